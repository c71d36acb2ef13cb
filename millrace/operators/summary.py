"""Extractive summaries of result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import summary_terms
from millrace.sources.staging import staged


def word_weights(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, weight): ln(N / rows with the word) + 1 over all rows, NULL texts counting as empty."""
    words = docs.select(key, F.explode(F.array_distinct(summary_terms(F.col(text)))).alias("word"))
    n = docs.count()
    return words.groupBy("word").agg((F.ln(F.lit(float(n)) / F.count(F.lit(1))) + 1).alias("weight"))


def sentences(text: Column, least: int) -> Column:
    """Pieces between runs of ``.!?`` that are longer than ``least`` when trimmed."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > least)


def ranked_sentences(docs: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, pos, sentence, score): mean weight of a sentence's words over "title. text", words without weight counting 0."""
    weights = word_weights(docs, key, text)
    body = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(". "), F.coalesce(F.col(text), F.lit("")))
    each = docs.select(key, F.posexplode(sentences(body, 10)).alias("pos", "sentence"))
    words = each.select(key, "pos", F.explode(summary_terms(F.col("sentence"))).alias("word")).groupBy(key, "pos", "word").agg(F.count(F.lit(1)).alias("n"))
    score = words.join(weights, "word", "left").groupBy(key, "pos").agg((F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("score"))
    return each.join(score, [key, "pos"], "left").select(key, "pos", "sentence", F.coalesce("score", F.lit(0.0)).alias("score"))


def key_points(docs: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, point): the first sentence longer than 20, else the title."""
    return docs.select(key, F.coalesce(F.get(sentences(F.col(text), 20), F.lit(0)), F.nullif(F.col(title), F.lit(""))).alias("point"))


def assembled(docs: DataFrame, key: str, title: str, text: str, query: str) -> DataFrame:
    """One row (summary, key_points, topics, confidence): the three best sentences after an opening, cut at 300 characters; key points of the first five rows, each once; topics; and 0.6 plus 0.05 a row, at most 0.95.

    Each part is a top-k, so at most eight rows a part come together. Without any sentence the summary says so in general words.
    """
    best = ranked_sentences(docs, key, title, text).orderBy(F.desc(F.round("score", 6)), key, "pos").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("score", 6)).alias("s"), F.col(key).alias("k"), "pos", "sentence"))), lambda x: x["sentence"]), ". ").alias("said"))
    points = key_points(docs.orderBy(key).limit(5), key, title, text).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "point"))), lambda x: x["point"])).alias("key_points"))
    topics = bigrams(docs, key, text).agg(F.collect_list("phrase").alias("topics"))
    n = docs.agg(F.least(F.lit(0.6) + F.count(F.lit(1)) * 0.05, F.lit(0.95)).alias("confidence"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    row = one(best).join(one(points), "__one").join(one(topics), "__one").join(one(n), "__one")  # one row each
    opening = F.lit(f"{query} is a topic with extensive resources available across multiple platforms. ")
    none = F.lit(f'Based on the search results for "{query}", multiple authoritative sources provide comprehensive information on this topic.')
    return row.select(F.when(F.col("said") != "", F.substring(F.concat(opening, "said", F.lit(".")), 1, 300)).otherwise(none).alias("summary"), F.array_join("key_points", " | ").alias("key_points"), F.array_join("topics", " | ").alias("topics"), F.round("confidence", 6).alias("confidence"))


def bigrams(docs: DataFrame, key: str, text: str, k: int = 8) -> DataFrame:
    """(phrase, n): pairs of neighbouring words that occur more than once, the ``k`` most frequent, ties by first occurrence.

    The word stream runs on over rows in key order. Within a row pairs come from its own array; across rows only each
    row's first and last word move, so the window over all rows holds two words a row.
    """
    rows = docs.select(F.col(key).alias("k"), summary_terms(F.col(text)).alias("w")).where(F.size("w") > 0)
    inner = rows.where(F.size("w") > 1).select("k", F.posexplode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("pos", "phrase"))
    inner = inner.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "pos")).alias("at"))
    ends = rows.select("k", F.get("w", F.lit(0)).alias("first"), F.element_at("w", -1).alias("last"), (F.size("w") - 1).alias("pos"))
    # neighbours of rows: lead within a partition of rows, and the first word of the next partition, one row a partition;
    # stored, since both reads must see the same partitions
    part = staged(ends.repartitionByRange("k").sortWithinPartitions("k").withColumn("p", F.spark_partition_id()), "row-ends")
    w = Window.partitionBy("p").orderBy("k")
    part = part.withColumn("next", F.lead("first").over(w))
    heads = part.groupBy("p").agg(F.min_by("first", "k").alias("head"))
    heads = heads.select(F.lag("p").over(Window.orderBy("p")).alias("p"), "head").where(F.col("p").isNotNull())
    cross = part.join(F.broadcast(heads), "p", "left").withColumn("next", F.coalesce("next", "head")).where(F.col("next").isNotNull())
    cross = cross.groupBy(F.concat("last", F.lit(" "), "next").alias("phrase")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "pos")).alias("at"))
    both = inner.unionByName(cross).groupBy("phrase").agg(F.sum("n").alias("n"), F.min("at").alias("at")).where(F.col("n") > 1)
    return both.orderBy(F.desc("n"), "at").limit(k).select(F.concat(F.upper(F.substring("phrase", 1, 1)), F.substring("phrase", 2, 10_000)).alias("phrase"), "n")
