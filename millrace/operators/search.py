"""The search pipeline over a corpus of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.functions.text import any_of
from millrace.operators.extraction import LENSES, record
from millrace.operators.ranking import keep_first
from millrace.operators.retrieval import query_terms, term_cosine
from millrace.operators.signals import confidence, intelligence, lens_boost, signals
from millrace.operators.views import content_way, enough
from millrace.plans import lens as L


def candidates(corpus: DataFrame, queries: list[str]) -> DataFrame:
    """Rows with URL and title whose title or description has a word of one of ``queries``."""
    words = sorted({w for q in queries for w in query_terms(q) if w not in ("site", "filetype", "gov", "com")})
    text = F.lower(F.concat_ws(" ", "title", "description"))
    return corpus.where(F.coalesce(F.col("url") != "", F.lit(False)) & F.coalesce(F.col("title") != "", F.lit(False)) & any_of(text, words))


def boosted(corpus: DataFrame, query: str, lens: str) -> DataFrame:
    """Candidates of all planned queries, the first of each URL, with ``domain``, ``boosted`` (score and lens boost) and ``text`` (title and description)."""
    rows = keep_first(candidates(corpus, L.plan(query, lens)), "url", "arrival")
    rows = rows.withColumn("domain", F.coalesce(F.nullif(F.col("domain"), F.lit("")), urls.domain(F.col("url"))))
    score = F.coalesce(F.nanvl(F.col("score"), F.lit(0.0)), F.lit(0.0)) + lens_boost(lens, F.col("domain"), F.col("url"), F.col("title"), F.col("description"))
    return rows.withColumns({"boosted": F.round(score, 6), "text": F.concat_ws(" ", "title", "description")})


def search(corpus: DataFrame, query: str, lens: str | None = None, k: int = 20, known: DataFrame | None = None) -> DataFrame:
    """The ``k`` best rows for ``query`` by the path of its lens.

    General: ordered by term similarity, then boosted score, then arrival, with spam score; procurement: by boosted score alone, without
    similarity or spam score (``similarity`` and ``spam_score`` are NULL). Both with how content is got, the typed record's
    signals, signals of the text and their confidence. Rows whose URL the store (``known``: url) has move up a place, so places may repeat.
    Two exchanges of candidates: the deduplication and the similarity's sums; the order is a top-k.
    """
    chosen = lens or L.classify_text(query)
    rows = boosted(corpus, query, chosen)
    if chosen == "procurement":
        rows = rows.withColumn("similarity", F.lit(None).cast("double"))
        best = rows.orderBy(F.desc("boosted"), "arrival").limit(k)
        spam = F.lit(None).cast("double")
    else:
        near = term_cosine(rows.select("result_id", "text"), query, "result_id", "text")
        rows = rows.join(near, "result_id", "left").withColumn("similarity", F.round(F.coalesce("similarity", F.lit(0.0)), 6))
        best = rows.orderBy(F.desc("similarity"), F.desc("boosted"), "arrival").limit(k)
        spam = F.round(urls.combined_spam(F.col("url")), 6)
    order = [F.desc("boosted"), F.asc("arrival")] if chosen == "procurement" else [F.desc("similarity"), F.desc("boosted"), F.asc("arrival")]
    best = best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # k rows
    if known is not None:
        best = best.join(known.where("url is not null").select("url").distinct().withColumn("hit", F.lit(True)), "url", "left")
        best = best.withColumn("place", F.when(F.col("hit"), F.greatest(F.lit(1), F.col("place") - 1)).otherwise(F.col("place")))
    total = F.aggregate(signals(F.col("text")), F.lit(0), lambda s, x: s + x["score"])
    found = enrich(best, chosen)
    return found.select(
        F.lit(chosen).alias("lens"), "place", "result_id", "title", "url", "domain", "source", "boosted", "similarity", spam.alias("spam_score"),
        content_way(F.lit(chosen), F.col("url")).alias("way"), "record_signals", confidence(total).alias("confidence"),
    )


def enrich(rows: DataFrame, lens: str, most: int = 30) -> DataFrame:
    """``rows`` (place, text, url, title) with the signals of the typed record that their lens extracts, NULL for a short text, a lens without records, or, under procurement, a place beyond ``most``."""
    if lens not in LENSES:
        return rows.withColumn("record_signals", F.lit(None).cast("string"))
    ready = enough(F.col("text")) & ((F.col("place") <= most) | F.lit(lens != "procurement"))
    made = record(lens, F.col("text"), F.col("url"), F.col("title"))
    return rows.withColumn("record_signals", F.when(ready, F.array_join(made["signals"], ", ")))


def insight(rows: DataFrame) -> DataFrame:
    """Signals, confidence and summary over the texts of result rows, one row."""
    return intelligence(rows.select("arrival", F.concat_ws(" ", "title", "description").alias("text")), "text", "arrival")
