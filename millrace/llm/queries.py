"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import boilerplate, chunking, namevariants, neighbours, packing, sentences, stuffing, survivors, tokens
from millrace.sources.tables import table


def _pages(spark, sf_dir):
    """Texts of both tables under one page number: twice the row's id, plus one for results."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text").select((F.col("doc_id") * 2).alias("page"), stuffing.language_code(F.col("lang")).alias("lang"), "text")
    rows = table(spark, sf_dir, "results", "result_id", "description").select((F.col("result_id") * 2 + 1).alias("page"), F.lit(None).cast("string").alias("lang"), F.col("description").alias("text"))
    return docs.unionByName(rows)


def p1_found(spark, sf_dir):
    found = stuffing.stuffed_pages(_pages(spark, sf_dir))
    return found.select(F.when(F.col("page") % 2 == 1, "results").otherwise("documents").alias("tbl"), F.floor(F.col("page") / 2).cast("bigint").alias("row_id"))


def p2_classes(spark, sf_dir):
    return namevariants.classes(table(spark, sf_dir, "opportunities", "organization")).select("org", "class_id")


def p2_found(spark, sf_dir):
    return namevariants.pairs(namevariants.classes(table(spark, sf_dir, "opportunities", "organization")))


def p3_pieces(spark, sf_dir):
    return chunking.split_long(table(spark, sf_dir, "documents", "doc_id", "text"))


def p3_found(spark, sf_dir):
    return p3_pieces(spark, sf_dir).where(F.col("piece_no") == 1).select("doc_id")


def _page_values(spark, sf_dir, fields):
    rows = table(spark, sf_dir, "results", "result_id", "url", "source", "fetched_at", "title", "description")
    return survivors.values_of_groups(rows, survivors.page_key(F.col("url")), fields, "result_id", "source", "fetched_at", table(spark, sf_dir, "source_registry"))


def p4_found(spark, sf_dir):
    return survivors.choose(_page_values(spark, sf_dir, ["title", "description"]), "best_record").select("field", "result_id")


def p4_survivors(spark, sf_dir):
    fields = ["title", "description", "url", "source"]
    return survivors.survivors(_page_values(spark, sf_dir, fields), fields, "votes")


def p6_neighbours(spark, sf_dir):
    return neighbours.most_similar(table(spark, sf_dir, "documents", "doc_id", "embedding"))


def p6_found(spark, sf_dir):
    near = p6_neighbours(spark, sf_dir)
    return near.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


def p6_search(spark, sf_dir):
    """The documents whose id is divisible by 20 as queries against all."""
    docs = table(spark, sf_dir, "documents", "doc_id", "embedding")
    return neighbours.search(docs, docs.where(F.col("doc_id") % 20 == 0))


def _stuffed(spark, sf_dir):
    """The rows of p1_found that are documents, as page numbers."""
    return stuffing.stuffed_pages(_pages(spark, sf_dir)).where(F.col("page") % 2 == 0)


def _texts(spark, sf_dir):
    """Texts of both tables that hold bodies, under page numbers: twice the row's id, plus one for extracted documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select((F.col("doc_id") * 2).alias("page"), "text")
    extracts = table(spark, sf_dir, "extracted_documents", "extract_id", "text").select((F.col("extract_id") * 2 + 1).alias("page"), "text")
    return docs.unionByName(extracts)


def _named(rows, *columns):
    return rows.select(F.when(F.col("page") % 2 == 1, "extracted_documents").otherwise("documents").alias("tbl"), F.floor(F.col("page") / 2).cast("bigint").alias("row_id"), *columns)


def p7_found(spark, sf_dir):
    body = _texts(spark, sf_dir).join(_stuffed(spark, sf_dir), "page", "left_anti")
    return _named(boilerplate.find_furniture(body), "line_no")


def p7_body(spark, sf_dir):
    """Every text of documents and extracted_documents without its furniture lines; a stuffed page's body is empty."""
    pages = _texts(spark, sf_dir).join(_stuffed(spark, sf_dir).withColumn("stuffed", F.lit(True)), "page", "left")
    text = F.when(F.col("stuffed") & F.col("text").isNotNull(), "").otherwise(F.col("text"))
    return _named(boilerplate.bodies(pages.select("page", text.alias("text"))), "body")


def p8_ids(spark, sf_dir):
    return tokens.encode(table(spark, sf_dir, "documents", "doc_id", "text"))


def p9_containers(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def p10_found(spark, sf_dir):
    return sentences.sentence_starts(table(spark, sf_dir, "documents", "doc_id", "lang", "text"), lang="lang")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_classes, p3_found, p3_pieces, p4_found, p4_survivors, p6_found, p6_neighbours, p6_search, p7_found, p7_body, p8_ids, p9_containers, p10_found)}
ORACLE: dict[str, str] = {}
