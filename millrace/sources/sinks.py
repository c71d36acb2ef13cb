"""Result sets as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row, in column ``value``."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))


def csv_field(c) -> object:
    """A quoted field, quotes doubled; NULL is empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def as_csv_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """One line a row with every field quoted and escaped."""
    return rows.select(F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in columns]).alias("value"))


def csv_with_metadata(rows: DataFrame, query: str, lens: str, at: str, *columns: str) -> DataFrame:
    """Lines ``value`` in order of ``place``: the metadata, the column names, then a quoted line a row (place 2 for all: rows have no order)."""
    spark, n = rows.sparkSession, rows.count()
    meta = ",".join('"' + x.replace('"', '""') + '"' for x in ("Metadata", f"Query: {query}", f"Lens: {lens}", f"Timestamp: {at}", f"Results: {n}"))
    head = spark.createDataFrame([(0, meta), (1, ",".join(columns))], "place int, value string")
    return head.unionByName(as_csv_lines(rows, *columns).select(F.lit(2).alias("place"), "value"))


def json_with_metadata(rows: DataFrame, query: str, lens: str, at: str) -> DataFrame:
    """The metadata object in place 0, then one object a row in place 1."""
    meta = rows.agg(F.count(F.lit(1)).alias("resultCount")).select(F.lit(0).alias("place"), F.to_json(F.struct(F.lit(query).alias("query"), F.lit(lens).alias("lens"), F.lit(at).alias("timestamp"), "resultCount")).alias("value"))
    return meta.unionByName(as_json_lines(rows).select(F.lit(1).alias("place"), "value"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
