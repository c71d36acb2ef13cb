"""Parquet tables of a data directory."""

from __future__ import annotations

import os

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


#: A single local file is spread over one task for each so many bytes, and over so many tasks at most.
SPLIT, TASKS = 1 << 17, 32


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet`` with only ``columns`` (all if none), so that the scan reads nothing else.

    A file is read in as many tasks as it has row groups. A single local file (test tables) of few row groups is spread by its
    size, which doesn't depend on the machine; a folder of files, as a table of any size is stored, is read as it lies.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    if os.path.isfile(path):
        want, have = min(TASKS, os.path.getsize(path) // SPLIT), pq.ParquetFile(path).metadata.num_row_groups
        if want > 2 * have:
            df = df.repartition(want)
    return df
