"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.session import checkpoint_dir

_folders: dict[str, SparkSession] = {}


def clear() -> None:
    """Removes the tables staged so far. Results that still read them can't be computed afterwards; called when the program ends."""
    for folder, spark in list(_folders.items()):
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder stays
            pass
        _folders.pop(folder, None)


atexit.register(clear)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read back: its lineage ends there, so a lost executor costs only a read.

    Runs a job at once. All tables of a program lie in one folder, which goes when the program ends.
    """
    folder = f"{checkpoint_dir(df.sparkSession)}/millrace-{df.sparkSession.sparkContext.applicationId}"
    _folders[folder] = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
