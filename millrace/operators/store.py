"""Keyed tables: upserts, deletes, preferences. Each returns the new table; nothing is written in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import domain

ACTIONS = {"raise": 2.0, "lower": 0.5, "pin": 10.0, "block": 0.0}


def last_of_batch(incoming: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The latest row of each key of a batch; rows are reduced before they move."""
    return incoming.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in incoming.columns if c not in keys]), order).alias("__r")).select(*keys, "__r.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] | None = None, replace: list[str] | None = None) -> DataFrame:
    """Existing rows with incoming ones put in: columns ``keep`` stay as they were, or only ``replace`` change; NULL keys are dropped from the batch.

    ``incoming`` has one row a key (see ``last_of_batch``). One full outer join on the keys.
    """
    new = incoming.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*[F.col(k) for k in keys], F.struct(*[c for c in existing.columns if c not in keys and c in incoming.columns]).alias("__n"))
    old = existing.select(*keys, F.struct(*[c for c in existing.columns if c not in keys]).alias("__o"))
    both = old.join(new, keys, "full")
    changed = [c for c in existing.columns if c not in keys and c in incoming.columns and (c in replace if replace is not None else c not in (keep or []))]
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in changed:
            out.append(F.when(F.col("__n").isNotNull(), F.col("__n")[c]).otherwise(F.col("__o")[c]).alias(c))
        elif c in incoming.columns:
            out.append(F.when(F.col("__o").isNotNull(), F.col("__o")[c]).otherwise(F.col("__n")[c]).alias(c))
        else:
            out.append(F.col("__o")[c].alias(c))
    return both.select(*out)


def delete(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def cleared(table: DataFrame) -> DataFrame:
    """An empty table of the same columns."""
    return table.limit(0)


def preferences_of(prefs: DataFrame, user: str, host: str | None = None, actions: list[str] | None = None) -> DataFrame:
    """A user's preferences: all, those of one host (any spelling), or those of some actions."""
    kept = prefs.where(F.col("user_id") == user)
    if host is not None:
        kept = kept.where(F.col("domain") == F.regexp_replace(F.lower(F.lit(host)), r"^www\.", ""))
    return kept.where(F.col("action").isin(actions)) if actions is not None else kept


def checked_preferences(prefs: DataFrame) -> DataFrame:
    """Preferences with a normalised domain; rows of another action or without user or domain are dropped."""
    d = F.regexp_replace(F.lower("domain"), r"^www\.", "")
    return prefs.withColumn("domain", d).where(F.col("action").isin(*ACTIONS) & (F.col("domain") != "") & F.col("user_id").isNotNull())


def apply_preferences(results: DataFrame, prefs: DataFrame) -> DataFrame:
    """Results without blocked hosts, with ``adjusted`` scores: pinned ten times, raised twice, lowered half; a row without score counts 1/rank if adjusted, else 0.

    ``prefs`` are one user's. Pin goes before raise before lower. Rows that aren't URLs pass unchanged.
    """
    by = prefs.groupBy(F.col("domain").alias("__d")).agg(F.min(F.when(F.col("action") == "block", 0).when(F.col("action") == "pin", 1).when(F.col("action") == "raise", 2).otherwise(3)).alias("__a"))
    joined = results.withColumn("__d", domain(F.col("url"))).join(by, "__d", "left").where(F.col("__a").isNull() | (F.col("__a") != 0))
    score = F.nanvl(F.col("score"), F.lit(None).cast("double"))
    base = F.coalesce(score, 1 / F.coalesce(F.col("rank"), F.lit(1)))
    return joined.withColumn("adjusted", F.when(F.col("__a") == 1, base * 10).when(F.col("__a") == 2, base * 2).when(F.col("__a") == 3, base * 0.5).otherwise(F.coalesce(score, F.lit(0.0)))).drop("__d", "__a")
