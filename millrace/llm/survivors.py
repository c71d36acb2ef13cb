"""One surviving record of each group of duplicate records, chosen field by field.

Fields are unpivoted into long rows (group, field, value), rows of one value are added up before anything is moved
further, each value gets its standing, ``max_by`` picks the winner of a field, and the winners are pivoted back.

Standing is a pluggable aggregate: ``votes`` (the sum over a value's records of source trust times recency decay) or
``best_record`` (the best single record behind the value: highest trust, then latest, then smallest id).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Visit-tracking and session parameters of URLs; placeholders that stand for no value (compared in lower case without ending dots).
TRACKING = [
    "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "fbclid", "msclkid", "yclid", "twclid", "ttclid", "igshid", "mc_cid", "mc_eid", "_ga", "_gl", "_hsenc", "_hsmi",
    "ref", "referrer", "referer", "sessionid", "session_id", "session", "sid", "phpsessid", "jsessionid", "aspsessionid", "cfid", "cftoken", "spm", "trk",
]
PLACEHOLDERS = [
    "-", "--", "—", "–", "n/a", "na", "none", "(none)", "null", "nil", "undefined", "unknown", "tbd", "tba", "untitled", "untitled document", "untitled page", "no title", "(no title)", "no description",
    "no description available", "description not provided", "description not available", "description unavailable", "not available", "not provided", "no summary available", "title not provided", "no title available", "?",
]
_CUT = r"(\.{3,}|…|\[\s*(\.{2,}|…)\s*\]|\(\s*(\.{3}|…|more)\s*\)|read more|»)\s*$"
#: Code points by which values of one group are first told apart when beginnings are searched.
SALT = 16


def page_key(url: Column) -> Column:
    """The page that a URL addresses, as text, or NULL for a blank one.

    Scheme, user part, host case, leading "www.", default ports, trailing slashes, fragment, order of parameters and
    tracking or session parameters (also ``;jsessionid=``) are left out. The path's case stays.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"^www\.|:(80|443)?$|\.(?=:|$)", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(?i);jsessionid=[^/;?]*|/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    name = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
    kept = F.filter(F.split(query, "[&;]"), lambda p: (p != "") & ~name(p).isin(TRACKING) & ~name(p).startswith("utm_"))
    return F.when(F.trim(url) != "", F.concat(host, path, F.lit("?"), F.array_join(F.array_sort(kept), "&")))


def stated(value: Column) -> Column:
    """Not NULL, blank or a placeholder."""
    plain = F.regexp_replace(F.lower(F.trim(value)), r"\s*\.+$", "")
    return F.coalesce((F.regexp_replace(value, r"[\s ​﻿]+", "") != "") & ~plain.isin(PLACEHOLDERS) & (plain != ""), F.lit(False))


def cut_off(value: Column) -> Column:
    """Marked as cut off at its end."""
    return F.coalesce(value.rlike("(?i)" + _CUT), F.lit(False))


#: Fields whose values are prose: one may be cut off, or be a beginning of another. Fields that hold addresses: the spelling without parameters of visits is taken.
PROSE, ADDRESSES = ("title", "description"), ("url",)


def _tracked(value: Column) -> Column:
    """How many parameters of visits or sessions, and fragments, an address carries."""
    names = "|".join(re.escape(x) for x in TRACKING)
    return F.regexp_count(value, F.lit(rf"(?i)[?&;](?:utm_\w*|{names})(?:=|&|;|#|$)|#."))


def values_of_groups(rows: DataFrame, group: Column, fields: list[str], record: str, source: str, seen: str, registry: DataFrame, half_life_days: float = 180.0) -> DataFrame:
    """(g1, g2, field, value, page, n, best, votes): one row for each distinct value of a group, added up over its records before it moves.

    g1 and g2 are hashes of the group's name, ``page``, so that the name need not move with each value. ``best`` orders
    records: trust, then time, then the negative record id. A source that the registry lacks has trust -1, a missing time is before all others.
    ``votes`` decays by half every ``half_life_days`` before 2100-01-01; votes are compared by their logarithms, so only
    differences of time matter.
    """
    reg = registry.select(F.col("source").alias("__s"), F.col("trust").alias("__trust")).dropDuplicates(["__s"])
    long = rows.select(
        group.alias("__g"), F.col(f"`{source}`").alias("__s"), F.col(f"`{seen}`").alias("__at"), F.col(f"`{record}`").alias("__id"),
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]).alias("__v"),
    ).where(F.col("__g").isNotNull())
    trust = F.coalesce(F.col("__trust"), F.lit(-1))
    age = F.datediff(F.lit("2100-01-01").cast("date"), F.col("__at").cast("date"))
    long = long.join(reg, "__s", "left").select(
        F.xxhash64("__g").alias("g1"), F.hash("__g").alias("g2"), "__g",
        F.named_struct(F.lit("trust"), trust, F.lit("at"), F.coalesce(F.col("__at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")), F.lit("neg"), -F.col("__id")).alias("best"),
        (F.greatest(trust, F.lit(0)) * F.pow(F.lit(0.5), F.coalesce(age, F.lit(50_000)) / F.lit(half_life_days))).alias("vote"), F.explode("__v").alias("__v"),
    )
    return long.groupBy("g1", "g2", "__v.field", "__v.value").agg(F.first("__g").alias("page"), F.count(F.lit(1)).alias("n"), F.max("best").alias("best"), F.sum("vote").alias("votes"))


def mark_beginnings(values: DataFrame) -> DataFrame:
    """Adds ``beginning``: the value is a strict beginning of another value of its group and field.

    Sorted by code point, a beginning stands right before a value that it begins. Values are sorted within their first
    ``SALT`` code points, so that a group with very many values is spread over many tasks; a shorter value can only
    begin one whose first ``SALT`` code points it begins, and those are compared once each.
    """
    salt, keys = F.substring("value", 1, SALT), ["g1", "g2", "field"]
    short = F.coalesce(F.length("value"), F.lit(0)) < SALT
    following = F.lead("value").over(Window.partitionBy(*keys, salt).orderBy("value"))
    long = values.where(~short).withColumn("beginning", F.coalesce(following.startswith(F.col("value")), F.lit(False)))
    heads = values.where(F.col("value").isNotNull()).select(*keys, salt.alias("head")).distinct()
    begun = heads.withColumn("next", F.lead("head").over(Window.partitionBy(*keys).orderBy("head"))).where((F.length("head") < SALT) & F.col("next").startswith(F.col("head")))
    begun = begun.select(*keys, F.col("head").alias("value"), F.lit(True).alias("begun"))
    rest = values.where(short).join(begun, [*keys, "value"], "left").withColumn("beginning", F.coalesce("begun", F.lit(False))).drop("begun")
    return long.unionByName(rest)


def choose(values: DataFrame, standing: str = "best_record", least: int = 2) -> DataFrame:
    """(g1, g2, field, vh, result_id, n_records): of each group of at least ``least`` records, the winning complete value of each field, as a hash.

    Complete: not NULL, blank or a placeholder, and for prose not marked as cut off and no strict beginning of another value. A field
    without a complete value has no row. ``best_record`` takes the value behind the best single record. ``votes`` adds up
    the votes of all values that are the same but for case and white space, or for an address address the same page, and takes
    the normal form with most votes and its best spelling (fewest parameters of visits, then the best record); equal votes
    go to the better single record. Once values are judged, only their hashes move.
    """
    prose, address = F.col("field").isin(*PROSE), F.col("field").isin(*ADDRESSES)
    judged = mark_beginnings(values.where(prose)).unionByName(values.where(~prose).withColumn("beginning", F.lit(False)))
    whole = stated(F.col("value")) & ~(prose & cut_off(F.col("value"))) & ~F.col("beginning")
    normal = F.when(address, F.lit(0)).otherwise(F.xxhash64(F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))))
    keys = ["g1", "g2", "field"]
    small = judged.select(*keys, F.xxhash64("value").alias("vh"), normal.alias("nh"), "n", "best", "votes", F.when(address, -_tracked(F.col("value"))).otherwise(0).alias("clean"), whole.alias("whole"))
    if standing == "votes":
        spelling = F.struct("clean", "best", "vh")
        small = small.groupBy(*keys, "nh").agg(F.sum("n").alias("n"), F.max(F.when(F.col("whole"), spelling)).alias("s"), F.sum(F.when(F.col("whole"), F.col("votes"))).alias("votes"))
        by = F.struct(F.coalesce(F.round(F.log2(F.nullif(F.col("votes"), F.lit(0.0))), 9), F.lit(-1e9)).alias("v"), F.col("s.best"))
        small = small.select(*keys, "n", F.col("s").isNotNull().alias("whole"), by.alias("by"), F.col("s.vh").alias("vh"), F.col("s.best").alias("best"))
    else:
        small = small.withColumn("by", F.col("best"))
    won = small.groupBy(*keys).agg(F.sum("n").alias("n_records"), F.max(F.when(F.col("whole"), F.struct("by", "vh", "best"))).alias("w"))
    return won.where((F.col("n_records") >= least) & F.col("w").isNotNull()).select(*keys, F.col("w.vh").alias("vh"), (-F.col("w.best.neg")).alias("result_id"), "n_records")


def survivors(values: DataFrame, fields: list[str], standing: str = "votes", least: int = 2) -> DataFrame:
    """One row a group: page STRING, each of ``fields`` and n_records; a field without a complete value is NULL, a group without any has no row."""
    keys = ["g1", "g2", "field", "vh"]
    won = choose(values, standing, least).join(values.select(*keys[:3], F.xxhash64("value").alias("vh"), "value", "page"), keys)
    one = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return won.groupBy("g1", "g2").agg(F.max("page").alias("page"), *one, F.max("n_records").alias("n_records")).drop("g1", "g2")
