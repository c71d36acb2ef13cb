"""Mixed timestamp formats and zones to one UTC instant.

All formats are alternatives of one regular expression with named groups. One ``regexp_replace`` writes the
groups of whichever alternative matched into a delimited string, so each value is matched once; the rest is integer
arithmetic on the split parts (days from civil date, seconds of day, offset). Only a value without any written
offset needs a zone's rules, which ``to_utc_timestamp`` applies: of a local time that occurs twice it takes the
earlier instant, and one that the clocks skip moves on by the length of the skip.

Everything stays in JVM expressions: no shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names (English and German; the first three letters decide), zone abbreviations with minutes east of UTC, generic zones.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "ist": 330, "jst": 540, "mez": 60, "mesz": 120,
}
GENERIC = {"et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"}

_MONTH = (
    r"jan(?:uary|uar)?|feb(?:ruary|ruar)?|mar(?:ch)?|märz|mrz|apr(?:il)?|may|mai|june?|juni|july?|juli|aug(?:ust)?|"
    r"sept?(?:ember)?|o[ck]t(?:ober)?|nov(?:ember)?|de[cz](?:ember)?"
)
_DAY = r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*"
_CLOCK = r"(?<{p}h>\d{{1,2}})(?::?(?<{p}n>\d{{2}})(?::?(?<{p}s>\d{{2}})(?:[.,]\d+)?)?)?\s*(?:(?<{p}ap>[ap])\.?m\.?)?"
_NAMES = "|".join(sorted([*ABBREVIATIONS, *GENERIC], key=lambda x: (-len(x), x)))
_ZONE = rf"(?:\s*(?<zn>{_NAMES})(?![a-z]))?(?:\s*(?<zo>[+-]\d{{2}}:?\d{{2}}))?"
_DATE = "|".join([
    r"(?<iy>\d{4})(?<isep>[-/.])(?<im>\d{1,2})\k<isep>(?<id>\d{1,2})(?!\d)",
    r"(?<cy>\d{4})(?<cm>\d{2})(?<cd>\d{2})(?!\d)",
    rf"(?:{_DAY},?\s+)?(?<dd>\d{{1,2}})(?:st|nd|rd|th|\.)?[\s-]*(?<dm>{_MONTH})[\s.,-]+(?<dy>\d{{4}})",
    rf"(?:{_DAY},?\s+)?(?<em>{_MONTH})\.?\s+(?<ed>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<ey>\d{{4}})",
    r"(?<na>\d{1,2})(?<nsep>[/.-])(?<nb>\d{1,2})\k<nsep>(?<ny>\d{4}|\d{2})(?!\d)",
    r"(?<jy>\d{4})\s*[年년]\s*(?<jm>\d{1,2})\s*[月월]\s*(?<jd>\d{1,2})\s*[日일]",
])
#: One alternation for every format: epoch seconds or milliseconds, or [label] [clock "on"] date [clock] [zone].
PATTERN = (
    r"(?iu)^\s*(?:(?<epms>\d{13})|(?<eps>\d{9,10})|(?:[\p{L}][\p{L} ]*?\s*[:\-–]?\s+)??"
    rf"(?:(?<noon>12\s+noon|noon|midnight)\s+on\s+|{_CLOCK.format(p='p')}\s+on\s+)?"
    rf"(?:{_DATE})(?:(?:\s*(?:t|,|at|@|um)\s*|\s+){_CLOCK.format(p='')}\s*(?:uhr|h)?{_ZONE})?)\s*$"
)
_MARK = "\u0001"
_PARTS = {
    "ms": "${epms}", "sec": "${eps}", "y": "${iy}${cy}${dy}${ey}${ny}${jy}", "m": "${im}${cm}${jm}", "name": "${dm}${em}", "d": "${id}${cd}${dd}${ed}${jd}",
    "a": "${na}", "b": "${nb}", "sep": "${nsep}", "noon": "${noon}", "h": "${h}${ph}", "n": "${n}${pn}", "s": "${s}${ps}", "ap": "${ap}${pap}", "zn": "${zn}", "zo": "${zo}",
}


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integer arithmetic."""
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _lookup(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def instant_seconds(df: DataFrame, value: str, zone: str, day_first: str, out: str = "instant_s") -> DataFrame:
    """Rows whose column ``value`` states a real date, with ``out``: epoch seconds of that moment.

    Zone: the one written, else column ``zone`` (IANA name), else UTC. Numeric dates with the year last are read day
    before month where column ``day_first`` is true or dots separate, else month before day. Two-digit years are of
    this century. A date alone means local midnight at its start; fractions of a second are dropped. NULL, blank and
    unmatched values, impossible dates and clock times give no row. Columns of any name may be present; helper columns
    carry a prefix and are dropped.
    """
    p = "__instant_"
    keep = [F.col(f"`{k}`") for k in df.columns if k != out]
    text = F.regexp_replace(F.col(f"`{value}`"), PATTERN, _MARK + "|".join(_PARTS.values()))
    made = _bound(df, {p + "f": F.split(text, r"\|")})
    matched = F.substring(F.col(p + "f")[0], 1, 1) == _MARK
    part = {k: F.nullif(F.ltrim(F.get(F.col(p + "f"), F.lit(i)), F.lit(_MARK)), F.lit("")) for i, k in enumerate(_PARTS)}
    num = {k: part[k].try_cast("bigint") for k in ("ms", "sec", "y", "m", "d", "a", "b", "h", "n", "s")}
    made = _bound(made.where(matched), {p + k: c for k, c in (part | num).items()})
    c = lambda k: F.col(p + k)
    first = F.coalesce(F.col(f"`{day_first}`"), F.lit(False)) | F.coalesce(c("sep") == ".", F.lit(False))
    noon = F.lower(c("noon"))
    h = F.when(noon.endswith("noon"), F.lit(12)).when(noon == "midnight", F.lit(0)).otherwise(F.coalesce(c("h"), F.lit(0)))
    digits = F.regexp_replace(c("zo"), "[^0-9]", "")
    offset = F.when(F.substring(c("zo"), 1, 1) == "-", -60).otherwise(60) * (F.substring(digits, 1, 2).try_cast("bigint") * 60 + F.substring(digits, 3, 2).try_cast("bigint"))
    made = _bound(made, {
        p + "year": F.when(c("y") < 100, c("y") + 2000).otherwise(c("y")),
        p + "month": F.coalesce(c("m"), _lookup(MONTHS, F.lower(F.substring(c("name"), 1, 3))).cast("bigint"), F.when(first, c("b")).otherwise(c("a"))),
        p + "day": F.coalesce(c("d"), F.when(first, c("a")).otherwise(c("b"))),
        p + "hour": F.when(c("ap").isNull(), h).when(h.between(1, 12), h % 12 + F.when(F.lower(c("ap")) == "p", 12).otherwise(0)),
        p + "epoch": F.coalesce(c("sec"), F.floor(c("ms") / 1000)),
        p + "written": F.coalesce(offset, _lookup(ABBREVIATIONS, F.lower(c("zn"))) * 60).cast("bigint"),
        p + "zone": F.coalesce(_lookup(GENERIC, F.lower(c("zn"))), F.col(f"`{zone}`"), F.lit("UTC")),
    })
    minute, second = F.coalesce(c("n"), F.lit(0)), F.coalesce(c("s"), F.lit(0))
    real = c("month").between(1, 12) & (c("day") >= 1) & (c("day") <= days_in_month(c("year"), c("month"))) & c("hour").between(0, 23) & minute.between(0, 59) & second.between(0, 60)
    made = _bound(made, {p + "local": F.when(real, days_from_civil(c("year"), c("month"), c("day")) * 86400 + c("hour") * 3600 + minute * 60 + F.least(second, F.lit(59))).cast("bigint")})
    by_rules = F.floor(F.unix_micros(F.to_utc_timestamp(F.timestamp_seconds(c("local")), c("zone"))) / 1_000_000)
    seconds = F.when(c("epoch").isNotNull(), c("epoch")).when(c("written").isNotNull(), c("local") - c("written")).otherwise(by_rules)
    return made.select(*keep, seconds.cast("bigint").alias(out)).where(F.col(out).isNotNull())


def _bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` added through a one-row generator, which the optimizer doesn't collapse: each is computed once, not once a use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def iso_utc(seconds: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of epoch seconds, whatever the session's zone."""
    day = F.floor(seconds / 86400)
    rest = seconds - day * 86400
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")
    return F.concat(date, F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def normalise_instants(rows: DataFrame, key: str, fields: list[str], source: str, registry: DataFrame) -> DataFrame:
    """Long rows (``key``, field, instant) of every usable value of ``fields``.

    ``registry`` has source, time_zone and day_first, one row a source; a source that it lacks counts as UTC, month first.
    The fields are unpivoted before the join, so the regular expression runs in one place. The join is left to Spark,
    which broadcasts the registry only below its size threshold.
    """
    long = rows.select(F.col(f"`{key}`").alias(key), F.col(f"`{source}`").alias("__src"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields])).alias("__v"))
    long = long.select(key, "__src", "__v.field", "__v.value").where(F.col("value").isNotNull())
    reg = registry.select(F.col("source").alias("__src"), "time_zone", "day_first").dropDuplicates(["__src"])
    timed = instant_seconds(long.join(reg, "__src", "left"), "value", "time_zone", "day_first")
    return timed.select(key, "field", iso_utc(F.col("instant_s")).alias("instant"))
