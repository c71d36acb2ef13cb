import calendar
import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest

from millrace.operators.instants import normalise_instants

REGISTRY = [("ny", "America/New_York", False), ("ldn", "Europe/London", True), ("blr", "Asia/Kolkata", True), ("none", None, False)]


def run(spark, rows):
    df = spark.createDataFrame([(i, s, v, None, "x") for i, (s, v) in enumerate(rows)], "opp_row long, source string, due_date string, posted_date string, time_zone string")
    reg = spark.createDataFrame(REGISTRY, "source string, time_zone string, day_first boolean")
    return {r.opp_row: r.instant for r in normalise_instants(df, "opp_row", ["due_date", "posted_date"], "source", reg).collect()}


CASES = [
    ("ny", "2026-03-26T16:25:35+0000", "2026-03-26T16:25:35Z"), ("ny", "2026-03-26T16:25:35", "2026-03-26T20:25:35Z"), ("none", "2024-02-27 11:36:30", "2024-02-27T11:36:30Z"), ("ldn", "2024-07-03", "2024-07-02T23:00:00Z"),
    ("ny", "1752480525", "2025-07-14T08:08:45Z"), ("ny", "1786330090901", "2026-08-10T02:48:10Z"), ("blr", "20250114T023757Z", "2025-01-14T02:37:57Z"), ("ny", "01/16/2026 00:00", "2026-01-16T05:00:00Z"),
    ("ldn", "16/01/2026 00:00", "2026-01-16T00:00:00Z"), ("ny", "15.08.2024 14:30 Uhr", "2024-08-15T18:30:00Z"), ("ny", "3/30/24", "2024-03-30T04:00:00Z"), ("ny", "12 noon on November 20, 2025", "2025-11-20T17:00:00Z"),
    ("ny", "Sat, 09 Nov 2024 14:50:31 -0600", "2024-11-09T20:50:31Z"), ("none", "17-Oct-2026 12:00", "2026-10-17T12:00:00Z"), ("none", "Deadline - October 14, 2024", "2024-10-14T00:00:00Z"), ("ny", "due 1:30 PM on 04/27/2024", "2024-04-27T17:30:00Z"),
    ("blr", "August 28th, 2025 @ 9:38 AM", "2025-08-28T04:08:00Z"), ("none", "May 18, 2026 at 6:08 am CDT", "2026-05-18T11:08:00Z"), ("none", "Closes Mar 12, 2024 10:48 PM PT", "2024-03-13T05:48:00Z"), ("none", "6. März 2024, 5:35 Uhr", "2024-03-06T05:35:00Z"),
    ("none", "2025年2月24日 01:05", "2025-02-24T01:05:00Z"), ("none", "July 6, 2026 8:03 PM UTC+05:30", "2026-07-06T14:33:00Z"), ("none", "2026-07-02T00:00:00.241000250+00:00", "2026-07-02T00:00:00Z"), ("unlisted", "2024-01-01 00:00:00", "2024-01-01T00:00:00Z"),
    ("ny", "2024-11-03T01:30:00", "2024-11-03T05:30:00Z"),  # occurs twice: the earlier
    ("ny", "2024-03-10T02:09", "2024-03-10T07:09:00Z"),  # skipped: moves on by an hour
    *[("ny", v, None) for v in ("02/30/2026", "00/00/0000", "2026-13-05 10:00", "TBD", "", " ", "-", "N/A", "Ongoing", None, "2024-02-29 25:00", "13:00 PM on 04/01/2024", "x" * 5000)],
]


def test_forms(spark):
    got = run(spark, [(s, v) for s, v, _ in CASES])
    assert {i: got.get(i) for i in range(len(CASES))} == {i: w for i, (_, _, w) in enumerate(CASES)}


def test_equals_the_standard_library(spark):
    rng = random.Random(7)
    rows, want = [], []
    for _ in range(400):
        source, zone, day_first = rng.choice(REGISTRY)
        t = dt.datetime(rng.randint(1990, 2035), rng.randint(1, 12), 1, rng.randint(0, 23), rng.randint(0, 59)) + dt.timedelta(days=rng.randint(0, 27))
        form = rng.choice(["%Y-%m-%dT%H:%M", "%d %B %Y %H:%M", "%B %d, %Y, %I:%M %p", "%d/%m/%Y %H:%M" if day_first else "%m/%d/%Y %H:%M", "%d.%m.%Y %H:%M", "%d-%b-%Y %H:%M"])
        rows.append((source, t.strftime(form)))
        local = t.replace(tzinfo=ZoneInfo(zone or "UTC"), fold=0)
        want.append(dt.datetime.fromtimestamp(calendar.timegm(local.utctimetuple()), dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    got = run(spark, rows)
    assert [got[i] for i in range(len(rows))] == want


def test_session_zone_makes_no_difference(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert run(spark, [("ny", "2026-03-26T16:25:35")])[0] == "2026-03-26T20:25:35Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_empty(spark):
    assert run(spark, [("ny", None)]) == {}


@pytest.mark.parametrize("y,m,d", [(1970, 1, 1), (2000, 2, 29), (1900, 3, 1), (2024, 12, 31), (1600, 1, 1)])
def test_days_from_civil(spark, y, m, d):
    from pyspark.sql import functions as F

    from millrace.operators.instants import days_from_civil

    got = spark.range(1).select(days_from_civil(F.lit(y), F.lit(m), F.lit(d)).alias("n")).first().n
    assert got == (dt.date(y, m, d) - dt.date(1970, 1, 1)).days
