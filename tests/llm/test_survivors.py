import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.llm import survivors as S


def test_page_key(spark):
    urls = ["http://WWW.A.example:80/x/?b=2&a=1#top", "https://a.example/x?a=1&b=2&utm_source=q&sessionid=3", "https://a.example:443/x/?gclid=1&b=2&a=1", "https://a.example/X?a=1&b=2", None, " ", "https://a.example/x?a=2"]
    keys = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(S.page_key(F.col("u")).alias("k")).collect()]
    assert keys[0] == keys[1] == keys[2] and len({keys[0], keys[3], keys[6]}) == 3 and keys[4] is None and keys[5] is None


def test_winners_equal_brute_force(spark):
    rng = random.Random(4)
    trust = {"a": 3, "b": 2, "c": 2}
    vals = ["Road works", "Road works in May", "Road", "Untitled", None, "", " ", "N/A", "Cut off…", "Cut [...]", "Road works in May 2024 and after", "Another thing entirely, quite long", "R"]
    rows = [(i, f"http://h.example/{rng.randint(1, 25)}", rng.choice(["a", "b", "c", "zz", None]), rng.choice([None, dt.datetime(2025, 1, rng.randint(1, 3))]), rng.choice(vals)) for i in range(300)]
    df = spark.createDataFrame(rows, "result_id long, url string, source string, fetched_at timestamp, title string")
    reg = spark.createDataFrame(list(trust.items()), "source string, trust int")
    v = S.values_of_groups(df, S.page_key(F.col("url")), ["title"], "result_id", "source", "fetched_at", reg)
    got = {(r.field, r.result_id) for r in S.choose(v).collect()}
    want = set()
    for u in {r[1] for r in rows}:
        g = [r for r in rows if r[1] == u]
        ok = [r for r in g if r[4] and r[4].strip() and r[4] not in ("Untitled", "N/A") and not r[4].endswith(("…", "[...]")) and not any(o[4] and o[4] != r[4] and o[4].startswith(r[4]) for o in g)]
        if len(g) > 1 and ok:
            want.add(("title", max(ok, key=lambda r: (trust.get(r[2], -1), r[3] or dt.datetime.min, -r[0]))[0]))
    assert got == want


def test_votes_sum_over_sources_and_pivot(spark):
    at = dt.datetime(2025, 1, 1)
    rows = [(1, "http://h.example/1", "low", at, "T one"), (2, "http://h.example/1", "low2", at, "T one"), (3, "http://h.example/1", "high", at, "T two"), (4, "http://h.example/2", "high", at, "alone")]
    df = spark.createDataFrame(rows, "result_id long, url string, source string, fetched_at timestamp, title string")
    reg = spark.createDataFrame([("low", 40), ("low2", 40), ("high", 60)], "source string, trust int")
    v = S.values_of_groups(df, S.page_key(F.col("url")), ["title"], "result_id", "source", "fetched_at", reg)
    assert [(r.title, r.n_records) for r in S.survivors(v, ["title"]).collect()] == [("T one", 3)]
    assert [r.title for r in S.survivors(v, ["title"], "best_record").collect()] == ["T two"]
    assert S.choose(v.limit(0)).count() == 0


def test_clean_addresses_and_normal_forms_win(spark):
    at = dt.datetime(2025, 1, 1)
    rows = [(i, "https://a.example/x", "high", at, "T one ") for i in range(3)] + [(3, "https://a.example/x?utm_source=mail", "high", at, "Other"), (4, "http://a.example/x#top", "high", at, "t  One"), (5, "https://a.example/x?sid=1", "high", at, "Other")]
    df = spark.createDataFrame(rows, "result_id long, url string, source string, fetched_at timestamp, title string")
    reg = spark.createDataFrame([("high", 60)], "source string, trust int")
    v = S.values_of_groups(df, S.page_key(F.col("url")), ["title", "url"], "result_id", "source", "fetched_at", reg)
    got = S.survivors(v, ["title", "url"]).collect()
    assert [(r.url, r.title, r.n_records) for r in got] == [("https://a.example/x", "T one ", 6)]
