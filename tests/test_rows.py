import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.operators import extraction, ranking, signals, state, store, summary
from millrace.plans import lens as L


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("url,domain,n", [("https://WWW.Foo.gov/x?a=1&b=2", "foo.gov", 2), ("not a url", "", 0), ("http://u@h.example:80", "h.example", 0), (None, "", None), ("https://a.example/?", "a.example", 0)])
def test_urls(spark, url, domain, n):
    assert one(spark, url, U.domain) == domain
    assert n is None or one(spark, url, U.parameters) == n


def test_spam_scores(spark):
    assert one(spark, "https://reddit.com/a", lambda u: U.total(U.url_penalties(u))) == 0.5
    assert one(spark, "bad", lambda u: U.combined_spam(u)) == 3.0
    assert one(spark, "https://x.xyz/?ref=1&a=1&b=1&c=1&d=1&e=1", lambda u: U.total(U.url_penalties(u))) == 2.5
    assert one(spark, "https://12.gov/" + "a" * 200, lambda u: U.combined_spam(u)) == pytest.approx(0.5 * (1 - 0.6 * 0.5))
    assert one(spark, "buy now click here limited time act now " + "w " * 40, lambda t: U.total(U.content_penalties(t))) == 2.0
    assert one(spark, "a b", lambda u: U.unwrap_redirect(F.concat(F.lit("/url?q="), U.encode_component(u)))) == "a b"


def test_keep_first_and_global_rank(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcde") if i % 9 else None, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "arrival long, url string, score int").repartition(7)
    first = {r.url: r.arrival for r in ranking.keep_first(df, "url", "arrival").collect()}
    assert first == {u: min(a for a, x, _ in rows if x == u) for u in "abcde"}
    ranks = ranking.global_rank(df, F.desc("score"), F.asc("arrival")).collect()
    assert [r.arrival for r in sorted(ranks, key=lambda r: r["rank"])] == [a for a, _, _ in sorted(rows, key=lambda r: (-r[2], r[0]))]
    assert sorted(r["rank"] for r in ranks) == list(range(1, 501))
    assert ranking.global_rank(df.limit(0), F.asc("arrival")).count() == 0


def test_upsert_delete_preferences(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "id long, title string, created string")
    new = spark.createDataFrame([(2, "c", "t1"), (3, None, "t1"), (None, "x", "t1")], "id long, title string, created string")
    assert sorted(map(tuple, store.upsert(old, new, ["id"], keep=["created"]).collect())) == [(1, "a", "t0"), (2, "c", "t0"), (3, None, "t1")]
    assert sorted(map(tuple, store.upsert(old, new, ["id"], replace=["title"]).collect())) == [(1, "a", "t0"), (2, "c", "t0"), (3, None, "t1")]
    assert [r.id for r in store.delete(old, new, ["id"]).collect()] == [1]
    assert store.last_of_batch(new.union(new), ["id"], F.col("title")).count() == 3
    prefs = store.checked_preferences(spark.createDataFrame([("u", "WWW.a.example", "pin"), ("u", "b.example", "block"), ("u", "c.example", "lower"), ("u", "d.example", "odd")], "user_id string, domain string, action string"))
    rows = spark.createDataFrame([("https://www.a.example/", 2.0, 1), ("https://b.example/", 2.0, 2), ("https://c.example", None, 4), ("nope", None, 5), ("https://d.example", 1.5, 6)], "url string, score double, rank int")
    assert {r.url: r.adjusted for r in store.apply_preferences(rows, prefs).collect()} == {"https://www.a.example/": 20.0, "https://c.example": 0.125, "nope": 0.0, "https://d.example": 1.5}


def _limit(times, limit, window):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if t - k < window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40).map(sorted), st.integers(1, 4), st.integers(1, 12))
def test_sliding_log_equals_the_definition(times, limit, window):
    log = state.SlidingLog(limit, window)
    assert [log.allow(t) for t in times] == _limit(times, limit, window)


def test_limiter_and_cache_over_sessions(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 2, 3]) if i % 20 else None, rng.randint(0, 400)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.allowed for r in state.rate_limit(df, "user_id", "ts", "event_id", 3, 10.0).collect()}
    hits = {r.event_id: r.hit for r in state.cache_replay(df, "user_id", "ts", "event_id", F.lit(5)).collect()}
    by = defaultdict(list)
    for i, u, s in rows:
        if u:
            by[u].append((s, i))
    for u, ev in by.items():
        ev.sort()
        assert [got[i] for _, i in ev] == _limit([s for s, _ in ev], 3, 10)
        stored, want = None, []
        for s, _ in ev:
            want.append(stored is not None and s - stored <= 5)
            if not want[-1]:
                stored = s
        assert [hits[i] for _, i in ev] == want
    assert len(got) == sum(map(len, by.values()))


def test_lenses(spark):
    for q, want in [("profile", "pdf"), ("", "web"), ("RFP bid", "procurement"), ("CLINIC news", "provider"), ("law study", "legal")]:
        assert L.classify_text(q) == want and one(spark, q, L.classify) == want
    assert L.expand("RFP services")["lens"] == "procurement" and "solicitation services" in L.expand("RFP services")["expansions"]
    assert len(L.plan("RFP")) == 13 and len(L.plan("city county")) == 9
    assert L.suggestions(spark.createDataFrame([("one of three",)], "query string")).count() == 10


def test_signals_and_records(spark):
    text = "Request for Proposal. Due date: May 3, 2026. Contact: a@b.gov, phone: 555-201-3344. Amount $1,200.50."
    df = spark.createDataFrame([(1, text), (2, None)], "o int, t string")
    assert [s.name for s in df.select(signals.signals(F.col("t")).alias("s")).first().s][:2] == ["includes deadline", "2026 active"]
    r = df.select(extraction.record("procurement", F.col("t"), F.lit(None), F.lit(None)).alias("r")).collect()
    assert (r[0].r.kind, r[0].r.due_date, r[0].r.email, r[0].r.amount) == ("RFP", "May 3, 2026", "a@b.gov", "$1,200.50") and r[1].r.confidence == 35
    got = signals.intelligence(df.where("t is not null"), "t", "o").first()
    assert 0 <= got.confidence <= 100 and got.n_signals >= 2
    c = df.select(F.explode(extraction.contacts(F.col("t"))).alias("c")).select("c.*").collect()
    assert [(x.type, x.value, x.label, x.confidence) for x in c] == [("email", "a@b.gov", "Primary Email", 95), ("phone", "555-201-3344", "Primary Phone", 90)]


def test_extractors_survive_long_plain_text(spark):
    text = "word " * 6000 + "7 " + "Abc def " * 3000
    df = spark.createDataFrame([(text,)], "t string")
    for lens in extraction.LENSES:
        assert df.select(extraction.record(lens, F.col("t"), F.lit(""), F.lit("")).alias("r")).first().r.confidence >= 35


def test_summaries(spark):
    rows = [(1, "Alpha", "The road works begin in spring. Road works end."), (2, "Beta", "Road works cost money"), (3, None, None), (4, "Tiny", "Short.")]
    df = spark.createDataFrame(rows, "k long, title string, d string")
    assert {r.phrase: r.n for r in summary.bigrams(df, "k", "d").collect()} == {"Road works": 3}
    assert {r.k: r.point for r in summary.key_points(df, "k", "title", "d").collect()} == {1: "The road works begin in spring", 2: "Road works cost money", 3: None, 4: "Tiny"}
    assert summary.ranked_sentences(df, "k", "title", "d").count() >= 3
    assert summary.bigrams(df.limit(0), "k", "d").count() == 0
