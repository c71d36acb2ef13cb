import numpy as np

from millrace.llm import neighbours as G


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, -row))[:k]] for i, row in zip(ids, s)}


def test_recall_copies_and_unusable(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 32))
    x = np.concatenate([c + 0.45 * rng.standard_normal((15, 32)) for c in centres]).astype(np.float32)
    x[7] = x[8] = x[9]
    ids = np.arange(1, len(x) + 1)
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x)] + [(9001, None, 0), (9002, [0.0] * 32, 0), (9003, [1.0], 0), (9004, [float("nan")] * 32, 0)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>, node int")
    got = {}
    for r in G.most_similar(df, k=5, dim=32).collect():
        got.setdefault(r.a, []).append((r.place, r.b))
    want = brute(ids, x.astype(np.float64), 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hit = sum(len({b for _, b in got[a]} & set(want[a])) for a in want)
    assert hit / (5 * len(want)) >= 0.97
    assert [b for _, b in sorted(got[8])][:2] == [9, 10]


def test_many_equal_vectors_take_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(50)] + [(99, [4.0, 1.0, 0.0, 0.0])], "doc_id long, embedding array<float>")
    got = {(r.a, r.place): r.b for r in G.most_similar(df, k=3, dim=4).collect()}
    assert [got[(40, p)] for p in (1, 2, 3)] == [0, 1, 2] and [got[(1, p)] for p in (1, 2, 3)] == [0, 2, 3] and [got[(99, p)] for p in (1, 2, 3)] == [0, 1, 2]


def test_chunks_bound_a_block(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 64)
    rng = np.random.default_rng(2)
    x = (rng.standard_normal(8) + 0.1 * rng.standard_normal((300, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<float>")
    assert G.most_similar(df, k=5, dim=8).count() == 1500


def test_chunks_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 64)
    rng = np.random.default_rng(2)
    x = (rng.standard_normal(8) + 0.1 * rng.standard_normal((600, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<float>")
    want = brute(np.arange(len(x)), x.astype(np.float64), 5)
    got = G.most_similar(df, k=5, dim=8).collect()
    assert sum(r.b in want[r.a] for r in got) / (5 * len(x)) >= 0.9


def test_empty(spark):
    assert G.most_similar(spark.createDataFrame([], "doc_id long, embedding array<float>"), dim=4).count() == 0


def test_greedy_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24))
    x = np.concatenate([c + 0.4 * rng.standard_normal((14, 24)) for c in centres]).astype(np.float32)
    x[20] = x[21]
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + [(5000, None)], "doc_id long, embedding array<float>")
    got = {}
    for r in G.search(df, df.where("doc_id % 20 = 0"), dim=24).collect():
        got.setdefault(r.query, []).append((r.place, r.b))
    want = brute(ids, x.astype(np.float64), 5)
    assert set(got) == {i for i in range(0, len(x), 20)} and sorted(got[20])[0][1] == 21
    assert sum(len({b for _, b in got[q]} & set(want[q])) for q in got) / (5 * len(got)) >= 0.9
    new = (x[::14][:20] + 0.05 * rng.standard_normal((20, 24))).astype(np.float32)
    asked = spark.createDataFrame([(9000 + i, v.tolist()) for i, v in enumerate(new)], "doc_id long, embedding array<float>")
    got = {}
    for r in G.search(df, asked, dim=24).collect():
        got.setdefault(r.query, set()).add(r.b)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {9000 + i: set(np.argsort(-(u @ v))[:5].tolist()) for i, v in enumerate(new)}
    assert sum(len(got.get(q, set()) & best[q]) for q in best) / 100 >= 0.9
