import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.chunking import cuts, landmarks, split_long


def prose(n, seed=0):
    rng = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(4, 14))) + rng.choice([". ", ".\n", ".\n\n"]))
    return "".join(out)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n日本。é", max_size=3000))
def test_pieces_are_within_the_limit_and_lose_nothing(text):
    ends = cuts(text, 200, 20, 60, 64)
    starts = [0, *ends[:-1]]
    assert ends[-1] == len(text)
    assert "".join(text[a:b] for a, b in zip(starts, ends)) == text
    assert all(b - max(0, a - 20) <= 200 for a, b in zip(starts, ends))


def test_cuts_fall_on_natural_boundaries():
    text = prose(40_000)
    ends = cuts(text, 4000, 200, 1200, 1024)
    assert all(text[e - 1].isspace() for e in ends[:-1])


def test_an_edit_changes_only_pieces_near_it():
    text = prose(60_000, 3)
    ends = cuts(text, 4000, 200, 1200, 1024)
    pieces = {text[a:b] for a, b in zip([0, *ends], ends)}
    edited = text[:30_000] + "INSERTED WORDS " + text[30_000:]
    ends2 = cuts(edited, 4000, 200, 1200, 1024)
    changed = [1 for a, b in zip([0, *ends2], ends2) if edited[a:b] not in pieces]
    assert len(changed) <= 4


def test_landmarks_depend_on_the_window_only():
    a, b = prose(5000, 5), "zzz" + prose(5000, 5)
    assert set(landmarks(a, 64)) >= {x - 3 for x in landmarks(b, 64) if x > 60}


def test_operator(spark):
    long = prose(9000, 2)
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (4, long, 0), (4, long, 0), (5, "x" * 4000, 0), (6, "y" * 4001, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_no int")
    got = split_long(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {2, 3, 4, 5, 6} and len(by[5]) == 1 and len(by[6]) == 2 and by[2][0].piece == ""
    ps = sorted({(r.piece_no, r.start_char, r.end_char, r.piece) for r in by[4]})
    assert len(by[4]) == 2 * len(ps)
    for (_, _, e, _), (_, s, _, _) in zip(ps, ps[1:]):
        assert e - s == 200
    assert ps[0][3] + "".join(p[200:] for _, _, _, p in ps[1:]) == long and max(len(p) for *_, p in ps) <= 4000
    assert split_long(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_long(df, limit=100, overlap=90, least=95)
