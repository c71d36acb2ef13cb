import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing, tokens
from millrace.llm.tokens import DEFAULT_VOCAB, PerfectHash, encoder

TEXTS = ["", " ", "Hello world's end, 1234 tests!", "naïve café\n\n\tx  y   ", "日本語のテスト。", "<|endoftext|> is text", "👩‍⚕️ ok", "a" * 3000, "ภาษาไทย ทดสอบ", "don't DON'T we'll", "\r\n\r\n", "x y​z", "हिन्दी पाठ", "\x00\x01"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_VOCAB)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_librarys(text, library):
    assert encoder(DEFAULT_VOCAB).encode_batch([text])[0].tolist() == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_librarys(text):
    from tokenizers import Tokenizer

    t = test_any_text_equals_the_librarys.__dict__.setdefault("t", Tokenizer.from_file(DEFAULT_VOCAB))
    t.encode_special_tokens = True
    assert encoder(DEFAULT_VOCAB).encode_batch([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_rank_files_work_too():
    import base64

    import tiktoken

    path = DEFAULT_VOCAB.replace(".json", ".tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=tokens.PRETOKEN, mergeable_ranks=ranks, special_tokens={})
    for text in TEXTS:
        assert encoder(path).encode_batch([text])[0].tolist() == lib.encode_ordinary(text)


def test_every_whole_entry_found_by_the_hash_is_what_the_merges_give():
    e = encoder(DEFAULT_VOCAB)
    wrong = [k for k, i in list(e.ids.items())[::37] if e.merge_bytes(k) != (i,)]
    assert not wrong


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = PerfectHash(keys)
    assert sorted(h.find(keys).tolist()) == list(range(5000))
    assert set(h.find([b"zz", b"k5001", b""]).tolist()) == {-1}


def test_null_empty_repeated_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "hi", 7), (3, "hi", 8)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode(df).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3]
    assert tokens.encode(df.limit(0)).count() == 0


def test_packing_fills_cuts_and_loses_nothing(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 60)) for i in range(400)] + [(900, "word " * 250), (901, None), (902, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), capacity=100, open_bins=8).collect()
    count = dict(zip([k for k, _ in rows], encoder(DEFAULT_VOCAB).count_batch([t for _, t in rows]), strict=True))
    fill, pieces = {}, {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
    assert max(fill.values()) <= 100
    for k, ps in pieces.items():
        ps.sort()
        assert sum(n for _, _, n in ps) == count[k]
        assert [f for _, f, _ in ps] == [sum(n for _, _, n in ps[:i]) for i in range(len(ps))]
        assert len(ps) == 1 or count[k] > 100
    assert set(pieces) == set(count)
    assert sum(fill.values()) / (100 * len(fill)) > 0.95


def test_bins_take_the_best_fit_and_close_the_fullest():
    b = packing.OpenBins(10, 2)
    assert b.add(6, "a") == [] and b.add(7, "b") == []
    assert b.add(3, "c") == [["b", "c"]]  # exactly filled
    assert b.add(8, "d") == [] and b.add(9, "e") == [["d"]]
    assert b.drain() == [["e"], ["a"]]


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
