"""Encoding of a corpus with a public byte-level BPE, and its token counts.

Two tiers. Whole pre-tokens that are vocabulary entries are resolved by a minimal perfect hash over the vocabulary
(levels of collision-free slots, ranked by population count, each hit verified against the stored bytes). Only what
the hash misses runs the merges: a heap of candidate merges over a doubly linked list of byte symbols.

The tables are a few MB, bounded by the vocabulary file, and are built once a Python worker from the file that
``vocab`` names, which every executor must be able to read. Documents stream through Arrow batches: no shuffle.
"""

from __future__ import annotations

import heapq
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies lie; a parameter of every operator here.
DEFAULT_VOCAB = os.environ.get("MILLRACE_VOCAB", "/opt/tokenizers/byte_bpe_50k.json")
# Fixed value: the public pattern that splits text before the merges of a byte-level BPE.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Resolved pre-tokens that a worker keeps; beyond, it starts anew. Only speed depends on it.
MEMO = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 byte values."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PerfectHash:
    """Minimal perfect hash of byte strings: key -> position in 0..n-1, or -1 for a string that is no key.

    Level by level, keys that fall alone into a slot of that level's bit array stay there, the others go on to the
    next. A key's position is the count of set bits before its slot. A hit is verified against the key's own bytes.
    """

    def __init__(self, keys: list[bytes], gamma: float = 2.0):
        import xxhash

        self._hash = xxhash.xxh3_64_intdigest
        codes = np.fromiter((self._hash(k) for k in keys), np.uint64, len(keys))
        if len(set(codes.tolist())) != len(keys):
            raise ValueError("two keys have one 64-bit code")
        left, self.levels, base = np.arange(len(keys)), [], 0
        order = np.empty(len(keys), np.int64)
        while len(left):
            size = max(64, int(gamma * len(left)))
            slot = self._slot(codes[left], len(self.levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((size, alone, rank))
            stays = alone[slot]
            order[rank[slot[stays]]] = left[stays]
            base += int(alone.sum())
            left = left[~stays]
        self.keys = [keys[i] for i in order]
        self.order = order

    @staticmethod
    def _slot(codes: np.ndarray, level: int, size: int) -> np.ndarray:
        x = codes + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def find(self, words: list[bytes]) -> np.ndarray:
        codes = np.fromiter((self._hash(w) for w in words), np.uint64, len(words))
        at, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, (size, alone, rank) in enumerate(self.levels):
            if not len(open_):
                break
            slot = self._slot(codes[open_], level, size)
            hit = alone[slot]
            at[open_[hit]] = rank[slot[hit]]
            open_ = open_[~hit]
        for i in np.flatnonzero(at >= 0).tolist():
            if self.keys[at[i]] != words[i]:
                at[i] = -1
        return at


class BytePairEncoder:
    """Encoder of one vocabulary file (``tokenizers`` JSON, or ``tiktoken`` ranks by file ending)."""

    def __init__(self, path: str):
        import regex

        self.split = regex.compile(PRETOKEN).findall
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            back = byte_alphabet()
            raw = {t: bytes(back[c] for c in t) for t in model["vocab"] if all(c in back for c in t)}
            self.ids = {b: model["vocab"][t] for t, b in raw.items()}
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            self.merges = {(model["vocab"][a], model["vocab"][b]): (rank, model["vocab"][a + b]) for rank, (a, b) in enumerate(pairs)}
        else:
            import base64

            with open(path, "rb") as f:
                self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.merges = None  # any two neighbours whose bytes together are an entry may merge, at that entry's rank
            self.bytes_of = {i: b for b, i in self.ids.items()}
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        keys = sorted(self.ids)
        self.perfect = PerfectHash(keys)
        self.slot_ids = [self.ids[k] for k in self.perfect.keys]
        self.memo: dict[str, tuple[int, ...]] = {}

    def _merge(self, a: int, b: int) -> tuple[int, int] | None:
        if self.merges is not None:
            return self.merges.get((a, b))
        i = self.ids.get(self.bytes_of[a] + self.bytes_of[b])
        return None if i is None else (i, i)

    def merge_bytes(self, word: bytes) -> tuple[int, ...]:
        """The merges, lowest rank first and leftmost among equals: a heap over a doubly linked list of symbols."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self._merge(ids[i], ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self._merge(made, ids[k]):
                    heapq.heappush(heap, (m[0], i, made, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self._merge(ids[h], made)):
                heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
        return tuple(i for i in ids if i >= 0)

    def learn(self, words: set[str]) -> None:
        """Resolves pre-tokens that the memo lacks: perfect hash first, merges for its misses."""
        new = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, b, at in zip(new, raw, self.perfect.find(raw).tolist(), strict=True):
            self.memo[w] = (self.slot_ids[at],) if at >= 0 else self.merge_bytes(b)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        split = [self.split(t) if t else [] for t in texts]
        if new := set().union(*split).difference(self.memo):
            self.learn(new)
        get = self.memo.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, words)), np.int32) for words in split]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        split = [self.split(t) if t else [] for t in texts]
        if new := set().union(*split).difference(self.memo):
            self.learn(new)
        get = self.memo.__getitem__
        return [sum(map(len, map(get, words))) for words in split]


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The worker's encoder of ``path``, built at first use."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """Rows (``key``, ids ARRAY<INT>), one for each row of ``docs``, repeated rows included.

    No special tokens are added, and their strings in a text are ordinary text. NULL and empty texts give an empty
    list, never NULL. Columns other than the two are not read.
    """

    def run(batches):
        enc = encoder(vocab)
        for batch in batches:
            ids = enc.encode_batch(batch.column(1).to_pylist())
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
