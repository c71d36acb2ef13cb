"""Filling containers of fixed capacity with documents sized in tokens.

Bounded-space online best fit: while documents stream by, at most ``open_bins`` containers are open. Their free
spaces are the set bits of one integer, so the best fit (the least free space that suffices) is one shift and one
lowest-bit operation. When a new container must be opened and all are in use, the fullest closes. A task packs the
rows of its own input split, so nothing is shuffled and the state of a task doesn't grow with its rows: it holds
the members of open containers only. At a split's end, what lies in open containers is repacked, largest first.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.tokens import DEFAULT_VOCAB, encoder


#: Members at which a container closes though it has space, so that empty texts don't pile up in one.
MEMBERS = 65_536


class OpenBins:
    """At most ``limit`` open containers of ``capacity``; ``add`` returns containers that closed."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.count = capacity, limit, 0
        self.spaces = 0  # bit f is set if an open container has f units free
        self.at: dict[int, list[list]] = defaultdict(list)

    def _put(self, free: int, members: list) -> None:
        self.at[free].append(members)
        self.spaces |= 1 << free
        self.count += 1

    def _take(self, free: int) -> list:
        members = self.at[free].pop()
        if not self.at[free]:
            del self.at[free]
            self.spaces &= ~(1 << free)
        self.count -= 1
        return members

    def add(self, size: int, item) -> list[list]:
        closed = []
        if fits := self.spaces >> size:
            free = size + (fits & -fits).bit_length() - 1
            members = self._take(free)
        else:
            if self.count >= self.limit:
                closed.append(self._take((self.spaces & -self.spaces).bit_length() - 1))
            free, members = self.capacity, []
        members.append(item)
        if free == size or len(members) >= MEMBERS:
            closed.append(members)
        else:
            self._put(free - size, members)
        return closed

    def drain(self) -> list[list]:
        left = [m for free in sorted(self.at) for m in self.at[free]]
        self.at.clear()
        self.spaces = self.count = 0
        return left


def pack(docs: DataFrame, capacity: int = 4096, open_bins: int = 128, key: str = "doc_id", text: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """Rows (``key``, piece INT, first_token INT, n_tokens INT, container_id BIGINT).

    A document within the capacity is one piece 0. One that alone exceeds it is cut into full pieces and a rest. NULL
    and empty texts have size 0 and go into a container like any other, taking no space. Repeated rows are packed as
    often as they occur. An empty table gives no row. ``container_id`` is unique over all tasks: split number times
    2**33 plus a count, so a task that is run again gives the same ids.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, bins = encoder(vocab), OpenBins(capacity, open_bins)
        number = TaskContext.get().partitionId() << 33

        def rows(groups):
            nonlocal number
            out = []
            for members in groups:
                out.extend((*m, number) for m in members)
                number += 1
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [schema_key, pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[key, "piece", "first_token", "n_tokens", "container_id"])

        schema_key = None
        for batch in batches:
            schema_key = batch.schema.field(0).type
            closed = []
            for k, n in zip(batch.column(0).to_pylist(), enc.count_batch(batch.column(1).to_pylist()), strict=True):
                first = piece = 0
                while n - first > capacity:
                    closed += bins.add(capacity, (k, piece, first, capacity))
                    first, piece = first + capacity, piece + 1
                closed += bins.add(n - first, (k, piece, first, n - first))
            yield rows(closed)
        if schema_key is not None:
            left = sorted((m for members in bins.drain() for m in members), key=lambda m: (-m[3], str(m[0]), m[1]))
            last, closed = OpenBins(capacity, len(left) + 1), []
            for m in left:
                closed += last.add(m[3], m)
            yield rows(closed + last.drain())

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, first_token int, n_tokens int, container_id bigint")
