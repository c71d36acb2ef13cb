"""The k most similar vectors of every vector, by NN-descent on Spark joins.

Equal vectors are one node. A first graph comes from cross-polytope hashing: a vector's largest coordinates after a
random rotation name its buckets, and each bucket's vectors are compared with each other. Then NN-descent: a node's
neighbours' neighbours are its next candidates. Comparing them pair by pair would move two vectors a pair, so nodes
meet in blocks instead: every node takes the least label in its neighbourhood, twice over, and visits the blocks of all
labels among its neighbours, so that two nodes with a common neighbour share a block; a block is one matrix product.

Vectors move as bytes: 8 bits an entry in buckets, 12 in blocks (an error of about 3e-5 of a cosine). A bucket or
block beyond ``CHUNK`` rows is sorted and split by further hash coordinates; what a chunk boundary separates, the next
rounds' common neighbours bring together. After the first round only links that are new count: the neighbours of a node that
gained or is a new neighbour meet again, others don't, so a round moves about as much as the one before changed. Rounds end
when few neighbours change, after two at least. Number of buckets follows the number of rows, so work grows as rows times bucket size.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.staging import staged

#: Rows compared at once at most, expected rows of a bucket, tables of buckets, buckets a vector visits in each, neighbours kept beyond those asked for.
CHUNK, BUCKET, TABLES, PROBES, SPARE = 8192, 2048, 2, 2, 1
#: Share of new neighbours below which rounds end, and rounds at most.
DELTA, MOST = 0.01, 12
#: Visits of a round that are broadcast to the vectors at most (24 bytes each); of more, the vectors move to them.
SHARED = 1_000_000
#: Bytes of vectors that a task sorts at most, if they are spread evenly.
TASK = 64 << 20
#: Rows of a product of matrices.
ROWS = 1024
SEED = 20_240_229


def usable(docs: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, node, vector) of the rows whose vector has ``dim`` entries, none NULL, and isn't all zero; equal vectors have one node."""
    v = F.col(f"`{vector}`")
    rows = docs.select(F.col(f"`{key}`").alias("key"), v.cast("array<float>").alias("vector")).where((F.size(v) == dim) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    return rows.select("key", F.xxhash64("vector").alias("node"), "vector")


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-30)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Binary column of values ``width`` long as a matrix of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    start = column.offset * width
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * width].reshape(-1, width)


def pack8(x: np.ndarray) -> np.ndarray:
    """Entries in 8 bits, by the scale that fills them."""
    return np.rint(x * (127.0 / np.maximum(np.abs(x).max(1, keepdims=True), 1e-30))).astype(np.int8).view(np.uint8)


def unpack8(b: np.ndarray, dim: int) -> np.ndarray:
    return b.view(np.int8).astype(np.float32)


def pack12(x: np.ndarray) -> np.ndarray:
    """Entries in 12 bits, two in three bytes, by the scale that fills them."""
    if x.shape[1] % 2:
        x = np.pad(x, ((0, 0), (0, 1)))
    q = (np.rint(x * (2047.0 / np.maximum(np.abs(x).max(1, keepdims=True), 1e-30))).astype(np.int16) + 2048).astype(np.uint16)
    a, b = q[:, ::2], q[:, 1::2]
    return np.stack([a & 255, a >> 8 | (b & 15) << 4, b >> 4], axis=2).astype(np.uint8).reshape(len(x), -1)


def unpack12(b: np.ndarray, dim: int) -> np.ndarray:
    t = b.reshape(len(b), -1, 3).astype(np.int16)
    out = np.empty((len(b), t.shape[1] * 2), np.float32)
    out[:, ::2] = (t[:, :, 0] | (t[:, :, 1] & 15) << 8) - 2048
    out[:, 1::2] = (t[:, :, 1] >> 4 | t[:, :, 2] << 4) - 2048
    return out[:, :dim]


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _rotation(dim: int, number: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(SEED + number).standard_normal((dim, dim)))
    return q.astype(np.float32)


def _bucket_plan(rows: int, dim: int) -> tuple[int, int]:
    """Coordinates that the first and the second part of a code choose among; 1 for no second part."""
    want = max(2, rows // BUCKET)
    if want <= 2 * dim:
        return max(1, want // 2), 1
    return dim // 2, min(dim // 2, max(2, round(want / dim / 2)))


def codes(x: np.ndarray, rotation: np.ndarray, first: int, second: int, probes: int = PROBES) -> np.ndarray:
    """(rows, probes) codes: sign and number of the largest coordinates, with those of the second part appended."""
    h = x @ rotation
    a = h[:, :first]
    p = min(probes, first)
    top = np.argpartition(-np.abs(a), p - 1, axis=1)[:, :p] if first > p else np.tile(np.arange(first), (len(x), 1))
    code = top * 2 + (np.take_along_axis(a, top, 1) > 0)
    if second > 1:
        b = h[:, first : first + second]
        t = np.abs(b).argmax(1)
        code = code * (2 * second) + (t * 2 + (b[np.arange(len(x)), t] > 0))[:, None]
    return code.astype(np.int64)


def further(x: np.ndarray, number: int) -> np.ndarray:
    """A further code of each row by which a bucket or block beyond ``CHUNK`` is sorted and split: its three largest coordinates after another rotation."""
    h = x @ _rotation(x.shape[1], 1000 + number)
    top = np.argsort(-np.abs(h), axis=1)[:, :3]
    sign = np.take_along_axis(h, top, 1) > 0
    code = np.zeros(len(x), np.int64)
    for j in range(top.shape[1]):
        code = code * (2 * x.shape[1]) + top[:, j] * 2 + sign[:, j]
    return code


def _bucketed(nodes: DataFrame, rows: int, dim: int) -> DataFrame:
    """(bucket, node, v): each node of a task in its buckets, vectors in 8 bits with the scale that fills them."""
    first, second = _bucket_plan(rows, dim)

    def run(batches):
        rotations = [_rotation(dim, t) for t in range(TABLES)]
        seen: set[int] = set()
        for b in batches:
            node = b.column(0).to_numpy()
            new = []
            for i, n in enumerate(node.tolist()):
                if n not in seen:
                    seen.add(n)
                    new.append(i)
            if not new:
                continue
            x = _matrix(b.column(1).take(pa.array(new)), dim)
            node = node[new]
            small = pack8(x)
            parts = []
            for t, r in enumerate(rotations):
                c = codes(x, r, first, second) * TABLES + t
                parts.append((c.ravel(), np.repeat(np.arange(len(x)), c.shape[1]), np.repeat(further(x, t), c.shape[1])))
            code, at, more = (np.concatenate([p[i] for p in parts]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(node[at]), _binary(small[at]), pa.array(more)], names=["block", "node", "v", "more"])

    return nodes.select("node", "vector").mapInArrow(run, "block bigint, node bigint, v binary, more bigint")


def _compare(blocks: DataFrame, unpack, width: int, dim: int, keep: int) -> DataFrame:
    """(node, near ARRAY<STRUCT<s FLOAT, n BIGINT>>): each node's best ``keep`` within its block (block, node, v), rows sorted by block.

    A block that has more than ``CHUNK`` rows is compared chunk by chunk as it streams by, so a task never holds more, and
    ``ROWS`` rows of a chunk at a time.
    """
    schema = pa.list_(pa.struct([("s", pa.float32()), ("n", pa.int64())]))

    def best(node: np.ndarray, x: np.ndarray):
        _, once = np.unique(node, return_index=True)
        node, x = node[once], unpack(x[once], dim)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        n, k = len(node), min(keep, len(node) - 1)
        if k < 1:
            return None
        near, which = np.empty((n, k), np.float32), np.empty((n, k), np.int64)
        for a in range(0, n, ROWS):
            s = x[a : a + ROWS] @ x.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2.0
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-s, axis=1)[:, :k]
            near[a : a + ROWS], which[a : a + ROWS] = np.take_along_axis(s, top, 1), node[top]
        return node, near, which

    def run(batches):
        key, held = None, []
        out: list = []

        def flush():
            if held:
                got = best(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held.clear()
                if got:
                    out.append(got)

        def ready():
            nodes = pa.array(np.concatenate([o[0] for o in out]))
            lens = np.concatenate([np.full(len(o[0]), o[1].shape[1]) for o in out])
            s, n = np.concatenate([o[1].ravel() for o in out]), np.concatenate([o[2].ravel() for o in out])
            offsets = np.zeros(len(lens) + 1, np.int32)
            np.cumsum(lens, out=offsets[1:])
            items = pa.StructArray.from_arrays([pa.array(s, pa.float32()), pa.array(n, pa.int64())], names=["s", "n"])
            out.clear()
            return pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(offsets), items).cast(schema)], names=["node", "near"])

        for b in batches:
            block, node, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _bytes(b.column(2), width)
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, z in zip(edges, edges[1:], strict=False):
                if z == a:
                    continue
                if block[a] != key:
                    flush()
                    key = block[a]
                while a < z:
                    room = CHUNK - sum(len(h[0]) for h in held)
                    if room <= 0:
                        flush()
                        room = CHUNK
                    e = min(z, a + room)
                    held.append((node[a:e].copy(), x[a:e].copy()))
                    a = e
            if sum(len(o[0]) for o in out) > 4096:
                yield ready()
        flush()
        if out:
            yield ready()

    return blocks.mapInArrow(run, "node bigint, near array<struct<s:float,n:bigint>>")


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """One list a node, best first, each neighbour once."""
    lists = found.groupBy("node").agg(F.flatten(F.collect_list("near")).alias("all"))
    by = F.array_sort("all", lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0))
    ids = F.slice(F.array_distinct(F.transform(by, lambda x: x["n"])), 1, keep)
    best = lists.select("node", by.alias("all"), ids.alias("near"))
    scored = F.transform("near", lambda n: F.struct(F.element_at(F.filter("all", lambda x: x["n"] == n), 1)["s"].alias("s"), n.alias("n")))
    return best.select("node", "near", scored.alias("scored"))


def _parts(blocks: DataFrame) -> DataFrame:
    """``blocks`` (block, node) with the number of parts, NULL for a block of up to ``CHUNK`` rows."""
    size = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CHUNK)
    return blocks.join(size.select("block", F.ceil(F.col("m") / CHUNK).alias("parts")), "block", "left")


def _spread(blocks: DataFrame, size: int) -> DataFrame:
    """``blocks`` (block, ..., more) by block, sorted, over as many tasks as ``size`` bytes need."""
    tasks = size // TASK + 1
    default = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = blocks.repartition(tasks, "block") if tasks > default else blocks.repartition("block")
    return moved.sortWithinPartitions("block", "more")


def graph(nodes: DataFrame, rows: int, dim: int, keep: int, rounds: int = MOST) -> DataFrame:
    """(node, near ARRAY<BIGINT>): approximate best neighbours of each node of ``nodes`` (node, vector), best first.

    Rounds follow each other, two at least, until the share of neighbours that are new falls below ``DELTA``, at most ``rounds``.

    Labels and visits go along the best ``keep`` less ``SPARE`` neighbours; those beyond are often chance finds far away.
    """
    first = _spread(_bucketed(nodes, rows, dim), rows * TABLES * PROBES * dim)
    made = _merged(_compare(first, unpack8, dim, dim, keep), keep)
    near = staged(made.withColumn("fresh", F.slice("near", 1, keep - SPARE)), "neighbours-0")

    def packed(batches, number=0):
        seen: set[int] = set()
        for b in batches:
            new = [i for i, n in enumerate(b.column(0).to_pylist()) if not (n in seen or seen.add(n))]
            if new:
                x = _matrix(b.column(1).take(pa.array(new)), dim)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(new)), _binary(pack12(x)), pa.array(further(x, number))], names=["node", "v", "more"])

    for r in range(1, rounds + 1):
        pairs = near.select("node", F.explode(F.concat(F.array("node"), F.slice("near", 1, keep - SPARE))).alias("other"))
        if r > 1:  # only the neighbours of nodes that a new link begins or ends at meet again
            centres = near.where(F.size("fresh") > 0).select(F.explode(F.concat(F.array("node"), "fresh")).alias("other")).distinct()
            pairs = staged(pairs.join(centres, "other", "left_semi").select("node", "other"), f"links-{r}")
        label = F.xxhash64("node", F.lit(r))
        one = pairs.groupBy(F.col("other").alias("node")).agg(F.min(label).alias("l"))  # the least label among those that know the node
        one = pairs.join(one.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("l").alias("l"))
        one = staged(one, f"labels-{r}")
        visits = pairs.join(one.select(F.col("node").alias("other"), F.col("l").alias("block")), "other").select("block", "node").distinct()
        visits = staged(_parts(staged(visits, f"visits-{r}")), f"parts-{r}")
        visits = F.broadcast(visits) if visits.count() <= SHARED else visits
        vectors = nodes.select("node", "vector").mapInArrow(partial(packed, number=r), "node bigint, v binary, more bigint")
        part = F.when(F.col("parts").isNull(), F.col("block")).otherwise(F.xxhash64("block", F.pmod(F.xxhash64("more"), F.col("parts"))))
        blocks = _spread(visits.join(vectors, "node").select(part.alias("block"), "node", "v", "more"), rows * dim * 3)
        # what is known stays in the running; the first lists, of 8 bits, come after all of 12
        known = near.select("node", F.transform("scored", lambda x: F.struct((x["s"] - F.lit(4.0 if r == 1 else 0.0)).cast("float").alias("s"), x["n"].alias("n"))).alias("near"))
        made = _merged(_compare(blocks, unpack12, (dim + 1) // 2 * 3, dim, keep).unionByName(known), keep)
        old = near.select("node", F.col("near").alias("old"))
        made = made.join(old, "node", "left").withColumn("fresh", F.array_except(F.slice("near", 1, keep - SPARE), F.coalesce("old", F.array().cast("array<bigint>")))).drop("old")
        near = staged(made, f"neighbours-{r}")
        change = near.agg(F.sum(F.size("fresh")).alias("new"), F.sum(F.size(F.slice("near", 1, keep - SPARE))).alias("all")).first()
        if r > 1 and (change["new"] or 0) <= DELTA * (change["all"] or 0):  # the first round's lists replace ones of 8 bits, so its change says nothing yet
            break
    return near.select("node", "near")


def most_similar(docs: DataFrame, k: int = 5, dim: int = 384, key: str = "doc_id", vector: str = "embedding", rounds: int = MOST) -> DataFrame:
    """(a, b, place): the ``k`` most similar other rows of each row, by cosine, place 1 the most similar; ties go to the smaller key.

    Rows without a usable vector (NULL, all zero, a NULL or NaN entry, another length) have no neighbours and are
    none. Rows of equal vectors are each other's nearest. An empty table gives no row.
    """
    rows = usable(docs, key, vector, dim)
    near = graph(rows, docs.count(), dim, k + SPARE, rounds)
    members = staged(rows.select("key", "node"), "members")
    w = Window.partitionBy("node").orderBy("key")
    heads = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("heads"))
    others = near.select("node", F.posexplode(F.slice("near", 1, k)).alias("pos", "other")).join(heads.select(F.col("node").alias("other"), "heads"), "other")
    others = others.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "heads"))).alias("far"))
    info = heads.join(others, "node", "left")
    joined = members.join(info, "node")
    own = F.filter("heads", lambda x: x != F.col("key"))
    far = F.flatten(F.transform(F.coalesce("far", F.array()), lambda x: x["heads"]))
    return joined.select(F.col("key").alias("a"), F.posexplode(F.slice(F.concat(own, far), 1, k)).alias("pos", "b")).select("a", "b", (F.col("pos") + 1).alias("place"))


#: Nodes of a bucket at which a search may start, nodes a query keeps beyond those asked for, rounds at most.
ENTRIES, BEAM, ROUNDS = 32, 12, 50


def _similar(pairs: DataFrame, asked: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(query, node, s) of ``pairs`` (query, node), with ``asked`` (query, q) and ``vectors`` (node, v) in 12 bits."""
    width = (dim + 1) // 2 * 3

    def run(batches):
        for b in batches:
            q, v = unpack12(_bytes(b.column(2), width), dim), unpack12(_bytes(b.column(3), width), dim)
            s = np.einsum("ij,ij->i", q, v) / np.maximum(np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1), 1e-30)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.astype(np.float32))], names=["query", "node", "s"])

    joined = pairs.join(vectors, "node").join(asked, "query").select("query", "node", "q", "v")
    return joined.mapInArrow(run, f"query {dict(pairs.dtypes)['query']}, node bigint, s float")


def search(docs: DataFrame, queries: DataFrame, k: int = 5, dim: int = 384, key: str = "doc_id", vector: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """(query, b, place): the ``k`` most similar rows of ``docs`` for each row of ``queries``, itself left out, by greedy search of the neighbour graph.

    A search starts at a few nodes of the query's buckets, and at the node equal to the query if there is one. Each round looks at the neighbours of the nodes it keeps that
    it hasn't looked at, and keeps the best ``k + BEAM``; it ends when every query has looked at all it keeps. A query whose buckets
    are empty starts at ``ENTRIES`` fixed nodes. A full bucket's entries differ by query: each takes those next to its own further hash.
    Equal vectors are one node and come in order of their keys. Approximate; queries and rows are told apart by ``key``.
    """
    rows = usable(docs, key, vector, dim)
    n = docs.count()
    near = graph(rows, n, dim, k + SPARE)
    first, second = _bucket_plan(n * BUCKET // ENTRIES, dim)  # small buckets, about as many rows as may be entries

    def hashed(batches):
        rotations = [_rotation(dim, t) for t in range(TABLES)]
        for b in batches:
            x = _matrix(b.column(1), dim)
            found = [codes(x, r, first, second) * TABLES + t for t, r in enumerate(rotations)]
            c = np.concatenate(found, axis=1)
            offsets = np.arange(0, c.size + 1, c.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.ravel())), _binary(pack12(x))], names=["id", "blocks", "v"])

    asked = usable(queries, key, vector, dim)
    kind = dict(asked.dtypes)["key"]
    starts = staged(asked.select("key", "vector").mapInArrow(hashed, f"id {kind}, blocks array<bigint>, v binary"), "search-starts")
    asked_v = starts.groupBy(F.col("id").alias("query")).agg(F.first("v").alias("q"))
    vectors = staged(rows.select("node", "vector").mapInArrow(hashed, "id bigint, blocks array<bigint>, v binary"), "search-nodes")
    size = vectors.select("id", F.explode("blocks").alias("block")).distinct()
    crowd = size.groupBy("block").agg(F.count(F.lit(1)).alias("m")).select("block", F.ceil(F.col("m") / ENTRIES).alias("parts"))
    size = size.join(crowd, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("block", "part", F.col("id").alias("node"))
    asking = starts.select(F.col("id").alias("query"), F.explode("blocks").alias("block")).join(crowd, "block").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts"))).select("block", "part", "query")
    fixed = [r[0] for r in vectors.select("id").distinct().orderBy(F.xxhash64("id")).limit(ENTRIES).collect()]
    vectors = vectors.groupBy(F.col("id").alias("node")).agg(F.first("v").alias("v"))
    best = Window.partitionBy("query").orderBy(F.desc("s"), "node")
    keep = lambda found: found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + BEAM).drop("r")
    pairs = asking.join(size, ["block", "part"]).select("query", "node")
    pairs = pairs.unionByName(asked.select(F.col("key").alias("query"), "node").join(rows.select("node").distinct(), "node", "left_semi").select("query", "node"))
    lost = asked.select(F.col("key").alias("query")).join(pairs.select("query").distinct(), "query", "left_anti")
    pairs = staged(pairs.unionByName(lost.select("query", F.explode(F.array(*[F.lit(x).cast("bigint") for x in fixed]) if fixed else F.array().cast("array<bigint>")).alias("node"))).distinct(), "search-entries")
    held = staged(keep(_similar(pairs, asked_v, vectors, dim)), "search-0")
    looked = held.limit(0).select("query", "node")
    for r in range(1, rounds + 1):
        front = staged(held.select("query", "node").join(looked, ["query", "node"], "left_anti"), f"search-front-{r}")
        if front.isEmpty():
            break
        steps = front.join(near, "node").select("query", F.explode("near").alias("node")).distinct().join(held, ["query", "node"], "left_anti")
        looked = looked.unionByName(front)
        held = staged(keep(held.unionByName(_similar(steps, asked_v, vectors, dim))), f"search-{r}")
    heads = Window.partitionBy("node").orderBy("key")
    members = rows.select("key", "node").withColumn("h", F.row_number().over(heads)).where(F.col("h") <= k + 1)
    found = held.join(members, "node").where(F.col("key") != F.col("query"))
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "key")))
    return ranked.where(F.col("place") <= k).select("query", F.col("key").alias("b"), "place")
