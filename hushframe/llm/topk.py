"""Exact top-k by inner product with aggregation over sorted lists and no random access.

The rows are packed into blocks; within a block each dimension has its list of entries sorted by
value. For a query the lists of its positive weights are read from the top and those of its
negative weights from the bottom, all to the same depth, a step of it at a time. What has been read
gives every row a lower bound (unread parts count as the worst value of their list) and an upper bound
(unread parts count as the value at the frontier). A row whose upper bound is under the k-th
highest lower bound, or under the k-th score of the blocks before, cannot qualify and is dropped.
Reading goes on until so few rows are left that they can be resolved, by reading the rest of their
entries, or the lists end, where bounds and scores meet. The steps of all queries of a block are
matrix products of what they read, over the rows that are left.

Queries are a stated set. Blocks of queries meet blocks of rows on the query block's number, so
neither side is ever whole in one place; a task takes the blocks of rows for a block of queries one
after another and carries the k best on.

Defined cases: vectors that are null or hold null or non-finite components take no part; a null id
takes no part; of vectors of different length the shorter one counts as filled up with zeros; of
rows with one id each is a candidate, but never for its own id, and the least vector is the query;
ties go to the smaller vec_id; an empty table gives no rows. A very long vector makes a block of
few rows. Scores beyond 64 bits are an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Rows of a candidate block and of a query block, and components that a block holds.
ROWS, QUERIES, CELLS = 2048, 8192, 2048 * 64
#: Queries whose bounds are in memory at once.
AT_ONCE = 512
#: The lists are read in so many steps; a query is resolved when so many times k rows are left.
STEPS, FEW = 5, 2


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of each component, of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine).select(
        "vec_id", F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v")
    )


def _by_length(ids: pa.Array, vectors: pa.Array):
    """(length, ids, matrix) of the vectors of each length."""
    own, size = ids.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat, begin = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(size) - size
    for d in np.unique(size):
        k = np.flatnonzero(size == d)
        yield int(d), own[k], flat[begin[k][:, None] + np.arange(d)]


def _packed(ids: np.ndarray, m: np.ndarray) -> dict:
    """A block in the narrowest numbers that hold it."""
    most = max(int(m.max(initial=0)), -int(m.min(initial=0)) - 1)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most < 1 << (8 * int(k[2]) - 1))
    return {"ids": ids.astype("<i8").tobytes(), "d": m.shape[1], "kind": kind, "m": m.astype(kind).tobytes()}


def _unpacked(ids: bytes, d: int, kind: str, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    return own, np.frombuffer(m, kind).astype(np.int64).reshape(len(own), d)


def _blocks(rows: int, cells: int):
    """Blocks of candidates, each of one length."""

    def run(batches):
        yield from _cut(batches, rows, cells)

    return run


def _cut(batches, rows: int, cells: int):
    held: dict[int, list] = {}
    part, n = TaskContext.get().partitionId(), 0

    def out(d):
        nonlocal n
        ids, m = (np.concatenate(x) for x in zip(*held.pop(d)))
        n += 1
        fields = [("block", pa.int64()), ("ids", pa.binary()), ("d", pa.int32()), ("kind", pa.string()), ("m", pa.binary())]
        return pa.RecordBatch.from_pylist([{"block": part << 32 | n, **_packed(ids, m)}], pa.schema(fields))

    for b in batches:
        for d, ids, m in _by_length(b.column(0), b.column(1)):
            most = max(1, min(rows, cells // max(d, 1)))
            at = 0
            while at < len(ids):
                own = held.setdefault(d, [])
                room = most - sum(len(x) for x, _ in own)
                own.append((ids[at : at + room], m[at : at + room]))
                at += room
                if at <= len(ids):
                    yield out(d)
        while sum(len(i) * max(d, 1) for d, own in held.items() for i, _ in own) > 2 * cells:  # many lengths
            yield out(max(held, key=lambda d: sum(len(i) for i, _ in held[d]) * max(d, 1)))
    for d in list(held):
        yield out(d)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row."""
    if values.dtype == object:
        return np.sort(values, axis=1)[:, -k]
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k]


def nra(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int, steps: int = STEPS):
    """Rows of m that may be among the k best of each query (row of q), with their scores: lists of
    (row number, score) arrays; and the depth to which each query's lists were read. floor: scores
    that a row must reach."""
    n, d = m.shape
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    limit = most(q) * most(m) * max(d, 1)
    kind = np.float32 if limit < 1 << 24 else np.float64 if limit < 1 << 53 else object  # sums must be exact
    plus, minus, rows = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind), m.astype(kind)
    order = np.argsort(-m, axis=0, kind="stable")  # the sorted lists: row numbers, from the highest value
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    low, high, each = rows.min(axis=0), rows.max(axis=0), np.arange(d)
    found = [None] * len(q)
    read = np.full(len(q), n)
    on, left = np.arange(len(q)), np.arange(n)  # queries not resolved, rows not dropped by all of them
    known = np.zeros((len(q), n), kind)
    alive = ids[None, :] != qid[:, None]
    floor = floor.astype(kind)
    before = 0
    for step in range(1, steps + 1):
        depth = max(1, n * step // steps)
        r, own = rank[left], rows[left]
        top, bottom = (r >= before) & (r < depth), (r >= n - depth) & (r < n - before)
        known += plus[on] @ np.where(top, own, 0).T + minus[on] @ np.where(bottom, own, 0).T
        before = depth
        if depth == n:
            break
        unread, unread_up = r >= depth, r < n - depth
        lower = known + (plus[on] @ np.where(unread, low, 0).T + minus[on] @ np.where(unread_up, high, 0).T)
        if len(left) > k:
            floor[on] = np.maximum(floor[on], _kth(np.where(alive, lower, -math.inf), k))
        frontier, frontier_up = rows[order[depth - 1], each], rows[order[n - depth], each]
        upper = known + (plus[on] @ np.where(unread, frontier, 0).T + minus[on] @ np.where(unread_up, frontier_up, 0).T)
        alive &= upper >= floor[on][:, None]
        few = alive.sum(axis=1) <= FEW * k
        for i in np.flatnonzero(few):
            j = left[alive[i]]
            found[on[i]] = (j, (rows[j] * q[on[i]].astype(kind)).sum(axis=1))  # the rest of their entries
        read[on[few]] = depth
        on, known, alive = on[~few], known[~few], alive[~few]
        some = alive.any(axis=0)
        left, known, alive = left[some], known[:, some], alive[:, some]
        if not len(on):
            break
    for i, query in enumerate(on):
        fit = alive[i] & (known[i] >= floor[query])
        found[query] = (left[fit], known[i][fit])
    return found, read


class Best:
    """The k best so far of each query of a block."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int):
        self.qid, self.q, self.k = qid, q, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in qid]
        self.read, self.size = np.zeros(len(qid), np.int64), 0

    def meet(self, ids: np.ndarray, m: np.ndarray) -> None:
        d = min(self.q.shape[1], m.shape[1])  # what is missing is zero
        self.size += len(ids)
        for a in range(0, len(self.qid), AT_ONCE):
            floor = np.array([-b[-1][0] if len(b) == self.k else -math.inf for b in self.best[a : a + AT_ONCE]], object)
            found, read = nra(self.q[a : a + AT_ONCE, :d], self.qid[a : a + AT_ONCE], floor, m[:, :d], ids, self.k)
            self.read[a : a + AT_ONCE] += read
            for i, (j, score) in enumerate(found, a):
                if len(j) > self.k and score.dtype != object:
                    cut = np.partition(score, len(j) - self.k)[len(j) - self.k]
                    j, score = j[score >= cut], score[score >= cut]
                self.best[i] = sorted([*self.best[i], *((-int(s), int(v)) for s, v in zip(score, ids[j]))])[: self.k]

    def out(self) -> pa.RecordBatch:
        best = [[{"s": s, "v": v} for s, v in b] for b in self.best]
        kind = pa.list_(pa.struct([("s", pa.int64()), ("v", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(self.qid), pa.array(best, kind), pa.array(self.read), pa.array(np.full(len(self.qid), self.size))], ["query_id", "best", "read", "size"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest inner products of each query, and
    depth, the share of the lists that was read for it. Both tables: vec_id long, v array<long>,
    from ``quantized``; queries have distinct ids."""
    spark = candidates.sparkSession
    blocks = max(1, math.ceil(queries.count() / QUERIES))
    n_rows = max(1, math.ceil(candidates.count() / ROWS))
    packed = "ids binary, d int, kind string, m binary"
    cand = candidates.select("vec_id", "v").repartition(n_rows).mapInArrow(_blocks(ROWS, CELLS), f"block long, {packed}")
    grouped = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("qb"))

    def pack_queries(key, t):
        t = t.combine_chunks().sort_by("vec_id")
        rows = [{"q" + c: v for c, v in _packed(ids, m).items()} for _, ids, m in _by_length(t.column("vec_id").combine_chunks(), t.column("v").combine_chunks())]
        fields = [("qb", pa.int32()), ("qids", pa.binary()), ("qd", pa.int32()), ("qkind", pa.string()), ("qm", pa.binary())]
        return pa.Table.from_pylist([{"qb": key[0].as_py(), **r} for r in rows], pa.schema(fields))

    asked = grouped.groupBy("qb").applyInArrow(pack_queries, "qb int, qids binary, qd int, qkind string, qm binary")
    # tasks: blocks of queries times runs of candidate blocks
    runs = min(n_rows, max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / blocks)))
    copies = cand.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, "qb")
    pairs = copies.withColumn("run", F.pmod(F.xxhash64("block"), F.lit(runs))).repartition(4 * blocks * runs, "qb", "run").sortWithinPartitions("qb", "qd", "run")

    def score(batches):
        at, best = None, None
        for b in batches:
            for r in b.to_pylist():
                if at != (r["qb"], r["qd"]):
                    if best:
                        yield best.out()
                    at, best = (r["qb"], r["qd"]), Best(*_unpacked(r["qids"], r["qd"], r["qkind"], r["qm"]), k)
                best.meet(*_unpacked(r["ids"], r["d"], r["kind"], r["m"]))
        if best:
            yield best.out()

    part = pairs.select("qb", *(c.split()[0] for c in packed.split(", ")), "qids", "qd", "qkind", "qm").mapInArrow(score, "query_id long, best array<struct<s:long,v:long>>, read long, size long")
    merged = part.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"), (F.sum("read") / F.sum("size")).alias("depth"))
    return merged.select("query_id", "depth", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"), "depth"
    )


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantized(table(spark, sf_dir, "embeddings"))
    queries = rows.where("vec_id % 20 = 0").groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(rows, queries).drop("depth")


OP7_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
