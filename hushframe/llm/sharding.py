"""Sharding by vector bin packing over bytes, tokens and rows.

Equal texts form a group. Every group is placed where the dot product of its shares of bytes, tokens
and rows with the residual capacity is highest, on two levels, so that no place sees all groups:

* A group whose share is above 1/(FINE * shards) is an item of the second level by itself; there are
  at most 3 * FINE * shards of them, whatever the input. All others are dealt by hash over tasks,
  and each task packs its groups, a batch at a time and the largest first, into bins whose capacity
  grows with what has come.
* Bins and large groups are the items that the driver packs into shards: some BINS bins, or
  ``shards`` a task if that is more. Then items move from a fuller to an emptier shard as long as
  that evens out bytes, tokens and rows together, bytes before the others.

A group larger than a whole shard cannot stay together in equal shards: it is an item for each of
SALTS salts of doc_id.

Defined cases: null text is empty text; a null doc_id is salted like any value; repeated rows
are rows; an empty table gives no rows; other columns are ignored; a very long text is a group like
any other, and if it is larger than a shard then its shard is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import keep, partitions, table

FINE, SALTS, BINS, SLICES = 64, 64, 4096, 1024
DIMS = ("bytes", "tokens", "rows")
#: What evenness of each dimension counts when items move.
WEIGHT = np.array([100.0, 1.0, 1.0])


def pack(share: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The bin of each item, the largest first. share: one row per item, one column per dimension;
    residual: the bins' free capacity, which is updated."""
    place = np.zeros(len(share), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        place[i] = int(np.argmax(residual @ share[i]))
        residual[place[i]] -= share[i]
    return place


def refine(share: np.ndarray, place: np.ndarray, shards: int) -> np.ndarray:
    """Move items from the fullest to the emptiest shard of a dimension, as long as the weighed
    squares of what shards have too much or too little shrink."""
    place = place.copy()
    off = np.stack([np.bincount(place, share[:, d], shards) for d in range(share.shape[1])], axis=1) - share.sum(axis=0) / shards
    for _ in range(64 * shards):
        moved = False
        for d in range(share.shape[1]):
            high, low = int(np.argmax(off[:, d])), int(np.argmin(off[:, d]))
            own = np.flatnonzero((place == high) & (share[:, d] > 0))
            if not len(own) or high == low:
                continue
            after = ((off[high] - share[own]) ** 2 + (off[low] + share[own]) ** 2) @ WEIGHT
            best = int(np.argmin(after))
            if after[best] < (1 - 1e-9) * float((off[high] ** 2 + off[low] ** 2) @ WEIGHT):
                place[own[best]] = low
                off[high] -= share[own[best]]
                off[low] += share[own[best]]
                moved = True
        if not moved:
            break
    return place


def _bins(total: np.ndarray, bins: int):
    """Groups with the bin of their task."""

    def run(batches):
        part, residual = TaskContext.get().partitionId(), np.zeros((bins, len(DIMS)))
        for b in batches:
            share = np.stack([b.column(b.schema.get_field_index(d)).to_numpy().astype(float) for d in DIMS], axis=1) / total
            residual += share.sum(axis=0) / bins
            place = pack(share, residual) + part * bins
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], [*b.schema.names, "bin"])

    return run


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("g"),
        ).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")),
        "shard-rows",
    )
    key = ["g", "text_crc32", "size"]
    sums = [F.sum(c).alias(c) for c in DIMS]
    salted = rows.groupBy(*key, "salt").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = keep(salted.groupBy(*key).agg(*sums), "shard-groups")
    total = np.array([x or 0 for x in groups.agg(*sums).first()], float)
    total = np.maximum(total, 1)
    over = lambda n: F.greatest(*[F.col(c) / F.lit(t) for c, t in zip(DIMS, total.tolist())]) > F.lit(1.0 / n)
    tasks = partitions(spark)
    bins = max(shards, -(-BINS // tasks))
    dealt = groups.where(~over(shards * FINE)).repartition(tasks, "g")
    light = keep(dealt.mapInArrow(_bins(total, bins), "g long, text_crc32 long, size long, bytes long, tokens long, rows long, bin long"), "shard-bins")
    of_bins = light.groupBy("bin").agg(*sums).collect()  # bins of each task
    heavy = groups.where(over(shards * FINE) & ~over(shards)).select(*key, *DIMS).collect()  # 3 * FINE * shards rows at most
    giant = groups.where(over(shards)).select(*key)  # 3 * shards rows at most
    parts = salted.join(F.broadcast(giant), key).select(*key, "salt", *DIMS).collect()
    items = [*of_bins, *heavy, *parts]
    share = np.array([[r[c] for c in DIMS] for r in items], float).reshape(len(items), len(DIMS)) / total
    place = refine(share, pack(share, np.full((shards, len(DIMS)), 1.0 / shards)), shards).tolist()
    of_bin = F.broadcast(spark.createDataFrame([(r["bin"], p) for r, p in zip(of_bins, place)], "bin long, shard int"))
    own = [(*[r[k] for k in key], s, p) for r, p in zip(heavy, place[len(of_bins) :]) for s in range(SALTS)]
    own += [(*[r[k] for k in key], r["salt"], p) for r, p in zip(parts, place[len(of_bins) + len(heavy) :])]
    lookup = F.broadcast(spark.createDataFrame(own, "g long, text_crc32 long, size long, salt int, shard int"))
    columns = ["doc_id", "size", "tokens", "text_crc32", "g", "shard"]
    large = rows.join(lookup, [*key, "salt"]).select(*columns)
    small = rows.join(light.join(of_bin, "bin").select(*key, "shard"), key).select(*columns)  # no group of more than 1/(FINE * shards)
    placed = keep(large.unionByName(small).withColumn("slice", F.pmod(F.xxhash64("doc_id", "g"), F.lit(SLICES)).cast("int")), "shard-placed")
    upto = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    begin = counts.select("shard", "slice", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("begin"))  # shards * SLICES rows
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "g")
    return (
        placed.join(F.broadcast(begin), ["shard", "slice"])
        .withColumn("slot", F.col("begin") + F.row_number().over(within) - 1)
        .select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")
    )


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
