"""N-gram Jaccard join by MinHash banding.

A document's set is the hashes of its runs of ``n`` consecutive words; words are runs of letters
and digits (everything outside ASCII among them), with A-Z lower-cased, so that case and
punctuation do not part copies. A shorter text is one run. Documents with equal sets form a class, whose size is kept; the rest
is about one document of each class.

* Bands: ``plan_bands`` takes the most rows a band and then the fewest bands that keep the chance
  to miss a pair at the threshold under ``1 - recall``. Band hashes are shuffled; documents of
  one band value, a bucket, are linked to their smallest id: links grow with the documents.
* Documents in buckets are put in the order of the connected parts of these links and dealt into
  blocks of about BLOCK_WEIGHT, so that a bucket's documents lie in few blocks. A document is sent
  to a pair of blocks if it is in one of them and shares a bucket with a document of the other;
  there full sets are compared. So a pair that shares a band meets once, and parts that hang
  together by chance links cost no more than these links. A task counts intersections by postings
  and gives back each document's links and a forest of the linked ones, never the pairs.
* Connected parts of the verified links are the duplicate groups.

Connected parts come from rounds of large-star and small-star steps over tables in the shared
folder; no link or part comes to the driver. The neighbours of a star's centre are dealt over SALTS tasks.

Defined cases: null texts and texts without a word have no set: no links, and a group of their own;
rows with one id are one document (if their texts differ, that of the smallest set hash counts);
null ids take no part; an empty table gives no rows; other columns are ignored. Very long texts
make blocks of few documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ALNUM, LOWER, Words, drop_kept, keep, mix, steps, table, text_buffers, windows

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: N-grams in a block of documents that are verified, and n-grams that a document counts as besides
#: its own, which bounds the documents of a block.
BLOCK_WEIGHT, DOC_WEIGHT = 1 << 19, 256
#: Tasks among which the neighbours of one node are dealt.
SALTS = 16


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows) for at most so many hashes: most rows, then fewest bands."""
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("too few hashes for this recall")


def _grams(rows: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words, and where each text's begin."""
    w = Words(*text_buffers(rows.column(rows.schema.get_field_index("text"))), ALNUM, LOWER)
    h, size = w.hashes(), np.diff(w.bounds)
    left = np.repeat(w.bounds[1:], size) - np.arange(len(h))
    ok = left >= n
    g = np.zeros(len(h), np.uint64)
    full = windows(h, n)
    g[: len(full)] = full
    for d in np.flatnonzero((size > 0) & (size < n)):  # one run for a short text, whatever n is
        a, b = w.bounds[d], w.bounds[d + 1]
        g[a] = windows(h[a:b], b - a)[0]
        ok[a] = True
    return g[ok], np.concatenate([[0], np.cumsum(ok)])[w.bounds]


def _unique(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of each text."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(bounds) - 1))]).astype(np.int64)


def _signatures(n: int, bands: int, per_band: int):
    state = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 32, (bands * per_band, 2), dtype=np.uint64).astype(np.uint32)

    def run(batches):
        for rows in steps(batches, "text"):
            g, bounds = _grams(rows, n)
            g, bounds = _unique(g, bounds)
            some = np.flatnonzero(np.diff(bounds) > 0)
            if not len(some):
                continue
            at = bounds[:-1][some]
            low, high = g.astype(np.uint32), (g >> np.uint64(32)).astype(np.uint32)
            out = []
            for b in range(bands):
                h = np.full(len(some), b + 1, np.uint64)
                for a, x in state[b * per_band : (b + 1) * per_band]:
                    value = (low ^ x) * (a | np.uint32(1)) + high
                    value ^= value >> np.uint32(15)
                    value *= np.uint32(0x2C1B3C6D)
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, at))
                out.append(h.view(np.int64))
            # a class is the set itself: two sums over the mixed members, and their number
            one, two = np.add.reduceat(mix(g), at), np.add.reduceat(mix(g ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
            flat = np.stack(out, axis=1).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(some)),
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.diff(bounds)[some].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(flat)),
                ],
                ["id", "set1", "set2", "n_grams", "bands"],
            )

    return run


def connected(links: DataFrame, what: str = "links") -> DataFrame:
    """node, root (the smallest node of its connected part) for links (a, b) of long ids, by
    alternating large-star and small-star steps until the links no longer change."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = keep(links.select("a", "b").where("a <> b").distinct(), what)
    before = None
    while True:
        # large star: every larger neighbour is linked to the smallest of the neighbourhood; only
        # nodes with a larger neighbour, of which there are few, are copied for the salts
        near = both(edges).groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most")).where("most > a")
        least = near.select("a", F.least("a", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        up = both(edges).where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        large = up.join(least, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = keep(large, what)
        # small star: every smaller neighbour, and the node, are linked to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        small = keep(small, what)
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_kept(edges)
        drop_kept(large)
        edges = small
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _weighed(batches):
    """Rows in order with the weight of those up to them in their partition."""
    part, upto = TaskContext.get().partitionId(), 0
    for b in batches:
        total = upto + np.cumsum(b.column(3).to_numpy().astype(np.int64) + DOC_WEIGHT)
        upto = int(total[-1]) if len(total) else upto
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.full(len(total), part, np.int32)), pa.array(total)], ["id", "copies", "set1", "range", "upto"])


def _in_blocks(ordered: DataFrame, weight: int) -> DataFrame:
    """id, copies, set1, block of ordered rows (id, copies, set1, n_grams), cut by weight. The driver
    sees two numbers a partition."""
    rows = keep(ordered.mapInArrow(_weighed, "id long, copies long, set1 long, range int, upto long"), "weighed")
    begin, total = [], 0
    for r in sorted(rows.groupBy("range").agg(F.max("upto").alias("weight")).collect()):
        begin.append((r["range"], total))
        total += r["weight"]
    begins = ordered.sparkSession.createDataFrame(begin, "range int, begin long")
    return rows.join(F.broadcast(begins), "range").select("id", "copies", "set1", F.floor((F.col("begin") + F.col("upto")) / weight).alias("block"))


def _verify(threshold: float):
    """Links and a spanning forest within one pair of blocks (x, y)."""

    def run(key, t):
        # a document that was read in two tasks is here twice
        t = t.take(np.unique(t.column("id").to_numpy(), return_index=True)[1])
        ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
        weight = t.column("copies").to_numpy().astype(np.int64)
        sets = t.column("grams")
        order = np.lexsort((ids, side))
        x, y = (order[side[order] == s] for s in (0, 1))
        own = key[0] == key[1]  # a block with itself
        if own:
            y = x
        get = lambda k: np.frombuffer(sets[int(k)].as_buffer(), np.uint64)
        ys = [get(k) for k in y]
        size_y = np.array([len(s) for s in ys], np.int64)
        flat = np.concatenate(ys) if ys else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(y)), size_y)
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        links = np.zeros(t.num_rows, np.int64)
        parent = np.arange(t.num_rows)

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for i, k in enumerate(x):
            s = get(k)
            a, b = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
            n = b - a
            pick = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            common = np.bincount(owner[pick], minlength=len(y))
            similar = common >= threshold * (len(s) + size_y - common) - 1e-9
            similar &= common > 0
            if own:
                similar[: i + 1] = False
            hit = y[similar]
            links[k] += weight[hit].sum()
            links[hit] += weight[k]
            for other in hit:
                p, q = root(k), root(other)
                if p != q:
                    if ids[p] < ids[q]:
                        parent[q] = p
                    else:
                        parent[p] = q
        some = np.flatnonzero(links > 0)
        roots = np.array([ids[root(k)] for k in some], np.int64)
        return pa.table({"id": pa.array(ids[some].astype(np.int64)), "root": pa.array(roots), "links": pa.array(links[some])})

    return run


def _sets(n: int):
    """The sets of rows that come in the order of their ids: one for each id, that of its class."""

    def run(batches):
        last = None
        for rows in steps(batches, "text"):
            g, bounds = _unique(*_grams(rows, n))
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(g))])[bounds]
            ids = rows.column(0).to_numpy()
            pick = []
            for i in np.flatnonzero(np.diff(total).view(np.int64) == rows.column(2).field("set1").to_numpy()):
                if ids[i] != last:
                    pick.append(i)
                    last = ids[i]
            raw = [g[bounds[i] : bounds[i + 1]].tobytes() for i in pick]
            yield pa.RecordBatch.from_arrays([rows.column(2).take(pa.array(pick, pa.int64())), pa.array(raw, pa.binary())], ["row", "grams"])

    return run


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block_weight: int = BLOCK_WEIGHT) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group), n_links (documents similar to it, copies
    included), n_copies (documents with its very set of n-grams, itself included)."""
    bands, per_band = plan_bands(threshold, recall)
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    of_set = ["set1", "set2", "n_grams"]
    signed = source.mapInArrow(_signatures(n, bands, per_band), "id long, set1 long, set2 long, n_grams int, bands array<long>")
    one_row = Window.partitionBy("id").orderBy(*of_set)
    signed = keep(signed.withColumn("k", F.row_number().over(one_row)).where("k = 1").drop("k"), "signatures")
    # one document of each set; a hot set is aggregated before it is shuffled
    classes = keep(signed.groupBy(*of_set).agg(F.min_by("bands", "id").alias("bands"), F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    band = classes.select("id", F.posexplode("bands").alias("band", "h"))
    least = band.groupBy("band", "h").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "h", "m")
    shared = keep(band.join(least, ["band", "h"]), "buckets")
    part_of = connected(shared.where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b")), "candidates")
    roots = part_of.select(F.col("root").alias("node"), "root").distinct()
    members = part_of.unionByName(roots).select(F.col("node").alias("id"), F.col("root").alias("part"))
    ordered = members.join(classes.select("id", "copies", "set1", "n_grams"), "id").repartitionByRange("part", "id").sortWithinPartitions("part", "id")
    blocks = keep(_in_blocks(ordered.select("id", "copies", "set1", "n_grams"), block_weight), "blocks")
    # the blocks that a bucket's documents lie in are those that each of them is sent to
    spread = shared.select("id", "band", "h").join(blocks.select("id", "block"), "id")
    lies_in = spread.groupBy("band", "h").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    others = spread.select("id", "band", "h").join(lies_in, ["band", "h"]).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("others"))
    placed = others.join(blocks, "id")
    texts = source.withColumnRenamed("doc_id", "id").join(placed.hint("merge"), "id").select("id", "text", F.struct("id", "set1", "copies", "block", "others").alias("row"))
    sets = texts.mapInArrow(_sets(n), "row struct<id:long,set1:long,copies:long,block:long,others:array<long>>, grams binary")
    pairs = sets.select("row.id", "row.copies", "grams", F.col("row.block").alias("own"), F.explode("row.others").alias("other")).select(
        "id", "copies", "grams", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    found = keep(pairs.groupBy("x", "y").applyInArrow(_verify(threshold), "id long, root long, links long"), "verified")
    group = connected(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "groups")
    n_links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = classes.join(n_links, "id", "left").join(group, F.col("id") == F.col("node"), "left").select(
        *of_set, F.coalesce("root", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies"
    )
    out = signed.select("id", *of_set).join(per_class, of_set).select(
        F.col("id").alias("doc_id"), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")
    )
    alone = source.select("doc_id").distinct().join(out.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(alone)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, min(r.b) AS class_id, CAST((SELECT count(*) FROM l WHERE l.a = r.a) AS BIGINT) AS n_links FROM r GROUP BY r.a
"""
