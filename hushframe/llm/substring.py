"""Substring deduplication with fixed-block anchors.

A window is ``size`` consecutive words; each holds a whole block of ``size // 2`` words that
begins at a multiple of ``size // 2`` of its document. So the index has the non-overlapping blocks
of all documents, and every rolling window of block length probes it:

1. Documents are dealt into buckets of about RANGE_BYTES. A bucket sends the distinct hashes of its
   probes, sorted and packed as differences, a row for each range of hashes, with two bits each:
   whether a block has it, and whether two documents of the bucket do. A hash hits if some block has
   it and two documents do; the answer is a bit for each hash asked. (A short hash only adds false
   hits, which step 2 drops.)
2. The bucket extends its hits: of the ``size``-word windows around them it sends the distinct ones
   (80 bits) with their smallest doc_id. The smallest doc_id of all buckets wins; the answer is again
   a bit for each window asked.
3. Windows that lost are merged where they overlap into maximal repeats, whose words are removed.

A bucket asks once for what it has a thousand times, so a passage that a tenth of all documents
share is an entry a bucket, and no range is hot. Answers are bits in the order of the questions,
which each step finds again from the same documents; what a row says besides its entries is two
numbers. No step makes pairs. The text is shuffled once, and all steps read that same exchange.

Defined cases: null or empty text has no words and the hash of an empty text; a null doc_id counts
as larger than every other; rows with one doc_id and one text count as one document with all its
windows, rows with one doc_id and different texts do not take words from each other; an empty
table gives no rows; other columns are ignored. A very long text makes its bucket larger.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Words, partitions, planes, steps, table, text_buffers, unique, whole, windows

WINDOW = 50
#: Text bytes for one range of hashes and one bucket of documents.
RANGE_BYTES = 8 << 20
NULL_ID = np.iinfo(np.int64).max


def _ids(column) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _cuts(top: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted 32-bit values fall into, and where each range's values begin."""
    part = (top.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    return part[begin], np.append(begin, len(part))


def _narrow(sorted_values: np.ndarray) -> bytes:
    """Sorted numbers as differences, in as many byte planes as the largest needs."""
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    size = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return planes(gaps)[: size * len(gaps)]


def _wide(cell, n: int) -> np.ndarray:
    flat = np.frombuffer(cell.as_buffer(), np.uint8)
    full = np.zeros((8, n), np.uint8)
    full[: len(flat) // n] = flat.reshape(-1, n)
    return np.cumsum(np.ascontiguousarray(full.T).view(np.uint64).ravel(), dtype=np.uint64)


def _bits(cell, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(cell.as_buffer(), np.uint8), count=n).astype(bool)


def _any(flags: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.logical_or.reduceat(flags, begin) if len(begin) else np.zeros(0, bool)


class Bucket:
    """The probes of some documents: distinct hashes of ``bits`` bits, in order."""

    def __init__(self, docs: pa.Table, size: int, bits: int):
        self.size, self.block = size, size // 2
        self.rows, code, ids, anchor = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for rows in steps(docs.select(["doc_id", "text"]).to_batches(), "text"):
            w, own = Words(*text_buffers(rows.column(1))), _ids(rows.column(0))
            words, n_words = w.hashes(), np.diff(w.bounds)
            h = windows(words, self.block)
            at = np.flatnonzero((whole(w.bounds, self.block) & np.repeat(n_words >= size, n_words))[: len(h)])
            doc = np.repeat(np.arange(len(own)), n_words)
            self.rows.append((rows.column(0), w, words, doc, own, at, len(code)))
            code.append(h[at] >> np.uint64(64 - bits))
            ids.append(own[doc[at]])
            anchor.append((at - w.bounds[doc[at]]) % self.block == 0)
        ends = np.cumsum([len(c) for c in code])
        code = np.concatenate(code)
        order = np.argsort(code)
        code = code[order]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        begin = np.flatnonzero(new)
        self.distinct = code[begin]
        of = np.empty(len(code), np.int32)
        of[order] = np.cumsum(new) - 1
        self.of = np.split(of, ends[:-1])  # the number of each probe's hash, by step
        self.anchor = _any(np.concatenate(anchor)[order], begin)
        ids = np.concatenate(ids)[order]
        self.several = np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin) if len(begin) else self.anchor

    def extend(self, hit: np.ndarray) -> None:
        """The windows around the probes whose hash hit (a flag for each distinct one): where they
        start, and the distinct ones with the smallest doc_id of each."""
        self.starts, lane1, lane2, ids = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for _, w, words, doc, own, at, k in self.rows:
            place = at[hit[self.of[k]]]
            first = np.maximum(place - (self.size - self.block), w.bounds[doc[place]])
            delta = np.bincount(first, minlength=len(w) + 1) - np.bincount(place + 1, minlength=len(w) + 1)
            one = windows(words, self.size)
            start = np.flatnonzero(((np.cumsum(delta[:-1]) > 0) & whole(w.bounds, self.size))[: len(one)])
            self.starts.append(start)
            lane1.append(one[start])
            lane2.append(windows(words, self.size, lane=True)[start].astype(np.uint16))
            ids.append(own[doc[start]])
        lane1, lane2, self.ids = (np.concatenate(x) for x in (lane1, lane2, ids))
        order = np.argsort(lane1)  # windows that agree in this lane alone may be asked for twice
        new = np.ones(len(order), bool)
        new[1:] = (lane1[order][1:] != lane1[order][:-1]) | (lane2[order][1:] != lane2[order][:-1])
        begin = np.flatnonzero(new)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.lane1, self.lane2 = lane1[order][begin], lane2[order][begin]
        self.least = np.minimum.reduceat(self.ids[order], begin) if len(begin) else self.ids[:0]


def _answers(replies: pa.Table, kind: int, size: int) -> np.ndarray:
    """The bits of the answers of one kind, in the order of what was asked."""
    own = replies.filter(pc.equal(replies.column("kind"), kind)).sort_by("part")
    flags = np.concatenate([np.zeros(0, bool), *(_bits(b, n.as_py()) for b, n in zip(own.column("bits"), own.column("n")))])
    if len(flags) != size:
        raise RuntimeError("a bucket has not got the answers to what it asked")
    return flags


ASKED = "part long, bucket long, n int, hashes binary, anchors binary, several binary"
REPLY = "bucket long, kind int, part long, n int, bits binary"
SPREAD = "part long, bucket long, n int, lane1 binary, lane2 binary, ids binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(list(c), kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _ask(size: int, parts: int, bits: int):
    def run(key, docs):
        b, out = Bucket(docs, size, bits), []
        part, cut = _cuts(b.distinct >> np.uint64(bits - 32), parts)
        for p, x, y in zip(part, cut[:-1], cut[1:]):
            low = -(-(int(p) << 32) // parts) << (bits - 32)  # the range's first hash
            out.append((int(p), key[0].as_py(), int(y - x), _narrow(b.distinct[x:y] - np.uint64(low)), np.packbits(b.anchor[x:y]).tobytes(), np.packbits(b.several[x:y]).tobytes()))
        return _table(ASKED, out)

    return run


def _match(key, t):
    """Of one range, the hashes that a block has and two documents."""
    n = t.column("n").to_pylist()
    code = np.concatenate([_wide(c, k) for c, k in zip(t.column("hashes"), n)])
    anchor, several = (np.concatenate([_bits(c, k) for c, k in zip(t.column(name), n)]) for name in ("anchors", "several"))
    blocks = unique(code[anchor])
    at = np.minimum(np.searchsorted(blocks, code), max(len(blocks) - 1, 0))
    known = blocks[at] == code if len(blocks) else np.zeros(len(code), bool)
    shared = np.bincount(at[known], minlength=len(blocks)) > 1
    shared[at[known & several]] = True
    hit = known.copy()
    hit[known] = shared[at[known]]
    ends = np.cumsum(n)
    part = key[0].as_py()
    return _table(REPLY, [(b, 0, part, k, np.packbits(hit[e - k : e]).tobytes()) for b, k, e in zip(t.column("bucket").to_pylist(), n, ends)])


def _spread(size: int, parts: int, bits: int):
    """The windows around the hits of a bucket; and the hits themselves, which travel on with them
    under a negative range."""

    def run(key, docs, replies):
        if not docs.num_rows:
            return _table(SPREAD, [])
        bucket = key[0].as_py()
        b = Bucket(docs, size, bits)
        hit = _answers(replies, 0, len(b.distinct))
        b.extend(hit)
        out = [(-1 - bucket % parts, bucket, len(hit), np.packbits(hit).tobytes(), b"", b"")]
        part, cut = _cuts(b.lane1 >> np.uint64(32), parts)
        for p, x, y in zip(part, cut[:-1], cut[1:]):
            out.append((int(p), bucket, int(y - x), _narrow(b.lane1[x:y] - np.uint64(-(-(int(p) << 32) // parts) << 32)), planes(b.lane2[x:y]), planes(b.least[x:y])))
        return _table(SPREAD, out)

    return run


def _resolve(key, t):
    """Of one range, the windows whose words also start in a document with a smaller doc_id than any
    of the bucket that asked."""
    part, n, buckets = key[0].as_py(), t.column("n").to_pylist(), t.column("bucket").to_pylist()
    if part < 0:
        return _table(REPLY, [(b, 0, 0, k, c.as_py()) for b, k, c in zip(buckets, n, t.column("lane1"))])
    lane1 = np.concatenate([_wide(c, k) for c, k in zip(t.column("lane1"), n)])
    plane = lambda c, kind: np.ascontiguousarray(np.frombuffer(c.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    lane2 = np.concatenate([plane(c, np.uint16) for c in t.column("lane2")])
    ids = np.concatenate([plane(c, np.int64) for c in t.column("ids")])
    order = np.lexsort((ids, lane2, lane1))
    new = np.ones(len(order), bool)
    new[1:] = (lane1[order][1:] != lane1[order][:-1]) | (lane2[order][1:] != lane2[order][:-1])
    least = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    lost = np.zeros(len(order), bool)
    lost[order] = ids[order] > least
    ends = np.cumsum(n)
    return _table(REPLY, [(b, 1, part, k, np.packbits(lost[e - k : e]).tobytes()) for b, k, e in zip(buckets, n, ends)])


def _remove(size: int, bits: int):
    def run(key, docs, replies):
        made = [pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})]
        if not docs.num_rows:
            return made[0]
        b = Bucket(docs, size, bits)
        b.extend(_answers(replies, 0, len(b.distinct)))
        lost = _answers(replies, 1, len(b.least))[b.entry] | (b.ids > b.least[b.entry])
        done = 0
        for (column, w, *_), start in zip(b.rows, b.starts):
            delta = np.zeros(len(w) + 1, np.int64)
            gone = start[lost[done : done + len(start)]]
            done += len(start)
            delta[gone] += 1
            np.add.at(delta, gone + size, -1)
            gone = np.cumsum(delta[:-1]) > 0
            # kept words joined by one space: their bytes, each word followed by a space
            stay = ~gone
            mark = np.zeros(len(w.data) + 1, np.int8)
            np.add.at(mark, w.starts[stay], 1)
            np.add.at(mark, w.ends[stay], -1)
            inside = np.cumsum(mark[:-1]) > 0
            length = np.where(stay, w.ends - w.starts, 0)
            total = np.concatenate([[0], np.cumsum(length + stay)])
            joined = np.full(int(total[-1]), 0x20, np.uint8)
            begin = total[:-1][stay]
            run_of = np.repeat(begin - (np.cumsum(length[stay]) - length[stay]), length[stay])
            joined[run_of + np.arange(int(length[stay].sum()))] = w.data[inside]
            raw, edge = joined.tobytes(), total[w.bounds]
            removed = np.concatenate([[0], np.cumsum(gone)])[w.bounds]
            made.append(pa.table({
                "doc_id": column,
                "n_words": pa.array(np.diff(w.bounds).astype(np.int64)),
                "n_removed": pa.array(np.diff(removed).astype(np.int64)),
                "kept": pa.array([raw[x : max(x, y - 1)].decode() for x, y in zip(edge[:-1], edge[1:])], pa.string()),
            }))
        return pa.concat_tables(made)

    return run


def dedup_substrings(docs: DataFrame, size: int = WINDOW, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (kept words joined by one space)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(2 * partitions(docs.sparkSession), math.ceil(total / range_bytes))
    # bits for the blocks there can be and ten more: one probe in a thousand hits by chance
    bits = min(64, max(32, math.ceil(math.log2(max(total, size) / size)) + 10))
    texts = source.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("bucket"), "doc_id", "text")
    hits = texts.groupBy("bucket").applyInArrow(_ask(size, parts, bits), ASKED).groupBy("part").applyInArrow(_match, REPLY)
    spread = texts.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_spread(size, parts, bits), SPREAD)
    lost = spread.groupBy("part").applyInArrow(_resolve, REPLY)
    return texts.groupBy("bucket").cogroup(lost.groupBy("bucket")).applyInArrow(_remove(size, bits), "doc_id long, n_words long, n_removed long, kept string")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
lost AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS g FROM lost GROUP BY doc_id),
word AS (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
dead AS (SELECT doc_id, unnest(g) AS i FROM gone),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n
  FROM word ANTI JOIN dead ON word.doc_id = dead.doc_id AND word.i = dead.i GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
