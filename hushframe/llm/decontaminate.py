"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of whole documents of one task. Its words become symbols: a word of the
benchmark has its number (found by hash, bytes compared), every other word the separator, and each
document ends with one. Runs between separators shorter than the shortest window cannot hold an occurrence and are left out,
which changes no result. The FM-index of a shard is its Burrows-Wheeler transform in a wavelet
tree with sampled ranks, plus sampled suffix positions. All windows are searched backward
together, one symbol a step; occurrences are located by walking to the next sampled position, and
their spans are merged per document.

The benchmark goes to the tasks in blocks of at most BLOCK_WORDS words, some 40 bytes a word; a
larger benchmark takes a pass over the rows, with an index of its words, for each block.

Defined cases: null text has no words; a null item text, or one without words, has no window; a
null item_id is an item whose id is the empty string; repeated items and repeated rows count
each on their own row; item_ids that are equal count once; an empty table on either side gives
every document without hits; other columns are ignored. A very long text is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._common import ALNUM, LOWER, Lexicon, Words, keep, steps, table, text_buffers, unique

WINDOW = 10
#: Bytes of document text in one shard.
SHARD_BYTES = 4 << 20
#: One suffix position in so many is kept; ranks are kept at every so many symbols.
SAMPLE, RANK = 8, 64
#: Benchmark words that a broadcast holds; a larger benchmark goes in several, one after another.
BLOCK_WORDS = 1 << 22


# ---------------------------------------------------------------- FM-index

def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling; each round sorts only the suffixes that are still tied."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = s[order][1:] != s[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    size = 1
    while True:
        tied = np.zeros(n, bool)  # places of the order whose suffix has an equal beside it
        tied[:-1] |= ~new[1:]
        tied[1:] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        suf = order[at]
        nxt = np.where(suf + size < n, rank[np.minimum(suf + size, n - 1)], -1)
        by = np.lexsort((nxt, rank[suf]))
        order[at] = suf[by]
        head, follow = rank[suf][by], nxt[by]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])
        new[at] |= fresh
        rank[order[at]] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        size *= 2


class WaveletTree:
    """Levelwise wavelet tree (one bit vector a level, most significant bit first)."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.n = bits, len(s)
        self.level, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            ones = np.zeros(self.n // RANK + 2, np.int32)
            full = np.add.reduceat(bit, np.arange(0, self.n, RANK)) if self.n else np.zeros(0, np.int64)
            ones[1 : len(full) + 1] = np.cumsum(full)
            packed = np.zeros((self.n // RANK + 1) * RANK, np.uint8)
            packed[: self.n] = bit
            self.level.append((ones, np.packbits(packed, bitorder="little").view("<u8")))
            self.zeros.append(self.n - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        ones, packed = self.level[level]
        block, off = i // RANK, (i % RANK).astype(np.uint64)
        return ones[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << off) - np.uint64(1))).astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place i."""
        low, high = np.zeros_like(i), i
        for level in range(self.bits):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self._ones(level, low), self._ones(level, high)
            low = np.where(bit, self.zeros[level] + a, low - a)
            high = np.where(bit, self.zeros[level] + b, high - b)
        return high - low

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for level in range(self.bits):
            ones, packed = self.level[level]
            bit = ((packed[i // RANK] >> (i % RANK).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            symbol = symbol * 2 + bit
            a = self._ones(level, i)
            i = np.where(bit == 1, self.zeros[level] + a, i - a)
        return symbol


class FMIndex:
    """Over symbols from 1 up; 0 is the separator. Inside, all are one higher, and 0 ends the text."""

    def __init__(self, s: np.ndarray, symbols: int):
        s = np.append(s.astype(np.int64) + 1, 0)
        suffixes = suffix_array(s)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols + 2))])
        self.tree = WaveletTree(s[suffixes - 1], int(symbols + 1).bit_length())
        marked = suffixes % SAMPLE == 0
        self.marked = marked
        self.upto = np.concatenate([[0], np.cumsum(marked)])
        self.sampled = suffixes[marked]
        self.n = len(s)

    def search(self, symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (runs of ``symbols``) at once: ranges of suffixes."""
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), self.n, np.int64)
        for k in range(int(sizes.max(initial=0))):
            on = np.flatnonzero((sizes > k) & (high > low))
            if not len(on):
                break
            c = symbols[begin[on] + sizes[on] - 1 - k].astype(np.int64) + 1
            low[on], high[on] = self.before[c] + self.tree.rank(c, low[on]), self.before[c] + self.tree.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes by walking back to the next sampled one."""
        out, walked = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            hit = self.marked[rows[left]]
            done = left[hit]
            out[done] = self.sampled[self.upto[rows[done]]] + walked[done]
            left = left[~hit]
            c = self.tree.access(rows[left])
            rows[left] = self.before[c] + self.tree.rank(c, rows[left])
            walked[left] += 1
        return out


# ---------------------------------------------------------------- operator

class Block:
    """Some items of the benchmark: their words, and every window as a place in the items' words."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        raw = [t.encode() for t in texts]
        words = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), ALNUM, LOWER)
        self.ids, self.words = ids, Lexicon(words)
        self.numbers = self.words.of.astype(np.int32)
        n = np.diff(words.bounds)
        size = np.minimum(n, window)
        count = np.where(n > 0, n - size + 1, 0)
        self.item = np.repeat(np.arange(len(n), dtype=np.int32), count)
        self.begin = (np.repeat(words.bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())).astype(np.int32)
        self.size = size[self.item].astype(np.int32)
        self.least = int(self.size.min())


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """Blocks of whole items with at most ``limit`` words (or one item). Rows come to the driver one
    after another."""
    ids, texts, total = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        raw = np.frombuffer(r["t"].encode(), np.uint8)
        n = len(Words(raw, np.array([0, len(raw)]), ALNUM, LOWER))
        if not n:
            continue
        if total and total + n > limit:
            yield Block(ids, texts, window)
            ids, texts, total = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        total += n
    if ids:
        yield Block(ids, texts, window)


def _hits(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first word and the window, of all occurrences in some texts."""
    symbol = block.words.numbers(words)
    n = len(symbol)
    edge = np.ones(n + 1, bool)  # a run begins
    edge[1:-1] = (symbol[1:] == 0) | (symbol[:-1] == 0)
    edge[words.bounds] = True
    run = np.flatnonzero(edge)
    size = np.diff(run)
    good = (size >= block.least) & (symbol[run[:-1]] > 0) if n else np.zeros(0, bool)
    if not good.any():
        return (np.zeros(0, np.int64),) * 2
    begin, size = run[:-1][good], size[good]
    into = np.concatenate([[0], np.cumsum(size + 1)])  # each run is followed by a separator
    place = np.repeat(begin - into[:-1], size + 1) + np.arange(into[-1])
    text = symbol[np.minimum(place, n - 1)]
    text[into[1:] - 1] = 0
    index = FMIndex(text, len(block.words))
    low, high = index.search(block.numbers, block.begin, block.size)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return place[index.locate(rows)], which


def _shard(texts: pa.Array, block: Block, before: pa.Array | None) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words of each text, its items and its spans; before: (items, spans) of the blocks before."""
    data, offsets = text_buffers(texts)
    w = Words(data, offsets, ALNUM, LOWER)
    n, doc, n_docs = len(w), w.doc(), len(texts)
    delta = np.zeros(n + 1, np.int64)
    first, which = _hits(w, block)
    size = block.size[which]
    np.add.at(delta, first, 1)
    np.add.at(delta, first + size, -1)
    items: list[set[str]] = [set() for _ in range(n_docs)]
    for key in unique(doc[first] * len(block.ids) + block.item[which]) if len(first) else ():
        items[key // len(block.ids)].add(block.ids[key % len(block.ids)])
    if before is not None:
        for d, r in enumerate(before.to_pylist()):
            items[d].update(r["items"])
            for span in r["spans"]:
                delta[w.bounds[d] + span["first"]] += 1
                delta[w.bounds[d] + span["last"]] -= 1
    covered = np.cumsum(delta[:-1]) > 0
    begin = covered.copy()
    begin[1:] &= ~covered[:-1]
    inner = w.bounds[1:-1][w.bounds[1:-1] < n]
    begin[inner] = covered[inner]
    last = covered.copy()
    last[:-1] &= ~covered[1:]
    ends = w.bounds[1:][np.diff(w.bounds) > 0] - 1
    last[ends] = covered[ends]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    base, byte = w.bounds[:-1][doc[s]], offsets[:-1][doc[s]]
    spans = [s - base, e - base, w.starts[s] - byte, w.ends[e - 1] - byte]
    of_doc = np.concatenate([[0], np.cumsum(np.bincount(doc[s], minlength=n_docs))])
    struct = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in spans], ["first", "last", "byte_first", "byte_last"])
    return np.diff(w.bounds).astype(np.int64), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(of_doc.astype(np.int32)), struct)


MARKS = "struct<n_words:long,items:array<string>,spans:array<struct<first:long,last:long,byte_first:long,byte_last:long>>>"


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, out: str = "marks", limit: int = BLOCK_WORDS, finish: Callable | None = None) -> DataFrame:
    """The rows of ``docs`` with a column ``out``: n_words, items (sorted ids) and spans of hit words
    (word numbers and bytes, ends excluded); or what ``finish`` makes of the columns and the spans. A block of the benchmark is a pass over the rows, which
    are written in between, so that a task never holds two."""
    sc, columns = docs.sparkSession.sparkContext, docs.columns
    text = columns.index("text")
    found = None
    blocks = benchmark_blocks(benchmark, window, limit)
    block = next(blocks, None) or Block([""], ["\u0001 no item"], window)  # without items: a window that no text has
    while block is not None:
        following = next(blocks, None)
        shared = sc.broadcast(block)

        def run(batches, shared=shared, more=found is not None, finish=None if following else finish):
            for rows in steps(batches, columns[text], SHARD_BYTES):
                n, items, spans = _shard(rows.column(text), shared.value, rows.column(len(columns)) if more else None)
                if finish:
                    yield pa.RecordBatch.from_arrays(finish(rows.columns[: len(columns)], spans), columns)
                    continue
                marks = pa.StructArray.from_arrays([pa.array(n), items, spans], ["n_words", "items", "spans"])
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], marks], [*columns, out])

        kept = StructType([*docs.schema.fields, StructField(out, StructType.fromDDL(f"m {MARKS}").fields[0].dataType)])
        found = (docs if found is None else found).mapInArrow(run, docs.schema if finish and not following else kept)
        if following is not None:
            found = keep(found, "marked")
            shared.destroy()
        block = following
    return found


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids), spans of hit words (word numbers
    and bytes, ends excluded)."""
    found = marked(docs.select("doc_id", "text"), benchmark, window, "marks", limit)
    hit = F.aggregate("marks.spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select("doc_id", "marks.n_words", hit.alias("n_hit"), "marks.items", "marks.spans")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` with the hit words taken out of ``text`` (each run leaves a line break);
    a column ``n_chars`` counts the new text. Texts without hits are not touched."""
    columns = docs.columns

    def cut(row_columns: list, spans: pa.Array) -> list:
        hit = np.flatnonzero(pc.list_value_length(spans).to_numpy(zero_copy_only=False))
        if not len(hit):
            return row_columns
        new, at_text = list(row_columns), columns.index("text")
        texts, counts = new[at_text].to_pylist(), {}
        for k in hit:
            raw, at, out = texts[k].encode(), 0, []
            for span in spans[int(k)].as_py():
                out.append(raw[at : span["byte_first"]])
                at = span["byte_last"]
            out.append(raw[at:])
            texts[k] = b"\n".join(out).decode()
            counts[int(k)] = len(texts[k])
        new[at_text] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            i = columns.index("n_chars")
            new[i] = pa.array([counts.get(k, n) for k, n in enumerate(new[i].to_pylist())], new[i].type)
        return new

    return marked(docs, benchmark, window, "__marks", limit, cut)


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII.format("text")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_ASCII.format("text")}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS t
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT dw.doc_id, dw.size, dw.i, win.item_id FROM dw JOIN win ON dw.size = win.size AND dw.t = win.t),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
