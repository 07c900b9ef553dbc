"""Shared parts of the training-data operators: written tables, word hashing, byte planes.

Words are found on the UTF-8 bytes of a whole Arrow column at once. A word's hash is the sum of its
eight-byte pieces, each scrambled with its place, scrambled again with the length; a window's hash
joins those of its halves the same way. No step is a polynomial, so texts of a regular make have no
hash in common either. All constants are fixed, so every task gets the same hash for a word. Where
equal hashes must mean equal words, ``distinct`` and ``Lexicon`` compare the bytes.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy step takes; a longer document is a step of its own.
CHUNK_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LANE = np.uint64(0xD1B54A32D192ED03)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and all tasks
    run in this process, as in tests."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        own = "file://" + tempfile.mkdtemp(prefix="hushframe-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def keep(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: this cuts the lineage,
    survives lost executors, and is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hushframe-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Delete the files of a table that ``keep`` wrote and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before: nothing is left to ask
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- words

def byte_table(accept) -> np.ndarray:
    return np.array([bool(accept(b)) for b in range(256)])


#: Words split by ASCII white space.
PLAIN = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Letters, digits and everything outside ASCII.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Maps A-Z to a-z.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column (null counts as empty), without a copy if it can be."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight-byte pieces of byte spans, the last of each filled up with zeros; where each span's
    pieces begin; and the number of each piece in its span. No span is empty."""
    n = (ends - starts + 7) >> 3
    first = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], n)
    at = np.repeat(starts, n) + 8 * k
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.ndarray(len(data) + 1, "<u8", buffer=wide, strides=(1,))[at]
    rest = np.repeat(ends, n) - at
    short = np.flatnonzero(rest < 8)
    value[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
    return value, first, k


def span_hashes(value: np.ndarray, first: np.ndarray, k: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of spans of ``size`` bytes from their pieces."""
    if not len(size):
        return np.zeros(0, np.uint64)
    place = mix(np.arange(1, int(k.max()) + 2, dtype=np.uint64) * _GOLD)
    return mix(np.add.reduceat(mix(value ^ place[k]), first[:-1]) + mix(size.astype(np.uint64)))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A span of each distinct byte string, and the number of each span's string. Strings
    are found by hash and their bytes compared, so that no two are taken for one."""
    size = ends - starts
    value, first, k = pieces(data, starts, ends)
    h = span_hashes(value, first, k, size)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    one, code = order[new], np.empty(len(h), np.int64)
    code[order] = np.cumsum(new) - 1
    if not len(size):
        return one, code
    like = one[code]
    differ = value != value[np.minimum(np.repeat(first[:-1][like], np.diff(first)) + k, len(value) - 1)]
    odd = np.flatnonzero((size != size[like]) | np.logical_or.reduceat(differ, first[:-1]))
    if len(odd):  # strings that share a hash with another one
        more: dict[bytes, int] = {}
        extra = []
        for i in odd:
            text = data[starts[i] : ends[i]].tobytes()
            if text not in more:
                more[text] = len(one) + len(more)
                extra.append(i)
            code[i] = more[text]
        one = np.concatenate([one, extra])
    return one, code


class Words:
    """The words of some texts: byte spans, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, accept: np.ndarray = PLAIN, fold: np.ndarray | None = None):
        n = len(data)
        inside = accept[data]
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:n]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # word numbers at which texts begin and end
        self.data = data if fold is None else fold[data]

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(*pieces(self.data, self.starts, self.ends), self.ends - self.starts)

    def doc(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


class Lexicon:
    """A fixed set of words, numbered from 1. Looks words up by hash and compares their bytes."""

    def __init__(self, words: Words):
        one, code = distinct(words.data, words.starts, words.ends)
        self.of = code + 1  # the number of each word that it was made of
        size = words.ends[one] - words.starts[one]
        edge = np.concatenate([[0], np.cumsum(size)])
        self.data = words.data[np.repeat(words.starts[one] - edge[:-1], size) + np.arange(edge[-1])]
        self.starts, self.ends = edge[:-1], edge[1:]
        self.value, self.first, k = pieces(self.data, self.starts, self.ends)
        h = span_hashes(self.value, self.first, k, size)
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]
        self._by_bytes: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.starts)

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word, 0 for those not in the set."""
        out = np.zeros(len(words), np.int64)
        size = words.ends - words.starts
        value, first, k = pieces(words.data, words.starts, words.ends)
        h = span_hashes(value, first, k, size)
        if not len(self) or not len(h):
            return out
        at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        found = np.flatnonzero(self.hashes[at] == h)
        like = self.order[at[found]]
        n = np.diff(first)[found]
        own = np.repeat(first[:-1][found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        its = np.repeat(self.first[:-1][like], n) + k[own]
        differ = value[own] != self.value[np.minimum(its, len(self.value) - 1)]
        odd = size[found] != (self.ends - self.starts)[like]
        if len(found):
            odd |= np.logical_or.reduceat(differ, np.cumsum(n) - n)
        out[found] = np.where(odd, 0, like + 1)
        for i in found[odd]:  # a hash in common with a word of the set
            if not self._by_bytes:
                self._by_bytes = {self.data[a:b].tobytes(): i + 1 for i, (a, b) in enumerate(zip(self.starts, self.ends))}
            out[i] = self._by_bytes.get(words.data[words.starts[i] : words.ends[i]].tobytes(), 0)
        return out


def windows(h: np.ndarray, size: int, lane: bool = False) -> np.ndarray:
    """Hashes of all runs of ``size`` values, borders of texts not regarded: runs of powers of two
    from pairs of half the length, and the run of ``size`` from those."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _LANE if lane else _GOLD
    power, reach, out, done = mix(h ^ base), 1, None, 0
    while True:
        if size & reach:
            part = power[done : done + n]
            out = part if out is None else mix(out * base + part)
            done += reach
        if done == size:
            return mix(out + np.uint64(size))
        power = mix(power[:-reach] * base + power[reach:])
        reach *= 2


def unique(a: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting: numpy's own way by hashing takes far longer."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def whole(bounds: np.ndarray, size: int) -> np.ndarray:
    """True at each word from which ``size`` words of the same text follow."""
    n = int(bounds[-1])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    return left >= size


def steps(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of at most ``limit`` bytes of ``column`` or one row. Memory
    that is freed goes back to the system, since a worker may live on beside other tasks."""
    pa.set_memory_pool(pa.system_memory_pool())
    _own_pages()
    for batch in batches:
        i = batch.schema.get_field_index(column)
        sizes = np.diff(text_buffers(batch.column(i))[1])
        begin = total = 0
        for k, s in enumerate(sizes):
            if total and total + s > limit:
                yield batch.slice(begin, k - begin)
                begin, total = k, 0
            total += int(s)
        if begin < len(sizes):
            yield batch.slice(begin)
        _trim()


#: glibc's M_MMAP_THRESHOLD.
_MMAP_THRESHOLD = -3


def _own_pages() -> None:
    """Large arrays get pages of their own, which go back when they are freed, however large the
    arrays before them were."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(_MMAP_THRESHOLD, 1 << 22)


def _trim() -> None:
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# ---------------------------------------------------------------- compact numbers

def planes(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: planes of small numbers are zeros, which compress away."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unplanes(raw, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(raw, np.uint8)
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(dtype).ravel()
