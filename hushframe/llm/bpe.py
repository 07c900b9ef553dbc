"""Byte-level BPE: encoding by ranked merges in Spark higher-order functions, and decoding.

1. Texts are cut into matches of the split pattern, exactly as the regular expression would cut
   them, on whole columns at once (``cuts``). A block of documents gives its distinct words (found
   by hash, bytes compared), each as its bytes' tokens and the ranks whose pieces occur in it, and
   its documents as word numbers.
2. Each distinct word is folded: ``aggregate`` goes through its ranked merges from the lowest, and
   each joins all its pairs of tokens, from the left. The literal rank map, from a rank to its
   pair and joined token, is read by array index.
3. Word numbers become ids by array reads. Nothing is shuffled, nothing grows with the corpus,
   and only the vocabulary is shipped.

A row of tokens is a text with a character a token (``token``): Spark's ``replace`` then joins
pairs, and ``array_join`` rows. This holds for vocabularies of under 1,112,064 ranks; a larger one is
refused. Decoding looks every id up in the literal array of pieces and concatenates them; pieces
travel as text with a character a byte, since Spark joins arrays of text only.

Defined cases: null text is empty and has no ids; a null doc_id is kept; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored. A very long text is a
block of its own, a very long word is folded like any other.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import distinct, mix, steps, table, text_buffers, unique

#: Text bytes of a block.
BLOCK_BYTES = 2 << 20

# ---------------------------------------------------------------- split pattern

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 4


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point, from the same Unicode tables as the pattern's."""
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            kinds[at[m.start() : m.end()]] = kind
    return kinds


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.int32)
    if len(lead) == len(data):
        return b, lead
    follow = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
    two, three, four = (b >= 0xC0) & (b < 0xE0), (b >= 0xE0) & (b < 0xF0), b >= 0xF0
    out = b.copy()
    k = lead[two]
    out[two] = (b[two] & 0x1F) << 6 | follow[k + 1]
    k = lead[three]
    out[three] = (b[three] & 0x0F) << 12 | follow[k + 1] << 6 | follow[k + 2]
    k = lead[four]
    out[four] = (b[four] & 0x07) << 18 | follow[k + 1] << 12 | follow[k + 2] << 6 | follow[k + 3]
    return out, lead


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes at which matches begin, in texts that lie one after another. The pattern is

        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    Its matches cover a text without gaps, so their beginnings say all."""
    if not len(data):
        return np.zeros(0, np.int64)
    point, lead = _points(data)
    n = len(point)
    kind = _classes()[point]
    edge = np.zeros(n + 1, bool)  # of a text
    edge[np.searchsorted(lead, offsets)] = True
    begin = np.ones(n + 1, bool)  # of a run of one class
    begin[1:n] = kind[1:] != kind[:-1]
    begin[edge] = True
    begin[n] = True
    start = begin[:n].copy()
    # the last character of white space before a run stands alone, or with the run if it is a blank
    last = np.flatnonzero((kind == SPACE) & begin[1:] & ~edge[1:])
    start[last] = True
    blank = last[point[last] == 0x20]
    start[blank + 1] = False
    # an apostrophe that begins a match takes a contraction's letters off the run that follows
    apostrophe = np.flatnonzero((point == 0x27) & start & begin[1:] & ~edge[1:])
    after = np.concatenate([point, np.zeros(2, point.dtype)])
    a, b = after[apostrophe + 1], after[apostrophe + 2]
    b = np.where(edge[np.minimum(apostrophe + 2, n)], 0, b)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for which, size in ((one, 1), (two & ~one, 2)):
        k = apostrophe[which] + 1
        start[k] = False
        k = k + size
        start[k[k < n]] = True
    return lead[np.flatnonzero(start)]


# ---------------------------------------------------------------- rank map

def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Code points that are no characters, and how many there are.
GAP, GAP_SIZE = 0xD800, 0x800


def token(i: int) -> str:
    """The character that stands for a rank: the i-th code point that is a character."""
    return chr(i if i < GAP else i + GAP_SIZE)


@functools.lru_cache(maxsize=4)
def merges(path: str) -> tuple[list[str], list[str], list[str]]:
    """For each rank the two tokens that it joins and the joined token, and each byte's token. The
    two tokens of a rank are what its bytes become under the lower ranks alone; a text gets to it
    in no other way, because a pair inside a token's bytes meets the same merges there as in the
    token alone, and a merge makes no pair of lower rank than its own."""
    ranks = load_ranks(path)
    size = max(ranks.values()) + 1
    if size >= 0x110000 - GAP_SIZE:
        raise ValueError("as many ranks as there are characters")
    left, right = [""] * size, [""] * size
    for piece, rank in ranks.items():
        if len(piece) == 1:
            continue
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            left[rank] = token(ranks[parts[0]]) + token(ranks[parts[1]])
            right[rank] = token(rank)
    return left, right, [token(ranks[bytes([b])]) for b in range(256)]


def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The hash of a row of bytes with one more."""
    return mix(h + byte.astype(np.uint64) + np.uint64(1))


class Finder:
    """Which ranks' pieces occur in words: a place is followed, byte by byte, as long as a piece may
    begin there (a bit table of beginnings), and pieces are looked up by length and hash. A rank
    that is found by chance joins nothing, since the pair is not there."""

    def __init__(self, ranks: dict[bytes, int], byte_tokens: list[str]):
        spelled = [t.encode() for t in byte_tokens]
        self.size = np.array([len(t) for t in spelled])
        self.byte = np.zeros((256, self.size.max()), np.uint8)
        for b, t in enumerate(spelled):
            self.byte[b, : len(t)] = list(t)
        self.ranks = max(ranks.values()) + 1
        long = [(p, r) for p, r in ranks.items() if len(p) > 1]
        flat = np.frombuffer(b"".join(p for p, _ in long), np.uint8)
        size = np.array([len(p) for p, _ in long], np.int64)
        rank = np.array([r for _, r in long], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        self.by, self.alive = [], np.zeros(1 << 22, bool)
        h, k = np.zeros(len(at), np.uint64), 0
        while len(at):
            h, k = _step(h, flat[at + k]), k + 1
            self.alive[h >> np.uint64(42)] = True  # what pieces begin with
            done = size == k
            order = np.argsort(h[done])
            self.by.append((h[done][order], rank[done][order]))
            h, at, size, rank = h[~done], at[~done], size[~done], rank[~done]

    def spell(self, data: np.ndarray, edges: np.ndarray) -> pa.Array:
        """Each word as the tokens of its bytes."""
        size = self.size[data]
        upto = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(upto[-1], np.uint8)
        for k in range(self.byte.shape[1]):
            on = size > k
            out[upto[:-1][on] + k] = self.byte[data[on], k]
        return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(upto[edges].tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())

    def find(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of each word's pieces, ascending, and where each word's begin."""
        n = len(edges) - 1
        left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(data))
        word = np.repeat(np.arange(n, dtype=np.int32), np.diff(edges))
        keys = []
        at, h = np.arange(len(data)), np.zeros(len(data), np.uint64)
        for k, (known, rank) in enumerate(self.by):
            on = left[at] > k
            at, h = at[on], _step(h[on], data[at[on] + k])
            on = self.alive[h >> np.uint64(42)]  # longer pieces can only go on from here
            at, h = at[on], h[on]
            if not len(at):
                break
            if len(known):
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[i] == h
                keys.append(word[at[hit]].astype(np.int64) * self.ranks + rank[i[hit]])
        key = unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        return (key % self.ranks).astype(np.int32), np.searchsorted(key, np.arange(n + 1) * self.ranks).astype(np.int32)


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_word(word: Column, path: str) -> Column:
    """The tokens of one word: its ranked merges, lowest first, folded over its bytes."""
    left, right, _ = merges(path)
    pair_of, token_of = _array(left), _array(right)
    return F.aggregate(word["merges"], word["bytes"], lambda s, r: F.replace(s, F.get(pair_of, r), F.get(token_of, r)))


def _array(texts: list[str]) -> Column:
    """A literal array of rows of tokens: one literal, cut at a character that is no token."""
    return F.split(F.lit(token(len(texts)).join(texts)), rf"\x{{{ord(token(len(texts))):x}}}", -1)


def _characters(tokens: Column) -> Column:
    return F.when(tokens == "", F.array().cast("array<string>")).otherwise(F.split(tokens, ""))


def numbers(tokens: Column, size: int) -> Column:
    """The ids of a row of tokens of a vocabulary of ``size`` ranks."""
    if size <= GAP:
        return F.transform(_characters(tokens), F.ascii)
    return F.transform(_characters(tokens), lambda c: F.when(F.ascii(c) < GAP, F.ascii(c)).otherwise(F.ascii(c) - GAP_SIZE))


# ---------------------------------------------------------------- blocks

_finders: dict[bytes, Finder] = {}


def _finder(ranks: dict[bytes, int], byte_tokens: list[str]) -> Finder:
    """One for each vocabulary that a worker has met."""
    key = hashlib.sha256(b"".join(b"%d,%d," % (len(p), r) + p for p, r in ranks.items())).digest()
    if key not in _finders:
        _finders[key] = Finder(ranks, byte_tokens)
    return _finders[key]


def _blocks(ranks: dict[bytes, int], byte_tokens: list[str]):
    """Blocks of documents: distinct words, and documents as word numbers."""

    def run(batches):
        finder = _finder(ranks, byte_tokens)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        for rows in steps(batches, "text", BLOCK_BYTES):
            data, offsets = text_buffers(rows.column(1))
            begin = cuts(data, offsets)
            end = np.append(begin[1:], len(data))[: len(begin)]
            first, code = distinct(data, begin, end)
            a, size = begin[first], (end - begin)[first]
            edges = np.concatenate([[0], np.cumsum(size)])
            gathered = data[np.repeat(a - edges[:-1], size) + np.arange(edges[-1])]
            found, bounds = finder.find(gathered, edges)
            words = pa.StructArray.from_arrays([finder.spell(gathered, edges), pa.ListArray.from_arrays(pa.array(bounds), pa.array(found))], ["bytes", "merges"])
            upto = np.searchsorted(begin, offsets).astype(np.int32)
            docs = pa.StructArray.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(upto), pa.array(code.astype(np.int32)))], ["doc_id", "codes"])
            yield pa.RecordBatch.from_arrays([one(words), one(docs)], ["words", "docs"])

    return run


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, tokens string: each whole text by the ranks in ``path``, a character a token, no
    special tokens."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"words array<struct<bytes:string,merges:array<int>>>, docs array<struct<doc_id:{kind},codes:array<int>>>"
    blocks = docs.select("doc_id", "text").mapInArrow(_blocks(load_ranks(path), merges(path)[2]), schema)
    of_word = F.transform("words", lambda w: fold_word(w, path))
    joined = lambda found: F.transform(F.col("docs"), lambda d: F.struct(d["doc_id"].alias("doc_id"), F.array_join(F.transform(d["codes"], lambda c: F.get(found, c)), "").alias("tokens")))
    return blocks.select(F.inline(_let(of_word, joined)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>: each whole text by the ranks in ``path``, no special tokens."""
    return tokens(docs, path).select("doc_id", numbers(F.col("tokens"), vocabulary_size(path)).alias("ids"))


def _pieces(path: str) -> Column:
    """The literal array of the ranks' pieces, a character a byte."""
    pieces = {rank: piece.decode("latin-1") for piece, rank in load_ranks(path).items()}
    return F.split(F.lit("\u0100".join(pieces.get(i, "") for i in range(max(pieces) + 1))), "\u0100", -1)


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids."""
    pieces = _pieces(path)
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")


def decode_tokens(row: Column, path: str) -> Column:
    """The bytes of a row of tokens: the same as of its ids, which are read on the way."""
    pieces, size = _pieces(path), vocabulary_size(path)
    number = F.ascii if size <= GAP else lambda c: F.when(F.ascii(c) < GAP, F.ascii(c)).otherwise(F.ascii(c) - GAP_SIZE)
    return F.encode(F.array_join(F.transform(_characters(row), lambda c: F.get(pieces, number(c))), ""), "ISO-8859-1")


def little_endian(tokens: Column, size: int) -> Column:
    """The ids of a row of tokens as unsigned 32-bit numbers, low byte first."""
    if size <= GAP:  # an id is a character of two bytes then, and 0 its upper half
        return F.encode(F.when(tokens == "", "").otherwise(F.concat(F.array_join(F.split(tokens, ""), "\u0000"), F.lit("\u0000"))), "UTF-16LE")
    hexed = F.split(F.lit(",".join(i.to_bytes(4, "little").hex() for i in range(size))), ",")
    return F.unhex(F.array_join(F.transform(numbers(tokens, size), lambda i: F.get(hexed, i)), ""))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def vocabulary_size(path: str) -> int:
    return max(load_ranks(path).values()) + 1


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    size, row = vocabulary_size(path), F.col("tokens")
    return tokens(table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        F.char_length(row).cast("long").alias("n_tokens"),
        F.sha2(little_endian(row, size), 256).alias("ids_sha256"),
        F.sha2(decode_tokens(row, path), 256).alias("decoded_sha256"),
    )
