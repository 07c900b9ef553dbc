"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

* Random indexing: every word (hashed into a fixed number of rows) and every word shape (case,
  last character, whether it repeats the word before) has a sparse random index vector. A word's
  and a shape's vector is the sum, over all places of the whole corpus, of the index vectors of
  the words and shapes within two places. The sums are exact, made in each task and added row by row.
* Pooling: a document is the mean vector of its words, that of its shapes, the mean product of
  neighbouring word vectors, and its length.
* A network with one hidden layer is fitted in numpy on the labelled rows of the sample, and a
  temperature on rows held back makes its probabilities calibrated.

``sample`` bounds the labelled rows that the network is fitted on (those of smallest hash);
vectors and scores cover every row and whole texts.

Defined cases: a text without words (null, empty, white space) is the zero vector, which is
scored like any other; an id labelled more than once has its lowest label; null labels are
ignored; without labels of both kinds every score is the share of label 1 (0.5 without labels);
repeated rows are scored alike; an empty table gives no rows; other columns pass unchanged. A very
long text is a step of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._common import PLAIN, Words, mix, steps, table, text_buffers

#: Rows for hashed words, rows for shapes, length of a vector, places on either side.
BUCKETS, SHAPES, DIM, REACH = 8192, 128, 24, 2
ROWS = BUCKETS + SHAPES
#: Labelled rows that the network is fitted on, at most.
SAMPLE = 20_000
SUMS = [f"s{k}" for k in range(DIM)]
CUT = 0.7
#: Text bytes of one numpy step: vectors of all its words are in memory.
STEP_BYTES = 256 << 10


def index_vectors() -> np.ndarray:
    """One +1 and one -1 in each row."""
    rnd = np.random.Generator(np.random.PCG64(11))
    out = np.zeros((ROWS, DIM), np.float32)
    for sign in (1.0, -1.0):
        out[np.arange(ROWS), rnd.integers(0, DIM, ROWS)] += sign
    return out


def _units(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word row and shape row of each word, and the bounds of texts."""
    w = Words(*text_buffers(rows.column(rows.schema.get_field_index("text"))), PLAIN)
    h = w.hashes()
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.bounds
    last, first = w.data[w.ends - 1], w.data[w.starts]
    upper = np.concatenate([[0], np.cumsum((w.data >= 0x41) & (w.data <= 0x5A))])
    small = np.concatenate([[0], np.cumsum((w.data >= 0x61) & (w.data <= 0x7A))])
    n_upper, n_small = upper[w.ends] - upper[w.starts], small[w.ends] - small[w.starts]
    case = np.where(n_upper == 0, 0, np.where(n_small == 0, 3, np.where((first >= 0x41) & (first <= 0x5A) & (n_upper == 1), 1, 2)))
    case = np.where((n_upper == 0) & (n_small == 0), 4, case)
    letter = (last >= 0x41) & (last <= 0x5A) | (last >= 0x61) & (last <= 0x7A) | (last >= 0x80)
    stop, digit = np.isin(last, [ord(c) for c in ".!?"]), (last >= 0x30) & (last <= 0x39)
    pause, bracket = np.isin(last, [ord(c) for c in ",;:-"]), np.isin(last, [ord(c) for c in "()[]{}<>'\""])
    end = np.select([letter, stop, pause, digit, bracket], [0, 1, 2, 3, 4], 5)
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[w.bounds[:-1][np.diff(w.bounds) > 0]] = 0
    shape = case * 12 + end * 2 + same
    return (mix(h) % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + shape, w.bounds


def _contexts(batches):
    index = index_vectors()
    total = np.zeros((ROWS, DIM))
    for rows in steps(batches, "text", STEP_BYTES):
        word, shape, bounds = _units(rows)
        if not len(word):
            continue
        own = index[word] + index[shape]
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        around = np.zeros_like(own)
        for k in range(1, REACH + 1):
            near = (doc[k:] == doc[:-k])[:, None]
            around[k:] += own[:-k] * near
            around[:-k] += own[k:] * near
        for unit in (word, shape):
            order = np.argsort(unit.astype(np.int16), kind="stable")
            cut = np.flatnonzero(np.diff(unit[order], prepend=-1))
            total[unit[order][cut]] += np.add.reduceat(around[order], cut, axis=0, dtype=np.float64)
    some = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, k].astype(np.int64)) for k in range(DIM))], ["unit", *SUMS])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of unit length of all words and shapes, from all documents."""
    sums = np.zeros((ROWS, DIM))
    found = docs.select("text").mapInArrow(_contexts, "unit int, " + ", ".join(f"{c} long" for c in SUMS)).groupBy("unit").agg(*[F.sum(c).alias(c) for c in SUMS])
    for r in found.collect():  # ROWS rows at most
        sums[r["unit"]] = r[1:]
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.maximum(length, 1)).astype(np.float32)


def pooled(vectors: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
    """One feature row for each text."""
    word, shape, bounds = _units(rows)
    n = np.diff(bounds)
    out = np.zeros((len(n), 3 * DIM + 1), np.float32)
    out[:, -1] = np.log1p(n) / 8
    some = np.flatnonzero(n)
    if len(some):
        at = bounds[:-1][some]
        v, s = vectors[word], vectors[shape]
        doc = np.repeat(np.arange(len(n)), n)
        near = np.zeros_like(v)
        near[1:] = v[1:] * v[:-1] * (doc[1:] == doc[:-1])[:, None]
        for k, x in enumerate((v, s, near)):
            out[some, k * DIM : (k + 1) * DIM] = np.add.reduceat(x, at, axis=0, dtype=np.float64) / n[some, None]
    return out


class Network:
    """tanh layer, one output; inputs are standardised; a temperature divides the output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3):
        rnd = np.random.Generator(np.random.PCG64(seed))
        self.share = float(y.mean()) if len(y) else 0.5
        self.flat = len(np.unique(y)) < 2
        if self.flat:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        order = rnd.permutation(len(x))
        held, own = order[: len(x) // 5], order[len(x) // 5 :]
        if len(np.unique(y[held])) < 2 or len(np.unique(y[own])) < 2:
            held = own = order
        d = x.shape[1]
        self.p = [rnd.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rnd.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            mixed = rnd.permutation(own)
            for a in range(0, len(mixed), 256):
                k = mixed[a : a + 256]
                h = np.tanh(x[k] @ self.p[0] + self.p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -40, 40))) - y[k]) / len(k)
                back = np.outer(e, self.p[2]) * (1 - h * h)
                grads = [x[k].T @ back + 1e-4 * self.p[0], back.sum(axis=0), h.T @ e + 1e-4 * self.p[2], np.array([e.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        raw = self._raw(x[held])
        loss = lambda temp: np.mean(np.logaddexp(0, np.where(y[held] == 1, -raw, raw) / temp))
        temps = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
        self.temperature = float(temps[int(np.argmin([loss(c) for c in temps]))])

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._raw((x - self.mean) / self.scale) / self.temperature, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """Fit on at most ``sample`` rows of labels (doc_id, quality), those of smallest hash."""
    sc = docs.sparkSession.sparkContext
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = one.select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample).select("doc_id", "quality")
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in picked.collect()], picked.schema)  # at most ``sample`` rows
    shared = sc.broadcast(vectors)

    def run(batches):
        for rows in steps(batches, "text", STEP_BYTES):
            x = pooled(shared.value, rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = own.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, x array<float>").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), 3 * DIM + 1)
    return Network(x, np.array([r["quality"] for r in rows], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, out: str = "quality_score") -> DataFrame:
    """The rows of ``docs`` with a column ``out`` (0 to 1, higher: label 1 likelier)."""
    vectors = word_vectors(docs)
    net = train(docs, labels, vectors, sample)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    columns = docs.columns

    def run(batches):
        vectors, net = shared.value
        for rows in steps(batches, "text", STEP_BYTES):
            s = net.predict(pooled(vectors, rows).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s, pa.float64())], [*rows.schema.names, out])

    kept = StructType([*docs.schema.fields, StructField(out, DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, kept)


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id's text, modulo 4, is not 2."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, learnable(table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))
