"""Cross-entropy difference of a target and a background language model.

Both models are bigram models over the words of the corpus, with the same smoothing; the
background's counts are scaled to the target's number of words, so that the two differ by what
they have seen and not by how much. A model gives a word MIX of its share among what follows the word
before (the rest to one is the chance that a text ends there) and the rest of its share among all
words, to each of which ADD was added. No document is scored by its own words: its counts are taken
off the models that have them, the target if it is one, and the background. A document's score is the mean over its words
of the loss under the target model less the loss under the background model: lower is more like the
target, and what the corpus has elsewhere but the target has not is high.

Counts are exact sums over all documents of all words and pairs that occur (64-bit hashes of
them), so the models grow with the corpus and nothing of them is collected or broadcast. Documents
are dealt by id into blocks of about BLOCK_BYTES. A block gives its distinct words and pairs with
their counts, packed by range of the hash; a range adds them up and gives each block the totals of
what it asked for, and the block scores its documents by them. Blocks and ranges grow in number,
not in size, and there are two for each shuffle partition at least. Only five sums (words of the target, words, bytes, and two of a sketch of how many
distinct words there are, which the smoothing allows for; its error is some 1.6 %) reach the driver.

Defined cases: a text without words (null, empty, white space) scores 0 with 0 words; an id that
is labelled more than once is a target if any label says so; without targets the models are equal
up to smoothing; a null doc_id is never a target; repeated rows count as often as they are there;
an empty table gives no rows; other columns are ignored. Rows of one doc_id lie in one block, and
each is a document of its own. A very long text is a step of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import PLAIN, Words, mix, partitions, planes, steps, table, text_buffers, unique, unplanes

#: Registers of the sketch that counts distinct words, as a power of two.
REGISTERS = 12
#: Weight of pairs against single words, and counts added to each word.
MIX, ADD = 0.6, 0.1
#: Text bytes of a block, and text bytes whose words and pairs a range of hashes holds.
BLOCK_BYTES = 8 << 20


def _ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word and of its pair with the word before, whether there is one; bounds of texts."""
    w = Words(*text_buffers(rows.column(rows.schema.get_field_index("text"))), PLAIN)
    h = w.hashes()
    before = np.concatenate([[np.uint64(0)], h[:-1]]) if len(h) else h
    inner = np.ones(len(h), bool)
    inner[w.bounds[:-1][np.diff(w.bounds) > 0]] = False
    pair = mix(mix(before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + h)
    return h, pair, inner, w.bounds


def _sizes(batches):
    """Words and bytes of each text; and, at the end, the registers of a sketch of all words: for
    each the longest run of zeros that a hash of its range begins with."""
    registers = np.zeros(1 << REGISTERS, np.int64)
    kind = None
    for rows in steps(batches, "text"):
        data, offsets = text_buffers(rows.column(1))
        w, kind = Words(data, offsets, PLAIN), rows.column(0).type
        h = mix(w.hashes())
        run = 64 - REGISTERS - np.frexp((h >> np.uint64(REGISTERS)).astype(np.float64))[1]
        np.maximum.at(registers, (h & np.uint64((1 << REGISTERS) - 1)).astype(np.int64), run + 1)
        n = rows.num_rows
        none = pa.nulls(n, pa.int32())
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(w.bounds).astype(np.int64)), pa.array(np.diff(offsets)), none, none], SIZES)
    some = np.flatnonzero(registers)
    if len(some):
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), kind), none, none, pa.array(some.astype(np.int32)), pa.array(registers[some].astype(np.int32))], SIZES)


SIZES = ["doc_id", "words", "bytes", "register", "longest"]


def vocabulary(used: int, inverse: float) -> int:
    """Distinct words by the registers that are used and the sum of their 2**-longest."""
    m = 1 << REGISTERS
    rough = 0.7213 / (1 + 1.079 / m) * m * m / (m - used + inverse)
    if rough <= 2.5 * m and used < m:
        rough = m * np.log(m / (m - used))
    return max(1, round(rough))


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_counts=True)


def _distinct(docs: pa.Table) -> np.ndarray:
    """Hashes of the words and pairs of a block, in order."""
    own = []
    for rows in steps(docs.select(["doc_id", "text"]).to_batches(), "text"):
        word, pair, inner, _ = _ids(rows)
        own.append(unique(np.concatenate([word, pair[inner]])))
    return unique(np.concatenate([np.zeros(0, np.uint64), *own]))


def _ask(ranges: int):
    borders = np.array([(p << 64) // ranges for p in range(1, ranges)], np.uint64)

    def run(key, docs, good):
        ids = good.column("doc_id").combine_chunks()
        every, target = [], []
        for rows in steps(docs.select(["doc_id", "text"]).to_batches(), "text"):
            word, pair, inner, bounds = _ids(rows)
            of_target = np.repeat(pc.is_in(rows.column(0), ids, skip_nulls=True).to_numpy(zero_copy_only=False), np.diff(bounds))
            every += [word, pair[inner]]
            target += [word[of_target], pair[inner & of_target]]
        hashes, background = _counted(every)
        own, n = _counted(target)
        count = np.zeros(len(hashes), np.int64)
        count[np.searchsorted(hashes, own)] = n
        at = np.concatenate([[0], np.searchsorted(hashes, borders), [len(hashes)]])
        out = {"part": [], "block": [], "hashes": [], "target": [], "background": []}
        for p in range(ranges):
            a, b = at[p], at[p + 1]
            if a < b:
                out["part"].append(p)
                out["block"].append(key[0].as_py())
                out["hashes"].append(planes(np.diff(hashes[a:b], prepend=np.uint64(0))))
                out["target"].append(planes(count[a:b]))
                out["background"].append(planes(background[a:b].astype(np.int64)))
        return pa.table({k: pa.array(v, pa.int32() if k in ("part", "block") else pa.binary()) for k, v in out.items()})

    return run


def _hashes(cell) -> np.ndarray:
    return np.cumsum(unplanes(cell.as_buffer(), np.uint64), dtype=np.uint64)


def _answer(key, t):
    asked = [_hashes(c) for c in t.column("hashes")]
    every = unique(np.concatenate(asked))
    total = np.zeros((2, len(every)), np.int64)
    for k, own in enumerate(asked):
        at = np.searchsorted(every, own)
        total[0, at] += unplanes(t.column("target")[k].as_buffer(), np.int64)
        total[1, at] += unplanes(t.column("background")[k].as_buffer(), np.int64)
    answers = [total[:, np.searchsorted(every, own)] for own in asked]
    cells = {"target": pa.array([planes(a[0]) for a in answers], pa.binary()), "background": pa.array([planes(a[1]) for a in answers], pa.binary())}
    return pa.table({"part": t.column("part"), "block": t.column("block"), **cells})


def losses(counts, own, masses, words, member, vocab: int, inner) -> np.ndarray:
    """Loss of each word under the target (row 0) and the background model (row 1), in nats. counts:
    for each model (of the word, its pair, the word before); own: the same within the document, which
    is taken off where member (a row a model) says so; masses: words of each model; words: of the
    document. The pair and the word before are read only where inner says so."""
    out = []
    for k in (0, 1):
        scale = masses[0] / masses[1] if k == 1 and masses[0] and masses[1] else 1.0
        word, pair, before = (np.maximum(c - o * member[k], 0) * scale for c, o in zip(counts[k], own))
        single = (word + ADD) / ((masses[k] - words * member[k]) * scale + ADD * vocab)
        context = np.where(inner, before, 0.0)
        double = np.where(context > 0, pair / np.where(context > 0, context, 1), 0.0)
        weight = np.where(context > 0, MIX, 0.0)
        out.append(-np.log(weight * double + (1 - weight) * single))
    return np.stack(out)


def _within(doc: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
    """How often each entry's unit occurs in its document."""
    _, back, n = np.unique(doc * units + unit, return_inverse=True, return_counts=True)
    return n[back.ravel()]


def _score(masses, vocab: int, kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("n_words", pa.int64()), ("loss_target", pa.float64()), ("loss_background", pa.float64()), ("difference", pa.float64())])

    def run(docs, answers):
        targets = answers.filter(pc.equal(answers.column("part"), -1)).column("doc_id").combine_chunks()
        answers = answers.filter(pc.greater_equal(answers.column("part"), 0)).sort_by("part")
        hashes = _distinct(docs)  # in the order in which they were asked for
        counts = np.stack([np.concatenate([np.zeros(0, np.int64), *(unplanes(c.as_buffer(), np.int64) for c in answers.column(k))]) for k in ("target", "background")])
        if len(hashes) != counts.shape[1]:
            raise RuntimeError("a block has not got the counts of its words")
        out = []
        for rows in steps(docs.select(["doc_id", "text"]).to_batches(), "text"):
            word, pair, inner, bounds = _ids(rows)
            n = np.diff(bounds)
            doc = np.repeat(np.arange(len(n)), n)
            target = pc.is_in(rows.column(0), targets, skip_nulls=True).to_numpy(zero_copy_only=False)
            own, back = np.unique(np.concatenate([word, pair[inner]]), return_inverse=True)
            found = counts[:, np.searchsorted(hashes, own)]
            word, pairs = back[: len(word)], np.zeros(len(word), np.int64)
            pairs[inner] = back[len(word) :]
            earlier = lambda x: np.concatenate([x[:1], x[:-1]])
            of_word, of_pair = _within(doc, word, len(own)), np.zeros(len(word), np.int64)
            of_pair[inner] = _within(doc[inner], pairs[inner], len(own))
            both = losses(
                [(c[word], c[pairs], earlier(c[word])) for c in found], (of_word, of_pair, earlier(of_word)), masses, n[doc],
                (target[doc], np.ones(len(doc))), vocab, inner,
            )
            some = np.flatnonzero(n)
            mean = np.zeros((2, len(n)))
            if len(some):
                mean[:, some] = np.add.reduceat(both, bounds[:-1][some], axis=1) / n[some]
            out.append(pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background (means), difference. The target are the
    documents whose quality labels (doc_id, quality) give as 1."""
    kind = dict(docs.dtypes)["doc_id"]
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast(kind).alias("doc_id")).agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    sizes = docs.select("doc_id", "text").mapInArrow(_sizes, f"doc_id {kind}, words long, bytes long, register int, longest int")
    sizes = sizes.groupBy("doc_id", "register").agg(F.sum("words").alias("words"), F.sum("bytes").alias("bytes"), F.max("longest").alias("longest"))
    marked = sizes.join(good.withColumn("good", F.lit(True)), "doc_id", "left")
    words_of_target, words, size, used, inverse = marked.agg(
        F.sum(F.when(F.col("good"), F.col("words"))), F.sum("words"), F.sum("bytes"), F.count("register"), F.sum(F.pow(F.lit(2.0), -F.col("longest")))
    ).first()
    masses, blocks = (words_of_target or 0, words or 0), max(2 * partitions(docs.sparkSession), -(-(size or 0) // BLOCK_BYTES))
    block = lambda by: F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int").alias("block")
    dealt = docs.select(block(F.coalesce(F.col("doc_id").cast("string"), "text")), "doc_id", "text")
    chosen = good.select(block(F.col("doc_id").cast("string")), "doc_id")
    packed = "part int, block int, hashes binary, target binary, background binary"
    asked = dealt.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(_ask(blocks), packed)
    answers = asked.groupBy("part").applyInArrow(_answer, "part int, block int, target binary, background binary")
    told = answers.unionByName(chosen.select(F.lit(-1).alias("part"), "block", "doc_id"), allowMissingColumns=True)
    arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(masses, vocabulary(used, inverse or 0.0), arrow), f"doc_id {kind}, n_words long, loss_target double, loss_background double, difference double")
    return scored


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
