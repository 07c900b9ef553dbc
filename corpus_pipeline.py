"""A corpus pipeline of five of the training-data operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. The last gives doc_id, n_tokens, ids and the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import bpe, decontaminate, neardup, pii, quality
from hushframe.llm._common import keep, table

#: A column that the stages add and take away again.
OWN = "__hushframe"


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = quality.score_quality(docs, quality.learnable(table(spark, sf_dir, "labels")), out=OWN)
    return scored.where(F.col(OWN) >= quality.CUT).drop(OWN)


def _with_key(docs: DataFrame) -> tuple[DataFrame, bool]:
    """A column OWN that is the doc_id where that is of one row, and whether others are there: of
    rows with one doc_id those of one text have the doc_id, other texts a hash above all small
    ids; rows without a doc_id have such a hash too."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("text").isNotNull(), text_hash)).alias("first"))
    odd = keep(rows.where("rows > 1 or doc_id is null").select(F.col("doc_id").alias(OWN), F.coalesce("first", F.lit(0)).alias(OWN + "_first")), "repeated-ids")
    if not odd.head(1):
        return docs.withColumn(OWN, F.col("doc_id").cast("long")), False
    marked = docs.join(odd, docs["doc_id"].eqNullSafe(odd[OWN]), "left").drop(OWN)
    first = F.col(OWN + "_first")
    other = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)
    key = F.when(F.col("doc_id").isNotNull() & (first.isNull() | (first == text_hash)), F.col("doc_id").cast("long")).otherwise(other)
    return marked.withColumn(OWN, key).drop(OWN + "_first"), True


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id. Rows that share
    a doc_id, or have none, are judged each by its own text; equal rows are one."""
    keyed, repeated = _with_key(docs)
    classes = neardup.jaccard_classes(keyed.select(F.col(OWN).alias("doc_id"), "text")).where("doc_id = class_id").select(F.col("doc_id").alias(OWN + "_id"))
    stay = keyed.join(classes.hint("merge"), keyed[OWN] == classes[OWN + "_id"], "left_semi")
    return (stay.dropDuplicates([OWN]) if repeated else stay).drop(OWN)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words within an occurrence of a benchmark window are taken out of the text."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates."""
    return pii.replace_pii(docs, pii.session_key(spark), out=OWN).drop(OWN)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; the text is what the ids decode to."""
    path = bpe.vocabulary()
    row = F.col("tokens")
    return bpe.tokens(docs, path).select("doc_id", F.char_length(row).cast("long").alias("n_tokens"), bpe.numbers(row, bpe.vocabulary_size(path)).alias("ids"), bpe.decode_tokens(row, path).cast("string").alias("text"))


STAGES = [
    ("quality classifier", drop_junk),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("PII", replace_personal_data),
    ("byte-level BPE", encode),
]

#: No SQL expresses the classifier, the surrogates or BPE; tests/llm/test_models.py checks the
#: rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
