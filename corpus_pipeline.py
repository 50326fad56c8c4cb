"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of `documents`, whatever further columns there are and whatever their names:
they travel past the operators in a struct.

Cases, for every stage: decisions are about rows, not doc_ids. A null doc_id is a document like others; near-dedup, which
names documents by it, keeps such rows. Rows that repeat doc_id and text stay or go together; rows that repeat a doc_id
with other texts are judged each by its text. Null and empty texts and those without words fail the quality rules; given
to the other stages, they stay. Ties are broken by doc_id, then a hash of the text. Very long texts are handled whole.
An empty table gives an empty one.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lines, minhash, pieces, quality
from tidemark.session import checkpointed, scratch, settle

VOCABULARY = "piece_bpe_32k.model"
#: Per cent of shingles that near-duplicates share: the least that near-dedup may use.
SIMILAR = 80


def stage(f):
    """A stage: before it begins, executors give back what the one before it needed."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        return f(spark, docs, sf_dir)

    return run_stage


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and a struct of all columns but the text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("row"))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the classifier keep."""
    classifier = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(quality.judge(_carried(docs), classifier).where("kept"), docs)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that resemble earlier ones; those that lose all their words go."""
    rows = lines.dedup_lines(_carried(docs))
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("row", F.col("row").withField("n_chars", F.when(F.col("n_removed") > 0, size).otherwise(F.col("row.n_chars"))))
    return _back(rows.where(~emptied), docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), SIMILAR).where("NOT text_kept")
    gone = gone.select(F.col("doc_id").alias("of"), "mark").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("here"))
    return rows.join(gone, (F.col("id") == F.col("of")) & (F.col("here") == F.col("mark")), "left_anti").select("row.*")


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return _back(decontam.without_leaks(_carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 32 bits) and digests of the ids and of what they decode to."""
    rows = pieces.encode_decode(docs, public_tokenizers.path(VOCABULARY))
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL can express neither the classifier nor the sketches; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents. A stage's tables go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, one) in enumerate(STAGES):
        with scratch(spark):
            docs = checkpointed(one(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
