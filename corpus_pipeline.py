"""The corpus pipeline: STAGES in order, each one's result written to the shared folder and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of documents; the last returns the token ids. Other columns of a stage's input are left out.
What a stage makes of nulls, empty texts and repeated rows is in its operator's docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, line_dedup, minhash, pieces
from plumbline.llm.common import SPACE, Scratch, documents, only_for
from plumbline.llm.quality import passing
from plumbline.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return passing(docs.select(*COLUMNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; so do documents of which no word is left. n_chars follows the text."""
    out = line_dedup.dedup(docs.select(*COLUMNS))
    left = (F.col("n_deleted") == 0) | (F.length(F.btrim("text", F.lit(SPACE))) > 0)
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least id; of rows with one id, the first. Rows without a word all stay."""
    return minhash.representatives(docs.select(*COLUMNS), percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, n_repaired and round_trip."""
    return pieces.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", token_ids),
]
#: Near-duplicate components and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with only_for():
            docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
