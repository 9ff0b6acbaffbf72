"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, source mix, token files.

Each stage takes (spark, docs, sf_dir), and its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm._shared import drop, written
from graphloom.llm.decontaminate import keep_clean
from graphloom.llm.mixture import mix_rows
from graphloom.llm.near_copies import near_copies
from graphloom.llm.quality import keep_good
from graphloom.llm.simhash import keep_one
from graphloom.llm.token_files import token_files


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles at least 0.8) stays, that with the smallest id."""
    return keep_one(docs, groups=near_copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights; documents taken twice have two rows."""
    return mix_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files; one row a document that was read back from them."""
    return token_files(docs)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_output)]

#: SQL cannot express the near-duplicate and tokenizer stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables of earlier stages are removed once the next is written; the last stage has read its own when it returns."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, folder = written(stage(spark, docs, sf_dir), name)
        if before:
            drop(spark, before)
        before = folder
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop(spark, before)
    return out
