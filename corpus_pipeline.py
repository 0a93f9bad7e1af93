"""From raw documents to token files: drop what is toxic, keep one of each group of near copies, drop what holds
benchmark passages, mix the sources to their target weights, write token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knigovod.llm.decontaminate import decontaminated
from knigovod.llm.jaccard import one_of_each
from knigovod.llm.mixing import resampled
from knigovod.llm.registered import fold, table, tokenizer_path
from knigovod.llm.shared import staged
from knigovod.llm.tokens import read_tokens, write_tokens
from knigovod.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5."""
    return without_toxic(docs, table(spark, sf_dir, "labels"), fold() != 0)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return resampled(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row for each document in them, read back."""
    return read_tokens(write_tokens(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_files),
]

#: Learning, components of near copies and tokenizing have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
