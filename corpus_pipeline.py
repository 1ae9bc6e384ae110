"""Training-corpus pipeline over the documents table: toxic documents go, one
document of each near-duplicate group stays, benchmark passages are cut out,
sources are mixed to target weights, and what is left becomes token files.

Cases: a null or empty text is scored as a text without terms, joins the group
of texts without words, holds no passage, has size 0 in the mix and becomes an
end token alone; null ids, languages and sources are values like any other;
repeated rows are near duplicates, of which one stays; an empty table gives an
empty table at every stage and no token files; other columns are carried up to
the last stage, whatever their names and types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querylab.llm import mixing, simhash_dedup, toxicity
from querylab.llm.common import new_dir, table
from querylab.llm.decontaminate import remove_passages
from querylab.llm.queries import tokenizer_path
from querylab.llm.token_files import read_token_files, write_token_files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: three-word shingles, two bits."""
    return simhash_dedup.keep_one(docs, shingle=3, max_distance=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the ten-word windows of the benchmark."""
    return remove_passages(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its budget of words takes them."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token files of what is left; one row a document read back."""
    out = new_dir(spark, "pipeline-tokens")
    write_token_files(docs, out, tokenizer_path())
    return read_token_files(spark, out)


Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]
STAGES: list[Stage] = [
    ("toxicity", drop_toxic), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources), ("token_output", token_output)]

#: The stages are beyond SQL; tests hold the rows of ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and
    read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_dir(spark, f"pipeline-{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
