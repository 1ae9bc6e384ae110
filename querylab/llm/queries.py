"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylab.llm.common import new_dir, table
from querylab.llm.decontaminate import find_passages
from querylab.llm.simhash_dedup import near_duplicates
from querylab.llm import chat, divergence, language_id, line_templates, merkle, mixing, pii, secrets, simhash, spans, toxicity
from querylab.llm.token_files import read_token_files, write_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    return importlib.import_module("public_tokenizers").path(name)


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-ID / binary output over all documents, read back from the files."""
    out = new_dir(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), out, tokenizer_path())
    return read_token_files(spark, out)


@query
def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of recurring templates and repeated long lines."""
    return line_templates.line_counts(table(spark, sf_dir, "documents"))


SQL["op2_line_templates"] = line_templates.SQL


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of all benchmark items in all documents."""
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: three-word shingles, two bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a factorization machine."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes from each."""
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


SQL["op5_mixing"] = mixing.SQL


@query
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of all documents and of their edited texts."""
    found = simhash.edited_likeness(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", simhash.hex_of("fp").alias("fingerprint"),
                        simhash.hex_of("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op7_near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other fingerprints within three bits of those of every fiftieth document."""
    found = simhash.near_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(simhash.hex_of("query").alias("fingerprint"), simhash.hex_of("fp").alias("near_fingerprint"), "distance")


def _span_digest(found: DataFrame, kinds: tuple[str, ...], *more: str) -> DataFrame:
    return found.select(
        "doc_id", *[spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in kinds],
        F.sha2(spans.listed(F.col("base")), 256).alias("base_sha256"), spans.listed(F.col("spans")).alias("spans"), *more)


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it in all documents."""
    return _span_digest(pii.find_pii(table(spark, sf_dir, "documents")), ("email", "ip", "card", "phone"))


@query
def op6_pii_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and terms of any length that reveal it, by smoothed disclosure."""
    found = pii.find_pii(table(spark, sf_dir, "documents"), shortest=1, unseen=pii.UNSEEN)
    return _span_digest(found, ("email", "ip", "card", "phone"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, judged by who owns their values."""
    return _span_digest(secrets.find_secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex"),
                        "n_live", "n_example")


@query
def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in reply order, linked by what they quote, without quotes."""
    return chat.link_quotes(table(spark, sf_dir, "conversations"))


SQL["op10_quotation_linking"] = chat.SQL


@query
def op10_quotation_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, linked by the lines and paragraphs that they quote at any level."""
    return chat.link_quotes(table(spark, sf_dir, "conversations"), deep=True)


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaves, roots and proofs of all documents, with a tampering check."""
    return merkle.manifest(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_sha256().alias("proof_sha256"), "folded_root", "verified")


SQL["op12_merkle_manifest"] = merkle.SQL


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How all sources of each language differ, by pairs and by telling terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op11_source_divergence"] = divergence.SQL


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by a byte convolutional network."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")
