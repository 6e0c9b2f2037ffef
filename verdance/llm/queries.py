"""The contract queries: thin views of the operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats, suffix_index

    found = suffix_index.deduplicated(base.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", repeats.count_removed().alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ctw

    found = ctw.scored(base.table(spark, sf_dir, "documents"), depth=ctw.QUERY_DEPTH)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats, suffix_tree

    found = suffix_tree.deduplicated(base.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", repeats.count_removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    found = quality.judged(base.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_records

    manifest = token_records.write(base.table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), base.scratch(spark, "shards"))
    return token_records.read(manifest)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    found = packing.packed(base.table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan as s

    found = s.scan(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    given = F.filter("spans", lambda x: x["kind"] < len(s.BASE_RULES))
    counts = [s.count(i).alias(f"n_{r.kind}") for i, r in enumerate(s.BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(s.listed(given), 256).alias("base_sha256"), s.listed(F.col("spans")).alias("spans"))


def op8_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    manifest = warc.write(base.table(spark, sf_dir, "pages"), base.scratch(spark, "warc"))
    return warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.components(base.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.matches(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_rules, op3_lm_score, op4_suffix_tree_dedup, op5_token_records, op6_best_fit_packing, op7_secret_scan, op8_warc_writer, op9_simhash, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.all_sql()
