"""A corpus pipeline: five stages, each by one operator of ``verdance.llm``.

Every stage works on all that its predecessor kept, written as Parquet to the
shared folder and read again, so that a lost executor costs no more than tasks
of one stage.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import base, decontam, packing, quality, secret_scan, similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    verdict = quality.judged(docs).where("kept").select(*[F.col(c).alias(f"its_{c}") for c in ("doc_id", "text_key", "lang", "source")]).distinct()
    rows = docs.select(base.whole_row(docs), "doc_id", base.text_key().alias("text_key"), "lang", "source")
    same = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in ("doc_id", "text_key", "lang", "source")]
    return rows.join(verdict, (same[0] & same[1]) & (same[2] & same[3]), "left_semi").select(*[c for _, c in base.columns_of(docs)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (SimHash, or five-word Jaccard of 0.8) the row with the smallest doc_id (null last), then text_key; of exact repeats one."""
    # the join and the grouping share their keys, so that rows are moved once
    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_key"]
    found = similar.representatives(docs).select(*key)
    rows = docs.select(base.whole_row(docs), "doc_id", base.text_key().alias("text_key")).select("__row", *key)
    kept = rows.join(found, ["id", "no_id", "text_key"], "left_semi")
    return kept.groupBy("id", "no_id", "text_key").agg(F.first("__row").alias("__row")).select(*[c for _, c in base.columns_of(docs)])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.clean(docs, base.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted again."""
    out = secret_scan.masked(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences with their places in windows of 2048."""
    import public_tokenizers

    found = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: Fingerprints and tokenizers are beyond SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over ``documents``."""
    docs, before = base.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = base.scratch(spark, name)
        with base.scope(spark):  # the stage's own tables go once its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            base.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
