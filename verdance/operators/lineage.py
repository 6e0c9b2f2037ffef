"""Cutting of lineage in iterative operators, by tables written to the shared folder.

A table and not checkpoint(): a checkpoint hands the constraints of its plan on,
and those of many rounds take the optimizer longer than the rounds themselves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="verdance-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """The table, written and read again."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/verdance/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
