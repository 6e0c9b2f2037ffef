"""Raster and table views that the queries make from the driver's tables.

Each view is one arithmetic, stated for Spark here and as SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of each band: offset into the vector, and value = max(0, level + gain * element).
BANDS = {
    "b02": (1, 0.08, 0.4), "b03": (2, 0.12, 0.6), "b04": (3, 0.12, 0.5), "b05": (4, 0.20, 0.4), "b08": (5, 0.40, 1.2),
    "b8a": (6, 0.38, 1.2), "b11": (7, 0.15, 0.8), "b12": (8, 0.10, 0.6),
}
#: Further offset of the second date.
LATER = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _element(offset: int) -> F.Column:
    return F.element_at("embedding", ((F.col("x") + offset) % 64 + 1).cast("int")).cast("double")


def grid(spark: SparkSession, sf_dir: str, bands: tuple[str, ...] = tuple(BANDS), later: bool = False) -> DataFrame:
    """y, x, label, scene, date, scl and bands: a pixel for each vector and place."""
    px = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    cells = [F.greatest(F.lit(0.0), F.lit(BANDS[b][1]) + F.lit(BANDS[b][2]) * _element(BANDS[b][0] + LATER * later)).cast("float").alias(b) for b in bands]
    fixed = [F.concat(F.lit("S"), (F.col("y") % 25).cast("string")).alias("scene"), F.date_add(F.lit("2020-01-06").cast("date"), (F.col("y") % 25) * 15).alias("date"), ((F.col("y") * 7 + F.col("x") * 13) % 12).cast("int").alias("scl")]
    return px.select("y", "x", "label", *fixed, *cells)


def grid_sql(bands: tuple[str, ...] = tuple(BANDS), later: bool = False) -> str:
    cells = "".join(f", greatest(0::double, {BANDS[b][1]}::double + {BANDS[b][2]}::double * embedding[(x + {BANDS[b][0] + LATER * later}) % 64 + 1]::double)::float AS {b}" for b in bands)
    return (
        "SELECT y::int AS y, x::int AS x, label, 'S' || (y % 25) AS scene, (DATE '2020-01-06' + ((y % 25) * 15)::int)::date AS date, ((y * 7 + x * 13) % 12)::int AS scl" + cells
        + " FROM (SELECT vec_id AS y, label, embedding, unnest(range(64)) AS x FROM embeddings)"
    )


def both(spark: SparkSession, sf_dir: str, bands: tuple[str, ...]) -> DataFrame:
    """Both dates side by side, by one pass over the vectors."""
    px = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    cells = [F.greatest(F.lit(0.0), F.lit(BANDS[b][1]) + F.lit(BANDS[b][2]) * _element(BANDS[b][0] + LATER * k)).cast("float").alias(f"{d}{b}") for k, d in ((0, "pre_"), (1, "post_")) for b in bands]
    return px.select("y", "x", ((F.col("y") * 7 + F.col("x") * 13) % 12).cast("int").alias("pre_scl"), ((F.col("y") * 5 + F.col("x") * 11) % 12).cast("int").alias("post_scl"), *cells)


def both_sql(bands: tuple[str, ...]) -> str:
    cells = "".join(f", greatest(0::double, {BANDS[b][1]}::double + {BANDS[b][2]}::double * embedding[(x + {BANDS[b][0] + LATER * k}) % 64 + 1]::double)::float AS {d}{b}" for k, d in ((0, "pre_"), (1, "post_")) for b in bands)
    return "SELECT y::int AS y, x::int AS x, ((y * 7 + x * 13) % 12)::int AS pre_scl, ((y * 5 + x * 11) % 12)::int AS post_scl" + cells + " FROM (SELECT vec_id AS y, embedding, unnest(range(64)) AS x FROM embeddings)"


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, y, x, value: a mask in scenes of 8 x 8 pixels."""
    px = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    return px.select((F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("int").alias("scene"), "y", "x", (_element(0) > 0.06).alias("value"))


CHIPS_SQL = "SELECT (y // 8 * 8 + x // 8)::int AS scene, y::int AS y, x::int AS x, embedding[x % 64 + 1]::double > 0.06::double AS value FROM (SELECT vec_id AS y, embedding, unnest(range(64)) AS x FROM embeddings)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (every tenth day), group_code, group_label, a, b: pixel values of many scenes."""
    days = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 10) * 10
    return table(spark, sf_dir, "lineitem").select(
        F.date_add(F.lit("1995-01-01").cast("date"), days.cast("int")).alias("date"), F.concat(F.lit("G"), (F.col("l_partkey") % 8).cast("string")).alias("group_code"),
        F.concat(F.lit("Group "), (F.col("l_partkey") % 8).cast("string")).alias("group_label"), F.col("l_discount").cast("float").alias("a"), F.col("l_tax").cast("float").alias("b"), "l_orderkey", "l_linenumber",
    )


OBS_SQL = """SELECT (DATE '1995-01-01' + (floor((l_shipdate::date - DATE '1995-01-01') / 10)::int * 10))::date AS date,
 'G' || (l_partkey % 8) AS group_code, 'Group ' || (l_partkey % 8) AS group_label, l_discount::float AS a, l_tax::float AS b, l_orderkey, l_linenumber FROM lineitem"""
