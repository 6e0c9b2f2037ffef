"""python -m verdance.plans.cli --pre SCENES --post SCENES --outdir DIR: a bitemporal comparison to Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.grid import Grid

from ..sources import scenes, sinks
from .pipelines import CHANGE_BANDS, bitemporal_change, with_classes


#: A path that still begins so has not been filled in.
PLACEHOLDER = "/path/to/"


def validated(spark: SparkSession, inputs: dict[str, str], outdir: str) -> None:
    """Fail if a path is missing from the settings, is a placeholder, or names nothing."""
    for name, value in {**inputs, "outdir": outdir}.items():
        if not value or not value.strip() or value.strip().startswith(PLACEHOLDER):
            raise ValueError(f"{name} is not set: {value!r}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in inputs.items():
        path = jvm.org.apache.hadoop.fs.Path(value)
        if not path.getFileSystem(conf).exists(path):
            raise FileNotFoundError(f"{name} does not exist: {value}")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Vegetation loss, gain and stability between two scenes")
    p.add_argument("--pre", required=True, help="folder with the first scene's archive")
    p.add_argument("--post", required=True, help="folder with the second scene's archive")
    p.add_argument("--outdir", required=True)
    p.add_argument("--pattern", default="*.zip", help=f"archives, or band files of a folder such as {scenes.BAND_FILES}")
    p.add_argument("--rule", default="alone", choices=scenes.RULES, help="how band files are told by their names")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    validated(spark, {"pre": a.pre, "post": a.post}, a.outdir)
    one = lambda path: with_classes(scenes.pixels(spark, path, CHANGE_BANDS, a.pattern, a.rule))
    grids: tuple[Grid, Grid] = tuple(scenes.grid_of(spark, x, "B04", a.pattern, a.rule) for x in (a.pre, a.post))  # the first scene's red band is the reference
    sinks.parquet(bitemporal_change(one(a.pre), one(a.post), grids=grids), f"{a.outdir}/change")


if __name__ == "__main__":
    main()
