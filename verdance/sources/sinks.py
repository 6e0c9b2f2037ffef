"""Sinks: Parquet first; CSV, GeoJSON lines and GeoTIFF for exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import Grid
from . import geotiff


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Columnar output, partitioned by columns if given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def csv(df: DataFrame, path: str, order: list[str] | None = None, by: list[str] | None = None) -> None:
    """CSV with a header; a small summary is one file, sorted."""
    w = (df.orderBy(*order).coalesce(1) if order else df).write.mode("overwrite").option("header", "true")
    (w.partitionBy(*by) if by else w).csv(path)


def text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


WRITTEN = "scene string, uri string, bytes long"


def geotiffs(px: DataFrame, path: str, grid: Grid, bands: dict[str, str], *, valid: str | None = None, nodata: float | None = None, compression: str = "deflate") -> DataFrame:
    """One GeoTIFF for each scene under path; returns scene, uri and size.

    px: scene, y, x and the bands, a NumPy type for each.  Missing pixels are
    nodata, or 0.  valid: a Boolean column that becomes the mask page.  A task
    holds one scene's raster.
    """
    names = list(bands)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        scene = f["scene"].iloc[0]
        kind = np.result_type(*bands.values())
        image = np.full((len(names), grid.height, grid.width), 0 if nodata is None else nodata, kind)
        y, x = f["y"].to_numpy(), f["x"].to_numpy()
        for k, n in enumerate(names):
            v = f[n]
            image[k, y, x] = v.where(v.notna(), 0 if nodata is None else nodata).to_numpy()
        ok = np.zeros((grid.height, grid.width), bool)
        ok[y, x] = f[valid].to_numpy(bool) if valid else True
        data = geotiff.write(geotiff.Raster(image, ok, grid.left, grid.top, grid.dx, grid.dy, grid.crs, nodata), compression, mask=valid is not None)
        where, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        where.create_dir(root, recursive=True)
        uri = f"{root}/{scene}.tif"
        with where.open_output_stream(f"{uri}.tmp", compression=None) as out:
            out.write(data)
        where.move(f"{uri}.tmp", uri)
        return pd.DataFrame({"scene": [scene], "uri": [uri], "bytes": [len(data)]})

    keep = ["scene", "y", "x", *names, *([valid] if valid and valid not in names else [])]
    return px.select(F.col("scene").cast("string").alias("scene"), *keep[1:]).groupBy("scene").applyInPandas(run, WRITTEN)
