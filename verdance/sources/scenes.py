"""Scenes as pixels: ZIP archives and folders of GeoTIFF bands.

Files are read by Spark (binaryFile), so any store that Spark reaches will do;
bytes are decoded on the executors, one scene a row, without temporary files.  A
pattern that ends in .zip names archives, a scene each; any other names band files,
and those in one folder below the path, or in the path itself, are a scene.  NaN
becomes NULL; other nodata values stay and are told by ``valid``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import date_in
from ..operators.grid import Grid
from . import geotiff

RASTERS = (".tif", ".tiff", ".jp2")
SCL = "SCL"


def _stem(name: str) -> str:
    return re.sub(r"\.[^.]*$", "", re.split(r"[/\\]", name)[-1]).lower()


#: How a member is told to be a band's: by its tag alone between other characters than letters and digits, by
#: its tag anywhere, by a name with <tag>_(Raw).tiff, or by tag and "raw", then the tag as a word, then anywhere.
RULES = ("alone", "anywhere", "raw_only", "raw_then_word")


def picked(names: list[str], tag: str, rule: str = "alone") -> str | None:
    """The member for a band by a rule; "raw" is preferred, then the first."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; one of {', '.join(RULES)}")
    t, rasters = tag.lower(), [n for n in names if n.lower().endswith(RASTERS)]
    base = lambda n: re.split(r"[/\\]", n.lower())[-1]
    if rule == "raw_only":
        return next((n for n in names if f"{t}_(raw).tiff" in n.lower()), None)
    if rule == "raw_then_word":
        tests = (lambda n: t in n.lower() and "raw" in n.lower(), lambda n: re.search(rf"\b{t}\b", n.lower()), lambda n: t in n.lower())
        return next((n for test in tests for n in rasters if test(n)), None)
    fits = [n for n in rasters if (t in base(n) if rule == "anywhere" else re.search(rf"(^|[^a-z0-9]){t}([^a-z0-9]|$)", _stem(n)))]
    return next((n for n in fits if "raw" in n.lower()), fits[0] if fits else None)


def picked_scl(names: list[str]) -> str | None:
    fits = [n for n in names if n.lower().endswith(RASTERS) and ("scene_classification_map" in n.lower() or "scl" in n.lower())]
    return next((n for n in fits if "scene_classification_map" in n.lower()), fits[0] if fits else None)


def files(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """path, content of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


BAND_FILES = "*.{tif,tiff,jp2,TIF,TIFF,JP2}"


def opened(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """scene, names, contents: an archive as it is (names is NULL), or the files of a folder in the order of their names."""
    found = files(spark, path, pattern)
    if pattern.lower().endswith(".zip"):
        return found.select(F.element_at(F.split("path", "/"), -1).alias("scene"), F.lit(None).cast("array<string>").alias("names"), F.array("content").alias("contents"))
    top = re.escape(path.rstrip("/").rsplit("/", 1)[-1])
    inside = F.regexp_extract("path", rf"/{top}/(.*)$", 1)
    scene = F.when(F.contains(inside, F.lit("/")), F.substring_index(inside, "/", 1)).otherwise(path.rstrip("/").rsplit("/", 1)[-1])
    each = found.select(scene.alias("scene"), F.struct(inside.alias("name"), "content").alias("file"))
    return each.groupBy("scene").agg(F.sort_array(F.collect_list("file")).alias("f")).select("scene", F.col("f.name").alias("names"), F.col("f.content").alias("contents"))


class Members:
    """The members of a scene, by name."""

    def __init__(self, names: list[str] | None, contents: list[bytes]):
        self.archive = zipfile.ZipFile(io.BytesIO(contents[0])) if names is None else None
        self.files = {} if names is None else dict(zip(names, contents))
        self.names = list(self.files) if self.archive is None else self.archive.namelist()

    def open(self, name: str) -> BinaryIO:
        return self.archive.open(name) if self.archive is not None else io.BytesIO(self.files[name])

    def read(self, name: str) -> bytes:
        return self.open(name).read()


def _scenes(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Members]]:
    for f in frames:
        for scene, names, contents in zip(f["scene"], f["names"], f["contents"]):
            yield scene, Members(None if names is None else list(names), list(contents))


MEMBERS = "scene string, member string, ord int"


def members(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """The members of each scene in their listed order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for scene, found in _scenes(frames):
            yield pd.DataFrame({"scene": scene, "member": found.names, "ord": range(len(found.names))})

    return opened(spark, path, pattern).mapInPandas(run, MEMBERS)


def _rows(scene: str, bands: dict[str, bytes], members: dict[str, str], need: tuple[str, ...]) -> Iterator[dict]:
    rasters = {t: geotiff.read(bands[t]) for t in need}
    first = rasters[need[0]]
    place = lambda r: (r.bands.shape[1:], r.left, r.top, r.dx, r.dy, r.crs)
    for t, r in rasters.items():
        if place(r) != place(first):
            raise ValueError(f"{scene}: band {t} is not on the grid of {need[0]}")
    scl = geotiff.read(bands[SCL]) if SCL in bands else None
    if scl is not None and scl.bands.shape[1:] != first.bands.shape[1:]:
        raise ValueError(f"{scene}: the classification is not on the bands' grid")
    valid = np.logical_and.reduce([r.valid for r in rasters.values()])
    height, width = first.bands.shape[1:]
    for y in range(height):
        row = {"scene": scene, "member": members[need[0]], "y": y, "valid": valid[y]}
        row |= {t.lower(): r.bands[0, y].astype(np.float32) for t, r in rasters.items()}
        for k, c in enumerate("rgb"):
            row[f"scl_{c}"] = None if scl is None or len(scl.bands) < 3 else scl.bands[k, y].astype(np.int32)
        row["scl"] = None if scl is None or len(scl.bands) > 1 else scl.bands[0, y].astype(np.int32)
        yield row


def image_rows(spark: SparkSession, path: str, bands: tuple[str, ...], pattern: str = "*.zip", rule: str = "alone") -> DataFrame:
    """A row for each line of each scene, with an array for each band."""
    need = tuple(bands)
    schema = "scene string, member string, y int, valid array<boolean>, " + ", ".join(f"{t.lower()} array<float>" for t in need) + ", scl_r array<int>, scl_g array<int>, scl_b array<int>, scl array<int>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for scene, members in _scenes(frames):
            found = {t: picked(members.names, t, rule) for t in need}
            if missing := [t for t, n in found.items() if n is None]:
                raise FileNotFoundError(f"{scene} has no band {', '.join(missing)}")
            if (scl := picked_scl(members.names)) is not None:
                found[SCL] = scl
            held: list[dict] = []
            for row in _rows(scene, {t: members.read(n) for t, n in found.items()}, found, need):
                held.append(row)
                if len(held) == 256:
                    yield pd.DataFrame(held)
                    held = []
            if held:
                yield pd.DataFrame(held)

    return opened(spark, path, pattern).mapInPandas(run, schema)


def pixels(spark: SparkSession, path: str, bands: tuple[str, ...], pattern: str = "*.zip", rule: str = "alone") -> DataFrame:
    """scene, date_name, date_member, y, x, valid, the bands, and scl or scl_r, scl_g, scl_b (NULL if absent).

    A scene's date is in its own name and in its bands' names; they can differ.
    """
    rows = image_rows(spark, path, bands, pattern, rule)
    cells = ["valid", *[t.lower() for t in bands], "scl_r", "scl_g", "scl_b", "scl"]
    none = F.transform("valid", lambda _: F.lit(None).cast("int"))  # a missing array would make the whole line missing
    zipped = [F.coalesce(c, none).alias(c) if c.startswith("scl") else F.col(c) for c in cells]
    wide = rows.select("scene", date_in(F.col("scene")).alias("date_name"), date_in(F.col("member")).alias("date_member"), "y", F.posexplode(F.arrays_zip(*zipped)).alias("x", "cell"))
    value = lambda c: F.when(~F.isnan(F.col(f"cell.{c}")), F.col(f"cell.{c}")) if c.upper() in bands else F.col(f"cell.{c}")
    return wide.select("scene", "date_name", "date_member", "y", "x", *[value(c).alias(c) for c in cells])


GRIDS = "scene string, band string, height int, width int, left double, top double, dx double, dy double, crs string"


def grids(spark: SparkSession, path: str, bands: tuple[str, ...], pattern: str = "*.zip", rule: str = "alone") -> DataFrame:
    """The grid of each band; of a member only its first bytes are unpacked where these hold the header."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for scene, members in _scenes(frames):
            rows = []
            for t in bands:
                if (name := picked(members.names, t, rule)) is not None:
                    r = geotiff.profile_of(members.open(name))
                    rows.append((scene, t, *r.bands.shape[1:], r.left, r.top, r.dx, r.dy, r.crs))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in GRIDS.split(", ")])

    return opened(spark, path, pattern).mapInPandas(run, GRIDS)


def grid_of(spark: SparkSession, path: str, band: str, pattern: str = "*.zip", rule: str = "alone") -> Grid:
    """The grid of a single scene's band: the reference that others are aligned to."""
    found = grids(spark, path, (band,), pattern, rule).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} must hold one scene with {band}")
    r = found[0]
    return Grid(r.height, r.width, r.left, r.top, r.dx, r.dy, r.crs)
