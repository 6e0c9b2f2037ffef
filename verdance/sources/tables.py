"""Attribute and vector sources: GeoJSON, spreadsheets, CSV also within ZIP."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scenes import files

_FEATURES = "crs struct<properties: struct<name: string>>, features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
_RING = "array<array<double>>"


def _edges(rings: Column) -> Column:
    """All sides of rings [[x, y], ...] as array<struct<x1, y1, x2, y2>>."""
    side = lambda ring: F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i)[0].alias("x1"), F.element_at(ring, i)[1].alias("y1"), F.element_at(ring, i + 1)[0].alias("x2"), F.element_at(ring, i + 1)[1].alias("y2")))
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), side))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature (in file order), crs, properties (a map) and edges of polygons; empty for no geometry."""
    one = spark.read.schema(_FEATURES).option("multiLine", "true").json(path)
    f = one.select(F.col("crs.properties.name").alias("crs"), F.posexplode("features").alias("feature", "f"))
    c, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    rings = F.when(kind == "Polygon", F.from_json(c, f"array<{_RING}>")).when(kind == "MultiPolygon", F.flatten(F.from_json(c, f"array<array<{_RING}>>")))
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    return f.select("feature", "crs", F.col("f.properties").alias("properties"), F.coalesce(_edges(rings), none).alias("edges"))


def require_crs(features: DataFrame) -> None:
    if features.where(F.col("crs").isNull()).head(1):
        raise ValueError("the layer names no coordinate system")


def geojson_lines(df: DataFrame, properties: list[str], geometry: str = "geometry") -> DataFrame:
    """value: a feature as JSON in each row, for a text writer; geometry: a JSON string."""
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), F.coalesce(F.col(geometry), F.lit("null")), F.lit("}")).alias("value"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> dict[str, list[list[str | None]]]:
    """The cells of each sheet of a workbook as text."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
    target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
        name = target[s.get(_REL)]
        rows = []
        for r in ElementTree.fromstring(z.read(name.lstrip("/") if name.startswith("/") else f"xl/{name}")).iter(f"{{{_NS['m']}}}row"):
            cells: list[str | None] = []
            for k, c in enumerate(r):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [None] * (at + 1 - len(cells))
                v = c.find("m:v", _NS)
                if c.get("t") == "s" and v is not None:
                    cells[at] = shared[int(v.text)]
                elif c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                else:
                    cells[at] = v.text if v is not None else None
            rows.append(cells)
        out[s.get("name")] = rows
    return out


SHEETS = "sheet string, sheet_ord int, nth int, cells map<string, string>"


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """sheet, sheet_ord, nth and cells (a map by the header) of every row of a workbook."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                for k, (name, rows) in enumerate(sheets(content).items()):
                    head = rows[0] if rows else []
                    body = [{h: (r[i] if i < len(r) else None) for i, h in enumerate(head) if h} for r in rows[1:]]
                    yield pd.DataFrame({"sheet": name, "sheet_ord": k, "nth": range(len(body)), "cells": body})

    folder, _, name = path.rpartition("/")
    return files(spark, folder, name).mapInPandas(run, SHEETS)


def resolved_sheet(cells: DataFrame, required: list[str], preferred: str | None = None) -> str:
    """The preferred sheet if there is one, else the first that has all required columns."""
    first = cells.where("nth = 0").select("sheet", "sheet_ord", F.map_keys("cells").alias("columns"))
    rows = sorted(first.collect(), key=lambda r: r["sheet_ord"])  # a row for each sheet
    if preferred in [r["sheet"] for r in rows]:
        return preferred
    for r in rows:
        if set(required) <= set(r["columns"]):
            return r["sheet"]
    raise ValueError(f"no sheet has the columns {required}; sheets: {[r['sheet'] for r in rows]}")


def sheet(cells: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """nth and the columns, as text, of one sheet."""
    return cells.where(F.col("sheet") == name).select("nth", *[F.element_at("cells", c).alias(c) for c in columns])


def csv(spark: SparkSession, path: str, schema: str, member: str | None = None) -> DataFrame:
    """A CSV file with a header, or a member of a ZIP archive."""
    if member is None:
        return spark.read.schema(schema).option("header", "true").csv(path)
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                text = zipfile.ZipFile(io.BytesIO(content)).read(member)
                for part in pd.read_csv(io.BytesIO(text), dtype=str, keep_default_na=False, chunksize=50_000):
                    yield part[names].replace("", None)

    folder, _, name = path.rpartition("/")
    raw = files(spark, folder, name).mapInPandas(run, ", ".join(f"`{n}` string" for n in names))
    kinds = spark.createDataFrame([], schema).dtypes
    return raw.select(*[F.col(n).cast(t).alias(n) for n, t in kinds])
