"""Renderings of pixels as colour columns; masks as Boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spectral import clamp01, darkness, f32, norm_diff_zero, single

GREY = 180
Colour = dict[str, Column]


def byte(c: Column) -> Column:
    """0..1 as 0..255, rounded half up."""
    return F.floor(clamp01(c) * f32(255) + f32(0.5)).cast("int")


def ndvi_colour(red: str = "b04", nir: str = "b08") -> Colour:
    """Brown to green by NDVI, darker where NDVI is uncertain."""
    v, d = norm_diff_zero(nir, red), darkness(red, nir)
    return {"r": byte(f32(0.9) * clamp01(f32(1) - v) * d), "g": byte(f32(0.8) * clamp01(v) * d), "b": byte(f32(0.1) * d)}


def with_alpha(c: Colour, keep: Column, valid: Column | None = None) -> Colour:
    return c | {"a": F.when(keep if valid is None else keep & valid, 255).otherwise(0)}


def transparent(c: Colour, valid: Column) -> Colour:
    return c | {"a": F.when(valid, 255).otherwise(0)}


def white_where(c: Colour, mask: Column) -> Colour:
    return {k: F.when(mask, 255).otherwise(v) for k, v in c.items()}


def grey_where(c: Colour, mask: Column) -> Colour:
    return {k: F.when(mask, GREY).otherwise(v) for k, v in c.items()}


def grey_overlay(c: Colour, loss: Column, valid: Column | None = None) -> Colour:
    """White outside the valid scene, then grey on loss: loss wins."""
    return grey_where(c if valid is None else white_where(c, ~valid), loss)


def clean_overlay(c: Colour, loss: Column, keep: Column, clear: Column) -> Colour:
    """White where not clear or not kept, then grey on loss."""
    return grey_where(white_where(white_where(c, ~clear), ~keep), loss)


def overlay_then_white(c: Colour, loss: Column, clear: Column) -> Colour:
    """Grey on loss, then white where not clear: clouds win."""
    return white_where(grey_where(c, loss), ~clear)


def red_overlay(mask: Column) -> Colour:
    on = lambda v: F.when(mask, v).otherwise(0)
    return {"r": on(255), "g": F.lit(0), "b": F.lit(0), "a": on(128)}


def blended(bottom: Colour, top: Colour, opacity: float = 1.0) -> Colour:
    """The top over the bottom over white; both have alpha."""
    part = lambda c: single(c.cast("float") / f32(255))
    under, over = part(bottom["a"]), part(top["a"]) * f32(opacity)
    out = {}
    for k in ("r", "g", "b"):
        on_white = part(bottom[k]) * under + f32(1) * (f32(1) - under)
        out[k] = byte(part(top[k]) * over + on_white * (f32(1) - over))
    return out
