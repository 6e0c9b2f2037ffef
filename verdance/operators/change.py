"""Change between two dates as set algebra on pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import sure


def paired(pre: DataFrame, post: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of both dates side by side: columns pre_<c> and post_<c>.

    With both tables bucketed or partitioned by the keys the join moves nothing.
    """
    a = pre.select(*keys, *[F.col(c).alias(f"pre_{c}") for c in pre.columns if c not in keys])
    b = post.select(*keys, *[F.col(c).alias(f"post_{c}") for c in post.columns if c not in keys])
    return a.join(b, keys)


def change(pre: Column, post: Column, valid: Column) -> dict[str, Column]:
    """loss, gain and stable of what is kept on two dates, where they can be compared."""
    pre, post, valid = sure(pre), sure(post), sure(valid)
    return {"loss": pre & ~post & valid, "gain": ~pre & post & valid, "stable": pre & post & valid}


def lost(pre: DataFrame, post: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of kept pixels that the second date does not keep (EXCEPT)."""
    return pre.select(*keys).exceptAll(post.select(*keys)).distinct()


def gained(pre: DataFrame, post: DataFrame, keys: list[str]) -> DataFrame:
    return lost(post, pre, keys)


def stable(pre: DataFrame, post: DataFrame, keys: list[str]) -> DataFrame:
    return pre.select(*keys).intersect(post.select(*keys))


def encoded(mask: Column) -> Column:
    """0 or 255."""
    return F.when(mask, 255).otherwise(0)


def holes(mask: Column) -> Column:
    """255 where a mask is not."""
    return 255 - encoded(mask)


def one_or_nodata(mask: Column) -> Column:
    """1, and 255 elsewhere."""
    return F.when(mask, 1).otherwise(255)


def in_domain(mask: Column, domain: Column) -> Column:
    """1 or 0 in the domain, 255 outside."""
    return F.when(domain, mask.cast("int")).otherwise(255)


def counts(masks: dict[str, Column]) -> list[Column]:
    """Number of pixels in each mask."""
    return [F.count_if(m).alias(f"n_{k}") for k, m in masks.items()]


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part, whole)


def enough(px: DataFrame, valid: str, least: int, by: list[str]) -> DataFrame:
    """by, n_valid, enough: whether as many pixels are valid as a comparison needs."""
    return px.groupBy(*by).agg(F.count_if(valid).alias("n_valid")).withColumn("enough", F.col("n_valid") >= least)
