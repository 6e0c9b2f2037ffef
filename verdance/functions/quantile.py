"""Exact quantiles of groups of any size.

A first pass counts the values of each group in buckets, of which there are some
thousands whatever the group holds.  Running counts over the buckets tell which of
them hold the wanted ranks; a second pass ranks the values of just these.  No task
gets all values of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets to a unit of the logarithm, and the magnitude below which they are of equal width.
FINE, SMALL = 256, 1 / 4096


def _bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) / F.lit(SMALL)) * F.lit(FINE)).cast("int")


def quantiles(long: DataFrame, keys: list[str], shares: dict[str, float], value: str = "value") -> DataFrame:
    """keys and a column for each share: the value at that share of the way through the group's order, interpolated.

    NULL values do not count; a group that has no others gives no row.
    """
    values = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    values = values.withColumn("bucket", _bucket(F.col("v")))
    group = Window.partitionBy(*keys)
    counts = values.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "size": F.sum("n").over(group)})
    at = {name: F.lit(share) * (F.col("size") - 1) for name, share in shares.items()}
    ranks = [f(p) for p in at.values() for f in (F.floor, F.ceil)]
    here = lambda rank, n, upto: (rank >= upto - n) & (rank < upto)
    wanted = counts.where(reduce(lambda a, b: a | b, [here(r, F.col("n"), F.col("upto")) for r in ranks]))
    wanted = wanted.select(*[F.col(k).alias(f"its_{k}") for k in keys], F.col("bucket").alias("its_bucket"), (F.col("upto") - F.col("n")).alias("before"), "size")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"its_{k}")) for k in [*keys, "bucket"]])
    each = values.join(wanted, same).groupBy(*keys, "bucket", "v").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("size").alias("size"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "bucket").orderBy("v"))
    each = each.withColumn("upto", upto)
    found = {f"{name}_{side}": F.max(F.when(here(f(p), F.col("n"), F.col("upto")), F.col("v"))) for name, p in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    out = each.groupBy(*keys).agg(F.max("size").alias("size"), *[c.alias(k) for k, c in found.items()])
    lo, hi = lambda k: F.col(f"{k}_lo"), lambda k: F.col(f"{k}_hi")
    between = {k: F.when(lo(k) == hi(k), lo(k)).otherwise((F.ceil(p) - p) * lo(k) + (p - F.floor(p)) * hi(k)) for k, p in at.items()}
    return out.select(*keys, *[c.alias(k) for k, c in between.items()])
