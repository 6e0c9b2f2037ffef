"""Neighbourhoods on the pixel grid: dilation, connected components, sieve.

A mask is a table of (scene..., y, x, value).  Components are found on runs of
equal pixels in a row, which are far fewer than pixels: runs of adjacent rows
that touch are links, and links contract in a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Columns of a run are dealt in tiles of this width, so rows with many runs join in small groups.
TILE = 64


def dilated(mask: DataFrame, radius: int, by: list[str], value: str = "value") -> DataFrame:
    """True within a square of the radius around a true pixel; pixels that are missing stay missing."""
    if radius <= 0:
        return mask
    along = lambda fixed, moving: Window.partitionBy(*by, fixed).orderBy(moving).rangeBetween(-radius, radius)
    across = mask.withColumn(value, F.max(F.col(value).cast("int")).over(along("y", "x")))
    return across.withColumn(value, (F.max(value).over(along("x", "y")) > 0))


def runs(mask: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, y, run, x0, x1, value: stretches of equal adjacent pixels.  run names a stretch within its scene."""
    w = Window.partitionBy(*by, "y").orderBy("x")
    new = ~((F.lag(value).over(w) == F.col(value)) & (F.lag("x").over(w) == F.col("x") - 1))
    edge = F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w)
    out = mask.withColumn("nth", edge).groupBy(*by, "y", "nth").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first(value).alias(value))
    return out.withColumn("run", (F.col("y").cast("long") * (1 << 32) + F.col("x0"))).select(*by, "y", "run", "x0", "x1", value)


def touching(found: DataFrame, by: list[str], value: str = "value", diagonal: bool = True) -> DataFrame:
    """by, a, b, same: pairs of runs that touch, in adjacent rows or side by side; same: of equal value."""
    reach = 1 if diagonal else 0
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(lo / TILE), F.floor(hi / TILE)))
    upper = found.select(*by, (F.col("y") + 1).alias("y"), F.col("run").alias("a"), (F.col("x0") - reach).alias("a0"), (F.col("x1") + reach).alias("a1"), F.col(value).alias("va"))
    upper = upper.withColumn("tile", tiles(F.col("a0"), F.col("a1")))
    lower = found.select(*by, "y", F.col("run").alias("b"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col(value).alias("vb")).withColumn("tile", tiles(F.col("b0"), F.col("b1")))
    rows = upper.join(lower, [*by, "y", "tile"]).where("a0 <= b1 and b0 <= a1").select(*by, "a", "b", (F.col("va") == F.col("vb")).alias("same")).distinct()
    w = Window.partitionBy(*by, "y").orderBy("x0")
    side = found.withColumns({"b": F.lead("run").over(w), "next": F.lead("x0").over(w), "vb": F.lead(value).over(w)})
    side = side.where("next = x1 + 1").select(*by, F.col("run").alias("a"), "b", (F.col(value) == F.col("vb")).alias("same"))
    return rows.unionByName(side)


def contracted(nodes: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """by, node, component: components named by a node; nodes without links are their own.

    Each round a node joins the first of itself and its neighbours in an order
    that a hash makes anew, and links within a joined group go away.  In such an
    order about half of the nodes of even a long chain are first of some
    neighbourhood, so the links shrink geometrically.
    """
    rounds, left = [], cut(links.where("a <> b").select(*by, "a", "b").distinct())
    while not left.isEmpty():
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("node"))  # noqa: E731, B023
        both = left.select(*by, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(*by, F.col("b").alias("node"), F.col("a").alias("other")))
        to = cut(both.groupBy(*by, "node").agg(F.least(place("node"), F.min(place("other")))["node"].alias("to")))
        rounds.append(to)
        a, b = to.toDF(*by, "a", "ca"), to.toDF(*by, "b", "cb")
        left = cut(left.join(a, [*by, "a"]).join(b, [*by, "b"]).where("ca <> cb").select(*by, F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    out = nodes.select(*by, "node", F.col("node").alias("component"))
    for to in rounds:
        out = out.join(to.toDF(*by, "component", "to"), [*by, "component"], "left").select(*by, "node", F.coalesce("to", "component").alias("component"))
    return out


def components(mask: DataFrame, by: list[str], value: str = "value", diagonal: bool = True) -> tuple[DataFrame, DataFrame]:
    """Runs with their component, and the touching pairs of runs.

    A component is named by the first pixel of its smallest run, as y * 2**32 + x.
    """
    found = cut(runs(mask, by, value))
    pairs = cut(touching(found, by, value, diagonal))
    of = contracted(found.withColumnRenamed("run", "node"), pairs.where("same"), by)
    # the name given in a contraction is one of the component's runs; take the smallest
    least = of.groupBy(*by, "component").agg(F.min("node").alias("first"))
    named = of.join(least, [*by, "component"]).select(*by, F.col("node").alias("run"), F.col("first").alias("component"))
    return cut(found.join(named, [*by, "run"])), pairs


def sieved_together(px: DataFrame, masks: dict[str, tuple[Column, int]], cell: list[str] = ["y", "x"]) -> DataFrame:  # noqa: B006
    """The masks of one scene's pixels, each sieved by its own least size, as columns; one pass for all."""
    stacked = px.select(*cell, F.inline(F.array(*[F.struct(F.lit(k).alias("mask"), c.alias("value")) for k, (c, _) in masks.items()])))
    least = F.element_at(F.create_map(*[F.lit(x) for k, (_, n) in masks.items() for x in (k, n)]), F.col("mask"))
    kept = sieved(stacked, least, ["mask"])
    return kept.groupBy(*cell).agg(*[F.bool_or(F.when(F.col("mask") == k, F.col("value"))).alias(k) for k in masks])


def to_pixels(found: DataFrame, by: list[str], *columns: str) -> DataFrame:
    return found.select(*by, "y", F.explode(F.sequence("x0", "x1")).alias("x"), *columns)


def sieved(mask: DataFrame, least: int | Column, by: list[str], value: str = "value", diagonal: bool = True) -> DataFrame:
    """Components of fewer pixels than ``least`` (which may depend on by) take the value of their largest neighbour.

    This drops specks and fills holes.  A neighbour that is itself too small hands
    on to its own largest neighbour; a chain that meets no large enough component
    leaves its members as they are.  Of equally large neighbours the one with the
    smaller name counts.
    """
    found, pairs = components(mask, by, value, diagonal)
    size = cut(found.groupBy(*by, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), F.first(value).alias(value)))
    of = found.select(*by, "run", "component")
    near = pairs.where("not same").join(of.toDF(*by, "a", "ca"), [*by, "a"]).join(of.toDF(*by, "b", "cb"), [*by, "b"]).select(*by, "ca", "cb")
    near = near.unionByName(near.select(*by, F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct()
    rank = F.struct(F.col("n"), -F.col("cb"))
    largest = near.join(size.select(*by, F.col("component").alias("cb"), "n", F.col(value).alias("to_value")), [*by, "cb"]).groupBy(*by, "ca").agg(F.max_by(F.struct("cb", "n", "to_value"), rank).alias("best"))
    small = size.where(F.col("n") < least).join(largest.withColumnRenamed("ca", "component"), [*by, "component"])
    chain = cut(small.select(*by, "component", F.col("best.cb").alias("to"), (F.col("best.n") >= least).alias("done"), F.col("best.to_value").alias("to_value")))
    while True:  # follow chains, twice as far each round
        ahead = chain.select(*by, F.col("component").alias("to"), F.col("to").alias("to2"), F.col("done").alias("done2"), F.col("to_value").alias("value2"))
        on = F.col("done") | F.col("to2").isNull()
        next_ = cut(chain.join(ahead, [*by, "to"], "left").select(*by, "component", F.when(on, F.col("to")).otherwise(F.col("to2")).alias("to"), F.when(on, F.col("done")).otherwise(F.col("done2")).alias("done"), F.when(on, F.col("to_value")).otherwise(F.col("value2")).alias("to_value")))
        more = next_.where("done").count() > chain.where("done").count()
        chain = next_
        if not more:
            break
    new = chain.where("done").select(*by, "component", F.col("to_value").alias("new_value"))
    out = found.join(new, [*by, "component"], "left").withColumn(value, F.coalesce("new_value", value))
    return to_pixels(out, by, value)
