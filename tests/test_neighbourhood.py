import numpy as np
import pytest

from verdance.operators import grid, neighbourhood


def table(spark, m: np.ndarray):
    rows = [(0, int(y), int(x), bool(m[y, x])) for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "scene int, y int, x int, value boolean")


def image(df, shape) -> np.ndarray:
    out = np.zeros(shape, bool)
    for r in df.collect():
        out[r.y, r.x] = r.value
    return out


def labels(m: np.ndarray, diagonal: bool) -> np.ndarray:
    out, n = -np.ones(m.shape, int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (diagonal or 0 in (a, b))]
    for y, x in np.ndindex(m.shape):
        if out[y, x] < 0:
            todo = [(y, x)]
            out[y, x] = n
            while todo:
                p = todo.pop()
                for a, b in steps:
                    q = p[0] + a, p[1] + b
                    if 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and out[q] < 0 and m[q] == m[p]:
                        out[q] = n
                        todo.append(q)
            n += 1
    return out


def sieve(m: np.ndarray, least: int, diagonal: bool) -> np.ndarray:
    of = labels(m, diagonal)
    size = np.bincount(of.ravel())
    near = {i: set() for i in range(len(size))}
    for y, x in np.ndindex(m.shape):
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                q = y + a, x + b
                if (a, b) != (0, 0) and (diagonal or 0 in (a, b)) and 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and of[q] != of[y, x]:
                    near[of[y, x]].add(of[q])
    value = {i: m[of == i][0] for i in near}
    out = m.copy()
    for i in near:
        if size[i] < least and near[i]:
            seen, j = {i}, i
            while size[j] < least:
                j = max(near[j], key=lambda k: (size[k], -k)) if near[j] else -1
                if j < 0 or j in seen:
                    j = -1
                    break
                seen.add(j)
            if j >= 0:
                out[of == i] = value[j]
    return out


@pytest.mark.parametrize("radius", [1, 2])
def test_dilation(spark, radius):
    m = np.random.default_rng(3).random((9, 11)) > 0.93
    want = np.zeros_like(m)
    for y, x in np.argwhere(m):
        want[max(0, y - radius):y + radius + 1, max(0, x - radius):x + radius + 1] = True
    assert (image(neighbourhood.dilated(table(spark, m), radius, ["scene"]), m.shape) == want).all()


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_and_sieve(spark, diagonal):
    m = np.random.default_rng(7).random((14, 16)) > 0.55
    found, _ = neighbourhood.components(table(spark, m), ["scene"], diagonal=diagonal)
    got = neighbourhood.to_pixels(found, ["scene"], "component").toPandas()
    of = labels(m, diagonal)
    pairs = {(of[r.y, r.x], r.component) for r in got.itertuples()}
    assert len(pairs) == of.max() + 1 == got.component.nunique()
    assert (image(neighbourhood.sieved(table(spark, m), 4, ["scene"], diagonal=diagonal), m.shape) == sieve(m, 4, diagonal)).all()


def test_sieve_drops_specks_and_fills_holes(spark):
    m = np.zeros((12, 12), bool)
    m[1:6, 1:6] = True
    m[3, 3] = False
    m[9, 9] = True
    got = image(neighbourhood.sieved(table(spark, m), 4, ["scene"]), m.shape)
    assert got[3, 3] and not got[9, 9] and got.sum() == 25


def test_resampling_onto_the_same_grid_changes_nothing(spark):
    g = grid.Grid(4, 5, 10.0, 50.0, 2.0, -2.0)
    df = spark.createDataFrame([("s", y, x, float(y * 5 + x)) for y in range(4) for x in range(5)], "scene string, y int, x int, v float")
    for out in (grid.nearest(df, g, g, ["scene"], ["v"]), grid.bilinear(df, g, g, ["scene"], ["v"])):
        assert {(r.y, r.x): r.v for r in out.collect()} == {(y, x): y * 5 + x for y in range(4) for x in range(5)}


def test_polygons_last_wins_and_holes(spark):
    square = lambda a, b, c, d: [(a, b, c, b), (c, b, c, d), (c, d, a, d), (a, d, a, b)]
    polygons = spark.createDataFrame([(1, 0, square(0.0, 0.0, 6.0, 6.0) + square(1.0, 1.0, 3.0, 3.0)), (2, 1, square(4.0, 4.0, 8.0, 8.0)), (3, 2, [])], "group_id int, feature int, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    px = spark.createDataFrame([(y, x) for y in range(9) for x in range(9)], "y int, x int")
    got = {(r.y, r.x): r.group_id for r in grid.polygons_to_pixels(polygons, grid.Grid(9, 9, 0.0, 0.0, 1.0, 1.0), px).collect()}
    want = {(y, x): 2 if 4 <= y < 8 and 4 <= x < 8 else 1 for y in range(9) for x in range(9) if (4 <= y < 8 and 4 <= x < 8) or (y < 6 and x < 6 and not (1 <= y < 3 and 1 <= x < 3))}
    assert got == want


def test_utm_of_known_points(spark):
    from pyspark.sql import functions as F

    e, n = grid.utm(F.col("lon"), F.col("lat"), 35)
    r = spark.createDataFrame([(27.0, 0.0), (27.0, 45.0)], "lon double, lat double").select(e.alias("e"), n.alias("n")).collect()
    assert abs(r[0].e - 500_000) < 1e-3 and abs(r[0].n) < 1e-3
    assert abs(r[1].n - 4_982_950.400) < 0.01


def test_bilinear_makes_cells_after_the_join(spark):
    """resample_bilinear, 1 GB: four rows for each target cell were made in one task, joined and grouped."""
    import random

    rng = random.Random(3)
    rows = [(s, y, x, rng.choice([None, rng.random(), float(y)]), rng.random()) for s in ("a", "b") for y in range(9) for x in range(40) if rng.random() > 0.1]
    rows += [("a", 3, 4, 7.0, None), ("c", 0, 0, 1.0, float("inf"))]
    px = spark.createDataFrame(rows, "scene string, y int, x int, v float, u float")
    source = grid.Grid(9, 40, 100.0, 50.0, 2.0, -1.0)
    for target in (grid.Grid(21, 95, 96.3, 51.2, 0.9, -0.45), grid.Grid(9, 40, 100.0, 50.0, 2.0, -1.0), grid.Grid(4, 9, 101.0, 49.5, 8.0, -2.0)):
        out = grid.bilinear(px, source, target, ["scene"], ["v", "u"])
        plain = grid._bilinear_by_points(px, source, target, ["scene"], ["v", "u"])
        got, expect = ({(r.scene, r.y, r.x): (r.v, r.u) for r in f.collect()} for f in (out, plain))
        assert got.keys() == expect.keys() and len(got) == 3 * target.height * target.width
        for k, e in expect.items():
            assert got[k] == pytest.approx(e, rel=1e-6, nan_ok=True) if None not in e else [x is None for x in got[k]] == [x is None for x in e]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Join LeftOuter") > plan.rindex("inline(xs")
