import datetime

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdance.functions import masks, spectral, text
from verdance.operators import scenes, stands


def test_zero_denominators_have_three_answers(spark):
    rows = [(1, 0.0, 0.0), (2, 0.1, -0.1), (3, 1e-7, 1e-7), (4, 0.5, 0.1), (5, None, 0.2)]
    df = spark.createDataFrame(rows, "i int, a float, b float")
    got = {r.i: r for r in df.select("i", spectral.norm_diff("a", "b").alias("n"), spectral.norm_diff_zero("a", "b").alias("z"), spectral.norm_diff_eps("a", "b").alias("e"), spectral.ratio("a", "b").alias("r")).collect()}
    assert got[1].n is None and got[1].z == 0 and got[1].e is None and got[1].r == 999
    assert got[2].n is None and got[2].z == 0
    assert got[3].n == 0 and got[3].e is None
    assert abs(got[4].n - 2 / 3) < 1e-6 and got[4].e == got[4].n
    assert got[5].n is None and got[5].z == 0 and got[5].e is None


def test_arithmetic_is_single_precision(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.random(2000).astype(np.float32) for _ in range(2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "i int, b08 float, b04 float")
    got = df.select("i", spectral.norm_diff("b08", "b04").alias("n"), spectral.ndvi_noise().alias("s")).orderBy("i").toPandas()
    with np.errstate(all="ignore"):
        assert (got.n.to_numpy(np.float32) == (a - b) / (a + b)).all()
        s = np.float32(2) / ((a + b) * (a + b)) * np.sqrt(a * a * np.float32(0.02) * np.float32(0.02) + b * b * np.float32(0.03) * np.float32(0.03))
    assert np.allclose(got.s, s, rtol=1e-6)


def test_thresholds_are_inclusive_in_single_precision(spark):
    df = spark.createDataFrame([(float(np.float32(v)),) for v in (0.35, 0.3499999, 0.64, 1.0)], "v float")
    assert [r[0] for r in df.select(spectral.within(F.col("v"), 0.35, 1.0)).collect()] == [True, False, True, True]


def test_colours_decode_within_the_tolerance(spark):
    rows = [(k, m, t, r * m + t, g * m, b * m) for k, (r, g, b) in masks.SCL_COLOURS.items() for m in (1, 257) for t in (0, 2, 3, 4)]
    df = spark.createDataFrame(rows, "k int, m int, t int, r int, g int, b int")
    for tolerance in (2, 3):
        got = df.select("k", "t", masks.scl_of_colour(F.col("r"), F.col("g"), F.col("b"), F.col("m") == 257, tolerance).alias("c")).collect()
        assert all(r.c == (r.k if r.t <= tolerance else 255) for r in got)


def test_seasons(spark):
    df = spark.createDataFrame([(d,) for d in (1, 30, 31, 360, 361, 365, 366)], "d int")
    got = df.select(text.bin_label(F.col("d")).alias("l"), text.bin_centre(F.col("d")).alias("c")).collect()
    assert [r.l for r in got] == ["001-030", "001-030", "031-060", "331-360", "361-365", "361-365", "361-365"]
    assert [r.c for r in got] == [16, 16, 46, 346, 363, 363, 363]


def test_keys_by_the_first_rule_that_holds(spark):
    cases = [("p1", "a", "P1A", "P1A"), ("p1", "a", "a", "P1A"), ("p1", "a", None, "P1A"), ("p1", "a", "x9", "X9"), (None, "a", "NaN", ""), ("p 1", " none ", "", "P1"), ("", "", "", "")]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, p string, s string, u string")
    got = [r.k for r in df.select("i", text.stand_key(F.col("p"), F.col("s"), F.col("u")).alias("k")).orderBy("i").collect()]
    assert got == [c[3] for c in cases]


def test_dates_and_band_names(spark):
    df = spark.createDataFrame([("x_2019-10-19_no.zip",), ("none",), ("S_2020-13-45.zip",)], "n string")
    assert [r[0] for r in df.select(text.date_in(F.col("n"))).collect()] == [datetime.date(2019, 10, 19), None, None]
    names = spark.createDataFrame([(n,) for n in ("a/T_B04_(Raw).tiff", "t-b04.TIF", "xB04y.tif", "B04")], "n string")
    assert [r[0] for r in names.select(text.tagged(F.col("n"), "B04")).collect()] == [True, True, False, True]


def _scene(**x):
    row = dict(clear_support_px=100, clear_frac=0.9, veg_frac=0.8, snow_frac=0.0, cloud_frac=0.0, shadow_frac=0.0, scl7_frac=0.0, ndvi_med_clear=0.7, ndsi_med_clear=-0.5)
    return row | x


def test_recommendations(spark):
    cases = [
        (_scene(), "keep", "no_major_scene_quality_issue"),
        (_scene(clear_support_px=0, clear_frac=0.0, ndvi_med_clear=None, ndsi_med_clear=None), "blacklist", "too_little_clear_support"),
        (_scene(clear_frac=0.05, cloud_frac=0.85), "blacklist", "too_little_clear_support;cloud_dominated"),
        (_scene(veg_frac=0.0, ndsi_med_clear=0.2), "blacklist", "no_vegetation_and_snow_like_clear_pixels"),
        (_scene(clear_frac=0.19, veg_frac=0.02, shadow_frac=0.35, scl7_frac=0.15, ndsi_med_clear=0.36), "caution", "low_clear_support;low_vegetation_support;high_shadow_fraction;high_unclassified_fraction;positive_ndsi_clear_pixels"),
        (_scene(shadow_frac=0.30), "caution", "high_shadow_fraction"),
        (_scene(clear_frac=0.60), "caution", "low_clear_support"),
    ]
    schema = "i int, clear_support_px long, clear_frac double, veg_frac double, snow_frac double, cloud_frac double, shadow_frac double, scl7_frac double, ndvi_med_clear double, ndsi_med_clear double"
    names = [c.split()[0] for c in schema.split(", ")][1:]
    df = spark.createDataFrame([(i, *[c[0][n] for n in names]) for i, c in enumerate(cases)], schema)
    got = scenes.with_recommendation(df).orderBy("i").collect()
    assert [(r.recommendation, r.recommendation_reason) for r in got] == [c[1:] for c in cases]


def test_stable_stands(spark):
    rows = [("a", "10", "500", "300"), ("b", "10", "501", "0"), ("c", "10", "0", "301"), ("d", "0", "0", "0"), ("e", "x", "0", None), ("f", "10", None, None)]
    df = spark.createDataFrame(rows, "ua string, ha string, total string, y1 string")
    got = stands.losses(df, "total", ["y1"], "ha").where(stands.is_stable())
    assert {r.ua for r in got.collect()} == {"a", "f"}


@given(st.integers(1, 366), st.sampled_from([5, 10, 30, 45]))
def test_bin_arithmetic(doy, width):
    start = (doy - 1) // width * width + 1
    assert start <= doy <= start + width - 1


def test_quantiles_are_those_of_sorted_values(spark):
    import numpy as np

    from verdance.functions.quantile import quantiles

    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0, 1, 500), "b": rng.normal(0, 4000, 301), "c": np.array([2.5]), "d": np.repeat([-1.0, 0.0, 1e-9, 7.0], 25), None: rng.random(8), "e": np.array([])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("e", None)]
    shares = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.9, "q999": 0.999, "q10": 1.0}
    df = spark.createDataFrame(rows, "g string, value double").repartition(4)
    got = {r.g: r for r in quantiles(df, ["g"], shares).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for g, r in got.items():
        assert [r[k] for k in shares] == pytest.approx([np.quantile(groups[g], p) for p in shares.values()], rel=1e-12, abs=1e-15)
