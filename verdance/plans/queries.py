"""Every operator of the engine as a query over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import masks, spectral, text
from ..functions.spectral import f32
from ..operators import change, envelope, grid, neighbourhood, render, scenes, stands, zonal
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def nd(a: str, b: str) -> str:
    return f"(({a} - {b}) / nullif({a} + {b}, 0::float))::float"


def nd0(a: str, b: str) -> str:
    return f"coalesce({nd(a, b)}, 0::float)"


def rat(a: str, b: str) -> str:
    return f"coalesce(({a} / nullif({b}, 0::float))::float, 999::float)"


C01 = "greatest(0::float, least(1::float, {}))".format
NOISE = "coalesce((2::float / nullif((b08 + b04) * (b08 + b04), 0::float))::float * sqrt(b08 * b08 * 0.02::float * 0.02::float + b04 * b04 * 0.03::float * 0.03::float)::float, 0::float)"
DARK = C01(f"1::float - 2::float * {NOISE}")
WATER = "((b02 - b04) > 0.034::float AND b8a < b04 AND b02 < 0.20::float)"
SNOW = f"(b03 > 0.20::float AND b11 < 0.15::float AND {rat('b04', 'b11')} > 4::float)"
VIS = "((b02 + b03 + b04) / 3::float)::float"
BRIGHT = f"((b03 > 0.175::float AND {nd0('b03', 'b04')} > 0::float) OR b03 > 0.39::float)"
CLOUDY = f"({VIS} > 0.12::float AND b04 > 0.06::float AND {nd0('b03', 'b11')} > -0.24::float AND {nd0('b08', 'b04')} < 0.42::float AND {rat('b02', 'b11')} > 0.70::float AND {rat('b8a', 'b11')} > 0.90::float AND {rat('b04', 'b11')} < 6::float AND NOT {WATER})"
CLOUD_OK = f"(NOT (NOT {SNOW} AND ({BRIGHT} OR {CLOUDY})))"
SHADOW_OK = f"(NOT (NOT {WATER} AND NOT {SNOW} AND CASE WHEN b08 + b04 > 0::float THEN {DARK} ELSE 1::float END < 0.4::float AND b08 + b04 < 0.20::float AND b02 < 0.15::float AND b03 < 0.13::float AND b04 < 0.13::float AND b8a < 0.12::float AND b11 < 0.08::float AND b12 < 0.06::float AND {VIS} < 0.12::float))"
BYTE = "floor({} * 255::float + 0.5::float)::int".format
R = BYTE(C01(f"0.9::float * {C01('1::float - ' + nd0('b08', 'b04'))} * {DARK}"))
G = BYTE(C01(f"0.8::float * {C01(nd0('b08', 'b04'))} * {DARK}"))
B = BYTE(C01(f"0.1::float * {DARK}"))
SPECTRAL = ("b02", "b03", "b04", "b08", "b8a", "b11", "b12")


# --- change of two dates ---------------------------------------------------------

def _kept(p: str) -> F.Column:
    return spectral.within(spectral.norm_diff_zero(f"{p}b08", f"{p}b04"), 0.35, 1.0)


def _kept_sql(p: str) -> str:
    return f"({nd0(p + 'b08', p + 'b04')} BETWEEN 0.35::float AND 1::float)"


@query(f"""WITH p AS ({views.both_sql(('b04', 'b08'))}), k AS (SELECT {_kept_sql('pre_')} AS a, {_kept_sql('post_')} AS b FROM p)
SELECT count(*) FILTER (a AND NOT b) AS n_loss, count(*) FILTER (NOT a AND b) AS n_gain, count(*) FILTER (a AND b) AS n_stable, count(*) AS n_pixels FROM k""")
def ndvi_keep_counts(spark: SparkSession, d: str) -> DataFrame:
    pre, post = views.grid(spark, d, ("b04", "b08")), views.grid(spark, d, ("b04", "b08"), later=True)
    px = change.paired(pre.select("y", "x", "b04", "b08"), post.select("y", "x", "b04", "b08"), ["y", "x"])
    return px.agg(*change.counts(change.change(_kept("pre_"), _kept("post_"), F.lit(True))), F.count(F.lit(1)).alias("n_pixels"))


def _keys_of(kept_a: str, kept_b: str) -> str:
    return f"SELECT y, x FROM ({views.both_sql(('b04', 'b08'))}) WHERE {kept_a} AND {kept_b}"


def _kept_pixels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    keep = spectral.within(spectral.norm_diff_zero("b08", "b04"), 0.35, 1.0)
    return views.grid(spark, d, ("b04", "b08")).where(keep), views.grid(spark, d, ("b04", "b08"), later=True).where(keep)


@query(_keys_of(_kept_sql("pre_"), f"NOT {_kept_sql('post_')}"))
def loss_pixels(spark: SparkSession, d: str) -> DataFrame:
    return change.lost(*_kept_pixels(spark, d), ["y", "x"])


@query(_keys_of(f"NOT {_kept_sql('pre_')}", _kept_sql("post_")))
def gain_pixels(spark: SparkSession, d: str) -> DataFrame:
    return change.gained(*_kept_pixels(spark, d), ["y", "x"])


@query(_keys_of(_kept_sql("pre_"), _kept_sql("post_")))
def stable_pixels(spark: SparkSession, d: str) -> DataFrame:
    return change.stable(*_kept_pixels(spark, d), ["y", "x"])


_CLEAR = "coalesce({0} NOT IN (0, 1, 2, 3, 8, 9, 10, 11) AND {0} <> 255, false)".format


@query(f"""WITH p AS ({views.both_sql(('b04', 'b08'))}), k AS (SELECT y, x, {_kept_sql('pre_')} AND {_CLEAR('pre_scl')} AS a, {_kept_sql('post_')} AND {_CLEAR('post_scl')} AS b, {_CLEAR('pre_scl')} AND {_CLEAR('post_scl')} AS v FROM p)
SELECT y, x, (a AND NOT b AND v) AS loss, (NOT a AND b AND v) AS gain, (a AND b AND v) AS stable, CASE WHEN a THEN 0 ELSE 255 END AS holes_pre, CASE WHEN b THEN 0 ELSE 255 END AS holes_post, v AS comparison_valid FROM k""")
def change_masked(spark: SparkSession, d: str) -> DataFrame:
    px = views.both(spark, d, ("b04", "b08"))
    clear = {p: masks.scl_clear(F.col(f"{p}scl"), F.lit(True)) for p in ("pre_", "post_")}
    a, b, v = _kept("pre_") & clear["pre_"], _kept("post_") & clear["post_"], clear["pre_"] & clear["post_"]
    return px.select("y", "x", *[c.alias(k) for k, c in change.change(a, b, v).items()], change.holes(a).alias("holes_pre"), change.holes(b).alias("holes_post"), v.alias("comparison_valid"))


# --- spectral expressions ----------------------------------------------------------

@query(f"""WITH p AS (SELECT scene, y, x, (b08 * (CASE WHEN y % 2 = 0 THEN 10000 ELSE 1 END)::float)::float AS b08, b04 FROM ({views.grid_sql(('b04', 'b08'))})),
t AS (SELECT scene, quantile_cont(b08::double, 0.999) AS t8, quantile_cont(b04::double, 0.999) AS t4 FROM p GROUP BY scene)
SELECT p.scene, y, x, CASE WHEN t8 > 1.5 THEN (b08 / 10000::float)::float ELSE b08 END AS b08, CASE WHEN t4 > 1.5 THEN (b04 / 10000::float)::float ELSE b04 END AS b04 FROM p JOIN t ON p.scene = t.scene""")
def dn_autoscale(spark: SparkSession, d: str) -> DataFrame:
    px = views.grid(spark, d, ("b04", "b08")).select("scene", "y", "x", (F.col("b08") * F.when(F.col("y") % 2 == 0, 10_000).otherwise(1).cast("float")).cast("float").alias("b08"), "b04")
    return spectral.autoscaled(px, ["b08", "b04"], ["scene"]).select("scene", "y", "x", "b08", "b04")


def _obs_query(sql: str, expression: Callable[[], F.Column]) -> Callable:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return views.observations(spark, d).select("l_orderkey", "l_linenumber", "a", "b", expression().alias("v"))

    return f, f"SELECT l_orderkey, l_linenumber, a, b, {sql} AS v FROM ({views.OBS_SQL})"


for _name, _sql, _f in (
    ("norm_diff_null", nd("a", "b"), lambda: spectral.norm_diff("a", "b")),
    ("norm_diff_zero", nd0("a", "b"), lambda: spectral.norm_diff_zero("a", "b")),
    ("norm_diff_eps", f"CASE WHEN abs(a + b) > 1e-6::float THEN {nd('a', 'b')} END", lambda: spectral.norm_diff_eps("a", "b")),
    ("ratio_fallback", rat("a", "b"), lambda: spectral.ratio("a", "b")),
    ("clamp_01", C01("(a * 20::float)::float"), lambda: spectral.clamp01(F.col("a") * f32(20))),
):
    QUERIES[_name], SQL[_name] = _obs_query(_sql, _f)


@query(f"""WITH p AS ({views.grid_sql()}) SELECT y, x, i AS "index", v AS value FROM (
SELECT y, x, 'NDVI' AS i, {nd('b08', 'b04')} AS v FROM p UNION ALL SELECT y, x, 'NDMI', {nd('b08', 'b11')} FROM p UNION ALL SELECT y, x, 'NBR', {nd('b08', 'b12')} FROM p
UNION ALL SELECT y, x, 'NDRE', {nd('b8a', 'b05')} FROM p UNION ALL SELECT y, x, 'NDSI', {nd('b03', 'b11')} FROM p UNION ALL SELECT y, x, 'NDGR', {nd('b03', 'b04')} FROM p)""")
def index_suite_long(spark: SparkSession, d: str) -> DataFrame:
    return spectral.long_indices(views.grid(spark, d), ["y", "x"], ("NDVI", "NDMI", "NBR", "NDRE", "NDSI", "NDGR"))


@query(f"""SELECT y, x, {nd('post_b08', 'post_b12')} - {nd('pre_b08', 'pre_b12')} AS dnbr FROM ({views.both_sql(('b08', 'b12'))})""")
def dnbr(spark: SparkSession, d: str) -> DataFrame:
    return views.both(spark, d, ("b08", "b12")).select("y", "x", (spectral.norm_diff("post_b08", "post_b12") - spectral.norm_diff("pre_b08", "pre_b12")).alias("dnbr"))


@query(f"SELECT y, x, round({NOISE}::double, 6) AS noise, round({DARK}::double, 6) AS darkness, {VIS} AS vis FROM ({views.grid_sql(('b02', 'b03', 'b04', 'b08'))})")
def signdvi_darkness(spark: SparkSession, d: str) -> DataFrame:
    r6 = lambda c: F.round(c.cast("double"), 6)
    return views.grid(spark, d, ("b02", "b03", "b04", "b08")).select("y", "x", r6(spectral.ndvi_noise()).alias("noise"), r6(spectral.darkness()).alias("darkness"), spectral.visible().alias("vis"))


@query(f"SELECT y, x, {R} AS r, {G} AS g, {B} AS b FROM ({views.grid_sql(('b04', 'b08'))})")
def signdvi_rgb(spark: SparkSession, d: str) -> DataFrame:
    return views.grid(spark, d, ("b04", "b08")).select("y", "x", *[c.alias(k) for k, c in render.ndvi_colour().items()])


# --- masks ---------------------------------------------------------------------------

@query(f"SELECT y, x, {WATER} AS water, {SNOW} AS snow, {BRIGHT} AS bright, {CLOUDY} AS cloudy, {CLOUD_OK} AS cloud_valid FROM ({views.grid_sql(SPECTRAL)})")
def cloud_valid(spark: SparkSession, d: str) -> DataFrame:
    return views.grid(spark, d, SPECTRAL).select("y", "x", masks.water().alias("water"), masks.snow().alias("snow"), masks.bright_cloud().alias("bright"), masks.spectral_cloud().alias("cloudy"), masks.cloud_valid(masks.data_mask(list(SPECTRAL))).alias("cloud_valid"))


@query(f"SELECT y, x, {SHADOW_OK} AS shadow_valid, {CLOUD_OK} AND {SHADOW_OK} AS clear FROM ({views.grid_sql(SPECTRAL)})")
def shadow_valid(spark: SparkSession, d: str) -> DataFrame:
    data = masks.data_mask(list(SPECTRAL))
    return views.grid(spark, d, SPECTRAL).select("y", "x", masks.shadow_valid(data).alias("shadow_valid"), masks.spectral_clear(data).alias("clear"))


def _palette_sql() -> str:
    rows = ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in masks.SCL_COLOURS.items())
    return f"(VALUES {rows}) AS c(id, cr, cg, cb)"


@query(f"""WITH p AS (SELECT y, x, scene, scl, y % 5 - 2 AS e, CASE WHEN y % 25 % 2 = 1 THEN 257 ELSE 1 END AS m FROM ({views.grid_sql(())})),
r AS (SELECT y, x, scene, e, m, coalesce(cr, 7) * m + e AS r, coalesce(cg, 7) * m AS g, coalesce(cb, 7) * m AS b FROM p LEFT JOIN {_palette_sql()} ON c.id = scl AND scl <> 2),
t AS (SELECT scene, max(greatest(r, g, b)) > 255.5 AS deep FROM r GROUP BY scene)
SELECT y, x, coalesce((SELECT max(id) FROM {_palette_sql()} WHERE abs(r - cr * CASE WHEN deep THEN 257 ELSE 1 END) <= 1 AND abs(g - cg * CASE WHEN deep THEN 257 ELSE 1 END) <= 1 AND abs(b - cb * CASE WHEN deep THEN 257 ELSE 1 END) <= 1), 255)::int AS scl FROM r JOIN t ON r.scene = t.scene""")
def scl_decode_palette(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, c in masks.SCL_COLOURS.items() if k != 2 for v in (k, c[i])]), F.col("scl")), F.lit(7)) * F.col("m")
    px = views.grid(spark, d, ()).withColumn("m", F.when(F.col("y") % 25 % 2 == 1, 257).otherwise(1))
    px = px.select("y", "x", "scene", (pick(0) + F.col("y") % 5 - 2).alias("r"), pick(1).alias("g"), pick(2).alias("b"))
    deep = px.groupBy("scene").agg((F.max(F.greatest("r", "g", "b")) > 255.5).alias("deep"))
    return px.join(deep, "scene").select("y", "x", masks.scl_of_colour(F.col("r"), F.col("g"), F.col("b"), F.col("deep"), tolerance=1).alias("scl"))


@query(f"SELECT y, x, scene, CASE WHEN y % 25 % 3 < 2 THEN scl END AS scl FROM ({views.grid_sql(())})")
def scene_classes(spark: SparkSession, d: str) -> DataFrame:
    """Of three scenes one has classes, one a rendering of them and one neither."""
    from .pipelines import with_classes

    kind = F.col("y") % 25 % 3
    colour = lambda i: F.when(kind == 1, F.element_at(F.create_map(*[F.lit(v) for k, c in masks.SCL_COLOURS.items() for v in (k, c[i])]), F.col("scl")))
    px = views.grid(spark, d, ()).select("y", "x", "scene", *[colour(i).alias(f"scl_{c}") for i, c in enumerate("rgb")], F.when(kind == 0, F.col("scl")).alias("scl"))
    return with_classes(px)


@query(f"SELECT scene, count(*) FILTER (b08 > 0.5::float) AS n_valid, count(*) FILTER (b08 > 0.5::float) >= 100 AS enough FROM ({views.grid_sql(('b08',))}) GROUP BY scene")
def enough_valid(spark: SparkSession, d: str) -> DataFrame:
    return change.enough(views.grid(spark, d, ("b08",)).withColumn("valid", F.col("b08") > f32(0.5)), "valid", 100, ["scene"])


@query(f"SELECT scene, y, x, b04, CASE WHEN (y + x) % 3 <> 0 THEN b08 END AS b08, b12 FROM ({views.grid_sql(('b04', 'b08', 'b12'))})")
def stacked_bands(spark: SparkSession, d: str) -> DataFrame:
    bands = ("b04", "b08", "b12")
    long = views.grid(spark, d, bands).select("scene", "y", "x", F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("value")) for b in bands])))
    return scenes.stacked(long.where("band <> 'b08' or (y + x) % 3 <> 0"), ["scene", "y", "x"], bands)


@query(f"SELECT y, x, {_CLEAR('scl')} AS clear, scl IN (0, 1, 3, 8, 9, 10, 11) AS invalid_core, scl IN (3, 8, 9, 10, 11) AS cloud_core, scl IN (3, 8, 9, 10) AS cleanup FROM ({views.grid_sql(())})")
def scl_clear_si(spark: SparkSession, d: str) -> DataFrame:
    scl = F.col("scl")
    return views.grid(spark, d, ()).select("y", "x", masks.scl_clear(scl, F.lit(True)).alias("clear"), masks.scl_invalid_core(scl).alias("invalid_core"), masks.scl_cloud_core(scl).alias("cloud_core"), masks.cleanup_mask(scl).alias("cleanup"))


def edge_clear(px: DataFrame, by: list[str], edge: int = 3, grow: int = 2) -> DataFrame:
    """Adds invalid and clear: classes, ambiguous pixels near cloud, and what is around them."""
    near = neighbourhood.dilated(px.withColumn("near", masks.scl_cloud_core(F.col("scl"))), edge, by, "near")
    bad = near.withColumn("invalid", masks.scl_invalid_core(F.col("scl")) | (F.col("scl").isin(5, 7) & F.col("near")))
    wide = neighbourhood.dilated(bad, grow, by, "invalid")
    return wide.withColumns({"invalid": F.col("invalid") & F.col("data"), "clear": F.col("data") & ~F.col("invalid")}).drop("near")


_SPARSE = "CASE WHEN v > 0.25 THEN 8 WHEN v > 0.2 THEN 7 WHEN v < -0.25 THEN 5 ELSE 4 END"


@query(f"""WITH p AS (SELECT vec_id::int AS y, x::int AS x, embedding[x + 1]::double AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS x FROM embeddings)),
s AS (SELECT y, x, {_SPARSE} AS scl FROM p),
b AS (SELECT s.*, scl = 8 OR (scl IN (5, 7) AND EXISTS (SELECT 1 FROM s q WHERE q.scl = 8 AND q.y BETWEEN s.y - 3 AND s.y + 3 AND q.x BETWEEN s.x - 3 AND s.x + 3)) AS bad FROM s),
i AS (SELECT y, x, EXISTS (SELECT 1 FROM b q WHERE q.bad AND q.y BETWEEN b.y - 2 AND b.y + 2 AND q.x BETWEEN b.x - 2 AND b.x + 2) AS invalid FROM b)
SELECT y, x, invalid, NOT invalid AS clear FROM i""")
def scl_clear_edge(spark: SparkSession, d: str) -> DataFrame:
    px = views.table(spark, d, "embeddings").select(F.lit(0).alias("scene"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))
    px = px.select("scene", "y", "x", F.when(F.col("v") > 0.25, 8).when(F.col("v") > 0.2, 7).when(F.col("v") < -0.25, 5).otherwise(4).alias("scl"), F.lit(True).alias("data"))
    return edge_clear(px, ["scene"]).select("y", "x", "invalid", "clear")


@query(f"""SELECT y, x, CASE WHEN y % 25 % 3 = 0 THEN {CLOUD_OK} AND {SHADOW_OK} ELSE {_CLEAR('scl')} END AS clear FROM ({views.grid_sql(SPECTRAL)})""")
def clear_source_choice(spark: SparkSession, d: str) -> DataFrame:
    px = views.grid(spark, d, SPECTRAL).withColumn("scl", F.when(F.col("y") % 25 % 3 != 0, F.col("scl")))
    by_class = F.when(F.col("scl").isNotNull(), masks.scl_clear(F.col("scl"), F.lit(True)))
    return px.select("y", "x", F.coalesce(by_class, masks.spectral_clear(masks.data_mask(list(SPECTRAL)))).alias("clear"))


_EPS = lambda a, b: f"CASE WHEN abs({a} + {b}) > 1e-6::float THEN {nd(a, b)} END"


@query(f"""WITH p AS ({views.both_sql(('b04', 'b08', 'b12'))}), i AS (SELECT y, x, pre_scl, post_scl, {_EPS('pre_b08', 'pre_b04')} AS va, {_EPS('post_b08', 'post_b04')} AS vs, {_EPS('pre_b08', 'pre_b12')} AS ba, {_EPS('post_b08', 'post_b12')} AS bs FROM p),
m AS (SELECT y, x, pre_scl, post_scl, va IS NOT NULL AND ba IS NOT NULL AS valid_pre, vs IS NOT NULL AND bs IS NOT NULL AS valid_post, coalesce(va >= 0.60::float AND ba >= 0.50::float, false) AS pre_vegetated,
 coalesce(vs IS NOT NULL AND bs <= 0.35::float, false) AS post_nonveg_nbr, coalesce(vs <= 0.50::float AND bs <= 0.35::float, false) AS post_nonveg FROM i)
SELECT y, x, valid_pre, valid_post, pre_vegetated, post_nonveg_nbr, post_nonveg, pre_vegetated AND post_nonveg AND valid_pre AND valid_post AS deforested,
 pre_vegetated AND post_nonveg AND valid_pre AND valid_post AND pre_scl NOT IN (3, 8, 9, 10) AND post_scl NOT IN (3, 8, 9, 10) AS cleaned FROM m""")
def deforestation(spark: SparkSession, d: str) -> DataFrame:
    m = masks.detection()
    cleaned = m["deforested"] & ~masks.cleanup_mask(F.col("pre_scl")) & ~masks.cleanup_mask(F.col("post_scl"))
    names = ("valid_pre", "valid_post", "pre_vegetated", "post_nonveg_nbr", "post_nonveg", "deforested")
    return views.both(spark, d, ("b04", "b08", "b12")).select("y", "x", *[m[k].alias(k) for k in names], cleaned.alias("cleaned"))


@query(f"""WITH p AS ({views.both_sql(('b04', 'b08'))}), m AS (SELECT count(*) AS n, count(*) FILTER ({_kept_sql('pre_')}) AS a, count(*) FILTER ({_kept_sql('post_')}) AS b FROM p)
SELECT n AS n_valid, a AS n_pre, b AS n_post, round(100.0::double * a / n, 6) AS pct_pre, round(100.0::double * b / n, 6) AS pct_post FROM m""")
def mask_percentages(spark: SparkSession, d: str) -> DataFrame:
    m = views.both(spark, d, ("b04", "b08")).agg(F.count(F.lit(1)).alias("n_valid"), F.count_if(_kept("pre_")).alias("n_pre"), F.count_if(_kept("post_")).alias("n_post"))
    return m.select("*", *[F.round(change.percent(F.col(f"n_{k}"), F.col("n_valid")), 6).alias(f"pct_{k}") for k in ("pre", "post")])


# --- neighbourhoods ----------------------------------------------------------------

@query("""WITH p AS (SELECT vec_id::int AS y, x::int AS x, embedding[x + 1]::double > 0.3::double AS m FROM (SELECT vec_id, embedding, unnest(range(64)) AS x FROM embeddings)),
t AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM p, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE m)
SELECT p.y, p.x, t.y IS NOT NULL AS value FROM p LEFT JOIN t ON p.y = t.y AND p.x = t.x""")
def dilate_r2(spark: SparkSession, d: str) -> DataFrame:
    px = views.table(spark, d, "embeddings").select(F.lit(0).alias("scene"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return neighbourhood.dilated(px.select("scene", "y", "x", (F.col("v").cast("double") > 0.3).alias("value")), 2, ["scene"]).select("y", "x", "value")


_COMPONENTS = f"""WITH RECURSIVE p AS ({views.CHIPS_SQL}), q AS (SELECT scene, y, x, value, y::bigint * 4294967296 + x AS id FROM p),
near AS (SELECT a.id AS a, b.id AS b, a.value = b.value AS same FROM q a JOIN q b ON a.scene = b.scene AND a.id <> b.id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT id AS a, id AS b FROM q UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b AND n.same),
comp AS (SELECT a AS id, min(b) AS component, count(*) AS n FROM reach GROUP BY a)"""


@query(_COMPONENTS + " SELECT q.scene, q.y, q.x, q.value, component, n FROM q JOIN comp ON comp.id = q.id")
def components8(spark: SparkSession, d: str) -> DataFrame:
    found, _ = neighbourhood.components(views.chips(spark, d), ["scene"])
    size = found.groupBy("scene", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    return neighbourhood.to_pixels(found.join(size, ["scene", "component"]), ["scene"], "value", "component", "n")


@query(_COMPONENTS + """, named AS (SELECT q.*, component, n FROM q JOIN comp ON comp.id = q.id),
pairs AS (SELECT DISTINCT s.component AS c, t.component AS o, t.n AS m, t.value AS v FROM near JOIN named s ON s.id = near.a JOIN named t ON t.id = near.b WHERE NOT near.same AND s.n < 9),
best AS (SELECT c, o, m, v FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY m DESC, o) AS k FROM pairs) WHERE k = 1),
chain AS (SELECT c, o, m, v, 1 AS step FROM best UNION ALL SELECT h.c, b.o, b.m, b.v, step + 1 FROM chain h JOIN best b ON b.c = h.o WHERE h.m < 9 AND step < 64),
done AS (SELECT c, v FROM chain WHERE m >= 9)
SELECT scene, y, x, coalesce(done.v, value) AS value FROM named LEFT JOIN done ON done.c = component AND n < 9""")
def sieve_min9(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.sieved(views.chips(spark, d), 9, ["scene"])


# --- rendering -------------------------------------------------------------------------

_RGB = f"SELECT y, x, {R} AS r, {G} AS g, {B} AS b, ({nd0('b08', 'b04')} BETWEEN 0.35::float AND 1::float) AS keep, {_CLEAR('scl')} AS clear, (y + x) % 9 = 0 AS loss FROM ({views.grid_sql(('b04', 'b08'))})"


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    px = views.grid(spark, d, ("b04", "b08"))
    return px.select("y", "x", *[c.alias(k) for k, c in render.ndvi_colour().items()], spectral.within(spectral.norm_diff_zero("b08", "b04"), 0.35, 1.0).alias("keep"), masks.scl_clear(F.col("scl"), F.lit(True)).alias("clear"), ((F.col("y") + F.col("x")) % 9 == 0).alias("loss"))


def _rgb() -> dict[str, F.Column]:
    return {k: F.col(k) for k in ("r", "g", "b")}


def _named(c: dict[str, F.Column], suffix: str = "") -> list[F.Column]:
    return [v.cast("int").alias(k + suffix) for k, v in c.items()]


def _each(pattern: str, suffix: str) -> str:
    return ", ".join(f"({pattern.format(c=c)})::int AS {c}{suffix}" for c in "rgb")


@query(f"""WITH p AS ({_RGB}) SELECT y, x, {_each('CASE WHEN loss THEN 180 WHEN NOT clear THEN 255 ELSE {c} END', '_grey')}, {_each('CASE WHEN loss THEN 180 ELSE {c} END', '_plain')},
{_each('CASE WHEN loss THEN 180 WHEN NOT keep OR NOT clear THEN 255 ELSE {c} END', '_clean')}, {_each('CASE WHEN NOT clear THEN 255 WHEN loss THEN 180 ELSE {c} END', '_white')}, {_each('CASE WHEN NOT clear THEN 255 ELSE {c} END', '_masked')} FROM p""")
def overlay_grey(spark: SparkSession, d: str) -> DataFrame:
    loss, keep, clear = F.col("loss"), F.col("keep"), F.col("clear")
    return _rendered(spark, d).select(
        "y", "x", *_named(render.grey_overlay(_rgb(), loss, clear), "_grey"), *_named(render.grey_overlay(_rgb(), loss), "_plain"), *_named(render.clean_overlay(_rgb(), loss, keep, clear), "_clean"),
        *_named(render.overlay_then_white(_rgb(), loss, clear), "_white"), *_named(render.white_where(_rgb(), ~clear), "_masked"))


@query(f"""WITH p AS ({_RGB}) SELECT y, x, CASE WHEN keep AND clear THEN 255 ELSE 0 END AS a_keep, CASE WHEN clear THEN 255 ELSE 0 END AS a_clear,
CASE WHEN loss THEN 255 ELSE 0 END AS r_red, CASE WHEN loss THEN 128 ELSE 0 END AS a_red FROM p""")
def alpha_layers(spark: SparkSession, d: str) -> DataFrame:
    red = render.red_overlay(F.col("loss"))
    return _rendered(spark, d).select("y", "x", render.with_alpha(_rgb(), F.col("keep"), F.col("clear"))["a"].alias("a_keep"), render.transparent(_rgb(), F.col("clear"))["a"].alias("a_clear"), red["r"].alias("r_red"), red["a"].alias("a_red"))


def _blend_sql(c: str) -> str:
    part = lambda v: f"({v}::float / 255::float)::float"
    under, over = part("ba"), f"{part('ta')} * 0.55::float"
    low = f"({part(c)} * {under} + 1::float * (1::float - {under}))"
    return BYTE(C01(f"{part(f'(255 - {c})')} * ({over}) + {low} * (1::float - {over})")) + f" AS {c}"


@query(f"WITH p AS (SELECT *, CASE WHEN keep THEN 255 ELSE 0 END AS ba, CASE WHEN loss THEN 128 ELSE 0 END AS ta FROM ({_RGB})) SELECT y, x, {', '.join(map(_blend_sql, 'rgb'))} FROM p")
def alpha_blend(spark: SparkSession, d: str) -> DataFrame:
    bottom = _rgb() | {"a": F.when(F.col("keep"), 255).otherwise(0)}
    top = {k: 255 - v for k, v in _rgb().items()} | {"a": F.when(F.col("loss"), 128).otherwise(0)}
    return _rendered(spark, d).select("y", "x", *_named(render.blended(bottom, top, 0.55)))


@query(f"""WITH p AS ({_RGB}) SELECT y, x, CASE WHEN keep THEN 255 ELSE 0 END AS m255, CASE WHEN keep THEN 0 ELSE 255 END AS holes, CASE WHEN keep THEN 1 ELSE 255 END AS one_nodata,
CASE WHEN clear THEN keep::int ELSE 255 END AS domain, CASE WHEN clear THEN r END AS masked_value FROM p""")
def mask_encodings(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("keep"), F.col("clear")
    return _rendered(spark, d).select("y", "x", change.encoded(k).alias("m255"), change.holes(k).alias("holes"), change.one_or_nodata(k).alias("one_nodata"), change.in_domain(k, c).alias("domain"), F.when(c, F.col("r")).alias("masked_value"))


# --- scenes --------------------------------------------------------------------------------

_QUALITY_PX = f"SELECT *, {_CLEAR('scl')} AND y % 25 <> 3 AS clear FROM (SELECT * EXCLUDE (scl), CASE WHEN y % 25 = 5 THEN 9 WHEN y % 25 = 7 THEN 11 WHEN scl IN (8, 9, 10) AND y % 25 > 12 THEN 4 WHEN y % 25 > 18 THEN 4 ELSE scl END AS scl FROM ({views.grid_sql()})) WHERE label < 8"
_QUALITY = f"""SELECT scene, date, count(*) AS support_px, count(*) FILTER (clear) AS clear_support_px, avg(clear::int::double) AS clear_frac, avg((scl = 4)::int::double) AS veg_frac, avg((scl = 11)::int::double) AS snow_frac,
avg((scl IN (8, 9, 10))::int::double) AS cloud_frac, avg((scl IN (2, 3))::int::double) AS shadow_frac, avg((scl = 7)::int::double) AS scl7_frac, {', '.join(f"quantile_cont(CASE WHEN clear THEN {nd(*spectral.INDEX_BANDS[n])}::double END, 0.5) AS {n.lower()}_med_clear" for n in ('NDVI', 'NDRE', 'NDMI', 'NBR', 'NDSI'))},
dayofyear(date)::int AS doy FROM ({_QUALITY_PX}) GROUP BY scene, date"""
_MEASURES = ("clear_frac", "veg_frac", "snow_frac", "cloud_frac", "shadow_frac", "scl7_frac", "ndvi_med_clear", "ndre_med_clear", "ndmi_med_clear", "nbr_med_clear", "ndsi_med_clear")


def _quality(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("y") % 25
    scl = F.when(y == 5, 9).when(y == 7, 11).when(F.col("scl").isin(8, 9, 10) & (y > 12), 4).when(y > 18, 4).otherwise(F.col("scl"))
    px = views.grid(spark, d).where("label < 8").withColumn("scl", scl)
    return scenes.quality(px.withColumn("clear", masks.scl_clear(F.col("scl"), F.lit(True)) & (y != 3)))


@query(f"SELECT scene, date, doy, support_px, clear_support_px, {', '.join(f'round({m}, 6) AS {m}' for m in _MEASURES)} FROM ({_QUALITY})")
def scene_quality(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).select("scene", "date", "doy", "support_px", "clear_support_px", *[F.round(m, 6).alias(m) for m in _MEASURES])


_REC = f"""SELECT scene, CASE WHEN b <> '' THEN 'blacklist' WHEN c <> '' THEN 'caution' ELSE 'keep' END AS recommendation, CASE WHEN b <> '' THEN b WHEN c <> '' THEN c ELSE 'no_major_scene_quality_issue' END AS recommendation_reason FROM (SELECT scene,
concat_ws(';', CASE WHEN clear_support_px = 0 OR ndvi_med_clear IS NULL OR clear_frac <= 0.10::double THEN 'too_little_clear_support' END, CASE WHEN cloud_frac >= 0.80::double THEN 'cloud_dominated' END, CASE WHEN veg_frac <= 0 AND ndsi_med_clear >= 0.20::double THEN 'no_vegetation_and_snow_like_clear_pixels' END) AS b,
concat_ws(';', CASE WHEN clear_frac <= 0.60::double THEN 'low_clear_support' END, CASE WHEN veg_frac <= 0.20::double THEN 'low_vegetation_support' END, CASE WHEN snow_frac >= 0.10::double THEN 'snow_present' END, CASE WHEN shadow_frac >= 0.30::double THEN 'high_shadow_fraction' END, CASE WHEN scl7_frac >= 0.10::double THEN 'high_unclassified_fraction' END, CASE WHEN ndsi_med_clear >= 0 THEN 'positive_ndsi_clear_pixels' END) AS c FROM ({_QUALITY}))"""


@query(_REC)
def scene_recommendation(spark: SparkSession, d: str) -> DataFrame:
    return scenes.with_recommendation(_quality(spark, d)).select("scene", "recommendation", "recommendation_reason")


def _filter_query(mode: str) -> None:
    skip = ", ".join(f"'{x}'" for x in scenes.MODES[mode]) or "''"
    name = f"scene_filter_{mode}"

    def f(spark: SparkSession, d: str) -> DataFrame:
        return scenes.filtered(views.grid(spark, d, ()).select("scene", "date").distinct(), scenes.with_recommendation(_quality(spark, d)), mode).select("scene", "date")

    QUERIES[name], SQL[name] = f, f"SELECT DISTINCT scene, date FROM ({views.grid_sql(())}) WHERE scene NOT IN (SELECT scene FROM ({_REC}) WHERE recommendation IN ({skip}))"


for _mode in scenes.MODES:
    _filter_query(_mode)


@query(f"SELECT count(*) FILTER (recommendation = 'blacklist') AS n_blacklist, count(*) FILTER (recommendation = 'caution') AS n_caution, count(*) FILTER (recommendation = 'keep') AS n_keep FROM ({_REC})")
def recommendation_tally(spark: SparkSession, d: str) -> DataFrame:
    return scenes.tally(scenes.with_recommendation(_quality(spark, d)))


# --- stands --------------------------------------------------------------------------------

_YEARS = tuple(range(1995, 2001))


def _stands(spark: SparkSession, d: str) -> DataFrame:
    """Customers as stands: orders per year as yearly losses, balance as area."""
    year = F.year(F.col("o_orderdate"))
    loss = views.table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total_loss"), *[F.sum(F.when(year == y, F.col("o_totalprice"))).alias(f"y{y}") for y in _YEARS])
    c = views.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("ua"), "c_custkey", F.col("c_mktsegment").alias("code"), F.lower("c_mktsegment").alias("label"), F.when(F.col("c_custkey") % 11 == 0, F.lit("n/a")).otherwise((F.col("c_acctbal") * F.lit(100.0)).cast("string")).alias("ha"))
    return stands.losses(c.join(loss, F.col("c_custkey") == F.col("o_custkey"), "left"), "total_loss", [f"y{y}" for y in _YEARS], "ha")


_STANDS = f"""SELECT ua, code, label, area_m2, total / nullif(CASE WHEN area_m2 > 0 THEN area_m2 END, 0) AS total_loss_frac, worst / nullif(CASE WHEN area_m2 > 0 THEN area_m2 END, 0) AS max_year_loss_frac, ha FROM (
SELECT c_custkey::varchar AS ua, c_mktsegment AS code, lower(c_mktsegment) AS label, CASE WHEN c_custkey % 11 = 0 THEN 0::double ELSE c_acctbal * 100.0::double END AS ha, CASE WHEN c_custkey % 11 = 0 THEN 0::double ELSE c_acctbal * 100.0::double * 10000.0::double END AS area_m2, coalesce(total, 0) AS total, greatest({', '.join(f'coalesce(y{y}, 0)' for y in _YEARS)}) AS worst FROM customer LEFT JOIN (
SELECT o_custkey, sum(o_totalprice) AS total, {', '.join(f'sum(o_totalprice) FILTER (year(o_orderdate) = {y}) AS y{y}' for y in _YEARS)} FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)"""


@query(f"SELECT ua, code, round(area_m2, 3) AS area_m2, round(total_loss_frac, 9) AS total_loss_frac, round(max_year_loss_frac, 9) AS max_year_loss_frac FROM ({_STANDS}) WHERE area_m2 > 0 AND total_loss_frac <= 0.005::double AND max_year_loss_frac <= 0.003::double AND code <> 'BUILDING'")
def stable_stands(spark: SparkSession, d: str) -> DataFrame:
    good = stands.in_groups(_stands(spark, d).where(stands.is_stable()), "code", ("BUILDING",))
    return good.select("ua", "code", F.round("area_m2", 3).alias("area_m2"), *[F.round(c, 9).alias(c) for c in ("total_loss_frac", "max_year_loss_frac")])


@query(f"SELECT code AS group_code, label AS group_label, count(ua) AS n_subparcels, round(sum(ha), 2) AS total_area_ha, round(quantile_cont(total_loss_frac * 100.0::double, 0.5), 6) AS median_total_loss_pct, round(max(total_loss_frac * 100.0::double), 6) AS max_total_loss_pct, round(max(max_year_loss_frac * 100.0::double), 6) AS max_single_year_loss_pct FROM ({_STANDS}) WHERE area_m2 > 0 GROUP BY code, label")
def support_by_group(spark: SparkSession, d: str) -> DataFrame:
    s = stands.support_by_group(_stands(spark, d).where("area_m2 > 0"), "code", "label", "ua", "ha")
    return s.select("group_code", "group_label", "n_subparcels", F.round("total_area_ha", 2).alias("total_area_ha"), *[F.round(c, 6).alias(c) for c in ("median_total_loss_pct", "max_total_loss_pct", "max_single_year_loss_pct")])


@query(f"SELECT 60 AS zip_count_input, 'relative loss thresholds' AS support_rule, 'LOSS' AS group_sheet_used, 0.005::double AS stable_total_loss_frac_max, 0.5::double AS stable_total_loss_pct_max, 0.003::double AS stable_max_year_loss_frac_max, 0.3::double AS stable_max_year_loss_pct_max, count(*) AS n_support_subparcels, round(coalesce(sum(ha), 0), 2) AS support_area_ha, 'none' AS scene_filter_mode, 60 AS zip_count_used FROM ({_STANDS}) WHERE area_m2 > 0")
def support_rule_summary(spark: SparkSession, d: str) -> DataFrame:
    return stands.support_rule(_stands(spark, d).where("area_m2 > 0"), "ha", 60, 60, "LOSS", "none").withColumn("support_area_ha", F.round(F.coalesce("support_area_ha", F.lit(0.0)), 2))


@query("SELECT row_number() OVER (ORDER BY c, l)::int AS group_id, c AS group_code, l AS group_label FROM (SELECT DISTINCT p_brand AS c, lower(p_brand) AS l FROM part)")
def group_ids(spark: SparkSession, d: str) -> DataFrame:
    return stands.group_ids(views.table(spark, d, "part").withColumn("l", F.lower("p_brand")), "p_brand", "l")


_NORM = lambda c: f"CASE WHEN replace(upper(trim(coalesce({c}, ''), ' ')), ' ', '') IN ('NONE', 'NAN', 'NULL') THEN '' ELSE replace(upper(trim(coalesce({c}, ''), ' ')), ' ', '') END"
_PARTS_SQL = "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' nan' ELSE 'p ' || (c_custkey % 40) END AS p, CASE c_custkey % 4 WHEN 0 THEN '' ELSE 's' || (c_custkey % 4) END AS s, CASE c_custkey % 7 WHEN 0 THEN 's' || (c_custkey % 4) WHEN 1 THEN NULL WHEN 2 THEN 'None' WHEN 3 THEN 'P' || (c_custkey % 40) || 'x' ELSE 'u ' || c_custkey END AS u FROM customer"
_KEY_SQL = f"""SELECT k, p, s, u, CASE WHEN u <> '' AND p <> '' AND starts_with(u, p) AND length(u) > length(p) THEN u WHEN u <> '' AND p <> '' AND s <> '' AND u = s THEN p || s WHEN u = '' AND p <> '' AND s <> '' THEN p || s WHEN u <> '' THEN u WHEN p <> '' THEN p ELSE '' END AS unit_key, p AS parcel_key
FROM (SELECT k, {_NORM('p')} AS p, {_NORM('s')} AS s, {_NORM('u')} AS u FROM ({_PARTS_SQL}))"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text_of = lambda c: c.cast("string")
    return views.table(spark, d, "customer").select(
        k.alias("k"), F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, " nan").otherwise(F.concat(F.lit("p "), text_of(k % 40))).alias("parcel"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("s"), text_of(k % 4))).alias("subparcel"),
        F.when(k % 7 == 0, F.concat(F.lit("s"), text_of(k % 4))).when(k % 7 == 1, F.lit(None).cast("string")).when(k % 7 == 2, "None").when(k % 7 == 3, F.concat(F.lit("P"), text_of(k % 40), F.lit("x"))).otherwise(F.concat(F.lit("u "), text_of(k))).alias("unit"))


@query(f"SELECT k, unit_key, parcel_key FROM ({_KEY_SQL})")
def fmu_key_norm(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("k", text.stand_key(F.col("parcel"), F.col("subparcel"), F.col("unit")).alias("unit_key"), text.norm_text(F.col("parcel")).alias("parcel_key"))


@query(f"""WITH s AS ({_KEY_SQL}), a AS (SELECT *, CASE WHEN k % 6 = 0 THEN NULL ELSE 'C' || (k % 9) END AS code, CASE WHEN k % 6 = 0 THEN NULL ELSE 'Label ' || (k % 9) END AS label FROM s WHERE k % 3 = 0),
a1 AS (SELECT unit_key, code, label FROM (SELECT *, row_number() OVER (PARTITION BY unit_key ORDER BY k) AS n FROM a) WHERE n = 1),
a2 AS (SELECT parcel_key, code, label FROM (SELECT *, row_number() OVER (PARTITION BY parcel_key ORDER BY k) AS n FROM a WHERE parcel_key IN (SELECT parcel_key FROM a GROUP BY parcel_key HAVING count(code) = 1)) WHERE n = 1),
j AS (SELECT s.k, s.unit_key, s.parcel_key, CASE WHEN a1.code IS NULL AND s.parcel_key <> '' THEN a2.code ELSE a1.code END AS code, CASE WHEN a1.code IS NULL AND s.parcel_key <> '' THEN a2.label ELSE a1.label END AS label FROM s LEFT JOIN a1 ON a1.unit_key = s.unit_key LEFT JOIN a2 ON a2.parcel_key = s.parcel_key)
SELECT k, unit_key, CASE WHEN coalesce(code, 'NO_DATA') = 'NO_DATA' THEN 'ALL_FOREST' ELSE code END AS group_code, CASE WHEN coalesce(code, 'NO_DATA') = 'NO_DATA' THEN 'All forest' ELSE coalesce(label, 'No data') END AS group_label FROM j""")
def fmu_join_fallback(spark: SparkSession, d: str) -> DataFrame:
    p, k = _parts(spark, d), F.col("k")
    code = lambda prefix: F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(prefix), (k % 9).cast("string")))
    table = p.where(k % 3 == 0).withColumns({"code": code("C"), "label": code("Label ")}).withColumnRenamed("k", "nth")
    return stands.grouped_stands(p, table, "nth").select("k", "unit_key", "group_code", "group_label")


@query("""WITH a AS (SELECT s_nationkey::varchar AS ua, s_suppkey, s_name, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) WHERE n = 1)
SELECT n_nationkey::varchar AS ua, n_name, s_name, s_acctbal FROM nation LEFT JOIN a ON a.ua = n_nationkey::varchar""")
def attribute_join_first(spark: SparkSession, d: str) -> DataFrame:
    n = views.table(spark, d, "nation").select(F.col("n_nationkey").alias("ua"), "n_name")
    s = views.table(spark, d, "supplier").select(F.col("s_nationkey").alias("ua"), "s_suppkey", "s_name", "s_acctbal")
    return stands.with_attributes(n, s, "ua", ["s_suppkey"]).select("ua", "n_name", "s_name", "s_acctbal")


@query("SELECT n_regionkey AS code, arg_max(n_name, n_nationkey) AS label FROM nation GROUP BY n_regionkey")
def one_label_per_code(spark: SparkSession, d: str) -> DataFrame:
    return stands.one_label(views.table(spark, d, "nation").select(F.col("n_regionkey").alias("code"), F.col("n_name").alias("label"), "n_nationkey"), "code", "label", "n_nationkey")


# --- zones and envelopes ---------------------------------------------------------------------

_ZONES = f"""SELECT group_code, group_label, 'AB' AS "index", date, count(v) AS n_valid_pixels, min(v::double) AS date_min, quantile_cont(v::double, 0.1) AS date_q10, quantile_cont(v::double, 0.5) AS date_median, quantile_cont(v::double, 0.9) AS date_q90, max(v::double) AS date_max, avg(v::double) AS date_mean
FROM (SELECT *, {nd('a', 'b')} AS v FROM ({views.OBS_SQL})) WHERE v IS NOT NULL GROUP BY group_code, group_label, date HAVING count(v) >= 20"""
_START = "((dayofyear(date) - 1) // 30 * 30 + 1)"
_END = f"least({_START} + 29, 365)"
_HALF = lambda a, b: f"(CASE WHEN ({a} + {b}) % 2 = 0 THEN ({a} + {b}) // 2 WHEN ({a} + {b}) // 2 % 2 = 0 THEN ({a} + {b}) // 2 ELSE ({a} + {b}) // 2 + 1 END)::int"
_SEASON = f"SELECT *, year(date)::int AS year, month(date)::int AS month, day(date)::int AS day, dayofyear(date)::int AS doy, printf('%03d-%03d', {_START}, {_END}) AS doy_bin_label, {_HALF(_START, _END)} AS doy_bin_center FROM ({_ZONES})"
_ENV = f"""SELECT group_code, group_label, "index", doy_bin_label, doy_bin_center, count(*) AS n_dates, sum(n_valid_pixels)::bigint AS support_pixels_total, quantile_cont(date_median, 0.1) AS env_q_low, quantile_cont(date_median, 0.5) AS env_q_med, quantile_cont(date_median, 0.9) AS env_q_high, min(date_median) AS curve_min, quantile_cont(date_median, 0.5) AS curve_med, max(date_median) AS curve_max,
quantile_cont(date_q10, 0.5) AS median_of_date_q10, quantile_cont(date_q90, 0.5) AS median_of_date_q90, min(date_min) AS min_of_date_min, max(date_max) AS max_of_date_max FROM ({_SEASON}) GROUP BY group_code, group_label, "index", doy_bin_label, doy_bin_center"""


def _zones(spark: SparkSession, d: str) -> DataFrame:
    px = views.observations(spark, d).withColumns({"index": F.lit("AB"), "value": spectral.norm_diff("a", "b")})
    return zonal.statistics(px, [*zonal.ZONE, "date"], 20)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _rounded_sql(sql: str, doubles: tuple[str, ...]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles)}) FROM ({sql})"


_STATS = ("date_min", "date_q10", "date_median", "date_q90", "date_max", "date_mean")
_ENV_STATS = ("env_q_low", "env_q_med", "env_q_high", "curve_min", "curve_med", "curve_max", "median_of_date_q10", "median_of_date_q90", "min_of_date_min", "max_of_date_max")


@query(_rounded_sql(_SEASON, _STATS))
def zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zonal.with_season(_zones(spark, d)))


@query(_rounded_sql(_ENV, _ENV_STATS))
def doy_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zonal.envelopes(zonal.with_season(_zones(spark, d))))


@query(f'SELECT group_code, "index", count(DISTINCT date) AS n_dates, min(doy) AS min_doy, max(doy) AS max_doy FROM ({_SEASON}) GROUP BY group_code, "index"')
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return zonal.coverage(zonal.with_season(_zones(spark, d)))


@query(f'SELECT s.group_code, s.group_label, s."index", s.date, s.year, s.doy, round(s.date_median, 6) AS date_median, s.doy_bin_label, e.doy_bin_center, {", ".join(f"round(e.{c}, 6) AS {c}" for c in ("env_q_low", "env_q_med", "env_q_high", "curve_min", "curve_max"))} FROM ({_SEASON}) s JOIN ({_ENV}) e ON s.group_code = e.group_code AND s.group_label = e.group_label AND s."index" = e."index" AND s.doy_bin_label = e.doy_bin_label')
def envelope_plot_points(spark: SparkSession, d: str) -> DataFrame:
    dates = zonal.with_season(_zones(spark, d))
    return _rounded(zonal.plot_points(dates, zonal.envelopes(dates)))


_NUMBERS = ("doy_bin_center", "n_dates", "support_pixels_total", *_ENV_STATS)
_PARTIAL = f"SELECT * FROM ({_ENV}) WHERE NOT (group_code IN ('G0', 'G1', 'G2') AND doy_bin_center < 150) AND NOT (group_code = 'G3' AND doy_bin_center > 300)"
_ALL = f"""SELECT group_code, group_label, "index", doy_bin_label, {', '.join(f'{c}::double AS {c}' for c in _NUMBERS)} FROM ({_PARTIAL}) UNION ALL SELECT 'ALL_FOREST', 'All forest', "index", doy_bin_label, {', '.join(f'quantile_cont({c}::double, 0.5)' for c in _NUMBERS)} FROM ({_PARTIAL}) GROUP BY "index", doy_bin_label"""


def _partial(spark: SparkSession, d: str) -> DataFrame:
    env = zonal.envelopes(zonal.with_season(_zones(spark, d)))
    return env.where("not (group_code in ('G0', 'G1', 'G2') and doy_bin_center < 150) and not (group_code = 'G3' and doy_bin_center > 300)")


@query(_rounded_sql(_ALL, _ENV_STATS))
def all_forest_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(envelope.with_all_forest(_partial(spark, d)))


_WANTED = f"""SELECT DISTINCT g.group_code, g."index", b.doy_bin_label AS requested_bin FROM ({_ALL}) g, (SELECT DISTINCT doy_bin_label FROM ({_ENV})) b"""
_LABEL_MID = _HALF("substr(w.requested_bin, 1, 3)::int", "substr(w.requested_bin, 5, 3)::int")
_LOOKUP = f"""SELECT group_code, "index", requested_bin, used_bin, requested_bin <> used_bin AS fallback_used, lo AS env_q_low, hi AS env_q_high, n_dates, support_pixels_total FROM (
SELECT w.group_code, w."index", w.requested_bin, e.doy_bin_label AS used_bin, e.median_of_date_q10 AS lo, e.median_of_date_q90 AS hi, e.n_dates, e.support_pixels_total,
row_number() OVER (PARTITION BY w.group_code, w."index", w.requested_bin ORDER BY (e.doy_bin_label = w.requested_bin) DESC, abs(e.doy_bin_center - {_LABEL_MID}), e.n_dates DESC, e.support_pixels_total DESC, e.doy_bin_label) AS n
FROM ({_WANTED}) w JOIN ({_ALL}) e ON e.group_code = w.group_code AND e."index" = w."index") WHERE n = 1"""


def _looked_up(spark: SparkSession, d: str) -> DataFrame:
    env = envelope.with_all_forest(_partial(spark, d))
    seasons = zonal.envelopes(zonal.with_season(_zones(spark, d))).select(F.col("doy_bin_label").alias("requested_bin")).distinct()
    wanted = env.select("group_code", "index").distinct().join(F.broadcast(seasons), how="cross")  # at most 13 seasons
    return envelope.lookup(env, wanted)


@query(f"SELECT * REPLACE (round(env_q_low, 6) AS env_q_low, round(env_q_high, 6) AS env_q_high) FROM ({_LOOKUP}) WHERE fallback_used")
def envelope_lookup_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_looked_up(spark, d).where("fallback_used"))


@query(f"SELECT * REPLACE (round(env_q_low, 6) AS env_q_low, round(env_q_high, 6) AS env_q_high) FROM ({_LOOKUP}) WHERE NOT fallback_used")
def envelope_lookup_exact(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_looked_up(spark, d).where("not fallback_used"))


@query(f"""SELECT s.group_code, s."index", s.date, s.doy_bin_label AS requested_bin, l.used_bin, l.fallback_used, round(l.env_q_low, 6) AS env_q_low, round(l.env_q_high, 6) AS env_q_high, l.n_dates, l.support_pixels_total
FROM ({_SEASON}) s JOIN ({_LOOKUP}) l ON l.group_code = s.group_code AND l."index" = s."index" AND l.requested_bin = s.doy_bin_label""")
def lookup_traces(spark: SparkSession, d: str) -> DataFrame:
    wanted = zonal.with_season(_zones(spark, d)).select("group_code", "index", "date", F.col("doy_bin_label").alias("requested_bin"))
    found = envelope.lookup(envelope.with_all_forest(_partial(spark, d)), wanted)
    return _rounded(envelope.traced(wanted, found))


@query(f"""SELECT DISTINCT 'X9' AS group_code, "index", doy_bin_label AS requested_bin FROM ({_SEASON}) WHERE group_code IN ('G1', 'G2')""")
def envelope_missing(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("group_code").isin("G1", "G2"), "X9").otherwise(F.col("group_code"))
    wanted = zonal.with_season(_zones(spark, d)).select(code.alias("group_code"), "index", F.col("doy_bin_label").alias("requested_bin"))
    return envelope.missing(envelope.lookup(envelope.with_all_forest(_partial(spark, d)), wanted), wanted)


# votes: envelopes of the raster view's own scenes, applied to its pixels
_IDX = ("NDVI", "NDMI", "NBR", "NDRE")
_LONG = "WITH p AS (SELECT *, 'L' || label AS group_code FROM (" + views.grid_sql() + ")) " + " UNION ALL ".join(f"""SELECT group_code, '{n}' AS "index", date, {nd(*spectral.INDEX_BANDS[n])} AS v FROM p""" for n in _IDX)
_G_ZONES = f"""SELECT group_code, group_code AS group_label, "index", date, count(v) AS n_valid_pixels, min(v::double) AS date_min, quantile_cont(v::double, 0.1) AS date_q10, quantile_cont(v::double, 0.5) AS date_median, quantile_cont(v::double, 0.9) AS date_q90, max(v::double) AS date_max, avg(v::double) AS date_mean FROM ({_LONG}) WHERE v IS NOT NULL GROUP BY group_code, "index", date HAVING count(v) >= 20"""
_G_BOUNDS = f"""SELECT group_code, doy_bin_label, {', '.join(f'''max(CASE WHEN "index" = '{n}' THEN round(q10, 4) END)::float AS {n.lower()}_low, max(CASE WHEN "index" = '{n}' THEN round(q90, 4) END)::float AS {n.lower()}_high''' for n in _IDX)} FROM (SELECT group_code, "index", printf('%03d-%03d', {_START}, {_END}) AS doy_bin_label, quantile_cont(date_q10, 0.5) AS q10, quantile_cont(date_q90, 0.5) AS q90 FROM ({_G_ZONES}) GROUP BY group_code, "index", printf('%03d-%03d', {_START}, {_END})) GROUP BY group_code, doy_bin_label"""
_IN = lambda n: f"(clear AND coalesce({nd(*spectral.INDEX_BANDS[n])} >= {n.lower()}_low AND {nd(*spectral.INDEX_BANDS[n])} <= {n.lower()}_high, false))"
_VOTES = f"""SELECT *, domain AND votes >= 2 AS keep, domain AND votes < 2 AS "drop" FROM (SELECT p.scene, p.date, p.doy_bin_label, p.y, p.x, p.group_code, {', '.join(f'{_IN(n)} AS in_{n.lower()}' for n in _IDX)}, {' + '.join(f'{_IN(n)}::int' for n in ('NDVI', 'NDMI', 'NBR'))} AS votes, clear AND {' AND '.join(f'{nd(*spectral.INDEX_BANDS[n])} IS NOT NULL' for n in ('NDVI', 'NDMI', 'NBR'))} AS domain
FROM (SELECT *, 'L' || label AS group_code, printf('%03d-%03d', {_START}, {_END}) AS doy_bin_label, {_CLEAR('scl')} AS clear FROM ({views.grid_sql()})) p LEFT JOIN ({_G_BOUNDS}) b ON b.group_code = p.group_code AND b.doy_bin_label = p.doy_bin_label)"""


def _voted(spark: SparkSession, d: str) -> DataFrame:
    px = views.grid(spark, d).withColumn("group_code", F.concat(F.lit("L"), F.col("label").cast("string")))
    long = spectral.long_indices(px, ["group_code", "date"], _IDX).withColumn("group_label", F.col("group_code"))
    env = zonal.envelopes(zonal.with_season(zonal.statistics(long, [*zonal.ZONE, "date"], 20)))
    env = env.withColumns({c: F.round(c, 4) for c in (envelope.LOW, envelope.HIGH)})  # so that both engines' last digits agree
    found = envelope.lookup(env, env.select("group_code", "index", F.col("doy_bin_label").alias("requested_bin")))
    seen = px.withColumns({"doy_bin_label": text.bin_label(F.dayofyear("date")), "clear": masks.scl_clear(F.col("scl"), F.lit(True))})
    return envelope.voted(seen, envelope.bounds(found))


@query(f'SELECT scene, y, x, group_code, in_ndvi, in_ndmi, in_nbr, in_ndre, votes, domain, keep, "drop", CASE WHEN domain THEN keep::int ELSE 255 END AS keep_mask FROM ({_VOTES})')
def envelope_votes(spark: SparkSession, d: str) -> DataFrame:
    return _voted(spark, d).select("scene", "y", "x", "group_code", *[f"in_{n.lower()}" for n in _IDX], "votes", "domain", "keep", "drop", envelope.encoded(F.col("keep"), F.col("domain")).alias("keep_mask"))


@query(f"""SELECT scene, date, doy_bin_label, group_code, count(*) AS semantic_domain_px, count(*) FILTER (keep) AS keep_px, count(*) FILTER ("drop") AS drop_px, round(100.0::double * avg(keep::int::double), 6) AS keep_pct, round(avg(votes::double), 6) AS mean_vote_count, {', '.join(f'round(100.0::double * avg(in_{n.lower()}::int::double), 6) AS inside_{n.lower()}_pct' for n in _IDX)} FROM ({_VOTES}) WHERE domain GROUP BY scene, date, doy_bin_label, group_code""")
def group_scene_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(envelope.group_summary(_voted(spark, d), ["scene", "date", "doy_bin_label", "group_code"]))


@query(f"""SELECT scene, date, doy_bin_label, count(*) FILTER (domain) AS n_grouped_valid_px, count(*) FILTER (keep) AS keep_px, count(*) FILTER ("drop") AS drop_px, round(100.0::double * count(*) FILTER (keep) / nullif(count(*) FILTER (domain), 0), 6) AS keep_pct, round(100.0::double * count(*) FILTER ("drop") / nullif(count(*) FILTER (domain), 0), 6) AS drop_pct, count(DISTINCT CASE WHEN domain THEN group_code END) AS n_group_ids_used, 'NDVI,NDMI,NBR' AS core_indices, 2 AS keep_votes_required FROM ({_VOTES}) GROUP BY scene, date, doy_bin_label""")
def scene_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(envelope.scene_summary(_voted(spark, d), ["scene", "date", "doy_bin_label"]))


# --- grids ---------------------------------------------------------------------------------------

def _source(spark: SparkSession, d: str) -> grid.Grid:
    """The whole view's grid."""
    return grid.Grid(views.table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1, 64, 0.0, 0.0, 1.0, 1.0)


def _fine(source: grid.Grid) -> grid.Grid:
    """Twice as fine, and not quite as large."""
    return grid.Grid(2 * source.height - 10, 126, 3.25, 2.75, 0.5, 0.5)


_E = lambda c, o: f"(({o}::double + ({c} + 0.5::double) * 0.5::double))"
_TARGET = "SELECT y::int AS y, x::int AS x FROM (SELECT unnest(range(2 * (SELECT max(vec_id) + 1 FROM embeddings)::bigint - 10)) AS y), (SELECT unnest(range(126)) AS x)"


@query(f"WITH s AS ({views.grid_sql(('b04', 'b08'))}), t AS (SELECT y, x, floor({_E('y', 2.75)})::int AS sy, floor({_E('x', 3.25)})::int AS sx FROM ({_TARGET})) SELECT t.y, t.x, coalesce(b04, 0::float) AS b04, coalesce(b08, 0::float) AS b08 FROM t LEFT JOIN s ON s.y = sy AND s.x = sx")
def resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    px = views.grid(spark, d, ("b04", "b08")).select(F.lit(0).alias("one"), "y", "x", "b04", "b08")
    source = _source(spark, d)
    return grid.nearest(px, source, _fine(source), ["one"], ["b04", "b08"]).select("y", "x", "b04", "b08")


@query(f"""WITH s AS (SELECT y, x, CASE WHEN (y + x) % 5 <> 0 THEN b08 END AS b08 FROM ({views.grid_sql(('b08',))})), t AS (SELECT y, x, {_E('y', 2.75)} - 0.5::double AS fr, {_E('x', 3.25)} - 0.5::double AS fc FROM ({_TARGET})),
f AS (SELECT y, x, floor(fr)::int + i AS sy, floor(fc)::int + j AS sx, (CASE WHEN i = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN j = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS w FROM t, (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j))
SELECT f.y, f.x, (sum(b08::double * w) / nullif(sum(CASE WHEN b08 IS NOT NULL THEN w END), 0))::float AS b08 FROM f LEFT JOIN s ON s.y = sy AND s.x = sx WHERE w > 0 GROUP BY f.y, f.x""")
def resample_bilinear(spark: SparkSession, d: str) -> DataFrame:
    px = views.grid(spark, d, ("b08",)).select(F.lit(0).alias("one"), "y", "x", F.when((F.col("y") + F.col("x")) % 5 != 0, F.col("b08")).alias("b08"))
    source = _source(spark, d)
    return grid.bilinear(px, source, _fine(source), ["one"], ["b08"]).select("y", "x", "b08")


_CORNERS = ((0.0, 0.0), (22.3, 7.9), (5.1, 31.7))
_EDGES_SQL = ", ".join(f"{{'x1': cx + {_CORNERS[i][0]}::double, 'y1': cy + {_CORNERS[i][1]}::double, 'x2': cx + {_CORNERS[(i + 1) % 3][0]}::double, 'y2': cy + {_CORNERS[(i + 1) % 3][1]}::double}}" for i in range(3))


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    corner = lambda i: [(k * 7 % 60).cast("double") + F.lit(_CORNERS[i % 3][0]), (k * 53 % 450).cast("double") + F.lit(_CORNERS[i % 3][1])]
    edges = F.array(*[F.struct(*[c.alias(n) for c, n in zip([*corner(i), *corner(i + 1)], ("x1", "y1", "x2", "y2"))]) for i in range(3)])
    return views.table(spark, d, "nation").select((k + 1).cast("int").alias("group_id"), k.alias("feature"), edges.alias("edges"))


@query(f"""WITH g AS (SELECT n_nationkey + 1 AS group_id, n_nationkey AS feature, [{_EDGES_SQL}] AS edges FROM (SELECT *, (n_nationkey * 7 % 60)::double AS cx, (n_nationkey * 53 % 450)::double AS cy FROM nation)),
p AS (SELECT vec_id::int AS y, x::int AS x, vec_id + 0.5::double AS py, x + 0.5::double AS px FROM (SELECT vec_id, unnest(range(64)) AS x FROM embeddings))
SELECT y, x, arg_max(group_id, feature)::int AS group_id FROM p, g WHERE len(list_filter(edges, lambda e: (e.y1 > py) <> (e.y2 > py) AND px < (e.x2 - e.x1) * (py - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1)) % 2 = 1 GROUP BY y, x""")
def polygon_to_pixel(spark: SparkSession, d: str) -> DataFrame:
    px = views.table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    return grid.polygons_to_pixels(_polygons(spark, d), _source(spark, d), px)


_SHIFTED = "SELECT vec_id::int AS y, x::int AS x, vec_id::int + 2 AS sy, x::int + 3 AS sx FROM (SELECT vec_id, unnest(range(64)) AS x FROM embeddings)"


@query(f"WITH s AS (SELECT *, (y + x) % 4 <> 0 AS valid FROM ({views.grid_sql(('b04',))})), t AS ({_SHIFTED}) SELECT t.y, t.x, coalesce(b04, 0::float) AS b04, coalesce(valid, false) AS valid, scl FROM t LEFT JOIN s ON s.y = sy AND s.x = sx")
def aligned_to_reference(spark: SparkSession, d: str) -> DataFrame:
    source = _source(spark, d)
    reference = replace(source, left=3.25, top=1.75)
    px = views.grid(spark, d, ("b04",)).select(F.lit(0).alias("one"), "y", "x", "b04", ((F.col("y") + F.col("x")) % 4 != 0).alias("valid"), "scl")
    out = grid.aligned(px, source, reference, ["one"], ["b04", "valid"], ["scl"])
    return grid.aligned(out, reference, reference, ["one"], ["b04", "valid"], ["scl"]).select("y", "x", "b04", "valid", "scl")  # the second time there is nothing to do


@query("""SELECT p_partkey // 4 AS scene, count(DISTINCT (p_partkey % 4 = 3 AND p_partkey % 7 = 0, p_partkey % 4 = 1 AND p_partkey % 11 = 0)) AS n FROM part GROUP BY 1 HAVING n > 1""")
def grid_mismatches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    height = F.when((k % 4 == 3) & (k % 7 == 0), 20).otherwise(10)
    crs = F.when((k % 4 == 1) & (k % 11 == 0), "EPSG:4326").otherwise("EPSG:32635")
    grids = views.table(spark, d, "part").select(F.floor(k / 4).cast("long").alias("scene"), (k % 4).alias("band"), height.alias("height"), F.lit(64).alias("width"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(1.0).alias("dx"), F.lit(-1.0).alias("dy"), crs.alias("crs"))
    return grid.mismatched(grids, ["scene"])


def _utm_sql() -> str:
    """Easting and northing of lon, lat in zone 35, by the series in plain numbers."""
    import math

    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    num = lambda v: f"{v!r}::double"
    east = " + ".join(["eta", *[f"{num(c)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(alpha, 1)]])
    north = " + ".join(["xi", *[f"{num(c)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(alpha, 1)]])
    return f"""SELECT c_custkey, lon, lat, 500000 + {num(a)} * ({east}) AS east, {num(a)} * ({north}) AS north FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM (
SELECT *, radians(lon - 27) AS lam, sinh(atanh(sin(radians(lat))) - {num(e)} * atanh({num(e)} * sin(radians(lat)))) AS t FROM (SELECT c_custkey, 24 + (c_custkey % 601) / 100.0::double AS lon, 43 + (c_custkey % 499) / 100.0::double AS lat FROM customer)))"""


@query(f"SELECT c_custkey, round(east, 3) AS east, round(north, 3) AS north, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({_utm_sql()})")
def points_to_utm(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    at = views.table(spark, d, "customer").select("c_custkey", (24 + (k % 601) / F.lit(100.0)).alias("lon"), (43 + (k % 499) / F.lit(100.0)).alias("lat"))
    east, north = grid.reprojected(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:32635")
    at = at.select("c_custkey", east.alias("east"), north.alias("north"))
    lon, lat = grid.reprojected(F.col("east"), F.col("north"), "EPSG:32635", "EPSG:4326")  # and back again
    return at.select("c_custkey", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("SELECT (n_nationkey + 1)::int AS group_id, n_nationkey AS feature, 3::int AS sides FROM nation WHERE n_nationkey % 3 <> 0")
def stands_with_shape(spark: SparkSession, d: str) -> DataFrame:
    bare = _polygons(spark, d).withColumn("edges", F.when(F.col("feature") % 3 != 0, F.col("edges")).otherwise(F.slice("edges", 1, 0)))
    return stands.with_shape(bare).select("group_id", "feature", F.size("edges").alias("sides"))


# --- names and dates ----------------------------------------------------------------------------------

_MEMBERS = """SELECT p_partkey // 8 AS scene, p_partkey AS ord, CASE p_partkey % 8 WHEN 0 THEN 'a/T_B04_(Raw).tiff' WHEN 1 THEN 'a/t-b04.TIF' WHEN 2 THEN 'xB04y.tif' WHEN 3 THEN 'B08 raw.jp2' WHEN 4 THEN 'B08.tif' WHEN 5 THEN 'b08.png' WHEN 6 THEN 'q_B8A_(Raw).tiff' ELSE 'scene_classification_map.tif' END AS name FROM part"""
_STEM = r"lower(regexp_replace(regexp_extract(name, '([^/\\]*)$', 1), '\.[^.]*$', ''))"


def _members(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    names = ["a/T_B04_(Raw).tiff", "a/t-b04.TIF", "xB04y.tif", "B08 raw.jp2", "B08.tif", "b08.png", "q_B8A_(Raw).tiff", "scene_classification_map.tif"]
    return views.table(spark, d, "part").select(F.floor(k / 8).cast("long").alias("scene"), k.alias("ord"), F.element_at(F.array(*map(F.lit, names)), (k % 8 + 1).cast("int")).alias("name"))


@query(f"""WITH m AS ({_MEMBERS}), t AS (SELECT m.*, tag FROM m, (VALUES ('B04'), ('B08'), ('B8A')) AS v(tag) WHERE regexp_matches(lower(name), '\\.(tif|tiff|jp2)$') AND regexp_matches({_STEM}, '(^|[^a-z0-9])' || lower(tag) || '([^a-z0-9]|$)'))
SELECT scene, tag, name, ord FROM (SELECT *, row_number() OVER (PARTITION BY scene, tag ORDER BY contains(lower(name), 'raw') DESC, ord) AS n FROM t) WHERE n = 1""")
def band_file_pick(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d).where(text.is_raster(F.col("name")))
    found = None
    for tag in ("B04", "B08", "B8A"):
        one = m.where(text.tagged(F.col("name"), tag)).withColumn("tag", F.lit(tag))
        found = one if found is None else found.unionByName(one)
    return scenes.first_match(found, ["scene", "tag"], F.contains(F.lower("name"), F.lit("raw")), "ord").select("scene", "tag", "name", "ord")


@query(f"""WITH m AS ({_MEMBERS}), s AS (SELECT DISTINCT scene FROM m), c AS (SELECT scene, arg_min(name, ord) AS scl FROM m WHERE contains(lower(name), 'scene_classification_map') OR contains(lower(name), 'scl') GROUP BY scene) SELECT s.scene, scl FROM s LEFT JOIN c ON c.scene = s.scene""")
def optional_scl_file(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    scl = scenes.first_match(m.where(text.is_classification(F.col("name"))), ["scene"], F.contains(F.lower("name"), F.lit("scene_classification_map")), "ord")
    return m.select("scene").distinct().join(scl.select("scene", F.col("name").alias("scl")), "scene", "left")


@query("""WITH n AS (SELECT o_orderkey, 'SdV_' || CASE WHEN o_orderkey % 10 = 0 THEN 'none' ELSE strftime(o_orderdate + INTERVAL 22 YEAR, '%Y-%m-%d') END || '_x.zip' AS name FROM orders), e AS (SELECT o_orderkey, name, try_cast(nullif(regexp_extract(name, '(20\\d{2}-\\d{2}-\\d{2})', 1), '') AS DATE) AS date FROM n)
SELECT o_orderkey, name, date, year(date)::int AS year, month(date)::int AS month, day(date)::int AS day, dayofyear(date)::int AS doy, strftime(date, '%Y-%m-%d') AS iso FROM e""")
def date_from_name(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 22 * 12), "yyyy-MM-dd")
    n = views.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("SdV_"), F.when(F.col("o_orderkey") % 10 == 0, "none").otherwise(day), F.lit("_x.zip")).alias("name"))
    n = n.withColumn("date", text.date_in(F.col("name")))
    return n.select("o_orderkey", "name", "date", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"), F.dayofyear("date").alias("doy"), F.date_format("date", "yyyy-MM-dd").alias("iso"))


@query(f"""SELECT doy, printf('%03d-%03d', (doy - 1) // 30 * 30 + 1, least((doy - 1) // 30 * 30 + 30, 365)) AS label, {_HALF('((doy - 1) // 30 * 30 + 1)', 'least((doy - 1) // 30 * 30 + 30, 365)')} AS centre FROM (SELECT unnest(range(1, 367))::int AS doy)""")
def season_bins(spark: SparkSession, d: str) -> DataFrame:
    doy = spark.range(1, 367).select(F.col("id").cast("int").alias("doy"))
    label = text.bin_label(F.col("doy"))
    return doy.select("doy", label.alias("label"), text.label_centre(label).alias("centre"))


@query("SELECT doc_id, coalesce(try_cast(regexp_extract(text, '[0-9]+', 0) AS double), 0) AS number, replace(source || '/' || lang, '/', '_') AS safe FROM documents")
def number_and_name(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", text.number(F.regexp_extract("text", "[0-9]+", 0)).alias("number"), text.safe_name(F.concat_ws("/", "source", "lang")).alias("safe"))


__all__ = ["QUERIES", "SQL", "Window", "edge_clear"]
