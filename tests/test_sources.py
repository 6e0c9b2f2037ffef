import io
import json
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdance.operators.grid import Grid
from verdance.plans import pipelines
from verdance.sources import geotiff, scenes, sinks, tables


@pytest.mark.parametrize("compression", ["none", "deflate", "lzw"])
@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "i4", "f4"])
def test_geotiff_round_trip(compression, kind):
    rng = np.random.default_rng(4)
    bands = rng.integers(0, 200, (2, 37, 53)).astype(kind)
    valid = rng.random((37, 53)) > 0.3
    data = geotiff.write(geotiff.Raster(bands, valid, 10.0, 60.0, 2.0, -2.0, "EPSG:32635", 7), compression, mask=True)
    r = geotiff.read(data)
    assert (r.bands == bands).all() and (r.valid == valid).all() and r.bands.dtype == np.dtype(kind)
    assert (r.left, r.top, r.dx, r.dy, r.crs, r.nodata) == (10.0, 60.0, 2.0, -2.0, "EPSG:32635", 7.0)
    p = geotiff.profile(data)
    assert p.bands.shape == (2, 37, 53) and p.crs == "EPSG:32635"


def test_nodata_makes_the_mask():
    bands = np.array([[[1, 7], [7, 2]]], "u1")
    assert geotiff.read(geotiff.write(geotiff.Raster(bands, np.ones((2, 2), bool), nodata=7))).valid.tolist() == [[True, False], [False, True]]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.lists(st.integers(0, 3), min_size=4000, max_size=9000).map(bytes)))
def test_lzw_round_trip(data):
    assert geotiff.unlzw(geotiff.lzw(data)) == data


def test_lzw_of_long_noise():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert geotiff.unlzw(geotiff.lzw(data)) == data


def archive(path, names: dict[str, np.ndarray], grid: Grid) -> None:
    with zipfile.ZipFile(path, "w") as z:
        for n, a in names.items():
            z.writestr(n, geotiff.write(geotiff.Raster(a if a.ndim == 3 else a[None], np.ones(a.shape[-2:], bool), grid.left, grid.top, grid.dx, grid.dy, grid.crs)))


GRID = Grid(6, 8, 100.0, 200.0, 10.0, -10.0, "EPSG:32635")
TAGS = ("B02", "B03", "B04", "B05", "B08", "B8A", "B11", "B12")


@pytest.fixture
def scene_dir(tmp_path):
    rng = np.random.default_rng(9)
    for k, date in enumerate(("2020-06-01", "2021-06-01")):
        d = tmp_path / f"d{k}"
        d.mkdir()
        bands = {f"x/2020-06-0{k + 2}_{t}_(Raw).tiff": rng.random((6, 8)).astype("f4") for t in TAGS}
        archive(d / f"S_{date}_a.zip", {"x/preview.txt.tif": np.zeros((6, 8), "u1"), **bands, "x/Scene_classification_map.tiff": np.array([[[0] * 8] * 6, [[160] * 8] * 6, [[0] * 8] * 6], "u1")}, GRID)
    return tmp_path


def test_scenes_are_read(spark, scene_dir):
    px = pipelines.with_classes(scenes.pixels(spark, f"{scene_dir}/d0", ("B04", "B08")))
    rows = px.collect()
    assert len(rows) == 48 and {r.scl for r in rows} == {4} and all(r.valid for r in rows)
    assert {(str(r.date_name), str(r.date_member)) for r in rows} == {("2020-06-01", "2020-06-02")}
    g = scenes.grids(spark, f"{scene_dir}/d0", TAGS).collect()
    assert len(g) == 8 and {(r.height, r.width, r.left, r.top, r.crs) for r in g} == {(6, 8, 100.0, 200.0, "EPSG:32635")}
    assert scenes.members(spark, f"{scene_dir}/d0").count() == 10


def test_missing_bands_and_odd_grids_fail(spark, scene_dir, tmp_path):
    with pytest.raises(Exception, match="B99"):
        scenes.pixels(spark, f"{scene_dir}/d0", ("B04", "B99")).collect()
    d = tmp_path / "odd"
    d.mkdir()
    archive(d / "a_2020-01-01.zip", {"B04.tif": np.zeros((2, 2), "f4"), "B08.tif": np.zeros((3, 2), "f4")}, GRID)
    with pytest.raises(Exception, match="not on the grid"):
        scenes.pixels(spark, str(d), ("B04", "B08")).collect()


def test_picking():
    assert scenes.picked(["xB04y.tif", "a_B04.tif", "b_B04_(Raw).tiff", "B04.png"], "B04") == "b_B04_(Raw).tiff"
    assert scenes.picked(["x.tif"], "B04") is None
    assert scenes.picked_scl(["a_scl.tif", "Scene_classification_map.tif"]) == "Scene_classification_map.tif"


def test_change_between_scenes(spark, scene_dir):
    one = lambda k: pipelines.with_classes(scenes.pixels(spark, f"{scene_dir}/d{k}", pipelines.CHANGE_BANDS))
    out = pipelines.bitemporal_change(one(0), one(1), pipelines.ChangeSettings(patches=(2,)))
    rows = out.collect()
    assert len(rows) == 48
    for r in rows:
        assert r.loss == (r.pre_keep and not r.post_keep and r.comparison_valid) and r.gain == (not r.pre_keep and r.post_keep and r.comparison_valid)
        assert r.pre_scl_clear and r.pre_clear and r.pre_white_r == r.pre_r and r.post_signdvi_a == 255 * r.post_keep
    written = sinks.geotiffs(out.withColumn("scene", out.y * 0).selectExpr("'s' as scene", "y", "x", "cast(loss as int) * 255 as loss"), f"{scene_dir}/tif", GRID, {"loss": "u1"}, nodata=0, compression="lzw").collect()
    r = geotiff.read(open(written[0].uri, "rb").read())
    assert {(int(y), int(x)) for y, x in np.argwhere(r.bands[0])} == {(q.y, q.x) for q in rows if q.loss}


def test_deforestation_report(spark):
    rng = np.random.default_rng(3)
    rows = [(y, x, *[float(v) for v in rng.random(6)], 4, 9 if x < 3 else 4) for y in range(12) for x in range(12)]
    px = spark.createDataFrame(rows, "y int, x int, pre_b04 float, pre_b08 float, pre_b12 float, post_b04 float, post_b08 float, post_b12 float, pre_scl int, post_scl int")
    out, report = pipelines.deforestation(px)
    r = report.first()
    assert r.n_valid == 144 and 0 <= r.pct_deforested <= 100 and out.count() == 144
    with pytest.raises(RuntimeError):
        pipelines.deforestation(px.where("y < 3"))


def test_envelopes_build_and_apply(spark):
    rng = np.random.default_rng(6)
    rows = [(f"S{s}", f"20{20 + s // 4}-0{1 + s % 4 * 2}-15", y, x, True, *[float(v) for v in rng.random(7)], 4) for s in range(8) for y in range(6) for x in range(6)]
    px = spark.createDataFrame(rows, "scene string, d string, y int, x int, valid boolean, b03 float, b04 float, b05 float, b08 float, b8a float, b11 float, b12 float, scl int").selectExpr("*", "cast(d as date) date")
    zones = spark.createDataFrame([(y, x, "A" if x < 3 else "B", "a" if x < 3 else "b") for y in range(6) for x in range(6)], "y int, x int, group_code string, group_label string")
    built = pipelines.build_envelopes(px, zones, pipelines.EnvelopeSettings(least=10))
    env = built["envelopes"]
    assert built["scene_quality"].count() == 8 and env.count() == 2 * 4 * 4 and built["coverage"].count() == 8
    from verdance.operators.envelope import with_all_forest

    got = pipelines.apply_envelopes(px, zones, with_all_forest(env))
    s = got["scene_summary"].collect()
    assert len(s) == 8 and all(r.keep_px + r.drop_px == r.n_grouped_valid_px == 36 and r.n_fallback_lookups == 0 and r.n_total_lookups == 8 for r in s)
    assert got["group_summary"].count() == 16 and got["pixels"].where("keep and votes < 2").count() == 0
    with pytest.raises(KeyError):
        pipelines.apply_envelopes(px, zones, env.where("group_code = 'A'"))


def test_geojson_and_workbook(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    layer = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:32635"}}, "features": [
        {"type": "Feature", "properties": {"ua": 7, "n": "x"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"ua": 8}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}, {"type": "Feature", "properties": {"ua": 9}, "geometry": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(layer))
    f = tables.geojson(spark, f"{tmp_path}/a.geojson")
    tables.require_crs(f)
    assert [(r.feature, r.properties["ua"], len(r.edges)) for r in f.orderBy("feature").collect()] == [(0, "7", 3), (1, "8", 6), (2, "9", 0)]
    lines = tables.geojson_lines(spark.createDataFrame([("q", '{"type":"Point","coordinates":[1,2]}')], "ua string, geometry string"), ["ua"]).first().value
    assert json.loads(lines)["geometry"]["coordinates"] == [1, 2]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda i, v: f'<c r="{"AB"[i]}{{n}}" t="inlineStr"><is><t>{v}</t></is></c>'
    row = lambda n, *v: f'<row r="{n}">' + "".join(cell(i, x).format(n=n) for i, x in enumerate(v) if x is not None) + "</row>"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="r1"/><sheet name="two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {ns}><sheetData>{row(1, 'q', 'r')}{row(2, '1', '2')}</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {ns}><sheetData>{row(1, 'ua', 'ha')}{row(2, '7', None)}{row(3, '8', '2.5')}</sheetData></worksheet>")
    (tmp_path / "w.xlsx").write_bytes(b.getvalue())
    cells = tables.workbook(spark, f"{tmp_path}/w.xlsx")
    assert tables.resolved_sheet(cells, ["ua"]) == "two" and tables.resolved_sheet(cells, ["ua"], "one") == "one"
    with pytest.raises(ValueError):
        tables.resolved_sheet(cells, ["missing"])
    assert [(r.ua, r.ha) for r in tables.sheet(cells, "two", ["ua", "ha"]).orderBy("nth").collect()] == [("7", None), ("8", "2.5")]


def test_csv_also_in_an_archive(spark, tmp_path):
    text = "a,b\n1,x\n2,\n"
    (tmp_path / "t.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("in/t.csv", text)
    for path, member in (("t.csv", None), ("t.zip", "in/t.csv")):
        assert [tuple(r) for r in tables.csv(spark, f"{tmp_path}/{path}", "a int, b string", member).orderBy("a").collect()] == [(1, "x"), (2, None)]


def test_bands_in_folders(spark, scene_dir, tmp_path):
    top = tmp_path / "open"
    for k in range(2):
        d = top / f"S_202{k}-06-01" / "bands"
        d.mkdir(parents=True)
        for t in ("B04", "B08"):
            (d / f"q_{t}_raw.TIF").write_bytes(geotiff.write(geotiff.Raster(np.full((1, 4, 5), k + 0.25, "f4"), np.ones((4, 5), bool), 1.0, 2.0, 1.0, -1.0, "EPSG:32635")))
    rows = scenes.pixels(spark, str(top), ("B04", "B08"), scenes.BAND_FILES).collect()
    assert {(r.scene, str(r.date_name), r.b04) for r in rows} == {("S_2020-06-01", "2020-06-01", 0.25), ("S_2021-06-01", "2021-06-01", 1.25)} and len(rows) == 40
    one = f"{top}/S_2020-06-01/bands"
    assert {r.scene for r in scenes.pixels(spark, one, ("B04",), scenes.BAND_FILES).collect()} == {"bands"}
    assert scenes.grid_of(spark, one, "B08", scenes.BAND_FILES) == Grid(4, 5, 1.0, 2.0, 1.0, -1.0, "EPSG:32635")
    with pytest.raises(ValueError):
        scenes.grid_of(spark, str(top), "B08", scenes.BAND_FILES)


def test_rules_of_band_names():
    names = ["xb04y.tif", "T_B04_(Raw).tiff", "z-b08.tif", "q_b08x_raw.tif", "B08.png"]
    assert [scenes.picked(names, "B04", r) for r in scenes.RULES] == ["T_B04_(Raw).tiff"] * 4
    assert [scenes.picked(names, "B08", r) for r in scenes.RULES] == ["z-b08.tif", "q_b08x_raw.tif", None, "q_b08x_raw.tif"]
    assert [scenes.picked(["ab08c.tif", "a-b08.tif"], "B08", r) for r in scenes.RULES] == ["a-b08.tif", "ab08c.tif", None, "a-b08.tif"]
    with pytest.raises(ValueError):
        scenes.picked(names, "B08", "any")


def test_headers_are_found_without_the_pixels():
    r = geotiff.Raster(np.random.default_rng(2).integers(0, 9, (1, 400, 500)).astype("u2"), np.ones((400, 500), bool), 3.0, 4.0, 2.0, -2.0, "EPSG:32635")
    data = geotiff.write(r, "none")  # the header is behind the pixels
    for d in (data, geotiff.write(geotiff.Raster(r.bands[:, :9, :9], r.valid[:9, :9], 3.0, 4.0, 2.0, -2.0, "EPSG:32635"))):
        assert geotiff.profile_of(io.BytesIO(d)).left == 3.0 and geotiff.profile_of(io.BytesIO(d)).bands.shape == geotiff.read(d).bands.shape


def test_predictors_and_matrices():
    import struct
    import zlib

    x = np.random.default_rng(3).random((6, 7)).astype("f4")
    planes = x.astype(">f4").view(np.uint8).reshape(6, 7, 4).transpose(0, 2, 1).reshape(6, -1)
    coded = np.diff(planes, axis=1, prepend=np.zeros((6, 1), np.uint8)).astype(np.uint8)

    def file(predictor: int, matrix: tuple) -> bytes:
        body = zlib.compress(coded.tobytes())
        at = 8 + len(body) + len(body) % 2
        tags = [(256, 4, 7), (257, 4, 6), (258, 3, 32), (259, 3, 8), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, 6), (279, 4, len(body)), (317, 3, predictor), (339, 3, 3)]
        rows = [struct.pack("<HHII", t, k, 1, v) for t, k, v in tags] + [struct.pack("<HHII", 34264, 12, 16, at + 2 + 12 * 12 + 4)]
        return b"II" + struct.pack("<HI", 42, at) + body.ljust(at - 8, b"\0") + struct.pack("<H", 12) + b"".join(rows) + bytes(4) + struct.pack("<16d", *matrix)

    r = geotiff.read(file(3, (2.0, 0, 0, 30.0, 0, -2.0, 0, 60.0, *[0] * 8)))
    assert (r.bands[0] == x).all() and (r.left, r.top, r.dx, r.dy) == (30.0, 60.0, 2.0, -2.0)
    with pytest.raises(ValueError, match="predictor"):
        geotiff.read(file(34892, (2.0, 0, 0, 30.0, 0, -2.0, 0, 60.0, *[0] * 8)))
    with pytest.raises(ValueError, match="rotated"):
        geotiff.read(file(3, (2.0, 0.5, 0, 30.0, 0, -2.0, 0, 60.0, *[0] * 8)))


def test_nan_is_null_and_scales_nothing(spark, tmp_path):
    for k in range(2):
        d = tmp_path / f"n{k}"
        d.mkdir()
        bands = {f"{t}.tif": np.full((10, 10), 0.3 if t != "B08" else 0.7, "f4") for t in TAGS}
        bands["B08.tif"][0, :3] = np.nan
        archive(d / f"S_202{k}-01-01.zip", bands, GRID)
    one = lambda k: pipelines.with_classes(scenes.pixels(spark, f"{tmp_path}/n{k}", pipelines.CHANGE_BANDS))
    assert one(0).where("b08 is null").count() == 3 and one(0).where("isnan(b08)").count() == 0
    out = pipelines.bitemporal_change(one(0), one(1), pipelines.ChangeSettings(patches=(2,))).collect()
    assert sum(r.pre_keep_raw for r in out) == 97 and not any(r.loss for r in out)
    from verdance.functions import spectral

    raw = spark.createDataFrame([("s", float("nan") if i < 3 else 0.5) for i in range(100)], "scene string, b08 float")
    assert {r.b08 for r in spectral.autoscaled(raw, ["b08"], ["scene"]).where("not isnan(b08)").collect()} == {0.5}


def test_scenes_on_other_grids_are_aligned(spark, tmp_path):
    rng = np.random.default_rng(12)
    whole = {t: rng.random((12, 14)).astype("f4") for t in TAGS}
    pre, post = Grid(6, 8, 100.0, 200.0, 10.0, -10.0, "EPSG:32635"), Grid(12, 14, 82.0, 218.0, 10.0, -10.0, "EPSG:32635")
    for name, g, cut in (("pre", pre, {t: a[2:8, 2:10] for t, a in whole.items()}), ("post", post, whole)):
        (tmp_path / name).mkdir()
        archive(tmp_path / name / f"{name}_2020-01-01.zip", {f"{t}.tif": a for t, a in cut.items()}, g)
    out = tmp_path / "out"
    from verdance.plans import cli

    cli.main(["--pre", f"{tmp_path}/pre", "--post", f"{tmp_path}/post", "--outdir", str(out)])
    rows = spark.read.parquet(f"{out}/change").collect()
    assert len(rows) == 48 and not any(r.loss or r.gain for r in rows)  # the same land, however it is cut
    with pytest.raises(ValueError):
        cli.validated(spark, {"pre": "/path/to/scene.zip", "post": str(tmp_path)}, str(out))
    with pytest.raises(FileNotFoundError):
        cli.validated(spark, {"pre": f"{tmp_path}/none", "post": str(tmp_path)}, str(out))
    from verdance.functions.masks import Cleanup

    with pytest.raises(ValueError):
        Cleanup(dilate=-1)


def test_grids_of_other_systems_are_projected_or_refused(spark):
    from verdance.operators import grid

    px = spark.createDataFrame([(0, y, x, float(10 * y + x)) for y in range(6) for x in range(8)], "one int, y int, x int, v float")
    utm = Grid(6, 8, 500_000.0, 5_000_000.0, 1000.0, -1000.0, "EPSG:32635")
    corner = spark.range(1).select(*grid.reprojected(*utm.centre(grid.F.lit(2), grid.F.lit(3)), "EPSG:32635", "EPSG:4326")).first()
    degrees = Grid(1, 1, corner[0] - 1e-4, corner[1] + 1e-4, 2e-4, -2e-4, "EPSG:4326")
    assert [r.v for r in grid.nearest(px, utm, degrees, ["one"], ["v"]).collect()] == [23.0]
    with pytest.raises(ValueError, match="cannot project"):
        grid.nearest(px, utm, Grid(1, 1, 0.0, 0.0, 1.0, 1.0, "EPSG:3857"), ["one"], ["v"])


#: Recorded recommendations, one scene for each combination of reasons. clear_support_px, then the
#: fractions of clear, vegetation, snow, cloud, shadow and unclassified pixels, median NDVI and NDSI, recommendation, reasons.
RECORDED = (
    (125556, 0.6568, 0.6047, 0.0012, 0.0, 0.3419, 0.0458, 0.80338, -0.54963, "caution", "high_shadow_fraction"),
    (36598, 0.1915, 0.0212, 0.064, 0.3972, 0.3473, 0.1524, 0.43141, 0.356178, "caution", "low_clear_support;low_vegetation_support;high_shadow_fraction;high_unclassified_fraction;positive_ndsi_clear_pixels"),
    (191135, 0.9999, 0.9999, 0.0, 0.0, 0.0001, 0.0, 0.88484, -0.57390, "keep", "no_major_scene_quality_issue"),
    (73979, 0.387, 0.3868, 0.0, 0.613, 0.0, 0.0001, 0.80639, -0.44475, "caution", "low_clear_support"),
    (37384, 0.1956, 0.0, 0.523, 0.1546, 0.1268, 0.1824, 0.16735, 0.772851, "blacklist", "no_vegetation_and_snow_like_clear_pixels"),
    (87484, 0.4577, 0.1602, 0.2221, 0.0173, 0.3029, 0.2129, 0.46532, 0.174747, "caution", "low_clear_support;low_vegetation_support;snow_present;high_shadow_fraction;high_unclassified_fraction;positive_ndsi_clear_pixels"),
    (2721, 0.0142, 0.0142, 0.0, 0.9857, 0.0001, 0.0, 0.58597, -0.33694, "blacklist", "too_little_clear_support;cloud_dominated"),
    (73068, 0.3822, 0.2581, 0.0745, 0.0753, 0.4679, 0.1092, 0.68855, -0.17209, "caution", "low_clear_support;high_shadow_fraction;high_unclassified_fraction"),
    (149288, 0.781, 0.501, 0.1078, 0.0151, 0.0962, 0.2164, 0.60844, -0.48372, "caution", "snow_present;high_unclassified_fraction"),
    (173991, 0.9102, 0.6794, 0.0412, 0.0031, 0.0455, 0.162, 0.60465, -0.50332, "caution", "high_unclassified_fraction"),
    (88294, 0.4619, 0.4142, 0.0029, 0.0258, 0.5093, 0.0433, 0.72211, -0.53378, "caution", "low_clear_support;high_shadow_fraction"),
    (108552, 0.5679, 0.0672, 0.1219, 0.0, 0.3103, 0.0, 0.46189, 0.315265, "caution", "low_clear_support;low_vegetation_support;snow_present;high_shadow_fraction;positive_ndsi_clear_pixels"),
    (153889, 0.8051, 0.4551, 0.1417, 0.0, 0.0533, 0.0, 0.70732, -0.47181, "caution", "snow_present"),
)


def test_recorded_recommendations(spark):
    from verdance.operators import scenes as quality

    names = "clear_support_px long, clear_frac double, veg_frac double, snow_frac double, cloud_frac double, shadow_frac double, scl7_frac double, ndvi_med_clear double, ndsi_med_clear double, want string, why string"
    rows = quality.with_recommendation(spark.createDataFrame(RECORDED, names)).collect()
    assert [(r.recommendation, r.recommendation_reason) for r in rows] == [(r.want, r.why) for r in rows]
