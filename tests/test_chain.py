"""Names, ids, checks, ranks, the terrain step and image matching against plain statements."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.functions import naming
from skyfold.operators import checks, geolocation, matching, ranks, terrain
from skyfold.operators import raster as R

DATA = "/root/testdata/sf0.001"


def test_time_pictures():
    assert naming.time_picture("%Y-%m-%d %H:%M:%S.%f") == "YYYY-MM-DD HR:MN:SC.######::RND ::UTC"
    assert naming.time_picture("100%% %j") == "100% DOY::RND ::UTC"
    for bad in ("%f", "%z", "%U %Y", "%M.%f"):
        with pytest.raises(ValueError):
            naming.time_picture(bad)


def test_errors_names_and_circular_frames(spark):
    df = spark.createDataFrame([("SPICE(NOFRAMECONNECT)", "sxform"), ("UNPARSEDTIME", ""), ("odd", None), (None, None)], "short string, routine string")
    got = [tuple(r) for r in df.select(naming.error_class(F.col("short")), naming.error_message(F.col("short"), F.col("routine"))).collect()]
    assert [g[0] for g in got] == ["coverage", "bad_time", "other", "other"]
    assert got[0][1].endswith("[SPICE(NOFRAMECONNECT) in sxform]") and got[3][1].endswith("[SPICE(UNKNOWN)]")
    bodies = spark.createDataFrame([("EARTH", 399, "ITRF93"), ("SAT", -100, None)], "name string, id long, frame string")
    frames = spark.createDataFrame([("ITRF93", 13000, 2, 3000, None), ("earth", 5, 1, 5, None), ("A", 1, 4, 0, 2), ("B", 2, 4, 0, 3), ("C", 3, 4, 0, 13000)], "name string, id long, class int, class_id long, alias_of long")
    names = spark.createDataFrame([("earth",), ("itrf93",), ("none",)], "name string")
    assert {r.name: (r.kind, r.id) for r in naming.body_or_frame(names, bodies, frames).collect()} == {"earth": ("body", 399), "itrf93": ("frame", 13000), "none": (None, None)}
    assert {r.name: r.frame_id for r in naming.object_frames(names, bodies, frames).collect()} == {"earth": 13000, "itrf93": None, "none": None}
    assert {r.frame_id: r.class_id for r in naming.frame_class_ids(frames).collect()} == {13000: 3000, 5: 5, 1: 3000, 2: 3000, 3: 3000}
    round_ = spark.createDataFrame([("A", 1, 4, 0, 2), ("B", 2, 4, 0, 1)], "name string, id long, class int, class_id long, alias_of long")
    with pytest.raises(Exception, match="circular"):
        naming.frame_class_ids(round_).collect()


def test_checks_and_settings(spark):
    df = spark.createDataFrame([(1, 0.1, 0.1, 1.0, 1.0, 0.0)], "measurement int, lat_error_deg double, lon_error_deg double, gcp_lat_deg double, gcp_lon_deg double, gcp_alt double")
    checks.check_matches(df)
    for bad in (lambda: checks.check_matches(df.drop("measurement")), lambda: checks.check_error_input(df), lambda: checks.check_telemetry(df.limit(0)), lambda: checks.check_science(df, "time"), lambda: checks.need_key(" "), lambda: checks.calibration_files("a", None), lambda: checks.need_match_inputs(None, False), lambda: checks.check_regrid((2, 2), (0.1, 0.1), None), lambda: checks.check_regrid(None, None, (1, 0, 0, 1)), lambda: checks.variable_name({}, "boresight"), lambda: checks.load_settings('{"other": {}}'), lambda: checks.load_settings('{"sweep": {"strategy": "x"}}'), lambda: checks.load_settings('{"setup": {"percent": 101}}')):
        with pytest.raises(ValueError):
            bad()
    for bad in ("x", None, True, [1, 2]):
        with pytest.raises(TypeError):
            checks.scalar_nominal(bad)
    assert checks.scalar_nominal([2]) == 2.0 and checks.calibration_files(None, None) is None
    setup, sweep, output = checks.load_settings(json.dumps({"setup": {"threshold_m": 100}, "output": {"path": "p", "threshold_m": 7}}))
    assert (setup.threshold_m, sweep.strategy, output.path, output.threshold_m) == (100, "random", "p", 100)
    assert checks.load_section('{"sweep": {"iterations": 3}}', "sweep").iterations == 3
    assert checks.result_attributes("dir/Base Frame_v03.attitude.ck.json", "constant") | {} == {"name": "param_base_frame_v03_attitude_ck", "units": "arcsec", "long_name": "base frame v03 attitude ck"}
    assert checks.result_name("x/cube_v01.json") == "cube"


def test_percentiles_and_numbers(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(size=3000).round(2).tolist(), *[0.5] * 2000]
    rows = [(i % 3 if i % 7 else None, v) for i, v in enumerate(values)] + [(9, None), (8, 1.0), (7, math.nan), (7, 2.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.percentiles for r in ranks.percentiles(ranks.value_counts(df, "v", ["k"]), shares, ["k"]).collect()}
    for k in (None, 0, 1, 2, 8):
        own = [v for kk, v in rows if kk == k and v is not None]
        assert np.allclose(got[k], np.percentile(own, [100 * s for s in shares])), k
    assert 9 not in got and got[7][0] == 2.0 and math.isnan(got[7][-1])
    assert ranks.percentiles(ranks.value_counts(df.limit(0), "v", []), shares).count() == 0
    nums = ranks.numbered(df.where("v is not null and not isnan(v)"), "v", "n").collect()
    assert sorted(r.n for r in nums) == list(range(len(nums))) and [r.v for r in sorted(nums, key=lambda r: r.n)] == sorted(r.v for r in nums)


def test_nearest_entries(spark):
    rng = np.random.default_rng(2)
    entries = [(f"e{i:03d}", float(x)) for i, x in enumerate(rng.uniform(0, 10, 40).round(1))]
    points = [(i, float(x)) for i, x in enumerate(rng.uniform(-3, 13, 500).round(1))]
    got = R.nearest_entry(spark.createDataFrame(points, "id int, a double"), spark.createDataFrame(entries, "name string, fa double"), "a", "fa", "id", "name").collect()
    want = {i: min(abs(x - a) for _, x in entries) for i, a in points}
    by, at = dict(entries), dict(points)
    assert len(got) == len(points) and all(abs(abs(by[r.name] - at[r.id]) - want[r.id]) < 1e-9 for r in got)


def test_terrain_query_meets_the_ground(spark):
    """Nearly all points are corrected; each lies on its line of sight, at the height of the ground there."""
    from skyfold.plans.catalog import QUERIES

    rows = QUERIES["terrain_correction"](spark, DATA).collect()
    good = [r for r in rows if r.qf == 0]
    assert len(good) > 0.95 * len(rows)
    near = 0
    for r in good:
        i, j = int(90.0 - r.lat + 0.5), int((r.lon + 180.0) + 0.5)
        ground = 1.0 + math.sin(i / 9.0) + math.cos(j / 7.0)
        near += abs(ground - r.alt) < 0.05
    assert near > 0.9 * len(good)


def test_march_refuses_a_start_below_all_ground():
    far = np.array([[9000.0, 0.0, 0.0]])
    out, flags = terrain.march(far, far * 1.1, lambda lon, lat: np.zeros(len(lon)), 0.0, 1.0)
    assert np.isnan(out).all() and flags[0] != 0


def test_terrain_step_of_the_chain(spark):
    """Good rows move up their line of sight to flat ground of 2 km; a row without data keeps its flag."""
    from skyfold.functions import geodesy as G

    base = spark.createDataFrame([(1, 1, 10.0, 20.0, 0), (2, 1, 30.0, -40.0, 0), (3, 1, 30.0, -40.0, 2)], "ugps long, pixel int, lon double, lat double, qf long")
    ground = G.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.lit(0.0))
    sat = G.geodetic_to_ecef(F.col("lon") + 1.0, F.col("lat"), F.lit(500.0))
    rows = base.withColumn("alt", F.lit(0.0)).withColumns({f"g{a}": c for a, c in zip("xyz", ground)} | {f"p{a}": c for a, c in zip("xyz", sat)})
    got = {r.ugps: r for r in geolocation.on_terrain(rows, np.full((180, 360), 2.0), -180.0, 90.0, 1.0).collect()}
    assert all(abs(got[k].alt - 2.0) < 1e-3 and got[k].qf == 0 and got[k].lon > (10.0, 30.0)[k - 1] for k in (1, 2))
    assert got[3].alt == 0.0 and got[3].qf == 2


def test_elevation_regions(spark):
    cells = spark.createDataFrame([(179.5, 0.0, 5.0), (-179.5, 0.0, -32768.0), (0.0, 0.0, 7.0)], "lon double, lat double, height double")
    assert sorted(map(tuple, geolocation.region(cells, 179.0, -179.0, -1.0, 1.0).collect())) == [(179.5, 0.0, 5.0), (180.5, 0.0, 0.0)]
    other = spark.createDataFrame([(0.0, 0.0, 9.0), (1.0, 0.0, 3.0)], "lon double, lat double, height double")
    assert {(r.lon, r.height) for r in geolocation.mosaic(other, cells).collect()} >= {(0.0, 9.0), (1.0, 3.0), (179.5, 5.0)}
    assert tuple(geolocation.region_range(other).first()) == (3.0, 9.0)
    geoid = spark.createDataFrame([(i, j, float(i + 10 * j)) for i in range(4) for j in range(4)], "ix int, iy int, height double")
    h = spark.createDataFrame([(1, 0.5, 9.5, 100.0), (2, 0.0, 10.0, 100.0), (3, 50.0, 0.0, 100.0)], "id int, lon double, lat double, height double")
    assert {r.id: r.height for r in geolocation.height_above_ellipsoid(h, geoid, 1.0, 0.0, 10.0).collect()} == {1: 105.5, 2: 100.0, 3: None}


def test_position_columns_and_fallback(spark):
    assert matching.position_columns(["t", "r_x", "r_y", "r_z"]) == ["r_x", "r_y", "r_z"]
    assert matching.position_columns(["my_pos1", "POS2", "r_9", "q"]) == ["my_pos1", "POS2", "r_9"]
    for bad in (["a"], ["pos"]):
        with pytest.raises(ValueError):
            matching.position_columns(bad)
    df = spark.createDataFrame([(1, 0.0, 90.0, None, None, None), (2, 0.0, 0.0, 0.0, 0.0, 7e6)], "image_id int, lat double, lon double, sx double, sy double, sz double")
    a, b = sorted(matching.nadir_fallback(df, 400000.0).collect())
    assert abs(a.sy - (6378137.0 + 400000.0)) < 1e-6 and abs(a.by + 1) < 1e-12 and (b.sz, b.bz) == (7e6, -1.0)


def test_grids(spark):
    b = spark.createDataFrame([(1, 0.0, 1.0, 10.0, 10.5)], "image_id int, min_lon double, max_lon double, min_lat double, max_lat double")
    got = matching.regular_grid(b, "image_id", resolution=(0.25, 0.25)).collect()
    assert len(got) == 15 and {(r.lat, r.lon) for r in got if (r.gi, r.gj) == (0, 4)} == {(10.5, 1.0)}
    assert matching.regular_grid(b, "image_id", size=(2, 3)).count() == 6
    for more in ({}, {"size": (2, 2), "resolution": (1.0, 1.0)}):
        with pytest.raises(ValueError):
            matching.regular_grid(b, "image_id", **more)


def test_the_whole_match_finds_a_planted_shift(spark):
    """A smooth scene seen 0.3 km north and 0.2 km west of its place, through a narrow point spread: found within 0.05 km, correlation near 1."""
    lat0, lon0, n = 10.0, 20.0, 41
    step = 0.001
    la, lo = np.meshgrid(lat0 - (np.arange(n) - n // 2) * step, lon0 + (np.arange(n) - n // 2) * step, indexing="ij")
    scene = lambda a, b: np.sin((a - lat0) * 300) + np.cos((b - lon0) * 260 + (a - lat0) * 150) + np.exp(-((a - lat0 - 0.004) ** 2 + (b - lon0 + 0.003) ** 2) / 2e-5)
    d_lat, d_lon = 0.3 / 111.0, -0.2 / 111.0
    m = 15
    ia, io = np.meshgrid(lat0 - (np.arange(m) - m // 2) * step, lon0 + (np.arange(m) - m // 2) * step, indexing="ij")
    sat = matching._ecef_km(lon0, lat0, 500_000.0) * 1000
    up = sat / np.linalg.norm(sat)
    east = np.cross([0, 0, 1.0], up)
    east /= np.linalg.norm(east)
    north = np.cross(up, east)
    ground = np.array([matching._ecef_km(io[m // 2, k], ia[m // 2, k], 0.0) * 1000 for k in range(m)])
    rays = (ground - sat) / np.linalg.norm(ground - sat, axis=1)[:, None]
    sight = rays @ np.stack([north, east, -up], 1)
    angles = np.linspace(-0.0004, 0.0004, 5)
    spread = matching.Spread(np.outer([1, 4, 9, 4, 1], [1, 4, 9, 4, 1]).astype(float), angles, angles)
    data, plat, plon = matching.project([spread], sat, sight, ia, io)
    assert data.shape == plat.shape == (5, 5) and abs(plat.mean() - lat0) < 1e-3 and abs(plon.mean() - lon0) < 1e-3
    pair = (1, scene(ia + d_lat, io + d_lon).tolist(), ia.tolist(), io.tolist(), scene(la, lo).tolist(), la.tolist(), lo.tolist(), *sat.tolist())
    bad = (2, [[1.0]], [[1.0]], [[1.0]], [[1.0]], [[1.0]], [[1.0]], *sat.tolist())
    kind = "array<array<double>>"
    df = spark.createDataFrame([pair, bad], f"pair_id long, img_data {kind}, img_lat {kind}, img_lon {kind}, gcp_data {kind}, gcp_lat {kind}, gcp_lon {kind}, px double, py double, pz double")
    how = R.Search(grid_span_km=2.0, steps=12, last_spacing_km=0.02)
    got = {r.pair_id: r for r in matching.match(df, sight, [spread], how).collect()}
    assert got[2].error and got[2].ccv is None
    r = got[1]
    assert r.error is None and r.ccv > 0.97 and abs(r.lat_error_km + 0.3) < 0.05 and abs(r.lon_error_km - 0.2 * np.cos(np.radians(lat0))) < 0.05, r
    with pytest.raises(ValueError):
        matching.project([], sat, sight, ia, io)


def test_motion_draws_the_spread_along_itself():
    """A narrow round spread under an image that moves north, east or north-east: wide along the motion, as before across it."""
    la, lo = np.meshgrid(np.linspace(-0.001, 0.001, 21), np.linspace(-0.001, 0.001, 21), indexing="ij")
    spread = np.exp(-(la**2 + lo**2) / (2 * 0.0004**2))
    for v, u in ((0.004, 0.0), (0.0, 0.004), (0.003, 0.003), (-0.003, 0.003)):
        steps = np.arange(5)[None, :]
        data, y, x = matching.moved(spread, la, lo, np.ones((3, 1)) * steps * v, np.ones((3, 1)) * steps * u, 1e-4, 1e-4)
        w, (gy, gx) = data / data.sum(), np.meshgrid(y, x, indexing="ij")
        my, mx = (w * gy).sum(), (w * gx).sum()
        along, across = (np.array([v, u]) / np.hypot(u, v)), (np.array([-u, v]) / np.hypot(u, v))
        spread_along, spread_across = (np.sqrt((w * ((gy - my) * a[0] + (gx - mx) * a[1]) ** 2).sum()) for a in (along, across))
        assert spread_across < 0.00055 and spread_along > 1.5 * spread_across, (v, u, spread_along, spread_across)


def test_repeated_rows_stay_as_they_are(spark):
    """Equal points, ids with several heights and equal (ugps, pixel) rows come back once each."""
    cells = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(4) for j in range(4)], "row int, col int, value double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 9.0, 9.0), (2, 9.0, 9.0), (3, 1.0, 2.0)], "id int, r double, c double")
    got = sorted((r.id, r.value) for r in R.bilinear_at(points, cells).collect())
    assert got == [(1, 5.5), (1, 5.5), (2, 0.0), (2, 0.0), (3, 12.0)]
    geoid = spark.createDataFrame([(i, j, 5.0) for i in range(4) for j in range(4)], "ix int, iy int, height double")
    heights = spark.createDataFrame([(1, 0.5, 9.5, 10.0), (1, 0.5, 9.5, 10.0), (1, 0.7, 9.2, 20.0), (2, 0.5, 9.5, 1.0)], "id int, lon double, lat double, height double")
    assert sorted(r.height for r in geolocation.height_above_ellipsoid(heights, geoid, 1.0, 0.0, 10.0).collect()) == pytest.approx([6.0, 15.0, 15.0, 25.0])
    ray = dict(ugps=1, pixel=1, gx=6378.137, gy=0.0, gz=0.0, px=7000.0, py=100.0, pz=50.0, lon=0.0, lat=0.0, alt=0.0, qf=0)
    rows = spark.createDataFrame([ray, ray, ray | {"qf": 4}], "ugps long, pixel int, gx double, gy double, gz double, px double, py double, pz double, lon double, lat double, alt double, qf long")
    out = geolocation.on_terrain(rows, np.full((18, 36), 1.0), -180.0, 90.0, 10.0).collect()
    assert len(out) == 3 and sorted(round(r.alt, 3) for r in out) == [0.0, 1.0, 1.0] and sorted(r.qf for r in out) == [0, 0, 4]
