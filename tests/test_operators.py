"""Golden values and edge cases of operators; the SQL comparisons are in test_oracles.py."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from skyfold.functions import geodesy as G
from skyfold.functions import timeconv as T
from skyfold.functions import vec as V
from skyfold.functions.vec import Vec
from skyfold.operators import ephemeris, errorstats, geometry, intervals, pairing, raster, segments, sweep, terrain
from skyfold.sources import readers, writers

A, B = 6378.137, 6356.752314245


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_times(spark):
    df = spark.createDataFrame([("1980-01-06", 0), ("2015-07-01 12:00:00", 1119787217000000), ("2024-11-13", 1415491218000000)], "utc string, ugps long")
    for r in df.select("ugps", T.adapt(F.col("utc"), "iso", "ugps").alias("u"), T.adapt(F.col("ugps"), "ugps", "utc").alias("t"), "utc", T.adapt(F.col("ugps"), to="et").alias("et")).collect():
        assert r.u == r.ugps and r.t.startswith(r.utc)
    assert r.et == pytest.approx(784728069.1827033, abs=1e-6)
    during = one(spark, u=T.utc_to_ugps(F.lit("2015-06-30 23:59:60.000001")), v=T.utc_to_ugps(F.lit("2015-06-30 23:59:60.999999")), w=T.utc_to_ugps(F.lit("nonsense")))
    ceil = spark.createDataFrame([(during.u,), (during.v,)], "u long").select(T.ugps_to_dt64(F.col("u")).cast("string")).collect()
    assert [r[0] for r in ceil] == ["2015-07-01 00:00:00"] * 2 and during.w is None
    assert T.path(T.GRAPH, "ugps", "ugps") == [] and len(T.path(T.GRAPH, "utc", "utc")) == 2
    with pytest.raises(ValueError):
        T.adapt(F.lit(1))
    with pytest.raises(ValueError):
        T.adapt(F.lit(1), "nothing", "et")


def test_every_format_to_every_other(spark):
    start = spark.createDataFrame([(1119787217000000,)], "u long")
    base = start.select(*[T.adapt(F.col("u"), "ugps", a).alias(a) for a in T.GRAPH]).first()
    here = start.select(*[F.lit(base[a]).cast("timestamp_ntz" if a == "dt64" else {int: "long", float: "double", str: "string"}[type(base[a])]).alias(a) for a in T.GRAPH])
    for a in ("ugps", "et", "utc", "dt64", "tai", "jd", "tsis1"):
        got = here.select(*[T.adapt(F.col(a), a, b).alias(b) for b in T.GRAPH]).first()
        for b in T.GRAPH:
            if isinstance(base[b], (int, float)):
                assert got[b] == pytest.approx(base[b], rel=1e-13, abs=60 if b == "ugps" else 1e-9), (a, b)


def test_rays(spark):
    c = math.cos(math.radians(45))
    cases = [((-1, 0, 0), (7000, 0, 0), (A, 0, 0), (0, 0)), ((c, c, 0), (-7000, -7000, 0), (-A * c, -A * c, 0), (-135, 0)), ((0, 0, 1), (0, 0, -7000), (0, 0, -B), (0, -90)), ((1, 0, 0), (7000, 0, 0), None, None), ((0, 1, 0), (7000, 0, 0), None, None)]
    df = spark.createDataFrame([tuple(map(float, (*v, *p))) for v, p, _, _ in cases], "vx double, vy double, vz double, px double, py double, pz double")
    at = df.select(*G.intersect_ellipsoid(Vec.columns("v"), Vec.columns("p")).named("")).select("*", *[x.alias(n) for x, n in zip(G.surface_lon_lat(Vec.columns("")), ("lon", "lat", "alt"))]).collect()
    for r, (_, _, xyz, ll) in zip(at, cases):
        if xyz is None:
            assert all(map(math.isnan, (r.x, r.y, r.z, r.lat, r.alt)))
        else:
            assert (r.x, r.y, r.z) == pytest.approx(xyz, abs=1e-9) and (r.lon, r.lat) == pytest.approx(ll, abs=1e-9) and r.alt == 0


def test_geodetic_round_trip_and_poles(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(rng.uniform(-180, 180, 200), rng.uniform(-90, 90, 200), rng.uniform(-5, 40000, 200))] + [(0.0, 90.0, 5.0), (0.0, -90.0, 0.0)]
    df = spark.createDataFrame(rows, "lon double, lat double, alt double")
    df = df.select("*", *G.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.col("alt")).named(""))
    for r in df.select("lon", "lat", "alt", *[c.alias(n) for c, n in zip(G.ecef_to_geodetic(Vec.columns("")), ("a", "b", "c"))]).collect():
        assert (r.b, r.c) == pytest.approx((r.lat, r.alt), rel=1e-11, abs=1e-8) and (abs(r.lat) == 90 or r.a == pytest.approx(r.lon, rel=1e-12))


def test_rotations(spark):
    rng = np.random.default_rng(2)
    for sequence in [(1, 2, 3), (3, 2, 1), (3, 1, 2), (1, 3, 2), (2, 3, 1), (2, 1, 3), (3, 1, 3), (1, 2, 1), (2, 1, 2), (1, 3, 1)]:
        a = rng.uniform(0.1, 1.4, 3)
        m = V.product(V.product(V.about(sequence[0], F.lit(a[0])), V.about(sequence[1], F.lit(a[1]))), V.about(sequence[2], F.lit(a[2])))
        flat = spark.range(1).select(*[c.alias(f"m{i}") for i, c in enumerate(c for row in m for c in row)]).first()
        df = spark.createDataFrame([tuple(flat)], ", ".join(f"m{i} double" for i in range(9)))
        mm = V.matrix([F.col(f"m{i}") for i in range(9)])
        q = V.quaternion(mm)
        got = df.select(*[c.alias(f"e{i}") for i, c in enumerate(V.euler(mm, sequence))], *[c.alias(f"q{i}") for i, c in enumerate(q)], "*")
        got = spark.createDataFrame([tuple(got.first())], got.schema)
        back = got.select("*", *[c.alias(f"b{i}") for i, c in enumerate(c for row in V.rotation([F.col(f"q{i}") for i in range(4)]) for c in row)]).first()
        assert [back[f"e{i}"] for i in range(3)] == pytest.approx(list(a), abs=1e-9), sequence
        assert [back[f"b{i}"] for i in range(9)] == pytest.approx([back[f"m{i}"] for i in range(9)], abs=1e-9)
    with pytest.raises(ValueError):
        V.euler(V.about(1, F.lit(0.1)), (1, 1, 2))


def test_geometry_registry(spark):
    s = spark.createDataFrame([(i * 1_000_000, 7000.0, 0.0, 0.0, -math.cos(math.radians(i * 30)), math.sin(math.radians(i * 30)), 0.0) for i in range(4)], "ugps long, sc_x double, sc_y double, sc_z double, bs_x double, bs_y double, bs_z double")
    got = geometry.get_geometry(s, ["cone_angle", "cone_angle_rate", "viewing_zenith", "sc_altitude"]).orderBy("ugps").collect()
    assert [r.cone_angle for r in got] == pytest.approx([0, 30, 60, 90], abs=1e-6) and [r.cone_angle_rate for r in got] == pytest.approx([30] * 4, abs=1e-6)
    assert got[0].viewing_zenith == pytest.approx(0, abs=1e-5) and math.isnan(got[3].viewing_zenith) and got[0].spacecraft_altitude == pytest.approx(7000 - A)
    assert len(geometry.FIELDS) == 24 and geometry.DEFAULT == ["sc_radius", "subsatellite", "subsolar", "earth_sun_distance", "sc_position", "sc_altitude", "sc_velocity"]
    assert geometry.providers(["cone_angle", "subsolar"]) == ["boresight", "sc_state", "sun_position"]
    with pytest.raises(KeyError):
        geometry.get_geometry(s, ["no_such_field"])


def test_coverage_windows(spark):
    rows = [("a1", "SPK", 1, 0, 2000), ("a2", "SPK", 1, 3000, 4000), ("b", "SPK", 2, 1000, 3500), ("c", "SPK", 1, 1500, 2500), ("u", "TEXT", 3, 10, 20), ("p", "PCK", 9, 500, 3600)]
    cat = spark.createDataFrame(rows, "file string, ktype string, object_id int, start long, stop long")
    few = cat.where("file <> 'c'")
    windows = lambda df: sorted((r.start, r.stop) for r in df.collect())
    assert windows(intervals.object_coverage(few).where("object_id = 1")) == [(0, 2000), (3000, 4000)]
    assert windows(intervals.object_coverage(cat).where("object_id = 1")) == [(0, 2500), (3000, 4000)]
    assert windows(intervals.valid_window(few, [1, 2])) == windows(intervals.valid_window(few, [1, 2, 9])) == [(1000, 2000), (3000, 3500)]
    touching = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 11, 12)], "k int, start long, stop long")
    assert windows(intervals.merge(touching, ["k"])) == [(0, 9), (11, 12)]
    ask = lambda a, b: spark.createDataFrame([(1, a, b)], "k int, start long, stop long")
    assert windows(intervals.gaps(touching, ask(-3, 20), ["k"])) == [(-3, 0), (9, 11), (12, 20)]
    assert windows(intervals.gaps(touching, ask(1, 4), ["k"])) == [] and windows(intervals.gaps(touching, ask(20, 30), ["k"])) == [(20, 30)]
    with pytest.raises(Exception, match="stops before"):
        intervals.gaps(touching, ask(5, 1), ["k"]).collect()


def test_error_statistics_edges(spark):
    df = spark.createDataFrame([(100.0,), (250.0,), (float("nan"),), (249.9,)], "nadir_equiv_error_m double")
    assert errorstats.verdict(df, errorstats.Requirement(250, 50)).first().passed and not errorstats.verdict(df, errorstats.Requirement(250, 50.1)).first().passed
    none = errorstats.verdict(df.limit(0)).first()
    assert (none.passed, none.percent_within) == (False, 0.0)
    kept = errorstats.filter_correlation(spark.createDataFrame([(0.5,), (float("nan"),), (0.4,)], "ccv double"), 0.5)
    assert [r.ccv for r in kept.collect()] == [0.5]
    nadir = spark.createDataFrame([(0.001, 0.001, 0.0, 0.0, [6798137.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [float(i % 4 == 0) for i in range(9)])], "lat_error_deg double, lon_error_deg double, gcp_lat_deg double, gcp_lon_deg double, position array<double>, boresight array<double>, rotation array<double>")
    assert math.isnan(errorstats.nadir_equivalent(nadir).first().nadir_equiv_error_m)


def test_segments(spark):
    df = spark.createDataFrame([(1, 0), (1, 10_000_000), (1, 39_999_999), (1, 69_999_999), (2, 5)], "k int, t long")
    assert [r.segment for r in segments.split_at_gaps(df, ["k"], "t", 30_000_000).orderBy("k", "t").collect()] == [0, 0, 0, 1, 0]
    lone = segments.rates(df.withColumn("v", F.lit(1.0)), ["k"], ["t"], "t", "v", "rate").where("k = 2").first()
    assert math.isnan(lone.rate)
    angle = spark.createDataFrame([(1, i * 1_000_000, float((350 + 10 * i) % 360)) for i in range(5)], "k int, t long, v double")
    assert [r.rate for r in segments.rates(angle, ["k"], ["t"], "t", "v", "rate", unwrap_degrees=True).collect()] == pytest.approx([10] * 5)


def test_frames():
    graph = {"cam": "body", "body": "j2000", "itrf": "j2000"}
    assert ephemeris.frame_path(graph, "cam", "itrf") == [("cam", True), ("body", True), ("itrf", False)]
    with pytest.raises(ValueError):
        ephemeris.frame_path(graph, "cam", "mars")


def test_polygons(spark):
    square = [(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (0, 4), (4, 4), (4, 0))]
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 2.0, 2.0), (-3.0, 0.0, -3.0), (7.0, 8.0, -5.0)], "x double, y double, d double")
    for r in df.withColumn("got", pairing.signed_distance((F.col("x"), F.col("y")), square)).collect():
        assert r.got == pytest.approx(r.d)
    assert one(spark, d=pairing.segment_distance((F.lit(3.0), F.lit(4.0)), (F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0)))).d == 5


def test_image_match_recovers_shifts():
    lat, lon = np.meshgrid(np.linspace(1, 0, 60), np.linspace(0, 1, 60), indexing="ij")
    data = np.sin(lat * 9) + np.cos(lon * 7 + lat * 5) + np.sin(lat * lon * 20)
    inner = slice(20, 40)
    for dlat, dlon in ((0.02, -0.03), (-0.017, 0.011)):
        image = (raster.sample_bilinear(data, lat[:, 0], lon[0], lat[inner, inner] + dlat, lon[inner, inner] + dlon), lat[inner, inner], lon[inner, inner])
        got = raster.search_shift((data, lat, lon), image, raster.Search(grid_span_km=11.0, steps=16, last_spacing_km=0.05))
        assert got[:2] == pytest.approx((dlat, dlon), abs=0.05 / 111 * 2) and got[2] > 0.999
    assert len(raster.Search().rounds()) == 15 and min(raster.Search().rounds()) > 0.01
    with pytest.raises(ValueError):
        raster.ascending(np.array([0.0, 1.0, 1.0]))


def test_image_match_search_tries_all_shifts(spark):
    """The query's first pairs, against every shift of 44 x 44 in 15 rounds down to 10 m, one at a time, from the north-west on."""
    from skyfold.plans.rasters import image_match_search

    e = {r.vec_id: np.array(r.embedding, float).reshape(8, 8) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").limit(2).collect()}
    got = {r.pair_id: r for r in image_match_search(spark, "/root/testdata/sf0.001").where(F.col("pair_id").isin(list(e))).collect()}
    axis = np.arange(8) * 0.02
    lat, lon = np.meshgrid(axis + 0.004, axis + 0.004, indexing="ij")
    for i, data in e.items():
        centre, spacing = (0.0, 0.0), 11.0 / 43
        for _ in range(15):
            step = np.degrees(spacing / 6378.137)
            tried = [(raster.correlation(data, raster.sample_bilinear(data, axis, axis, lat + centre[0] - k * step, lon + centre[1] + m * step)), -k, -m) for k in range(-22, 22) for m in range(-22, 22)]
            ccv, k, m = max(tried)
            centre, spacing = (centre[0] + k * step, centre[1] - m * step), spacing * 0.8
        assert (got[i].lat_shift_deg, got[i].lon_shift_deg, got[i].ccv) == pytest.approx((*centre, ccv), abs=1e-9)


def test_regrid_snaps_to_the_nearest_cell_of_large_images(spark):
    """A plane on 60 x 60 skewed points is carried on beyond them; 8 x 8 points (image 2) give the fill there."""
    rows = [(image, i, j, j + 0.03 * i, i + 0.05 * j) for image, n in ((1, 60), (2, 8)) for i in range(n) for j in range(n)]
    cells = spark.createDataFrame([(*r, 2 * r[3] + 3 * r[4]) for r in rows], "image_id long, row int, col int, lon double, lat double, value double")
    points = [(0, 0, 10.2, 10.1), (0, 1, -0.2, 5.3), (1, 0, 30.0, -0.7), (1, 1, 70.0, 70.0), (2, 0, float("nan"), 1.0)]
    grid = spark.createDataFrame([(image, *p) for image in (1, 2) for p in points], "image_id long, gi int, gj int, lon double, lat double")
    got = {(r.image_id, r.gi, r.gj): r.value for r in raster.regrid(cells, grid, 1.0).collect()}
    assert len(got) == 10 and all(got[1, gi, gj] == pytest.approx(2 * lon + 3 * lat) for gi, gj, lon, lat in points[:4])
    assert math.isnan(got[1, 2, 0]) and all(math.isnan(got[2, gi, gj]) for gi, gj, *_ in points)
    near = {(r.gi, r.gj): r.value for r in raster.regrid(cells, grid, 1.0, method="nearest").where("image_id = 1").collect()}
    assert near[1, 1] == pytest.approx(2 * (59 + 0.03 * 59) + 3 * (59 + 0.05 * 59))


def test_raster_kernels():
    rng = np.random.default_rng(1)
    image, kernel = rng.random((9, 7)), rng.random((3, 5))
    want = np.array([[sum(kernel[a, b] * image[i + 1 - a, j + 2 - b] for a in range(3) for b in range(5) if 0 <= i + 1 - a < 9 and 0 <= j + 2 - b < 7) for j in range(7)] for i in range(9)])
    assert raster.convolve_same(image, kernel) == pytest.approx(want)
    assert raster.correlation(np.ones((3, 3)), image[:3, :3]) == 0.0 and raster.correlation(image, 2 * image + 1) == pytest.approx(1)
    psf = np.zeros((7, 7))
    psf[1, 5] = 2.0
    padded = raster.pad_to_centroid(psf)
    assert [raster.centroid(padded.sum(1 - a)) for a in (0, 1)] == [(n - 1) / 2 for n in padded.shape]
    assert raster.normalize(psf).sum() == 1 and raster.motion_blur(np.eye(5), 1) == pytest.approx(np.eye(5))
    with pytest.raises(ValueError):
        raster.centroid(np.zeros(3))


def test_terrain():
    surface = np.array([[A, 0, 0], [A, 0.1, 0], [A, 0.2, 0.1], [np.nan, 0, 0]])
    satellite = np.array([[A + 420, 420, 0], [A + 420, 420, 0], [A, A, 0], [A, A, 0]], float)
    out, flags = terrain.march(surface, satellite, lambda lon, lat: np.full(len(lon), 1.6), -0.1, 9.0)
    assert out[0] == pytest.approx([0.014368, 0.0, 1.6], rel=1e-4, abs=1e-9) and out[1][2] == pytest.approx(1.6, rel=1e-4)
    assert flags.tolist() == [0, 0, 0x400, 0x1000] and np.isnan(out[2:]).all()


def test_sweeps(spark):
    p = (sweep.Parameter("a", "offset", 1.0, (-1.0, 1.0), 0.5, "milliseconds", "v"), sweep.Parameter("b", "constant", 0.0, (-2.0, 2.0), 1.0, "arcseconds"))
    s = sweep.Sweep(p, "random", 5, 3, 7)
    rows = sweep.parameter_sets(spark, s).orderBy("param_idx").collect()
    rng = np.random.RandomState(7)
    want = []
    for _ in range(5):
        want.append([(1.0 + np.clip(rng.normal(0, 0.5), -1, 1)) * 1e-3, *(np.clip(rng.normal(0, 1.0), -2, 2) * sweep.ARCSEC for _ in range(3))])
    assert np.array([list(r)[1:] for r in rows]) == pytest.approx(np.array(want))
    assert s.with_parameter("b", sigma=9.0).parameters[1].sigma == 9.0
    with pytest.raises(KeyError):
        s.with_parameter("zzz", sigma=1.0)
    same = sweep.apply_offset(spark.range(1), p[0], F.lit(1.0))
    assert same.columns == ["id"]


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_table(spark, "x", "xlsx")
    (tmp_path / "t.csv").write_text("t,v\n1,2.5\n2,\n")
    assert readers.kernel_input(readers.read_table(spark, str(tmp_path / "t.csv"), "csv", time="t", time_scale=1e6)).collect()[0].t == 1e6
    rows = spark.range(5).withColumnRenamed("id", "k")
    assert writers.append_new(rows, str(tmp_path / "table"), ["k"]) == 5
    with pytest.raises(ValueError):
        writers.append_new(rows.limit(1), str(tmp_path / "table"), ["k"])
    writers.write_with_attributes(rows, str(tmp_path / "attr"), {"units": "m"})
    assert writers.attributes(spark.read.parquet(str(tmp_path / "attr"))) == {"units": "m"}
    assert writers.write_behaviour(False, False, False) == "errorifexists"
    with pytest.raises(FileExistsError):
        writers.write_behaviour(True, False, False)
    assert readers.tle_query([25544], {"EPOCH": ("range", ("a", "b")), "ecc": ("lt", 0.1)}) == "class/gp_history/NORAD_CAT_ID/25544/EPOCH/a--b/ECC/<0.1/format/json"
    with pytest.raises(ValueError):
        readers.tle_query([1], {"epoch": ("le", 1)})
    assert readers.parse_leap_seconds("DELTET/DELTA_AT = ( 10, @1972-JAN-1\n 11, @1972-JUL-1 )") == [(10, "1972-01-01"), (11, "1972-07-01")]
    assert readers.meta_kernel('{"mission_kernels": {"a": "x.bsp"}, "sds_kernels": ["y"]}') == {"mappings": {}, "mission_kernels": ["x.bsp"], "sds_kernels": ["y"]}
    with readers.tables(spark, {"eph": str(tmp_path / "table")}):
        assert "eph" in readers.loaded(spark)
    assert "eph" not in readers.loaded(spark)
    files = readers.discover(spark, str(tmp_path), "*.csv").collect()
    assert len(files) == 1
    good = readers.read_rasters(spark, str(tmp_path), lambda path, raw: [{"n": len(raw)}], "n long", "*.csv").collect()
    assert [r.n for r in good] == [13]
