"""Queries on text kernels: their texts are made of given tables, parsed into the pool, and read by its views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from skyfold.functions import geodesy as G
from skyfold.functions.vec import Vec
from skyfold.operators import ephemeris, frames
from skyfold.sources import kernel_pool as P
from skyfold.sources import ck, spk

from .geo import E2, ECEF, PIXELS, RAY, states
from .registry import query, r, rs, table


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _joined(blocks, order: str):
    """One text a kernel, of its blocks in order."""
    each = F.transform(F.sort_array(F.collect_list(F.struct(order, "block"))), lambda s: s["block"])
    return blocks.groupBy("kernel").agg(F.array_join(each, "").alias("text"))


def instrument_texts(spark, sf_dir):
    """50 instruments a kernel: prose with an assignment in it, values given twice and added to, dates, D exponents, several lines."""
    k = F.col("k")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.floor(F.col("s_suppkey") / 50).alias("kernel"))
    pixels = F.when(k % 4 != 0, text("INS-", k, "_PIXEL_COUNT = ", k % 3 + 1, "\nINS-", k, "_PIXEL_VECTORS = ( 1 2 ", k % 11, " )\nINS-", k, "_PIXEL_VECTORS += ( 4, 5 6\n 7\t8 ", k % 13, ".5 )\n")).otherwise("")
    block = text(
        "About INS-", k, "_BORESIGHT = ( 9 9 9 ), in prose.\n  \\begindata  \nINS-", k, "_BORESIGHT = ( 1.0D0 8 8 )\nINS-", k, "_FOV_SHAPE = 'CIRCLE'\nINS-", k, "_FOV_FRAME='It''s F", k, "'\n",
        "INS-", k, "_BORESIGHT = ( 0.5, ", k % 7, "\n -2.5d-1 )\nINS-", k, "_FOV_CLASS_SPEC = 'ANGLES'\nINS-", k, "_FOV_REF_VECTOR = ( 1 0 0 )\nINS-", k, "_FOV_REF_ANGLE = ", k % 10 + 1, "\nINS-", k, "_FOV_ANGLE_UNITS = 'DEGREES'\n",
        "EPOCH_", k, " = @2000-JAN-0", k % 9 + 1, "-12:00:00.5\n", pixels, "\\begintext\n",
    )
    return _joined(s.withColumn("block", block), "k")


def _rows(name: str, number: str = "NULL", text_: str = "NULL", where: str = "true") -> str:
    return f"SELECT {name} AS variable, {number} AS number, {text_} AS text, k FROM s WHERE {where}"


def _vector(name: str, numbers: list[str], where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT * FROM (SELECT {name} AS variable, {i} AS index, ({n})::DOUBLE AS number, NULL AS text FROM s WHERE {where})" for i, n in enumerate(numbers))


def _string(name: str, value: str) -> str:
    return f"SELECT {name}, 0, NULL::DOUBLE, {value} FROM s"


_INS = "'INS-' || k || "


@query("WITH s AS (SELECT s_suppkey AS k FROM supplier) " + " UNION ALL ".join([
    _vector(_INS + "'_BORESIGHT'", ["0.5", "k % 7", "-0.25"]), _vector(_INS + "'_FOV_REF_VECTOR'", ["1", "0", "0"]), _vector(_INS + "'_FOV_REF_ANGLE'", ["k % 10 + 1"]),
    _vector("'EPOCH_' || k", ["86400 * (k % 9) + 0.5"]), _vector(_INS + "'_PIXEL_COUNT'", ["k % 3 + 1"], "k % 4 <> 0"), _vector(_INS + "'_PIXEL_VECTORS'", ["1", "2", "k % 11", "4", "5", "6", "7", "8", "k % 13 + 0.5"], "k % 4 <> 0"),
    _string(_INS + "'_FOV_SHAPE'", "'CIRCLE'"), _string(_INS + "'_FOV_FRAME'", "'It''s F' || k"), _string(_INS + "'_FOV_CLASS_SPEC'", "'ANGLES'"), _string(_INS + "'_FOV_ANGLE_UNITS'", "'DEGREES'")]))
def kernel_pool_values(spark, sf_dir):
    return P.pool(instrument_texts(spark, sf_dir))


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), v AS (SELECT k, p, [[1, 2, k % 11], [4, 5, 6], [7, 8, k % 13 + 0.5]][p]::DOUBLE[] AS v FROM s, range(1, 4) t(p) WHERE k % 4 <> 0 AND p <= k % 3 + 1)
  SELECT -k AS instrument, p::INTEGER AS pixel, v[1] AS x, v[2] AS y, v[3] AS z FROM v UNION ALL SELECT -k, 1, 0.5, k % 7, -0.25 FROM s WHERE k % 4 = 0""")
def detector_vectors(spark, sf_dir):
    """Pixel vectors where a kernel has them, else the boresight."""
    return P.detector_vectors(P.pool(instrument_texts(spark, sf_dir)))


@query(f"""WITH s AS (SELECT s_suppkey AS k, sqrt(0.25 + (s_suppkey % 7) ** 2 + 0.0625)::DOUBLE AS n, radians(s_suppkey % 10 + 1) AS a FROM supplier), u AS (SELECT k, a, 0.5 / n AS ux, (k % 7) / n AS uy, -0.25 / n AS uz FROM s),
  p AS (SELECT *, sqrt(1 - ux * ux) AS m FROM u)
  SELECT -k AS instrument, 'CIRCLE' AS shape, 'It''s F' || k AS frame, {rs("a", 9)} AS ref_angle, {rs("cos(a) * ux + sin(a) * (1 - ux * ux) / m", 9)} AS x, {rs("cos(a) * uy - sin(a) * ux * uy / m", 9)} AS y, {rs("cos(a) * uz - sin(a) * ux * uz / m", 9)} AS z FROM p""")
def fields_of_view(spark, sf_dir):
    """Cones by angle, and the vector on their edge towards the reference vector."""
    got = P.fields_of_view(P.pool(instrument_texts(spark, sf_dir)))
    edge = F.get("corners", F.lit(0))
    return got.select("instrument", "shape", "frame", r(F.col("ref_angle"), 9).alias("ref_angle"), *[r(edge[a], 9).alias(a) for a in "xyz"])


def clock_texts(spark, sf_dir):
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(k.alias("kernel"), text(
        "\\begindata\nSCLK_DATA_TYPE_", k + 1, " = ( 1 )\nSCLK01_N_FIELDS_", k + 1, " = ( 2 )\nSCLK01_MODULI_", k + 1, " = ( 100000 100 )\nSCLK01_OFFSETS_", k + 1, " = ( 0 0 )\n",
        "SCLK_PARTITION_START_", k + 1, " = ( 0.0 50 )\nSCLK_PARTITION_END_", k + 1, " = ( ", k * 1000 + 5000, " 9.0E6 )\n",
        "SCLK01_COEFFICIENTS_", k + 1, " = ( 0 100 1.0\n 3000 @2000-JAN-02-12:00:00 1.", k, " 20000 200000 0.5 )\n\\begintext\n").alias("text"))
    return n


_CLOCK = "CASE WHEN t < 3000 THEN 100 + t / 100 WHEN t < 20000 THEN 86400 + (t - 3000) / 100 * rate ELSE 200000 + (t - 20000) / 100 * 0.5 END"


@query(f"""WITH e AS (SELECT event_id, (user_id % 25)::BIGINT AS k, ((event_id * 37) % 40000)::DOUBLE AS t FROM events), c AS (SELECT *, ('1.' || k)::DOUBLE AS rate FROM e)
  SELECT event_id, {rs(_CLOCK, 6)} AS time, {rs("t", 4)} AS ticks, {rs("CASE WHEN t <= k * 1000 + 5000 THEN t ELSE k * 1000 + 5000 + t - 50 END", 4)} AS encoded FROM c""")
def clock_of_kernels(spark, sf_dir):
    """Ticks to time and back by a kernel's pieces, and clock strings to ticks over its partitions; the clock depends on the event's user."""
    e = table(spark, sf_dir, "events").select("event_id", (-(F.col("user_id") % 25) - 1).alias("clock"), (F.col("event_id") * 37 % 40000).cast("double").alias("t"))
    got = e.join(P.clocks(P.pool(clock_texts(spark, sf_dir))), "clock").withColumn("time", P.ticks_to_time(F.col("t"), F.col("pieces"), F.col("ticks_per_count")))
    string = F.concat(F.floor(F.col("t") / 100).cast("string"), F.lit(":"), F.lpad((F.col("t") % 100).cast("int").cast("string"), 2, "0"))
    encoded = P.encode_ticks(string, F.struct("moduli", "offsets", "partition_start", "partition_end"))
    return got.select("event_id", r(F.col("time"), 6).alias("time"), r(P.time_to_ticks(F.col("time"), F.col("pieces"), F.col("ticks_per_count")), 4).alias("ticks"), r(encoded, 4).alias("encoded"))


def frame_texts(spark, sf_dir):
    """Constant frames by angles, matrices (by columns) and quaternions, in turn."""
    k = F.col("k")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.floor(F.col("s_suppkey") / 50).alias("kernel"))
    c, sn = F.cos(F.radians(k)), F.sin(F.radians(k))
    spec = (
        F.when(k % 3 == 0, text("'ANGLES'\nTKFRAME_", k, "_ANGLES = ( ", k, " 90 ", k % 5, " )\nTKFRAME_", k, "_AXES = ( 3 2 1 )\nTKFRAME_", k, "_UNITS = 'DEGREES'\n"))
        .when(k % 3 == 1, text("'MATRIX'\nTKFRAME_", k, "_MATRIX = ( ", c, " ", -sn, " 0\n ", sn, " ", c, " 0 0 0 1 )\n"))
        .otherwise(text("'QUATERNION'\nTKFRAME_", k, "_Q = ( ", F.cos(F.radians(k) / 2), " 0 ", F.sin(F.radians(k) / 2), " 0 )\n"))
    )
    block = text("\\begindata\nFRAME_F", k, " = ", k, "\nFRAME_", k, "_NAME = 'F", k, "'\nFRAME_", k, "_CLASS = 4\nFRAME_", k, "_CLASS_ID = ", k, "\nFRAME_", k, "_CENTER = 399\nTKFRAME_", k, "_RELATIVE = 'J2000'\nTKFRAME_", k, "_SPEC = ", spec, "\\begintext\n")
    return _joined(s.withColumn("block", block), "k")


@query(f"""WITH s AS (SELECT s_suppkey AS k, radians(s_suppkey) AS a, radians(s_suppkey % 5) AS b FROM supplier)
  SELECT k AS frame_id, 'F' || k AS name, 4 AS class, 'J2000' AS relative,
    {rs("CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN cos(a) ELSE cos(a) END", 9)} AS r0, {rs("CASE k % 3 WHEN 0 THEN sin(a) * cos(b) + cos(a) * sin(b) WHEN 1 THEN sin(a) ELSE 0 END", 9)} AS r1,
    {rs("CASE k % 3 WHEN 0 THEN sin(a) * sin(b) - cos(a) * cos(b) WHEN 1 THEN 0 ELSE sin(a) END", 9)} AS r2, {rs("CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -sin(a) END", 9)} AS r6 FROM s""")
def frames_of_kernels(spark, sf_dir):
    """Matrices to the frame that a constant frame is relative to."""
    got = P.frames(P.pool(frame_texts(spark, sf_dir)))
    return got.select("frame_id", "name", F.col("class").cast("int").alias("class"), "relative", *[r(F.col(c), 9).alias(c) for c in ("r0", "r1", "r2", "r6")])


@query(f"""WITH {ECEF}, px AS ({PIXELS}),
  ray AS (SELECT p.id, pixel, x * 1.066::DOUBLE AS px, y * 1.066::DOUBLE AS py, z * 1.066::DOUBLE AS pz, -x - look * 6000 AS vx, -y + look * 3000 AS vy, -z + look * look * 1000 AS vz FROM p CROSS JOIN px),
  {RAY[RAY.index('s AS (SELECT *'):]}
  SELECT id AS ugps, pixel, CASE WHEN d >= 0 THEN {rs('degrees(atan2(py + d * vy, px + d * vx))', 5)} END AS lon,
  CASE WHEN d >= 0 THEN {rs(f'degrees(atan2((pz + d * vz) / {1 - E2!r}::DOUBLE, sqrt((px + d * vx) ** 2 + (py + d * vy) ** 2)))', 5)} END AS lat FROM d""")
def geolocate_by_kernel(spark, sf_dir):
    """Times x pixels -> ellipsoid, the pixels' vectors being those of an instrument kernel: across, along and down the line to the Earth's centre."""
    look = (F.col("r_regionkey") - 2) * 0.3
    vectors = table(spark, sf_dir, "region").select(F.lit(0).alias("kernel"), F.col("r_regionkey").alias("k"), text("INS-7_PIXEL_VECTORS += ( ", look, " ", look * look, " 1.0 )\n").alias("block"))
    whole = _joined(vectors, "k").withColumn("text", F.concat(F.lit("\\begindata\nINS-7_PIXEL_COUNT = 5\n"), "text"))
    px = P.detector_vectors(P.pool(whole)).select("pixel", F.col("x").alias("across"), F.col("y").alias("along"), F.col("z").alias("down"))
    frames = states(spark, sf_dir).select("id", *Vec.columns("").times(1.066).named("p"), *Vec.columns("").named("c"))
    all_ = ephemeris.pixel_states(frames, px)
    a, b, c = F.col("across"), F.col("along"), F.col("down")
    at = G.intersect_ellipsoid(Vec(-F.col("cx") * c - a * 6000, -F.col("cy") * c + a * 3000, -F.col("cz") * c + b * 1000), Vec.columns("p"))
    got = all_.select(F.col("id").alias("ugps"), "pixel", *at.named("g"))
    lon, lat, _ = G.surface_lon_lat(Vec.columns("g"))
    miss = F.isnan("gx")
    return got.select("ugps", "pixel", F.when(~miss, r(lon, 5)).alias("lon"), F.when(~miss, r(lat, 5)).alias("lat"))


_POLE = "\\begindata\nBODY399_POLE_RA = ( 0. -0.641 0. )\nBODY399_POLE_DEC = ( 90. -0.557 0. )\nBODY399_PM = ( 190.147 360.9856235 0. )\n"
_MOUNT = 20.0


@query(f"""WITH e AS (SELECT event_id, epoch_us(ts) / 1e6::DOUBLE - 946728000 AS et, epoch_us(ts) AS us FROM events), d AS (SELECT min(us // 86400000000) * 86400000000 AS lo, max(us // 86400000000) * 86400000000 AS hi FROM e),
  a AS (SELECT event_id, us BETWEEN lo AND hi AS known, 2e-6::DOUBLE * ((us - lo) / 1e6::DOUBLE) AS phi, radians(90 - 0.641 * et / 86400 / 36525) AS t, radians(0.557 * et / 86400 / 36525) AS p, radians((190.147 + 360.9856235 * (et / 86400)) % 360) AS w FROM e, d),
  b AS (SELECT *, cos(w) * cos(t) - sin(w) * sin(t) * cos(p) AS b00, cos(w) * sin(t) + sin(w) * cos(t) * cos(p) AS b01, sin(w) * sin(p) AS b02, sin(t) * sin(p) AS b20, -cos(t) * sin(p) AS b21, cos(p) AS b22 FROM a),
  c AS (SELECT *, cos(phi) AS q, sin(phi) AS s, cos(radians({_MOUNT})) AS mc, sin(radians({_MOUNT})) AS ms FROM b)
  SELECT event_id, CASE WHEN known THEN {rs("b00 * q + b01 * s")} END AS r0, CASE WHEN known THEN {rs("-b00 * s * mc + b01 * q * mc + b02 * ms")} END AS r1, CASE WHEN known THEN {rs("b20 * s * ms - b21 * q * ms + b22 * mc")} END AS r8,
    {rs("b00")} AS e0, {rs("b02")} AS e2, {rs("b21")} AS e7 FROM c""")
def rotations_along_frames(spark, sf_dir):
    """An instrument on a platform (constant, of a kernel), the platform in J2000 (samples a day), the Earth by pole and meridian (of a kernel): two paths for each event."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    e = table(spark, sf_dir, "events").select("event_id", us.alias("ugps"))
    day = 86_400_000_000
    days = e.select((F.floor(F.col("ugps") / day) * day).cast("long").alias("ugps")).distinct()
    half = 1e-6 * ((F.col("ugps") - F.col("lo")) / 1e6)
    samples = days.crossJoin(F.broadcast(days.agg(F.min("ugps").alias("lo")))).select(F.lit(1).alias("frame"), "ugps", F.cos(half).alias("q0"), F.lit(0.0).alias("q1"), F.lit(0.0).alias("q2"), F.sin(half).alias("q3"))
    k = F.col("r_regionkey")
    tk = table(spark, sf_dir, "region").where(k == 0).select(F.lit(0).alias("kernel"), F.concat(F.lit(_POLE), text("FRAME_INST = 5\nFRAME_5_NAME = 'INST'\nFRAME_5_CLASS = 4\nTKFRAME_5_RELATIVE = 'PLATFORM'\nTKFRAME_5_SPEC = 'ANGLES'\nTKFRAME_5_ANGLES = ( ", -_MOUNT + 0 * k, " 0 0 )\nTKFRAME_5_AXES = ( 1 2 3 )\nTKFRAME_5_UNITS = 'DEGREES'\n")).alias("text"))
    held = P.pool(tk)
    tree = frames.tree_of_kernels(P.frames(held), held, {"PLATFORM": frames.Sampled("J2000", samples, 1)})
    got = frames.rotations(e, tree, {"r": ("INST", "BODY399"), "e": ("J2000", "BODY399")}, F.col("ugps") / 1e6 - 946728000)
    none = lambda c: F.when(~F.isnan(c), r(F.col(c))).alias(c)
    return got.select("event_id", *[none(c) for c in ("r0", "r1", "r8", "e0", "e2", "e7")])


def _ephemeris_file(key: tuple, rows: pa.Table) -> pa.Table:
    """An SPK file of some suppliers: each a target on two quadratic pieces of 100 s, and a later segment over the middle."""
    found = []
    for k in sorted(rows["k"].to_pylist()):
        pieces = [[100 * i + 50.0, 50.0, k % 7 + i, 1.0, 0.5, 0.0, k % 3, 0.0, k % 5, 0.0, 1.0] for i in (0, 1)]
        found.append((k, 0, 1, 2, 0.0, 200.0, np.array([*pieces[0], *pieces[1], 0.0, 100.0, 11, 2])))
        found.append((k, 0, 1, 2, 80.0, 90.0, np.array([85.0, 5.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 80.0, 10.0, 11, 1])))
    return pa.table({"file": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([spk.daf(found)], pa.binary())})


@query(f"""WITH l AS (SELECT DISTINCT l_suppkey AS k, l_orderkey % 230 + 0.25::DOUBLE AS et FROM lineitem), p AS (SELECT *, CASE WHEN et >= 100 THEN 1 ELSE 0 END AS i, (et - CASE WHEN et >= 100 THEN 150 ELSE 50 END) / 50 AS u FROM l)
  SELECT k AS target, et, {rs("CASE WHEN et BETWEEN 80 AND 90 THEN -1 WHEN et <= 200 THEN k % 7 + i + u + 0.5 * (2 * u * u - 1) END")} AS x, {rs("CASE WHEN et BETWEEN 80 AND 90 THEN 0 WHEN et <= 200 THEN (k % 3) * u END")} AS y,
    {rs("CASE WHEN et BETWEEN 80 AND 90 THEN 0 WHEN et <= 200 THEN (1 + 2 * u) / 50 END")} AS vx, {rs("CASE WHEN et BETWEEN 80 AND 90 THEN 0 WHEN et <= 200 THEN 4 * u / 50 END")} AS vz FROM p""")
def states_of_ephemeris_files(spark, sf_dir):
    """Files of polynomials, 50 suppliers each, and states of suppliers at times of their line items; later segments first."""
    s = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 50).cast("long").alias("file"), F.col("s_suppkey").cast("long").alias("k"))
    held = spk.intervals(s.groupBy("file").applyInArrow(_ephemeris_file, "file long, content binary"))
    times = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), F.lit(0).alias("center"), (F.col("l_orderkey") % 230 + 0.25).alias("et")).distinct()
    got = spk.lookup(times, held, 100.0)
    none = lambda c: F.when(~F.isnan(c), r(F.col(c))).alias(c)
    return got.select("target", "et", *[none(c) for c in ("x", "y", "vx", "vz")])


def _attitude_file(key: tuple, rows: pa.Table) -> pa.Table:
    """A C-kernel of some suppliers: each turns about z, in two intervals with a gap, with rates."""
    found, ticks = [], np.array([0.0, 10.0, 20.0, 50.0, 60.0])
    for k in sorted(rows["k"].to_pylist()):
        half, zero = 0.005 * ticks * (k % 5 + 1), np.zeros(5)
        q = np.stack([np.cos(half), zero, zero, np.sin(half)], 1)
        found.append((k, 1, 3, 1, 0.0, 60.0, ck.type_three(ticks, q, np.array([0.0, 50.0]), np.stack([zero, ticks, zero + k], 1))))
    return pa.table({"file": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([spk.daf(found, kind_of_file=b"DAF/CK")], pa.binary())})


@query(f"""WITH l AS (SELECT DISTINCT l_suppkey AS k, l_orderkey % 80 + 0.5::DOUBLE AS t FROM lineitem),
  f AS (SELECT *, CASE WHEN t <= 20 OR t BETWEEN 50 AND 60 THEN t WHEN t <= 23 THEN 20.0 WHEN t >= 47 AND t < 50 THEN 50.0 WHEN t > 60 AND t <= 63 THEN 60.0 END AS found FROM l)
  SELECT k AS instrument, t AS tick, found AS tick_found, {rs("cos(0.005 * found * (k % 5 + 1))")} AS q0, {rs("sin(0.005 * found * (k % 5 + 1))")} AS q3, {rs("found")} AS w1, {rs("CASE WHEN found IS NOT NULL THEN k END")} AS w2 FROM f""")
def pointing_of_attitude_files(spark, sf_dir):
    """Pointing in intervals, in gaps by tolerance, and beyond it."""
    s = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 50).cast("long").alias("file"), F.col("s_suppkey").cast("long").alias("k"))
    held = ck.spans(s.groupBy("file").applyInArrow(_attitude_file, "file long, content binary"))
    times = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("int").alias("instrument"), (F.col("l_orderkey") % 80 + 0.5).alias("tick")).distinct()
    got = ck.pointing(times, held, 3.0, True, 10.0)
    none = lambda c: F.when(~F.isnan(c), r(F.col(c))).alias(c)
    return got.select("instrument", "tick", *[none(c) for c in ("tick_found", "q0", "q3", "w1", "w2")])
