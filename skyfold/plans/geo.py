"""Queries of geodesy, viewing geometry, ephemerides and pairing, on places derived from ids and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import constants as K
from skyfold.functions import geodesy as G
from skyfold.functions import vec as V
from skyfold.functions.vec import Vec
from skyfold.operators import ephemeris, geometry, pairing

from .registry import query, r, rs, table

A, B, E2 = K.WGS84_A_KM, K.WGS84_B_KM, K.WGS84_E2
PLACE = "SELECT event_id AS id, (event_id * 137.508::DOUBLE) % 360.0::DOUBLE - 180 AS lon, (event_id * 61.8::DOUBLE) % 170.0::DOUBLE - 85 AS lat, value AS alt FROM events"
#: A satellite 420 km above each place, an Earth-fixed velocity, a Sun, and a boresight a little off nadir.
ECEF = f"""
place AS ({PLACE}),
n AS (SELECT *, {A}::DOUBLE / sqrt(1 - {E2!r}::DOUBLE * sin(radians(lat)) ** 2) AS n FROM place),
p AS (SELECT id, lon, lat, alt, (n + alt) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + alt) * cos(radians(lat)) * sin(radians(lon)) AS y,
  ({(B / A) ** 2!r}::DOUBLE * n + alt) * sin(radians(lat)) AS z FROM n)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") * 137.508 % 360.0 - 180).alias("lon"), (F.col("event_id") * 61.8 % 170.0 - 85).alias("lat"), F.col("value").alias("alt"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    return p.select("id", "lon", "lat", "alt", *G.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.col("alt")).named(""))


@query(f"WITH {ECEF} SELECT id, {rs('x')} AS x, {rs('y')} AS y, {rs('z')} AS z FROM p")
def geodetic_to_ecef(spark, sf_dir):
    s = states(spark, sf_dir)
    return s.select("id", *[r(F.col(c)).alias(c) for c in "xyz"])


@query(f"{PLACE.replace('SELECT event_id AS id,', 'SELECT event_id AS id, ')}".join(["SELECT id, round(lon, 6) + 0.0::DOUBLE AS lon, round(lat, 6) + 0.0::DOUBLE AS lat, round(alt, 6) + 0.0::DOUBLE AS alt, round(90 - lat, 6) + 0.0::DOUBLE AS colat FROM (", ")"]))
def ecef_to_geodetic(spark, sf_dir):
    """Back from Earth-fixed coordinates: the SQL gives the places themselves."""
    s = states(spark, sf_dir)
    lon, lat, alt = G.ecef_to_geodetic(Vec.columns(""))
    return s.select("id", r(lon).alias("lon"), r(lat).alias("lat"), r(alt).alias("alt"), r(90.0 - lat).alias("colat"))


RAY = f"""
ray AS (SELECT id, x * 1.1::DOUBLE AS px, y * 1.1::DOUBLE AS py, z * 1.1::DOUBLE AS pz,
  -x + 9.0::DOUBLE * alt AS vx, -y AS vy, -z - 7.0::DOUBLE * alt AS vz FROM p),
s AS (SELECT *, vx * vx / {A * A!r}::DOUBLE + vy * vy / {A * A!r}::DOUBLE + vz * vz / {B * B!r}::DOUBLE AS uu,
  vx * px / {A * A!r}::DOUBLE + vy * py / {A * A!r}::DOUBLE + vz * pz / {B * B!r}::DOUBLE AS uq,
  px * px / {A * A!r}::DOUBLE + py * py / {A * A!r}::DOUBLE + pz * pz / {B * B!r}::DOUBLE AS qq FROM ray),
d AS (SELECT *, CASE WHEN uq * uq - uu * (qq - 1) >= 0 THEN (-uq - sqrt(uq * uq - uu * (qq - 1))) / uu END AS d FROM s)"""


def rays(spark, sf_dir):
    s = states(spark, sf_dir)
    x, y, z, a = (F.col(c) for c in ("x", "y", "z", "alt"))
    return s.select("id", *Vec(x * 1.1, y * 1.1, z * 1.1).named("p"), *Vec(-x + 9.0 * a, -y, -z - 7.0 * a).named("v"))


@query(f"""WITH {ECEF}, {RAY} SELECT id, d IS NOT NULL AND d >= 0 AS hit,
  CASE WHEN d >= 0 THEN {rs('px + d * vx', 5)} END AS x, CASE WHEN d >= 0 THEN {rs('py + d * vy', 5)} END AS y, CASE WHEN d >= 0 THEN {rs('pz + d * vz', 5)} END AS z,
  CASE WHEN d >= 0 THEN {rs(f'degrees(atan2((pz + d * vz) / {1 - E2!r}::DOUBLE, sqrt((px + d * vx) ** 2 + (py + d * vy) ** 2)))')} END AS lat FROM d""")
def ray_intersect_ellipsoid(spark, sf_dir):
    """A miss, NaN in the operator, shows as null."""
    at = G.intersect_ellipsoid(Vec.columns("v"), Vec.columns("p"))
    got = rays(spark, sf_dir).select("id", *at.named(""))
    none = lambda c: F.when(~F.isnan("x"), c)
    return got.select("id", (~F.isnan("x")).alias("hit"), *[none(r(F.col(c), 5)).alias(c) for c in "xyz"], none(r(G.surface_lon_lat(Vec.columns(""))[1])).alias("lat"))


ANGLES = f"""
t AS (SELECT id, lon, lat, x, y, z, x * 1.05::DOUBLE + alt - x AS tx, y * 1.07::DOUBLE - y AS ty, z * 1.02::DOUBLE + 3 * alt - z AS tz FROM p),
en AS (SELECT *, -sin(radians(lon)) * tx + cos(radians(lon)) * ty AS e,
  -sin(radians(lat)) * cos(radians(lon)) * tx - sin(radians(lat)) * sin(radians(lon)) * ty + cos(radians(lat)) * tz AS nn,
  cos(radians(lat)) * cos(radians(lon)) * tx + cos(radians(lat)) * sin(radians(lon)) * ty + sin(radians(lat)) * tz AS u, sqrt(tx * tx + ty * ty + tz * tz) AS l FROM t)"""


@query(f"""WITH {ECEF}, {ANGLES} SELECT id, {rs('CASE WHEN atan2(e, nn) < 0 THEN degrees(atan2(e, nn)) + 360 ELSE degrees(atan2(e, nn)) END', 5)} AS azimuth,
  {rs('degrees(atan2(e, nn))', 5)} AS signed_azimuth, {rs('degrees(acos(u / l))', 5)} AS zenith,
  {rs('degrees(acos((x * tx + y * ty + z * tz) / (l * sqrt(x * x + y * y + z * z))))', 5)} AS geocentric_zenith FROM en""")
def azimuth_zenith(spark, sf_dir):
    s = states(spark, sf_dir)
    own = Vec.columns("")
    target = Vec(own.x * 1.05 + F.col("alt"), own.y * 1.07, own.z * 1.02 + 3 * F.col("alt"))
    return s.select("id", r(G.azimuth(own, target), 5).alias("azimuth"), r(G.azimuth(own, target, signed=True), 5).alias("signed_azimuth"), r(G.zenith(own, target), 5).alias("zenith"), r(G.zenith(own, target, geocentric=True), 5).alias("geocentric_zenith"))


@query("SELECT event_id AS id, round((value * 3.7::DOUBLE - event_id % 400 + 180 + 7200) % 360, 6) + 0.0::DOUBLE AS relative_azimuth FROM events")
def relative_azimuth(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), r(G.relative_azimuth(F.col("value") * 3.7, (F.col("event_id") % 400).cast("double"))).alias("relative_azimuth"))


ORBIT = """
o AS (SELECT id, x, y, z, -y * 0.001::DOUBLE + 0.5 AS vx, x * 0.001::DOUBLE AS vy, 3 + 0 * z AS vz, -x + 500.0::DOUBLE AS bx0, -y - 3 * alt AS by0, -z + 200.0::DOUBLE AS bz0 FROM p),
u AS (SELECT *, sqrt(x * x + y * y + z * z) AS l, sqrt(bx0 * bx0 + by0 * by0 + bz0 * bz0) AS bl FROM o),
f AS (SELECT *, -x / l AS zx, -y / l AS zy, -z / l AS zz, bx0 / bl AS bx, by0 / bl AS by_, bz0 / bl AS bz FROM u),
g AS (SELECT *, vx * zx + vy * zy + vz * zz AS vz_ FROM f),
h AS (SELECT *, vx - vz_ * zx AS ax, vy - vz_ * zy AS ay, vz - vz_ * zz AS az FROM g),
i AS (SELECT *, ax / sqrt(ax * ax + ay * ay + az * az) AS xx, ay / sqrt(ax * ax + ay * ay + az * az) AS xy, az / sqrt(ax * ax + ay * ay + az * az) AS xz FROM h),
j AS (SELECT *, bx * xx + by_ * xy + bz * xz AS qx, bx * (zy * xz - zz * xy) + by_ * (zz * xx - zx * xz) + bz * (zx * xy - zy * xx) AS qy, bx * zx + by_ * zy + bz * zz AS qz FROM i)"""


def orbits(spark, sf_dir):
    s = states(spark, sf_dir)
    x, y, z, alt = (F.col(c) for c in ("x", "y", "z", "alt"))
    return s.select("id", "x", "y", "z", "alt", *Vec(-y * 0.001 + 0.5, x * 0.001, 3 + 0 * z).named("v"), *Vec(-x + 500.0, -y - 3 * alt, -z + 200.0).unit().named("b"))


@query(f"""WITH {ECEF}, {ORBIT} SELECT id, {rs('degrees(acos(greatest(-1, least(1, qz))))', 5)} AS cone_angle, {rs('(degrees(atan2(qy, qx)) + 360) % 360', 4)} AS clock_angle,
  {rs('degrees(atan2(qx, qz))', 5)} AS along_track_angle, {rs('degrees(atan2(qy, qz))', 5)} AS cross_track_angle FROM j""")
def orbital_angles(spark, sf_dir):
    o = orbits(spark, sf_dir)
    clock, along, cross = G.orbital_angles(Vec.columns("b"), Vec.columns(""), Vec.columns("v"))
    return o.select("id", r(G.cone_angle(Vec.columns("b"), Vec.columns("")), 5).alias("cone_angle"), r(clock, 4).alias("clock_angle"), r(along, 5).alias("along_track_angle"), r(cross, 5).alias("cross_track_angle"))


@query(f"""WITH {ECEF}, {ORBIT} SELECT id, {rs('(x * bx + y * by_ + z * bz) / l', 9)} AS boresight_cosine, {rs(f'({K.AU_KM}::DOUBLE / (l * 23000)) ** 2', 9)} AS distance_correction,
  {rs(f'1 - ((vx * x + vy * y + vz * z) / l) / {K.LIGHT_KM_S}::DOUBLE', 12)} AS doppler_factor FROM j""")
def solar_corrections(spark, sf_dir):
    o = orbits(spark, sf_dir)
    own = Vec.columns("")
    return o.select("id", r(G.boresight_cosine(own, Vec.columns("b")), 9).alias("boresight_cosine"), r(G.distance_correction(own.times(23000)), 9).alias("distance_correction"), r(G.doppler_factor(own, Vec.columns("v")), 12).alias("doppler_factor"))


@query(f"""WITH {ECEF}, m AS (SELECT id, lon, lat, x, y, z, alt FROM p), q AS (SELECT a.id, a.lon, a.lat, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM m a JOIN m b ON b.id = a.id + 1)
  SELECT id, {rs('-sin(radians(lon)) * dx + cos(radians(lon)) * dy', 5)} AS east, {rs('-sin(radians(lat)) * cos(radians(lon)) * dx - sin(radians(lat)) * sin(radians(lon)) * dy + cos(radians(lat)) * dz', 5)} AS north,
  {rs('cos(radians(lat)) * cos(radians(lon)) * dx + cos(radians(lat)) * sin(radians(lon)) * dy + sin(radians(lat)) * dz', 5)} AS up FROM q""")
def geodetic_to_enu(spark, sf_dir):
    """Of each place's successor; the operator works in metres."""
    p = places(spark, sf_dir)
    nxt = p.select((F.col("id") - 1).alias("id"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.col("alt").alias("alt1"))
    v = G.geodetic_to_enu(F.col("lon1"), F.col("lat1"), F.col("alt1") * 1000, F.col("lon"), F.col("lat"), F.col("alt") * 1000)
    return p.join(nxt, "id").select("id", *[r(c / 1000, 5).alias(n) for n, c in zip(("east", "north", "up"), v)])


@query(f"""WITH {ECEF} SELECT id AS ugps, {rs('sqrt(x * x + y * y + z * z)', 5)} AS spacecraft_radius, {rs('lat', 5)} AS subsatellite_latitude, {rs('lon', 5)} AS subsatellite_longitude,
  {rs('90 - lat', 5)} AS subsatellite_colatitude, {rs('alt', 5)} AS spacecraft_altitude, {rs('-y * 0.001::DOUBLE', 5)} AS spacecraft_velocity_x, {rs('x * 0.001::DOUBLE', 5)} AS spacecraft_velocity_y, 7.0::DOUBLE AS spacecraft_velocity_z FROM p""")
def get_geometry_fields(spark, sf_dir):
    s = states(spark, sf_dir).select(F.col("id").alias("ugps"), *Vec.columns("").named("sc_"), (-F.col("y") * 0.001).alias("sc_vx"), (F.col("x") * 0.001).alias("sc_vy"), F.lit(7.0).alias("sc_vz"))
    got = geometry.get_geometry(s, ["sc_radius", "subsatellite", "sc_altitude", "sc_velocity"])
    return got.select("ugps", *[r(F.col(c), 5).alias(c) for c in got.columns[1:]])


# --- ephemerides ---------------------------------------------------------------------------------------------------

SAMPLES = "SELECT user_id AS object_id, epoch_us(ts) AS ugps, value AS x, value * 0.5::DOUBLE AS y, 1.0::DOUBLE AS z, (event_id % 7) * 0.001::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.002::DOUBLE AS vz FROM events WHERE event_type <> 'error'"


def _samples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return e.select("event_id", "event_type", F.col("user_id").alias("object_id"), us.alias("ugps"), "value")


@query(f"""WITH s AS (SELECT *, lead(ugps) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(vx) OVER w AS vx1, lead(vz) OVER w AS vz1 FROM ({SAMPLES}) WINDOW w AS (PARTITION BY object_id ORDER BY ugps)),
  q AS (SELECT event_id, user_id AS object_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
  j AS (SELECT q.event_id, (t - ugps)::DOUBLE / (t1 - ugps) AS u, (t1 - ugps)::DOUBLE / 1e6::DOUBLE AS h, x, x1, vx, vx1, y, y1, z, z1, vz, vz1 FROM q LEFT JOIN s ON q.object_id = s.object_id AND t >= ugps AND t < t1 AND t1 - ugps <= 36000000000)
  SELECT event_id, {rs('x * (1 + 2*u) * (1-u)**2 + x1 * u*u*(3 - 2*u) + h * (vx * u * (1-u)**2 - vx1 * u*u*(1-u))', 4)} AS x,
  {rs('y * (1 + 2*u) * (1-u)**2 + y1 * u*u*(3 - 2*u)', 4)} AS y, {rs('6*u*(1-u)*(x1-x)/h + vx*(1-u)*(1-3*u) + vx1*u*(3*u-2)', 6)} AS vx FROM j""")
def query_ephemeris(spark, sf_dir):
    """As-of join of one kind of event to the interpolated samples of the others of its user; without samples null."""
    e = _samples(spark, sf_dir)
    s = e.where("event_type <> 'error'").select("object_id", "ugps", F.col("value").alias("x"), (F.col("value") * 0.5).alias("y"), F.lit(1.0).alias("z"), (F.col("event_id") % 7 * 0.001).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.002).alias("vz"))
    got = ephemeris.query_ephemeris(e.where("event_type = 'error'").select("event_id", "object_id", "ugps"), s, 36_000_000_000, 3_600_000_000)
    none = lambda c, n: F.when(~F.isnan(c), r(F.col(c), n)).alias(c)
    return got.select("event_id", none("x", 4), none("y", 4), none("vx", 6))


@query("""WITH s AS (SELECT user_id AS f, epoch_us(ts) AS t0, radians(value) / 2 AS a, lead(epoch_us(ts)) OVER w AS t1, lead(radians(value) / 2) OVER w AS a1 FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  q AS (SELECT event_id, user_id AS f, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
  j AS (SELECT event_id, a, a1, (t - t0)::DOUBLE / (t1 - t0) AS u, cos(a) * cos(a1) + sin(a) * sin(a1) AS d FROM q LEFT JOIN s ON q.f = s.f AND t >= t0 AND t < t1),
  k AS (SELECT *, acos(least(1.0::DOUBLE, abs(d))) AS w, CASE WHEN d < 0 THEN -1 ELSE 1 END AS g FROM j),
  l AS (SELECT *, CASE WHEN sin(w) < 1e-9 THEN 1 - u ELSE sin((1 - u) * w) / sin(w) END AS w0, g * CASE WHEN sin(w) < 1e-9 THEN u ELSE sin(u * w) / sin(w) END AS w1 FROM k)
  SELECT event_id, round(w0 * cos(a) + w1 * cos(a1), 6) + 0.0::DOUBLE AS q0, round(w0 * sin(a) + w1 * sin(a1), 6) + 0.0::DOUBLE AS q3 FROM l""")
def query_attitude(spark, sf_dir):
    e = _samples(spark, sf_dir).withColumnRenamed("object_id", "frame")
    half = F.radians("value") / 2
    a = e.where("event_type <> 'error'").select("frame", "ugps", F.cos(half).alias("q0"), F.lit(0.0).alias("q1"), F.lit(0.0).alias("q2"), F.sin(half).alias("q3"))
    got = ephemeris.query_attitude(e.where("event_type = 'error'").select("event_id", "frame", "ugps"), a, None, 3_600_000_000)
    return got.select("event_id", *[F.when(~F.isnan(c), r(F.col(c))).alias(c) for c in ("q0", "q3")])


@query("""WITH q AS (SELECT event_id, user_id AS f, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), s AS (SELECT event_id AS sample, user_id AS f, epoch_us(ts) AS t0 FROM events WHERE event_type <> 'error')
  SELECT event_id, sample FROM (SELECT q.event_id, sample, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(t - t0), t0) AS n FROM q LEFT JOIN s ON q.f = s.f AND abs(t - t0) <= 1800000000) WHERE n = 1""")
def nearest_sample_within_tolerance(spark, sf_dir):
    e = _samples(spark, sf_dir)
    s = e.where("event_type <> 'error'").select("object_id", "ugps", F.col("event_id").alias("sample"))
    return ephemeris.nearest_within(e.where("event_type = 'error'").select("event_id", "object_id", "ugps"), s, "object_id", 1_800_000_000).select("event_id", "sample")


PIXELS = "SELECT r_regionkey + 1 AS pixel, (r_regionkey - 2) * 0.3::DOUBLE AS look FROM region"


@query(f"""WITH {ECEF}, px AS ({PIXELS}),
  ray AS (SELECT p.id, pixel, x * 1.066::DOUBLE AS px, y * 1.066::DOUBLE AS py, z * 1.066::DOUBLE AS pz, -x - look * 6000 AS vx, -y + look * 3000 AS vy, -z + look * look * 1000 AS vz FROM p CROSS JOIN px),
  {RAY[RAY.index('s AS (SELECT *'):]}
  SELECT id AS ugps, pixel, CASE WHEN d >= 0 THEN {rs('degrees(atan2(py + d * vy, px + d * vx))', 5)} END AS lon,
  CASE WHEN d >= 0 THEN {rs(f'degrees(atan2((pz + d * vz) / {1 - E2!r}::DOUBLE, sqrt((px + d * vx) ** 2 + (py + d * vy) ** 2)))', 5)} END AS lat,
  CASE WHEN d >= 0 THEN 0 ELSE 512 END AS qf FROM d""")
def geolocate_pixels(spark, sf_dir):
    """Times x pixels -> ellipsoid, with quality flags."""
    frames = states(spark, sf_dir).select("id", *Vec.columns("").times(1.066).named("p"), *Vec.columns("").named("c"))
    px = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("pixel"), ((F.col("r_regionkey") - 2) * 0.3).alias("look"))
    all_ = ephemeris.pixel_states(frames, px)
    k = F.col("look")
    at = G.intersect_ellipsoid(Vec(-F.col("cx") - k * 6000, -F.col("cy") + k * 3000, -F.col("cz") + k * k * 1000), Vec.columns("p"))
    got = all_.select(F.col("id").alias("ugps"), "pixel", *at.named("g"))
    lon, lat, _ = G.surface_lon_lat(Vec.columns("g"))
    miss, no = F.isnan("gx"), F.lit(False)
    return got.select("ugps", "pixel", F.when(~miss, r(lon, 5)).alias("lon"), F.when(~miss, r(lat, 5)).alias("lat"), ephemeris.quality(no, no, miss).alias("qf"))


@query("SELECT qf, count(*) AS n, bit_or(qf) AS all_flags FROM (SELECT CASE event_type WHEN 'error' THEN 2 ELSE 0 END | CASE WHEN value > 100 THEN 1024 ELSE 0 END | CASE WHEN event_id % 3 = 0 THEN 8192 ELSE 0 END AS qf FROM events) GROUP BY qf")
def quality_flag_histogram(spark, sf_dir):
    bit = lambda cond, name: F.when(cond, K.QUALITY_FLAGS[name]).otherwise(0)
    qf = bit(F.col("event_type") == "error", "SPICE_ERR_MISSING_EPHEMERIS").bitwiseOR(bit(F.col("value") > 100, "CALC_TERRAIN_EXTREME_ZENITH")).bitwiseOR(bit(F.col("event_id") % 3 == 0, "CALC_ANCIL_INSUFF_DATA"))
    return table(spark, sf_dir, "events").select(qf.alias("qf")).groupBy("qf").agg(F.count(F.lit(1)).alias("n"), F.bit_or("qf").alias("all_flags"))


@query("""WITH a AS (SELECT event_id AS id, radians(value) AS t FROM events) SELECT id, round(degrees(atan2(sin(t), cos(t))), 5) + 0.0::DOUBLE AS yaw,
  round(degrees(asin(sin(0.3::DOUBLE))), 5) AS pitch, abs(round(cos(t / 2) * cos(0.15::DOUBLE), 6)) + 0.0::DOUBLE AS q0 FROM a""")
def frame_rotations(spark, sf_dir):
    """Instrument -> body -> inertial along the frame graph, as Euler angles (3-2-1) and the quaternion's scalar part."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.radians("value").alias("t"))
    m = {"instrument": V.about(2, F.lit(0.3)), "body": V.about(3, F.col("t"))}
    got = ephemeris.frame_rotation({"instrument": "body", "body": "inertial"}, m, "inertial", "instrument")
    back = V.transpose(got)
    yaw, pitch, _ = V.euler(back, (3, 2, 1))
    return e.select("id", r(F.degrees(yaw), 5).alias("yaw"), r(F.degrees(pitch), 5).alias("pitch"), (F.abs(r(V.quaternion(back)[0])) + F.lit(0.0)).alias("q0"))


@query("""SELECT event_id AS id, CASE WHEN a + 0.5::DOUBLE <= 10 THEN 3 WHEN a >= 10.5::DOUBLE THEN 0 ELSE 1 END AS occultation,
  CASE WHEN a <= 12 THEN 1 ELSE 0 END AS in_view FROM (SELECT event_id, (value * 0.1::DOUBLE) % 25.0::DOUBLE + 0.0003::DOUBLE AS a FROM events)""")
def occultation_and_view(spark, sf_dir):
    """A near body of apparent radius 10 degrees before a far one of half a degree, at angles from values."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") * 0.1 % 25.0 + 0.0003).alias("a"))
    import math

    rad = F.radians("a")
    far = Vec(F.cos(rad) * 1e6, F.sin(rad) * 1e6, F.lit(0.0))
    code = G.occultation(Vec.of(0.0, 0.0, 0.0), Vec.of(1e4, 0.0, 0.0), far, 1e4 * math.sin(math.radians(10)), 1e6 * math.sin(math.radians(0.5)))
    return e.select("id", code.alias("occultation"), G.field_of_view(F.col("a"), 12.0, F.lit(42164.0))[0].alias("in_view"))


# --- pairing -------------------------------------------------------------------------------------------------------

FOOT = "SELECT n_nationkey AS image_id, (n_nationkey * 37) % 120 - 60 AS la, (n_nationkey * 53) % 300 - 150 AS lo FROM nation"
POINT = "SELECT s_suppkey AS gcp_id, (s_suppkey * 61.8::DOUBLE) % 120 - 60 AS lat, (s_suppkey * 137.508::DOUBLE) % 300 - 150 AS lon FROM supplier"


def _images(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image_id"), ((F.col("n_nationkey") * 37) % 120 - 60).cast("double").alias("la"), ((F.col("n_nationkey") * 53) % 300 - 150).cast("double").alias("lo"))
    corners = [(0, 0), (0, 12), (-8, 12), (-8, 0)]
    return n.select("image_id", *[(F.col("la") + a).alias(f"lat{i}") for i, (a, _) in enumerate(corners)], *[(F.col("lo") + b).alias(f"lon{i}") for i, (_, b) in enumerate(corners)])


def _points(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gcp_id"), (F.col("s_suppkey") * 61.8 % 120.0 - 60).alias("lat"), (F.col("s_suppkey") * 137.508 % 300.0 - 150).alias("lon"))


def _ecef_m(lat: str, lon: str, out: str) -> str:
    n = f"({A * 1000!r}::DOUBLE / sqrt(1 - {E2!r}::DOUBLE * sin(radians({lat})) ** 2))"
    return f"{n} * cos(radians({lat})) * cos(radians({lon})) AS {out}x, {n} * cos(radians({lat})) * sin(radians({lon})) AS {out}y, {(B / A) ** 2!r}::DOUBLE * {n} * sin(radians({lat})) AS {out}z"


@query(f"""WITH f AS ({FOOT}), g AS ({POINT}), ring AS (SELECT image_id, la, lo, la - 4 AS la0, lo + 6 AS lo0, unnest([0, 1, 2, 3]) AS k FROM f),
  corner AS (SELECT image_id, k, la0, lo0, la + CASE WHEN k >= 2 THEN -8 ELSE 0 END AS cla, lo + CASE WHEN k IN (1, 2) THEN 12 ELSE 0 END AS clo FROM ring),
  c3 AS (SELECT image_id, k, la0, lo0, {_ecef_m('cla', 'clo', 'c')}, {_ecef_m('la0', 'lo0', 'o')} FROM corner),
  flat AS (SELECT image_id, k, la0, lo0, -sin(radians(lo0)) * (cx - ox) + cos(radians(lo0)) * (cy - oy) AS e, -sin(radians(la0)) * cos(radians(lo0)) * (cx - ox) - sin(radians(la0)) * sin(radians(lo0)) * (cy - oy) + cos(radians(la0)) * (cz - oz) AS n FROM c3),
  edge AS (SELECT a.image_id, a.la0, a.lo0, a.k, a.e AS e1, a.n AS n1, b.e AS e2, b.n AS n2 FROM flat a JOIN flat b ON a.image_id = b.image_id AND b.k = (a.k + 1) % 4),
  pt AS (SELECT gcp_id, lat, lon, {_ecef_m('lat', 'lon', 'p')} FROM g),
  both_ AS (SELECT edge.*, gcp_id, {_ecef_m('la0', 'lo0', 'o')}, px, py, pz FROM edge, pt WHERE abs(lat - la0) < 30 AND abs(lon - lo0) < 40),
  plane AS (SELECT *, -sin(radians(lo0)) * (px - ox) + cos(radians(lo0)) * (py - oy) AS x, -sin(radians(la0)) * cos(radians(lo0)) * (px - ox) - sin(radians(la0)) * sin(radians(lo0)) * (py - oy) + cos(radians(la0)) * (pz - oz) AS y FROM both_),
  d AS (SELECT *, greatest(0, least(1, ((x - e1) * (e2 - e1) + (y - n1) * (n2 - n1)) / ((e2 - e1) ** 2 + (n2 - n1) ** 2))) AS t, (e2 - e1) * (y - n1) - (x - e1) * (n2 - n1) AS side FROM plane),
  w AS (SELECT image_id, gcp_id, min(sqrt((x - e1 - t * (e2 - e1)) ** 2 + (y - n1 - t * (n2 - n1)) ** 2)) AS dist, sum(CASE WHEN n1 <= y AND y < n2 AND side > 0 THEN 1 WHEN n2 <= y AND y < n1 AND side < 0 THEN -1 ELSE 0 END) AS winding FROM d GROUP BY image_id, gcp_id)
  SELECT image_id, gcp_id, round(CASE WHEN winding <> 0 THEN dist ELSE -dist END, 3) AS margin_m FROM w WHERE CASE WHEN winding <> 0 THEN dist ELSE -dist END >= -200000""")
def find_l1a_gcp_pairs(spark, sf_dir):
    got = pairing.find_pairs(_images(spark, sf_dir), _points(spark, sf_dir), -200_000.0)
    return got.select("image_id", "gcp_id", r(F.col("margin_m"), 3).alias("margin_m"))


@query("""WITH p AS (SELECT l_suppkey AS image_id, l_orderkey % 4 AS row, l_linenumber AS col, avg(l_quantity) AS lat, avg(l_discount) * 100 AS lon FROM lineitem GROUP BY 1, 2, 3),
  e AS (SELECT image_id, min(row) AS r0, max(row) AS r1, max(col) AS cmax FROM p GROUP BY 1)
  SELECT p.image_id, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon,
  round(arg_min(lat, struct_pack(a := row, b := col)), 6) AS first_lat, round(arg_max(lat, struct_pack(a := row, b := col)), 6) AS last_lat FROM p GROUP BY 1""")
def footprint_metadata(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") % 4).alias("row"), F.col("l_linenumber").alias("col")).agg(F.avg("l_quantity").alias("lat"), (F.avg("l_discount") * 100).alias("lon"))
    f = pairing.footprints(p)
    return f.select("image_id", *[r(F.col(c)).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")], r(F.col("c0.lat")).alias("first_lat"), r(F.col("c2.lat")).alias("last_lat"))


@query(f"""WITH p AS ({PLACE}), q AS (SELECT id % 97 AS k, CASE WHEN id % 97 < 50 THEN (lon + 360) % 20 - 10 + 175 ELSE lon / 4 END AS l FROM p), w AS (SELECT k, CASE WHEN l > 180 THEN l - 360 ELSE l END AS l FROM q),
  m AS (SELECT k, min(l) AS a, max(l) AS b, min((l + 360) % 360) AS c, max((l + 360) % 360) AS d FROM w GROUP BY k)
  SELECT k, {rs('CASE WHEN b - a <= 180 THEN a ELSE c END')} AS min_lon, {rs('CASE WHEN b - a <= 180 THEN b WHEN d > 180 THEN d - 360 ELSE d END')} AS max_lon FROM m""")
def minmax_longitude(spark, sf_dir):
    p = places(spark, sf_dir)
    q = p.select((F.col("id") % 97).alias("k"), F.when(F.col("id") % 97 < 50, (F.col("lon") + 360) % 20.0 - 10 + 175).otherwise(F.col("lon") / 4).alias("l"))
    got = pairing.minmax_longitude(q.select("k", F.when(F.col("l") > 180, F.col("l") - 360).otherwise(F.col("l")).alias("lon")), ["k"])
    return got.select("k", r(F.col("min_lon")).alias("min_lon"), r(F.col("max_lon")).alias("max_lon"))
