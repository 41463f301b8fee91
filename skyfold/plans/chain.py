"""Queries of the geolocation chain, of names and ids, and of what stands around image matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions import constants as K
from skyfold.functions import naming
from skyfold.operators import checks, geolocation, matching

from .rasters import CELLS, images
from .registry import query, r, rs, table

A, B, E2 = K.WGS84_A_KM, K.WGS84_B_KM, K.WGS84_E2


@query("SELECT n_nationkey, -100000 - n_nationkey AS spacecraft_id, -100000 - n_nationkey AS clock_id, (-100000 - n_nationkey) * 1000 AS attitude_id, (-100000 - n_nationkey) * 1000 - 1 AS imager_id, (-100000 - n_nationkey) * 1000 - 2 AS sounder_id FROM nation")
def inferred_ids(spark, sf_dir):
    got = naming.infer_ids(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey")), "n_nationkey", ["imager", "sounder"], "norad")
    return got.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "spacecraft_id", "clock_id", "attitude_id", F.col("instrument_ids")["imager"].alias("imager_id"), F.col("instrument_ids")["sounder"].alias("sounder_id"))


@query("SELECT n.n_nationkey AS spacecraft, s.s_suppkey AS suppkey, -(n.n_nationkey + 1) * 1000 - s.s_suppkey AS instrument FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey BETWEEN 1 AND 999")
def instruments_of_spacecraft(spark, sf_dir):
    """Ids made from suppliers and their nations lead back to the nation."""
    n = table(spark, sf_dir, "nation").select((-(F.col("n_nationkey").cast("long") + 1)).alias("spacecraft_id"))
    b = table(spark, sf_dir, "supplier").where("s_suppkey < 1000").select(F.col("s_suppkey").cast("string").alias("name"), (-(F.col("s_nationkey").cast("long") + 1) * 1000 - F.col("s_suppkey")).alias("id"))
    got = naming.instruments_of(n, b)
    return got.select((-F.col("spacecraft_id") - 1).cast("int").alias("spacecraft"), F.col("name").cast("long").alias("suppkey"), F.col("id").alias("instrument"))


@query("""WITH RECURSIVE f AS (SELECT 'F' || r_regionkey AS name, 900 + r_regionkey AS id, CASE WHEN r_regionkey = 0 THEN 2 WHEN r_regionkey = 1 THEN 3 ELSE 4 END AS class, 900 + r_regionkey - 2 AS up, 70 + r_regionkey AS class_id FROM region),
  c AS (SELECT id, id AS at FROM f UNION SELECT c.id, f.up FROM c JOIN f ON f.id = c.at AND f.class = 4),
  ends AS (SELECT c.id, f.class, f.class_id FROM c JOIN f ON f.id = c.at WHERE f.class <> 4)
  SELECT n_name AS name, 100 + n_nationkey AS spk_id, 900 + n_regionkey AS ck_id, CASE WHEN class = 2 THEN class_id END AS pck_id FROM nation JOIN ends ON ends.id = 900 + n_regionkey""")
def target_identifiers(spark, sf_dir):
    """Nations as bodies, regions as frames; frames 2 to 4 are aliases of those two before."""
    k = F.col("r_regionkey").cast("long")
    frames = table(spark, sf_dir, "region").select(F.concat(F.lit("F"), k.cast("string")).alias("name"), (k + 900).alias("id"), F.when(k == 0, 2).when(k == 1, 3).otherwise(4).alias("class"), (k + 70).alias("class_id"), (k + 898).alias("alias_of"))
    bodies = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey").cast("long") + 100).alias("id"), F.concat(F.lit("F"), F.col("n_regionkey").cast("string")).alias("frame"))
    return naming.target_ids(bodies.select("name"), bodies, frames)


@query("SELECT event_type, CASE event_type WHEN 'error' THEN 'coverage' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY event_type")
def error_classes(spark, sf_dir):
    short = F.when(F.col("event_type") == "error", "SPICE(SPKINSUFFDATA)").otherwise(F.concat(F.lit("SPICE("), "event_type", F.lit(")")))
    return table(spark, sf_dir, "events").groupBy("event_type", naming.error_class(short).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, l_discount::DOUBLE AS z FROM l WHERE i = n // 2")
def mid_frame_positions(spark, sf_dir):
    """An order's lines as the telemetry of one observation."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").alias("at"), F.col("l_quantity").alias("sc_pos_x"), F.col("l_extendedprice").alias("sc_pos_y"), F.col("l_discount").alias("sc_pos_z"))
    return matching.mid_frame(t, "l_orderkey", "at")


@query(f"SELECT event_id, {rs('(value / 1000) / 111.0::DOUBLE', 9)} AS lat_error_deg, {rs(f'(value / 500) / ({A}::DOUBLE * cos(radians(event_id % 80)) * pi() / 180)', 9)} AS lon_error_deg FROM events")
def error_in_degrees(spark, sf_dir):
    lat, lon = matching.km_to_degrees(F.col("value") / 1000, F.col("value") / 500, F.col("event_id") % 80)
    return table(spark, sf_dir, "events").select("event_id", r(lat, 9).alias("lat_error_deg"), r(lon, 9).alias("lon_error_deg"))


@query(f"SELECT s_suppkey AS id, {rs(f'(s_suppkey % 300) - 150 - 5.0::DOUBLE / (2 * pi() * {A}::DOUBLE / 360)', 9)} AS min_lon, {rs(f'(s_suppkey % 120) - 60 + 5.0::DOUBLE / (2 * pi() * {A}::DOUBLE / 360)', 9)} AS max_lat FROM supplier")
def elevation_padded_box(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 300 - 150).cast("double").alias("lon"), (F.col("s_suppkey") % 120 - 60).cast("double").alias("lat"))
    return geolocation.padded_box(p, 5.0).select("id", r(F.col("min_lon"), 9).alias("min_lon"), r(F.col("max_lat"), 9).alias("max_lat"))


_CHIP = f"{CELLS}, chip AS (SELECT image_id, k // 8 AS i, k % 8 AS j, (k % 8) * 0.01::DOUBLE + (k // 8) * 0.0002::DOUBLE * (image_id % 5) AS lon, 10 - (k // 8) * 0.01::DOUBLE + (k % 8) * 0.0001::DOUBLE * (image_id % 3) AS lat FROM cells)"


@query(f"WITH {_CHIP} SELECT image_id, {rs('max(CASE WHEN j = 0 AND i IN (0, 7) THEN lon END)')} AS min_lon, {rs('min(CASE WHEN j = 7 AND i IN (0, 7) THEN lon END)')} AS max_lon, {rs('max(CASE WHEN i = 7 AND j IN (0, 7) THEN lat END)')} AS min_lat, {rs('min(CASE WHEN i = 0 AND j IN (0, 7) THEN lat END)')} AS max_lat FROM chip GROUP BY image_id")
def chip_bounds(spark, sf_dir):
    """The largest box inside skewed chips' corners."""
    c = images(spark, sf_dir).select("image_id", "row", "col", (F.col("col") * 0.01 + F.col("row") * 0.0002 * (F.col("image_id") % 5)).alias("lon"), (10 - F.col("row") * 0.01 + F.col("col") * 0.0001 * (F.col("image_id") % 3)).alias("lat"))
    return matching.grid_bounds(c, "image_id").select("image_id", *[r(F.col(x)).alias(x) for x in ("min_lon", "max_lon", "min_lat", "max_lat")])


@query("SELECT l_orderkey AS table_index, l_linenumber AS measurement, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE 'result_' || l_orderkey END AS sci_key, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE 'gcp_' || l_orderkey END AS gcp_key FROM lineitem")
def measurement_sources(spark, sf_dir):
    attrs = F.map_from_arrays(F.array(F.lit("science_file"), F.lit("gcp_key")), F.array(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag"))))
    return checks.source_keys(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_index"), F.col("l_linenumber").alias("measurement"), attrs.alias("attrs")))


_LINE = f"""t AS (SELECT DISTINCT (s_suppkey % 1199) * 500000 AS ugps FROM supplier),
f AS (SELECT ugps, 7000.0::DOUBLE AS px, 7.5::DOUBLE * (ugps / 1e6::DOUBLE) - 300 AS py, 0.5::DOUBLE * (ugps / 1e6::DOUBLE) + 100 AS pz FROM t),
d AS (SELECT f.*, r_regionkey + 1 AS pixel, -1.0::DOUBLE AS dx, (r_regionkey - 1) * 0.3::DOUBLE AS dy, 0.02::DOUBLE * r_regionkey AS dz FROM f, region),
q AS (SELECT *, dx*dx/{A * A!r}::DOUBLE + dy*dy/{A * A!r}::DOUBLE + dz*dz/{B * B!r}::DOUBLE AS uu, dx*px/{A * A!r}::DOUBLE + dy*py/{A * A!r}::DOUBLE + dz*pz/{B * B!r}::DOUBLE AS uq, px*px/{A * A!r}::DOUBLE + py*py/{A * A!r}::DOUBLE + pz*pz/{B * B!r}::DOUBLE - 1 AS c FROM d),
k AS (SELECT *, CASE WHEN uq*uq - uu*c >= 0 AND uq < 0 THEN (-uq - sqrt(uq*uq - uu*c)) / uu END AS s FROM q),
g AS (SELECT *, px + s*dx AS gx, py + s*dy AS gy, pz + s*dz AS gz FROM k),
h AS (SELECT *, atan2(gy, gx) AS lo, atan2(gz / {1 - E2!r}::DOUBLE, sqrt(gx*gx + gy*gy)) AS la, px - gx AS vx, py - gy AS vy, pz - gz AS vz, 1.5e8::DOUBLE - gx AS sx, -gy AS sy, 1e7::DOUBLE - gz AS sz FROM g)"""


def _zenith(v: str) -> str:
    return f"degrees(acos((cos(la)*cos(lo)*{v}x + cos(la)*sin(lo)*{v}y + sin(la)*{v}z) / sqrt({v}x*{v}x + {v}y*{v}y + {v}z*{v}z)))"


def _azimuth(v: str) -> str:
    a = f"degrees(atan2(-sin(lo)*{v}x + cos(lo)*{v}y, -sin(la)*cos(lo)*{v}x - sin(la)*sin(lo)*{v}y + cos(la)*{v}z))"
    return f"({a} + 360) % 360"


@query(f"""WITH {_LINE} SELECT ugps, pixel, {rs('degrees(lo)')} AS lon, {rs('degrees(la)')} AS lat, {rs(_zenith('v'), 4)} AS view_zenith, {rs(_azimuth('v'), 4)} AS view_azimuth,
  {rs(_zenith('s'), 4)} AS solar_zenith, {rs(_azimuth('s'), 4)} AS solar_azimuth, {rs('px * 1000', 3)} AS spacecraft_x, CASE WHEN s IS NULL THEN 512 ELSE 0 END AS qf FROM h""")
def geolocation_chain(spark, sf_dir):
    """From samples to the product: lookups of state and attitude, pixels, ellipsoid, Sun, angles, flags. The satellite moves on a line, its axes are the Earth's."""
    sec = F.col("id") * 60.0
    at = spark.range(11).select(F.lit(1).alias("object_id"), F.lit(1).alias("frame"), (F.col("id") * 60_000_000).alias("ugps"), F.lit(7000.0).alias("x"), (sec * 7.5 - 300).alias("y"), (sec * 0.5 + 100).alias("z"), F.lit(0.0).alias("vx"), F.lit(7.5).alias("vy"), F.lit(0.5).alias("vz"), F.lit(1.0).alias("q0"), *[F.lit(0.0).alias(f"q{i}") for i in (1, 2, 3)])
    times = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 1199 * 500_000).cast("long").alias("ugps")).distinct().withColumns({"object_id": F.lit(1), "frame": F.lit(1)})
    k = F.col("r_regionkey")
    pixels = table(spark, sf_dir, "region").select((k + 1).alias("pixel"), F.lit(-1.0).alias("vx"), ((k - 1) * 0.3).alias("vy"), (k * 0.02).alias("vz"))
    frames = geolocation.frames_at(times, at.select("object_id", "ugps", "x", "y", "z", "vx", "vy", "vz"), at.select("frame", "ugps", *[f"q{i}" for i in range(4)]))
    rows = geolocation.on_ellipsoid(geolocation.pointing_state(frames.drop("object_id", "frame"), pixels))
    sun = times.select("ugps", F.lit(1.5e8).alias("x"), F.lit(0.0).alias("y"), F.lit(1e7).alias("z"))
    got = geolocation.product(geolocation.with_targets(rows, sun, "sun"))
    none = lambda c, n: F.when(~F.isnan(c), r(F.col(c), n)).alias(c)
    return got.select("ugps", "pixel", none("lon", 6), none("lat", 6), *[none(c, 4) for c in ("view_zenith", "view_azimuth", "solar_zenith", "solar_azimuth")], none("spacecraft_x", 3), "qf")
