"""Queries of composite products and of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyfold.functions.vec import Vec
from skyfold.operators import products
from skyfold.operators.ranks import shared_folder
from skyfold.streaming import streams

from .geo import ECEF, PIXELS, states
from .registry import query, r, rs, table


@query(f"""WITH {ECEF}, px AS ({PIXELS}), w AS (SELECT p.id, pixel, lon, lat, x / sqrt(x*x+y*y+z*z) AS ux, y / sqrt(x*x+y*y+z*z) AS uy, z / sqrt(x*x+y*y+z*z) AS uz FROM p, px)
  SELECT id AS ugps, pixel, CASE WHEN pixel <= 4 THEN {rs('lon', 4)} END AS lon, CASE WHEN pixel <= 4 THEN 0 ELSE 512 END AS qf FROM w""")
def geolocate_product(spark, sf_dir):
    """Pixels that look down the radius (1 to 4, all the same) or away from it (5); the radius meets the surface at the same longitude."""
    s = states(spark, sf_dir)
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    u = [F.col(a) / n for a in "xyz"]
    frames = s.select(F.col("id").alias("ugps"), *Vec.columns("").times(1.1).named("p"), *[c.alias(f"r{k}") for k, c in enumerate([F.lit(0.0), F.lit(0.0), u[0], F.lit(0.0), F.lit(0.0), u[1], F.lit(0.0), F.lit(0.0), u[2]])], F.lit(1.5e8).alias("sun_x"), F.lit(0.0).alias("sun_y"), F.lit(1e7).alias("sun_z"))
    px = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("pixel"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), F.when(F.col("r_regionkey") < 4, -1.0).otherwise(1.0).alias("vz"))
    got = products.geolocate(frames, px)
    return got.select("ugps", "pixel", F.when(~F.isnan("lon"), r(F.col("lon"), 4)).alias("lon"), "qf")


@query(f"""WITH {ECEF}, s AS (SELECT id, x * 1.1::DOUBLE AS x, y * 1.1::DOUBLE AS y, z * 1.1::DOUBLE AS z FROM p), d AS (SELECT *, sqrt(x*x+y*y+z*z) AS l, sqrt((1.5e8::DOUBLE - x)**2 + y*y + (1e7::DOUBLE - z)**2) AS sl FROM s)
  SELECT id AS ugps, {rs('-x / l', 6)} AS earth_cosine, {rs('(1.5e8::DOUBLE - x) / sl', 6)} AS sun_cosine, CASE WHEN degrees(acos((1.5e8::DOUBLE - x) / sl)) <= 40 THEN 1 ELSE 0 END AS sun_in_view FROM d""")
def pointing_product(spark, sf_dir):
    s = states(spark, sf_dir).select(F.col("id").alias("ugps"), *Vec.columns("").times(1.1).named("sc_"), *[F.lit(v).alias(f"b_{a}") for a, v in zip("xyz", (1.0, 0.0, 0.0))], *[F.lit(v).alias(f"sun_{a}") for a, v in zip("xyz", (1.5e8, 0.0, 1e7))], *[F.lit(v).alias(f"moon_{a}") for a, v in zip("xyz", (0.0, 3.8e5, 0.0))])
    got = products.pointing(s, 40.0)
    return got.select("ugps", r(F.col("earth_cosine")).alias("earth_cosine"), r(F.col("sun_cosine")).alias("sun_cosine"), "sun_in_view")


@query(f"""WITH {ECEF}, s AS (SELECT id, x * 23500.0::DOUBLE AS x, y * 23500.0::DOUBLE AS y, z * 23500.0::DOUBLE AS z FROM p) SELECT id AS ugps, {rs('(149597870.7::DOUBLE / sqrt(x*x+y*y+z*z)) ** 2', 9)} AS sun_distance_correction,
  {rs('1 - ((7.5::DOUBLE * x - 1.0::DOUBLE * z) / sqrt(x*x+y*y+z*z)) / 299792.458::DOUBLE', 12)} AS sun_doppler_factor FROM s""")
def solar_correction_product(spark, sf_dir):
    s = states(spark, sf_dir).select(F.col("id").alias("ugps"), *Vec.columns("").times(23500.0).named(""), F.lit(7.5).alias("vx"), F.lit(0.0).alias("vy"), F.lit(-1.0).alias("vz"))
    got = products.corrections(s)
    return got.select("ugps", r(F.col("sun_distance_correction"), 9).alias("sun_distance_correction"), r(F.col("sun_doppler_factor"), 12).alias("sun_doppler_factor"))


def _drain(stream, spark):
    """Run a stream over what is there, to its end (complete mode), and return its result, which executors write to the shared folder: it may be as long as the input."""
    folder, kept = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", []

    def delete(name: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def keep(batch, i: int) -> None:  # a batch holds the whole result so far
        batch.write.mode("overwrite").parquet(f"{folder}/result-{i}")
        kept.append(i)

    stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    for name in ["state", *[f"result-{i}" for i in kept[:-1]]]:
        delete(name)
    return spark.read.schema(stream.schema).parquet(f"{folder}/result-{kept[-1]}") if kept else spark.createDataFrame([], stream.schema)


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return src.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n, round(avg(value), 6) AS mean_error_m, round(sqrt(avg(value * value)), 6) AS rms_error_m, round(max(value), 6) AS max_error_m, round(avg(CASE WHEN value < 250 THEN 100.0::DOUBLE ELSE 0 END), 6) AS percent_within FROM events GROUP BY 1")
def streaming_error_statistics(spark, sf_dir):
    """Tumbling windows over a stream that is read to its end (complete mode, so no window stays open)."""
    e = _stream(spark, sf_dir).withColumnRenamed("value", "nadir_equiv_error_m")
    got = _drain(streams.windowed_error_statistics(e, "ts"), spark)
    return got.select(F.unix_micros("start").alias("start_us"), "n", *[F.round(c, 6).alias(c) for c in ("mean_error_m", "rms_error_m", "max_error_m", "percent_within")])


@query("""WITH d AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 14400000000 THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM d)
  SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS stop_us, count(*) AS n FROM s GROUP BY user_id, g""")
def streaming_sessions(spark, sf_dir):
    got = _drain(streams.sessions(_stream(spark, sf_dir), "ts", "user_id", 14_400_000_000), spark)
    return got.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "n")
