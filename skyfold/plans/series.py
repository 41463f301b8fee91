"""Queries of order-dependent operators, interval algebra, kernel catalogs and sources, over events and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfold.operators import intervals as I
from skyfold.operators import segments as S
from skyfold.operators.ranks import durable
from skyfold.sources import readers, writers

from .registry import query, r, rs, table


def _us(c="ts"):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ugps", _us())


@query("""WITH d AS (SELECT event_id, user_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 14400000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY e.ts, d.event_id) AS segment FROM d JOIN events e USING (event_id, user_id)""")
def gap_segments(spark, sf_dir):
    got = S.split_at_gaps(events(spark, sf_dir), ["user_id"], "ugps", 4 * 3_600_000_000, ["event_id"])
    return got.select("event_id", "user_id", "segment")


@query("""WITH d AS (SELECT event_id, user_id, ts, CASE WHEN ((epoch_us(ts) - lag(epoch_us(ts)) OVER w) // 1000000) % 86400 >= 30000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM d""")
def gap_segments_by_seconds_component(spark, sf_dir):
    """Steps compared by their seconds within a day, as the original does."""
    return S.split_at_gaps(events(spark, sf_dir), ["user_id"], "ugps", 30000 * 1_000_000, ["event_id"], seconds_component=True).select("event_id", "segment")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_latest(spark, sf_dir):
    return S.keep_latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


_GRAD = """CASE WHEN t0 IS NULL AND t2 IS NULL THEN NULL WHEN t0 IS NULL THEN (f2 - v) / (t2 - t) WHEN t2 IS NULL THEN (v - f0) / (t - t0)
  ELSE ((t - t0) ** 2 * f2 + ((t2 - t) ** 2 - (t - t0) ** 2) * v - (t2 - t) ** 2 * f0) / ((t - t0) * (t2 - t) * (t2 - t0)) END"""


@query(f"""WITH s AS (SELECT event_id, user_id, ts, value AS v, epoch_us(ts)::DOUBLE / 1e6 AS t FROM events), w AS (SELECT *, lag(v) OVER k AS f0, lead(v) OVER k AS f2, lag(t) OVER k AS t0, lead(t) OVER k AS t2 FROM s WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, {rs(_GRAD, 6)} AS rate FROM w""")
def central_difference_rate(spark, sf_dir):
    got = S.rates(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "ugps", "value", "rate")
    return got.select("event_id", F.when(~F.isnan("rate"), r(F.col("rate"))).alias("rate"))


@query(f"""WITH s AS (SELECT event_id, user_id, ts, value % 360 AS a, epoch_us(ts)::DOUBLE / 1e6 AS t FROM events), d AS (SELECT *, a - lag(a) OVER k AS d FROM s WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)),
  j AS (SELECT *, a + sum(CASE WHEN d > 180 THEN -360 WHEN d < -180 THEN 360 ELSE 0 END) OVER k AS v FROM d WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)),
  w AS (SELECT *, lag(v) OVER k AS f0, lead(v) OVER k AS f2, lag(t) OVER k AS t0, lead(t) OVER k AS t2 FROM j WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, {rs(_GRAD, 6)} AS rate FROM w""")
def unwrapped_angle_rate(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("angle", F.col("value") % 360)
    got = S.rates(e, ["user_id"], ["ts", "event_id"], "ugps", "angle", "rate", unwrap_degrees=True)
    return got.select("event_id", F.when(~F.isnan("rate"), r(F.col("rate"))).alias("rate"))


@query("SELECT event_id, round((epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6::DOUBLE, 6) AS seconds FROM events")
def seconds_from_first(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select("event_id", F.round(S.seconds_from_first("ugps", w), 6).alias("seconds"))


@query("""WITH d AS (SELECT user_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value AS d FROM events) SELECT user_id, round(avg(d), 6) + 0.0::DOUBLE AS mean_step, coalesce(bool_and(d > 0), true) AS increasing FROM d GROUP BY user_id""")
def mean_step_and_monotonicity(spark, sf_dir):
    got = S.mean_step(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value")
    return got.select("user_id", r(F.col("mean_step")).alias("mean_step"), "increasing")


# --- intervals: a customer's orders to their shipments, in days -----------------------------------------------------

DAYS = "w AS (SELECT o_custkey AS object_id, least(epoch_us(o_orderdate), epoch_us(l_shipdate)) // 86400000000 AS start, greatest(epoch_us(o_orderdate), epoch_us(l_shipdate)) // 86400000000 AS stop, o_orderpriority AS kind, l_linenumber AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
DAYS = DAYS.replace("greatest(epoch_us(o_orderdate), epoch_us(l_shipdate)) // 86400000000 AS stop", "least(epoch_us(o_orderdate), epoch_us(l_shipdate)) // 86400000000 + 20 + (o_orderkey % 90) AS stop")
MERGED = """i AS (SELECT *, sum(n) OVER (PARTITION BY object_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY object_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM (SELECT object_id, start, max(stop) AS stop FROM w GROUP BY object_id, start))),
mg AS (SELECT object_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY object_id, g)"""


def windows(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    day = lambda c: F.floor(_us(c) / 86_400_000_000).cast("long")
    start = F.least(day("o_orderdate"), day("l_shipdate"))
    return j.select(F.col("o_custkey").alias("object_id"), start.alias("start"), (start + 20 + F.col("o_orderkey") % 90).alias("stop"), F.col("o_orderpriority").alias("kind"), F.col("l_linenumber").alias("line"))


@query(f"WITH {DAYS}, {MERGED} SELECT * FROM mg")
def merge_windows(spark, sf_dir):
    return I.merge(windows(spark, sf_dir), ["object_id"])


@query(f"WITH {DAYS}, a AS (SELECT * FROM w WHERE line % 2 = 1), b AS (SELECT * FROM w WHERE line % 2 = 0) SELECT a.object_id, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM a JOIN b ON a.object_id = b.object_id AND a.start <= b.stop AND b.start <= a.stop")
def intersect_windows(spark, sf_dir):
    w = durable(windows(spark, sf_dir).select("object_id", "start", "stop", "line"))
    return I.intersect(w.where("line % 2 = 1").select("object_id", "start", "stop"), w.where("line % 2 = 0").select("object_id", "start", "stop"), ["object_id"], held=True)


@query(f"""WITH {DAYS}, {MERGED}, q AS (SELECT DISTINCT object_id, 9500 + object_id % 50 AS q0, 10200 AS q1 FROM w UNION SELECT -1, 9500, 10200),
  c AS (SELECT q.object_id, q0, q1, start, stop FROM q JOIN mg ON mg.object_id = q.object_id AND start <= q1 AND stop >= q0), l AS (SELECT *, coalesce(lag(stop) OVER k, q0) AS prev, lead(start) OVER k IS NULL AS last FROM c WINDOW k AS (PARTITION BY object_id ORDER BY start)),
  g AS (SELECT object_id, prev AS start, least(start, q1) AS stop FROM l UNION ALL SELECT object_id, greatest(stop, q0), q1 FROM l WHERE last UNION ALL SELECT object_id, q0, q1 FROM q WHERE object_id NOT IN (SELECT object_id FROM c))
  SELECT * FROM g WHERE start < stop""")
def coverage_gaps(spark, sf_dir):
    w = durable(windows(spark, sf_dir).select("object_id", "start", "stop"))
    ask = w.select("object_id").distinct().select("object_id", (F.lit(9500) + F.col("object_id") % 50).alias("start"), F.lit(10200).cast("long").alias("stop"))
    ask = ask.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("object_id"), F.lit(9500).cast("long").alias("start"), F.lit(10200).cast("long").alias("stop")))
    return I.gaps(w, ask, ["object_id"], held=True)


_FRACTIONS = """f AS (SELECT object_id, start + (line * 37 % 100) / 100.0::DOUBLE AS start, stop + (line * 37 % 100) / 100.0::DOUBLE + (line % 3) / 8.0::DOUBLE - 20 AS stop FROM w WHERE object_id IS NOT NULL),
  p AS (SELECT object_id, min(start) AS lo, max(stop) AS hi FROM f GROUP BY object_id),
  q AS (SELECT object_id, unnest([lo - 5.25, lo + (hi - lo) / 4, lo + (hi - lo) / 3]) AS q0, unnest([lo + (hi - lo) / 2, lo + (hi - lo) / 2, hi + 7.5]) AS q1 FROM p)"""


@query(f"""WITH {DAYS}, {_FRACTIONS}, e AS (SELECT object_id, start AS t FROM f UNION SELECT object_id, stop FROM f UNION SELECT object_id, q0 FROM q UNION SELECT object_id, q1 FROM q),
  c AS (SELECT object_id, t AS a, lead(t) OVER (PARTITION BY object_id ORDER BY t) AS b FROM e),
  u AS (SELECT q.object_id, q0, q1, a, b FROM q JOIN c ON q.object_id = c.object_id AND a >= q0 AND b <= q1 WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.object_id = q.object_id AND start <= a AND stop >= b)),
  i AS (SELECT *, sum(n) OVER (PARTITION BY object_id, q0, q1 ORDER BY a) AS g FROM (SELECT *, CASE WHEN a = lag(b) OVER k AND NOT EXISTS (SELECT 1 FROM f WHERE f.object_id = u.object_id AND start <= a AND stop >= a) THEN 0 ELSE 1 END AS n FROM u WINDOW k AS (PARTITION BY object_id, q0, q1 ORDER BY a)))
  SELECT object_id, {rs("q0")} AS request_start, {rs("q1")} AS request_stop, {rs("min(a)")} AS start, {rs("max(b)")} AS stop FROM i GROUP BY object_id, q0, q1, g""")
def coverage_gaps_of_requests(spark, sf_dir):
    """Three overlapping requests a key; windows and requests with fractions."""
    w = windows(spark, sf_dir).where(F.col("object_id").isNotNull())
    part = (F.col("line") * 37 % 100) / 100.0
    f = durable(w.select("object_id", (F.col("start") + part).alias("start"), (F.col("stop") + part + F.col("line") % 3 / 8.0 - 20).alias("stop")))
    p = I.rollup(f, ["object_id"])
    lo, hi = F.col("start"), F.col("stop")
    each = [(lo - 5.25, lo + (hi - lo) / 2), (lo + (hi - lo) / 4, lo + (hi - lo) / 2), (lo + (hi - lo) / 3, hi + 7.5)]
    q = p.select("object_id", F.inline(F.array(*[F.struct(a.alias("start"), b.alias("stop")) for a, b in each])))
    got = I.gaps(f, q, ["object_id"], with_request=True, held=True)
    return got.select("object_id", *[r(F.col(c)).alias(c) for c in ("request_start", "request_stop", "start", "stop")])


KERNELS = "cat AS (SELECT 'k' || (s_suppkey % 13) AS file, CASE s_suppkey % 13 % 4 WHEN 0 THEN 'SPK' WHEN 1 THEN 'CK' WHEN 2 THEN 'PCK' ELSE 'TEXT' END AS ktype, s_nationkey % 7 AS object_id, (s_suppkey * 37) % 500 AS start, (s_suppkey * 37) % 500 + 60 + s_suppkey % 80 AS stop FROM supplier)"


def kernels(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("SPK", "CK", "PCK", "TEXT"))), (k % 13 % 4 + 1).cast("int"))
    return s.select(F.concat(F.lit("k"), (k % 13).cast("string")).alias("file"), kind.alias("ktype"), (F.col("s_nationkey") % 7).alias("object_id"), (k * 37 % 500).alias("start"), (k * 37 % 500 + 60 + k % 80).alias("stop"))


_OBJECT_MERGE = MERGED.replace("FROM w GROUP", "FROM cat WHERE ktype <> 'TEXT' GROUP")


@query(f"WITH {KERNELS} SELECT file, object_id, min(start) AS start, max(stop) AS stop FROM cat GROUP BY ALL")
def coverage_rollup(spark, sf_dir):
    return I.rollup(kernels(spark, sf_dir), ["file", "object_id"])


@query(f"WITH {KERNELS} SELECT file, ktype, list_sort(list(DISTINCT object_id)) AS object_ids FROM cat WHERE ktype <> 'TEXT' GROUP BY ALL")
def kernel_catalog(spark, sf_dir):
    return I.kernel_catalog(kernels(spark, sf_dir))


@query(f"WITH {KERNELS}, {_OBJECT_MERGE} SELECT * FROM mg")
def object_coverage(spark, sf_dir):
    return I.object_coverage(kernels(spark, sf_dir))


@query(f"WITH {KERNELS}, {_OBJECT_MERGE}, a AS (SELECT * FROM mg WHERE object_id = 1), b AS (SELECT * FROM mg WHERE object_id = 2) SELECT greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM a JOIN b ON a.start <= b.stop AND b.start <= a.stop")
def valid_window(spark, sf_dir):
    return I.valid_window(kernels(spark, sf_dir), [1, 2])


@query(f"WITH {KERNELS}, w AS (SELECT file AS object_id, start, stop FROM cat WHERE object_id = 0 AND ktype <> 'TEXT'), {MERGED}, a AS (SELECT * FROM mg WHERE object_id = 'k10'), b AS (SELECT * FROM mg WHERE object_id = 'k8') SELECT greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM a JOIN b ON a.start <= b.stop AND b.start <= a.stop")
def pairwise_overlap(spark, sf_dir):
    return I.pairwise_overlap(kernels(spark, sf_dir), "k10", "k8", 0)


@query(f"WITH {KERNELS}, q AS (SELECT unnest([0, 3, 99, NULL]) AS object_id) SELECT object_id, CASE WHEN object_id IS NULL THEN 'could not be resolved' ELSE 'no kernel contains it' END AS reason FROM q WHERE object_id IS NULL OR object_id NOT IN (SELECT object_id FROM cat WHERE ktype <> 'TEXT')")
def missing_objects(spark, sf_dir):
    return I.missing_objects(kernels(spark, sf_dir), spark.createDataFrame([(0,), (3,), (99,), (None,)], "object_id int"))


# --- sources and sinks ---------------------------------------------------------------------------------------------


@query("SELECT event_id AS t, CASE WHEN value > 80 THEN NULL ELSE value END AS x FROM events WHERE value <= 80")
def kernel_input_rename_and_drop(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") <= 80, F.col("value")).when(F.col("value") > 200, F.lit(float("nan"))))
    return readers.kernel_input(e, {"event_id": "t", "value": "x"})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount + l_tax + 0 + 0 <> 0")
def drop_zero_quaternions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({"q2": F.lit(0.0), "q3": F.lit(0.0)})
    return readers.drop_zero_quaternions(li, ["l_discount", "l_tax", "q2", "q3"]).select("l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT event_id AS ert, value AS x FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id AS ert, user_id AS y FROM events WHERE event_id % 3 = 0), c AS (SELECT event_id AS ert, event_type AS z FROM events WHERE event_id % 5 = 0)
  SELECT ert, x, y, z FROM a FULL JOIN b USING (ert) FULL JOIN c USING (ert)""")
def merge_telemetry_packets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    part = lambda n, c, out: e.where(f"event_id % {n} = 0").select(F.col("event_id").alias("ert"), F.col(c).alias(out))
    return readers.merge_telemetry([part(2, "value", "x"), part(3, "user_id", "y"), part(5, "event_type", "z")])


@query("""WITH a AS (SELECT event_id AS ert, value AS x FROM events WHERE value <= 80 OR value IS NULL OR event_type = 'error'), b AS (SELECT event_id AS ert, user_id AS y FROM events WHERE value > 20), c AS (SELECT event_id AS ert, event_type AS z FROM events WHERE event_type IN ('click', 'view'))
  SELECT ert, x, y, z FROM a FULL JOIN b USING (ert) FULL JOIN c USING (ert)""")
def merge_overlapping_packets(spark, sf_dir):
    """Packets that overlap and leave no event out: every row of the table is in one at least."""
    e = table(spark, sf_dir, "events")
    part = lambda rows, c, out: e.where(rows).select(F.col("event_id").alias("ert"), F.col(c).alias(out))
    return readers.merge_telemetry([part("value <= 80 OR value IS NULL OR event_type = 'error'", "value", "x"), part("value > 20", "user_id", "y"), part("event_type IN ('click', 'view')", "event_type", "z")])


@query("SELECT user_id AS norad_cat_id, event_type AS epoch, event_id AS file FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1")
def read_two_line_elements(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("NORAD_CAT_ID"), F.col("event_type").alias("EPOCH"), F.col("ts").alias("CREATION_DATE"), F.col("event_id").alias("FILE"))
    return readers.read_tle(e, ["norad_cat_id", "epoch", "file"])


@query("""WITH f AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'x/readme.txt' ELSE 'x/' || lpad((s_suppkey % 9 * 10)::VARCHAR, 2, '0') || CASE WHEN s_suppkey % 2 = 0 THEN 'n' ELSE 's' END || lpad((s_suppkey % 12 * 30)::VARCHAR, 3, '0') || CASE WHEN s_suppkey % 5 = 0 THEN 'w' ELSE 'e' END || '_20101117_gmted_mea' || CASE s_suppkey % 4 WHEN 0 THEN '075' WHEN 1 THEN '150' ELSE '300' END || '.tif' END AS path FROM supplier)
  SELECT path, (s_suppkey % 9 * 10) * CASE WHEN s_suppkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1 END + 0.0::DOUBLE AS ll_lat, (s_suppkey % 12 * 30) * CASE WHEN s_suppkey % 5 = 0 THEN -1.0::DOUBLE ELSE 1 END + 0.0::DOUBLE AS ll_lon, 'mea' AS stat, CASE s_suppkey % 4 WHEN 0 THEN 7.5::DOUBLE WHEN 1 THEN 15 ELSE 30 END AS arcsec FROM f WHERE s_suppkey % 3 <> 0""")
def describe_elevation_tiles(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("x/"), F.lpad((k % 9 * 10).cast("string"), 2, "0"), F.when(k % 2 == 0, "n").otherwise("s"), F.lpad((k % 12 * 30).cast("string"), 3, "0"), F.when(k % 5 == 0, "w").otherwise("e"), F.lit("_20101117_gmted_mea"), F.when(k % 4 == 0, "075").when(k % 4 == 1, "150").otherwise("300"), F.lit(".tif"))
    files = table(spark, sf_dir, "supplier").select(F.when(k % 3 == 0, "x/readme.txt").otherwise(name).alias("path"))
    got = readers.describe_tiles(files)
    return got.select("path", (F.col("ll_lat") + 0.0).alias("ll_lat"), (F.col("ll_lon") + 0.0).alias("ll_lon"), "stat", "arcsec")


@query(r"""WITH l AS (SELECT doc_id, n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents))
  SELECT doc_id, n, length(line) > 132 AS too_long, contains(line, '"') AS has_quote, regexp_matches(line, '[^\x20-\x7E\t]') AS not_ascii FROM l WHERE length(line) > 132 OR contains(line, '"') OR regexp_matches(line, '[^\x20-\x7E\t]') OR len(list_filter(regexp_extract_all(line, '''([^'']*)''', 1), lambda s: length(s) > 80)) > 0""")
def text_kernel_issues(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "value"))
    got = writers.text_kernel_issues(lines)
    has = lambda m: F.array_contains("issues", m)
    return got.select("doc_id", "n", has("line over 132 characters").alias("too_long"), has("double quote").alias("has_quote"), has("not printable ASCII").alias("not_ascii"))


@query("SELECT n_nationkey AS pair_idx FROM nation WHERE n_regionkey <> 2")
def unfinished_pairs(spark, sf_dir):
    """What a sweep that broke off has left to do, from the partitions it wrote."""
    path = f"{writers.shared_folder(spark)}/results-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "pair_idx")
    n.where("n_regionkey = 2").select("pair_idx", F.lit(1.0).alias("rms_error_m")).write.mode("overwrite").partitionBy("pair_idx").parquet(path)
    return writers.unfinished(spark, n.select("pair_idx"), path)


@query("SELECT l_suppkey AS image_id, count(CASE WHEN l_tax > 0 THEN 1 END) AS valid_count, min(CASE WHEN l_tax > 0 THEN l_quantity END) AS valid_min, max(CASE WHEN l_tax > 0 THEN l_quantity END) AS valid_max FROM lineitem GROUP BY l_suppkey")
def raster_attributes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.when(F.col("l_tax") > 0, F.col("l_quantity")).otherwise(float("nan")).alias("value"))
    return writers.raster_attributes(li)
