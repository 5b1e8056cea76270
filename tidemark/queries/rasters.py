"""Rasters and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bands
from tidemark.operators import gates, ranking, raster, tiles
from tidemark.plans import rainfall
from tidemark.queries.base import query, table

_CELLS = "SELECT user_id AS row, CAST(day(ts) * 24 + hour(ts) AS INTEGER) AS col, round(avg(value), 4) AS v FROM events GROUP BY 1, 2"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("row"), (F.dayofmonth("ts") * 24 + F.hour("ts")).alias("col")).agg(F.round(F.avg("value"), 4).alias("v"))


@query("""
WITH b AS (SELECT CAST(floor(value / 0.25) AS BIGINT) AS bucket, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1),
s AS (SELECT bucket, mean, sum(n) OVER w AS w, sum(n * mean) OVER w AS mu, sum(n) OVER () AS total, sum(n * mean) OVER () AS mu_t FROM b WINDOW w AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING)),
v AS (SELECT bucket, mean, CASE WHEN w * (total - w) > 0 THEN pow(mu_t * w - mu * total, 2) / (w * (total - w) * total) ELSE 0 END AS sigma FROM s)
SELECT round(mean, 6) AS threshold FROM v ORDER BY round(sigma, 9) DESC, bucket LIMIT 1
""")
def q_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold of the largest between-class variance."""
    return raster.otsu(raster.histogram(table(spark, sf_dir, "events"), F.col("value"))).select(F.round("threshold", 6).alias("threshold"))


@query("""
WITH m AS (SELECT user_id, median(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS a, median(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY user_id)
SELECT user_id, round(b - a, 6) AS delta, CASE WHEN b - a >= 3 THEN 'strong' WHEN b - a >= 1.5 THEN 'weak' ELSE 'none' END AS signal FROM m
""")
def q_median_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians before and after, and the class of the change."""
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(F.median(F.when(early, F.col("value"))).alias("a"), F.median(F.when(~early, F.col("value"))).alias("b"))
    return m.select("user_id", F.round(F.col("b") - F.col("a"), 6).alias("delta"), bands.change_signal(F.col("b") - F.col("a")).alias("signal"))


@query("""
WITH e AS (SELECT TIMESTAMP '2024-01-30 00:00:00' AS e)
SELECT user_id, round(0.5 * coalesce(sum(value) FILTER (WHERE ts > e - INTERVAL 24 HOUR), 0), 4) AS mm_24h, round(0.5 * sum(value), 4) AS mm_72h, count(*) FILTER (WHERE ts > e - INTERVAL 24 HOUR) AS n_24h, count(*) AS n_72h,
  CASE WHEN 0.5 * coalesce(sum(value) FILTER (WHERE ts > e - INTERVAL 24 HOUR), 0) >= 120 THEN 'red' WHEN 0.5 * coalesce(sum(value) FILTER (WHERE ts > e - INTERVAL 24 HOUR), 0) >= 60 THEN 'orange'
       WHEN 0.5 * coalesce(sum(value) FILTER (WHERE ts > e - INTERVAL 24 HOUR), 0) >= 30 THEN 'yellow' ELSE 'none' END AS flag
FROM events, e WHERE ts > e - INTERVAL 72 HOUR AND ts <= e GROUP BY user_id
""")
def q_rain_accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both accumulations in one scan, pushed down to the longer window."""
    rain = table(spark, sf_dir, "events").select(F.col("user_id"), F.col("ts"), F.col("value").alias("mm_per_hr"))
    return rainfall.accumulate(rain, ["user_id"], F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))


@query("""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW), 4) AS mm FROM events
""")
def q_rolling_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 24 hours for every row, by range and not by rows."""
    return rainfall.rolling(table(spark, sf_dir, "events"), ["user_id"], "value").select("event_id", F.round("mm", 4).alias("mm"))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events) AS coverage FROM events GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS rn FROM d)
SELECT day, event_type, n, round(coverage, 6) AS coverage FROM g WHERE rn = 1 AND coverage >= 0.2 ORDER BY day DESC LIMIT 1
""")
def q_latest_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest day whose dominant group covers enough."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    whole = F.broadcast(e.agg(F.countDistinct("user_id").alias("all")))  # one row
    d = e.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("own")).join(whole, F.lit(True)).withColumn("coverage", F.col("own") / F.col("all"))
    lead = ranking.top_of_each(d, ["day"], [F.desc("n"), F.col("event_type")])
    return ranking.newest_where(lead, F.col("coverage") >= 0.2, "day").select("day", "event_type", "n", F.round("coverage", 6).alias("coverage"))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, -30 + avg(value) AS thr, sum(value) AS area, count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events) AS cov FROM events GROUP BY 1),
s AS (SELECT day, CASE WHEN cov < 0.55 THEN 'no_usable_pass' WHEN thr <= -24 + 1e-6 OR thr >= -14 - 1e-6 THEN 'degenerate_threshold' WHEN area > 4000 THEN 'low_confidence' ELSE 'ok' END AS scan_status FROM d)
SELECT s.day, scan_status, count(e.event_id) AS n_features FROM s LEFT JOIN events e ON CAST(e.ts AS DATE) = s.day AND scan_status = 'ok' GROUP BY ALL
""")
def q_status_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status for each layer; what isn't ok publishes no features."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    whole = F.broadcast(e.agg(F.countDistinct("user_id").alias("all")))  # one row
    d = e.groupBy("day").agg((F.avg("value") - 30).alias("thr"), F.sum("value").alias("area"), F.countDistinct("user_id").alias("own")).join(whole, F.lit(True)).withColumn("cov", F.col("own") / F.col("all"))
    status = d.select("day", gates.status_of_layer("extent", F.col("thr"), F.col("area"), F.col("cov"))[1])
    shown = gates.publishable(e, status, ["day"]).groupBy("day").agg(F.count("*").alias("n"))
    return status.join(shown, "day", "left").select("day", "scan_status", F.coalesce("n", F.lit(0)).alias("n_features"))


@query(f"""
WITH c AS ({_CELLS}), o AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM range(-1, 2) a(i), range(-1, 2) b(j)),
n AS (SELECT c.row, c.col, x.v FROM c, o, c x WHERE x.row = c.row + o.i AND x.col = c.col + o.j)
SELECT row, col, round(avg(v), 6) AS mean, round(median(v), 6) AS median, count(*) AS n FROM n GROUP BY row, col
""")
def q_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median of the neighbourhood."""
    found = tiles.focal(_cells(spark, sf_dir), raster.square(1), ["mean", "median", "count"], size=64)
    return found.select("row", "col", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.col("count").alias("n"))


@query(f"""
WITH c AS ({_CELLS}),
g AS (SELECT c.row, c.col, (e.v - w.v) / 60 AS dx, (n.v - s.v) / 60 AS dy FROM c JOIN c e ON e.row = c.row AND e.col = c.col + 1 JOIN c w ON w.row = c.row AND w.col = c.col - 1 JOIN c n ON n.row = c.row + 1 AND n.col = c.col JOIN c s ON s.row = c.row - 1 AND s.col = c.col)
SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope FROM g
""")
def q_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope from the four neighbours."""
    return tiles.slope_degrees(_cells(spark, sf_dir), 30.0, "v", 64).where("slope is not null").select("row", "col", F.round("slope", 6).alias("slope"))


@query(f"""
WITH RECURSIVE c AS (SELECT row, col, row * 10000 + col AS id FROM ({_CELLS}) WHERE v >= 12),
e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
l AS (SELECT a AS id, min(b) AS label, count(*) AS size FROM r GROUP BY a)
SELECT CAST(id // 10000 AS BIGINT) AS row, CAST(id % 10000 AS INTEGER) AS col, CAST(label // 10000 AS BIGINT) AS c_row, CAST(label % 10000 AS INTEGER) AS c_col, size FROM l
""")
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-connected components of the wet cells and their sizes."""
    c = raster.components(_cells(spark, sf_dir).where("v >= 12"))
    return c.select(F.col("row").cast("long").alias("row"), "col", F.col("component.row").cast("long").alias("c_row"), F.col("component.col").alias("c_col"), "size")


@query(f"""
WITH c AS ({_CELLS}), p AS (SELECT row, avg(v) AS occ FROM c GROUP BY row)
SELECT count(*) FILTER (WHERE occ * 5 >= 50 OR col % 24 = 0) AS permanent, count(*) FILTER (WHERE v < 5 AND NOT (occ * 5 >= 50 OR col % 24 = 0)) AS flooded, count(*) FILTER (WHERE v < 5 AND row / 40.0 < 5) AS standing, count(*) FILTER (WHERE v < 5 AND (row / 40.0 < 3 AND (col / 10.0 < 30 OR occ >= 10.5))) AS plausible FROM c JOIN p USING (row)
""")
def q_mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permanent water and terrain masks on aligned cells."""
    c = _cells(spark, sf_dir)
    j = c.join(c.groupBy("row").agg(F.avg("v").alias("occ")), "row")
    perm = tiles.permanent_water(F.col("occ") * 5, F.when(F.col("col") % 24 == 0, 1))
    slope = F.col("row") / 40.0
    plausible = tiles.flood_plausible(slope, F.col("col") / 10.0, F.when(F.col("occ") >= 10.5, F.col("occ")).otherwise(F.lit(None).cast("double")))
    n = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    dark = F.col("v") < 5
    return j.agg(n(perm).alias("permanent"), n(dark & ~perm).alias("flooded"), n(dark & tiles.slope_ok(slope)).alias("standing"), n(dark & plausible).alias("plausible"))


@query("""
WITH s AS (SELECT count(*) FILTER (WHERE a AND b) AS i, count(*) FILTER (WHERE a) AS p, count(*) FILTER (WHERE b) AS g, count(*) FILTER (WHERE a OR b) AS u FROM (SELECT l_discount > 0.05 AS a, l_quantity > 24 AS b FROM lineitem))
SELECT round(i / greatest(u, 1), 6) AS iou, round(i / greatest(p, 1), 6) AS precision, round(i / greatest(g, 1), 6) AS recall, round(2 * (i / greatest(p, 1)) * (i / greatest(g, 1)) / (i / greatest(p, 1) + i / greatest(g, 1)), 6) AS f1 FROM s
""")
def q_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two masks."""
    return raster.overlap(table(spark, sf_dir, "lineitem"), F.col("l_discount") > 0.05, F.col("l_quantity") > 24)


@query(f"""
WITH c AS ({_CELLS}), z AS (SELECT row // 15 AS zone, v, row, col FROM c)
SELECT CAST(zone AS BIGINT) AS zone, round(sum(v), 3)::DOUBLE AS total, max(v) AS peak, round(avg(v), 6) AS mean, count(*) FILTER (WHERE v >= 12) AS wet, arg_min(v, row * 10000 + col) AS first FROM z GROUP BY zone
""")
def q_zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zonal sum, maximum, mean and first value."""
    z = _cells(spark, sf_dir).withColumn("zone", F.floor(F.col("row") / 15).cast("long"))
    return z.groupBy("zone").agg(F.round(F.sum("v"), 3).alias("total"), F.max("v").alias("peak"), F.round(F.avg("v"), 6).alias("mean"), F.sum(F.when(F.col("v") >= 12, 1).otherwise(0)).cast("long").alias("wet"), F.min_by("v", F.col("row") * 10000 + F.col("col")).alias("first"))


@query(f"""
WITH RECURSIVE c AS ({_CELLS}), b AS (SELECT row, median(v) - 20 AS base_vh FROM c GROUP BY row), o AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM range(-1, 2) a(i), range(-1, 2) b(j)),
s AS (SELECT c.row, c.col, median(x.v - 25) AS vh FROM c, o, c x WHERE x.row = c.row + o.i AND x.col = c.col + o.j AND abs(o.i) + abs(o.j) <= 1 GROUP BY c.row, c.col),
h AS (SELECT CAST(floor(vh / 0.25) AS BIGINT) AS bucket, count(*) AS n, avg(vh) AS mean FROM s GROUP BY 1),
w AS (SELECT bucket, mean, sum(n) OVER u AS w, sum(n * mean) OVER u AS mu, sum(n) OVER () AS total, sum(n * mean) OVER () AS mu_t FROM h WINDOW u AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING)),
t AS (SELECT greatest(-24.0, least(-14.0, mean)) AS thr FROM w ORDER BY round(CASE WHEN w * (total - w) > 0 THEN pow(mu_t * w - mu * total, 2) / (w * (total - w) * total) ELSE 0 END, 9) DESC, bucket LIMIT 1),
m AS (SELECT s.row, s.col, CASE WHEN vh < thr AND vh - base_vh < -1 AND s.col % 24 <> 0 THEN 1.0 ELSE 0.0 END AS v FROM s JOIN b ON s.row = b.row CROSS JOIN t),
f AS (SELECT c.row, c.col, CASE WHEN avg(x.v) > 0.42 THEN 1.0 ELSE 0.0 END AS v FROM m c, o, m x WHERE x.row = c.row + o.i AND x.col = c.col + o.j GROUP BY c.row, c.col),
k AS (SELECT c.row, c.col, c.row * 10000 + c.col AS id FROM f c, o, f x WHERE x.row = c.row + o.i AND x.col = c.col + o.j AND abs(o.i) + abs(o.j) <= 1 AND c.col % 24 <> 0 GROUP BY c.row, c.col HAVING avg(x.v) > 0.5),
e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT CAST(a // 10000 AS BIGINT) AS row, CAST(a % 10000 AS INTEGER) AS col, count(*) AS size FROM r GROUP BY a HAVING count(*) >= 2
""")
def q_flood_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole detection on the event grid."""
    from tidemark.plans import extent

    c = _cells(spark, sf_dir)
    base = c.groupBy("row").agg(F.median("v").alias("base_v"))
    cells = c.join(base, "row").select("row", "col", (F.col("v") - 25).alias("vh"), (F.col("base_v") - 20).alias("base_vh"), (F.col("col") % 24 == 0).alias("perm"), F.lit(1.0).alias("slope"), F.lit(True).alias("plausible"))
    return extent.detect(cells, least_size=2).select(F.col("row").cast("long").alias("row"), "col", "size")


@query("""
SELECT a.event_type, count(*) AS n FROM (SELECT DISTINCT event_type, user_id % 7 AS track FROM events WHERE ts >= TIMESTAMP '2024-01-20') a JOIN (SELECT DISTINCT event_type, user_id % 7 AS track, CAST(ts AS DATE) AS d FROM events WHERE ts < TIMESTAMP '2024-01-10') b ON a.event_type = b.event_type AND a.track = b.track GROUP BY 1
""")
def q_same_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline scenes of the same direction and track."""
    from tidemark.operators import joins

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("orbit_pass"), (F.col("user_id") % 7).alias("rel_orbit"), "ts")
    new = e.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).select("orbit_pass", "rel_orbit", F.lit(0).alias("scene_id")).distinct()
    old = e.where(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).select("orbit_pass", "rel_orbit", F.to_date("ts").alias("scene_id")).distinct()
    return joins.same_track(new, old).groupBy(F.col("orbit_pass").alias("event_type")).agg(F.count("*").alias("n"))
