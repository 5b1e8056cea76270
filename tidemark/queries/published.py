"""Scenes, masks, overlaps, gates and states of published layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bands, normalise
from tidemark.operators import gates, ranking, spatial
from tidemark.plans import accountability, exposure, extent
from tidemark.queries.base import query, table
from tidemark.queries.evidence import _KNN_SQL, _POLYGONS, _customers, _edge_rows, _polygons, _sites
from tidemark.sources import scenes

_SCENES = """SELECT o_orderkey AS scene_id, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS mode, o_orderkey % 3 = 0 AS dual, 117 + (o_custkey % 100) / 10.0 AS west, 117.5 + (o_custkey % 100) / 10.0 AS east,
  5 + (o_orderkey % 160) / 10.0 AS south, 5.5 + (o_orderkey % 160) / 10.0 AS north FROM orders"""


@query(f"""
WITH s AS ({_SCENES}), k AS (SELECT scene_id, day FROM s WHERE day >= DATE '1995-01-01' AND day < DATE '1997-01-01' AND mode = 'F' AND dual AND west <= 124 AND east >= 119 AND south <= 18 AND north >= 8)
SELECT k.day, count(DISTINCT scene_id) AS n_scenes, count(*) AS n_cells, round(avg(-l_quantity), 6) AS mean_vh FROM k JOIN lineitem ON l_orderkey = scene_id GROUP BY k.day
""")
def q_scene_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes by box, dates, mode and polarisation, and one band of their cells by date."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    both = F.when(k % 3 == 0, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("VV")))
    collection = table(spark, sf_dir, "orders").select(
        k.alias("scene_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("mode"), both.alias("pols"), (117 + (c % 100) / 10.0).alias("west"), (117.5 + (c % 100) / 10.0).alias("east"),
        (5 + (k % 160) / 10.0).alias("south"), (5.5 + (k % 160) / 10.0).alias("north"),
    )
    chosen = scenes.scenes(collection, (119, 8, 124, 18), "1995-01-01", "1997-01-01", "F", "VH")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_partkey").alias("row"), F.col("l_linenumber").alias("col"), (-F.col("l_quantity")).alias("vh"))
    found = scenes.scene_cells(cells.join(collection.select("scene_id", "day"), "scene_id"), chosen, ["vh"])
    return found.groupBy("day").agg(F.countDistinct("scene_id").alias("n_scenes"), F.count("*").alias("n_cells"), F.round(F.avg("vh"), 6).alias("mean_vh"))


@query("""
WITH c AS (SELECT user_id % 40 AS row, hour(ts) AS col, day(ts) AS ev, value > 14 AS wet FROM events),
s AS (SELECT row, col, bool_or(ev <= 15) AS t, bool_or(ev BETWEEN 16 AND 25) AS h FROM c WHERE wet GROUP BY ALL), l AS (SELECT DISTINCT row, col FROM c)
SELECT l.row, l.col, CASE WHEN s.row IS NULL THEN 'never' WHEN t AND NOT h THEN 'train' ELSE 'holdout' END AS mask FROM l LEFT JOIN s ON l.row = s.row AND l.col = s.col WHERE s.row IS NULL OR t <> h
""")
def q_label_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells flooded by training events only, by held-out events only, or never."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("row"), F.hour("ts").cast("long").alias("col"), F.dayofmonth("ts").alias("event_id"), (F.col("value") > 14).cast("int").alias("flooded"))
    split = spark.range(1, 26).select(F.col("id").cast("int").alias("event_id"), F.when(F.col("id") <= 15, "train").otherwise("holdout").alias("grp"))
    return scenes.label_masks(e, e.select("row", "col"), split)


@query(f"""
WITH e(poly_id, x1, y1, x2, y2) AS (VALUES {_edge_rows()}), g AS (SELECT r.row, c.col FROM range(0, 60) r(row), range(0, 100) c(col)),
u AS (SELECT poly_id, row, col FROM g JOIN e ON (y1 > row + 0.5) <> (y2 > row + 0.5) AND col + 0.5 < (x2 - x1) * (row + 0.5 - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
f AS (SELECT DISTINCT o_orderpriority AS day, CAST(floor(o_totalprice / 5000) AS BIGINT) AS col, CAST(floor(CAST(o_orderkey % 5000 AS DOUBLE) / 100) AS BIGINT) AS row FROM orders),
n AS (SELECT poly_id, count(*) AS n FROM u GROUP BY 1), w AS (SELECT poly_id, day, count(*) AS w FROM u JOIN f USING (row, col) GROUP BY ALL)
SELECT poly_id, day, CAST(w * 0.25 AS DOUBLE) AS area, round(w / n, 6) AS share FROM w JOIN n USING (poly_id)
""")
def q_area_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each unit under each day's flood, by common cells."""
    units = exposure.polygon_cells(spatial.edges(_polygons(spark)), 1.0)
    floods = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("day"), F.floor(F.col("o_totalprice") / 5000).alias("col"), F.floor((F.col("o_orderkey") % 5000).cast("double") / 100).alias("row"))
    return exposure.overlap(units, floods, 0.25, "poly_id").withColumn("share", F.round("share", 6))


@query("""
WITH old AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS checked, CASE o_orderkey % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' END AS signal FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey AS project_id, coalesce(checked, false) AS satellite_checked, signal AS built_change_signal FROM orders LEFT JOIN old ON id = o_orderkey
""")
def q_satellite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with the satellite cache by id; what was never looked at is unchecked."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cache = o.where(k % 3 == 0).select(k.alias("id"), (k % 2 == 0).alias("satellite_checked"), F.when(k % 4 == 0, "strong").when(k % 4 == 1, "weak").alias("built_change_signal"))
    return accountability.with_satellite(o.select(k.alias("project_id")), cache)


@query(f"""{_KNN_SQL}, r(poly_id, ring, lon, lat) AS (VALUES {", ".join(f"({i}, {k}, {117 + sum(x for x, _ in r) / len(r) / 10}, {5 + sum(y for _, y in r) / len(r) / 3})" for i, rs in _POLYGONS for k, r in enumerate(rs))}),
x AS (SELECT c.id, poly_id, 12742.0176 * asin(sqrt(least(1.0, pow(sin(radians(r.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - c.lon) / 2), 2)))) AS km FROM c, r)
SELECT id, arg_min(poly_id, km) AS poly_id, round(min(km), 5) AS km FROM x GROUP BY id""")
def q_nearest_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygon whose ring's centre of vertices is nearest."""
    scaled = _polygons(spark).withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((117 + p["x"] / 10).alias("x"), (5 + p["y"] / 3).alias("y")))))
    return spatial.nearest_ring(_customers(spark, sf_dir), scaled).withColumn("km", F.round("km", 5))


@query(f"""{_KNN_SQL}, b AS (SELECT id, (arg_min(site_id, km * 1000000 + site_id / 1e6) % 20) / 20.0 AS score, min(km) / 40 AS km FROM d GROUP BY id),
t AS (SELECT id, CASE WHEN km > 2.5 THEN 'clear' WHEN score >= 0.6 THEN 'intersects' ELSE 'near' END AS modelled, CASE WHEN km <= 0.05 THEN 'intersects' WHEN km <= 1 THEN 'near' ELSE 'clear' END AS recorded FROM b)
SELECT modelled, recorded, CASE WHEN modelled = 'clear' THEN CASE WHEN recorded = 'intersects' THEN 'recorded_not_modelled' ELSE 'neither' END WHEN recorded = 'intersects' THEN 'modelled_and_recorded' ELSE 'modelled_not_recorded' END AS outcome, count(*) AS n FROM t GROUP BY ALL
""")
def q_recurrence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what the nearest sample and the distance say, and both together."""
    near = spatial.nearest(_customers(spark, sf_dir), _sites(spark, sf_dir)).select(((F.col("site_id") % 20) / 20.0).alias("score"), (F.round("km", 6) / 40).alias("km"))
    s = near.select(bands.recurrence_state(F.col("score"), F.col("km")).alias("modelled"), bands.distance_class(F.col("km")).alias("recorded"))
    return s.groupBy("modelled", "recorded", bands.gap_outcome(F.col("modelled"), F.col("recorded")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT l_orderkey, sum(l_quantity) AS len, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS wet, count(*) FILTER (WHERE l_returnflag = 'A') AS near FROM lineitem GROUP BY 1)
SELECT CASE WHEN l_orderkey % 11 = 0 THEN 'unknown' WHEN wet / len >= 0.5 OR wet >= 80 THEN 'flooded' WHEN wet > 0 OR near > 0 THEN 'near' ELSE 'clear' END AS exposure, count(*) AS n FROM s GROUP BY 1
""")
def q_exposure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32: the class of a road by its share and length under water."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("len"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("wet"), F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("near"))
    return s.groupBy(bands.exposure_class(F.col("l_orderkey") % 11 != 0, F.col("len"), F.col("wet"), F.col("near"), 0.5).alias("exposure")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey % 50 AS grp, count(*) FILTER (WHERE 12 - l_quantity BETWEEN -30 AND 0) AS n, round(avg(12 - l_quantity) FILTER (WHERE 12 - l_quantity BETWEEN -30 AND 0), 6) AS mean_db FROM lineitem GROUP BY 1")
def q_valid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values that a sensor can't give are left out."""
    v = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("grp"), bands.valid_range(12 - F.col("l_quantity")).alias("v"))
    return v.groupBy("grp").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean_db"))


@query("""
WITH c AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id AS row, hour(ts) AS col FROM events), a AS (SELECT DISTINCT row, col FROM c)
SELECT day, round(count(*) / (SELECT count(*) FROM a), 6) AS coverage, round((SELECT count(*) FROM a) * 62500 / 1e6, 6) AS area_km2 FROM c GROUP BY day
""")
def q_coverage_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of cells, and the share of it that each day's scenes hold."""
    c = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("row"), F.hour("ts").alias("col"))
    cells = c.select("row", "col").distinct()
    return extent.coverage(c, cells).join(extent.area_km2(cells, 62500.0), F.lit(True)).select("day", F.round("coverage", 6).alias("coverage"), F.round("area_km2", 6).alias("area_km2"))


@query("SELECT n_nationkey AS layer, CASE WHEN n_nationkey % 5 = 0 THEN 'skip' WHEN n_nationkey % 3 = 0 THEN 'pass' ELSE 'fail' END AS result FROM nation")
def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers must say that permanent water is masked; placeholders are skipped."""
    k = F.col("n_nationkey")
    layers = table(spark, sf_dir, "nation").select(k.alias("layer"), F.when(k % 2 == 0, k % 5 == 0).otherwise(F.when(k % 5 == 0, True)).alias("placeholder"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("permanent_water_masked"))
    return gates.provenance(layers)


@query("""
SELECT check_name, 'fail' AS severity, n_bad, n_bad = 0 AS ok FROM (SELECT 'has_rows' AS check_name, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT AS n_bad FROM part UNION ALL
SELECT 'cited', count(*) FILTER (WHERE p_type NOT IN ('ECONOMY', 'PROMO') OR p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR contains(p_name, 'hot')) FROM part)
""")
def q_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding has its source, words and vocabulary; a table without findings fails too."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    row = {"coa_finding": F.col("p_type"), "source_url": F.when(k % 7 == 0, "ftp://x").otherwise("https://x.example"), "source_published": F.lit("2024"), "source_org": F.when(k % 5 == 0, "").otherwise(F.col("p_name"))}
    return gates.cited(p, normalise.finding_reason(row, ["ECONOMY", "PROMO"], ["hot"]))


_LAYERS = """SELECT c_custkey AS layer, CASE c_custkey % 3 WHEN 0 THEN 'flood' WHEN 1 THEN 'rain' ELSE 'roads' END AS kind, CASE c_custkey % 6 WHEN 0 THEN 'no_usable_pass' WHEN 1 THEN 'no_data' WHEN 5 THEN 'what' ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 10 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(c_custkey % 700) END AS as_of, c_custkey % 4 AS n, c_custkey % 8 < 6 AS masked, CASE WHEN c_custkey % 9 > 0 THEN true END AS observed FROM customer"""
_HELD = "SELECT o_custkey AS layer, count(*) AS held, count(*) FILTER (WHERE o_orderstatus = 'F') AS unknown FROM orders WHERE o_totalprice > 300000 GROUP BY 1"
_RULES = [
    ("status_known", "true", "status IN ('ok', 'low_confidence') OR (kind = 'rain' AND status = 'no_data') OR (kind <> 'rain' AND status IN ('no_usable_pass', 'degenerate_threshold'))"),
    ("water_masked", "kind = 'flood'", "masked"), ("observed", "kind = 'flood'", "observed"), ("count_matches", "true", "n = held"),
    ("ok_has_features", "status = 'ok' AND kind <> 'roads'", "held > 0"), ("ok_has_date", "status = 'ok' AND kind <> 'roads'", "as_of IS NOT NULL"),
    ("fresh", "status = 'ok' AND kind <> 'roads' AND as_of IS NOT NULL", "epoch(TIMESTAMP '2024-01-31' - as_of) / 3600 <= 288"),
    ("empty_has_no_features", "status IN ('no_usable_pass', 'no_data') AND kind <> 'roads'", "held = 0"), ("has_segments", "kind = 'roads'", "held > 0"),
    ("segments_unknown", "status IN ('no_usable_pass', 'no_data') AND kind = 'roads' AND held > 0", "unknown > 0"),
]
_RULES_SQL = " UNION ALL ".join(f"SELECT layer, '{n}' AS check_name, '{'warn' if n == 'fresh' else 'fail'}' AS severity, coalesce({g}, false) AS ok FROM j WHERE {a}" for n, a, g in _RULES)


@query(f"WITH l AS ({_LAYERS}), h AS ({_HELD}), j AS (SELECT l.*, coalesce(held, 0) AS held, coalesce(unknown, 0) AS unknown FROM l LEFT JOIN h ON l.layer = h.layer) {_RULES_SQL}")
def q_layer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What published layers say of themselves against what they hold."""
    k = F.col("c_custkey")
    layers = table(spark, sf_dir, "customer").select(
        k.alias("layer"), F.when(k % 3 == 0, "flood").when(k % 3 == 1, "rain").otherwise("roads").alias("kind"), F.when(k % 6 == 0, "no_usable_pass").when(k % 6 == 1, "no_data").when(k % 6 == 5, "what").otherwise("ok").alias("scan_status"),
        F.when(k % 10 != 0, F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (k % 700) * 3600)).alias("as_of"),
        (k % 4).alias("feature_count"), (k % 8 < 6).alias("permanent_water_masked"), F.when(k % 9 > 0, True).alias("observed_not_forecast"),
    )
    features = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("layer"), F.when(F.col("o_orderstatus") == "F", "unknown").otherwise("clear").alias("exposure"))
    return gates.layer_checks(layers, features, F.lit("2024-01-31 00:00:00").cast("timestamp"), F.lit(288))


@query("SELECT event_id, CASE WHEN CAST('0x' || substr(md5(event_id || ':7'), 1, 8) AS UBIGINT) / 4294967296.0 < 0.3 THEN 'holdout' ELSE 'train' END AS grp FROM events")
def q_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row held out with a probability, by a seeded hash."""
    return ranking.bernoulli(table(spark, sf_dir, "events"), "event_id", 0.3, "7").select("event_id", "grp")


@query("SELECT name, min(o_orderkey) AS seq FROM (SELECT o_orderpriority || '/' || o_orderstatus || '/' || o_orderkey % 5 AS name, o_orderkey FROM orders) GROUP BY name ORDER BY seq, name LIMIT 12")
def q_first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve distinct names in their order; the limit is the operator's own."""
    o = table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 5).cast("string")).alias("name"), F.col("o_orderkey").alias("seq"))
    return ranking.first_distinct(o, "name", "seq", 12)


@query("""
SELECT coalesce(reason, '') AS reason, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'amount out of range' WHEN o_orderstatus = 'P' THEN 'status unknown' END AS reason FROM orders) GROUP BY 1
""")
def q_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bad rows are set aside with the first reason, and counted."""
    good, bad = normalise.isolated(table(spark, sf_dir, "orders"), [("amount out of range", F.col("o_totalprice") > 300000), ("status unknown", F.col("o_orderstatus") == "P")])
    both = good.select("o_orderkey", F.lit("").alias("reason")).unionByName(bad.select("o_orderkey", "reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


@query("SELECT c_custkey, replace(replace(replace('<b>' || c_name || '</b> & ' || c_mktsegment, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS shown, CAST(make_timestamp(2024, 1, 1 + CAST(c_custkey % 28 AS BIGINT), CASE WHEN c_custkey % 3 = 1 THEN 0 WHEN c_custkey % 3 = 2 THEN 4 ELSE 12 END, CASE WHEN c_custkey % 3 = 1 THEN 0 ELSE 30 END, 0) AS TIMESTAMP) AS at FROM customer")
def q_shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text escaped for a page, and times with Z, an offset, or as dates."""
    k = F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")), "yyyy-MM-dd")
    text = F.when(k % 3 == 0, F.concat(day, F.lit("T12:30:00Z"))).when(k % 3 == 1, day).otherwise(F.concat(day, F.lit("T12:30:00+08:00")))
    return table(spark, sf_dir, "customer").select("c_custkey", bands.escaped(F.concat(F.lit("<b>"), "c_name", F.lit("</b> & "), "c_mktsegment")).alias("shown"), bands.time_of(text).cast("timestamp_ntz").alias("at"))
