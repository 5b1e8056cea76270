"""Roll-ups, joins, ranks and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bands, scoring
from tidemark.operators import gates, joins, ranking, rollups
from tidemark.queries.base import query, table

_BANDS: list[tuple[str, float, float | None]] = [("<50k", 0.0, 5e4), ("50-100k", 5e4, 1e5), ("100-250k", 1e5, 2.5e5), ("250-400k", 2.5e5, 4e5), (">1M", 1e6, None)]
_BAND_ROWS = ", ".join(f"({i}, '{label}', {low}, {high if high is not None else 'NULL'})" for i, (label, low, high) in enumerate(_BANDS))


@query(f"""
WITH b(ordinal, tranche, low, high) AS (VALUES {_BAND_ROWS}),
s AS (SELECT tranche, count(*) AS n, sum(o_totalprice) AS alloc, count(*) FILTER (WHERE o_orderstatus = 'F') AS flagged FROM orders JOIN b ON o_totalprice > 0 AND o_totalprice >= low AND (high IS NULL OR o_totalprice < high) GROUP BY tranche)
SELECT ordinal, b.tranche, coalesce(n, 0) AS n_projects, round(coalesce(alloc, 0), 2)::DOUBLE AS allocation, coalesce(flagged, 0) AS n_flagged, CASE WHEN n > 0 THEN round(flagged / n, 4) ELSE 0.0 END::DOUBLE AS flagged_share
FROM b LEFT JOIN s ON b.tranche = s.tranche
""")
def q_tranche_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every band in order, zero where empty."""
    o = table(spark, sf_dir, "orders").select(bands.band(F.col("o_totalprice"), _BANDS).alias("tranche"), "o_totalprice", "o_orderstatus")
    out = rollups.by_dimension(o, "tranche", [b[0] for b in _BANDS], [F.count("*").alias("n_projects"), F.sum("o_totalprice").alias("allocation"), rollups.count_where(F.col("o_orderstatus") == "F").alias("n_flagged")], ["n_projects", "allocation", "n_flagged"])
    return out.select("ordinal", "tranche", "n_projects", F.round("allocation", 2).alias("allocation"), "n_flagged", scoring.share(F.col("n_flagged"), F.col("n_projects")).alias("flagged_share"))


@query("""
WITH f AS (
  SELECT n_name, l_extendedprice * (1 - l_discount) AS a, l_returnflag, l_shipdate, o_orderdate, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), g AS (
  SELECT n_name AS province, count(*) AS n_projects, sum(a) AS alloc, count(*) FILTER (WHERE l_returnflag = 'R') AS n_flagged, count(*) FILTER (WHERE o_orderstatus = 'F' AND l_shipdate > o_orderdate) AS n_after,
         sum(CASE WHEN l_returnflag = 'A' THEN a ELSE 0 END) AS low_alloc, count(DISTINCT date_trunc('month', l_shipdate)) AS n_passes FROM f GROUP BY n_name)
SELECT province, n_projects, round(alloc, 2) AS allocation, n_flagged, n_after, round(low_alloc, 2) AS low_allocation, n_passes, (alloc > 0 AND n_passes > 0) AS warrants FROM g
""")
def q_province_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of conditional counts and sums for each province, with the review flag."""
    t = lambda n: table(spark, sf_dir, n)
    f = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    g = f.groupBy(F.col("n_name").alias("province")).agg(
        F.count("*").alias("n_projects"), F.sum(a).alias("alloc"), rollups.count_where(F.col("l_returnflag") == "R").alias("n_flagged"),
        rollups.count_where((F.col("o_orderstatus") == "F") & (F.col("l_shipdate") > F.col("o_orderdate"))).alias("n_after"), rollups.sum_where(F.col("l_returnflag") == "A", a).alias("low"),
        F.countDistinct(F.trunc(F.col("l_shipdate"), "month")).alias("n_passes"),
    )
    return g.select("province", "n_projects", F.round("alloc", 2).alias("allocation"), "n_flagged", "n_after", F.round("low", 2).alias("low_allocation"), "n_passes", bands.warrants_review(F.col("alloc"), F.lit(0.0), F.col("n_passes")).alias("warrants"))


@query("SELECT p_type AS type, count(*) AS n, round(sum(l_quantity), 2)::DOUBLE AS quantity, round(avg(l_discount), 6) AS mean_discount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def q_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: by type; the join is left to Spark, which broadcasts only below its size limit."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))


@query("""
WITH s AS (SELECT c_nationkey AS k, avg(c_acctbal) / 6000 AS score FROM customer GROUP BY 1), e AS (SELECT s_nationkey AS k, count(*) AS ev FROM supplier GROUP BY 1),
g AS (SELECT n_name, round(coalesce(score, 0), 3) AS s, coalesce(ev, 0) AS e FROM nation LEFT JOIN s ON n_nationkey = s.k LEFT JOIN e ON n_nationkey = e.k)
SELECT CASE WHEN s >= 0.6 AND e <= 1 THEN 'under_observed_prone' WHEN e >= 3 THEN 'charted' WHEN s >= 0.6 AND e = 2 THEN 'monitored' ELSE 'low' END AS gap, count(*) AS n FROM g GROUP BY 1
""")
def q_gap_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score and events of each unit, classified and counted."""
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.avg("c_acctbal") / 6000).alias("score"))
    e = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("events"))
    g = table(spark, sf_dir, "nation").join(s, "n_nationkey", "left").join(e, "n_nationkey", "left")
    return rollups.histogram_of(g.select(bands.gap_class(F.round(F.coalesce("score", F.lit(0.0)), 3), F.col("events")).alias("gap")), "gap")


@query("""
SELECT o_orderkey, count(DISTINCT l_shipdate) AS n_passes, CAST(min(l_shipdate) AS DATE) AS first_pass FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'F' AND CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) + 30 GROUP BY o_orderkey
""")
def q_completed_then(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes after completion, for completed works."""
    passes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_shipdate").cast("date")).alias("passes"))
    later = joins.later_passes(F.col("passes"), F.date_add(F.col("o_orderdate").cast("date"), 30))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(passes, "o_orderkey").select("o_orderkey", later.alias("p")).where(F.size("p") > 0)
    return o.select("o_orderkey", F.size("p").cast("long").alias("n_passes"), F.element_at("p", 1).alias("first_pass"))


@query("""
SELECT n_name, count(o_orderkey) AS n_findings, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS findings
FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY n_name
""")
def q_findings_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted sets of findings, empty where there is none."""
    t = lambda n: table(spark, sf_dir, n)
    big = t("orders").where("o_totalprice > 400000")
    j = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(big, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("n_name").agg(F.count("o_orderkey").alias("n_findings"), F.array_join(rollups.sorted_set("o_orderpriority"), ",").alias("findings"))


@query("""
SELECT event_type, count(*) FILTER (WHERE value >= 60) AS red, count(*) FILTER (WHERE value >= 30 AND value < 60) AS orange, count(*) FILTER (WHERE value >= 10 AND value < 30) AS yellow, count(*) FILTER (WHERE value < 10) AS none,
       round(sum(CASE WHEN value >= 60 THEN value ELSE 0 END), 3)::DOUBLE AS red_km FROM events GROUP BY event_type
""")
def q_pivot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of classes as columns."""
    e = table(spark, sf_dir, "events").withColumn("cls", bands.rain_band(F.col("value"), (10.0, 30.0, 60.0)))
    return rollups.pivot_counts(e, "event_type", "cls", ["red", "orange", "yellow", "none"], [F.round(rollups.sum_where(F.col("value") >= 60, F.col("value")), 3).alias("red_km")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT * FROM lineitem WHERE l_quantity >= 10 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 26)")
def q_topn_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: the largest after a floor; the limit is the operator's own cap."""
    out = ranking.top_n(table(spark, sf_dir, "lineitem"), F.col("l_quantity") >= 10, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 26)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def q_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each key."""
    return ranking.last_wins(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) ORDER BY o_orderkey LIMIT 200")
def q_anti_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't done yet, then the limit of a run."""
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.not_done(table(spark, sf_dir, "orders"), done, "o_orderkey", [F.col("o_orderkey")], 200).select("o_orderkey", "o_totalprice")


@query("""
WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS signal, 1 AS seq FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'X', 2 FROM orders WHERE o_orderkey % 2 = 0)
SELECT id, signal FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM c) WHERE rn = 1
""")
def q_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed cache merged with new results, the newer ones win."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("signal"), F.lit(1).alias("seq"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("X").alias("signal"), F.lit(2).alias("seq"))
    return ranking.last_wins(old.unionByName(new), "id", [F.col("seq")]).select("id", "signal")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':7'), event_id) AS rn FROM events) WHERE rn <= 40")
def q_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same number of rows of each class, by a seeded hash; the number is the sampling operator's own."""
    return ranking.sample_of_each(table(spark, sf_dir, "events"), "event_type", "event_id", 40, "7").select("event_type", "event_id")


@query("""
WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id || ':42'), user_id) AS rn, count(*) OVER () AS n FROM u)
SELECT user_id, CASE WHEN rn <= round(n * 0.3) THEN 'holdout' ELSE 'train' END AS grp FROM r
""")
def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ids held out in hash order, disjoint by construction."""
    return ranking.split_ids(table(spark, sf_dir, "events"), "user_id", 0.3, "42")


@query("""
WITH g AS (SELECT n_name AS province, sum(o_totalprice) AS alloc, count(*) FILTER (WHERE o_orderstatus = 'P') AS passes FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT province, round(alloc, 2) AS allocation, passes FROM g ORDER BY passes > 0 DESC, alloc DESC, province LIMIT 1
""")
def q_lead_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row to lead with."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.groupBy(F.col("n_name").alias("province")).agg(F.sum("o_totalprice").alias("alloc"), rollups.count_where(F.col("o_orderstatus") == "P").alias("passes")).withColumn("w", bands.warrants_review(F.col("alloc"), F.lit(1.0), F.col("passes")))
    return ranking.lead(g, "alloc", "passes", "w", "province").select("province", F.round("alloc", 2).alias("allocation"), "passes")


@query("SELECT event_type, max(ts) AS seen_at FROM events WHERE event_type <> 'view' GROUP BY event_type ORDER BY seen_at DESC, event_type LIMIT 1")
def q_freshest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer with the latest record."""
    layers = table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy(F.col("event_type").alias("seq")).agg(F.max("ts").alias("at"))
    return ranking.freshest(layers).select(F.col("seq").alias("event_type"), F.col("at").alias("seen_at"))


@query("""
WITH l AS (SELECT event_type, user_id, max(ts) AS seen FROM events GROUP BY ALL), d AS (SELECT *, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(seen)) AS BIGINT) AS s FROM l)
SELECT event_type, user_id, CASE WHEN s < 3600 THEN 'updated ' || (s // 60) || ' min ago' WHEN s < 86400 THEN 'updated ' || (s // 3600) || ' h ' || (s // 60 - s // 3600 * 60) || ' min ago'
  WHEN s < 604800 THEN 'updated ' || (s // 86400) || ' days ago (last Sentinel-1 pass)' ELSE 'last pass ' || (s // 86400) || ' days ago' END AS age, s > 172800 AS stale, strftime(seen + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') || ' PHT' AS shown FROM d
""")
def q_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age in words, staleness against a cadence, local time."""
    l = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max("ts").cast("timestamp").alias("at"))  # noqa: E741
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return l.select("event_type", "user_id", bands.age_text(F.col("at"), now).alias("age"), bands.is_stale(F.col("at"), now, F.lit(bands.STALE_SECONDS["viirs"])).alias("stale"), bands.local_time(F.col("at")).alias("shown"))


@query("SELECT n_name, sha256('[' || string_agg(CAST(c_custkey AS VARCHAR), ', ' ORDER BY c_custkey) || ']') AS hash FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def q_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha256 of canonical sorted id lists."""
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.collect_list("c_custkey").alias("ids")).select("n_name", scoring.ids_hash(F.col("ids")).alias("hash"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share, max(o_totalprice) AS peak FROM orders GROUP BY o_orderpriority")
def q_rounding_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the total; groups are summed before the total, so the orders are read once."""
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.max("o_totalprice").alias("peak"))
    from pyspark.sql import Window

    whole = F.sum("s").over(Window.partitionBy(F.lit(1)))
    return g.select("o_orderpriority", "n", F.round(F.col("s") / whole, 6).alias("share"), "peak")


@query("""
SELECT 'amount_positive' AS check_name, 'fail' AS severity, count(*) FILTER (WHERE o_totalprice <= 0) AS n_bad, count(*) FILTER (WHERE o_totalprice <= 0) = 0 AS ok FROM orders
UNION ALL SELECT 'status_known', 'fail', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) = 0 FROM orders
UNION ALL SELECT 'fresh', 'warn', count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-06-01'), count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-06-01') = 0 FROM orders
""")
def q_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one pass."""
    rules = [("amount_positive", "fail", F.col("o_totalprice") <= 0), ("status_known", "fail", ~F.col("o_orderstatus").isin("F", "O")), ("fresh", "warn", F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz"))]
    return gates.check(table(spark, sf_dir, "orders"), rules)


@query("SELECT n_name, count(*) AS n_suppliers, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def q_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of records joined with a list of names, whatever their case and blanks."""
    t = lambda n: table(spark, sf_dir, n)
    k, name = F.col("s_suppkey"), F.col("n_name")
    written = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.when(k % 3 == 0, F.upper(name)).when(k % 3 == 1, F.concat(F.lit("  "), F.lower(name))).otherwise(F.concat(F.initcap(name), F.lit(" "))).alias("written"))
    listed = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", F.lower(F.trim("n_name")).alias("key"))
    return written.select(F.lower(F.trim("written")).alias("key")).join(listed, "key").groupBy("n_name", "r_name").agg(F.count("*").alias("n_suppliers"))
