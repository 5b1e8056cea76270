"""Places: polygons, nearest sites, distances, corridors, roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geo import haversine_km
from tidemark.operators import spatial
from tidemark.plans import lookup, roads
from tidemark.queries.base import query, table

#: Polygons of the queries over (price / 1000, quantity): a square with a hole, a triangle, two parts, overlapping ones.
_POLYGONS: list[tuple[int, list[list[tuple[float, float]]]]] = [
    (1, [[(10, 5), (60, 5), (60, 40), (10, 40)], [(20, 12), (40, 12), (40, 30), (20, 30)]]),
    (2, [[(50, 10), (95, 25), (55, 48)]]),
    (3, [[(0, 0), (12, 0), (12, 20), (0, 20)], [(70, 2), (90, 2), (80, 20)]]),
    (4, [[(30, 15), (75, 18), (65, 45), (28, 33), (45, 25)]]),
]


def _polygons(spark: SparkSession) -> DataFrame:
    ring = lambda r: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in r])
    rows = F.array(*[F.struct(F.lit(i).alias("poly_id"), F.array(*map(ring, rs)).alias("rings")) for i, rs in _POLYGONS])
    return spark.range(1).select(F.explode(rows).alias("p")).select("p.*")


def _edge_rows() -> str:
    out = [(i, *a, *b) for i, rs in _POLYGONS for r in rs for a, b in zip(r, r[1:] + r[:1])]
    return ", ".join(f"({i}, {float(a)}, {float(b)}, {float(c)}, {float(d)})" for i, a, b, c, d in out)


_POINTS_SQL = "SELECT o_orderkey AS id, o_totalprice / 5000 AS x, CAST(o_orderkey % 5000 AS DOUBLE) / 100 AS y FROM orders"
_INSIDE_SQL = f"""WITH e(poly_id, x1, y1, x2, y2) AS (VALUES {_edge_rows()}), p AS ({_POINTS_SQL}),
i AS (SELECT id, poly_id FROM p JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY id, poly_id HAVING count(*) % 2 = 1)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 5000).alias("x"), ((F.col("o_orderkey") % 5000).cast("double") / 100).alias("y"))


@query(f"{_INSIDE_SQL} SELECT id, min(poly_id) AS poly_id FROM i GROUP BY id")
def q_pip_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first polygon that holds a point."""
    return spatial.first_inside(_points(spark, sf_dir), spatial.edges(_polygons(spark)), "id", "x", "y", tile=5.0)


@query(f"{_INSIDE_SQL} SELECT id, string_agg(CAST(poly_id AS VARCHAR), ',' ORDER BY poly_id) AS polys FROM i GROUP BY id")
def q_pip_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All polygons that hold a point."""
    hits = spatial.inside(_points(spark, sf_dir), spatial.edges(_polygons(spark)), "id", "x", "y", tile=5.0)
    return hits.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("poly_id")), lambda i: i.cast("string")), ",").alias("polys"))


@query(f"{_INSIDE_SQL} SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT DISTINCT id FROM i)")
def q_pip_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in any polygon, overlapping ones counted once."""
    points = _points(spark, sf_dir)
    hits = spatial.inside(points, spatial.edges(_polygons(spark)), "id", "x", "y", tile=5.0)
    return points.join(hits, "id", "left_semi").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_PLACE = "4.4 + (s_suppkey * 37 % 169) / 10.0 AS lat, 116.7 + (s_suppkey * 53 % 100) / 10.0 AS lon"
_KM = "round(12742.0176 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))), 6)"
_KNN_SQL = f"""WITH c AS (SELECT c_custkey AS id, 5 + (c_custkey * 7919 % 16000) / 1000.0 AS lat, 117 + (c_custkey * 104729 % 9500) / 1000.0 AS lon FROM customer),
s AS (SELECT s_suppkey AS site_id, {_PLACE} FROM supplier), d AS (SELECT id, site_id, {_KM} AS km FROM c, s)"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (5 + (k * 7919 % 16000) / 1000.0).alias("lat"), (117 + (k * 104729 % 9500) / 1000.0).alias("lon"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("site_id"), (4.4 + (k * 37 % 169) / 10.0).alias("lat"), (116.7 + (k * 53 % 100) / 10.0).alias("lon"))


@query(f"{_KNN_SQL} SELECT id, arg_min(site_id, km * 1000000 + site_id / 1e6) AS site_id, min(km) AS km FROM d GROUP BY id")
def q_haversine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest site by growing cells."""
    return spatial.nearest(_customers(spark, sf_dir), _sites(spark, sf_dir), cell=1.0).select("id", "site_id", F.round("km", 6).alias("km"))


@query(f"{_KNN_SQL} SELECT id, site_id, km FROM d WHERE km <= 80")
def q_within_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sites within a distance, by rows of cells."""
    return spatial.within_km(_customers(spark, sf_dir), _sites(spark, sf_dir), 80.0).select("id", "site_id", F.round("km", 6).alias("km"))


@query("""
WITH l AS (SELECT o_orderkey AS id, 120 + (o_orderkey % 97) / 100.0 AS lon1, 14 + (o_orderkey % 89) / 100.0 AS lat1, 120.5 + (o_orderkey % 53) / 100.0 AS lon2, 14.2 + (o_orderkey % 71) / 100.0 AS lat2 FROM orders),
k AS (SELECT *, 12742.0176 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))) AS km FROM l),
n AS (SELECT *, CAST(least(120, greatest(2, ceil(km * 1000 / 350))) AS INTEGER) AS n FROM k), p AS (SELECT id, n, unnest(range(0, n + 1)) AS i, lon1, lat1, lon2, lat2 FROM n)
SELECT id, count(*) AS n_points, round(max(lon1 + (lon2 - lon1) * (i / n)), 6) AS max_lon, round(sum(lat1 + (lat2 - lat1) * (i / n)), 4) AS sum_lat FROM p GROUP BY id
""")
def q_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced points of corridors."""
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select(k.alias("id"), (120 + (k % 97) / 100.0).alias("lon1"), (14 + (k % 89) / 100.0).alias("lat1"), (120.5 + (k % 53) / 100.0).alias("lon2"), (14.2 + (k % 71) / 100.0).alias("lat2"))
    return spatial.corridor_points(lines).groupBy("id").agg(F.count("*").alias("n_points"), F.round(F.max("lon"), 6).alias("max_lon"), F.round(F.sum("lat"), 4).alias("sum_lat"))


@query(f"""{_KNN_SQL}, e AS (SELECT id % 100 AS grp, km, site_id / 25.0 AS score FROM d), b AS (SELECT id, min(km) AS km FROM d GROUP BY id)
SELECT d.id % 100 AS grp, round(max(d.site_id / 25.0), 6) AS score, round(min(d.km), 6) AS km FROM d JOIN b ON d.id = b.id AND d.km = b.km GROUP BY 1""")
def q_corridor_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score and distance along several points."""
    # of equally near sites the one with the best score, that is the largest number, counts
    near = spatial.nearest(_customers(spark, sf_dir), _sites(spark, sf_dir).withColumn("site_id", -F.col("site_id")), cell=1.0)
    best = spatial.best_along(near.select((F.col("id") % 100).alias("id"), F.col("id").alias("i"), (-F.col("site_id") / 25.0).alias("score"), "km"))
    return best.select(F.col("id").alias("grp"), F.round("score", 6).alias("score"), F.round("km", 6).alias("km"))


_SCALED = ", ".join(f"({i}, {117 + a / 10}, {5 + b / 3}, {117 + c / 10}, {5 + d / 3})" for i, rs in _POLYGONS for r in rs for (a, b), (c, d) in zip(r, r[1:] + r[:1]))


@query(f"""{_KNN_SQL}, e(poly_id, x1, y1, x2, y2) AS (VALUES {_SCALED}), b AS (SELECT id, arg_min(site_id, km * 1000000 + site_id / 1e6) / 25.0 AS score, min(km) AS km FROM d GROUP BY id),
i AS (SELECT DISTINCT id FROM (SELECT id, poly_id FROM c JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)),
n AS (SELECT id, min(12742.0176 * asin(sqrt(least(1.0, pow(sin(radians(y1 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y1)) * pow(sin(radians(x1 - lon) / 2), 2))))) AS edge FROM c, e GROUP BY id),
t AS (SELECT b.id, round(score, 6) AS score, km, CASE WHEN km > 2.5 THEN 'clear' WHEN score >= 0.6 THEN 'intersects' ELSE 'near' END AS recurrence,
  CASE WHEN i.id IS NOT NULL OR edge <= 0.05 THEN 'intersects' WHEN edge <= 1 THEN 'near' ELSE 'clear' END AS recorded FROM b JOIN n ON b.id = n.id LEFT JOIN i ON i.id = b.id)
SELECT *, CASE WHEN recurrence <> 'clear' AND recorded <> 'intersects' THEN 'modelled_not_recorded' WHEN recurrence <> 'clear' THEN 'modelled_and_recorded' WHEN recorded = 'intersects' THEN 'recorded_not_modelled' ELSE 'neither' END AS outcome FROM t""")
def q_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers held against the same points."""
    points = _customers(spark, sf_dir).withColumn("i", F.lit(0))
    samples = _sites(spark, sf_dir).withColumn("score", F.col("site_id") / 25.0)
    scaled = _polygons(spark).withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((117 + p["x"] / 10).alias("x"), (5 + p["y"] / 3).alias("y")))))
    return lookup.evidence(points, samples, spatial.edges(scaled)).withColumn("score", F.round("score", 6)).withColumn("km", F.round("km", 6))


@query(f"""{_KNN_SQL}, e(idx, x1, y1, x2, y2) AS (VALUES {_SCALED}), n AS (SELECT id, min(km) AS km, arg_min(site_id, km * 1000000 + site_id / 1e6) AS site FROM d GROUP BY id),
i AS (SELECT id, min(idx) AS idx FROM (SELECT id, idx FROM c JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY id),
g(lon, lat) AS (VALUES {", ".join(f"({117 + sum(x for x, _ in r) / len(r) / 10}, {5 + sum(y for _, y in r) / len(r) / 3})" for _, rs in _POLYGONS for r in rs)}),
f AS (SELECT c.id, min(12742.0176 * asin(sqrt(least(1.0, pow(sin(radians(g.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - c.lon) / 2), 2))))) AS km FROM c, g GROUP BY c.id),
w AS (SELECT id, string_agg(name, '/' ORDER BY site_id) AS names FROM (SELECT id, site_id, row_number() OVER (PARTITION BY id ORDER BY site_id) AS rn, 'road ' || site_id || CASE WHEN site_id % 3 = 0 THEN ' (flooded)' ELSE ' (near)' END AS name FROM d WHERE km <= 1.0 AND site_id % 3 < 2) WHERE rn <= 12 GROUP BY id),
r AS (SELECT c.id, n.km, n.site, i.idx, f.km AS far, w.names FROM c JOIN n ON c.id = n.id JOIN f ON c.id = f.id LEFT JOIN i ON c.id = i.id LEFT JOIN w ON c.id = w.id),
o AS (SELECT id, 'recurrence' AS layer, CASE WHEN km > 2.5 THEN 'clear' WHEN site / 25.0 >= 0.6 THEN 'intersects' ELSE 'near' END AS state, '2017' AS as_of, round(km, 6) AS km, NULL AS number, NULL AS names FROM r
  UNION ALL SELECT id, 'history', CASE WHEN idx IS NULL THEN 'clear' WHEN idx % 2 > 0 THEN 'intersects' ELSE 'near' END, NULL, NULL, CAST(idx % 2 AS BIGINT), NULL FROM r
  UNION ALL SELECT id, 'latest', CASE WHEN idx IS NOT NULL THEN 'intersects' WHEN far <= 0.05 THEN 'intersects' WHEN far <= 1 THEN 'near' ELSE 'clear' END, '2024-07-25', CASE WHEN idx IS NOT NULL THEN 0 ELSE round(far, 6) END, NULL, NULL FROM r
  UNION ALL SELECT id, 'rain', CASE WHEN km > 8 THEN 'clear' WHEN site % 2 = 0 THEN 'near' ELSE 'intersects' END, '2024-07-26', round(km, 6), NULL, CASE WHEN km <= 8 THEN CASE WHEN site % 2 = 0 THEN 'none' ELSE 'red' END END FROM r
  UNION ALL SELECT id, 'roads', CASE WHEN names IS NULL THEN 'clear' ELSE 'intersects' END, '2024-07-25', NULL, NULL, names FROM r)
SELECT 'usable' AS kind, * FROM o UNION ALL SELECT 'unusable', id, layer, CASE WHEN layer IN ('recurrence', 'history') THEN state ELSE 'withheld' END, as_of, CASE WHEN layer = 'recurrence' THEN km END, number, NULL FROM o
UNION ALL SELECT 'missing', id, layer, 'unavailable', NULL, NULL, NULL, NULL FROM o
""")
def q_evidence_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five layers for every place, each with its state and date; and as they are where layers are unusable or missing."""
    points, s = _customers(spark, sf_dir).withColumn("i", F.lit(0)), _sites(spark, sf_dir)
    scaled = _polygons(spark).withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((117 + p["x"] / 10).alias("x"), (5 + p["y"] / 3).alias("y")))))
    k = F.col("site_id")
    recurrence = s.withColumn("score", k / 25.0)
    history = scaled.select(F.col("poly_id").alias("idx"), (F.col("poly_id") % 2).alias("events"), "rings")
    rain = s.withColumn("flag", F.when(k % 2 == 0, "none").otherwise("red"))
    roads_ = s.select(k.alias("seq"), F.concat(F.lit("road "), k).alias("name"), F.when(k % 3 == 0, "flooded").when(k % 3 == 1, "near").otherwise("clear").alias("exposure"), F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("coords"))
    layer = lookup.Layer

    def kind(name: str, status: str, there: bool) -> DataFrame:
        of = lambda rows, as_of: layer(rows if there else None, status, as_of if there else None)
        found = lookup.bundle(points, of(recurrence, "2017"), of(history, None), of(scaled, "2024-07-25"), of(rain, "2024-07-26"), of(roads_, "2024-07-25"))
        return found.select(F.lit(name).alias("kind"), "id", "layer", "state", "as_of", F.round("km", 6).alias("km"), "number", F.array_join("names", "/").alias("names"))

    return kind("usable", "ok", True).unionByName(kind("unusable", "no_usable_pass", True)).unionByName(kind("missing", "ok", False))


@query()
def q_road_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of roads in the water; tested on a small fixture."""
    k = F.col("o_orderkey")
    ends = F.array(*[F.struct((121 + (k % a) / 1000).alias("x"), (14.5 + (k % b) / 1000).alias("y")) for a, b in ((97, 89), (71, 53), (41, 61))])
    lines = table(spark, sf_dir, "orders").select(k.alias("osm_id"), F.lit("trunk").alias("highway"), F.lit("").alias("ref"), F.when(k % 2 == 0, "SLEX").otherwise("Coastal Road").alias("name"), ends.alias("coords"))
    water = _polygons(spark).withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((284000 + p["x"] * 100).alias("x"), (1604000 + p["y"] * 200).alias("y")))))
    return roads.exposure(lines, spatial.edges(water), True)


@query("SELECT c_custkey AS id, round(12742.0176 * asin(sqrt(least(1.0, pow(sin(radians(14.6 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(14.6)) * pow(sin(radians(121.0 - lon) / 2), 2)))), 6) AS km FROM (SELECT c_custkey, 5 + (c_custkey * 7919 % 16000) / 1000.0 AS lat, 117 + (c_custkey * 104729 % 9500) / 1000.0 AS lon FROM customer)")
def q_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from each place to one other."""
    return _customers(spark, sf_dir).select("id", F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(14.6), F.lit(121.0)), 6).alias("km"))
