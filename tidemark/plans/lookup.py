"""Evidence for places: several layers held against the same points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import bands
from tidemark.operators import spatial

#: Kilometres within which samples and roads count, and how many road names are given.
SAMPLE_KM, RAIN_KM, ROAD_KM, NAMES = 2.5, 8.0, 1.0, 12


def evidence(points: DataFrame, samples: DataFrame, record_edges: DataFrame) -> DataFrame:
    """id, score, km, recurrence, recorded, outcome for points (id, i, lon, lat), one or several for each id.

    samples: site_id, lat, lon, score; record_edges: edges of recorded extents. The record intersects if any point is inside; a polygon's
    distance is that of its edges' vertices.
    """
    keyed = points.select(F.struct("id", "i").alias("id"), "lat", "lon")
    near = spatial.nearest(keyed, samples).join(samples.select("site_id", "score"), "site_id").select(F.col("id.id").alias("id"), F.col("id.i").alias("i"), "score", "km")
    best = spatial.best_along(near)
    hit = spatial.inside(points.select(F.struct("id", "i").alias("p"), "lon", "lat"), record_edges, "p", "lon", "lat").select(F.col("p.id").alias("id")).distinct().withColumn("hit", F.lit(True))
    corners = record_edges.select(F.xxhash64("poly_id", "x1", "y1").alias("site_id"), F.col("y1").alias("lat"), F.col("x1").alias("lon")).distinct()
    close = spatial.within_km(points.select("id", "lat", "lon"), corners, 1.0).groupBy("id").agg(F.min("km").alias("edge_km"))
    state = F.when(F.coalesce("hit", F.lit(False)), "intersects").otherwise(bands.distance_class(F.coalesce("edge_km", F.lit(float("inf")))))
    j = points.select("id").distinct().join(best, "id", "left").join(hit, "id", "left").join(close, "id", "left")
    j = j.select("id", "score", "km", bands.recurrence_state(F.col("score"), F.col("km")).alias("recurrence"), state.alias("recorded"))
    return j.withColumn("outcome", bands.gap_outcome(F.col("recurrence"), F.col("recorded")))


@dataclass
class Layer:
    """A published layer: its rows (None: there is no such layer), what it says of itself, and its date."""

    rows: DataFrame | None
    status: str | None = "ok"
    as_of: str | None = None


def bundle(points: DataFrame, recurrence: Layer, history: Layer, latest: Layer, rain: Layer, roads: Layer, compatible: bool = False) -> DataFrame:
    """id, layer, state, as_of, score, km, number, names for points (id, i, lon, lat): five rows for each id, one or several points for each.

    state: unavailable where there is no layer; withheld where its status isn't ok (recurrence and history have none); else intersects, near
    or clear. recurrence: site_id, lat, lon, score (``compatible``: folded in the points' order). history: idx, events, rings; the first
    unit (smallest idx) that holds any point. latest: poly_id, rings; inside, or by the nearest ring's mean of vertices from the first
    point. rain: site_id, lat, lon, flag; the nearest sample of all points. roads: seq, name, exposure, coords; names of flooded and
    near ones that have a vertex around any point. Each layer is joined by cells, and only the wanted columns are read.
    """
    ids = points.select("id").distinct()
    keyed = points.select(F.struct("id", "i").alias("id"), "lat", "lon")
    none = {"score": F.lit(None).cast("double"), "km": F.lit(None).cast("double"), "number": F.lit(None).cast("long"), "names": F.lit(None).cast("array<string>")}

    def shown(name: str, layer: Layer, rows: DataFrame, state: Column, **values: Column) -> DataFrame:
        kept = {k: values.get(k, v) for k, v in none.items()}
        return rows.select("id", F.lit(name).alias("layer"), state.alias("state"), F.lit(layer.as_of).cast("string").alias("as_of"), *[v.alias(k) for k, v in kept.items()])

    def usable(name: str, layer: Layer, build, has_status: bool = True) -> DataFrame:
        if layer.rows is None:
            return shown(name, layer, ids, F.lit("unavailable"))
        if has_status and layer.status != "ok":
            return shown(name, layer, ids, F.lit("withheld"))
        return build()

    def by_score() -> DataFrame:
        near = spatial.nearest(keyed, recurrence.rows).join(recurrence.rows.select("site_id", "score"), "site_id")
        best = spatial.best_along(near.select(F.col("id.id").alias("id"), F.col("id.i").alias("i"), F.coalesce("score", F.lit(-1.0)).alias("score"), "km"), compatible)
        found = F.coalesce((F.col("score") >= 0) & (F.col("km") <= SAMPLE_KM), F.lit(False))
        return shown("recurrence", recurrence, ids.join(best, "id", "left"), F.when(~found, "clear").when(F.col("score") >= 0.6, "intersects").otherwise("near"), score=F.when(found, F.col("score")), km=F.col("km"))

    def holds(layer: Layer, key: str) -> DataFrame:
        hits = spatial.inside(keyed.select("id", "lon", "lat"), spatial.edges(layer.rows, key), "id", "lon", "lat", key)
        return hits.groupBy(F.col("id.id").alias("id")).agg(F.min(key).alias(key))

    def by_unit() -> DataFrame:
        first = holds(history, "idx").join(history.rows.select("idx", F.coalesce("events", F.lit(0)).cast("long").alias("events")), "idx")
        return shown("history", history, ids.join(first, "id", "left"), F.when(F.col("idx").isNull(), "clear").when(F.col("events") > 0, "intersects").otherwise("near"), number=F.col("events"))

    def by_pass() -> DataFrame:
        order = Window.partitionBy("id").orderBy("i")
        first = points.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("id", "lat", "lon")
        far = spatial.nearest_ring(first, latest.rows).select("id", "km")
        j = ids.join(holds(latest, "poly_id"), "id", "left").join(far, "id", "left")
        within = F.col("poly_id").isNotNull()
        return shown("latest", latest, j, F.when(within, "intersects").otherwise(bands.distance_class(F.coalesce("km", F.lit(float("inf"))))), km=F.when(within, 0.0).otherwise(F.col("km")))

    def by_rain() -> DataFrame:
        near = spatial.nearest(keyed, rain.rows).select(F.col("id.id").alias("id"), F.struct("km", F.col("id.i"), "site_id").alias("b")).groupBy("id").agg(F.min("b").alias("b"))
        j = ids.join(near.select("id", "b.km", "b.site_id").join(rain.rows.select("site_id", "flag"), "site_id"), "id", "left")
        close = F.coalesce(F.col("km") <= RAIN_KM, F.lit(False))
        return shown("rain", rain, j, F.when(~close, "clear").when(F.coalesce("flag", F.lit("none")) == "none", "near").otherwise("intersects"), km=F.col("km"), names=F.when(close, F.array("flag")))

    def by_road() -> DataFrame:
        flagged = roads.rows.where(F.col("exposure").isin("flooded", "near")).select(F.struct("seq", F.concat(F.coalesce("name", F.lit("unnamed road")), F.lit(" ("), "exposure", F.lit(")")).alias("name")).alias("road"), F.posexplode("coords").alias("v", "p"))
        vertices = flagged.select(F.struct("road", "v").alias("site_id"), F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))
        near = spatial.within_km(keyed, vertices, ROAD_KM).groupBy(F.col("id.id").alias("id"), F.col("site_id.road.name").alias("name")).agg(F.min("site_id.road.seq").alias("seq"))
        first = near.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("seq", "name"))).where(F.col("_rn") <= NAMES)
        names = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "name"))), lambda x: x["name"]).alias("names"))
        return shown("roads", roads, ids.join(names, "id", "left"), F.when(F.col("names").isNull(), "clear").otherwise("intersects"), names=F.col("names"))

    parts = [usable("recurrence", recurrence, by_score, False), usable("history", history, by_unit, False), usable("latest", latest, by_pass), usable("rain", rain, by_rain), usable("roads", roads, by_road)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
