"""Public works against modelled and observed floods: one fact, cached by the caller, and its roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bands, normalise, scoring
from tidemark.operators import joins, ranking, rollups, spatial


def projects(raw: DataFrame) -> DataFrame:
    """Records of the subset with standard fields. Filters on category and title come before the other fields are read."""
    located = raw
    if "location" in {c.lower() for c in raw.columns}:
        name = next(c for c in raw.columns if c.lower() == "location")
        located = raw.withColumns({p: normalise.location_part(raw, name, p) for p in ("region", "province") if p not in {c.lower() for c in raw.columns}})
    r = normalise.select_resolved(located)
    if "project_id" not in normalise.resolve_columns(located.columns):
        r = r.drop("project_id")  # the row's number stands for it
    category = normalise.blank_to(F.col("category"), F.col("project_type"))
    lat, lon = normalise.float_of(F.col("latitude")), normalise.float_of(F.col("longitude"))
    there = normalise.in_bbox(lat, lon)
    day = lambda c: normalise.iso_date_of(F.col(c)).try_cast("date")
    return r.where(normalise.is_flood_control(category, F.col("title"))).select(
        normalise.record_id(r, "project_id").alias("project_id"), "title", normalise.amount_of(F.col("contract_amount")).alias("contract_amount"), normalise.status_of(F.col("status")).alias("status"),
        normalise.flood_type(F.col("title"), category).alias("project_type"), F.when(there, lat).alias("latitude"), F.when(there, lon).alias("longitude"), normalise.confidence_of(lat, lon).alias("confidence"),
        "region", "province", day("completion_date").alias("completion_date"), day("start_date").alias("start_date"), normalise.year_of(F.col("infra_year")).alias("infra_year"),
    ).where("project_id is not null")


def located(fact: DataFrame, province_edges: DataFrame, provinces: DataFrame) -> DataFrame:
    """``fact`` with idx, score and name of its province: by coordinates, else by the province's text (then confidence 0.6).

    province_edges: idx, x1, y1, x2, y2; provinces: idx, name, recurrence_score.
    """
    seq = fact.withColumn("_rec", F.struct("project_id", F.xxhash64(*fact.columns)))
    by_place = spatial.first_inside(seq.select("_rec", "longitude", "latitude"), province_edges, "_rec", "longitude", "latitude", "idx")
    texts = seq.select(F.col("_rec").alias("left_id"), normalise.province_text(F.col("province")).alias("text"))
    by_text = joins.text_join(texts, provinces.select(F.col("idx").alias("right_id"), F.lower("name").alias("text"))).select(F.col("left_id").alias("_rec"), F.col("right_id").alias("text_idx"))
    j = seq.join(by_place, "_rec", "left").join(by_text.dropDuplicates(["_rec"]), "_rec", "left")
    idx = F.coalesce("idx", "text_idx")
    j = j.withColumn("confidence", F.when(F.col("idx").isNull(), 0.6).otherwise(F.col("confidence"))).withColumn("idx", idx).drop("text_idx", "_rec")
    known = provinces.select("idx", F.col("name").alias("province_name"), F.coalesce("recurrence_score", F.lit(0.0)).alias("recurrence_score"))
    return j.join(known, "idx", "left")


def with_passes(fact: DataFrame, passes: DataFrame) -> DataFrame:
    """``fact`` with passes (dates on which the place was seen flooded) and later_passes. passes: edges with day as key."""
    seen = spatial.inside(fact.select("project_id", "longitude", "latitude").dropDuplicates(["project_id"]), passes, "project_id", "longitude", "latitude", "day")
    dates = seen.groupBy("project_id").agg(F.array_sort(F.collect_set("day")).alias("passes"))
    j = fact.join(dates, "project_id", "left").withColumn("passes", F.coalesce("passes", F.array().cast("array<date>")))
    return j.withColumn("later_passes", joins.later_passes(F.col("passes"), F.col("completion_date")))


def with_findings(fact: DataFrame, findings: DataFrame, least: float = 0.6) -> DataFrame:
    """``fact`` with finding: the first (smallest seq) of its province whose description is alike. findings: seq, province, description, finding."""
    tokens = lambda c: F.split(normalise.description_key(c), "_")
    left = fact.select(F.col("project_id").alias("left_id"), F.lower("province_name").alias("p"), tokens(F.col("title")).alias("tokens")).dropDuplicates(["left_id"])
    right = findings.select(F.col("seq").alias("right_id"), F.lower("province").alias("p"), tokens(F.col("description")).alias("tokens"))
    first = joins.jaccard_join(left, right, ["p"], least).groupBy("left_id").agg(F.min("right_id").alias("seq")).join(findings.select("seq", "finding"), "seq").select(F.col("left_id").alias("project_id"), "finding")
    return fact.join(first, "project_id", "left")


def with_satellite(fact: DataFrame, cache: DataFrame) -> DataFrame:
    """``fact`` with satellite_checked and built_change_signal of the cache (id, satellite_checked, built_change_signal); an empty cache leaves all unchecked."""
    seen = cache.select(F.col("id").alias("project_id"), F.col("satellite_checked").alias("_checked"), "built_change_signal")
    return fact.join(seen, "project_id", "left").withColumn("satellite_checked", F.coalesce("_checked", F.lit(False))).drop("_checked").select(*fact.columns, "satellite_checked", "built_change_signal")


def totals(fact: DataFrame) -> DataFrame:
    """One row: projects, their allocation, and those that no province was found for."""
    return fact.agg(F.count("*").alias("n_projects"), F.coalesce(F.sum("contract_amount"), F.lit(0.0)).alias("allocation"), rollups.count_where(F.col("idx").isNull()).alias("n_unresolved"))


def by_province(fact: DataFrame) -> DataFrame:
    """Unresolved records are in no province, but in the other roll-ups."""
    amount = F.coalesce("contract_amount", F.lit(0.0))
    later = (F.col("status") == "completed") & (F.size("later_passes") > 0)
    dates = fact.where("idx is not null").select("province_name", F.explode("passes").alias("d")).groupBy("province_name").agg(F.countDistinct("d").alias("observed_passes"))
    g = fact.where("idx is not null").groupBy("province_name").agg(
        F.count("*").alias("n_projects"), F.sum(amount).alias("allocation"), rollups.count_where(F.col("finding").isNotNull()).alias("n_flagged"), rollups.count_where(later).alias("n_completed_then_flooded"),
        rollups.sum_where(later, amount).alias("completed_then_flooded_allocation"), rollups.sum_where(F.col("confidence") < 1, amount).alias("low_confidence_allocation"), F.max("recurrence_score").alias("recurrence_score"),
    )
    g = g.join(dates, "province_name", "left").withColumn("observed_passes", F.coalesce("observed_passes", F.lit(0)))
    return g.withColumn("flagged_share", scoring.share(F.col("n_flagged"), F.col("n_projects"))).withColumn("warrants", bands.warrants_review(F.col("allocation"), F.col("recurrence_score"), F.col("observed_passes")))


def by_type(fact: DataFrame) -> DataFrame:
    return fact.groupBy("project_type").agg(F.count("*").alias("n_projects"), F.sum(F.coalesce("contract_amount", F.lit(0.0))).alias("allocation"))


def by_tranche(fact: DataFrame) -> DataFrame:
    t = fact.withColumn("tranche", bands.band(F.col("contract_amount")))
    return rollups.by_dimension(t, "tranche", [b[0] for b in bands.TRANCHES], [F.count("*").alias("n_projects"), F.sum("contract_amount").alias("allocation")], ["n_projects", "allocation"])


def by_id(fact: DataFrame, order: list[str]) -> DataFrame:
    """The last record of each id; aggregates count all."""
    return ranking.last_wins(fact, "project_id", [F.col(c) for c in order])
