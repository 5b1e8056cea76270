"""Quality gates: rules become rows (check_name, severity, n_bad, ok)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate of severity 'fail' isn't met."""


def check(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One row for each rule (name, severity, condition that a bad row meets); all rules in one pass over ``df``."""
    bad = df.agg(*[F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)).cast("long").alias(f"r{i}") for i, (_, _, c) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("severity"), F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("n_bad")) for i, (n, s, _) in enumerate(rules)])
    return bad.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.n_bad") == 0).alias("ok"))


def enforce(checks: DataFrame) -> DataFrame:
    """The checks themselves, or an error that names the failed ones."""
    failed = [f"{r['check_name']} ({r['n_bad']})" for r in checks.where("severity = 'fail' and not ok").collect()]
    if failed:
        raise GateError("; ".join(sorted(failed)))
    return checks


def governed(records: DataFrame, disclaimer: str) -> DataFrame:
    """Records whose disclaimer isn't, byte for byte, the given one; empty if all are governed."""
    return records.where(~F.col("disclaimer").eqNullSafe(F.lit(disclaimer)))


def disjoint(train: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """Keys that are in both."""
    return train.select(key).intersect(holdout.select(key))


def forbidden_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Paths of fields with a forbidden name anywhere in the schema."""
    banned, found = {n.lower() for n in names}, []

    def walk(kind, path: str) -> None:
        if hasattr(kind, "fields"):
            for f in kind.fields:
                if f.name.lower() in banned:
                    found.append(f"{path}{f.name}")
                walk(f.dataType, f"{path}{f.name}.")
        elif hasattr(kind, "elementType"):
            walk(kind.elementType, path)
        elif hasattr(kind, "valueType"):
            walk(kind.valueType, path)

    walk(df.schema, "")
    return found


def status_of_layer(layer: str, threshold: Column, area_km2: Column, coverage: Column, rails: tuple[float, float] = (-24.0, -14.0), most_km2: float = 4000.0, least_coverage: float = 0.55) -> list[Column]:
    """layer, scan_status: why a layer may not be shown, or ok."""
    status = (
        F.when(F.coalesce(coverage, F.lit(0.0)) < least_coverage, "no_usable_pass")
        .when((threshold <= rails[0] + 1e-6) | (threshold >= rails[1] - 1e-6), "degenerate_threshold")
        .when(area_km2 > most_km2, "low_confidence")
        .otherwise("ok")
    )
    return [F.lit(layer).alias("layer"), status.alias("scan_status")]


def publishable(features: DataFrame, status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features whose status is ok; a layer that isn't publishes none."""
    return features.join(status.where("scan_status = 'ok'").select(*keys), list(keys), "left_semi")


def named_arrays(df: DataFrame, names: Sequence[str], aggregates: Sequence[str] = ()) -> list[str]:
    """Top-level arrays of records, other than the known ``aggregates``, that carry one of ``names``: lists of single cases."""
    banned, out = {n.lower() for n in names}, []
    for f in df.schema.fields:
        element = getattr(f.dataType, "elementType", None)
        if f.name not in aggregates and hasattr(element, "fields") and banned & {x.name.lower() for x in element.fields}:
            out.append(f.name)
    return out


def count_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that aren't there with an integer type: counts of people or cases are never fractions or texts."""
    kinds = dict(df.dtypes)
    return [n for n in names if kinds.get(n) not in ("tinyint", "smallint", "int", "bigint")]


def provenance(layers: DataFrame) -> DataFrame:
    """layer, result of (layer, placeholder, permanent_water_masked): a placeholder is skipped, every other layer must say that permanent water is masked."""
    result = F.when(F.coalesce("placeholder", F.lit(False)), "skip").when(F.coalesce("permanent_water_masked", F.lit(False)), "pass").otherwise("fail")
    return layers.select("layer", result.alias("result"))


def cited(findings: DataFrame, reason: Column) -> DataFrame:
    """Checks: there are findings, and none has a ``reason`` why it can't be shown (see normalise.finding_reason)."""
    rows = findings.agg(F.count("*").alias("n"), F.sum(F.when(reason.isNotNull(), 1).otherwise(0)).cast("long").alias("bad"))
    found = F.array(F.struct(F.lit("has_rows").alias("check_name"), F.when(F.col("n") == 0, 1).otherwise(0).cast("long").alias("n_bad")), F.struct(F.lit("cited").alias("check_name"), F.coalesce("bad", F.lit(0)).alias("n_bad")))
    return rows.select(F.explode(found).alias("c")).select("c.check_name", F.lit("fail").alias("severity"), "c.n_bad", (F.col("c.n_bad") == 0).alias("ok"))


# States that a layer may report, and those that mean an honestly empty layer.
STATUSES = {
    "flood": ("ok", "no_usable_pass", "degenerate_threshold", "low_confidence"),
    "rain": ("ok", "no_data", "low_confidence"),
    "roads": ("ok", "no_usable_pass", "degenerate_threshold", "low_confidence"),
}
EMPTY = ("no_usable_pass", "degenerate_threshold", "low_confidence", "no_data")


def layer_checks(layers: DataFrame, features: DataFrame, now: Column, most_hours: Column, strict: bool = False) -> DataFrame:
    """layer, check_name, severity, ok: what a published layer says of itself against what it holds.

    layers: layer, kind (flood, rain, roads), scan_status, as_of, feature_count, permanent_water_masked, observed_not_forecast; features:
    layer, exposure. ``most_hours`` is the age up to which a layer is fresh; staleness warns, and fails with ``strict``. A check that
    doesn't apply to a layer gives no row.
    """
    held = features.groupBy("layer").agg(F.count("*").alias("held"), F.sum(F.when(F.col("exposure") == "unknown", 1).otherwise(0)).alias("unknown"))
    j = layers.join(held, "layer", "left").withColumns({"held": F.coalesce("held", F.lit(0)), "unknown": F.coalesce("unknown", F.lit(0))})
    kind, status = F.col("kind"), F.col("scan_status")
    known = F.coalesce(*[F.when(kind == k, status.isin(*s)) for k, s in STATUSES.items()])
    ok, empty = status == "ok", status.isin(*EMPTY)
    age = (F.unix_seconds(now) - F.unix_seconds("as_of")) / 3600
    dated = ok & (kind != "roads")
    rules = [
        ("status_known", "fail", F.lit(True), known),
        ("water_masked", "fail", kind == "flood", F.col("permanent_water_masked")),
        ("observed", "fail", kind == "flood", F.col("observed_not_forecast")),
        ("count_matches", "fail", F.lit(True), F.col("feature_count") == F.col("held")),
        ("ok_has_features", "fail", dated, F.col("held") > 0),
        ("ok_has_date", "fail", dated, F.col("as_of").isNotNull()),
        ("fresh", "fail" if strict else "warn", dated & F.col("as_of").isNotNull(), age <= most_hours),
        ("empty_has_no_features", "fail", empty & (kind != "roads"), F.col("held") == 0),
        ("has_segments", "fail", kind == "roads", F.col("held") > 0),
        ("segments_unknown", "fail", empty & (kind == "roads") & (F.col("held") > 0), F.col("unknown") > 0),
    ]
    no = F.lit(False)
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("severity"), F.coalesce(a, no).alias("applies"), F.coalesce(g, no).alias("ok")) for n, s, a, g in rules])
    return j.select("layer", F.explode(rows).alias("r")).where("r.applies").select("layer", "r.check_name", "r.severity", "r.ok")
