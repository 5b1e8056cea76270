"""Classes and bands as chained conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Budget bands (label, lowest amount, first amount beyond).
TRANCHES: list[tuple[str, float, float | None]] = [
    ("<₱10M", 0.0, 10_000_000.0),
    ("₱10-50M", 10_000_000.0, 50_000_000.0),
    ("₱50-100M", 50_000_000.0, 100_000_000.0),
    ("₱100-500M", 100_000_000.0, 500_000_000.0),
    (">₱500M", 500_000_000.0, None),
]
# Expressways (name, words of ref and name, limited access), in the order in which they are tried.
CORRIDORS: list[tuple[str, list[str], bool]] = [
    ("Skyway Stage 3", ["skyway stage 3", "skyway stage iii", "metro manila skyway stage 3"], True),
    ("Skyway", ["skyway", "metro manila skyway", "smc skyway"], True),
    ("SLEX", ["slex", "south luzon expressway"], True),
    ("NLEX", ["nlex", "north luzon expressway"], True),
    ("SCTEX", ["sctex", "subic–clark–tarlac", "subic-clark-tarlac"], True),
    ("TPLEX", ["tplex", "tarlac–pangasinan–la union", "tarlac-pangasinan-la union"], True),
    ("CAVITEX", ["cavitex", "manila–cavite expressway", "manila-cavite expressway", "coastal road"], True),
    ("NAIAX", ["naiax", "naia expressway"], True),
    ("CALAX", ["calax", "cavite–laguna expressway", "cavite-laguna expressway"], True),
    ("C5", ["c-5", "c5 road", "circumferential road 5", "carlos p. garcia"], False),
    ("EDSA", ["edsa", "epifanio de los santos"], False),
    ("Commonwealth Ave", ["commonwealth avenue", "commonwealth ave"], False),
]
PRONE, RAIN_EDGES, SIGNAL_EDGES, VALID_DB = 0.6, (30.0, 60.0, 120.0), (1.5, 3.0), (-30.0, 0.0)
STALE_SECONDS = {"sentinel1": 12 * 86400, "rainviewer": 1800, "viirs": 48 * 3600}


def band(value: Column, bands: Sequence[tuple[str, float, float | None]] = TRANCHES) -> Column:
    """Label of the half-open band that holds a positive value; NULL else."""
    out = F.lit(None).cast("string")
    for label, low, high in reversed(bands):
        out = F.when((value >= low) & (F.lit(True) if high is None else value < high), label).otherwise(out)
    return F.when(value > 0, out)


def gap_class(score: Column, events: Column, prone: float = PRONE) -> Column:
    score, events = F.coalesce(score, F.lit(0.0)), F.coalesce(events, F.lit(0))
    return (
        F.when((score >= prone) & (events <= 1), "under_observed_prone")
        .when(events >= 3, "charted")
        .when((score >= prone) & (events == 2), "monitored")
        .otherwise("low")
    )


def rain_band(mm: Column, edges: tuple[float, float, float] = RAIN_EDGES) -> Column:
    return F.when(mm >= edges[2], "red").when(mm >= edges[1], "orange").when(mm >= edges[0], "yellow").otherwise("none")


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def change_signal(delta: Column) -> Column:
    d = finite(delta)
    return F.when(d >= SIGNAL_EDGES[1], "strong").when(d >= SIGNAL_EDGES[0], "weak").otherwise("none")


def valid_range(value: Column, low: float = VALID_DB[0], high: float = VALID_DB[1]) -> Column:
    return F.when(value.between(low, high) & ~F.isnan(value), value)


def pre_post_windows(start: Column, completion: Column, guard: int = 14, window: int = 180) -> Column:
    """struct(pre0, pre1, post0, post1) around the works; NULL for missing or reversed dates."""
    made = F.struct(
        F.date_sub(start, guard + window).alias("pre0"), F.date_sub(start, guard).alias("pre1"),
        F.date_add(completion, guard).alias("post0"), F.date_add(completion, guard + window).alias("post1"),
    )
    return F.when(completion >= start, made)


def exposure_class(usable: Column, length: Column, flooded: Column, near: Column, share: float = 0.05, metres: float = 80.0) -> Column:
    """unknown without a usable pass; flooded from ``share`` of the length or ``metres``; near; clear."""
    return (
        F.when(~usable, "unknown")
        .when((F.try_divide(flooded, length) >= share) | (flooded >= metres), "flooded")
        .when((flooded > 0) | (near > 0), "near")
        .otherwise("clear")
    )


def distance_class(km: Column) -> Column:
    return F.when(km <= 0.05, "intersects").when(km <= 1.0, "near").otherwise("clear")


def recurrence_state(score: Column, km: Column) -> Column:
    """State of the nearest sample of the model."""
    return F.when(F.coalesce(score, F.lit(-1.0)) < 0, "clear").when(km > 2.5, "clear").when(score >= PRONE, "intersects").otherwise("near")


def gap_outcome(modelled: Column, recorded: Column) -> Column:
    """What the model's state and the record's state say together."""
    prone = modelled.isin("intersects", "near")
    return (
        F.when((modelled == "unavailable") | (recorded == "unavailable"), "not_comparable")
        .when(prone & recorded.isin("near", "clear"), "modelled_not_recorded")
        .when(prone & (recorded == "intersects"), "modelled_and_recorded")
        .when(~prone & (recorded == "intersects"), "recorded_not_modelled")
        .otherwise("neither")
    )


def corridor_of(ref: Column, name: Column, corridors: Sequence[tuple[str, Sequence[str], bool]] = CORRIDORS) -> Column:
    """struct(road_name, corridor, is_expressway) of a road; the first corridor whose words occur."""
    ref, name = F.coalesce(ref, F.lit("")), F.coalesce(name, F.lit(""))
    text = F.lower(F.concat_ws(" ", ref, name))
    own = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(ref), F.lit("")))
    out = F.struct(F.coalesce(own, F.lit("Unnamed road")).alias("road_name"), F.lit("").alias("corridor"), F.lit(False).alias("is_expressway"))
    for key, words, fast in reversed(corridors):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, F.struct(F.coalesce(own, F.lit(key)).alias("road_name"), F.lit(key).alias("corridor"), F.lit(fast).alias("is_expressway"))).otherwise(out)
    return out


def road_in_scope(highway: Column, ref: Column, is_expressway: Column) -> Column:
    """Links and primary roads without a number only as parts of an expressway."""
    link = highway.endswith("_link")
    local = highway.startswith("primary") & (F.coalesce(ref, F.lit("")) == "")
    return is_expressway | ~(link | local)


def age_text(at: Column, now: Column) -> Column:
    """How long ago, in words that get coarser with age."""
    s = F.greatest(F.lit(0), F.unix_seconds(now) - F.unix_seconds(at)).cast("long")
    minutes, hours, days = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    return (
        F.when(at.isNull(), "acquisition time unavailable")
        .when(s < 3600, F.concat(F.lit("updated "), minutes.cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.lit("updated "), hours.cast("string"), F.lit(" h "), (minutes - hours * 60).cast("string"), F.lit(" min ago")))
        .when(s < 7 * 86400, F.concat(F.lit("updated "), days.cast("string"), F.lit(" days ago (last Sentinel-1 pass)")))
        .otherwise(F.concat(F.lit("last pass "), days.cast("string"), F.lit(" days ago")))
    )


def is_stale(at: Column, now: Column, seconds: Column) -> Column:
    """Older than its own cadence; what is missing isn't stale."""
    return F.coalesce(F.unix_seconds(now) - F.unix_seconds(at) > seconds, F.lit(False))


def local_time(at: Column, zone: str = "Asia/Manila", label: str = " PHT") -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm"), F.lit(label))


def money_short(amount: Column) -> Column:
    """Trillions, billions, millions, or whole units with separators."""
    return (
        F.when(amount >= 1e12, F.concat(F.format_number(amount / 1e12, 2), F.lit("T")))
        .when(amount >= 1e9, F.concat(F.format_number(amount / 1e9, 1), F.lit("B")))
        .when(amount >= 1e6, F.concat(F.format_number(amount / 1e6, 1), F.lit("M")))
        .otherwise(F.format_number(amount, 0))
    )


def warrants_review(allocation: Column, score: Column, passes: Column) -> Column:
    """Money allocated where floods are modelled or have been observed."""
    return F.coalesce((allocation > 0) & ((F.coalesce(score, F.lit(0.0)) >= PRONE) | (F.coalesce(passes, F.lit(0)) > 0)), F.lit(False))


def escaped(text: Column) -> Column:
    """A text for the body or an attribute of a page."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def time_of(text: Column) -> Column:
    """A timestamp of an ISO text with Z, an offset or neither (then UTC), or of a date; NULL for anything else."""
    bare = F.trim(text)
    zoned = F.when(bare.rlike(r"(Z|[+-]\d\d:?\d\d)$") & bare.contains(":"), bare).when(bare.contains(":"), F.concat(bare, F.lit("Z"))).otherwise(F.concat(bare, F.lit("T00:00:00Z")))
    return F.when(bare.rlike(r"^\d{4}-\d\d-\d\d"), zoned.try_cast("timestamp"))
