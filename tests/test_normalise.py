import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bands, normalise, text


def values(spark, rows, schema, *columns):
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in sorted(out)]


def test_columns_are_resolved_by_the_first_variant():
    found = normalise.resolve_columns([" ContractID ", "Budget", "ContractCost", "LAT", "weird"])
    assert found["project_id"] == " ContractID " and found["contract_amount"] == "ContractCost" and found["latitude"] == "LAT" and "status" not in found


@pytest.mark.parametrize("compatible", [False, True])
def test_amounts(spark, compatible):
    rows = [("₱1,000.50",), ("PHP 1,000",), ("-5",), ("0",), ("5d",), ("1e3",), (None,), (" 7 ",), ("NaN",), (".5",)]
    want = [1000.5, None if compatible else 1000.0, None, None, None, 1000.0, None, 7.0, None, 0.5]
    assert values(spark, rows, "x string", normalise.amount_of(F.col("x"), compatible)) == want


def test_statuses(spark):
    rows = {"Completed": "completed", "100% ": "completed", "incomplete": "completed", "Not Yet Started": "not_started", "For Procurement": "not_started", "CANCELLED": "terminated", "On-Going": "ongoing", "Started": "ongoing", "odd": "unknown", None: "unknown", "abandoned": "completed"}
    assert values(spark, [(k,) for k in rows], "x string", normalise.status_of(F.col("x"))) == list(rows.values())


def test_dates(spark):
    rows = [("2024-02-30",), ("2024-02-29",), ("3/4/2024",), ("05-Jan-2024",), ("01-Jan-70",), ("05-Jan-24",), ("January 5, 2024",), ("5 January 2024",), ("2024-01-05T10:00:00",), ("nat",), (None,)]
    got = [None if d is None else d.isoformat() for d in values(spark, rows, "x string", normalise.date_of(F.col("x")))]
    assert got == [None, "2024-02-29", "2024-03-04", "2024-01-05", "1970-01-01", "2024-01-05", "2024-01-05", "2024-01-05", "2024-01-05", None, None]


def test_iso_dates(spark):
    rows = [("2024-02-29 10:00",), ("2024-13-99",), ("2024/02/29",), ("nan",), ("",), (None,), ("none-12-31",), (" 2024-01-02 ",)]
    assert values(spark, rows, "x string", normalise.iso_date_of(F.col("x"))) == ["2024-02-29", "2024-13-99", None, None, None, None, None, "2024-01-02"]


def test_membership(spark):
    rows = [
        ("Flood Control and Drainage", "anything", True), (" flood control and drainage ", "", True), ("Roads", "drainage along the road", False), ("GAA 2024 LP", "Construction of seawall", True),
        ("GAA 2024 LP", "school", False), ("", "revetment works", True), (None, "Dike", True), ("Bridges CSSP", "dike", False), ("Something else", "dike", False), ("SSP program", "river wall", True),
    ]
    assert values(spark, [r[:2] for r in rows], "c string, t string", normalise.is_flood_control(F.col("c"), F.col("t"))) == [r[2] for r in rows]


def test_box_with_corners_and_nan(spark):
    rows = [(4.4, 116.7), (21.3, 126.7), (4.39, 120.0), (10.0, 126.71), (None, 120.0), (math.nan, 120.0), (10.0, None), (14.5, 121.0)]
    assert values(spark, rows, "a double, b double", normalise.in_bbox(F.col("a"), F.col("b"))) == [True, True, False, False, False, False, False, True]


def test_description_key_is_idempotent(spark):
    rows = [("Construction of the Dike along Brgy. Sto. Niño, Section 2",), ("  The   of ",), ("",), (None,)]
    once = normalise.description_key(F.col("x"))
    got = values(spark, rows, "x string", once, normalise.description_key(once))
    assert all(a == b for a, b in got) and got[0][0] == "construction_dike_sto_ni_o_2" and got[1][0] == ""


def test_province_text_without_office(spark):
    assert values(spark, [("Bulacan 1st DEO",), ("Pampanga DEO",), (" Rizal ",)], "x string", normalise.province_text(F.col("x"))) == ["bulacan", "pampanga", "rizal"]


def test_tranches_at_their_edges(spark):
    rows = [(None,), (0.0,), (-1.0,), (1.0,), (9_999_999.99,), (1e7,), (5e7,), (1e8,), (499_999_999.0,), (5e8,), (1e12,)]
    want = [None, None, None, "<₱10M", "<₱10M", "₱10-50M", "₱50-100M", "₱100-500M", "₱100-500M", ">₱500M", ">₱500M"]
    assert values(spark, rows, "x double", bands.band(F.col("x"))) == want


def test_signals_and_ranges(spark):
    rows = [(None,), (math.nan,), (math.inf,), (-math.inf,), (-3.0,), (1.49,), (1.5,), (2.99,), (3.0,)]
    assert values(spark, rows, "x double", bands.change_signal(F.col("x"))) == ["none"] * 6 + ["weak", "weak", "strong"]
    assert values(spark, [(-30.0,), (0.0,), (0.1,), (math.nan,)], "x double", bands.valid_range(F.col("x"))) == [-30.0, 0.0, None, None]


def test_gap_classes_in_order(spark):
    rows = [(0.6, 0), (0.6, 1), (0.6, 2), (0.6, 3), (0.1, 3), (0.1, 2), (None, None)]
    assert values(spark, rows, "s double, e int", bands.gap_class(F.col("s"), F.col("e"))) == ["under_observed_prone"] * 2 + ["monitored", "charted", "charted", "low", "low"]


def test_gap_outcomes(spark):
    rows = [("unavailable", "near"), ("intersects", "clear"), ("near", "intersects"), ("clear", "intersects"), ("clear", "near")]
    assert values(spark, rows, "a string, b string", bands.gap_outcome(F.col("a"), F.col("b"))) == ["not_comparable", "modelled_not_recorded", "modelled_and_recorded", "recorded_not_modelled", "neither"]


def test_windows_around_works(spark):
    df = spark.sql("select date'2024-03-01' s, date'2024-06-01' c union all select date'2024-06-02', date'2024-06-01' union all select null, date'2024-06-01'")
    got = [r["w"] for r in df.select(bands.pre_post_windows(F.col("s"), F.col("c")).alias("w")).collect()]
    assert [d.isoformat() for d in got[0]] == ["2023-08-20", "2024-02-16", "2024-06-15", "2024-12-12"] and got[1:] == [None, None]


def test_review_rule(spark):
    rows = [(1.0, 0.6, 0), (1.0, 0.59, 0), (1.0, 0.0, 1), (0.0, 0.9, 3), (None, 0.9, 1), (1.0, None, None)]
    assert values(spark, rows, "a double, s double, p int", bands.warrants_review(F.col("a"), F.col("s"), F.col("p"))) == [True, False, True, False, False, False]


def test_exposure(spark):
    rows = [(True, 1000.0, 50.0, 1.0), (True, 10000.0, 80.0, 1.0), (True, 1000.0, 49.0, 1.0), (True, 1000.0, 0.0, 2.0), (True, 1000.0, 0.0, 0.0), (False, 1000.0, 900.0, 1.0)]
    got = values(spark, rows, "u boolean, l double, f double, n double", bands.exposure_class(F.col("u"), F.col("l"), F.col("f"), F.col("n")))
    assert got == ["flooded", "flooded", "near", "near", "clear", "unknown"]


def test_corridor_names(spark):
    rows = [("", "Metro Manila Skyway Stage 3"), ("", "Skyway"), ("N1", ""), ("", ""), ("C-5", " "), ("E2", "South Luzon Expressway")]
    got = values(spark, rows, "r string, n string", bands.corridor_of(F.col("r"), F.col("n")))
    assert [tuple(g) for g in got] == [("Metro Manila Skyway Stage 3", "Skyway Stage 3", True), ("Skyway", "Skyway", True), ("N1", "", False), ("Unnamed road", "", False), ("C-5", "C5", False), ("South Luzon Expressway", "SLEX", True)]


def test_ages(spark):
    df = spark.sql("select timestamp'2024-01-10 00:00:00' now, explode(array(timestamp'2024-01-09 23:30:01', timestamp'2024-01-09 20:58:00', timestamp'2024-01-05 00:00:00', timestamp'2024-01-01 00:00:00', null, timestamp'2024-01-11 00:00:00')) at")
    got = [r[0] for r in df.select(bands.age_text(F.col("at"), F.col("now"))).collect()]
    assert got == ["updated 29 min ago", "updated 3 h 2 min ago", "updated 5 days ago (last Sentinel-1 pass)", "last pass 9 days ago", "acquisition time unavailable", "updated 0 min ago"]


def test_search_scores(spark):
    rows = [("manila", "manila"), ("mani", "manila"), ("nil", "manila"), ("san juan city", "city of san pedro"), ("manilla", "manila bay"), ("manolo", "manila"), ("xx", "manila")]
    assert values(spark, rows, "q string, n string", text.search_score(F.col("q"), F.col("n"))) == [100, 78, 60, 56, 0, 30, 0]


def test_finding_reasons(spark):
    row = {n: F.col(n) for n in ("coa_finding", "source_url", "source_published", "source_org")}
    rows = [("a", "https://x", "2024", "o"), ("z", "https://x", "2024", "o"), ("a", "ftp://x", "2024", "o"), ("a", None, "2024", "o"), ("a", "http://x", "", "o"), ("a", "http://x", "2024", None), ("a", "http://fraudster", "2024", "o")]
    got = values(spark, rows, "coa_finding string, source_url string, source_published string, source_org string", normalise.finding_reason(row, ["a"], ["Fraud"]))
    assert got == [None, "finding not in vocabulary", "source_url missing or not http(s)", "source_url missing or not http(s)", "source_published missing", "source_org missing", "banned word Fraud"]


def test_hosts_and_keys(spark):
    rows = [("https://a.example.org/x", True), ("https://example.org.evil.com", False), ("http://example.org", False), ("https://user@example.org:8080", True), (None, False)]
    assert values(spark, [r[:1] for r in rows], "u string", text.url_allowed(F.col("u"), ["example.org"])) == [r[1] for r in rows]
    assert values(spark, [('{"a": {"email": 1}, "b": "phone:"}',), ("[]",)], "j string", text.forbidden_keys(F.col("j"), ["email", "phone"])) == [["email"], []]


def test_proximity_counts_characters_between(spark):
    rows = [("A" + "x" * 240 + "B", True), ("A" + "x" * 241 + "B", False), ("B\nA", True), (None, False)]
    assert values(spark, [r[:1] for r in rows], "t string", text.near_each_other(F.col("t"), "A", "B")) == [r[1] for r in rows]
