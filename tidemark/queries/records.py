"""Normalisation and filters (F1-F17, F25-F28, F36) and textual joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bands, normalise
from tidemark.operators import joins
from tidemark.queries.base import query, table
from tidemark.sources import layers


def _sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_CATEGORY = "CASE WHEN p_type = 'ECONOMY' THEN 'Flood Control and Drainage' WHEN p_type = 'PROMO' THEN 'GAA 2024 ' || p_brand WHEN p_type = 'SMALL' THEN 'Support for LP' WHEN p_type = 'MEDIUM' THEN 'Roads and drainage' END"
_TITLE = "CASE WHEN contains(p_name, 'ring') THEN 'Drainage of ' || p_name WHEN contains(p_name, 'bolt') THEN 'Seawall ' || p_name ELSE p_name END"


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    category = (
        F.when(F.col("p_type") == "ECONOMY", "Flood Control and Drainage")
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("GAA 2024 "), "p_brand"))
        .when(F.col("p_type") == "SMALL", "Support for LP")
        .when(F.col("p_type") == "MEDIUM", "Roads and drainage")
    )
    title = F.when(F.col("p_name").contains("ring"), F.concat(F.lit("Drainage of "), "p_name")).when(F.col("p_name").contains("bolt"), F.concat(F.lit("Seawall "), "p_name")).otherwise(F.col("p_name"))
    return part.select(F.col("p_partkey").alias("ContractID"), category.alias(" Category "), title.alias("description"), F.col("p_retailprice").alias("contractCost"))


_UNINFORMATIVE = f"""(trim(lower(coalesce(category, ''))) IN ('', 'nan', 'none', 'null') OR (NOT {_sql_any("lower(coalesce(category, ''))", normalise.WORK_WORDS)}
  AND (regexp_matches(trim(lower(coalesce(category, ''))), '{normalise.FUND_BEGINNING}') OR regexp_matches(trim(lower(coalesce(category, ''))), '{normalise.FUND_WORD}'))))"""


@query(f"""
WITH p AS (SELECT p_partkey AS project_id, {_CATEGORY} AS category, {_TITLE} AS title, p_retailprice AS amount FROM part)
SELECT project_id, coalesce({" ".join(["CASE"] + [f"WHEN contains(lower(title || ' ' || coalesce(category, '')), '{w}') THEN '{w}'" for w in normalise.FLOOD_WORDS] + ["END"])}, 'flood control') AS flood_type, amount
FROM p WHERE trim(lower(coalesce(category, ''))) = '{normalise.FLOOD_CATEGORY}' OR ({_UNINFORMATIVE} AND {_sql_any("lower(title)", normalise.FLOOD_WORDS)})
""")
def q_subset_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns resolved by variants, subset by category or rescued by title, type by keyword."""
    p = normalise.select_resolved(_projects(spark, sf_dir), {k: normalise.PROJECT_COLUMNS[k] for k in ("project_id", "title", "contract_amount", "category")})
    kept = p.where(normalise.is_flood_control(F.col("category"), F.col("title")))
    return kept.select("project_id", normalise.flood_type(F.col("title"), F.col("category")).alias("flood_type"), F.col("contract_amount").alias("amount"))


_STATUS = "CASE o_orderkey % 8 WHEN 0 THEN 'Completed ' WHEN 1 THEN 'NOT YET STARTED' WHEN 2 THEN ' On-Going' WHEN 3 THEN 'cancelled' WHEN 4 THEN '100%' WHEN 5 THEN 'started' WHEN 6 THEN NULL ELSE o_orderpriority END"


@query(f"""
SELECT status, count(*) AS n FROM (SELECT CASE {" ".join(f"WHEN {_sql_any('s', w)} THEN '{n}'" for n, w in normalise.STATUS_WORDS)} ELSE 'unknown' END AS status
FROM (SELECT lower(trim({_STATUS})) AS s FROM orders)) GROUP BY status
""")
def q_status_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """canonical statuses."""
    raw = F.expr(_STATUS)
    return table(spark, sf_dir, "orders").select(normalise.status_of(raw).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""
WITH a AS (
  SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '₱' || o_orderkey || ',000' WHEN 1 THEN 'PHP ' || o_orderkey || '.50' WHEN 2 THEN '-' || o_orderkey WHEN 3 THEN o_orderkey || 'd' WHEN 4 THEN 'n/a' ELSE ' ' || o_orderkey || ' ' END AS raw FROM orders
), b AS (SELECT o_orderkey, regexp_replace(trim(raw), 'PHP|[₱P, ]', '', 'g') AS t FROM a),
c AS (SELECT o_orderkey, CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(t AS DOUBLE) END AS v FROM b)
SELECT o_orderkey, CASE WHEN v > 0 THEN v END AS amount FROM c
""")
def q_amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """amounts from texts."""
    raw = F.expr("CASE o_orderkey % 6 WHEN 0 THEN '₱' || o_orderkey || ',000' WHEN 1 THEN 'PHP ' || o_orderkey || '.50' WHEN 2 THEN '-' || o_orderkey WHEN 3 THEN o_orderkey || 'd' WHEN 4 THEN 'n/a' ELSE ' ' || o_orderkey || ' ' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", normalise.amount_of(raw).alias("amount"))


@query("""
WITH d AS (
  SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 3 THEN strftime(o_orderdate, '%d %B %Y') ELSE 'nat' END AS raw FROM orders
)
SELECT o_orderkey, CAST(coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%m/%d/%Y'), try_strptime(raw, '%d-%b-%Y'), try_strptime(raw, '%d %B %Y')) AS DATE) AS day,
       CASE WHEN regexp_matches(raw, '^.{4}-.{2}-.{2}') THEN left(raw, 10) END AS iso FROM d
""")
def q_date_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dates in several formats, and ISO coercion."""
    day = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "MM/dd/yyyy")).when(k == 2, F.date_format(day, "dd-MMM-yyyy")).when(k == 3, F.date_format(day, "dd MMMM yyyy")).otherwise("nat")
    return table(spark, sf_dir, "orders").select("o_orderkey", normalise.date_of(raw).alias("day"), normalise.iso_date_of(raw).alias("iso"))


@query("""
SELECT c_custkey, (c_acctbal BETWEEN 4.4 AND 2121.3 AND c_nationkey BETWEEN 3 AND 12) AS in_box,
       CASE WHEN c_acctbal BETWEEN 4.4 AND 2121.3 AND c_nationkey BETWEEN 3 AND 12 THEN 1.0 ELSE 0.6 END::DOUBLE AS confidence FROM customer
""")
def q_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inclusive box and the confidence that follows from it."""
    lat, lon = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    box = normalise.in_bbox(lat, lon, (4.4, 2121.3), (3, 12))
    return table(spark, sf_dir, "customer").select("c_custkey", box.alias("in_box"), F.when(box, 1.0).otherwise(0.6).alias("confidence"))


@query(f"""
SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains({normalise.KEY_STOPWORDS!r}, w)), '_') AS key
FROM documents
""")
def q_desc_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """description keys of whole texts."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", normalise.description_key(F.col("text")).alias("key"))


@query("""
WITH t AS (SELECT p_partkey, p_brand, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS w FROM part)
SELECT a.p_partkey AS left_id, min(b.p_partkey) AS right_id, count(*) AS n
FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey > b.p_partkey
WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.6 GROUP BY a.p_partkey
""")
def q_fuzzy_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sets at least 0.6 alike within a brand; the first finding wins."""
    t = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("tokens"))
    return joins.jaccard_earlier(t, ["p_brand"], 0.6)


@query("""
WITH l AS (SELECT c_custkey AS left_id, 'nation_' || (c_custkey % 30) || CASE WHEN c_custkey % 3 = 0 THEN ' 1st deo' ELSE '' END AS raw FROM customer),
t AS (SELECT left_id, trim(CASE WHEN contains(raw, ' 1st') THEN split_part(raw, ' 1st', 1) ELSE raw END) AS t FROM l),
n AS (SELECT n_nationkey AS right_id, lower(n_name) AS t FROM nation)
SELECT left_id, coalesce(min(right_id) FILTER (WHERE t.t = n.t), min(right_id)) AS right_id FROM t JOIN n ON starts_with(t.t, n.t) OR starts_with(n.t, t.t) GROUP BY left_id
""")
def q_text_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Province texts without office marks, exact or by prefix either way, first in order."""
    raw = F.concat(F.lit("nation_"), (F.col("c_custkey") % 30).cast("string"), F.when(F.col("c_custkey") % 3 == 0, " 1st deo").otherwise(""))
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("left_id"), normalise.province_text(raw).alias("text"))
    right = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("right_id"), F.lower("n_name").alias("text"))
    return joins.text_join(left, right)


@query("""
SELECT p_partkey, CASE WHEN p_type NOT IN ('ECONOMY', 'PROMO') THEN 'finding not in vocabulary' WHEN p_partkey % 7 = 0 THEN 'source_url missing or not http(s)'
  WHEN p_partkey % 5 = 0 THEN 'source_org missing' WHEN contains(p_name, 'hot') THEN 'banned word hot' END AS reason FROM part
""")
def q_finding_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """why a finding is dropped."""
    row = {
        "coa_finding": F.col("p_type"), "source_url": F.when(F.col("p_partkey") % 7 == 0, F.lit("ftp://a")).otherwise(F.lit("https://a")), "source_published": F.lit("2024-01-01"),
        "source_org": F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.lit("org")), "description": F.col("p_name"),
    }
    return table(spark, sf_dir, "part").select("p_partkey", normalise.finding_reason(row, ["ECONOMY", "PROMO"], ["hot"]).alias("reason"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS s, CAST(l_shipdate AS DATE) AS c, l_extendedprice, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT count(*) AS n, min(s - 194) AS first_pre0, max(s - 14) AS last_pre1, min(c + 14) AS first_post0, max(c + 194) AS last_post1 FROM d WHERE c >= s
""")
def q_pre_post_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """windows before and after the works, for rows with dates in order."""
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = d.select(bands.pre_post_windows(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).alias("w")).where("w is not null")
    return w.agg(F.count("*").alias("n"), F.min("w.pre0").alias("first_pre0"), F.max("w.pre1").alias("last_pre1"), F.min("w.post0").alias("first_post0"), F.max("w.post1").alias("last_post1"))


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM documents
""")
def q_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole texts without case, marks and punctuation."""
    return table(spark, sf_dir, "documents").select("doc_id", normalise.plain_text(F.col("text")).alias("plain"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'DPWH-' || (row_number() OVER () - 1) END AS record FROM customer")
def q_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of records; those without one have the number of their row."""
    rows = layers.numbered(spark, f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    return rows.select("c_custkey", F.when(k % 3 == 0, normalise.record_id(rows, "c_name")).otherwise(normalise.record_id(rows.drop("c_name"), "c_name")).alias("record"))
