"""Base DataFrames derived from the given tables, with the same derivations as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.nodes import code_groups
from tidepanel.plans.registry import values_sql

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- coded flows -------------------------------------------------------------------------------

SEGMENT_ENTITY = {
    "AUTOMOBILE": "KORPORASI", "MACHINERY": "KORPORASI", "BUILDING": "PTMN",
    "HOUSEHOLD": "ASING", "FURNITURE": "INDIVIDU",
}


def flows(spark, sf_dir) -> DataFrame:
    """(ds, entity, code, purpose, volume): one signed whole-unit amount per line."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey",
        F.rint(F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
               * (F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("volume"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("ds"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    ent = F.create_map(*[F.lit(x) for kv in SEGMENT_ENTITY.items() for x in kv])
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(c, F.col("o_custkey") == c.c_custkey)
              .join(p, F.col("l_partkey") == p.p_partkey)
              .select("ds", ent[F.col("c_mktsegment")].alias("entity"),
                      (F.col("p_size") - 1).alias("code"),
                      F.concat(F.lpad((F.col("p_size") - 1).cast("string"), 2, "0"), F.lit(" - "), "p_type").alias("purpose"),
                      "volume"))


FLOWS = f"""flows AS (
  SELECT CAST(o_orderdate AS DATE) AS ds,
         CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_ENTITY.items())} END AS entity,
         p_size - 1 AS code,
         lpad(CAST(p_size - 1 AS VARCHAR), 2, '0') || ' - ' || p_type AS purpose,
         round_even((CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END) * (l_extendedprice * (1 - l_discount)), 0) AS volume
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""

CODES = f"codes(code, col, neg_cat, pos_cat) AS ({values_sql(code_groups())})"
LEDGER = f"""{FLOWS}, {CODES}, ledger AS (
  SELECT ds, entity, col, neg_cat, pos_cat, sum(volume) AS volume FROM flows JOIN codes USING (code) GROUP BY ALL)"""
CATS = f"""{LEDGER}, cats AS (
  SELECT ds, entity, CASE WHEN volume < 0 THEN neg_cat ELSE pos_cat END AS category, sum(volume) AS volume
  FROM ledger GROUP BY ALL)"""
TIDY = f"""{CATS}, tidy AS (
  SELECT ds, entity, category, round_even(volume / 1000, 0) AS value FROM cats)"""


# --- daily series ------------------------------------------------------------------------------

def signed_orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("ds"), "o_orderpriority", "o_custkey",
        (F.when(F.col("o_orderstatus") == "F", -1.0).otherwise(1.0) * F.rint(F.col("o_totalprice") / 1000)).alias("v"))


def series(spark, sf_dir) -> DataFrame:
    """(series, ds, y): one whole-number value per order priority and reported day, missing = 0."""
    daily = signed_orders(spark, sf_dir).groupBy("ds").agg(
        *[F.coalesce(F.sum(F.when(F.col("o_orderpriority") == p, F.col("v"))), F.lit(0.0)).alias(p) for p in PRIORITIES])
    return daily.select("ds", F.explode(F.array(
        *[F.struct(F.lit(p).alias("series"), F.col(f"`{p}`").alias("y")) for p in PRIORITIES])).alias("s")
    ).select("s.series", "ds", "s.y")


SERIES = f"""orders_signed AS (
  SELECT CAST(o_orderdate AS DATE) AS ds, o_orderpriority,
         (CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE 1.0 END) * round_even(o_totalprice / 1000, 0) AS v FROM orders),
series AS (
  SELECT p.series, d.ds, CAST(coalesce(sum(o.v), 0) AS DOUBLE) AS y
  FROM (SELECT DISTINCT ds FROM orders_signed) d
  CROSS JOIN (SELECT unnest(['{"','".join(PRIORITIES)}']) AS series) p
  LEFT JOIN orders_signed o ON o.ds = d.ds AND o.o_orderpriority = p.series GROUP BY 1, 2)"""
INDEXED = f"""{SERIES}, idx AS (
  SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds) AS i,
         count(*) OVER (PARTITION BY series) AS n FROM series)"""


# --- external series: one supplier-country price level per reported ship day --------------------

def external(spark, sf_dir) -> DataFrame:
    """(name, ds, value): average ship-day price of three return flags, present only on ship days."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("name"), F.to_date("l_shipdate").alias("ds")).agg(
        (F.sum(F.rint("l_extendedprice")) / F.count(F.lit(1))).alias("value"))


EXTERNAL = """external AS (
  SELECT l_returnflag AS name, CAST(l_shipdate AS DATE) AS ds,
         sum(round_even(l_extendedprice, 0)) / count(*) AS value FROM lineitem GROUP BY 1, 2)"""


# --- articles ----------------------------------------------------------------------------------

def articles(spark, sf_dir) -> DataFrame:
    """One scored or unscored article per event: scorer = event type, polarity in [-1, 1]."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id"), F.col("ts").alias("published_utc"),
        F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"),
        F.concat(F.lit("/n/"), F.col("user_id").cast("string")).alias("url"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("  Item "), F.col("event_type"), F.lit("  "), F.col("user_id").cast("string"))).alias("title"),
        F.col("event_type").alias("scorer"), k.alias("k"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.rint((F.col("value") - 10) * 8) / 64))).alias("polarity"))


ARTICLES = """articles AS (
  SELECT event_id, ts AS published_utc, 'src' || CAST(user_id % 7 AS VARCHAR) AS source, '/n/' || CAST(user_id AS VARCHAR) AS url,
         CASE WHEN k % 11 = 0 THEN NULL ELSE '  Item ' || event_type || '  ' || CAST(user_id AS VARCHAR) END AS title,
         event_type AS scorer, k,
         CASE WHEN k % 5 = 0 THEN NULL ELSE greatest(-1.0, least(1.0, round_even((value - 10) * 8, 0) / 64)) END AS polarity
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
