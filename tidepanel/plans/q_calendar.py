"""Calendar operators and node attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import calendar as cal
from tidepanel.plans import base as b
from tidepanel.plans import q_etl as qe
from tidepanel.plans.registry import query

HOLIDAYS = sorted(f"{y}-{md}" for y in range(1995, 2003) for md in ("01-01", "08-17", "12-25"))
_HOL = "hol AS (SELECT CAST(unnest([" + ",".join(f"'{h}'" for h in HOLIDAYS) + "]) AS DATE) AS h)"
_DAYS = f"{b.SERIES}, days AS (SELECT DISTINCT ds FROM series)"


def _days(s, d):
    return b.signed_orders(s, d).select("ds").distinct()


@query("c1_future_business_days", "series:s h:i ds:d", f"""WITH {b.SERIES}, {_HOL}, l AS (SELECT o_orderpriority AS series, max(ds) AS last_ds FROM orders_signed GROUP BY 1),
c AS (SELECT series, CAST(unnest(generate_series(last_ds + INTERVAL 1 DAY, last_ds + INTERVAL 200 DAY, INTERVAL 1 DAY)) AS DATE) AS ds FROM l)
SELECT series, row_number() OVER (PARTITION BY series ORDER BY ds) AS h, ds FROM c WHERE isodow(ds) < 6 AND ds NOT IN (SELECT h FROM hol)
QUALIFY row_number() OVER (PARTITION BY series ORDER BY ds) <= 60""")
def _(s, d):
    last = b.signed_orders(s, d).groupBy(F.col("o_orderpriority").alias("series")).agg(F.max("ds").alias("last_ds"))
    return cal.future_business_days(last, "last_ds", 60, HOLIDAYS)


@query("c2_business_day_spine", "ds:d", f"WITH {_DAYS}, c AS (SELECT CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM days) SELECT ds FROM c WHERE isodow(ds) < 6")
def _(s, d):
    return cal.business_day_spine(_days(s, d).agg(F.min("ds").alias("lo"), F.max("ds").alias("hi")), "lo", "hi").select("ds")


def _wave_sql(x, p, n):
    return f"sin(2*pi()*{x}/{p}) AS {n}_sin, cos(2*pi()*{x}/{p}) AS {n}_cos"


@query("c3_calendar_features", "ds:d day_of_week:0 month:0 week_of_year:0 day_of_week_sin:6 day_of_week_cos:6 month_sin:6 month_cos:6 is_weekend:0", f"""WITH {_DAYS}
SELECT ds, isodow(ds) - 1 AS day_of_week, month(ds) AS month, weekofyear(ds) AS week_of_year, {_wave_sql('(isodow(ds)-1)', 5, 'day_of_week')}, {_wave_sql('month(ds)', 12, 'month')},
CAST(isodow(ds) > 5 AS INT) AS is_weekend FROM days""")
def _(s, d):
    return _days(s, d).select("ds", *[c.alias(n) for n, c in cal.calendar_features(F.col("ds")).items()])


_QE = "CAST(date_trunc('quarter', ds) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"


@query("c3_calendar_flags", "ds:d day:i quarter:i is_month_start:i is_month_end:i is_quarter_start:i is_quarter_end:i", f"""WITH {_DAYS} SELECT ds, day(ds) AS day, quarter(ds) AS quarter,
CAST(day(ds) = 1 AS INT) AS is_month_start, CAST(ds = last_day(ds) AS INT) AS is_month_end, CAST(ds = date_trunc('quarter', ds) AS INT) AS is_quarter_start, CAST(ds = {_QE} AS INT) AS is_quarter_end FROM days""")
def _(s, d):
    return _days(s, d).select("ds", *[c.alias(n) for n, c in cal.calendar_flags(F.col("ds")).items()])


@query("c4_days_until_period_end", "ds:d days_until_month_end:0 days_until_quarter_end:0 is_near_month_end:0 is_near_quarter_end:0", f"""WITH {_DAYS},
x AS (SELECT ds, date_diff('day', ds, last_day(ds)) AS m, date_diff('day', ds, {_QE}) AS q FROM days)
SELECT ds, m AS days_until_month_end, q AS days_until_quarter_end, CAST(m <= 5 AS INT) AS is_near_month_end, CAST(q <= 10 AS INT) AS is_near_quarter_end FROM x""")
def _(s, d):
    return _days(s, d).select("ds", *[c.alias(n) for n, c in cal.period_end_features(F.col("ds")).items()])


@query("c5_holiday_features", "ds:d is_holiday:0 days_to_holiday:0 days_from_holiday:0", f"""WITH {_DAYS}, {_HOL} SELECT ds, CAST(bool_or(h = ds) AS INT) AS is_holiday,
coalesce(date_diff('day', ds, min(h) FILTER (h > ds)), 30) AS days_to_holiday, coalesce(date_diff('day', max(h) FILTER (h < ds), ds), 30) AS days_from_holiday FROM days CROSS JOIN hol GROUP BY ds""")
def _(s, d):
    return _days(s, d).select("ds", *[c.alias(n) for n, c in cal.holiday_features(F.col("ds"), HOLIDAYS).items()])


@query("c6_fourier_features", "ds:d " + " ".join(f"fourier_{n}_{w}:6" for n in ("weekly", "monthly", "quarterly") for w in ("sin", "cos")), f"""WITH {_DAYS},
spine AS (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS x),
i AS (SELECT ds, CASE WHEN ds >= DATE '2000-01-03' THEN (SELECT count(*) FROM spine WHERE x >= DATE '2000-01-03' AND x < ds AND isodow(x) < 6)
  ELSE -(SELECT count(*) FROM spine WHERE x > ds AND x <= DATE '2000-01-03' AND isodow(x) < 6) END AS t FROM days)
SELECT ds, {_wave_sql('t', 5, 'fourier_weekly')}, {_wave_sql('t', 20, 'fourier_monthly')}, {_wave_sql('t', 60, 'fourier_quarterly')} FROM i""")
def _(s, d):
    return _days(s, d).select("ds", *[c.alias(n) for n, c in cal.fourier_features(F.col("ds")).items()])


def node_attributes(node):
    """Category, sub-category, depth and column-safe label of a node id."""
    cat = (F.when(F.startswith(node, F.lit("A")), "KORPORASI").when(F.startswith(node, F.lit("B")), "INDIVIDU")
           .when(F.startswith(node, F.lit("C")), "NON RESIDEN").otherwise("LAINNYA"))
    sub = F.when(F.startswith(node, F.lit("A.1")), "PTMN").when(F.startswith(node, F.lit("A.2")), "Korporasi Lainnya").otherwise("-")
    depth = F.length(node) - F.length(F.replace(node, F.lit("."), F.lit("")))
    return {"category": cat, "sub_category": sub, "depth": depth, "clean": F.replace(node, F.lit("."), F.lit("_")), "last_part": F.element_at(F.split(node, r"\."), -1)}


@query("p17_node_attributes", "node:s category:s sub_category:s depth:i clean:s last_part:s days:i", f"""WITH {qe.PANEL_FULL} SELECT node,
CASE WHEN node LIKE 'A%' THEN 'KORPORASI' WHEN node LIKE 'B%' THEN 'INDIVIDU' WHEN node LIKE 'C%' THEN 'NON RESIDEN' ELSE 'LAINNYA' END AS category,
CASE WHEN node LIKE 'A.1%' THEN 'PTMN' WHEN node LIKE 'A.2%' THEN 'Korporasi Lainnya' ELSE '-' END AS sub_category,
length(node) - length(replace(node, '.', '')) AS depth, replace(node, '.', '_') AS clean, list_extract(string_split(node, '.'), -1) AS last_part, count(*) AS days FROM panel GROUP BY 1""")
def _(s, d):
    g = qe.panel_full(s, d).groupBy("node").agg(F.count(F.lit(1)).alias("days"))
    return g.select("node", "days", *[c.alias(n) for n, c in node_attributes(F.col("node")).items()])


def parse_children(text):
    """JSON list of node ids, empty where the text is no list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


@query("p18_parse_children", "region:s n_children:i children:s", """SELECT r_name AS region, CASE WHEN r_regionkey = 3 THEN 0 ELSE count(n_name) END AS n_children,
CASE WHEN r_regionkey = 3 THEN '' ELSE string_agg(n_name, ',' ORDER BY n_name) END AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey""")
def _(s, d):
    n = b.table(s, d, "region").join(b.table(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    g = n.groupBy("r_name", "r_regionkey").agg(F.to_json(F.sort_array(F.collect_list("n_name"))).alias("j"))      # nations of one region
    kids = parse_children(F.when(F.col("r_regionkey") == 3, F.lit("[broken")).otherwise(F.col("j")))
    return g.select(F.col("r_name").alias("region"), F.size(kids).alias("n_children"), F.concat_ws(",", kids).alias("children"))
