"""Appends, upserts, dedup, date sets, joins in time and calendar roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.ranks import exact_quantiles
from tidepanel.operators import align, etl, tables
from tidepanel.operators.nodes import ENTITIES
from tidepanel.plans import base as b
from tidepanel.plans import q_etl as qe
from tidepanel.functions.literals import literal_table, values_sql
from tidepanel.plans.registry import query
from tidepanel.session import scratch_path
from tidepanel.sources import files

NAMES = ["A", "N", "R"]
PERIODS = [(f"p{i:02d}", f"{1995 + i // 4}-Q{i % 4 + 1}", f"{1995 + i // 4}-{3 * (i % 4) + 1:02d}-{8 + i % 5:02d}",
            f"{1995 + (i + 1) // 4}-{3 * ((i + 1) % 4) + 1:02d}-{7 + (i + 1) % 5:02d}") for i in range(28)]
PERIODS_SQL = f"""periods AS (SELECT id, period, CAST(s AS DATE) AS start_date, CAST(e AS DATE) AS end_date
  FROM ({values_sql(PERIODS)}) t(id, period, s, e))"""
_NAMES_SQL = "SELECT unnest(['A','N','R']) AS name"


def periods(s):
    return literal_table(s, PERIODS, "id string, period string, s string, e string").select(
        "id", "period", F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date"))


def _daily_total(s, d):
    return b.signed_orders(s, d).groupBy("ds").agg(F.sum("v").alias("value"))


_TOTAL = f"{b.SERIES}, total AS (SELECT ds, sum(v) AS value FROM orders_signed GROUP BY ds)"

# --- sources over derived files ---------------------------------------------------------------------


@query("s11_read_two_column_series", "ds:d value:0", f"WITH {_TOTAL} SELECT ds, value FROM total WHERE day(ds) <> 13")
def _(s, d):
    t = _daily_total(s, d)
    rows = t.select("ds", F.explode(F.when(F.dayofmonth("ds") % 3 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("old"), "value")
    text = rows.select(F.when(F.dayofmonth("ds") == 13, F.lit("n/a")).otherwise(F.date_format("ds", "yyyy-MM-dd")).alias("date"), "old", "ds",
                       F.format_number(F.col("value") + F.col("old"), 0).alias("close"))
    path = scratch_path(s, "two-column")
    text.orderBy("ds", F.col("old").desc()).coalesce(1).select("date", "close").write.csv(path, header=True)    # one row per day
    return files.read_two_column_series(s, path)


@query("s12_read_calendar", "ds:d name:s kind:s", f"WITH {_TOTAL} SELECT ds, 'holiday ' || strftime(ds, '%m-%d') AS name, CASE WHEN isodow(ds) > 5 THEN 'weekend' ELSE 'fixed' END AS kind FROM total WHERE strftime(ds, '%m-%d') IN ('01-01', '08-17', '12-25')")
def _(s, d):
    h = _daily_total(s, d).filter(F.date_format("ds", "MM-dd").isin("01-01", "08-17", "12-25"))
    item = F.struct(F.date_format("ds", "yyyy-MM-dd").alias("tanggal"), F.concat(F.lit("holiday "), F.date_format("ds", "MM-dd")).alias("nama"),
                    F.when(F.weekday("ds") > 4, "weekend").otherwise("fixed").alias("kategori"))
    path = scratch_path(s, "calendar")
    h.agg(F.to_json(F.collect_list(item)).alias("value")).write.text(path)      # three days a year
    return files.read_calendar(s, path)


@query("s12_read_periods", "id:s period:s start_date:d end_date:d", """SELECT 'q' || strftime(date_trunc('quarter', o_orderdate), '%Y%m') AS id, CAST(year(o_orderdate) AS VARCHAR) AS period,
min(CAST(o_orderdate AS DATE)) AS start_date, max(CAST(o_orderdate AS DATE)) AS end_date FROM orders GROUP BY 1, 2""")
def _(s, d):
    q = b.signed_orders(s, d).groupBy(F.date_trunc("quarter", "ds").alias("q")).agg(F.min("ds").alias("a"), F.max("ds").alias("z"))
    item = F.struct(F.concat(F.lit("q"), F.date_format("q", "yyyyMM")).alias("id"), F.date_format("q", "yyyy").alias("period"),
                    F.date_format("a", "yyyy-MM-dd").alias("start_date"), F.date_format("z", "yyyy-MM-dd").alias("end_date"), F.date_format("z", "yyyy-MM-dd").alias("rdg_date"))
    path = scratch_path(s, "periods")
    q.agg(F.to_json(F.struct(F.collect_list(item).alias("schedule"))).alias("value")).write.text(path)      # four a year
    return files.read_periods(s, path)


_SPLIT_SQL = f"""{_TOTAL}, old AS (SELECT ds, value, 'old' AS origin FROM total WHERE ds < DATE '2001-01-01'),
new AS (SELECT ds, value + 1 AS value, 'new' AS origin FROM total WHERE ds >= DATE '2000-12-15')"""


def _split(s, d):
    t = _daily_total(s, d)
    return (t.filter("ds < date'2001-01-01'").withColumn("origin", F.lit("old")),
            t.filter("ds >= date'2000-12-15'").select("ds", (F.col("value") + 1).alias("value"), F.lit("new").alias("origin")))


def _stored(df, s, name):
    path = scratch_path(s, name)
    df.withColumn("year", F.year("ds")).write.partitionBy("year").parquet(path)
    return s.read.parquet(path)


@query("s13_append_new_days", "ds:d value:0 origin:s", f"WITH {_SPLIT_SQL} SELECT * FROM old UNION ALL SELECT * FROM new WHERE ds > (SELECT max(ds) FROM old)")
def _(s, d):
    old, new = _split(s, d)
    return _stored(tables.append_new_days(old, new), s, "append")


@query("s13_append_new_days_force", "ds:d value:0 origin:s", f"WITH {_SPLIT_SQL} SELECT * FROM old WHERE ds NOT IN (SELECT ds FROM new) UNION ALL SELECT * FROM new")
def _(s, d):
    old, new = _split(s, d)
    return _stored(tables.append_new_days(old, new, force=True), s, "append-force")


@query("s13_append_gap", "last_ds:d first_new:d last_new:d gap_days:i", f"""WITH {_TOTAL}
SELECT max(ds) FILTER (ds < DATE '2000-12-01') AS last_ds, min(ds) FILTER (ds >= DATE '2000-12-15') AS first_new, max(ds) AS last_new,
greatest(date_diff('day', max(ds) FILTER (ds < DATE '2000-12-01'), min(ds) FILTER (ds >= DATE '2000-12-15')) - 1, 0) AS gap_days FROM total""")
def _(s, d):
    t = _daily_total(s, d)
    return tables.append_gap(t.filter("ds < date'2000-12-01'"), t.filter("ds >= date'2000-12-15'"))


@query("s15_write_scores", "doc_id:i lang:s quality:i toxic:i", """SELECT d.doc_id, lang, coalesce(l.quality, CASE WHEN d.doc_id % 2 = 0 THEN 0 END) AS quality, l.toxic
FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)""")
def _(s, d):
    docs = b.table(s, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, 0).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    new = b.table(s, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    return tables.write_scores(docs, new, "doc_id", ["quality", "toxic"])


@query("s16_append_stream_items", "no:i event_id:i event_type:s", """WITH old AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS no, event_id, event_type FROM events WHERE event_id % 4 = 0)
SELECT * FROM old UNION ALL SELECT (SELECT max(no) FROM old) + row_number() OVER (ORDER BY ts, event_id), event_id, event_type FROM events WHERE event_id % 4 <> 0""")
def _(s, d):
    from tidepanel.functions.ranks import global_row_number
    e = b.table(s, d, "events").select("event_id", "event_type", "ts")
    old = global_row_number(e.filter("event_id % 4 = 0"), "ts", "event_id", "no").select("no", "event_id", "event_type", "ts")
    return tables.append_stream_items(old, e, "event_id", "ts")


# --- dedup ---------------------------------------------------------------------------------------------

def _user_days(s, d):
    return b.table(s, d, "events").select("user_id", F.to_date("ts").alias("ds"), "event_id", "value", "event_type")


_UD = "ud AS (SELECT user_id, CAST(ts AS DATE) AS ds, event_id, value, event_type FROM events)"


@query("k5_dedupe_dates_first", "user_id:i ds:d event_id:i value:4", f"WITH {_UD} SELECT * FROM ud QUALIFY row_number() OVER (PARTITION BY user_id, ds ORDER BY event_id) = 1")
def _(s, d):
    return tables.dedupe(_user_days(s, d), ["user_id", "ds"], ["event_id"], "first")


@query("k5_dedupe_dates_last", "user_id:i ds:d event_id:i value:4", f"WITH {_UD} SELECT * FROM ud QUALIFY row_number() OVER (PARTITION BY user_id, ds ORDER BY event_id DESC) = 1")
def _(s, d):
    return tables.dedupe(_user_days(s, d), ["user_id", "ds"], ["event_id"], "last")


@query("k5_duplicate_rows", "user_id:i ds:d event_id:i value:4", f"WITH {_UD} SELECT * FROM ud QUALIFY count(*) OVER (PARTITION BY user_id, ds) > 1")
def _(s, d):
    return tables.duplicate_rows(_user_days(s, d), ["user_id", "ds"])


@query("k6_dedupe_results", "user_id:i event_type:s event_id:i value:4", "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(s, d):
    return tables.dedupe(b.table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "last")


@query("k7_conflicting_duplicates", "user_id:i ds:d n:i conflict:i", f"""WITH {_UD} SELECT user_id, ds, count(*) AS n,
CAST(max(value) - min(value) > 1e-9 * greatest(max(abs(value)), 1e-300) OR min(event_type) <> max(event_type) AS INT) AS conflict FROM ud GROUP BY 1, 2 HAVING count(*) > 1""")
def _(s, d):
    return tables.conflicting_duplicates(_user_days(s, d), ["user_id", "ds"], ["value"], ["event_type"])


@query("k8_drop_bad_arm", "event_type:s n:i", """SELECT event_type, count(*) AS n FROM events
WHERE NOT (event_type = 'error' AND ts >= TIMESTAMP '2024-01-10 00:00:00') GROUP BY 1""")
def _(s, d):
    e = b.table(s, d, "events")
    bad = (F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return tables.drop_arm(e, bad).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("k10_tail", "series:s ds:d y:0", f"WITH {b.SERIES} SELECT series, ds, y FROM series QUALIFY row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 90")
def _(s, d):
    return tables.tail(b.series(s, d), ["series"], 90)


# --- set operations ------------------------------------------------------------------------------------

@query("u1_union_all_shards", "shard:i n:i total:0", """SELECT shard, count(*) AS n, sum(round_even(o_totalprice, 0)) AS total FROM (
SELECT o_custkey % 4 AS shard, o_totalprice FROM orders) GROUP BY 1""")
def _(s, d):
    o = b.table(s, d, "orders")
    shards = [o.filter(F.col("o_custkey") % 4 == k).select(F.lit(k).alias("shard"), "o_totalprice") for k in range(4)]
    allrows = shards[0]
    for x in shards[1:]:
        allrows = allrows.unionByName(x)
    return allrows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.rint("o_totalprice")).alias("total"))


_ED = f"{b.FLOWS}, ed AS (SELECT DISTINCT ds, entity FROM flows)"
_ENT_SQL = "SELECT unnest(['" + "','".join(ENTITIES) + "']) AS entity"


@query("u2_date_set_comparison", "entity:s n_missing:i examples:s", f"""WITH {_ED},
m AS (SELECT ds, entity FROM (SELECT DISTINCT ds FROM ed) CROSS JOIN ({_ENT_SQL}) EXCEPT SELECT ds, entity FROM ed)
SELECT entity, count(*) AS n_missing, array_to_string(list_transform(list_sort(list(ds))[1:5], lambda x: strftime(x, '%Y-%m-%d')), ', ') AS examples FROM m GROUP BY 1""")
def _(s, d):
    return tables.date_set_comparison(b.flows(s, d), list(ENTITIES))


@query("u3_missing_calendar_days", "entity:s ds:d", f"""WITH {_ED}, r AS (SELECT entity, min(ds) AS lo, max(ds) AS hi FROM ed GROUP BY 1)
SELECT entity, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM r EXCEPT SELECT entity, ds FROM ed""")
def _(s, d):
    return tables.missing_calendar_days(b.flows(s, d), ["entity"])


@query("u4_missing_until_asof", "entity:s ds:d", f"""WITH {_ED}, r AS (SELECT entity, max(ds) AS hi FROM ed GROUP BY 1)
SELECT entity, CAST(unnest(generate_series(hi + INTERVAL 1 DAY, DATE '2001-09-14', INTERVAL 1 DAY)) AS DATE) AS ds FROM r""")
def _(s, d):
    return tables.missing_until(b.flows(s, d), ["entity"], "2001-09-15")


# --- joins in time ----------------------------------------------------------------------------------------

_GRID = f"""{b.SERIES}, {b.EXTERNAL}, days AS (SELECT DISTINCT ds FROM series), names AS ({_NAMES_SQL}),
grid AS (SELECT name, ds, value FROM days CROSS JOIN names LEFT JOIN external USING (name, ds))"""


def _fill_sql(grid):
    return f"""SELECT name, ds, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY name ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(value IGNORE NULLS) OVER (PARTITION BY name ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM {grid}"""


def _days(s, d):
    return b.signed_orders(s, d).select("ds").distinct()


@query("j3_merge_external_left", "name:s ds:d value:3", f"WITH {_GRID} {_fill_sql('grid')}")
def _(s, d):
    return align.merge_external(_days(s, d), b.external(s, d), NAMES, "left")


@query("j3_merge_external_inner", "name:s ds:d value:3", f"WITH {_GRID}, g2 AS (SELECT * FROM grid WHERE ds IN (SELECT ds FROM external)) {_fill_sql('g2')}")
def _(s, d):
    return align.merge_external(_days(s, d), b.external(s, d), NAMES, "inner")


@query("j3_merge_external_outer", "name:s ds:d value:3", f"""WITH {_GRID}, d2 AS (SELECT ds FROM days UNION SELECT ds FROM external),
g3 AS (SELECT name, ds, value FROM d2 CROSS JOIN names LEFT JOIN external USING (name, ds)) {_fill_sql('g3')}""")
def _(s, d):
    return align.merge_external(_days(s, d), b.external(s, d), NAMES, "outer")


@query("j4_align_asof", "name:s ds:d value:3", f"""WITH {_GRID}, t AS (SELECT ds, name FROM days CROSS JOIN names),
a AS (SELECT t.name, t.ds, e.value FROM t ASOF LEFT JOIN external e ON t.name = e.name AND t.ds >= e.ds)
SELECT name, ds, coalesce(value, first_value(value IGNORE NULLS) OVER (PARTITION BY name ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM a""")
def _(s, d):
    return align.align_asof(b.external(s, d), _days(s, d), NAMES)


@query("j5_align_by_date", "name:s ds:d value:3", f"WITH {_GRID} SELECT * FROM grid")
def _(s, d):
    return align.on_dates(b.external(s, d), _days(s, d), NAMES)


@query("j6_roll_to_next_business_day", "ds:d n:i", f"""WITH cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds FROM orders WHERE isodow(o_orderdate) < 6),
r AS (SELECT c.ds FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem) l ASOF JOIN cal c ON l.d <= c.ds) SELECT ds, count(*) AS n FROM r GROUP BY 1""")
def _(s, d):
    cal = _days(s, d).filter(F.weekday("ds") < 5)
    ship = b.table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("ds")).agg(F.count(F.lit(1)).alias("k"))
    return align.roll_to_next_business_day(ship, cal, "ds").groupBy("ds").agg(F.sum("k").alias("n"))


@query("j7_period_join", "ds:d node:s id:s value:0", f"WITH {qe.PANEL_SIMPLE}, {PERIODS_SQL} SELECT ds, node, id, value FROM panel JOIN periods ON ds BETWEEN start_date AND end_date")
def _(s, d):
    return align.period_join(qe.panel_simple(s, d), periods(s))


@query("j8_inner_join_external_panel", "ds:d node:s name:s value:0 ext:3", f"""WITH {qe.PANEL_SIMPLE}, {b.EXTERNAL}
SELECT p.ds, node, name, p.value, e.value AS ext FROM panel p JOIN external e ON p.ds = e.ds""")
def _(s, d):
    return qe.panel_simple(s, d).join(b.external(s, d).withColumnRenamed("value", "ext"), "ds")


@query("j9_merge_sources_override", "ds:d A:3 N:3 total:0", f"""WITH {_TOTAL}, {b.EXTERNAL}, w AS (SELECT ds, max(value) FILTER (name='A') AS A, max(value) FILTER (name='N') AS N FROM external GROUP BY 1)
SELECT w.ds, w.A, t.value AS N, t.value AS total FROM w LEFT JOIN total t USING (ds)""")
def _(s, d):
    w = b.external(s, d).groupBy("ds").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("A", "N")])
    return align.merge_override(w, _daily_total(s, d).select("ds", F.col("value").alias("N"), F.col("value").alias("total")), "ds")


@query("j10_combine_sources", "name:s ds:d value:3", f"""WITH {b.SERIES}, {b.EXTERNAL}
SELECT name, ds, value FROM external WHERE name <> 'R' UNION ALL SELECT series, ds, y FROM series WHERE series <> '1-URGENT'
UNION ALL SELECT 'R', ds, y FROM series WHERE series = '1-URGENT'""")
def _(s, d):
    x = b.series(s, d).select(F.when(F.col("series") == "1-URGENT", "R").otherwise(F.col("series")).alias("name"), "ds", F.col("y").alias("value"))
    return align.combine_sources(b.external(s, d), x)


_LAGS = [0, 1, 2, 5, 20]


@query("j11_self_join_lags", "series:s ds:d y:0 k:i y_lag:0", f"""WITH {b.INDEXED}, k AS (SELECT unnest({_LAGS}) AS k)
SELECT a.series, a.ds, a.y, k, b.y AS y_lag FROM idx a CROSS JOIN k JOIN idx b ON b.series = a.series AND b.i = a.i - k""")
def _(s, d):
    return align.lag_pairs(b.series(s, d), _LAGS)


@query("j13_semi_anti_joins", "kind:s c_mktsegment:s n:i", """SELECT 'semi' AS kind, c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY 2
UNION ALL SELECT 'anti', c_mktsegment, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY 2""")
def _(s, d):
    c = b.table(s, d, "customer").select("c_custkey", "c_mktsegment")
    big = b.table(s, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    part = lambda how, k: c.join(big, "c_custkey", how).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k))
    return part("left_semi", "semi").unionByName(part("left_anti", "anti"))


@query("w28_backfill_share", "name:s n:i n_leading:i share_pct:6 flagged:i", f"""WITH {_GRID}, g AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ds) AS i FROM (SELECT name, ds, CASE WHEN ds >= DATE '1995-09-01' OR name <> 'R' THEN value END AS value FROM grid)),
a AS (SELECT name, count(*) AS n, coalesce(min(i) FILTER (value IS NOT NULL) - 1, count(*)) AS n_leading FROM g GROUP BY 1)
SELECT *, 100.0 * n_leading / n AS share_pct, CAST(100.0 * n_leading / n > 10 AS INT) AS flagged FROM a""")
def _(s, d):
    g = align.on_dates(b.external(s, d), _days(s, d), NAMES)
    return align.forward_gap(g.withColumn("value", F.when((F.col("ds") >= F.lit("1995-09-01").cast("date")) | (F.col("name") != "R"), F.col("value"))))


# --- calendar roll-ups and profiles -----------------------------------------------------------------------

@query("a14_weekly_sum", "node:s week:d value:0", f"WITH {qe.PANEL_SIMPLE} SELECT node, CAST(date_trunc('week', ds) AS DATE) AS week, sum(value) AS value FROM panel GROUP BY 1, 2")
def _(s, d):
    return qe.panel_simple(s, d).groupBy("node", F.trunc("ds", "week").alias("week")).agg(F.sum("value").alias("value"))


@query("a15_monthly_sum", "node:s month:d value:0", f"WITH {qe.PANEL_SIMPLE} SELECT node, CAST(date_trunc('month', ds) AS DATE) AS month, sum(value) AS value FROM panel GROUP BY 1, 2")
def _(s, d):
    return qe.panel_simple(s, d).groupBy("node", F.trunc("ds", "month").alias("month")).agg(F.sum("value").alias("value"))


@query("a16_period_sum", "node:s id:s period:s days:i value:0", f"""WITH {qe.PANEL_SIMPLE}, {PERIODS_SQL}
SELECT node, id, period, count(*) AS days, sum(value) AS value FROM panel JOIN periods ON ds BETWEEN start_date AND end_date GROUP BY 1, 2, 3""")
def _(s, d):
    return align.period_join(qe.panel_simple(s, d), periods(s)).groupBy("node", "id", "period").agg(F.count(F.lit(1)).alias("days"), F.sum("value").alias("value"))


@query("a17_sheet_quality_summary", "entity:s n_rows:i duplicate_dates:i first_ds:d last_ds:d uniform:i", f"""WITH {b.FLOWS},
g AS (SELECT entity, count(*) AS n_rows, count(*) - count(DISTINCT ds) AS duplicate_dates, min(ds) AS first_ds, max(ds) AS last_ds FROM flows GROUP BY 1)
SELECT *, CAST((SELECT count(DISTINCT n_rows) FROM g) = 1 AS INT) AS uniform FROM g""")
def _(s, d):
    per_day = b.flows(s, d).groupBy("entity", "ds").agg(F.count(F.lit(1)).alias("k"))
    g = per_day.groupBy("entity").agg(F.sum("k").alias("n_rows"), (F.sum("k") - F.count(F.lit(1))).alias("duplicate_dates"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))
    u = g.agg((F.min("n_rows") == F.max("n_rows")).cast("int").alias("uniform"))
    return g.join(F.broadcast(u))


_PROF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a18_column_profile", "column:s n:i mean:4 median:4 std:4 min:4 max:4 range:4", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, max({c}) - min({c}) AS range FROM lineitem""" for c in _PROF))
def _(s, d):
    long = etl.melt(b.table(s, d, "lineitem").select(*_PROF), [], _PROF, "column", "v")
    g = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return g.join(exact_quantiles(long, ["column"], "v", {"median": 0.5}), "column").withColumn("range", F.col("max") - F.col("min"))


@query("a19_extremes_with_dates", "series:s min_y:0 min_ds:d max_y:0 max_ds:d", f"""WITH {b.SERIES} SELECT series, min(y) AS min_y, max(y) AS max_y,
(SELECT min(ds) FROM series b WHERE b.series = a.series AND b.y = min(a.y)) AS min_ds, (SELECT min(ds) FROM series b WHERE b.series = a.series AND b.y = max(a.y)) AS max_ds FROM series a GROUP BY series""")
def _(s, d):
    first = F.struct(F.col("y"), (-F.unix_date("ds")).alias("t"))
    return b.series(s, d).groupBy("series").agg(F.min("y").alias("min_y"), F.min_by("ds", F.struct("y", "ds")).alias("min_ds"),
                                                F.max("y").alias("max_y"), F.max_by("ds", first).alias("max_ds"))
