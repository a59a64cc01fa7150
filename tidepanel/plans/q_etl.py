"""Sources, coded flows, categories and node trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import etl, nodes
from tidepanel.plans import base as b
from tidepanel.plans.registry import query, values_sql
from tidepanel.session import scratch_path
from tidepanel.sources import files

TREE_FULL, TREE_SIMPLE = nodes.tree_full(), nodes.tree_simple()


def _term_rows(tree):
    return [(n, e, c, s) for n, ts in tree.items() for e, c, s in ts]


def _tree_sql(tree, name="panel"):
    return f"""{b.TIDY}, terms(node, entity, category, w) AS ({values_sql(_term_rows(tree))}),
{name} AS (SELECT d.ds, n.node, coalesce(sum(n.w * t.value), 0) AS value
  FROM (SELECT DISTINCT ds FROM tidy WHERE entity = 'KORPORASI') d CROSS JOIN terms n
  LEFT JOIN tidy t ON t.ds = d.ds AND t.entity = n.entity AND t.category = n.category GROUP BY 1, 2)"""


PANEL_SIMPLE, PANEL_FULL = _tree_sql(TREE_SIMPLE), _tree_sql(TREE_FULL)


def ledger(s, d):
    return etl.ledger(b.flows(s, d))


def cats(s, d):
    return etl.category_rollup(ledger(s, d))


def tidy(s, d):
    return etl.tidy(cats(s, d))


def panel_simple(s, d):
    return etl.node_panel(tidy(s, d), TREE_SIMPLE)


def panel_full(s, d):
    return etl.node_panel(tidy(s, d), TREE_FULL)


def leaf_panel(s, d):
    return panel_simple(s, d).filter(F.col("node").isin(nodes.leaf_nodes(TREE_SIMPLE)))


_LEAVES = "'" + "','".join(nodes.leaf_nodes(TREE_SIMPLE)) + "'"
_FEED_SQL = f"WITH {b.FLOWS} SELECT ds, purpose, sum(volume) AS volume FROM flows GROUP BY 1, 2"


def _feed(s, d):
    return b.flows(s, d).groupBy("ds", "purpose").agg(F.sum("volume").alias("volume"))


@query("s1_read_flows_json", "ds:d purpose:s volume:2", _FEED_SQL)
def _(s, d):
    path = scratch_path(s, "feed-json")
    files.write_feed(_feed(s, d), path, "json")
    return files.read_flows_json(s, path)


@query("s2_read_flows_xml", "ds:d purpose:s volume:2", _FEED_SQL)
def _(s, d):
    path = scratch_path(s, "feed-xml")
    files.write_feed(_feed(s, d), path, "xml")
    return files.read_flows_xml(s, path)


@query("s3_read_entity_ledgers", "entity:s ds:d col:s volume:0", f"""WITH {b.LEDGER}
SELECT entity, ds, 'x' || col AS col, volume FROM ledger WHERE volume <> 0
UNION ALL SELECT entity, ds, 'x43', sum(volume) FROM ledger GROUP BY 1, 2 HAVING sum(volume) <> 0""")
def _(s, d):
    led = ledger(s, d)
    used = sorted(nodes.CODE_TO_COLUMN.values())
    wide = led.groupBy("entity", "ds").pivot("col", used).agg(F.sum("volume"))
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in used[1:]), F.coalesce(F.col(f"`{used[0]}`"), F.lit(0.0)))
    cols = {1: F.col("ds"), **{c: F.col(f"`{c}`") for c in used}, nodes.TOTAL_COLUMN: total}
    sheet = wide.select("entity", *[cols.get(i, F.lit(None).cast("double")).alias(f"h{i}") for i in range(1, 48)])
    root = scratch_path(s, "ledgers")
    sheet.write.partitionBy("entity").csv(root, header=True)
    rows = files.read_entity_ledgers(s, {e: f"{root}/entity={e}" for e in nodes.ENTITIES})
    return etl.melt(rows.withColumnRenamed("x1", "ds"), ["entity", "ds"], [f"x{i}" for i in range(2, 48)], "col", "volume").filter("volume <> 0")


@query("s4_extract_block", "o_orderkey:i ds:d bad_date:i o_totalprice:2", """
SELECT o_orderkey, TRY_CAST(raw_date AS DATE) AS ds, CAST(raw_date IS NOT NULL AND TRY_CAST(raw_date AS DATE) IS NULL AS INT) AS bad_date, o_totalprice
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw_date,
             CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)
WHERE o_orderkey >= 5 AND NOT (raw_date IS NULL AND o_totalprice IS NULL)""")
def _(s, d):
    k = F.col("o_orderkey")
    sheet = b.table(s, d, "orders").select(
        "o_orderkey", F.when(k % 89 == 0, F.lit(None)).when(k % 97 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("raw_date"),
        F.when(k % 89 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return files.extract_block(sheet, "o_orderkey", 5, "raw_date", ["o_totalprice"])


@query("s5_read_panel", "node:s ds:d value:0", f"WITH {PANEL_SIMPLE} SELECT node, ds, value FROM panel")
def _(s, d):
    path = scratch_path(s, "panel-wide")
    files.write_panel_wide(panel_simple(s, d), path)
    return files.read_panel(s, path)


_YEARS = [str(y) for y in range(1995, 2002)]


@query("s6_write_panel_wide", "node:s " + " ".join(f"{y}:0" for y in _YEARS), f"""WITH {PANEL_SIMPLE}
SELECT node, {', '.join(f'sum(value) FILTER (year(ds) = {y}) AS "{y}"' for y in _YEARS)} FROM panel GROUP BY node""")
def _(s, d):
    yearly = panel_simple(s, d).groupBy("node", F.year("ds").cast("string").alias("y")).agg(F.sum("value").alias("value"))
    path = scratch_path(s, "panel-year")
    files.panel_wide(yearly, _YEARS, "y").write.parquet(path)
    return s.read.parquet(path)


# --- projection over coded flows ------------------------------------------------------------------

@query("p1_extract_code", "code:i n:i volume:0", f"""WITH {b.FLOWS}
SELECT CAST(regexp_extract(purpose, '^([0-9]+)', 1) AS INT) AS code, count(*) AS n, sum(volume) AS volume FROM flows GROUP BY 1""")
def _(s, d):
    return b.flows(s, d).groupBy(etl.extract_code(F.col("purpose")).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("p2_sign_split", "ds:d entity:s negative:0 positive:0", f"""WITH {b.LEDGER}
SELECT ds, entity, sum(least(volume, 0)) AS negative, sum(greatest(volume, 0)) AS positive FROM ledger WHERE neg_cat <> pos_cat GROUP BY 1, 2""")
def _(s, d):
    neg, pos = etl.sign_split(F.col("volume"))
    return ledger(s, d).filter("neg_cat <> pos_cat").groupBy("ds", "entity").agg(neg.alias("negative"), pos.alias("positive"))


@query("p3_category_rollup", "ds:d entity:s category:s volume:0", f"WITH {b.CATS} SELECT * FROM cats")
def _(s, d):
    return cats(s, d)


@query("p4_verification_diffs", "ds:d entity:s total_less_parts:0 categories_less_total:0", f"""WITH {b.CATS},
t AS (SELECT ds, entity, sum(volume) AS total FROM flows WHERE code IN (SELECT code FROM codes) GROUP BY 1, 2),
l AS (SELECT ds, entity, sum(volume) AS parts FROM ledger GROUP BY 1, 2), c AS (SELECT ds, entity, sum(volume) AS cat FROM cats GROUP BY 1, 2)
SELECT ds, entity, total - parts AS total_less_parts, cat - total AS categories_less_total FROM t JOIN l USING (ds, entity) JOIN c USING (ds, entity)""")
def _(s, d):
    led = ledger(s, d)
    by_col = led.groupBy("ds", "entity").agg(
        F.sum("volume").alias("total"),
        F.sum(F.when(F.col("neg_cat") == F.col("pos_cat"), F.col("volume")).otherwise(0.0)).alias("plain"),
        *[x.alias(n) for x, n in zip(etl.sign_split(F.when(F.col("neg_cat") != F.col("pos_cat"), F.col("volume")).otherwise(0.0)), ("neg", "pos"))])
    return by_col.select("ds", "entity", (F.col("total") - (F.col("plain") + F.col("neg") + F.col("pos"))).alias("total_less_parts"),
                         (F.col("neg") + F.col("pos") + F.col("plain") - F.col("total")).alias("categories_less_total"))


@query("p5_scale_thousands", "ds:d entity:s category:s value:0", f"WITH {b.TIDY} SELECT * FROM tidy")
def _(s, d):
    return tidy(s, d)


@query("p6_start_date_filter", "entity:s n:i first_ds:d explicit_n:i", f"""WITH {b.TIDY}
SELECT entity, count(*) AS n, min(ds) AS first_ds, count(*) FILTER (ds >= DATE '1996-03-01') AS explicit_n
FROM tidy WHERE ds >= (SELECT min(ds) FROM tidy) GROUP BY 1""")
def _(s, d):
    t = tidy(s, d)
    auto = etl.start_date_filter(t).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("ds").alias("first_ds"))
    return auto.join(etl.start_date_filter(t, "1996-03-01").groupBy("entity").agg(F.count(F.lit(1)).alias("explicit_n")), "entity")


# --- joins and reshapes of flows ------------------------------------------------------------------

@query("j1_map_codes", "col:i n:i volume:0", f"WITH {b.FLOWS}, {b.CODES} SELECT col, count(*) AS n, sum(volume) AS volume FROM flows JOIN codes USING (code) GROUP BY 1")
def _(s, d):
    return etl.map_codes(b.flows(s, d).select("code", "volume"), etl.code_dimension(s)).groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("j2_pair_entities", "ds:d KORPORASI:0 PTMN:0 ASING:0 INDIVIDU:0", f"""WITH {b.TIDY}
SELECT ds, {', '.join(f"coalesce(sum(value) FILTER (entity = '{e}'), 0) AS {e}" for e in nodes.ENTITIES)} FROM tidy GROUP BY ds""")
def _(s, d):
    return tidy(s, d).groupBy("ds").agg(*[F.coalesce(F.sum(F.when(F.col("entity") == e, F.col("value"))), F.lit(0.0)).alias(e) for e in nodes.ENTITIES])


_CODES_ALL = sorted(nodes.CODE_TO_COLUMN)


@query("r1_pivot_codes", "ds:d " + " ".join(f"{c}:0" for c in _CODES_ALL), f"""WITH {b.FLOWS}
SELECT ds, {', '.join(f'coalesce(sum(volume) FILTER (code = {c}), 0) AS "{c}"' for c in _CODES_ALL)} FROM flows GROUP BY ds""")
def _(s, d):
    return etl.pivot_codes(b.flows(s, d), "ds", _CODES_ALL)


@query("r2_melt_categories", "ds:d entity:s category:s value:0", f"""WITH {b.TIDY}, days AS (SELECT DISTINCT ds, entity FROM tidy),
c AS (SELECT unnest(['{"','".join(nodes.CATEGORIES)}']) AS category)
SELECT ds, entity, category, coalesce(value, 0) AS value FROM days CROSS JOIN c LEFT JOIN tidy USING (ds, entity, category)""")
def _(s, d):
    wide = tidy(s, d).groupBy("ds", "entity").pivot("category", list(nodes.CATEGORIES)).agg(F.sum("value")).fillna(0.0)
    return etl.melt(wide, ["ds", "entity"], list(nodes.CATEGORIES), "category", "value")


# --- node trees -----------------------------------------------------------------------------------

@query("a1_sum_by_date_code", "ds:d code:i volume:0 n_rows:i duplicated:i", f"""WITH {b.FLOWS}
SELECT ds, code, sum(volume) AS volume, count(*) AS n_rows, CAST(count(*) > 1 AS INT) AS duplicated FROM flows GROUP BY 1, 2""")
def _(s, d):
    return b.flows(s, d).groupBy("ds", "code").agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) > 1).cast("int").alias("duplicated"))


@query("a2_hierarchy_full", "ds:d node:s value:0", f"WITH {PANEL_FULL} SELECT ds, node, value FROM panel")
def _(s, d):
    return panel_full(s, d)


@query("a3_hierarchy_simple", "ds:d node:s value:0", f"WITH {PANEL_SIMPLE} SELECT ds, node, value FROM panel")
def _(s, d):
    return panel_simple(s, d)


_BRIDGE_SIMPLE = nodes.rollup_bridge(TREE_SIMPLE)


@query("a4_rollup_tree", "ds:d node:s value:0", f"WITH {PANEL_SIMPLE} SELECT ds, node, value FROM panel")
def _(s, d):
    return etl.rollup_tree(leaf_panel(s, d), _BRIDGE_SIMPLE)


@query("a4_rollup_levels", "region:s nation:s volume:0 n:i", """
SELECT r_name AS region, n_name AS nation, sum(round_even(o_totalprice, 0)) AS volume, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)""")
def _(s, d):
    by_cust = b.table(s, d, "orders").groupBy("o_custkey").agg(F.sum(F.rint("o_totalprice")).alias("v"), F.count(F.lit(1)).alias("k"))
    c = b.table(s, d, "customer").select("c_custkey", "c_nationkey")
    nat = b.table(s, d, "nation").join(b.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (by_cust.join(c, F.col("o_custkey") == F.col("c_custkey")).join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
            .rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("v").alias("volume"), F.sum("k").alias("n")))


# Semantic pairing of the corporate block with the sub-entity block of the detailed tree.
_SUB = {t[0][1]: n for n, t in TREE_FULL.items() if n.startswith("A.1.") and len(t) == 1}
_CORP = {t[0][1]: n for n, t in TREE_FULL.items() if n.startswith("A.0.") and len(t) == 1}
_DIFF = {n: (_CORP[t[0][1]], _SUB[t[0][1]]) for n, t in TREE_FULL.items() if n.startswith("A.2.") and len(t) == 2}


_WANT = values_sql([(n, x, sign) for n, pair in _DIFF.items() for x, sign in zip(pair, (1, -1))])


@query("a5_difference_nodes", "ds:d node:s value:0", f"""WITH {PANEL_FULL}, want(diff, leaf, sign) AS MATERIALIZED ({_WANT})
SELECT ds, diff AS node, sum(sign * value) AS value FROM panel JOIN want ON node = leaf GROUP BY ds, diff HAVING count(DISTINCT leaf) = 2""")
def _(s, d):
    return etl.difference_nodes(panel_full(s, d), _DIFF)


_EDGES = nodes.tree_edges(TREE_SIMPLE)
_EDGE_SUM_SQL = f"""edges(parent, child) AS ({values_sql(_EDGES)})"""


@query("a6_explicit_rollup_order", "ds:d node:s value:0", f"""WITH {PANEL_SIMPLE}, {_EDGE_SUM_SQL}
SELECT ds, parent AS node, sum(value) AS value FROM edges JOIN panel ON node = child GROUP BY 1, 2""")
def _(s, d):
    kids = {}
    for p, c in _EDGES:
        kids.setdefault(p, []).append(c)
    wide = etl.node_columns(leaf_panel(s, d), nodes.leaf_nodes(TREE_SIMPLE))
    for p in sorted(kids, key=lambda n: (n == "D", -nodes.node_level(n))):
        wide = wide.withColumn(p, sum((F.col(f"`{c}`") for c in kids[p]), F.lit(0.0)))
    return etl.melt(wide.select("ds", *[F.col(f"`{p}`") for p in kids]), ["ds"], [f"`{p}`" for p in kids], "node", "value")


_KEEP_LEAVES = [n for n in nodes.leaf_nodes(TREE_SIMPLE)]


@query("a7_merge_leaves", "ds:d node:s value:0", f"""WITH {PANEL_SIMPLE}, m(src, dst) AS ({values_sql(nodes.MERGE_PAIRS.items())})
SELECT ds, coalesce(dst, node) AS node, sum(value) AS value FROM panel LEFT JOIN m ON src = node WHERE node IN ({_LEAVES}) GROUP BY 1, 2""")
def _(s, d):
    return etl.merge_leaves(leaf_panel(s, d), nodes.MERGE_PAIRS, ["A.1"])


@query("a8_additivity_check", "parent:s n_children:i max_gap:4 days:i", f"""WITH {PANEL_SIMPLE}, {_EDGE_SUM_SQL},
k AS (SELECT ds, parent, sum(value) AS s, count(*) AS nc FROM edges JOIN panel ON node = child GROUP BY 1, 2)
SELECT parent, max(nc) AS n_children, max(abs(value - s)) AS max_gap, count(*) AS days FROM k JOIN panel ON panel.node = parent AND panel.ds = k.ds GROUP BY 1""")
def _(s, d):
    return etl.additivity_check(panel_simple(s, d), _EDGES)
