"""Coded transactions -> category flows -> additive node panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.literals import literal_table
from tidepanel.operators.nodes import CATEGORIES, ENTITIES, code_groups


def extract_code(purpose: Column) -> Column:
    """Leading digits of a purpose text as integer; NULL where there are none."""
    return F.nullif(
        F.regexp_extract(purpose, r"^(\d+)", 1), F.lit("")).cast("int")


def code_dimension(spark) -> DataFrame:
    return literal_table(spark, code_groups(), "code int, col int, neg_cat string, pos_cat string")


def map_codes(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Equi join on the fixed 40-row code dictionary; unknown codes drop out."""
    return df.join(F.broadcast(dim), "code")


def sum_by(df: DataFrame, keys: list[str], value: str = "volume") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def ledger(flow_df: DataFrame) -> DataFrame:
    """(ds, entity, col, neg_cat, pos_cat, volume): duplicate codes of a day are summed first."""
    daily = sum_by(flow_df, ["ds", "entity", "code"])
    return map_codes(daily, code_dimension(flow_df.sparkSession)).drop("code")


def sign_split(value: Column) -> tuple[Column, Column]:
    """Sum of the negative parts and of the positive parts."""
    return F.sum(F.least(value, F.lit(0.0))), F.sum(F.greatest(value, F.lit(0.0)))


def category_rollup(ledger_df: DataFrame) -> DataFrame:
    cat = F.when(F.col("volume") < 0, F.col("neg_cat")).otherwise(F.col("pos_cat"))
    return ledger_df.groupBy("ds", "entity", cat.alias("category")).agg(F.sum("volume").alias("volume"))


def scale_thousands(value: Column) -> Column:
    return F.rint(value / 1000)


def tidy(cat_df: DataFrame) -> DataFrame:
    return cat_df.select("ds", "entity", "category", scale_thousands(F.col("volume")).alias("value"))


def start_date_filter(df: DataFrame, start: str | None = None) -> DataFrame:
    """Rows from an explicit start date on, or from the earliest date of any entity."""
    if start is not None:
        return df.filter(F.col("ds") >= F.lit(start).cast("date"))
    first = df.agg(F.min("ds").alias("start"))          # one row
    return df.join(F.broadcast(first), F.col("ds") >= F.col("start")).drop("start")


def entity_category_wide(tidy_df: DataFrame) -> DataFrame:
    """One row per day with a column per (entity, category); absent cells are 0.

    The 40 conditional sums combine map-side, so a day is shuffled once per input partition."""
    cells = [F.expr(f"coalesce(sum(value) FILTER (WHERE entity = '{e}' AND category = '{c}'), 0D) AS `{e}|{c}`") for e in ENTITIES for c in CATEGORIES]
    return tidy_df.groupBy("ds").agg(F.expr("max(CAST(entity = 'KORPORASI' AS INT)) AS has_corp"), *cells)


def node_panel(tidy_df: DataFrame, tree: dict) -> DataFrame:
    """(ds, node, value) of a signed node tree, for every day the corporate ledger reports."""
    wide = entity_category_wide(tidy_df).filter("has_corp = 1")

    def value(terms):
        net: dict[str, int] = {}
        for e, c, s in terms:
            net[f"{e}|{c}"] = net.get(f"{e}|{c}", 0) + s
        return " + ".join(["0D"] + [f"{w}D * `{k}`" for k, w in net.items() if w])

    rows = ", ".join(f"'{n}', {value(t)}" for n, t in tree.items())
    return wide.selectExpr("ds", f"stack({len(tree)}, {rows}) AS (node, value)")


def pivot_codes(df: DataFrame, key: str, codes: list[int], value: str = "volume") -> DataFrame:
    """Long to wide over an explicit code list; duplicates are summed, gaps become 0."""
    return df.groupBy(key).pivot("code", codes).agg(F.sum(value)).fillna(0)


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def rollup_tree(leaf_df: DataFrame, bridge: list[tuple[str, str, int]], keys=("ds",), values=("value",)) -> DataFrame:
    """Bottom-up recalculation: each leaf adds its value(s) to every ancestor of the fixed bridge."""
    sums = [F.sum(v).alias(v) for v in values]
    ups: dict[str, list[str]] = {}
    for leaf, anc, _ in bridge:
        ups.setdefault(leaf, []).append(anc)
    m = "map(" + ", ".join("'{}', array({})".format(leaf, ", ".join(f"'{v}'" for v in a)) for leaf, a in ups.items()) + ")"
    return (leaf_df.groupBy(*keys, "node").agg(*sums)
            .select(*keys, F.expr(f"explode({m}[node])").alias("node"), *values)
            .groupBy(*keys, "node").agg(*sums))


def node_columns(panel: DataFrame, nodes: list[str], keys=("ds",)) -> DataFrame:
    """Panel with one column per listed node: the shape in which nodes are combined."""
    return panel.groupBy(*keys).agg(*[F.sum(F.when(F.col("node") == n, F.col("value"))).alias(n) for n in nodes])


def difference_nodes(panel: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """node = minuend - subtrahend for every (minuend, subtrahend) pair, per day."""
    need = sorted({n for p in pairs.values() for n in p})
    wide = node_columns(panel.filter(F.col("node").isin(need)), need)
    rows = F.array(*[F.struct(F.lit(n).alias("node"), (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("value")) for n, (a, b) in pairs.items()])
    return wide.select("ds", F.explode(rows).alias("x")).select("ds", "x.node", "x.value")


def merge_leaves(leaf_df: DataFrame, pairs: dict[str, str], dropped: list[str]) -> DataFrame:
    """Fold source leaves into their receivers and drop emptied parents."""
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    kept = leaf_df.filter(~F.col("node").isin(dropped))
    return kept.groupBy("ds", F.coalesce(m[F.col("node")], F.col("node")).alias("node")).agg(F.sum("value").alias("value"))


def additivity_check(panel: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """Per parent: number of days and largest absolute gap between it and the sum of its children."""
    kids: dict[str, list[str]] = {}
    for p, c in edges:
        kids.setdefault(p, []).append(c)
    need = sorted({*kids, *[c for v in kids.values() for c in v]})
    wide = node_columns(panel, need)
    aggs = []
    for p, cs in kids.items():
        total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cs])
        aggs.append(F.struct(F.lit(p).alias("parent"), F.lit(len(cs)).alias("n_children"),
                             F.max(F.abs(F.col(f"`{p}`") - total)).alias("max_gap"),
                             F.count(F.col(f"`{p}`")).alias("days")).alias(p))
    one = wide.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"`{p}`") for p in kids])).alias("x")).select("x.*")
