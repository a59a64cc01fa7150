"""Correlations and feature selection."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidepanel.operators import features as ft
from tidepanel.operators import learners as ml
from tidepanel.operators import nodes
from tidepanel.operators import selection as sel
from tidepanel.plans import base as b
from tidepanel.plans import q_etl as qe
from tidepanel.plans import q_features as qf
from tidepanel.plans.registry import query
from tidepanel.session import cut_lineage

LEAVES = nodes.leaf_nodes(qe.TREE_SIMPLE)
_LEAF = f"{qe.PANEL_SIMPLE}, leaf AS (SELECT node AS series, ds, value AS y FROM panel WHERE node IN ({qe._LEAVES}))"
_PAIRS = f"""{_LEAF}, prs AS (SELECT a.series AS target, b.series AS candidate, abs(CASE WHEN stddev_pop(a.y) > 0 AND stddev_pop(b.y) > 0 THEN covar_pop(a.y, b.y) / (stddev_pop(a.y) * stddev_pop(b.y)) END) AS corr
  FROM leaf a JOIN leaf b USING (ds) WHERE a.series <> b.series AND length(a.series) = length(b.series) GROUP BY 1, 2)"""


def leaf_series(s, d):
    return qe.leaf_panel(s, d).select(F.col("node").alias("series"), "ds", F.col("value").alias("y"))


def _every_two(names) -> list[tuple[str, str]]:
    return list(combinations(sorted(names), 2))


def _pairs(s, d):
    wanted = [(x, y) for x, y in _every_two(LEAVES) if len(x) == len(y)]
    return sel.correlate_pairs(leaf_series(s, d), wanted).withColumn("corr", F.abs("corr"))


def _top_sql(source: str, k: int) -> str:
    by = "PARTITION BY target ORDER BY round(abs(corr), 9) DESC, candidate"
    return f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER ({by}) AS r FROM {source} WHERE corr IS NOT NULL AND target <> candidate) WHERE r <= {k}"


def _top(pairs, k: int):
    return sel.top_correlated(pairs.withColumn("corr", F.round("corr", 9)), k)


@query("f1_pearson_to_target", "target:s candidate:s corr:6", f"WITH {_PAIRS} {_top_sql('prs', 30)}")
def _(s, d):
    return _top(_pairs(s, d), 30)


@query("j12_all_pairs_series", "target:s candidate:s corr:6", f"""WITH {b.SERIES}, prs AS (SELECT a.series AS target, b.series AS candidate, corr(a.y, b.y) AS corr FROM series a JOIN series b USING (ds) GROUP BY 1, 2) {_top_sql('prs', 2)}""")
def _(s, d):
    """The two series closest to each series."""
    return _top(sel.correlate_pairs(b.series(s, d), _every_two(b.PRIORITIES)), 2)


@query("k1_top_correlated", "target:s candidate:s corr:6 rank:i", f"""WITH {_PAIRS} SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(corr, 9) DESC, candidate) AS rank FROM prs WHERE corr IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(corr, 9) DESC, candidate) <= 5""")
def _(s, d):
    return sel.top_correlated(_pairs(s, d).withColumn("corr", F.round("corr", 9)), 5)


@query("f2_same_depth_series", "node:s depth:i peers:i", f"""WITH {qe.PANEL_FULL}, n AS (SELECT DISTINCT node FROM panel), lf AS (SELECT node, length(node) - length(replace(node, '.', '')) AS dp FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE starts_with(m.node, n.node || '.'))),
g AS (SELECT dp, count(*) - 1 AS peers FROM lf GROUP BY 1)
SELECT node, dp + 1 AS depth, peers FROM lf JOIN g USING (dp)""")
def _(s, d):
    return sel.same_depth_leaves(qe.panel_full(s, d).select("node").distinct())


_CATDAY = f"{b.TIDY}, cat AS (SELECT category AS series, ds, sum(value) AS y FROM tidy GROUP BY 1, 2)"


def _cat_day(s, d):
    return qe.tidy(s, d).groupBy(F.col("category").alias("series"), "ds").agg(F.sum("value").alias("y"))


@query("f3_correlation_matrix", "target:s candidate:s corr:6", f"WITH {_CATDAY}, prs AS (SELECT a.series AS target, b.series AS candidate, covar_pop(a.y, b.y) / (stddev_pop(a.y) * stddev_pop(b.y)) AS corr FROM cat a JOIN cat b USING (ds) GROUP BY 1, 2) {_top_sql('prs', 5)}")
def _(s, d):
    """The five categories closest to each category."""
    return _top(sel.correlate_pairs(_cat_day(s, d), _every_two(nodes.CATEGORIES)), 5)


@query("f3_external_correlation", "target:s candidate:s corr:6", f"WITH {_CATDAY}, {b.EXTERNAL} SELECT a.series AS target, e.name AS candidate, corr(a.y, e.value) AS corr FROM cat a JOIN external e USING (ds) GROUP BY 1, 2")
def _(s, d):
    ext = b.external(s, d).select(F.col("name").alias("series"), "ds", F.col("value").alias("y"))
    return sel.correlate_to_targets(ext, _cat_day(s, d), list(nodes.CATEGORIES))


# A small feature pool with the same content on both sides.
_SMALL = {**{f"lag_{k}": qf._lags[f"lag_{k}"] for k in range(1, 11)}, **{k: v for k, v in qf._roll.items() if k.rsplit("_", 1)[1] in ("5", "20") and "min" not in k},
          "value_diff_1": qf._chg["value_diff_1"], "value_diff_5": qf._chg["value_diff_5"]}
_NAMES = list(_SMALL)


def _long_sql(features: dict, source: str = "idx", ctes: str = "") -> str:
    return f"""{b.INDEXED}{ctes}, fw AS (SELECT series, ds, y, {', '.join(f'round(coalesce({e}, 0), 6) AS {n}' for n, e in features.items())} FROM {source}),
fl AS (SELECT series, ds, y, feature, x FROM fw UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(features)}))),
rk AS (SELECT *, rank() OVER (PARTITION BY series, feature ORDER BY x) + (count(*) OVER (PARTITION BY series, feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY series, feature ORDER BY y) + (count(*) OVER (PARTITION BY series, feature, y) - 1) / 2.0 AS ry FROM fl),
rel AS (SELECT series, feature, round(coalesce(abs(corr(rx, ry)), 0), 9) AS score FROM rk GROUP BY 1, 2)"""


_LONG = _long_sql(_SMALL)


def small_ranks(s, d):
    x = qf.indexed(s, d)
    cols = {**ft.lag_features(qf.SW), **ft.rolling_features(qf.SW), **ft.change_features(qf.SW)}
    wide = x.selectExpr("series", "ds", "y", *[f"round({cols[n]}, 6) AS {n}" for n in _NAMES])
    return sel.feature_ranks(sel.long_features(wide, _NAMES))


def _rel(s, d):
    return sel.spearman_relevance(small_ranks(s, d)).withColumn("score", F.round("score", 9))


@query("f4_spearman_relevance", "series:s feature:s score:6", f"WITH {_LONG} SELECT * FROM rel")
def _(s, d):
    return _rel(s, d)


def _mrmr_sql(k):
    red = f"""redm AS (SELECT a.series, a.feature AS f, b.feature AS g, round(coalesce(abs(CASE WHEN stddev_pop(a.rx) > 0 AND stddev_pop(b.rx) > 0 THEN covar_pop(a.rx, b.rx) / (stddev_pop(a.rx) * stddev_pop(b.rx)) END), 0), 12) AS c
  FROM rk a JOIN rk b ON a.series = b.series AND a.ds = b.ds GROUP BY 1, 2, 3),
p1 AS (SELECT series, 1 AS step, feature, score FROM rel QUALIFY row_number() OVER (PARTITION BY series ORDER BY score DESC, feature) = 1)"""
    for i in range(2, k + 1):
        red += f""",
p{i} AS (SELECT * FROM p{i - 1} UNION ALL (SELECT r.series, {i}, r.feature, r.score FROM rel r JOIN redm m ON m.series = r.series AND m.f = r.feature JOIN p{i - 1} p ON p.series = r.series AND p.feature = m.g
  WHERE (r.series, r.feature) NOT IN (SELECT series, feature FROM p{i - 1}) GROUP BY r.series, r.feature, r.score
  QUALIFY row_number() OVER (PARTITION BY r.series ORDER BY r.score - avg(m.c) DESC, r.feature) = 1))"""
    return f"{red}"


@query("f5_mrmr_select", "series:s step:i feature:s score:6", f"WITH {_LONG}, {_mrmr_sql(3)} SELECT * FROM p3")
def _(s, d):
    return sel.mrmr_select(small_ranks(s, d), 3)


@query("f6_top_k", "series:s feature:s score:6 rank:i", f"WITH {_LONG} SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, feature) AS rank FROM rel QUALIFY row_number() OVER (PARTITION BY series ORDER BY score DESC, feature) <= 5")
def _(s, d):
    return sel.top_k(_rel(s, d), 5)


@query("f7_volatility_quota", "series:s feature:s score:6 rank:i", f"""WITH {_LONG}, s0 AS (SELECT *, CAST(feature LIKE 'rolling_std%' AS INT) AS p, row_number() OVER (PARTITION BY series ORDER BY score DESC, feature) AS rk0 FROM rel),
s1 AS (SELECT *, CAST(rk0 <= 4 AS INT) AS b4, 2 - sum(CASE WHEN rk0 <= 4 THEN p ELSE 0 END) OVER (PARTITION BY series) AS need FROM s0),
adds AS (SELECT * FROM s1 WHERE p = 1 AND b4 = 0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY score DESC, feature) <= need),
kept AS (SELECT * FROM s1 WHERE b4 = 1 AND p = 0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY score DESC, feature) <= count(*) OVER (PARTITION BY series) - (SELECT count(*) FROM adds WHERE adds.series = s1.series)),
u AS (SELECT series, feature, score FROM adds UNION ALL SELECT series, feature, score FROM kept UNION ALL SELECT series, feature, score FROM s1 WHERE b4 = 1 AND p = 1)
SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, feature) AS rank FROM u QUALIFY row_number() OVER (PARTITION BY series ORDER BY score DESC, feature) <= 4""")
def _(s, d):
    return sel.volatility_quota(_rel(s, d), F.startswith("feature", F.lit("rolling_std")), 4, 2)


@query("f8_mean_pairwise_corr", "days:i rho:6", f"""WITH {_LEAF}, df AS (SELECT series, ds, y - lag(y) OVER (PARTITION BY series ORDER BY ds) AS v FROM leaf), rr AS (SELECT series, ds, rank() OVER (PARTITION BY series ORDER BY v) + (count(*) OVER (PARTITION BY series, v) - 1) / 2.0 AS r FROM df WHERE v IS NOT NULL),
c AS (SELECT a.series, b.series AS o, corr(a.r, b.r) AS c FROM rr a JOIN rr b USING (ds) WHERE a.series <> b.series GROUP BY 1, 2)
SELECT (SELECT count(DISTINCT ds) FROM rr) AS days, greatest(0, least(1, avg(c))) AS rho FROM c""")
def _(s, d):
    return sel.mean_pairwise_corr(leaf_series(s, d), len(LEAVES))


_MARKET = {**{f"ext_{c}_lag_{k}": f"CASE WHEN y <> 0 THEN {qf._lag(k, c)} END" for c in ("A", "N") for k in range(1, 4)}, **{f"lag_{k}": qf._lags[f"lag_{k}"] for k in (1, 2, 5, 10)}}
_SLOT = "SELECT '{r}' AS rule, {k} AS k, series, count(*) AS chosen, count(*) FILTER (feature LIKE 'ext!_%' ESCAPE '!') AS market FROM {t} WHERE step <= {k} GROUP BY series"
_REL = "(SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, feature) AS step FROM rel)"


@query("f9_market_slots", "rule:s k:i series:s chosen:i market:i", f"WITH {_long_sql(_MARKET, 'joined', ', ' + b.EXTERNAL + ', ' + qf._MKT)}, {_mrmr_sql(4)} "
       + " UNION ALL ".join(_SLOT.format(r=r, k=k, t=t) for r, t in (("mrmr", "p4"), ("relevance", _REL)) for k in (2, 4)))
def _(s, d):
    """Chosen market features per selection size and rule."""
    wide = qf.market_joined(s, d)
    for c in ("A", "N"):
        wide = ft.add(wide, {f"ext_{c}_lag_{k}": f"CASE WHEN y <> 0 THEN {qf.SW.sql_lag(k, c)} END" for k in range(1, 4)})
    wide = ft.add(wide, ft.lag_features(qf.SW, (1, 2, 5, 10)))
    wide = wide.selectExpr("series", "ds", "y", *[f"round({c}, 6) AS {c}" for c in _MARKET])
    ranks = sel.feature_ranks(sel.long_features(wide, list(_MARKET)))
    out = None
    for rule, beta in (("mrmr", 1.0), ("relevance", 0.0)):
        chosen = sel.mrmr_select(ranks, 4, beta)
        for k in (2, 4):
            m = sel.market_slots(chosen.filter(F.col("step") <= k)).withColumns({"rule": F.lit(rule), "k": F.lit(k)})
            out = m if out is None else out.unionByName(m)
    return out


_FAM = " ".join(f"WHEN regexp_matches(feature, '{p}') THEN '{n}'" for n, p in sel.FAMILIES if p)


@query("f10_feature_family_shares", "series:s family:s weight:6 features:i share:6", f"""WITH {_LONG}, g AS (SELECT series, CASE {_FAM} ELSE 'Calendar and Fourier' END AS family, sum(score) AS weight, count(*) AS features FROM rel GROUP BY 1, 2)
SELECT *, weight / sum(weight) OVER (PARTITION BY series) AS share FROM g""")
def _(s, d):
    return sel.family_shares(_rel(s, d))


# --- the whole pool: all candidates compete, at the sizes that applications use ------------------------------------------

SIZES = (12, 25)


def pool(s, d, market: bool = False):
    """(rows, names): every series with all its candidates, and lags of the two market series among them."""
    if not market:
        return ml.pool_features(b.series(s, d), qf.SW)
    wide = qf.market_joined(s, d)
    ext = {f"ext_{c}_lag_{k}": f"CASE WHEN y <> 0 THEN {qf.SW.sql_lag(k, c)} END" for c in ("A", "N") for k in range(1, 16)}
    x, names = ml.pool_features(b.series(s, d), qf.SW)
    return x.join(ft.add(wide, ext).select("series", "ds", *ext), ["series", "ds"]), [*names, *ext]


def pool_ranks(s, d, market: bool = False):
    x, names = pool(s, d, market)
    return sel.feature_ranks(sel.long_features(x, names))


def _by_size(build, sizes=SIZES):
    out = None
    for k in sizes:
        x = build(k).withColumn("k", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return out


@query("f4_pool_relevance", "series:s feature:s score:6")
def _(s, d):
    """Relevance of all 116 candidates of every series."""
    return sel.spearman_relevance(pool_ranks(s, d))


@query("f5_pool_mrmr", "k:i series:s step:i feature:s score:6")
def _(s, d):
    """12 and 25 of the whole pool by relevance less redundancy; the first 12 steps are the smaller choice."""
    picked = sel.mrmr_select(pool_ranks(s, d), max(SIZES))
    return picked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in SIZES]))).where("step <= k")


@query("f6_pool_top_k", "k:i series:s feature:s score:6 rank:i")
def _(s, d):
    scores = cut_lineage(sel.spearman_relevance(pool_ranks(s, d)))          # one row per series and candidate
    return _by_size(lambda k: sel.top_k(scores, k))


@query("f7_pool_volatility_quota", "k:i series:s feature:s score:6 rank:i")
def _(s, d):
    """Top features of the whole pool with a quarter of the places kept for volatility."""
    scores = cut_lineage(sel.spearman_relevance(pool_ranks(s, d)))
    volatile = F.col("feature").rlike("std|volatil")
    return _by_size(lambda k: sel.volatility_quota(scores, volatile, k, k // 4))


@query("f9_pool_market_slots", "rule:s k:i series:s chosen:i market:i")
def _(s, d):
    """How many of 12 and 25 chosen come from the market, when its 30 lags compete with the whole pool."""
    ranks = pool_ranks(s, d, market=True)
    out = None
    for rule, beta in (("mrmr", 1.0), ("relevance", 0.0)):
        chosen = cut_lineage(sel.mrmr_select(ranks, max(SIZES), beta))
        x = _by_size(lambda k: sel.market_slots(chosen.where(F.col("step") <= k))).withColumn("rule", F.lit(rule))
        out = x if out is None else out.unionByName(x)
    return out


@query("f10_pool_family_shares", "series:s family:s weight:6 features:i share:6")
def _(s, d):
    return sel.family_shares(sel.spearman_relevance(pool_ranks(s, d)))
