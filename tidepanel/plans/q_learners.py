"""Pooled learners, recursion, stacking, forecast versions and the streaming feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import learners as ml
from tidepanel.operators import selection as sel
from tidepanel.operators.features import SeriesWindow
from tidepanel.operators.forecast import naive_forecasts, positions, route_models
from tidepanel.plans import base as b
from tidepanel.plans import q_evaluation as qv
from tidepanel.plans import q_forecast as qf
from tidepanel.plans import q_news as qn
from tidepanel.plans.q_calendar import HOLIDAYS
from tidepanel.plans.q_selection import leaf_series
from tidepanel.plans.registry import query
from tidepanel.session import cut_lineage, scratch_path
from tidepanel.sources import versions
from tidepanel.streaming import feed

SW = SeriesWindow()


def _parts(s, d, hold: int = 60):
    """Training, validation and test rows with features; computed once and kept for the fits."""
    x, cols = ml.direct_features(b.series(s, d), SW)
    x = positions(x).withColumn("age", F.col("n") - F.col("i"))
    x = ml.with_levels(x, ml.series_levels(x.filter(F.col("age") > 2 * hold))).cache()
    return x.filter(F.col("age") > 2 * hold), x.filter((F.col("age") > hold) & (F.col("age") <= 2 * hold)), x.filter(F.col("age") <= hold), cols


def _tests_sql(label: str, values: tuple[str, ...]) -> str:
    """The last 60 days of every series, all predicted, with an error no more than twice that of the day before."""
    return f"""WITH {b.SERIES} SELECT v AS {label}, series, least(count(*), 60) AS n, least(count(*), 60) AS finite, 1 AS close
FROM series CROSS JOIN (SELECT unnest({list(values)}) AS v) GROUP BY 1, 2"""


def _judged(out, label: str):
    naive = F.avg(F.abs(F.col("y") - F.col("lag_1")))
    return out.groupBy(label, "series").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("pred") < float("inf")).alias("finite"),
                                            (F.avg(F.abs(F.col("y") - F.col("pred"))) <= 2 * naive).cast("int").alias("close"))


@query("m5_panel_trees", "kind:s series:s n:i finite:i close:i", _tests_sql("kind", ("forest", "boosted")))
def _(s, d):
    """Pooled forest and boosted trees: one-step test errors per series."""
    train, _v, test, cols = _parts(s, d)
    out = None
    for kind in ("forest", "boosted"):
        p = ml.direct_predict(ml.fit_trees(train, cols, kind), test).withColumn("kind", F.lit(kind))
        out = p if out is None else out.unionByName(p)
    return _judged(out.join(test.select("series", "ds", "lag_1"), ["series", "ds"]), "kind")


@query("m26_k_ablation_pool", "k:s series:s n:i finite:i close:i", _tests_sql("k", ("12", "25")))
def _(s, d):
    """Forests on 12 and on 25 of the 116 candidates, chosen by mRMR on training rows: one-step test errors."""
    x, names = ml.pool_features(b.series(s, d), SW)
    x = cut_lineage(positions(x).withColumn("age", F.col("n") - F.col("i")))
    train, test, out = x.filter("age > 60"), x.filter("age <= 60"), None
    levels = ml.series_levels(train)
    for k in (12, 25):
        cols = ml.choose_inputs(train, names, k)
        model = ml.fit_trees(ml.with_levels(train, levels), cols, numTrees=10)
        p = ml.direct_predict(model, ml.with_levels(test, levels)).withColumn("k", F.lit(str(k)))
        out = p if out is None else out.unionByName(p)
    return _judged(out.join(test.select("series", "ds", "lag_1"), ["series", "ds"]), "k")


@query("m6_panel_ridge", "variant:s series:s n:i finite:i close:i", _tests_sql("variant", ("lags", "dummies", "all")))
def _(s, d):
    """Guarded ridge in its three variants: one-step test errors per series."""
    train, valid, test, cols = _parts(s, d)
    out = None
    for v in ("lags", "dummies", "all"):
        m, r = ml.fit_ridge(train, valid, cols, v)
        p = ml.direct_predict(m, test, r).withColumn("variant", F.lit(v))
        out = p if out is None else out.unionByName(p)
    return _judged(out.join(test.select("series", "ds", "lag_1"), ["series", "ds"]), "variant")


@query("m7_direct_predict", "series:s ds:d y:0 known:i status:s", f"""WITH {b.SERIES} SELECT series, ds, y, 1 AS known, 'ok' AS status FROM series QUALIFY row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 60""")
def _(s, d):
    """Teacher-forced forest predictions of the last 60 days."""
    train, _v, test, cols = _parts(s, d)
    return ml.direct_predict(ml.fit_trees(train, cols, numTrees=10), test).withColumn("known", (F.abs("pred") < float("inf")).cast("int"))


@query("m8_recursive_predict", "series:s h:i known:i status:s", f"""WITH {b.SERIES} SELECT DISTINCT series, h, 1 AS known, 'ok' AS status FROM series CROSS JOIN (SELECT unnest(range(1, 21)) AS h)""")
def _(s, d):
    """Twenty business days ahead, each fed with the predictions before it."""
    train, _v, _t, cols = _parts(s, d)
    return ml.recursive_predict(ml.fit_trees(train, cols, numTrees=5, maxDepth=4), ml.series_levels(train), b.series(s, d), 20, HOLIDAYS).withColumn("known", (F.abs("pred") < float("inf")).cast("int"))


@query("m9_stack_models", "series:s origin:i fold:i y:0 known:i status:s", f"""WITH {qv.RUNS}, w AS (SELECT series, origin, max(actual) AS y FROM runs WHERE arm = 'main' GROUP BY 1, 2)
SELECT series, origin, floor(origin * 5 / 310) AS fold, y, 1 AS known, CASE WHEN floor(origin * 5 / 310) < 1 THEN 'mean' ELSE 'ok' END AS status FROM w""")
def _(s, d):
    """Boosted meta model over four base methods, fitted on earlier folds only."""
    r = qv.runs(s, d).filter(F.col("arm") == "main").filter(F.col("method").isin(qv.METHODS))
    w = r.groupBy("series", "origin").agg(F.max("actual").alias("y"), *[F.max(F.when(F.col("method") == m, F.col("pred"))).alias(m) for m in qv.METHODS])
    return ml.stack_models(w, qv.METHODS, 310).withColumn("known", (F.abs("pred") < float("inf")).cast("int"))


@query("f10_importance_by_family", "family:s features:i share:4")
def _(s, d):
    """Share of a fitted forest's importance by feature family."""
    train, _v, _t, cols = _parts(s, d)
    imp = ml.feature_importances(ml.fit_trees(train, cols, numTrees=5), cols)
    f = s.createDataFrame([("all", n, v) for n, v in imp], "series string, feature string, score double")
    return sel.family_shares(f).drop("series")


# --- forecast versions -----------------------------------------------------------------------------------------

_CFG = dict(qf._MODELS)
_VN = f"WITH {qf._LEAFCTE}, {qf._naive_sql('leaf')}, mm(series, method) AS ({qf.values_sql(qf._MODELS)}), f AS (SELECT series, method, h, pred FROM naive JOIN mm USING (series, method))"


def _saved(s, d):
    root = scratch_path(s, "versions")
    f = route_models(naive_forecasts(leaf_series(s, d), 20, HOLIDAYS), qf.model_map(s))
    for v, k in (("20010901_090000", 1.0), ("20010902_090000", 1.1), ("20010903_090000", 1.2)):
        versions.save_version(f.withColumn("pred", F.col("pred") * k), root, v, v, _CFG, {"forecast_days": "20"})
    versions.delete_version(s, root, "20010902_090000")
    return root


@query("s18_load_version", "series:s method:s h:i pred:3", f"{_VN} SELECT series, method, h, pred * 1.2 AS pred FROM f")
def _(s, d):
    return versions.load_version(s, _saved(s, d), "20010903_090000")


@query("s18_version_summary", "version_id:s model:s nodes:i", f"{_VN} SELECT v AS version_id, method AS model, count(DISTINCT series) AS nodes FROM f CROSS JOIN (SELECT unnest(['20010901_090000', '20010903_090000']) AS v) GROUP BY 1, 2")
def _(s, d):
    return versions.version_summary(s, _saved(s, d))


# --- streaming feed -----------------------------------------------------------------------------------------------

_TIME_CUT = ("2024-01-11", "2024-01-21")


def _landing(s, d, late: bool = False):
    """Feed files in arrival order: three chunks by time, the later ones repeating part of the earlier."""
    path = scratch_path(s, "landing")
    a = qn.art(s, d).withColumn("published_utc", F.col("published_utc").cast("timestamp"))
    lo, hi = (F.lit(x).cast("timestamp") for x in _TIME_CUT)
    held = (F.col("event_id") % 10 == 3) & F.lit(late)
    chunks = [a.filter((F.col("published_utc") < lo) & ~held), a.filter((F.col("published_utc") >= lo) & (F.col("published_utc") < hi)),
              a.filter((F.col("published_utc") >= hi) | ((F.col("published_utc") < lo) & held))]
    if late:
        chunks.append(a.filter(F.col("event_id") % 3 == 0))         # the whole range is pulled again in part
    for c in chunks:
        c.write.mode("append").parquet(path)
    return path, a.schema


_ACC = f"{qn.ART}, ok AS (SELECT * FROM art WHERE trim(title) <> '' OR polarity IS NOT NULL)"


@query("t1_ingest_feed", "uid:s business_date:d url:s", f"WITH {_ACC} SELECT DISTINCT uid, business_date, url FROM (SELECT uid, min(business_date) AS business_date, min(url) AS url FROM ok GROUP BY 1)")
def _(s, d):
    path, schema = _landing(s, d)
    store, ck = scratch_path(s, "store"), scratch_path(s, "ck")
    feed.ingest_feed(feed.read_feed(s, path, schema), store, ck, ["published_utc", "event_id"])
    return s.read.parquet(store)


@query("t2_stream_dedup", "uid:s", f"WITH {qn.ART} SELECT DISTINCT uid FROM art")
def _(s, d):
    path, schema = _landing(s, d, late=True)
    store, ck = scratch_path(s, "dedup"), scratch_path(s, "ck")
    feed.stream_dedup(feed.read_feed(s, path, schema), store, ck, ["published_utc", "event_id"])
    return s.read.parquet(store)


@query("t3_business_day_tumbling", "business_date:d scorer:s n_news:i polarity:6", f"WITH {qn._DAILY} SELECT * FROM daily")
def _(s, d):
    path, schema = _landing(s, d, late=True)
    store, out, ck = scratch_path(s, "store"), scratch_path(s, "tumbling"), scratch_path(s, "ck")
    feed.tumbling_from_store(feed.read_feed(s, path, schema, 2), store, out, ck, ["published_utc"], "event_id")
    return feed.latest_revision(s, out, ["business_date", "scorer"])


@query("t3_business_day_batch", "business_date:d scorer:s n_news:i polarity:6", f"WITH {qn._DAILY} SELECT * FROM daily")
def _(s, d):
    return feed.business_day_tumbling(qn.art(s, d))


@query("t4_late_data_policy", "business_date:d n:i", f"WITH {_ACC}, u AS (SELECT uid, min(business_date) AS business_date FROM ok GROUP BY 1) SELECT business_date, count(*) AS n FROM u GROUP BY 1")
def _(s, d):
    path, schema = _landing(s, d, late=True)
    store, ck = scratch_path(s, "store"), scratch_path(s, "ck")
    feed.ingest_feed(feed.read_feed(s, path, schema), store, ck, ["published_utc", "event_id"])
    feed.ingest_feed(feed.read_feed(s, path, schema), store, scratch_path(s, "ck-again"), ["published_utc", "event_id"])      # a full re-pull adds nothing
    return s.read.parquet(store).groupBy("business_date").agg(F.count(F.lit(1)).alias("n"))
