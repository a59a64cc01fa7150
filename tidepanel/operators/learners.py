"""Pooled learners: one MLlib model over all series.

A series enters as its training mean and spread, not as a category, so the number of series is not limited
by tree bins and no list of series passes through the driver.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import calendar as cal
from tidepanel.operators import features as ft
from tidepanel.operators import selection as sel
from tidepanel.session import cut_lineage

LAGS, MEANS = (1, 2, 3, 4, 5, 10), (5, 20)
LEVEL = ("series_mean", "series_sd")
DEPTH = max(*LAGS, *MEANS)


def direct_features(df: DataFrame, sw: ft.SeriesWindow) -> tuple[DataFrame, list[str]]:
    """Model inputs built from actual lags (teacher forcing); NULL where the history is too short."""
    cols = {**ft.lag_features(sw, LAGS), **{f"mean_{n}": ft.rolling_features(sw, (n,))[f"rolling_mean_{n}"] for n in MEANS}}
    names = [*cols, "day_of_week", "month"]
    return ft.add(df, cols).withColumns(_day(F.col(sw.order))), names


def _day(d):
    c = cal.calendar_features(d)
    return {"day_of_week": c["day_of_week"], "month": c["month"]}


def pool_features(df: DataFrame, sw: ft.SeriesWindow) -> tuple[DataFrame, list[str]]:
    """The whole candidate pool, filled, and its names."""
    pool = ft.feature_pool(df, sw)
    names = ft.feature_names(pool, sw)
    return ft.fill_features(pool, sw, names), names


def choose_inputs(train: DataFrame, names: list[str], k: int) -> list[str]:
    """Inputs of a pooled model: mRMR picks ``k`` features per series on the training rows, and the ``k`` picked for
    most series, earliest first, are taken.  Only these names reach the driver."""
    picked = sel.mrmr_select(sel.feature_ranks(sel.long_features(train, names)), k)
    votes = picked.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("step").alias("step"))
    return [r.feature for r in votes.orderBy(F.desc("n"), "step", "feature").limit(k).collect()]


def series_levels(train: DataFrame) -> DataFrame:
    """(series, series_mean, series_sd) from the training rows only."""
    return train.groupBy("series").agg(F.avg("y").alias(LEVEL[0]), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias(LEVEL[1]))


def with_levels(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows with their series' levels; a series not seen in training gets zeros."""
    return rows.join(levels, "series", "left").fillna(0.0, subset=list(LEVEL))


def _assemble(columns: list[str], onehot: tuple[str, ...] = ()) -> list:
    stages: list = []
    if onehot:
        stages.append(OneHotEncoder(inputCols=list(onehot), outputCols=[f"{c}_hot" for c in onehot], handleInvalid="keep"))
    hot = [f"{c}_hot" for c in onehot]
    return [*stages, VectorAssembler(inputCols=[*[c for c in columns if c not in onehot], *hot], outputCol="features", handleInvalid="keep")]


def fit_trees(train: DataFrame, columns: list[str], kind: str = "forest", **params):
    """Rows carry their series' levels (``with_levels``); the fit takes those with all inputs."""
    train = train.dropna(subset=["y", *columns])
    if kind == "forest":
        learner = RandomForestRegressor(labelCol="y", seed=42, **{"numTrees": 20, "maxDepth": 6, **params})
    else:
        learner = GBTRegressor(labelCol="y", seed=42, **{"maxIter": 10, "maxDepth": 4, "stepSize": 0.1, **params})
    return Pipeline(stages=[*_assemble([*columns, *LEVEL]), learner]).fit(train)


def training_range(train: DataFrame, columns: list[str]) -> tuple[list[str], dict[str, tuple[float, float]]]:
    """Columns that vary and their range on the training rows: one aggregate row read by the driver."""
    aggs = [x for c in columns for x in (F.stddev_pop(c).alias(f"s_{c}"), F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}"))]
    r = train.agg(*aggs).first()
    keep = [c for c in columns if r[f"s_{c}"] is not None and r[f"s_{c}"] > 1e-8 * (max(abs(r[f"l_{c}"]), abs(r[f"h_{c}"])) + 1)]
    return keep, {c: (float(r[f"l_{c}"]), float(r[f"h_{c}"])) for c in keep}


def clip_to_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """A linear model extrapolates, so its inputs stay inside what it was trained on."""
    return df.withColumns({c: F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c))) for c, (lo, hi) in ranges.items()})


def fit_ridge(train: DataFrame, valid: DataFrame, columns: list[str], variant: str = "all", alphas=(0.001, 0.1, 10.0)):
    """Ridge regression with guards; the penalty is the one with the least error on the validation rows.

    The fit takes rows with all inputs.  Variants: ``lags`` (own lags only), ``dummies`` (calendar as indicator columns), ``all``."""
    train, valid = train.dropna(subset=["y", *columns]), valid.dropna(subset=["y", *columns])
    use = [c for c in columns if c.startswith("lag_")] if variant == "lags" else columns
    keep, ranges = training_range(train, [*use, *LEVEL])
    onehot = tuple(c for c in ("day_of_week", "month") if c in keep) if variant == "dummies" else ()
    stages = _assemble(keep, onehot)
    best, score = None, None
    for a in alphas:
        m = Pipeline(stages=[*stages, LinearRegression(labelCol="y", elasticNetParam=0.0, regParam=a, standardization=True, solver="normal")]).fit(train)
        e = RegressionEvaluator(labelCol="y", metricName="rmse").evaluate(m.transform(clip_to_range(valid, ranges)))
        if score is None or e < score:
            best, score = m, e
    return best, ranges


def direct_predict(model, rows: DataFrame, ranges: dict | None = None) -> DataFrame:
    """(series, ds, y, pred, status) of every row: ``ok``, or ``no_input`` with a NULL pred where an input is missing."""
    inputs = [c.removesuffix("_hot") for t in model.stages if isinstance(t, VectorAssembler) for c in t.getInputCols()]
    known = ~F.array_contains(F.array(*[F.col(c).isNull() for c in inputs]), True)
    safe = rows.withColumn("_known", known).fillna(0, subset=[c for c in inputs if c in rows.columns])
    out = model.transform(clip_to_range(safe, ranges) if ranges else safe)
    return out.select("series", "ds", "y", F.when(F.col("_known"), F.col("prediction")).alias("pred"), F.when(F.col("_known"), "ok").otherwise("no_input").alias("status"))


def recursive_predict(model, levels: DataFrame, history: DataFrame, horizon: int, holidays: list[str], cut_every: int = 10) -> DataFrame:
    """Forecast ``horizon`` business days ahead, each step fed with the earlier predictions.

    A series is one row holding its last values, so a step is a projection over all series at once with no
    shuffle; the result is checkpointed to the shared folder every few steps to keep the plan short.  A series with a
    shorter history than the inputs need repeats its last value (status ``naive``, else ``ok``)."""
    age = F.row_number().over(ft.Window.partitionBy("series").orderBy(F.desc("ds")))
    last = history.withColumn("_a", age).filter(F.col("_a") <= DEPTH)
    state = last.groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("ds", "y"))), lambda x: x["y"]).alias("tail"), F.max("ds").alias("last_ds"))
    days = cal.future_business_days(state.select("series", "last_ds"), "last_ds", horizon, holidays).groupBy("series").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("h", "ds"))), lambda x: x["ds"]).alias("days"))
    state = with_levels(state.join(days, "series"), levels).withColumn("preds", F.array().cast("array<double>"))
    short = state.filter(F.size("tail") < DEPTH).select("series", F.posexplode("days").alias("h", "ds"), F.element_at("tail", -1).alias("pred"))
    short = short.select("series", (F.col("h") + 1).alias("h"), "ds", "pred", F.lit("naive").alias("status"))
    state = state.filter(F.size("tail") >= DEPTH)
    for h in range(1, horizon + 1):
        lag = lambda k: F.element_at("tail", -k)
        mean = lambda n: F.aggregate(F.slice("tail", -n, n), F.lit(0.0), lambda a, x: a + x) / n
        cols = {**{f"lag_{k}": lag(k) for k in LAGS}, **{f"mean_{n}": mean(n) for n in MEANS}, **_day(F.element_at("days", h)), "y": F.lit(0.0)}
        step = model.transform(state.withColumns(cols))
        state = step.select("series", "days", *LEVEL, F.concat(F.slice("tail", 2, DEPTH - 1), F.array("prediction")).alias("tail"), F.concat("preds", F.array("prediction")).alias("preds"))
        if h % cut_every == 0 and h < horizon:
            state = cut_lineage(state)
    full = state.select("series", F.posexplode(F.arrays_zip("days", "preds")).alias("h", "x"))
    return full.select("series", (F.col("h") + 1).alias("h"), F.col("x.days").alias("ds"), F.col("x.preds").alias("pred"), F.lit("ok").alias("status")).unionByName(short)


def stack_models(wide: DataFrame, methods: list[str], n_origins: int, folds: int = 5) -> DataFrame:
    """Meta forecasts over base predictions: each fold of origins is predicted by a model fitted on earlier folds.

    The first fold has no earlier one and gets the mean of the base predictions (status ``mean``); a row without all
    base predictions gets the mean of those it has (``incomplete``)."""
    mean = F.aggregate(F.filter(F.array(*methods), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(F.filter(F.array(*methods), lambda x: x.isNotNull())), F.lit(0))
    every = cut_lineage(wide.withColumn("fold", F.floor(F.col("origin") * folds / n_origins)).withColumn("_mean", mean))
    d = every.dropna(subset=[*methods, "y"])
    plain = every.withColumn("status", F.when(F.array_contains(F.array(*[F.col(m).isNull() for m in methods]), True), "incomplete").when((F.col("fold") < 1) | F.col("y").isNull(), "mean"))
    prep = VectorAssembler(inputCols=methods, outputCol="features")
    out = plain.filter("status is not null").select("series", "origin", "fold", "y", F.col("_mean").alias("pred"), "status")
    for k in range(1, folds):
        m = Pipeline(stages=[prep, GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, seed=42)]).fit(d.filter(F.col("fold") < k))
        p = m.transform(d.filter(F.col("fold") == k)).select("series", "origin", "fold", "y", F.col("prediction").alias("pred"), F.lit("ok").alias("status"))
        out = out.unionByName(p)
    return out


def feature_importances(model, columns: list[str]) -> list[tuple[str, float]]:
    """Importances of a fitted tree pipeline, by input column."""
    return list(zip([*columns, *LEVEL], [float(v) for v in model.stages[-1].featureImportances.toArray()]))
