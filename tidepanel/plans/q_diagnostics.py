"""Series diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.normal import cdf_sql, ppf_sql
from tidepanel.operators import diagnostics as dg
from tidepanel.plans import base as b
from tidepanel.plans import q_etl as qe
from tidepanel.plans.registry import query

_P = "OVER (PARTITION BY series)"
_IQR = f"""{b.SERIES}, q AS (SELECT *, quantile_cont(y, 0.25) {_P} AS q1, quantile_cont(y, 0.75) {_P} AS q3 FROM series),
iqr AS (SELECT series, ds, y, q1 - 1.5*(q3-q1) AS lower, q3 + 1.5*(q3-q1) AS upper, CASE WHEN y > q3 + 1.5*(q3-q1) THEN y - (q3 + 1.5*(q3-q1)) WHEN y < q1 - 1.5*(q3-q1) THEN y - (q1 - 1.5*(q3-q1)) ELSE 0 END AS score FROM q)"""
_MAD = f"""{b.SERIES}, md AS (SELECT *, abs(y - m) AS dv FROM (SELECT *, quantile_cont(y, 0.5) {_P} AS m FROM series)),
mad AS (SELECT series, ds, y, CASE WHEN quantile_cont(dv, 0.5) {_P} > 0 THEN 0.6745 * (y - m) / quantile_cont(dv, 0.5) {_P} WHEN avg(dv) {_P} > 0 THEN (y - m) / (1.253314 * avg(dv) {_P}) ELSE 0 END AS score FROM md)"""


@query("d1_outliers_iqr", "series:s ds:d y:0 lower:4 upper:4 is_outlier:i", f"WITH {_IQR} SELECT *, CAST(score <> 0 AS INT) AS is_outlier FROM iqr")
def _(s, d):
    return dg.outliers_iqr(b.series(s, d))


@query("d2_outliers_zscore", "series:s ds:d score:6 is_outlier:i", f"WITH {b.SERIES}, z AS (SELECT series, ds, (y - avg(y) {_P}) / stddev_pop(y) {_P} AS score FROM series) SELECT *, CAST(abs(score) > 3 AS INT) AS is_outlier FROM z")
def _(s, d):
    return dg.outliers_zscore(b.series(s, d))


@query("d3_outliers_mad", "series:s ds:d score:6 is_outlier:i", f"WITH {_MAD} SELECT *, CAST(abs(score) > 3.5 AS INT) AS is_outlier FROM mad")
def _(s, d):
    return dg.outliers_mad(b.series(s, d))


_SUM = "SELECT '{m}' AS method, series, ds, y, score, CASE WHEN score > 0 THEN 'Tinggi' ELSE 'Rendah' END AS direction, row_number() OVER (PARTITION BY series ORDER BY abs(score) DESC, ds) AS rank FROM {t} WHERE abs(score) > {c}"


@query("d4_summarize_outliers", "method:s series:s ds:d score:6 direction:s rank:i", f"""WITH {_MAD}, q AS {_IQR.split(', q AS ', 1)[1]}
{_SUM.format(m='mad', t='mad', c=3.5)} UNION ALL {_SUM.format(m='iqr', t='iqr', c=0)}""")
def _(s, d):
    x = b.series(s, d)
    return dg.summarize_outliers(dg.outliers_mad(x)).withColumn("method", F.lit("mad")).unionByName(dg.summarize_outliers(dg.outliers_iqr(x)).withColumn("method", F.lit("iqr")))


@query("k9_outliers_ranked", "series:s ds:d score:6 rank:i", f"""WITH {b.SERIES}, z AS (SELECT series, ds, (y - avg(y) {_P}) / stddev_pop(y) {_P} AS score FROM series)
SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(score) DESC, ds) AS rank FROM z WHERE abs(score) > 2""")
def _(s, d):
    return dg.summarize_outliers(dg.outliers_zscore(b.series(s, d), 2.0)).orderBy(F.abs("score").desc())


@query("a25_outliers_per_year", "series:s year:i n:i", f"WITH {_MAD} SELECT series, year(ds) AS year, count(*) AS n FROM mad WHERE abs(score) > 2 GROUP BY 1, 2")
def _(s, d):
    return dg.outliers_mad(b.series(s, d), 2.0).filter("is_outlier = 1").groupBy("series", F.year("ds").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("a26_yearly_volatility", "series:s year:i n:i std:4 mean:4", f"WITH {b.SERIES} SELECT series, year(ds) AS year, count(*) AS n, stddev_samp(y) AS std, avg(y) AS mean FROM series GROUP BY 1, 2")
def _(s, d):
    return b.series(s, d).groupBy("series", F.year("ds").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("y").alias("std"), F.avg("y").alias("mean"))


# A level shift is added so that the segmentation has something to find.
_SHIFT = f"""{b.SERIES}, sh AS (SELECT series, ds, y + CASE WHEN ds >= DATE '1997-06-01' AND series = '1-URGENT' THEN 600 WHEN ds >= DATE '1999-02-01' THEN 300 ELSE 0 END AS y FROM series)"""


def _shifted(s, d):
    bump = (F.when((F.col("ds") >= F.lit("1997-06-01").cast("date")) & (F.col("series") == "1-URGENT"), 600.0)
            .when(F.col("ds") >= F.lit("1999-02-01").cast("date"), 300.0).otherwise(0.0))
    return b.series(s, d).withColumn("y", F.col("y") + bump)


def _breaks_sql(rounds: int) -> str:
    """Binary segmentation written out round by round."""
    seg = "PARTITION BY series, seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING"
    q = f"""WITH {_SHIFT}, x0 AS MATERIALIZED (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i, sum(y*y) {_P} - sum(y) {_P} * sum(y) {_P} / count(*) {_P} AS tot, 1 AS seg, TRUE AS go FROM sh)"""
    for k in range(1, rounds + 1):
        q += f""", s{k} AS (SELECT series, seg, i, sum(y) OVER ({seg} AND 1 PRECEDING) AS l, count(*) OVER ({seg} AND CURRENT ROW) - 1 AS p, count(*) OVER (PARTITION BY series, seg) AS m, sum(y) OVER (PARTITION BY series, seg) AS t FROM x{k - 1}),
b{k} AS (SELECT series, seg AS bseg, i AS bi, l*l/p + (t-l)*(t-l)/(m-p) - t*t/m AS gain FROM s{k} WHERE p >= 60 AND m - p >= 60 AND l*l/p + (t-l)*(t-l)/(m-p) - t*t/m > 0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY gain DESC, i) = 1),
x{k} AS MATERIALIZED (SELECT series, ds, y, i, tot, CASE WHEN take AND seg = bseg AND i >= bi THEN seg * 2 + 1 WHEN take AND seg = bseg THEN seg * 2 ELSE seg END AS seg, take AS go
  FROM (SELECT x{k - 1}.*, bseg, bi, coalesce(go AND tot > 0 AND gain >= 0.01 * tot, FALSE) AS take FROM x{k - 1} LEFT JOIN b{k} USING (series)))"""
    return q + f" SELECT series, min(i) AS start_idx, max(i) AS end_idx, min(ds) AS start_ds, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std FROM x{rounds} GROUP BY series, seg"


@query("d5_structural_breaks", "series:s start_idx:i end_idx:i start_ds:d n:i mean:4 std:4", _breaks_sql(5))
def _(s, d):
    """Segments of every series after at most five accepted splits."""
    return dg.segment_stats(dg.structural_breaks(_shifted(s, d)))


@query("d5_first_break", "series:s start_idx:i end_idx:i start_ds:d n:i mean:4 std:4", f"""WITH {_SHIFT}, x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i, count(*) {_P} AS m, sum(y) {_P} AS t, sum(y*y) {_P} AS qq,
  sum(y) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM sh),
g AS (SELECT series, i, l*l/i + (t-l)*(t-l)/(m-i) - t*t/m AS gain, qq - t*t/m AS tot FROM x WHERE i >= 60 AND m - i >= 60),
bp AS (SELECT series, i AS bp FROM g WHERE gain > 0 AND gain >= 0.01 * tot QUALIFY row_number() OVER (PARTITION BY series ORDER BY gain DESC, i) = 1)
SELECT x.series, min(i) AS start_idx, max(i) AS end_idx, min(ds) AS start_ds, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std FROM x LEFT JOIN bp USING (series) GROUP BY x.series, coalesce(i >= bp, FALSE)""")
def _(s, d):
    return dg.segment_stats(dg.structural_breaks(_shifted(s, d), max_breaks=1))


@query("d6_cusum", "series:s ds:d cusum:3", f"WITH {b.SERIES}, c AS (SELECT series, ds, y - avg(y) {_P} AS e FROM series) SELECT series, ds, sum(e) OVER (PARTITION BY series ORDER BY ds) AS cusum FROM c")
def _(s, d):
    return dg.cusum(b.series(s, d))


@query("d7_kpss_statistic", "series:s n:i lags:i statistic:6 stationary:i", f"""WITH {_SHIFT}, e AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ds) AS i, count(*) {_P} AS n, y - avg(y) {_P} AS e FROM sh),
c AS (SELECT *, sum(e) OVER (PARTITION BY series ORDER BY i) AS s FROM e),
ac AS (SELECT a.series, a.n, a.i - b.i AS k, sum(a.e * b.e) AS p FROM e a JOIN e b ON a.series = b.series AND b.i <= a.i AND b.i >= a.i - 90 GROUP BY 1, 2, 3),
h AS (SELECT series, n, sum(CASE WHEN k = 0 THEN p / n WHEN k <= floor(pow(n, 2.0/9)) THEN p / (n / 2.0) END) AS s0, sum(CASE WHEN k > 0 AND k <= floor(pow(n, 2.0/9)) THEN k * p / (n / 2.0) ELSE 0 END) AS s1 FROM ac GROUP BY 1, 2),
L AS (SELECT series, n, least(n - 1, floor(1.1447 * pow(pow(s1 / s0, 2), 1.0/3) * pow(n, 1.0/3))) AS l FROM h),
v AS (SELECT L.series, l, any_value(L.n) AS n, sum(CASE WHEN k = 0 THEN p WHEN k <= l THEN 2 * (1 - k / (l + 1.0)) * p ELSE 0 END) / any_value(L.n) AS lr FROM L JOIN ac USING (series) GROUP BY 1, 2),
st AS (SELECT v.series, any_value(v.n) AS n, any_value(l) AS lags, sum(s * s) / (any_value(v.n) * any_value(v.n)) / any_value(lr) AS statistic FROM v JOIN c USING (series) GROUP BY 1)
SELECT *, CAST(statistic < 0.463 AS INT) AS stationary FROM st""")
def _(s, d):
    return dg.kpss(_shifted(s, d))


@query("d8_dickey_fuller", "series:s n:i slope:6 statistic:4 stationary:i", f"""WITH {b.SERIES}, x AS (SELECT series, y - lag(y) OVER (PARTITION BY series ORDER BY ds) AS dy, lag(y) OVER (PARTITION BY series ORDER BY ds) AS l FROM series),
g AS (SELECT series, count(*) AS n, regr_slope(dy, l) AS slope, regr_sxx(dy, l) AS sxx, regr_syy(dy, l) AS syy, regr_sxy(dy, l) AS sxy FROM x WHERE l IS NOT NULL GROUP BY 1),
t AS (SELECT series, n, slope, slope / sqrt((syy - slope * sxy) / (n - 2) / sxx) AS statistic FROM g) SELECT *, CAST(statistic < -2.86 AS INT) AS stationary FROM t""")
def _(s, d):
    return dg.dickey_fuller(b.series(s, d))


@query("d9_acf", "series:s n:i k:i acf:6 band:6 significant:i", f"""WITH {b.SERIES}, e AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ds) AS i, count(*) {_P} AS n, y - avg(y) {_P} AS e FROM series),
ac AS (SELECT a.series, a.n, a.i - b.i AS k, sum(a.e * b.e) AS p FROM e a JOIN e b ON a.series = b.series AND b.i <= a.i AND b.i >= a.i - 40 GROUP BY 1, 2, 3),
r AS (SELECT series, n, k, p / max(CASE WHEN k = 0 THEN p END) OVER (PARTITION BY series) AS acf, 1.96 / sqrt(n) AS band FROM ac) SELECT *, CAST(abs(acf) > band AS INT) AS significant FROM r""")
def _(s, d):
    return dg.acf(b.series(s, d))


@query("d10_pacf", "series:s k:i pacf:6", f"""WITH RECURSIVE {b.SERIES}, e AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ds) AS i, count(*) {_P} AS n, y - avg(y) {_P} AS e FROM series),
ac AS (SELECT a.series, a.n, a.i - b.i AS k, sum(a.e * b.e) AS c FROM e a JOIN e b ON a.series = b.series AND b.i <= a.i AND b.i >= a.i - 40 GROUP BY 1, 2, 3),
v AS (SELECT series, list(c / c0 * n / (n - k) ORDER BY k) FILTER (k > 0) AS r FROM (SELECT *, max(c) FILTER (k = 0) OVER (PARTITION BY series) AS c0 FROM ac) WHERE k <= least(40, greatest(1, n // 2 - 1)) GROUP BY 1),
rec AS (SELECT series, 1 AS k, r, [r[1]] AS phi, r[1] AS p FROM v UNION ALL SELECT series, k + 1, r, list_append([phi[j] - last * phi[k + 1 - j] FOR j IN range(1, k + 1)], last), last
  FROM (SELECT *, (r[k + 1] - list_sum([phi[j] * r[k + 1 - j] FOR j IN range(1, k + 1)])) / (1 - list_sum([phi[j] * r[j] FOR j IN range(1, k + 1)])) AS last FROM rec WHERE k < len(r)))
SELECT series, k, p AS pacf FROM rec""")
def _(s, d):
    """Partial autocorrelations, 40 lags."""
    return dg.pacf(b.series(s, d))


@query("d10_pacf_first_three", "series:s k:i pacf:6", f"""WITH {b.SERIES}, e AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ds) AS i, count(*) {_P} AS n, y - avg(y) {_P} AS e FROM series),
ac AS (SELECT a.series, a.n, a.i - b.i AS k, sum(a.e * b.e) / (a.n - (a.i - b.i)) AS p FROM e a JOIN e b ON a.series = b.series AND b.i <= a.i AND b.i >= a.i - 3 GROUP BY 1, 2, 3),
r AS (SELECT series, max(p) FILTER (k = 1) / max(p) FILTER (k = 0) AS r1, max(p) FILTER (k = 2) / max(p) FILTER (k = 0) AS r2, max(p) FILTER (k = 3) / max(p) FILTER (k = 0) AS r3 FROM ac GROUP BY 1)
SELECT series, 1 AS k, r1 AS pacf FROM r UNION ALL SELECT series, 2, (r2 - r1*r1) / (1 - r1*r1) FROM r
UNION ALL SELECT series, 3, (r3 - 2*r1*r2 + pow(r1, 3) + r1*r2*r2 - r1*r1*r3) / (1 - 2*r1*r1 - r2*r2 + 2*r1*r1*r2) FROM r""")
def _(s, d):
    return dg.pacf(b.series(s, d), 3)


@query("d11_distribution_stats", "series:s n:i mean:4 std:4 skewness:6 kurtosis_excess:6 jb:3 jb_p:6 normal:i", f"""WITH {b.SERIES}, m AS (SELECT series, count(*) AS n, avg(y) AS mean, stddev_samp(y) AS std FROM series GROUP BY 1),
k AS (SELECT series, n, mean, std, avg(pow((y - mean) / std, 3)) AS skewness, avg(pow((y - mean) / std, 4)) - 3 AS kurtosis_excess FROM series JOIN m USING (series) GROUP BY ALL),
j AS (SELECT *, n / 6.0 * (skewness * skewness + kurtosis_excess * kurtosis_excess / 4) AS jb FROM k) SELECT *, exp(-jb / 2) AS jb_p, CAST(exp(-jb / 2) >= 0.05 AS INT) AS normal FROM j""")
def _(s, d):
    return dg.distribution_stats(b.series(s, d))


_QQ = f"""{b.SERIES}, o AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY y, ds) AS i, count(*) {_P} AS n, (y - avg(y) {_P}) / stddev_samp(y) {_P} AS z FROM series),
o2 AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM o), qq AS (SELECT series, ds, y, i, n, z, {ppf_sql('p')} AS theoretical, i / n AS ecdf, {cdf_sql('z')} AS normal_cdf FROM o2)"""


@query("d12_qq_points", "series:s ds:d i:i theoretical:6 ecdf:6 normal_cdf:6", f"WITH {_QQ} SELECT * FROM qq")
def _(s, d):
    return dg.qq_points(b.series(s, d))


_T75 = ppf_sql("CAST(0.75 AS DOUBLE)")


@query("d12_qq_summary", "series:s slope:4 intercept:4 r_squared:6 ks_distance:6", f"""WITH {_QQ}, q AS (SELECT series, (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / (2 * {_T75}) AS slope, quantile_cont(y, 0.25) AS a FROM qq GROUP BY 1),
l AS (SELECT series, slope, a + slope * {_T75} AS intercept FROM q)
SELECT series, slope, intercept, 1 - sum(pow(y - (slope * theoretical + intercept), 2)) / (var_pop(y) * count(*)) AS r_squared, max(abs(ecdf - normal_cdf)) AS ks_distance FROM qq JOIN l USING (series) GROUP BY 1, 2, 3""")
def _(s, d):
    return dg.qq_summary(dg.qq_points(b.series(s, d)))


_K2 = dg.k2_sql("n", "g1", "g2")


@query("d13_normality_tests", "series:s n:i ad:4 ad_critical:3 ad_normal:i k2:2 k2_p:6", f"""WITH {_QQ}, mo AS (SELECT series, count(*) AS n, avg(y) AS mu, stddev_pop(y) AS sp FROM series GROUP BY 1),
g AS (SELECT series, any_value(n) AS n, avg(pow((y - mu) / sp, 3)) AS g1, avg(pow((y - mu) / sp, 4)) - 3 AS g2 FROM series JOIN mo USING (series) GROUP BY 1),
k AS (SELECT series, pow({_K2['z_skew']}, 2) + pow({_K2['z_kurt']}, 2) AS k2 FROM g),
a AS (SELECT series, n, -n - sum((2*i - 1) * ln(greatest(normal_cdf, 1e-300)) + (2*(n + 1 - i) - 1) * ln(greatest({cdf_sql('(-z)')}, 1e-300))) / n AS ad FROM qq GROUP BY 1, 2)
SELECT series, n, ad, round(0.787 / (1 + 4.0/n - 25.0/(n*n)), 3) AS ad_critical, CAST(ad < round(0.787 / (1 + 4.0/n - 25.0/(n*n)), 3) AS INT) AS ad_normal, k2, exp(-k2/2) AS k2_p FROM a JOIN k USING (series)""")
def _(s, d):
    return dg.normality_tests(b.series(s, d))


_SW = dg.shapiro_sql()


@query("d13_shapiro_wilk", "series:s n:i w:6 p_value:6 normal:i", f"""WITH {b.SERIES}, r AS (SELECT series, y, row_number() OVER (PARTITION BY series ORDER BY y, ds) AS i, count(*) {_P} AS total FROM series),
m AS (SELECT *, CASE WHEN i * 2 > total THEN {ppf_sql("((i - 0.375) / (total + 0.25))")} ELSE -{ppf_sql("((total + 1 - i - 0.375) / (total + 0.25))")} END AS m FROM r),
g AS (SELECT series, CAST(any_value(total) AS DOUBLE) AS n, sum(m * m) AS mm, sum(m * y) AS xm, max(m) AS m1, max(m) FILTER (i = total - 1) AS m2, max(y) - min(y) AS xe1, max(y) FILTER (i = total - 1) - max(y) FILTER (i = 2) AS xe2, var_pop(y) * count(*) AS ss FROM m GROUP BY 1),
a AS (SELECT *, {_SW["a1"]} AS a1, {_SW["a2"]} AS a2 FROM g), w AS (SELECT *, {_SW["w"]} AS w FROM a), z AS (SELECT *, {_SW["z"]} AS z FROM w)
SELECT series, n, w, 1 - {cdf_sql("z")} AS p_value, CAST(1 - {cdf_sql("z")} >= 0.05 AS INT) AS normal FROM z""")
def _(s, d):
    return dg.shapiro_wilk(b.series(s, d))


@query("d14_zero_runs", "series:s start_ds:d end_ds:d days:i", f"""WITH {b.SERIES}, z AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - row_number() OVER (PARTITION BY series, y = 0 ORDER BY ds) AS g FROM series)
SELECT series, min(ds) AS start_ds, max(ds) AS end_ds, count(*) AS days FROM z WHERE y = 0 GROUP BY series, g HAVING count(*) >= 2""")
def _(s, d):
    return dg.zero_runs(b.series(s, d))


_REP = "rep AS (SELECT DISTINCT o_orderpriority || '/' || (o_custkey % 40) AS series, CAST(o_orderdate AS DATE) AS ds FROM orders)"


@query("d15_date_gaps", "series:s from_ds:d to_ds:d days:i", f"WITH {_REP}, g AS (SELECT series, lag(ds) OVER (PARTITION BY series ORDER BY ds) AS from_ds, ds AS to_ds FROM rep) SELECT *, date_diff('day', from_ds, to_ds) AS days FROM g WHERE date_diff('day', from_ds, to_ds) > 4")
def _(s, d):
    o = b.table(s, d, "orders").select(F.concat(F.col("o_orderpriority"), F.lit("/"), (F.col("o_custkey") % 40).cast("string")).alias("series"), F.to_date("o_orderdate").alias("ds"))
    return dg.date_gaps(o)


@query("d16_zero_share", "series:s n:i zeros:i zero_pct:4 flagged:i", f"WITH {b.SERIES} SELECT series, count(*) AS n, count(*) FILTER (y = 0) AS zeros, 100.0 * count(*) FILTER (y = 0) / count(*) AS zero_pct, CAST(100.0 * count(*) FILTER (y = 0) / count(*) > 30 AS INT) AS flagged FROM series GROUP BY 1")
def _(s, d):
    return dg.zero_share(b.series(s, d))


@query("d17_seasonal_decompose", "series:s ds:d trend:4 seasonal:4 resid:4", f"""WITH {b.INDEXED}, x AS (SELECT series, ds, y, i - 1 AS i, n FROM idx), t0 AS (SELECT *, CASE WHEN i >= 2 AND i < n - 2 THEN avg(y) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS t FROM x),
ln AS (SELECT series, regr_slope(t, i) FILTER (i >= 2 AND i < 7) AS k0, regr_intercept(t, i) FILTER (i >= 2 AND i < 7) AS b0, regr_slope(t, i) FILTER (i >= n - 8 AND i < n - 3) AS k1, regr_intercept(t, i) FILTER (i >= n - 8 AND i < n - 3) AS b1 FROM t0 GROUP BY 1),
tr AS (SELECT series, ds, y, i, CASE WHEN i < 2 THEN k0 * i + b0 WHEN i > n - 3 THEN k1 * i + b1 ELSE t END AS trend FROM t0 JOIN ln USING (series)),
ph AS (SELECT series, i % 5 AS p, avg(y - trend) AS m FROM tr GROUP BY 1, 2), ce AS (SELECT series, avg(m) AS c FROM ph GROUP BY 1)
SELECT series, ds, trend, m - c AS seasonal, y - trend - (m - c) AS resid FROM tr JOIN ph ON ph.series = tr.series AND ph.p = i % 5 JOIN ce ON ce.series = tr.series""".replace("SELECT series, ds, trend, m - c AS", "SELECT tr.series, ds, trend, m - c AS"))
def _(s, d):
    return dg.seasonal_decompose(b.series(s, d), 5)


@query("d18_external_contract_check", "rule:s kind:s count:i", """WITH sheet AS (SELECT o_orderkey AS rn, CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS ds FROM orders),
m AS (SELECT count(*) FILTER (ds IS NULL) AS bad, count(ds) - count(DISTINCT ds) AS dup, date_diff('day', min(ds), max(ds)) + 1 - count(DISTINCT ds) AS holes, date_diff('day', max(ds), DATE '2002-01-01') AS lag FROM sheet),
dn AS (SELECT count(*) AS down FROM sheet a JOIN sheet b ON b.rn = a.rn - 1 WHERE a.ds < b.ds)
SELECT * FROM (SELECT 'unparseable_dates' AS rule, 'error' AS kind, bad AS count FROM m UNION ALL SELECT 'duplicate_dates', 'error', dup FROM m UNION ALL SELECT 'columns_without_numbers', 'warning', 1
UNION ALL SELECT 'unsorted_dates', 'warning', down FROM dn UNION ALL SELECT 'missing_calendar_days', 'warning', holes FROM m UNION ALL SELECT 'ends_before_panel', 'warning', CASE WHEN lag > 30 THEN lag ELSE 0 END FROM m) WHERE count > 0""")
def _(s, d):
    sheet = b.table(s, d, "orders").select(F.col("o_orderkey").alias("rn"), F.when(F.col("o_orderkey") % 101 == 0, "??").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Tanggal"), "o_totalprice", "o_orderpriority")
    return dg.external_contract(sheet, "rn", "Tanggal", ["o_totalprice", "o_orderpriority"], F.lit("2002-01-01").cast("date"))


_LEAFY = f"{qe.PANEL_SIMPLE}, leaf AS (SELECT node AS series, ds, value AS y FROM panel WHERE node IN ({qe._LEAVES}))"


@query("d20_sign_polarity", "series:s nonzero:i polarity:i", f"""WITH {_LEAFY}, g AS (SELECT series, count(*) FILTER (y <> 0) AS nonzero, count(*) FILTER (y > 0) AS pos FROM leaf GROUP BY 1)
SELECT series, nonzero, CASE WHEN nonzero < 100 THEN 0 WHEN pos / nonzero >= 0.995 THEN 1 WHEN pos / nonzero <= 1 - 0.995 THEN -1 ELSE 0 END AS polarity FROM g""")
def _(s, d):
    return dg.sign_polarity(qe.leaf_panel(s, d).select(F.col("node").alias("series"), "ds", F.col("value").alias("y")))


_LATE = f"{b.SERIES}, late AS (SELECT series, ds, CASE WHEN series = '1-URGENT' AND ds < DATE '1996-01-15' THEN 0 WHEN series = '2-HIGH' AND ds < DATE '1995-03-01' THEN 0 ELSE y END AS y FROM series)"


def late_start(s, d):
    cut = lambda n, day: (F.col("series") == n) & (F.col("ds") < F.lit(day).cast("date"))
    return b.series(s, d).withColumn("y", F.when(cut("1-URGENT", "1996-01-15") | cut("2-HIGH", "1995-03-01"), 0.0).otherwise(F.col("y")))


_FIRST = f"{_LATE}, li AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i FROM late), lf AS (SELECT series, min(i) AS f FROM li WHERE y <> 0 GROUP BY 1), since AS (SELECT li.series, ds, y FROM li JOIN lf USING (series) WHERE f < 250 OR i >= f)"


@query("d21_from_first_report", "series:s n:i first_ds:d total:0", f"WITH {_FIRST} SELECT series, count(*) AS n, min(ds) AS first_ds, sum(y) AS total FROM since GROUP BY 1")
def _(s, d):
    return dg.from_first_report(late_start(s, d)).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min("ds").alias("first_ds"), F.sum("y").alias("total"))


@query("d22_series_descriptives", "series:s n:i mean:4 sd:4 median:4 zero_pct:4 skew:6 kurt:6 acf1:6", f"""WITH {_FIRST}, x AS (SELECT *, lag(y) OVER (PARTITION BY series ORDER BY ds) AS l FROM since), m AS (SELECT series, avg(y) AS mu, stddev_pop(y) AS sp FROM since GROUP BY 1)
SELECT series, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS sd, quantile_cont(y, 0.5) AS median, 100.0 * count(*) FILTER (y = 0) / count(*) AS zero_pct, avg(pow((y - mu) / sp, 3)) AS skew, avg(pow((y - mu) / sp, 4)) - 3 AS kurt, corr(y, l) AS acf1
FROM x JOIN m USING (series) GROUP BY 1""")
def _(s, d):
    return dg.series_descriptives(late_start(s, d))


@query("d23_zero_share_by_regime", "series:s first_ds:d zero_total:4 zero_since:4 zero_last:4", f"""WITH {_LATE}, li AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i, count(*) {_P} AS n FROM late), lf AS (SELECT series, min(i) AS f FROM li WHERE y <> 0 GROUP BY 1)
SELECT series, min(ds) FILTER (i = f) AS first_ds, 100.0 * avg(CAST(y = 0 AS INT)) AS zero_total, 100.0 * avg(CAST(y = 0 AS INT)) FILTER (i >= f) AS zero_since, 100.0 * avg(CAST(y = 0 AS INT)) FILTER (i >= n - 30) AS zero_last FROM li JOIN lf USING (series) GROUP BY 1""")
def _(s, d):
    return dg.zero_share_by_regime(late_start(s, d))


@query("d23_level_by_year", "series:s year:i mean_abs:4", f"WITH {_LATE} SELECT series, year(ds) AS year, avg(abs(y)) AS mean_abs FROM late GROUP BY 1, 2")
def _(s, d):
    return late_start(s, d).groupBy("series", F.year("ds").alias("year")).agg(F.avg(F.abs("y")).alias("mean_abs"))
