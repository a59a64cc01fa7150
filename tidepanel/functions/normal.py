"""Normal distribution as SQL text, so that one formula serves every engine it runs on."""

from __future__ import annotations

from pyspark.sql import functions as F

# Published rational approximations of the normal distribution function and its inverse.
_CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)


def _num(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _poly(coefs, x: str) -> str:
    out = _num(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {_num(c)})"
    return out


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    tail = (f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN exp(-{a}*{a}/2) * {_poly(_CDF_NUM, a)} / {_poly(_CDF_DEN, a)} "
            f"ELSE exp(-{a}*{a}/2) / ({a} + 1/({a} + 2/({a} + 3/({a} + 4/({a} + 0.65))))) / 2.506628274631 END")
    return f"(CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE ({tail}) END)"


def ppf_sql(p: str) -> str:
    q = f"sqrt(-2 * ln({p}))"
    q2 = f"sqrt(-2 * ln(1 - {p}))"
    m = f"({p} - 0.5)"
    r = f"({m} * {m})"
    return (f"(CASE WHEN {p} < 0.02425 THEN {_poly(_PPF_C, q)} / {_poly(_PPF_D, q)} WHEN {p} > 0.97575 THEN -({_poly(_PPF_C, q2)}) / {_poly(_PPF_D, q2)} "
            f"ELSE {_poly(_PPF_A, r)} * {m} / {_poly(_PPF_B, r)} END)")


def two_sided_sql(z: str) -> str:
    return f"(2 * (1 - {cdf_sql(f'abs({z})')}))"


#: Degrees of freedom from which Student's t is taken from the normal distribution (its argument corrected; error < 1e-7).
T_AS_NORMAL = 4000


def t_two_sided_sql(t: str, nu: str) -> str:
    """Two-sided p of Student's t with whole degrees of freedom: 1 minus a finite series in cos^2 of atan(t / sqrt(nu))."""
    c2 = f"({nu} / ({nu} + {t} * {t}))"
    count = f"CAST({nu} div 2 AS INT)"
    sign = f"(CASE WHEN {nu} % 2 = 0 THEN -1 ELSE 0 END)"            # ratio of terms k, k - 1: (2k-1)/2k or 2k/(2k+1)
    terms = (f"CASE WHEN {count} > 1 THEN aggregate(sequence(1, {count} - 1), named_struct('term', 1D, 'sum', 1D), (s, k) -> named_struct("
             f"'term', s.term * {c2} * (2 * k + {sign}) / (2 * k + {sign} + 1), 'sum', s.sum + s.term * {c2} * (2 * k + {sign}) / (2 * k + {sign} + 1)), s -> s.sum) "
             f"ELSE CASE WHEN {count} = 1 THEN 1D ELSE 0D END END")
    sine = f"(abs({t}) / sqrt({nu} + {t} * {t}))"
    inside = f"CASE WHEN {nu} % 2 = 0 THEN {sine} * ({terms}) ELSE 2 / pi() * (atan(abs({t}) / sqrt({nu})) + {sine} * sqrt{c2} * ({terms})) END"
    z = f"(abs({t}) * (1 - 1 / (4 * CAST({nu} AS DOUBLE))) / sqrt(1 + {t} * {t} / (2 * CAST({nu} AS DOUBLE))))"
    return f"(CASE WHEN {nu} >= {T_AS_NORMAL} THEN {two_sided_sql(z)} WHEN {nu} >= 1 THEN greatest(0D, 1 - ({inside})) END)"


def cdf(column: str):
    return F.expr(cdf_sql(column))


def ppf(column: str):
    return F.expr(ppf_sql(column))


def corr_sql(x: str, y: str) -> str:
    """The same as text, over two column names."""
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) {both} * stddev_pop({y}) {both})"


def safe_corr(x, y):
    """Correlation aggregate that is NULL, not an error, for a constant side."""
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    a, b = F.when(both == 1, x), F.when(both == 1, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
