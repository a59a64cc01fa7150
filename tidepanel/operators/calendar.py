"""Business-day arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "2000-01-03"     # a Monday


def date_array(days: list[str]) -> Column:
    return F.array(*[F.lit(d).cast("date") for d in days]) if days else F.array().cast("array<date>")


def is_business_day(d: Column, holidays: Column) -> Column:
    return (F.weekday(d) < 5) & ~F.array_contains(holidays, d)


def future_business_days(df: DataFrame, last: str, n: int, holidays: list[str]) -> DataFrame:
    """The next n business days after a row's last date, numbered from 1."""
    span = math.ceil(n * 7 / 5) + 7 + 2 * len(holidays)
    hol = date_array(holidays)
    cand = F.filter(F.sequence(F.date_add(last, 1), F.date_add(last, span)), lambda d: is_business_day(d, hol))
    return (df.select("*", F.posexplode(F.slice(cand, 1, n)).alias("h", "ds")).withColumn("h", F.col("h") + 1))


def business_day_spine(df: DataFrame, lo: str, hi: str) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.col(lo), F.col(hi))).alias("ds")).filter(F.weekday("ds") < 5)


def busday_index(d: Column) -> Column:
    """Business days from the epoch Monday up to (excluding) the date; before it, minus those after
    the date up to and including the epoch."""
    epoch = F.lit(EPOCH).cast("date")

    def count(days):
        rem = F.pmod(days, F.lit(7))
        return (days - rem) / 7 * 5 + F.least(rem, F.lit(5))

    days = F.datediff(d, epoch)
    return F.when(days >= 0, count(days)).otherwise(count(days + 1) - 1).cast("double")


def _wave(x: Column, period: float):
    a = F.lit(2 * math.pi) * x / F.lit(float(period))
    return F.sin(a), F.cos(a)


def calendar_features(d: Column, week_length: int = 5) -> dict[str, Column]:
    dow, mon = F.weekday(d).cast("double"), F.month(d).cast("double")
    ds, dc = _wave(dow, week_length)
    ms, mc = _wave(mon, 12)
    return {"day_of_week": dow, "month": mon, "week_of_year": F.weekofyear(d).cast("double"),
            "day_of_week_sin": ds, "day_of_week_cos": dc, "month_sin": ms, "month_cos": mc,
            "is_weekend": (dow >= 5).cast("double")}


def calendar_flags(d: Column) -> dict[str, Column]:
    return {"day": F.dayofmonth(d), "quarter": F.quarter(d),
            "is_month_start": (F.dayofmonth(d) == 1).cast("int"), "is_month_end": (d == F.last_day(d)).cast("int"),
            "is_quarter_start": (d == F.trunc(d, "quarter")).cast("int"), "is_quarter_end": (d == quarter_end(d)).cast("int")}


def quarter_end(d: Column) -> Column:
    return F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)


def period_end_features(d: Column) -> dict[str, Column]:
    me, qe = F.datediff(F.last_day(d), d).cast("double"), F.datediff(quarter_end(d), d).cast("double")
    return {"days_until_month_end": me, "days_until_quarter_end": qe,
            "is_near_month_end": (me <= 5).cast("double"), "is_near_quarter_end": (qe <= 10).cast("double")}


def holiday_features(d: Column, holidays: list[str], default: float = 30.0) -> dict[str, Column]:
    """Holiday flag and calendar days to the next and from the previous one (the holiday list is a small table)."""
    hol = date_array(holidays)
    nxt = F.array_min(F.filter(hol, lambda h: h > d))
    prv = F.array_max(F.filter(hol, lambda h: h < d))
    return {"is_holiday": F.array_contains(hol, d).cast("double"),
            "days_to_holiday": F.coalesce(F.datediff(nxt, d).cast("double"), F.lit(default)),
            "days_from_holiday": F.coalesce(F.datediff(d, prv).cast("double"), F.lit(default))}


def fourier_features(d: Column) -> dict[str, Column]:
    i, out = busday_index(d), {}
    for name, p in (("weekly", 5), ("monthly", 20), ("quarterly", 60)):
        out[f"fourier_{name}_sin"], out[f"fourier_{name}_cos"] = _wave(i, p)
    return out
