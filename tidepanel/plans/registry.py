"""Registry of runnable queries and of the SQL each one is checked against.

A query names its output with a column spec: ``ds:d node:s n:i value:4`` means a date (shown as
text), a string, a 64-bit integer and a double rounded to four digits; ``value:L6`` shows the logarithm of one plus
the value's size, with its sign, to six digits: a relative comparison for values of any size.  The same projection is put
around the Spark result and around the SQL so both sides have one schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.literals import values_sql  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark_col(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind[0] == "L":
        x = c.cast("double")
        return (F.round(F.signum(x) * F.ln(1 + F.abs(x)), int(kind[1:])) + F.lit(0.0)).alias(name)
    return (F.round(c.cast("double"), int(kind)) + F.lit(0.0)).alias(name)


def _sql_col(name: str, kind: str) -> str:
    c = f'"{name}"'
    body = {
        "d": f"strftime(CAST({c} AS DATE), '%Y-%m-%d')",
        "t": f"strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')",
        "s": f"CAST({c} AS VARCHAR)",
        "i": f"CAST({c} AS BIGINT)",
        "L": f"round(sign(CAST({c} AS DOUBLE)) * ln(1 + abs(CAST({c} AS DOUBLE))), {kind[1:]}) + 0.0",
    }.get("L" if kind[0] == "L" else kind) or f"round(CAST({c} AS DOUBLE), {kind}) + 0.0"
    return f"{body} AS {c}"


def query(name: str, cols: str, sql: str | None = None):
    spec = [c.rsplit(":", 1) for c in cols.split()]

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir).select(*[_spark_col(n, k) for n, k in spec])

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"SELECT {', '.join(_sql_col(n, k) for n, k in spec)} FROM (\n{sql.strip()}\n) AS q"
        return fn

    return register
