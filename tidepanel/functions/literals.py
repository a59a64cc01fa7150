"""Small literal tables as part of the plan (no Python rows, no RDD)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def values_sql(rows) -> str:
    """``VALUES`` text for a small literal table."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """``schema`` is a DDL list such as ``code int, name string``."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    cols = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    return spark.sql(f"SELECT {cols} FROM {values_sql(rows)} AS t({', '.join(n for n, _ in fields)})")
