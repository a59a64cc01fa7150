"""File sources and sinks: coded feeds, ledgers, wide panels, archives, two-column series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the coded feed.
FEED_COLUMNS = ("TANGGAL_LAPORAN", "TUJUAN_TRANSAKSI", "VOLUME_NETT_RIBU_USD")
_FEED_SCHEMA = ", ".join(f"{c} string" for c in FEED_COLUMNS)


def require_columns(df: DataFrame, needed) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def _typed_feed(df: DataFrame) -> DataFrame:
    d, p, v = FEED_COLUMNS
    return require_columns(df, FEED_COLUMNS).select(
        F.col(d).try_cast("date").alias("ds"), F.col(p).cast("string").alias("purpose"), F.col(v).try_cast("double").alias("volume"))


def read_flows_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Coded feed as JSON records; amounts that do not parse become NULL.

    JSON lines split across tasks; ``multi_line`` reads one array per file.  The names are those of all records, so a
    column that only some files have counts as present and one that none has is an error."""
    require_columns(spark.read.json(path, multiLine=multi_line, primitivesAsString=True), FEED_COLUMNS)
    return _typed_feed(spark.read.schema(_FEED_SCHEMA).json(path, multiLine=multi_line))


def read_flows_xml(spark: SparkSession, path: str) -> DataFrame:
    """``<result><rows><row>`` feed, one record per ``row`` element; a column that no record has is an error."""
    require_columns(spark.read.format("xml").option("rowTag", "row").option("inferSchema", False).load(path), FEED_COLUMNS)
    return _typed_feed(spark.read.format("xml").option("rowTag", "row").schema(_FEED_SCHEMA).load(path))


def write_feed(df: DataFrame, path: str, fmt: str) -> None:
    """(ds, purpose, volume) written in the feed's own column names."""
    d, p, v = FEED_COLUMNS
    out = df.select(F.date_format("ds", "yyyy-MM-dd").alias(d), F.col("purpose").alias(p), F.col("volume").cast("string").alias(v))
    w = out.write.mode("errorifexists")
    if fmt == "xml":
        w.format("xml").option("rootTag", "rows").option("rowTag", "row").save(path)
    else:
        w.json(path)


def read_entity_ledgers(spark: SparkSession, paths: dict[str, str], width: int = 47) -> DataFrame:
    """One positional table per entity: columns become x1..xN, x1 a date, the rest whole numbers."""
    out = None
    schema = ", ".join(f"x{i} string" for i in range(1, width + 1))
    for entity, path in paths.items():
        raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=True)
        typed = raw.select(F.col("x1").try_cast("date").alias("x1"),
                           *[F.rint(F.coalesce(F.col(f"x{i}").try_cast("double"), F.lit(0.0))).alias(f"x{i}") for i in range(2, width + 1)],
                           F.lit(entity).alias("entity"))
        out = typed if out is None else out.unionByName(typed)
    return out


def extract_block(df: DataFrame, row_col: str, first_row: int, date_col: str, columns: list[str]) -> DataFrame:
    """Rectangular block of a raw sheet: rows from ``first_row``, listed columns, empty rows dropped,
    the date coerced and flagged where it does not parse."""
    ds = F.col(date_col).try_cast("date")
    return (df.filter(F.col(row_col) >= first_row).select(row_col, date_col, *columns)
              .dropna("all", subset=[date_col, *columns])
              .withColumn("ds", ds).withColumn("bad_date", (F.col(date_col).isNotNull() & ds.isNull()).cast("int")))


def read_panel(spark: SparkSession, path: str, meta=("node",)) -> DataFrame:
    """Wide CSV panel (meta columns + one column per day) to long (node, ds, value)."""
    wide = spark.read.csv(path, header=True)
    days = [c for c in wide.columns if c not in meta]
    cells = F.expr("map_from_arrays(split('" + ",".join(days) + "', ','), array(" + ",".join(f"`{d}`" for d in days) + "))")
    return wide.select(*meta, F.explode(cells).alias("d", "v")).select(
        *meta, F.col("d").cast("date").alias("ds"), F.col("v").try_cast("double").alias("value"))


def panel_wide(panel: DataFrame, labels: list[str], column: str = "ds", meta=("node",)) -> DataFrame:
    """Long panel to one column per label, sorted by node (the table has one row per node)."""
    return panel.groupBy(*meta).pivot(column, labels).agg(F.first("value")).orderBy(*meta)


def write_panel_wide(panel: DataFrame, path: str, meta=("node",)) -> None:
    """Wide CSV: meta columns, then one column per day in order.

    The day columns live in one array cell until the line is written, so the plan does not grow
    with the calendar; the day list (the header) is the only thing read back to the driver."""
    days = [r[0] for r in panel.select(F.date_format("ds", "yyyy-MM-dd").alias("d")).distinct().orderBy("d").toLocalIterator()]
    grid = panel.select(*meta).distinct().select(*meta, F.explode(F.split(F.lit(",".join(days)), ",")).alias("d"))
    cell = grid.join(panel.select(*meta, F.date_format("ds", "yyyy-MM-dd").alias("d"), F.col("value").cast("string").alias("v")), [*meta, "d"], "left")
    rows = cell.groupBy(*meta).agg(F.sort_array(F.collect_list(F.struct("d", F.coalesce("v", F.lit("")).alias("v")))).alias("c")).orderBy(*meta)
    line = F.concat_ws(",", *meta, F.transform("c", lambda x: x["v"]))
    rows.select(line.alias(",".join([*meta, *days]))).write.csv(path, header=True, sep="\x01", escapeQuotes=False)


# Positions used in the 58-column event archive (0-based).
ARCHIVE_WIDTH = 58
ARCHIVE_FIELDS = {"event_id": 0, "day": 1, "country_a": 7, "country_b": 17, "tone": 34, "country_geo": 53, "url": 57}


def read_archive_raw(spark: SparkSession, path: str) -> DataFrame:
    """58 tab-separated text columns; lines of another width are skipped."""
    schema = ", ".join(f"c{i} string" for i in range(ARCHIVE_WIDTH))
    return spark.read.schema(schema).option("columnPruning", False).csv(path, sep="\t", mode="DROPMALFORMED", quote="")


def read_event_archive(spark: SparkSession, path: str, countries: list[str]) -> DataFrame:
    """Records touching any listed country, with the tone scaled by 1/10 and clipped to [-1, 1]."""
    raw = read_archive_raw(spark, path)
    f = {k: F.col(f"c{i}") for k, i in ARCHIVE_FIELDS.items()}
    hit = f["country_a"].isin(countries) | f["country_b"].isin(countries) | f["country_geo"].isin(countries)
    tone = f["tone"].try_cast("double")
    return (raw.filter(hit & tone.isNotNull())
               .select(f["event_id"].try_cast("bigint").alias("event_id"), F.try_to_date(f["day"], "yyyyMMdd").alias("ds"),
                       F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tone / 10)).alias("polarity"), f["url"].alias("url")))


def validate_archive_schema(raw: DataFrame, max_bad_share: float = 0.5, bound: float = 100.0) -> DataFrame:
    """One row: column count, share of unreadable tones, tone range and the verdict."""
    tone = F.col(f"c{ARCHIVE_FIELDS['tone']}").try_cast("double")
    m = raw.agg(F.count(F.lit(1)).alias("n"), F.avg(tone.isNull().cast("int")).alias("bad_share"),
                F.min(tone).alias("min_tone"), F.max(tone).alias("max_tone"))
    ok = (F.lit(len(raw.columns) == ARCHIVE_WIDTH) & (F.col("bad_share") <= max_bad_share)
          & (F.coalesce(F.col("min_tone"), F.lit(0.0)) >= -bound) & (F.coalesce(F.col("max_tone"), F.lit(0.0)) <= bound))
    return m.select(F.lit(len(raw.columns)).alias("n_columns"), "*", F.coalesce(ok, F.lit(False)).cast("int").alias("valid"))


def read_two_column_series(spark: SparkSession, path: str) -> DataFrame:
    """First column a date, the first column after it that holds numbers (thousands commas allowed) the value.

    The last duplicate of a day wins: by file, split of the file and place in the split (a split is read in order by
    one task, so ids grow within it)."""
    raw = spark.read.csv(path, header=True)
    d, rest = raw.columns[0], raw.columns[1:]
    if not rest:
        raise ValueError("at least two columns are needed: a date and a number")
    number = lambda c: F.regexp_replace(F.col(f"`{c}`"), ",", "").try_cast("double")
    found = raw.agg(*[F.count(number(c)).alias(f"_{i}") for i, c in enumerate(rest)]).first()
    v = next((c for i, c in enumerate(rest) if found[f"_{i}"]), None)
    if v is None:
        raise ValueError("no column but the first holds numbers")
    pos = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r"))
    typed = raw.select(F.col(f"`{d}`").try_cast("date").alias("ds"), number(v).alias("value"), pos.alias("pos"))
    return (typed.filter("ds is not null and value is not null")
                 .groupBy("ds").agg(F.max_by("value", "pos").alias("value")))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("tanggal string, nama string, kategori string").json(path, multiLine=True)
    return raw.select(F.col("tanggal").try_cast("date").alias("ds"), F.col("nama").alias("name"), F.col("kategori").alias("kind")).dropna(subset=["ds"])


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    item = "id string, period string, start_date string, end_date string, rdg_date string"
    raw = spark.read.schema(f"schedule array<struct<{', '.join(p.replace(' ', ': ', 1) for p in item.split(', '))}>>").json(path, multiLine=True)
    return raw.select(F.explode("schedule").alias("s")).select(
        "s.id", "s.period", F.col("s.start_date").cast("date").alias("start_date"), F.col("s.end_date").cast("date").alias("end_date"))
