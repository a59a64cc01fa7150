"""Article corpus: identity, business day, polarity and daily sentiment on the panel calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.align import ffill, roll_to_next_business_day

LOCAL_ZONE = "Asia/Jakarta"     # fixed value: the desk's zone
CUTOFF_HOUR = 16                # fixed value: local hour from which news belongs to the next day


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[\s\p{Z}]+", " "))


def article_uid(title: Column, day: Column, url: Column) -> Column:
    """sha1 of normalised title | day | url."""
    return F.sha1(F.concat_ws("|", normal_title(title), day, F.coalesce(url, F.lit(""))))


def business_date(ts: Column, cutoff: int = CUTOFF_HOUR) -> Column:
    """Local date, moved to the next day from the cutoff hour on; weekends stay."""
    local = F.from_utc_timestamp(ts, LOCAL_ZONE)
    return F.to_date(local + F.make_interval(hours=F.lit(24 - cutoff)))


def to_utc(text: Column, assume: str = LOCAL_ZONE) -> Column:
    """Mixed timestamp texts to UTC; the zone is assumed only where the text has none, garbage is NULL."""
    t = F.regexp_replace(F.trim(text), "/", "-")
    zoned = F.regexp_like(t, F.lit(r"(Z|[+-]\d{2}:?\d{2})$")) & F.regexp_like(t, F.lit(r"\d{2}:\d{2}"))
    plain = F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("dd-MM-yyyy HH:mm")))
    return F.when(zoned, F.try_to_timestamp(t)).otherwise(F.to_utc_timestamp(plain, assume))


def news_text(title: Column, description: Column, opening: int | None = None) -> Column:
    """``title. description``; NULL when empty.  The whole description counts unless ``opening`` limits its characters."""
    t, d = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(description, F.lit("")))
    joined = F.when(d != "", F.trim(F.concat(t, F.lit(". "), d if opening is None else F.substring(d, 1, opening)), F.lit(" ."))).otherwise(t)
    return F.nullif(joined, F.lit(""))


def feed_filter(df: DataFrame, countries: list[str], lo: str, hi: str, country: str = "country", ds: str = "ds") -> DataFrame:
    return df.filter(F.lower(F.trim(country)).isin([c.lower() for c in countries]) & F.col(ds).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def share_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per value and their share of all rows."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("t"))
    return g.join(F.broadcast(tot)).select(key, "n", (F.col("n") / F.col("t")).alias("share"))


def polarity_from_dist(dist: Column) -> dict[str, Column]:
    """P(positive) - P(negative) and the three shares from an array of (label, score)."""
    m = F.map_from_entries(F.transform(dist, lambda x: F.struct(F.lower(F.trim(x["label"])), x["score"])))
    share = lambda a, b: F.coalesce(m[a], m[b], F.lit(0.0))
    pos, neg, neu = share("positive", "label_0"), share("negative", "label_2"), share("neutral", "label_1")
    return {"polarity": pos - neg, "p_positive": pos, "p_negative": neg, "p_neutral": neu}


def argmax_label(pos: Column, neg: Column, neu: Column) -> tuple[Column, Column]:
    top = F.greatest(pos, neg, neu)
    return F.when(pos == top, "positive").when(neg == top, "negative").otherwise("neutral"), top


def needs_scoring(df: DataFrame, scorer: str) -> DataFrame:
    """Titled articles without a polarity or scored by something else."""
    return df.filter((F.length("title") > 0) & (F.col("polarity").isNull() | ~F.col("scorer").eqNullSafe(scorer)))


def daily_sentiment(df: DataFrame) -> DataFrame:
    return df.filter("polarity is not null").groupBy("business_date", "scorer").agg(
        F.count(F.lit(1)).alias("n_news"), F.avg("polarity").alias("polarity"))


def pivot_scorers(daily: DataFrame, scorers: list[str]) -> DataFrame:
    """One polarity and one count column per scorer."""
    aggs = []
    for s in scorers:
        hit = F.col("scorer") == s
        aggs += [F.max(F.when(hit, F.col("polarity"))).alias(f"sent_{s}_polaritas"), F.max(F.when(hit, F.col("n_news"))).alias(f"sent_{s}_n_berita")]
    return daily.groupBy("business_date").agg(*aggs)


def daily_complete(df: DataFrame) -> DataFrame:
    """Count and mean per day on a gap-free calendar: no news is count 0 and an unknown mean."""
    g = df.groupBy("ds").agg(F.count(F.lit(1)).alias("n_news"), F.avg("polarity").alias("polarity"))
    spine = g.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("ds"))
    return spine.join(g, "ds", "left").withColumn("n_news", F.coalesce("n_news", F.lit(0)))


def calendar_aggregate(daily: DataFrame, calendar: DataFrame, max_gap: int = 4) -> DataFrame:
    """Daily sentiment on the panel calendar: days off roll to the next business day, polarity is
    averaged, counts are summed, gaps are filled forward at most ``max_gap`` rows and never backward."""
    rolled = roll_to_next_business_day(daily.withColumnRenamed("business_date", "ds"), calendar, "ds")
    g = rolled.groupBy("scorer", "ds").agg(F.avg("polarity").alias("polarity"), F.sum("n_news").alias("n_news"))
    days = calendar.agg(F.collect_set("ds").alias("_d"))                      # one row: the calendar
    spine = daily.select("scorer").distinct().join(F.broadcast(days)).select("scorer", F.explode("_d").alias("ds"))
    full = spine.join(g, ["scorer", "ds"], "left").withColumn("n_news", F.coalesce("n_news", F.lit(0)))
    return full.withColumn("polarity", ffill(F.col("polarity"), ["scorer"], limit=max_gap))


def corpus_coverage(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("business_date").alias("year"), "source").agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct("business_date").alias("days"), F.count("polarity").alias("scored"))


def column_coverage(aligned: DataFrame, keys=("scorer",), value: str = "polarity", minimum: float = 60.0) -> DataFrame:
    """Filled days, their share, usability and first/last filled date per column."""
    has = F.col(value).isNotNull()
    return aligned.groupBy(*keys).agg(
        F.count_if(has).alias("filled"), F.count(F.lit(1)).alias("days"), F.round(100.0 * F.count_if(has) / F.count(F.lit(1)), 1).alias("pct"),
        (100.0 * F.count_if(has) / F.count(F.lit(1)) >= minimum).cast("int").alias("usable"),
        F.min(F.when(has, F.col("ds"))).alias("first_ds"), F.max(F.when(has, F.col("ds"))).alias("last_ds"))


def extract_titles(pages: DataFrame, html: str, patterns: list[str]) -> DataFrame:
    """Titles by the first pattern that matches a page; tags stripped, empty titles dropped."""
    found = None
    for p in patterns:
        hits = F.regexp_extract_all(F.col(html), F.lit(p), F.lit(1))
        hits = F.when(F.size(hits) > 0, hits)
        found = hits if found is None else F.coalesce(found, hits)
    t = pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("pos", "title"))
    return t.withColumn("title", F.trim(F.regexp_replace("title", r"<[^>]*>", ""))).filter("title <> ''")


def range_audit(feed: DataFrame, start: str, page_size: int, max_pages: int) -> DataFrame:
    """One row: did a capped feed reach the requested start day?"""
    return feed.agg(F.count(F.lit(1)).alias("items"), F.min("ds").alias("oldest")).select(
        "items", "oldest", (F.col("oldest") < F.lit(start).cast("date")).cast("int").alias("passed_start"),
        ((F.col("items") >= page_size * max_pages) & (F.col("oldest") >= F.lit(start).cast("date"))).cast("int").alias("cap_warning"))
