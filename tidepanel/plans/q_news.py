"""Article corpus, event archive, stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import news, tables
from tidepanel.plans import base as b
from tidepanel.plans.registry import query
from tidepanel.session import scratch_path
from tidepanel.sources import files

SCORERS = ["click", "error", "purchase", "signup", "view"]
_WS = r"[\s\p{{Z}}]+"
_UID = "sha1(trim(regexp_replace(lower(coalesce({t}, '')), '" + _WS + "', ' ', 'g')) || '|' || {d} || '|' || coalesce({u}, ''))"
ART = f"""{b.ARTICLES}, art AS (SELECT *, {_UID.format(t='title', d="strftime(published_utc, '%Y-%m-%d')", u='url')} AS uid,
  CAST(published_utc + INTERVAL 15 HOUR AS DATE) AS business_date FROM articles)"""


def art(s, d):
    a = b.articles(s, d)
    return (a.withColumn("uid", news.article_uid(F.col("title"), F.date_format("published_utc", "yyyy-MM-dd"), F.col("url")))
             .withColumn("business_date", news.business_date(F.col("published_utc"))))


# --- event archive -----------------------------------------------------------------------------------------
_CTRY = ["IDN", "USA", "SGP", "JPN", "AUS"]
_ARCH = f"""arch AS (SELECT event_id, ts, k, list_extract({_CTRY}, CAST(user_id % 5 + 1 AS INT)) AS ca, list_extract({_CTRY}, CAST((user_id + event_id) % 5 + 1 AS INT)) AS cb,
  list_extract({_CTRY}, CAST(event_id % 5 + 1 AS INT)) AS cg, '/e/' || CAST(user_id AS VARCHAR) AS url,
  CASE WHEN k % 13 = 0 OR k % 17 = 0 THEN NULL ELSE round_even((value - 10) * 8, 0) / 8 END AS tone
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) WHERE k % 19 <> 0)"""


def _archive(s, d):
    e = b.table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda x: F.element_at(F.array(*[F.lit(c) for c in _CTRY]), (x % 5 + 1).cast("int"))
    tone = F.when(k % 13 == 0, F.lit("")).when(k % 17 == 0, F.lit("n.a.")).otherwise((F.rint((F.col("value") - 10) * 8) / 8).cast("string"))
    cells = {0: F.col("event_id").cast("string"), 1: F.date_format("ts", "yyyyMMdd"), 7: pick(F.col("user_id")), 17: pick(F.col("user_id") + F.col("event_id")),
             34: tone, 53: pick(F.col("event_id")), 57: F.concat(F.lit("/e/"), F.col("user_id").cast("string"))}
    full = F.concat_ws("\t", *[cells.get(i, F.lit("-")) for i in range(files.ARCHIVE_WIDTH)])
    path = scratch_path(s, "archive")
    e.select(F.when(k % 19 == 0, F.concat_ws("\t", cells[0], cells[1], F.lit("broken"))).otherwise(full).alias("value")).write.text(path)
    return path


@query("s7_read_event_archive", "event_id:i ds:d polarity:6 url:s", f"""WITH {_ARCH} SELECT event_id, CAST(ts AS DATE) AS ds, greatest(-1.0, least(1.0, tone / 10)) AS polarity, url
FROM arch WHERE tone IS NOT NULL AND (ca IN ('IDN','SGP') OR cb IN ('IDN','SGP') OR cg IN ('IDN','SGP'))""")
def _(s, d):
    return files.read_event_archive(s, _archive(s, d), ["IDN", "SGP"])


@query("s8_validate_archive_schema", "n_columns:i n:i bad_share:6 min_tone:4 max_tone:4 valid:i", f"""WITH {_ARCH} SELECT 58 AS n_columns, count(*) AS n, avg(CASE WHEN tone IS NULL THEN 1 ELSE 0 END) AS bad_share,
min(tone) AS min_tone, max(tone) AS max_tone, CAST(avg(CASE WHEN tone IS NULL THEN 1 ELSE 0 END) <= 0.5 AND min(tone) >= -100 AND max(tone) <= 100 AS INT) AS valid FROM arch""")
def _(s, d):
    return files.validate_archive_schema(files.read_archive_raw(s, _archive(s, d)))


_PATTERNS = [r"<h2[^>]*>\s*<a[^>]*>(.*?)</a>", r"<h1[^>]*>(.*?)</h1>", r"<title[^>]*>(.*?)</title>"]
_HITS = ", ".join(f"CASE WHEN len(regexp_extract_all(html, '{p}', 1)) > 0 THEN regexp_extract_all(html, '{p}', 1) END" for p in _PATTERNS)


@query("s10_extract_titles", "page_id:i title:s", f"""SELECT page_id, title FROM (SELECT page_id, trim(regexp_replace(unnest(coalesce({_HITS})), '<[^>]*>', '', 'g'), ' ') AS title FROM pages) WHERE title <> ''""")
def _(s, d):
    return news.extract_titles(b.table(s, d, "pages").select("page_id", "html"), "html", _PATTERNS)


# --- article store -----------------------------------------------------------------------------------------

_STORE = f"""{ART}, ok AS (SELECT * FROM art WHERE trim(title) <> '' OR polarity IS NOT NULL),
store AS (SELECT * FROM ok WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY event_id) = 1),
batch AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY uid ORDER BY event_id) = 1)"""


def _store(s, d):
    a = art(s, d)
    return tables.dedupe(tables.accepted_articles(a.filter("event_id % 3 = 0")), ["uid"], ["event_id"]), a


@query("s14_upsert_articles", "uid:s event_id:i source:s polarity:6", f"WITH {_STORE} SELECT uid, event_id, source, polarity FROM store UNION ALL SELECT uid, event_id, source, polarity FROM batch WHERE uid NOT IN (SELECT uid FROM store)")
def _(s, d):
    st, a = _store(s, d)
    return tables.upsert_articles(st, a, ["event_id"])


@query("s14_upsert_counts", "accepted:i new:i duplicate:i", f"""WITH {_STORE} SELECT count(*) AS accepted, count(*) FILTER (uid NOT IN (SELECT uid FROM store)) AS "new", count(*) FILTER (uid IN (SELECT uid FROM store)) AS duplicate FROM batch""")
def _(s, d):
    return tables.upsert_counts(*_store(s, d))


@query("p8_article_uid", "doc_id:i uid:s", f"""SELECT doc_id, {_UID.format(t='text', d="strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INT), '%Y-%m-%d')", u='source')} AS uid FROM documents""")
def _(s, d):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
    return b.table(s, d, "documents").select("doc_id", news.article_uid(F.col("text"), day, F.col("source")).alias("uid"))


@query("p9_to_utc", "event_id:i utc:t", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN sec WHEN 1 THEN sec - INTERVAL 7 HOUR WHEN 2 THEN sec - INTERVAL 7 HOUR
WHEN 3 THEN date_trunc('minute', sec) - INTERVAL 7 HOUR END AS utc FROM (SELECT event_id, date_trunc('second', ts) AS sec FROM events)""")
def _(s, d):
    e, f = b.table(s, d, "events"), lambda p: F.date_format("ts", p)
    m = F.col("event_id") % 5
    text = (F.when(m == 0, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(m == 1, f("yyyy-MM-dd HH:mm:ss"))
            .when(m == 2, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00"))).when(m == 3, f("dd/MM/yyyy HH:mm")).otherwise(F.lit("soon")))
    return e.select("event_id", news.to_utc(text).alias("utc"))


@query("p10_business_date", "event_id:i business_date:d", f"WITH {ART} SELECT event_id, business_date FROM art")
def _(s, d):
    return art(s, d)


@query("p11_news_text", "doc_id:i n_chars:i digest:s", r"""WITH t AS (SELECT doc_id, trim(coalesce(source, ''), ' ') AS a, trim(coalesce(CASE WHEN doc_id % 7 <> 0 THEN text END, ''), ' ') AS x FROM documents),
u AS (SELECT doc_id, CASE WHEN x <> '' THEN trim(a || '. ' || x, ' .') ELSE a END AS body FROM t)
SELECT doc_id, length(body) AS n_chars, md5(body) AS digest FROM u WHERE body <> ''""")
def _(s, d):
    t = b.table(s, d, "documents").select("doc_id", news.news_text(F.col("source"), F.when(F.col("doc_id") % 7 != 0, F.col("text"))).alias("body"))
    return t.filter("body is not null").select("doc_id", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


@query("p12_country_date_filter", "source:s n:i share:6", f"""WITH {ART}, f AS (SELECT * FROM art WHERE lower(trim(source)) IN ('src1','src4','src6') AND business_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')
SELECT source, count(*) AS n, count(*) / (SELECT count(*) FROM f) AS share FROM f GROUP BY 1""")
def _(s, d):
    return news.share_by(news.feed_filter(art(s, d), ["SRC1", "src4", "Src6"], "2024-01-05", "2024-01-20", "source", "business_date"), "source")


_DIST_SQL = """dist AS (SELECT event_id, k / 256.0 AS a, (100 - k) / 512.0 AS c, (value - floor(value)) AS n, event_id % 3 AS m FROM
 (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
pol AS (SELECT event_id, a AS p_positive, CASE WHEN m = 2 THEN 0 ELSE c END AS p_negative, n AS p_neutral FROM dist)"""


def _dist(s, d):
    e = b.table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    lab = lambda a, x, y: F.when(F.col("event_id") % 3 == 0, a).when(F.col("event_id") % 3 == 1, x).otherwise(y)
    pair = lambda l, v: F.struct(l.alias("label"), v.cast("double").alias("score"))
    dist = F.array(pair(lab("Positive", " LABEL_0 ", "positive"), k / 256.0), pair(lab("negative", "label_2", "unknown"), (100 - k) / 512.0),
                   pair(lab("NEUTRAL", "Label_1", "neutral"), F.col("value") - F.floor("value")))
    p = news.polarity_from_dist(F.col("dist"))
    return e.select("event_id", dist.alias("dist")).select("event_id", *[c.alias(n) for n, c in p.items()])


@query("p13_polarity_from_dist", "event_id:i polarity:6 p_positive:6 p_negative:6 p_neutral:6", f"WITH {_DIST_SQL} SELECT *, p_positive - p_negative AS polarity FROM pol")
def _(s, d):
    return _dist(s, d)


@query("p14_argmax_label", "event_id:i label:s score:6", f"""WITH {_DIST_SQL} SELECT event_id, CASE WHEN p_positive >= p_negative AND p_positive >= p_neutral THEN 'positive'
WHEN p_negative >= p_neutral THEN 'negative' ELSE 'neutral' END AS label, greatest(p_positive, p_negative, p_neutral) AS score FROM pol""")
def _(s, d):
    lab, top = news.argmax_label(F.col("p_positive"), F.col("p_negative"), F.col("p_neutral"))
    return _dist(s, d).select("event_id", lab.alias("label"), top.alias("score"))


@query("p15_needs_scoring", "event_id:i scorer:s", f"WITH {ART} SELECT event_id, scorer FROM art WHERE length(title) > 0 AND (polarity IS NULL OR scorer IS DISTINCT FROM 'view')")
def _(s, d):
    return news.needs_scoring(art(s, d), "view")


# --- daily sentiment -----------------------------------------------------------------------------------------

_DAILY = f"{ART}, daily AS (SELECT business_date, scorer, count(*) AS n_news, avg(polarity) AS polarity FROM art WHERE polarity IS NOT NULL GROUP BY 1, 2)"


@query("a9_daily_sentiment", "business_date:d scorer:s n_news:i polarity:6", f"WITH {_DAILY} SELECT * FROM daily")
def _(s, d):
    return news.daily_sentiment(art(s, d))


@query("r3_pivot_scorers", "business_date:d " + " ".join(f"sent_{x}_polaritas:6 sent_{x}_n_berita:i" for x in SCORERS), f"""WITH {_DAILY}
SELECT business_date, {', '.join(f"max(polarity) FILTER (scorer='{x}') AS sent_{x}_polaritas, max(n_news) FILTER (scorer='{x}') AS sent_{x}_n_berita" for x in SCORERS)} FROM daily GROUP BY 1""")
def _(s, d):
    return news.pivot_scorers(news.daily_sentiment(art(s, d)), SCORERS)


@query("a10_daily_news_complete", "ds:d n_news:i polarity:6", f"""WITH {ART}, g AS (SELECT business_date AS ds, count(*) AS n_news, avg(polarity) AS polarity FROM art GROUP BY 1)
SELECT c.ds, coalesce(n_news, 0) AS n_news, polarity FROM (SELECT CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM g) c LEFT JOIN g USING (ds)""")
def _(s, d):
    return news.daily_complete(art(s, d).withColumnRenamed("business_date", "ds"))


# Panel calendar: weekdays of the news span without a long holiday block.
_CAL = """cal AS (SELECT DISTINCT business_date AS ds FROM art WHERE isodow(business_date) < 6 AND business_date NOT BETWEEN DATE '2024-01-15' AND DATE '2024-01-17')"""
_THIN = f"thin AS (SELECT * FROM daily WHERE scorer <> 'error' OR business_date < DATE '2024-01-08')"
_ALIGN = f"""{_DAILY}, {_CAL}, {_THIN},
rolled AS (SELECT t.scorer, c.ds, avg(t.polarity) AS polarity, sum(t.n_news) AS n_news FROM thin t ASOF JOIN cal c ON t.business_date <= c.ds GROUP BY 1, 2),
spine AS (SELECT ds, scorer FROM cal CROSS JOIN (SELECT DISTINCT scorer FROM thin)),
aligned AS (SELECT s.scorer, s.ds, coalesce(n_news, 0) AS n_news,
  last_value(polarity IGNORE NULLS) OVER (PARTITION BY s.scorer ORDER BY s.ds ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS polarity FROM spine s LEFT JOIN rolled USING (scorer, ds))"""


def aligned(s, d):
    a = art(s, d)
    cal = a.select(F.col("business_date").alias("ds")).distinct().filter((F.weekday("ds") < 5) & ~F.col("ds").between(F.lit("2024-01-15").cast("date"), F.lit("2024-01-17").cast("date")))
    daily = news.daily_sentiment(a).filter((F.col("scorer") != "error") | (F.col("business_date") < F.lit("2024-01-08").cast("date")))
    return news.calendar_aggregate(daily, cal)


@query("a11_calendar_aggregate", "scorer:s ds:d n_news:i polarity:6", f"WITH {_ALIGN} SELECT * FROM aligned")
def _(s, d):
    return aligned(s, d)


@query("w26_ffill_with_limit", "scorer:s ds:d polarity:6", f"WITH {_ALIGN} SELECT scorer, ds, polarity FROM aligned")
def _(s, d):
    return aligned(s, d)


@query("a12_corpus_coverage", "year:i source:s articles:i days:i scored:i", f"WITH {ART} SELECT year(business_date) AS year, source, count(*) AS articles, count(DISTINCT business_date) AS days, count(polarity) AS scored FROM art GROUP BY 1, 2")
def _(s, d):
    return news.corpus_coverage(art(s, d))


@query("a13_column_coverage", "scorer:s filled:i days:i pct:1 usable:i first_ds:d last_ds:d", f"""WITH {_ALIGN} SELECT scorer, count(polarity) AS filled, count(*) AS days, round(100.0 * count(polarity) / count(*), 1) AS pct,
CAST(100.0 * count(polarity) / count(*) >= 60 AS INT) AS usable, min(ds) FILTER (polarity IS NOT NULL) AS first_ds, max(ds) FILTER (polarity IS NOT NULL) AS last_ds FROM aligned GROUP BY 1""")
def _(s, d):
    return news.column_coverage(aligned(s, d))


@query("t5_range_audit", "items:i oldest:d passed_start:i cap_warning:i", """SELECT count(*) AS items, min(CAST(ts AS DATE)) AS oldest, CAST(min(CAST(ts AS DATE)) < DATE '2023-12-01' AS INT) AS passed_start,
CAST(count(*) >= 100 AND min(CAST(ts AS DATE)) >= DATE '2023-12-01' AS INT) AS cap_warning FROM events""")
def _(s, d):
    return news.range_audit(b.table(s, d, "events").select(F.to_date("ts").alias("ds")), "2023-12-01", 20, 5)
