"""Article corpus rules on small hand-made inputs."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidepanel.operators import news, tables
from tidepanel.sources import files
from tidepanel.streaming import feed


@pytest.mark.parametrize("utc, day", [("2024-03-05 08:00:00", "2024-03-05"), ("2024-03-05 09:00:00", "2024-03-06"), ("2024-03-05 16:00:00", "2024-03-06"),
                                      ("2024-03-05 10:00:00", "2024-03-06"), ("2024-03-05 17:00:00", "2024-03-06"), ("2024-03-06 08:59:59", "2024-03-06"), ("2024-03-08 10:00:00", "2024-03-09")])
def test_cutoff(spark, utc, day):
    got = spark.range(1).select(news.business_date(F.lit(utc).cast("timestamp")).alias("d")).first().d
    assert str(got) == day


def test_cutoff_agrees_with_tumbling_window(spark):
    df = spark.range(0, 24 * 14).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("published_utc"), F.lit("s").alias("scorer"), F.lit(0.5).alias("polarity"))
    a = {(str(r.business_date), r.n_news) for r in feed.business_day_tumbling(df).collect()}
    b = {(str(r.business_date), r.n_news) for r in news.daily_sentiment(df.withColumn("business_date", news.business_date(F.col("published_utc")))).collect()}
    assert a == b


def test_to_utc(spark):
    rows = [("2024-03-05T10:00:00Z", "2024-03-05 10:00:00"), ("2024-03-05 10:00:00", "2024-03-05 03:00:00"), ("2024-03-05T10:00:00+07:00", "2024-03-05 03:00:00"), ("tomorrow", None), (None, None), ("2024-03-05", "2024-03-04 17:00:00")]
    got = spark.createDataFrame(rows, "t string, want string").select(F.date_format(news.to_utc(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def test_uid(spark):
    base = ("Rupiah  Menguat", "2024-03-05", "u1")
    variants = [(" rupiah menguat ", "2024-03-05", "u1", True), ("RUPIAH\tMENGUAT", "2024-03-05", "u1", True), ("Rupiah Menguat", "2024-03-05", "u2", False), ("Rupiah Menguat", "2024-03-06", "u1", False), ("Rupiah Melemah", "2024-03-05", "u1", False)]
    u = news.article_uid
    df = spark.createDataFrame(variants, "t string, d string, u string, same boolean")
    ref = u(F.lit(base[0]), F.lit(base[1]), F.lit(base[2]))
    assert df.filter((u(F.col("t"), F.col("d"), F.col("u")) == ref) != F.col("same")).count() == 0


def _batch(spark, rows):
    return spark.createDataFrame(rows, "uid string, n int, title string, polarity double")


def test_upsert_rules(spark):
    batch = _batch(spark, [("a", 1, "x", None), ("a", 2, "x", None), ("b", 3, "", None), ("c", 4, None, 0.3), ("d", 5, "  ", None)])
    empty = _batch(spark, [])
    first = tables.upsert_articles(empty, batch, ["n"])
    assert sorted((r.uid, r.n) for r in first.collect()) == [("a", 1), ("c", 4)]
    assert tuple(tables.upsert_counts(empty, batch).first()) == (2, 2, 0)
    scored = tables.write_scores(first, spark.createDataFrame([("a", 0.9)], "uid string, polarity double"), "uid", ["polarity"])
    again = tables.upsert_articles(scored, _batch(spark, [("a", 9, "x", None), ("e", 10, "y", None)]), ["n"])
    assert sorted((r.uid, r.n, r.polarity) for r in again.collect()) == [("a", 1, 0.9), ("c", 4, 0.3), ("e", 10, None)]
    assert tuple(tables.upsert_counts(scored, batch).first()) == (2, 0, 2)


def test_needs_scoring(spark):
    df = spark.createDataFrame([("t", None, None), ("t", "m1", 0.2), ("t", "m2", 0.2), ("", "m2", None), (None, None, None)], "title string, scorer string, polarity double")
    assert news.needs_scoring(df, "m1").count() == 2


def _dates(spark, days):
    return spark.createDataFrame([(dt.date.fromisoformat(x),) for x in days], "ds date")


def test_weekend_rolls_to_monday(spark):
    daily = spark.createDataFrame([("2024-01-05", "g", 10, 0.1), ("2024-01-06", "g", 2, 0.5), ("2024-01-07", "g", 2, 0.7), ("2024-01-08", "g", 8, 0.3)], "d string, scorer string, n_news int, polarity double").select(F.col("d").cast("date").alias("business_date"), "scorer", "n_news", "polarity")
    got = {str(r.ds): (r.n_news, r.polarity) for r in news.calendar_aggregate(daily, _dates(spark, ["2024-01-05", "2024-01-08", "2024-01-09"])).collect()}
    assert got["2024-01-08"][0] == 12 and got["2024-01-08"][1] == pytest.approx(0.5)
    assert got["2024-01-09"] == (0, pytest.approx(0.5)) and got["2024-01-05"] == (10, pytest.approx(0.1))


def test_fill_limit_and_coverage(spark):
    days = [str(dt.date(2024, 1, 1) + dt.timedelta(i)) for i in range(28)]
    cal = _dates(spark, [x for x in days if dt.date.fromisoformat(x).weekday() < 5])
    daily = spark.createDataFrame([("2024-01-02", "g", 3, 0.4)], "d string, scorer string, n_news int, polarity double").select(F.col("d").cast("date").alias("business_date"), "scorer", "n_news", "polarity")
    out = news.calendar_aggregate(daily, cal, 4)
    assert out.filter("polarity is not null").count() == 5                # the day itself and four more
    assert out.filter("polarity is not null and ds < date'2024-01-02'").count() == 0
    c = news.column_coverage(out).first()
    assert (c.filled, c.days, c.pct, c.usable) == (5, 20, 25.0, 0)


def test_days_past_the_calendar_drop(spark):
    from tidepanel.operators.align import roll_to_next_business_day

    got = roll_to_next_business_day(_dates(spark, ["2024-01-06", "2024-01-09", "2023-12-30"]), _dates(spark, ["2024-01-05", "2024-01-08"]), "ds")
    assert sorted(str(r.ds) for r in got.collect()) == ["2024-01-05", "2024-01-08"]


def test_text_and_feed_filter(spark):
    rows = [("Head", "Body", "Head. Body"), ("Head", "", "Head"), ("", "", None), ("H", "x" * 400, "H. " + "x" * 400), (None, "Only", "Only")]
    got = spark.createDataFrame(rows, "t string, d string, want string").select(news.news_text(F.col("t"), F.col("d")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got
    assert spark.range(1).select(news.news_text(F.lit("H"), F.lit("x" * 400), 300)).first()[0] == "H. " + "x" * 300
    f = spark.createDataFrame([("Indonesia", "2024-01-05"), ("indonesia ", "2024-02-05"), ("Japan", "2024-01-05")], "country string, d string").select("country", F.col("d").cast("date").alias("ds"))
    assert news.feed_filter(f, ["INDONESIA"], "2024-01-01", "2024-01-31").count() == 1


@pytest.mark.parametrize("start, pages, passed, warned", [("2024-01-03", 1, 1, 0), ("2023-12-01", 1, 0, 1), ("2023-12-01", 9, 0, 0)])
def test_range_audit(spark, start, pages, passed, warned):
    r = news.range_audit(_dates(spark, ["2024-01-01", "2024-01-02", "2024-01-05"]), start, 3, pages).first()
    assert (r.passed_start, r.cap_warning) == (passed, warned)


def test_archive(spark, tmp_path):
    def line(tone, a="IDN", b="USA", g="X", n=58):
        c = ["-"] * n
        c[0], c[1] = "1", "20240105"
        if n == 58:
            c[7], c[17], c[34], c[53], c[57] = a, b, tone, g, "u"
        return "\t".join(c)

    (tmp_path / "f.tsv").write_text("\n".join([line("5"), line("-250"), line(""), line("1", "USA", "USA", "IDN"), line("1", "USA"), line("3", n=12)]))
    got = sorted(r.polarity for r in files.read_event_archive(spark, str(tmp_path), ["IDN"]).collect())
    assert got == [-1.0, 0.1, 0.5]
    v = files.validate_archive_schema(files.read_archive_raw(spark, str(tmp_path))).first()
    assert (v.n_columns, v.n, v.valid) == (58, 5, 0) and v.min_tone == -250


def test_polarity_label_aliases(spark):
    d = spark.sql("select array(named_struct('label', ' LABEL_0', 'score', 0.7D), named_struct('label', 'Negative', 'score', 0.2D)) as d")
    r = d.select(*[c.alias(n) for n, c in news.polarity_from_dist(F.col("d")).items()]).first()
    assert (r.polarity, r.p_neutral) == (pytest.approx(0.5), 0.0)


def test_ingest_is_idempotent_and_keeps_late_articles(spark, tmp_path):
    land, store = str(tmp_path / "land"), str(tmp_path / "store")
    rows = [("2024-01-01 08:00:00", "a", 1), ("2024-01-01 10:00:00", "a", 2), ("2024-01-03 08:00:00", "b", 3)]
    late = [("2024-01-01 07:00:00", "late", 4), ("2024-01-01 08:00:00", "a", 5)]

    def chunk(rs):
        df = spark.createDataFrame(rs, "t string, title string, event_id int").select(F.col("t").cast("timestamp").alias("published_utc"), "title", "event_id", F.lit(0.1).alias("polarity"))
        return df.withColumn("uid", news.article_uid(F.col("title"), F.date_format("published_utc", "yyyy-MM-dd"), F.lit("u"))).withColumn("business_date", news.business_date(F.col("published_utc")))

    for i, rs in enumerate((rows, late)):
        chunk(rs).write.mode("append").parquet(land)
        feed.ingest_feed(feed.read_feed(spark, land, chunk(rs).schema), store, str(tmp_path / "ck"), ["published_utc", "event_id"])
    feed.ingest_feed(feed.read_feed(spark, land, chunk(rows).schema), store, str(tmp_path / "ck2"), ["published_utc", "event_id"])
    got = sorted((r.title, str(r.business_date), r.event_id) for r in spark.read.parquet(store).collect())
    assert got == [("a", "2024-01-01", 1), ("b", "2024-01-03", 3), ("late", "2024-01-01", 4)]


def test_dates_before_the_calendar_roll_to_its_first_day(spark):
    from tidepanel.operators import align

    calendar = spark.createDataFrame([(dt.date(2024, 3, d),) for d in (4, 5, 8)], "ds date")
    rows = [(dt.date(2024, 1, 1), 1), (dt.date(2024, 2, 20), 2), (dt.date(2024, 3, 4), 3), (dt.date(2024, 3, 6), 4), (dt.date(2024, 3, 9), 5), (None, 6)]
    got = {r.v: str(r.ds) for r in align.roll_to_next_business_day(spark.createDataFrame(rows, "ds date, v int"), calendar, "ds").collect()}
    assert got == {1: "2024-03-04", 2: "2024-03-04", 3: "2024-03-04", 4: "2024-03-08"}


def test_feed_columns_are_checked_over_all_records(spark, tmp_path):
    a, b = files.FEED_COLUMNS[:2]
    (tmp_path / "lines.json").write_text(f'{{"{a}": "2024-01-02"}}\n{{"{a}": "2024-01-03", "{b}": "05 x"}}\n')
    with pytest.raises(ValueError, match=files.FEED_COLUMNS[2]):
        files.read_flows_json(spark, str(tmp_path / "lines.json"))
    (tmp_path / "rows.xml").write_text(f"<result><rows><row><{a}>2024-01-02</{a}><{b}>05 x</{b}></row></rows></result>")
    with pytest.raises(ValueError, match=files.FEED_COLUMNS[2]):
        files.read_flows_xml(spark, str(tmp_path / "rows.xml"))
    many = tmp_path / "many"
    many.mkdir()
    for i in range(20):                                     # the amount is there in one file of twenty
        amount = f', "{files.FEED_COLUMNS[2]}": "7"' if i == 13 else ""
        (many / f"{i}.json").write_text(f'[{{"{a}": "2024-01-02", "{b}": "05 x"{amount}}}]')
    rows = files.read_flows_json(spark, str(many), multi_line=True).collect()
    assert len(rows) == 20 and [r.volume for r in rows if r.volume is not None] == [7.0]


def test_first_numeric_column_is_the_value(spark, tmp_path):
    (tmp_path / "p.csv").write_text('date,name,close,open\n2024-01-02,x,"1,200.5",9\n2024-01-03,y,3,9\n2024-01-02,z,4,9\n')
    assert {(str(r.ds), r.value) for r in files.read_two_column_series(spark, str(tmp_path / "p.csv")).collect()} == {("2024-01-02", 4.0), ("2024-01-03", 3.0)}
    (tmp_path / "q.csv").write_text("date,name\n2024-01-02,x\n")
    with pytest.raises(ValueError, match="numbers"):
        files.read_two_column_series(spark, str(tmp_path / "q.csv"))


ARTICLE = "uid string, event_id int, published_utc timestamp, title string, polarity double, scorer string"


def _land(spark, path, rows):
    spark.createDataFrame([(u, i, dt.datetime.fromisoformat(t), "t", p, "s") for u, i, t, p in rows], ARTICLE).coalesce(1).write.mode("append").parquet(path)


def _feed_of(spark, path, rows):
    _land(spark, str(path), rows)
    return feed.read_feed(spark, str(path), ARTICLE)


def test_late_rows_are_kept_and_repeats_are_not(spark, tmp_path):
    landing, store, table = (str(tmp_path / x) for x in ("landing", "store", "table"))
    order = ["published_utc", "event_id"]
    for rows in ([("a", 1, "2024-03-05T01:00:00", 0.5)], [("b", 2, "2024-03-25T01:00:00", 0.1)], [("a", 3, "2024-03-05T01:00:00", 0.9), ("c", 4, "2024-03-05T02:00:00", 0.7), ("d", 5, "2024-02-01T10:00:00", 0.2)]):
        _land(spark, landing, rows)
        feed.stream_dedup(feed.read_feed(spark, landing, ARTICLE), store, str(tmp_path / "ck"), order)
        feed.tumbling_from_store(feed.read_feed(spark, landing, ARTICLE), str(tmp_path / "store2"), table, str(tmp_path / "ck2"), order)
    assert sorted(r.uid for r in spark.read.parquet(store).collect()) == ["a", "b", "c", "d"]
    got = {(str(r.business_date), r.n_news, round(r.polarity, 6)) for r in feed.latest_revision(spark, table, ["business_date", "scorer"]).collect()}
    assert got == {("2024-03-05", 2, 0.6), ("2024-03-25", 1, 0.1), ("2024-02-02", 1, 0.2)}


def test_a_batch_is_counted_without_the_rows_of_the_store(spark, tmp_path, monkeypatch):
    landing, store, table, ck = (str(tmp_path / x) for x in ("landing", "store", "table", "ck"))
    feed.stream_dedup(_feed_of(spark, tmp_path / "old", [("old", 0, "2024-03-05T00:30:00", 0.1), ("none", 9, "2024-03-05T00:40:00", None)]), store, str(tmp_path / "ck0"), ["event_id"])
    counted, real = [], feed._day_sums
    monkeypatch.setattr(feed, "_day_sums", lambda df, *a: counted.append(df.count()) or real(df, *a))
    chunks = [[("a", 1, "2024-03-05T01:00:00", 0.5), ("b", 2, "2024-03-05T10:00:00", 0.25)], [("a", 3, "2024-03-05T01:00:00", 0.9)], [("c", 4, "2024-03-05T02:00:00", 0.75)]]
    for rows in chunks:
        _land(spark, landing, rows)
        feed.tumbling_from_store(feed.read_feed(spark, landing, ARTICLE), store, table, ck, ["event_id"])
    assert counted == [2, 2, 0, 1]                          # the store of before once, then new rows only
    want = {("2024-03-05", 3, 0.45), ("2024-03-06", 1, 0.25)}
    read = lambda: {(str(r.business_date), r.n_news, round(r.polarity, 6)) for r in feed.latest_revision(spark, table, ["business_date", "scorer"]).collect()}
    assert read() == want
    feed.tumbling_from_store(feed.read_feed(spark, landing, ARTICLE), store, table, str(tmp_path / "ck2"), ["event_id"])          # all pulled again by another stream
    assert read() == want


@pytest.mark.parametrize("when", ["rows", "revision"])
def test_a_replayed_batch_is_counted_once(spark, tmp_path, monkeypatch, when):
    landing, store, table, ck = (str(tmp_path / x) for x in ("landing", "store", "table", "ck"))
    pull = lambda: feed.tumbling_from_store(feed.read_feed(spark, landing, ARTICLE), store, table, ck, ["event_id"])
    _land(spark, landing, [("a", 1, "2024-03-05T01:00:00", 0.5)])
    pull()
    _land(spark, landing, [("b", 2, "2024-03-05T02:00:00", 0.25), ("a", 3, "2024-03-05T01:00:00", 0.9)])
    once, real = feed._write_once, feed._means

    def stop(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:                         # either before the rows are stored or after
        m.setattr(feed, "_write_once", lambda s, path, rows: once(s, path, rows) or (stop() if path.endswith("batch=1") else None)) if when == "rows" else m.setattr(feed, "_means", stop)
        with pytest.raises(StreamingQueryException):
            pull()
    assert spark.read.parquet(store).count() == (1 if when == "rows" else 2) and feed._means is real
    pull()
    assert sorted(r.uid for r in spark.read.parquet(store).collect()) == ["a", "b"]
    assert [(r.n_news, r.polarity) for r in feed.latest_revision(spark, table, ["business_date", "scorer"]).collect()] == [(2, 0.375)]


def test_ingest_reads_only_the_days_of_a_batch(spark, tmp_path, monkeypatch):
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    _land(spark, landing, [(f"u{d}", d, f"2024-03-{d:02d}T01:00:00", 0.5) for d in range(1, 20)])
    feed.ingest_feed(feed.read_feed(spark, landing, ARTICLE), store, str(tmp_path / "ck"), ["event_id"])
    seen = []
    real = feed._stored

    def watched(s, path):
        df = real(s, path)
        if df is not None:
            original = df.filter
            monkeypatch.setattr(df, "filter", lambda c: seen.append(original(c)) or seen[-1], raising=False)
        return df

    monkeypatch.setattr(feed, "_stored", watched)
    _land(spark, landing, [("u5", 99, "2024-03-05T01:00:00", 0.5), ("new", 100, "2024-03-06T01:00:00", 0.5)])
    feed.ingest_feed(feed.read_feed(spark, landing, ARTICLE), store, str(tmp_path / "ck"), ["event_id"])
    text = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [published_day" in text and spark.read.parquet(store).count() == 20
    assert len(seen[0].inputFiles()) >= 2 and seen[0].select("published_day").distinct().count() == 2


def test_a_cluster_needs_a_shared_folder():
    from tidepanel import session

    class Context:
        master = "local-cluster[2,1,1024]"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
