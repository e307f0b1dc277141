"""Queries over small tables of odd rows give what their SQL gives."""

import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from sparkloom.operators import imports
from sparkloom.plans import catalog, q_search, q_text


def check(spark, folder, name, **tables):
    """The query's rows over tables, each DataFrame stored below the folder, are those of its SQL."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df, want = catalog.QUERIES[name](spark, str(folder)), con.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = Counter(map(tuple, df.select(*want.columns).collect()))
    assert rows == Counter(want.fetchall())
    return rows


def test_titles_are_those_of_the_sql(spark, tmp_path):
    titles = ["token = &quot;5aa&quot;", "it&#39;s &apos;so&apos;", "a <b>bold</b>\n one", " \x0b a\x0b b ", "&amp;lt;p&amp;quot;", " &nbsp; ", "", "x&#39;  "]
    html = [f"<html><head><TITLE lang='en'>{t}</title></head><p>then</p></html>" for t in titles] + ["<p>then</p>", "", None]
    pages = spark.createDataFrame([(n, f"http://a/{n}", x) for n, x in enumerate(html)], "page_id long, url string, html string")
    check(spark, tmp_path, "page_title", pages=pages)
    check(spark, tmp_path, "doc_search", pages=pages)
    check(spark, tmp_path, "doc_search", pages=pages.where("page_id > 7").withColumn("url", F.concat("url", F.lit("/Then"))))


def test_watched_events_without_time_type_or_id(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 1, "a"), (2, "2024-01-01 00:20:00", 1, None), (3, None, 1, "b"), (4, "2024-01-01 01:00:00", 2, "a"), (None, "2024-01-01 02:00:00", 1, "c"), (9, "2024-01-01 02:00:00", 1, "d"), (5, "2024-01-01 02:30:00", 2, "a"), (6, "2024-01-01 03:59:59.999999", 2, None), (7, "2024-01-01 03:00:00", None, "a"), (8, "1969-12-31 22:30:00", 3, "a"), (10, "1969-12-31 23:30:00", 3, "b"), (11, "1969-12-31 22:59:59.9995", 4, "b"), (12, "2024-01-01 01:59:59.999499", 4, "b"), (13, "2024-01-01 01:59:59.9995", 5, "b")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = check(spark, tmp_path, "watch_diff", events=events)
    assert any(poll is None and kind == "deleted" for _, poll, kind in found)
    check(spark, tmp_path, "watch_diff", events=events.withColumn("ts", F.col("ts").cast("timestamp")))


def test_watched_hours_are_those_of_utc(spark, tmp_path):
    rows = [(n, f"2024-{m:02}-{day:02} {h:02}:15:00", n % 2, "ab"[n % 3 > 1]) for n, (m, day, h) in enumerate((m, day, h) for m in (3, 10) for day in (10, 27, 30, 31) for h in (0, 1, 2, 3))]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        check(spark, tmp_path, "watch_diff", events=events)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_searched_chunks_are_stored_without_their_texts(spark, tmp_path):
    draw = random.Random(3)
    texts = ["\n".join(" ".join(draw.choices(["cold", "widget", "red", *map(str, range(400))], k=draw.randint(1, 9))) for _ in range(40 * n)) for n in range(1, 8)]
    docs = spark.createDataFrame([(n, x, "en" if n % 2 else "fr", "web") for n, x in enumerate(texts, 1)] + [(8, None, "en", "web"), (9, "", "en", "web")], "doc_id long, text string, lang string, source string")
    events = spark.createDataFrame([(1, "2024-01-20 00:00:00.0005", 1), (2, "2024-01-30 00:00:00", 2), (3, None, 3), (4, "2024-01-10 00:00:00", None)], "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    items = spark.createDataFrame([(1, "cold widget"), (2, "red word3 doc3"), (3, "7 8 9 10")], "item_id long, text string")
    rows = check(spark, tmp_path, "semantic_search_all", documents=docs, events=events, benchmark=items)
    assert len({q for q, *_ in rows}) == 3
    stored = q_search._document_chunks(spark, str(tmp_path))
    assert "chunk" not in stored.columns and stored.where("modified is not null").select("path").distinct().count() == 2


def test_items_that_repeated_documents_cover(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red cold Widget"), (1, "cold red"), (2, None), (3, "fooBar baz"), (4, "bar"), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "bar bar foo"), (8, "cold cold red x"), (9, None), (10, "bar bar foo"), (11, "..")], "item_id long, text string")
    check(spark, tmp_path, "token_coverage", documents=docs, benchmark=items)


def test_pairs_of_documents_and_items_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_text, "_PAIRS", 3)
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("cold red").alias("text"))
    items = spark.createDataFrame([(7, "cold"), (8, "red x")], "item_id long, text string")
    check(spark, tmp_path, "token_coverage", documents=docs, benchmark=items)
    assert catalog.QUERIES["token_coverage"](spark, str(tmp_path)).rdd.getNumPartitions() >= 20


def test_statements_come_in_frames_of_bounded_size(spark):
    sizes = [len(f) for f in imports.frames(((n, "x") for n in range(2 * imports.FRAME_ROWS + 5)), ["n", "x"])]
    assert sizes == [imports.FRAME_ROWS, imports.FRAME_ROWS, 5] and not list(imports.frames(iter(()), ["n"]))
    many = spark.createDataFrame([("a.py", "\n".join(f"import m{n}" for n in range(5000))), ("b.py", ""), ("c.py", "import z")], "path string, content string")
    assert imports.python_imports(many).count() == 5001
