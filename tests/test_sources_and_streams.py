import datetime as dt

from pyspark.sql import functions as F

from millrace.sources import records as src
from millrace.streaming import jobs


def test_tolerant_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"url": "u1", "page_content": "x"}\n\n{"url": "u2", \nnot json\n[1]\n{"url": "u3", "extra": 5}\n')
    assert sorted(r.url for r in src.read_json_lines(spark, f"file://{path}").where("url is not null").collect()) == ["u1", "u3"]
    assert src.read_json_lines(spark, f"file://{tmp_path}/none.jsonl").count() == 0
    lines = spark.read.text(f"file://{path}")
    assert sorted(r.url for r in src.parse_json_lines(lines, "value", src.WEB_RECORD).collect()) == ["u1", "u3"]


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('[{"url": "u", "topics": ["a", "b"]}, {"url": "v"}]')
    assert [(r.url, r.topics) for r in src.read_manifest(spark, f"file://{path}").collect()] == [("u", ["a", "b"]), ("v", None)]
    assert src.read_manifest(spark, f"file://{tmp_path}/none.json").count() == 0


def test_sitemaps_nested_with_cycle(spark):
    index = "﻿<!-- c --><sitemapindex xmlns=\"http://x\"><sitemap><loc> s2 </loc></sitemap><sitemap><loc>s1</loc></sitemap></sitemapindex>"
    docs = spark.createDataFrame([("s1", index), ("s2", "<sitemapindex><loc>s3</loc></sitemapindex>"), ("s3", "<urlset><url><loc>p1</loc></url><url><loc>p2?a=1&amp;b=2</loc></url></urlset>"), ("s4", "<oops"), ("s5", None)], "url string, xml string")
    roots = spark.createDataFrame([("s1",), ("s4",), ("s5",)], "url string")
    assert sorted(map(tuple, src.crawl_sitemaps(docs, roots).collect())) == [("s1", "p1"), ("s1", "p2?a=1&b=2")]
    assert src.crawl_sitemaps(docs, roots, depth=1).count() == 0
    feed = "<rss><channel><link>no</link><item><title>t</title><link>a</link></item><item><link>b</link></item></channel></rss>"
    assert spark.createDataFrame([(feed,)], "x string").select(src.feed_links(F.col("x"))).first()[0] == ["a", "b"]


def test_rows_windows_and_unions(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.5)], "id int, name string, v double")
    assert [r.page_content for r in src.rows_as_text(df, ["name", "v"]).orderBy("id").collect()] == ["name: a", "v: 3.5"]
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 28),)], "t timestamp_ntz")
    got = src.sliding_windows(ts, "t", "30 seconds", "25 seconds").select(F.date_format("window_start", "ss")).collect()
    assert sorted(r[0] for r in got) == ["00", "25"]
    assert src.union_all(df, df.drop("v")).count() == 4


def test_append_twice_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "content_hash string, n int")
    store = f"file://{tmp_path}/store"
    assert src.append_new(df, store) == 2 and src.append_new(df, store) == 0 and spark.read.parquet(store).count() == 2


def test_stream_ingest_equals_batch_and_is_idempotent(spark, tmp_path):
    rows = [(i, f"u{i % 5}", "default", "słowo " * (40 * i)) for i in range(8)] + [(9, "u", None, None)]
    spark.createDataFrame(rows, "record_id long, url string, content_type string, page_content string").write.parquet(f"file://{tmp_path}/in")
    store = f"file://{tmp_path}/store"
    counts = []
    for n in range(2):
        stream = spark.readStream.schema("record_id long, url string, content_type string, page_content string").parquet(f"file://{tmp_path}/in")
        jobs.ingest_stream(stream, store, f"file://{tmp_path}/cp{n}").awaitTermination()
        counts.append(spark.read.parquet(store).count())
    assert counts[0] == counts[1] > 8


def test_thread_history_is_bounded_and_ordered(spark, tmp_path):
    for part, turns in enumerate(([3, 1, 2], list(range(4, 16)))):
        spark.createDataFrame([(k, t, f"{k}-{t}") for k in (1, 2) for t in turns if k == 1 or t < 3], "thread long, turn long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{part}")
    stream = spark.readStream.schema("thread long, turn long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    q = jobs.thread_history(stream, 4).writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(out).groupBy("thread").agg(F.max_by("history", "turns").alias("h"), F.max("turns").alias("n")).collect()
    assert {r.thread: (r.n, r.h) for r in last} == {1: (15, [f"1-{t}" for t in range(12, 16)]), 2: (2, ["2-1", "2-2"])}


def test_event_windows_equal_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(60)]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(f"file://{tmp_path}/in")
    got = jobs.run_to_table(spark, jobs.event_windows(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").collect()
    closed = max(r[0] for r in rows) - dt.timedelta(minutes=10)
    want = {}
    for t, k, v in rows:
        start = t.replace(minute=0)
        if start + dt.timedelta(hours=1) <= closed:
            n, s = want.get((start, k), (0, 0.0))
            want[start, k] = (n + 1, s + v)
    assert {(r.window_start, r.event_type): (r.events, r.value) for r in got} == want
