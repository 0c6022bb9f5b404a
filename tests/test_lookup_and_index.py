from pyspark.sql import functions as F

from millrace.functions import udtf
from millrace.operators import index, lookup, search


def test_metadata_last_entry_holds(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, source string")
    manifest = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "source string, pos int, author string")
    assert {r.id: r.author for r in lookup.with_metadata(rows, manifest, "source", "pos").collect()} == {1: "y", 2: None, 3: None}


def test_latest_known(spark):
    rows = spark.createDataFrame([(1, 2022), (2, 2099), (3, None), (4, 0)], "id long, year int")
    dim = spark.createDataFrame([(2022, 5.0), (2024, 7.0), (None, 9.0)], "year int, cap double")
    assert {r.id: r.cap for r in lookup.latest_known(rows, dim, "year", "cap").collect()} == {1: 5.0, 2: 7.0, 3: 7.0, 4: 7.0}
    assert {r.cap for r in lookup.latest_known(rows, dim.limit(0), "year", "cap").collect()} == {None}


def test_most_trusted_and_routes(spark):
    df = spark.createDataFrame([("s", 3, "blog"), ("s", 2, "law"), ("s", 1, None), ("t", 9, None), ("t", 4, "blog")], "source string, id long, kind string")
    assert {r.source: (r.id, r.trust) for r in lookup.most_trusted(df, "source", "kind", ["law", "gov"], "id").collect()} == {"s": (2, 1), "t": (4, 3)}
    q = spark.createDataFrame([("Jaka RATĘ mam?",), ("ratęx",), (None,)], "q string").select(*lookup.routes(F.col("q"), {"rate": ["ratę", "rata"]}))
    assert [r.rate for r in q.collect()] == [True, False, False]


def test_robots(spark):
    urls = spark.createDataFrame([(1, "https://a.example/x/1"), (2, "https://a.example/y"), (3, "https://b.example/x/"), (4, None)], "id long, url string")
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow:\nDisallow: /x/\n"), ("c.example", None)], "authority string, robots string")
    assert {r.id: r.allowed for r in lookup.crawlable(urls, robots).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_index_extends_to_the_same_result(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"rata kredytu bank {'obligacja ' * (i % 4)} słowo{i % 7}") for i in range(60)] + [(90, None), (91, "")], "id long, text string")
    q = spark.createDataFrame([(1, "obligacja słowo3"), (2, "nic takiego")], "qid long, q string")
    built = index.KeywordIndex(spark, f"file://{tmp_path}/ix").rebuild(docs.where("id < 30"), "id", "text").append(docs, "id", "text").append(docs, "id", "text")
    got = sorted((r.qid, r.rank, r.id) for r in built.search(q, "qid", "q", 5).collect())
    want = search.top(search.sparse_scores(docs, q, "id", "text", "qid", "q"), 5)
    assert got == sorted((r.qid, r.rank, r.id) for r in want.collect()) and len(got) == 5


def test_chunk_udtf(spark):
    udtf.register(spark)
    got = spark.sql("SELECT * FROM chunk_text('aa bb cc dd', 5, 0)").collect()
    assert [(r.chunk_index, r.chunk_total, r.chunk) for r in got] == [(0, 2, "aa bb"), (1, 2, "cc dd")] or len(got) >= 2
    assert spark.sql("SELECT * FROM chunk_text(CAST(NULL AS STRING), 5, 0)").count() == 0
