import hashlib

from pyspark.sql import types as T

from millrace.operators import chunking, lookup, pipeline, search
from millrace.sources import records as src

PAGE = '<a href="/a">x</a><a class="k" href="/b?utm_x=1">y</a><a href="/c/1">z</a><a href="https://other.example/q">o</a><a href="/a">x</a>'


def test_site_plan(spark):
    pages = spark.createDataFrame([("s", "https://h.example/p/", PAGE), ("s", "https://h.example/p2/", PAGE), (None, "https://h.example/", PAGE), ("t", None, PAGE), ("t", "https://t.example/", None)], "source_id string, url string, page_content string")
    seen = spark.createDataFrame([("https://h.example/a",), (None,)], "url string")
    found = pipeline.discovered(pages)
    got = {tuple(r) for r in pipeline.to_fetch(found, seen, ["utm_"]).collect()}
    assert got == {("s", "https://h.example/c/1", 1)}
    assert {r.url for r in pipeline.to_fetch(found, seen.limit(0), ["utm_"], 1).collect()} == {"https://h.example/a"}
    assert pipeline.to_fetch(found.limit(0), seen, []).count() == 0
    topics = spark.createDataFrame([(1, "Rata kredytu", ["RATA"]), (2, "Inne", ["rata"]), (3, None, ["rata"]), (4, "x", None), (5, "x", [])], "id long, title string, topics array<string>")
    assert {r.id for r in pipeline.about_topics(topics).collect()} == {1, 4, 5}


def test_ingest_against_brute_force(spark, tmp_path):
    rows = [(i, f"https://h.example/{i % 6}", "s" if i % 2 else None, "x", f"słowo{i % 4} " * (60 * (i % 5))) for i in range(24)] + [(99, None, "s", None, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, source string, content_type string, page_content string")
    store, known = f"file://{tmp_path}/store", set()
    for part in (df.where("record_id < 12"), df, df):
        want: dict[str, list[int]] = {}
        hashes = []
        for r in part.collect():
            for i, text in enumerate(chunking.split_text(r.page_content, 512, 64) if r.page_content and len(r.page_content.strip()) >= 5 else []):
                hashes.append((hashlib.sha256(f"{r.url or ''}{i}{text[:100]}".encode()).hexdigest(), r.source or "unknown"))
        first = {h: min(s for g, s in hashes if g == h) for h, _ in hashes}
        for h, s in hashes:
            want.setdefault(s, [0, 0])[0] += 1
        for h, s in first.items():
            want[s][1] += h not in known
        dry = {r.source: (r.chunks, r.new_chunks, r.duplicate_chunks) for r in pipeline.ingest(part, store, dry_run=True, least=5).collect()}
        wet = {r.source: (r.chunks, r.new_chunks, r.duplicate_chunks) for r in pipeline.ingest(part, store, least=5).collect()}
        assert dry == wet == {s: (n, new, n - new) for s, (n, new) in want.items()}
        known |= set(first)
        assert spark.read.parquet(store).count() == len(known)


def test_tables_are_created_and_checked(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    schema = T.StructType.fromDDL("id long, v string")
    assert src.ensure_table(spark, path, schema) == [] and spark.read.parquet(path).count() == 0
    assert src.ensure_table(spark, path, T.StructType.fromDDL("id long, v long, w int")) == ["v", "w"]


ROBOTS = """# none of this counts
Disallow: /early
User-agent: other
Disallow: /
User-agent: *
User-agent: Miller
Disallow:
Disallow: /x/   # closed
Allow: /x/open
Disallow: /*.pdf$

User-agent: miller
Disallow: /own
"""


def test_robots_rules(spark):
    paths = {"/": True, "/x/1": False, "/x/open/1": True, "/early": True, "/a.pdf": False, "/a.pdf?x": True, "/own": True, "": True}
    urls = spark.createDataFrame([(f"https://a.example{p}", "clash", 1) for p in paths] * 2 + [(None, "clash", 1), ("https://b.example/x/", "clash", 1)], "url string, rule string, path int")
    robots = spark.createDataFrame([("a.example", ROBOTS), ("a.example", None), (None, "x"), ("c.example", "")], "authority string, robots string")
    got = lookup.crawlable(urls, robots).collect()
    assert len(got) == urls.count() and {r.url: r.allowed for r in got if r.url and "a.example" in r.url} == {f"https://a.example{p}": ok for p, ok in paths.items()}
    mine = {r.url: r.allowed for r in lookup.crawlable(urls, robots, "miller").collect() if r.url}
    assert not mine["https://a.example/own"] and not mine["https://a.example/x/1"] and mine["https://b.example/x/"]
    assert all(r.allowed for r in lookup.crawlable(urls, robots.limit(0)).collect())


def test_sparse_vectors_merge_equal_ids_and_filters(spark):
    tf = spark.createDataFrame([(1, "plumless", 0.25), (1, "buckeroo", 0.5), (2, "plumless", 1.0)], "id long, token string, tf double")  # both have CRC-32 1306201125
    assert {(r.id, r.term, r.tf) for r in search.term_ids(tf).collect()} == {(1, 1306201125, 0.75), (2, 1306201125, 1.0)}
    docs = spark.createDataFrame([(1, 2023, "a"), (2, 2024, "b"), (3, None, "a"), (4, 2024, None)], "id long, year int, content_type string")
    assert {r.id for r in search.metadata_filter(docs, (2023, 2024), ("a", "b")).collect()} == {1, 2}
    assert search.metadata_filter(docs).count() == 4


def test_index_reads_only_the_questions_buckets(spark, tmp_path):
    from millrace.operators import index

    docs = spark.createDataFrame([(i, f"rata{i} kredyt{i % 5}") for i in range(80)], "id long, text string")
    built = index.KeywordIndex(spark, f"file://{tmp_path}/ix").rebuild(docs, "id", "text")
    tokens = spark.createDataFrame([("kredyt3",)], "token string")
    part = built.postings(tokens)
    assert part.count() == 16
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
