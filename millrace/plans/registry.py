"""Registered core queries: name -> function of (spark, directory). Each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions import html as hx
from millrace.functions import text as tx
from millrace.functions import udtf
from millrace.operators import chunking, evaluation, history, index, inventory, lookup, pipeline, search
from millrace.sources import records as src
from millrace.sources import storage
from millrace.streaming import jobs

FLAGSHIP = "j4_hybrid_search"
CFG = search.SearchConfig()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# sources and sinks


def s1_tolerant_json(spark, d):
    """JSON lines with truncated, blank and non-object lines among them."""
    e = table(spark, d, "events").select("event_id", "props")
    bad = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 5)).when(F.col("event_id") % 11 == 0, F.lit("[1, 2]")).when(F.col("event_id") % 13 == 0, F.lit("  ")).otherwise(F.col("props"))
    lines = e.select(bad.alias("line"))
    parsed = src.parse_json_lines(lines, "line", T.StructType.fromDDL("k int"))
    return parsed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def s4_unseen_urls(spark, d):
    """Delivered records whose URL the accepted history doesn't hold."""
    w = table(spark, d, "web_records").select("record_id", "batch_no", "url")
    return inventory.unseen(w.where("batch_no > 0"), w.where("batch_no = 0")).select("record_id", "url")


def s9_first_hit(spark, d):
    """The first document of each source."""
    return inventory.first_hit(table(spark, d, "documents").select("source", "doc_id", "content_type"), "source", "doc_id")


def s16_page_numbers(spark, d):
    """Pages with at least 50 characters, numbered within their file by record."""
    p = table(spark, d, "page_records").where(F.length(tx.strip(F.col("page_content"))) >= 50)
    order = Window.partitionBy("url").orderBy("record_id")
    return p.select("record_id", "url", F.row_number().over(order).alias("n"), tx.pdf_date(F.regexp_replace("date", "-", "")).alias("iso"))


def s25_manifest_hosts(spark, d):
    """Records on each of the manifest's hosts."""
    hosts = table(spark, d, "web_records").select(tx.host(F.col("url")).alias("host"))
    return hosts.join(inventory.manifest_hosts(table(spark, d, "source_manifest")), "host", "left_semi").groupBy("host").agg(F.count(F.lit(1)).alias("records"))


def s27_url_lookup(spark, d):
    """Web records under each document's URL, with and without a final slash."""
    asked = table(spark, d, "page_captures").select(F.col("url").alias("asked")).where("asked is not null").distinct()
    return inventory.lookup_url(table(spark, d, "page_captures").select("url", "record_id"), asked).select("asked", "record_id")


def s29_rows_as_text(spark, d):
    """Orders as sentences."""
    return src.rows_as_text(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).select("o_orderkey", "page_content")


def s30_sliding_windows(spark, d):
    """Events per sliding window."""
    w = src.sliding_windows(table(spark, d, "events"), "ts", "1 hour", "30 minutes")
    return w.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"))


def x1_union_records(spark, d):
    """All record tables under one superset of columns, counted by source and kind."""
    parts = [table(spark, d, t).withColumn("kind", F.lit(t)) for t in ("web_records", "page_captures", "page_records")]
    return src.union_all(*parts).groupBy("kind", "source_id").agg(F.count(F.lit(1)).alias("n"), F.count("page").alias("pages"))


# functions


def t1_article_text(spark, d):
    """Article text, title and date of every captured page."""
    a = table(spark, d, "page_captures").select("record_id", hx.article("page_content").alias("a"))
    return a.select("record_id", "a.text", "a.title", hx.iso_date(F.col("a.published")).alias("published"))


def t3_date_year(spark, d):
    """Year of each record's date."""
    return table(spark, d, "web_records").select("record_id", tx.year_of(F.col("date")).cast("string").alias("y"))


def t5_year_in_url(spark, d):
    """Year in each record's URL."""
    return table(spark, d, "web_records").select("record_id", tx.year_in_url(F.col("url")).alias("since"))


def t6_hosts(spark, d):
    """Authority and host of each record's URL."""
    return table(spark, d, "web_records").select("record_id", tx.netloc(F.col("url")).alias("authority"), tx.host(F.col("url")).alias("host"))


def t7_slugs(spark, d):
    """The URL's path as an identifier."""
    return table(spark, d, "web_records").select("record_id", tx.path_slug(F.col("url")).alias("slug"))


def _chunks(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "url", "source", "content_type", "text")
    return chunking.with_hash(chunking.chunk(docs, "text"), text_col="text")


def t8_chunks(spark, d):
    """All chunks of all documents."""
    return _chunks(spark, d).select("doc_id", "chunk_index", "chunk_total", "text", "content_hash")


def t8_chunk_stats(spark, d):
    """Chunks and their sizes by source."""
    return _chunks(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("text")).alias("longest"), F.countDistinct("doc_id").alias("documents"))


def t9_text_hash(spark, d):
    """The hash of every document as one chunk."""
    return table(spark, d, "documents").select("doc_id", tx.chunk_hash(F.col("url"), F.lit(0), F.col("text")).alias("content_hash"))


def t10_token_counts(spark, d):
    """Tokens and distinct tokens of every document."""
    t = tx.tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


def t11_token_ids(spark, d):
    """Distinct tokens with their 32-bit ids."""
    t = table(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("token")).distinct()
    return t.select("token", tx.token_id(F.col("token")).alias("token_id"))


def t12_term_frequencies(spark, d):
    """Occurrences and share of every token of every document."""
    return search.term_frequencies(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "token", "n", F.round("tf", 9).alias("tf"))


def t15_first_percent(spark, d):
    """The first rate named on each page."""
    return table(spark, d, "page_captures").select("record_id", tx.first_percent(F.col("page_content")).alias("rate"))


def t16_links(spark, d):
    """Links of each page, absolute, with how often they occur."""
    p = table(spark, d, "page_captures").select("record_id", "url", F.explode(tx.links(F.col("page_content"))).alias("link"))
    return p.groupBy("record_id", tx.absolute(F.col("url"), F.col("link")).alias("link")).agg(F.count(F.lit(1)).alias("n"))


def t22_first_lines(spark, d):
    """The first line of each document that isn't blank."""
    return table(spark, d, "documents").select("doc_id", tx.first_line(F.col("text")).alias("line"))


def t23_context_blocks(spark, d):
    """The block of text that each document would be quoted by."""
    c = history.context_block(F.lit(1), F.col("source"), F.lit(None).cast("string"), F.date_format("published_at", "yyyy-MM-dd"), F.col("title"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", c.alias("block"))


def min_length_filter(spark, d):
    """Documents of at least 200 characters without outer white space."""
    return table(spark, d, "documents").where(F.length(tx.strip(F.col("text"))) >= 200).select("doc_id", "source")


def url_and_title_filters(spark, d):
    """Records left by URL patterns and title topics, by source."""
    return inventory.skip_counts(table(spark, d, "web_records"), ["/blog/", "utm_"])


# joins, search


def _record_chunks(spark, d) -> DataFrame:
    w = table(spark, d, "web_records").select("record_id", "batch_no", "url", "source", "content_type", "page_content")
    return chunking.with_hash(chunking.chunk(w))


def j1_new_chunks(spark, d):
    """Chunks of later batches that the history's chunks don't hold."""
    hashed = _record_chunks(spark, d)
    return chunking.new_chunks(hashed.where("batch_no > 0"), hashed.where("batch_no = 0")).select("content_hash")


def a10_dedup_counts(spark, d):
    """New and duplicate chunks of later batches by source."""
    hashed = _record_chunks(spark, d)
    return chunking.dedup_counts(hashed.where("batch_no > 0"), hashed.where("batch_no = 0"))


def _openings(spark, d) -> DataFrame:
    w = table(spark, d, "web_records").select("record_id", "batch_no", "url", "source", "page_content")
    return chunking.with_hash(w.where("page_content is not null").withColumn("chunk_index", F.lit(0)))


def j1_new_openings(spark, d):
    """Hashes of the openings of later batches' articles that the history's openings don't hold."""
    hashed = _openings(spark, d)
    return chunking.new_chunks(hashed.where("batch_no > 0"), hashed.where("batch_no = 0")).select("content_hash")


def a10_opening_counts(spark, d):
    """New and known openings of later batches by source."""
    hashed = _openings(spark, d)
    return chunking.dedup_counts(hashed.where("batch_no > 0"), hashed.where("batch_no = 0"))


def ingest_report(spark, d):
    """An ingest run of the later batches over a store that holds the history's chunks, by source; the store grows by the new ones."""
    w = table(spark, d, "web_records").select("record_id", "batch_no", "url", "source", "content_type", "page_content")
    store = storage.new_path(spark, "chunks")
    pipeline.ingest(w.where("batch_no = 0"), store)
    return pipeline.ingest(w.where("batch_no > 0"), store)


def site_plan(spark, d):
    """The first twenty pages of each source to fetch next: linked from its captured pages, on their host, not among the records yet."""
    seen = table(spark, d, "web_records").select("url")
    found = pipeline.discovered(table(spark, d, "page_captures"))
    return pipeline.to_fetch(found, seen, ["/tag/", "utm_", "#"], 20)


def filtered_search(spark, d):
    """Keyword search among one year's articles of two types."""
    docs = table(spark, d, "web_records").select("record_id", "year", "content_type", "page_content")
    kept = search.metadata_filter(docs, (2023, 2024), ("blog_html", "pdf_local"))
    s = search.sparse_scores(kept, table(spark, d, "golden_questions"), "record_id", "page_content", "item_id", "question")
    return search.top(s, CFG.sparse).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def t12_sparse_vectors(spark, d):
    """Stored sparse vectors of all documents: terms by CRC-32 id."""
    return search.term_ids(search.term_frequencies(table(spark, d, "documents"), "doc_id", "text")).select(F.col("id").alias("doc_id"), "term", F.round("tf", 9).alias("tf"))


def _dense(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings")
    return search.dense_top(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), CFG.dense)


def j6_dense_topk(spark, d):
    """The nearest vectors of every fiftieth one."""
    return _dense(spark, d).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def _sparse(spark, d) -> DataFrame:
    s = search.sparse_scores(table(spark, d, "documents"), table(spark, d, "golden_questions"), "doc_id", "text", "item_id", "question")
    return search.top(s, CFG.sparse)


def j7_sparse_topk(spark, d):
    """The best documents of every question by keywords."""
    return _sparse(spark, d).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def _fused(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings")
    asked = table(spark, d, "golden_questions").select(F.col("item_id").alias("qid"))
    # stand-in for a model: the vector of a question is the one with its number
    queries = v.join(asked, v.vec_id == asked.qid).select("qid", "embedding")
    return search.fuse(search.dense_top(v, queries, CFG.dense), _sparse(spark, d), CFG)


def j3_fused_topk(spark, d):
    """Keyword and vector lists fused by weighted reciprocal ranks."""
    return _fused(spark, d).select("qid", "id", "rank", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_rank", "sparse_rank")), F.round("score", 9).alias("score"))


def _hydrated(spark, d) -> DataFrame:
    hits = search.hydrate(_fused(spark, d), table(spark, d, "documents"), "doc_id", "text", "source", "title", "published_at")
    q = table(spark, d, "golden_questions").select(F.col("item_id").alias("qid"), "question")
    return hits.join(q, "qid")


def j4_hybrid_search(spark, d):
    """Hybrid search with the documents found."""
    return _hydrated(spark, d).select("qid", "rank", "id", "source", "title", F.round("score", 9).alias("score"))


def w5_reranked(spark, d):
    """The best six of each question after reranking by shared words."""
    h = _hydrated(spark, d)
    return search.rerank(h, search.overlap_score(F.col("question"), F.col("text")), CFG).select("qid", "id", "rerank_rank", F.round("rerank_score", 6).alias("rerank_score"))


def w6_unranked(spark, d):
    """The first six of the fused order."""
    return _fused(spark, d).where(F.col("rank") <= CFG.reranked).select("qid", "id", "rank")


def source_filter_advice(spark, d):
    """Documents that an advice question may use, by source: those of the manifest's blogs."""
    blogs = table(spark, d, "source_manifest").where("content_type = 'blog_html'").select("source")
    docs = table(spark, d, "documents").select("doc_id", "source")
    return search.source_filter(docs, F.lit("advice"), blogs).groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


# aggregates, windows, evaluation


def a1_source_counts(spark, d):
    """Documents per source."""
    return inventory.source_counts(table(spark, d, "documents"))


def a2_domain_inventory(spark, d):
    """Distinct URLs and rows per domain, with a total."""
    return inventory.domain_inventory(table(spark, d, "web_records"))


def a3_grade_summary(spark, d):
    """Mean relevance of what each question found, and whether it needs another try."""
    h = _hydrated(spark, d).withColumn("grade", search.overlap_score(F.col("question"), F.col("text"))).withColumn("stale", F.coalesce(F.col("published_at") < F.lit("2024-07-01").cast("timestamp_ntz"), F.lit(False)))
    return inventory.grades(h, "qid", "grade", "stale").select("qid", F.round("avg_score", 6).alias("avg_score"), "stale", "retry")


def _relevant(spark, d) -> DataFrame:
    g = table(spark, d, "golden_questions").select(F.col("item_id").alias("qid"), F.explode("expected_source_domains").alias("source"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return docs.join(g, "source").select("qid", "id")


def a12_retrieval_metrics(spark, d):
    """Recall, precision and reciprocal rank of every question whose expected sources have documents."""
    m = evaluation.retrieval_metrics(_sparse(spark, d), _relevant(spark, d), 12)
    return m.select("qid", "relevant", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")))


def a12_answer_checks(spark, d):
    """Whether the best document of each question holds what is expected and nothing forbidden."""
    best = search.hydrate(_sparse(spark, d).where("rank = 1"), table(spark, d, "documents"), "doc_id", "text", "source")
    want = table(spark, d, "golden_questions").select(F.col("item_id").alias("qid"), "expected_answer_contains", "should_not_contain", "expected_source_domains")
    return evaluation.answer_checks(best.select("qid", F.col("text").alias("answer"), "source"), want)


def w7_last_rows(spark, d):
    """The last ten records of every source."""
    w = table(spark, d, "web_records").where("source_id is not null").select("source_id", "record_id")
    return history.last_rows(w, "source_id", "record_id", 10)


def w11_latest_values(spark, d):
    """The last value of every user."""
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return inventory.latest(e, "user_id", "at", "value").select("user_id", "value", F.col("at.event_id").alias("event_id"))


def s6_robots_gate(spark, d):
    """Which records a crawler may fetch, by robots texts of the manifest's hosts that differ with their language."""
    polish = "User-agent: *\nDisallow:\nDisallow: /blog/  # closed\nAllow: /blog/20\n\nUser-agent: archiver\nDisallow: /\n"
    other = "User-agent: *\nDisallow: /*?\n"
    texts = F.when(F.col("language") == "pl", polish).otherwise(other)
    hosts = table(spark, d, "source_manifest").select(tx.netloc(F.col("url")).alias("authority"), texts.alias("robots"))
    return lookup.crawlable(table(spark, d, "web_records").select("record_id", "url"), hosts).select("record_id", "allowed")


def k4_keyword_index(spark, d):
    """Search in a stored keyword index that was built from one part of the documents and extended by the rest."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    built = index.KeywordIndex(spark, storage.new_path(spark, "keywords")).rebuild(docs.where("doc_id % 2 = 0"), "doc_id", "text").append(docs, "doc_id", "text")
    return built.search(table(spark, d, "golden_questions"), "item_id", "question", CFG.sparse).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def k5_page_blocks(spark, d):
    """Each file's pages as one editable text with page markers."""
    p = table(spark, d, "page_records").where("page_content is not null and page is not null").groupBy("url", "page").agg(F.min_by("page_content", "record_id").alias("t"))
    block = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("t"))
    return p.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def j5_manifest_metadata(spark, d):
    """Documents with their source's author and language."""
    m = table(spark, d, "source_manifest").select("source", "source_id", "author", "language")
    return lookup.with_metadata(table(spark, d, "documents").select("doc_id", "source"), m, "source", "source_id")


def j8_latest_known(spark, d):
    """For each record the number of documents of its year, of the latest known year where there are none."""
    dim = table(spark, d, "documents").where("published_at is not null").groupBy(F.year("published_at").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return lookup.latest_known(table(spark, d, "web_records").select("record_id", "year"), dim, "year", "n").select("record_id", "n")


def j11_most_trusted(spark, d):
    """The most trusted document of each source: statutes before official files before the rest."""
    return lookup.most_trusted(table(spark, d, "documents").select("source", "doc_id", "content_type"), "source", "content_type", ["legal_text", "pdf_gov", "pdf_local"], "doc_id")


def t21_keyword_routes(spark, d):
    """Topics that each document names."""
    words = {"asks_account": ["konto", "rachunek", "account"], "asks_item": ["pozycji", "about"], "asks_rate": ["stawka", "próg", "rate"]}
    return table(spark, d, "documents").select("doc_id", *lookup.routes(F.col("text"), words))


def t8_chunks_in_sql(spark, d):
    """Chunks by the table function, from SQL."""
    udtf.register(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spark.sql("SELECT d.doc_id, c.chunk_index, c.chunk_total, length(c.chunk) AS chars FROM {docs} d, LATERAL chunk_text(d.text, 512, 64) c", docs=docs)


# streams


def _file(d: str, name: str) -> str:
    return f"{d}/{name}.parquet"


def _read_stream(spark, d, name):
    path = _file(d, name)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(path)


def r2_incremental_ingest(spark, d):
    """Chunks stored by a stream of records, run twice over the same store: the second run adds nothing."""
    store = storage.new_path(spark, "store")
    for n in range(2):
        rows = _read_stream(spark, d, "page_records").select("record_id", "url", "source", "content_type", "page_content")
        jobs.ingest_stream(rows, store, storage.new_path(spark, f"progress{n}")).awaitTermination()
    return spark.read.parquet(store).select("content_hash", F.length("page_content").alias("chars"))


def r3_thread_history(spark, d):
    """The last ten records of every source, kept as the state of a stream."""
    out = storage.new_path(spark, "history")
    turns = _read_stream(spark, d, "web_records").where("source_id is not null").select(F.xxhash64("source_id").alias("thread"), F.col("record_id").alias("turn"), F.col("record_id").cast("string").alias("text"))

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("append").parquet(out)

    stream = jobs.thread_history(turns)
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", storage.new_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("thread").agg(F.max(F.struct("turns", "history")).alias("s"))
    return last.select("s.turns", F.array_join("s.history", ",").alias("history"))


def r4_event_windows(spark, d):
    """Hourly events by type, as far as the watermark has closed the hours."""
    stream = jobs.event_windows(_read_stream(spark, d, "events").select("ts", "event_type", "value"))
    rows = jobs.run_to_table(spark, stream, storage.new_path(spark, "windows"), storage.new_path(spark, "progress"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("value", 4).alias("value"))


_NO_QUERY = {"table"}
QUERIES: dict = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_") and f.__name__ not in _NO_QUERY}
