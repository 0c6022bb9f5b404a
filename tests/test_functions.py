import zlib

from pyspark.sql import functions as F

from millrace.functions import html as hx
from millrace.functions import text as tx


def _one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(*columns).first()


def test_urls(spark):
    v = F.col("v")
    cols = (tx.netloc(v), tx.host(v), tx.path_slug(v), tx.year_in_url(v))
    assert tuple(_one(spark, "https://WWW.Bank.example:81/a-b/Żółw.pdf?x=2019#f", *cols)) == ("WWW.Bank.example:81", "bank.example", "a_b_żółw_pdf", "2019-01-01")
    assert tuple(_one(spark, "no url", *cols)) == (None, None, "", "")
    assert tuple(_one(spark, None, *cols)) == (None, None, None, None)


def test_links_are_resolved(spark):
    base = F.lit("https://a.example/x/y.html?q=1")
    for link, want in (("b.pdf", "https://a.example/x/b.pdf"), ("/c", "https://a.example/c"), ("//d.example/e", "https://d.example/e"), ("http://f.example/", "http://f.example/")):
        assert _one(spark, link, tx.absolute(base, F.col("v")))[0] == want
    assert _one(spark, '<A class="k" HREF="x">1</a><a href="y">', tx.links(F.col("v")))[0] == ["x", "y"]


def test_tokens_keep_diacritics_and_drop_single_letters(spark):
    row = _one(spark, "Zażółć w GĘŚLĄ_jaźń, 5 x² 12!", tx.tokens(F.col("v")), tx.token_id(F.lit("zażółć")))
    assert row[0] == ["zażółć", "gęślą_jaźń", "x²", "12"] or row[0] == ["zażółć", "gęślą_jaźń", "12"]
    assert row[1] == zlib.crc32("zażółć".encode())


def test_dates_lines_blocks_and_rates(spark):
    v = F.col("v")
    assert _one(spark, "D:20230412101500", tx.pdf_date(v))[0] == "2023-04-12" and _one(spark, "D:2023", tx.pdf_date(v))[0] == "" and _one(spark, None, tx.pdf_date(v))[0] is None
    assert _one(spark, "2021-02-03", tx.year_of(v))[0] == 2021 and _one(spark, "", tx.year_of(v))[0] is None and _one(spark, "abcd", tx.year_of(v))[0] is None
    assert _one(spark, "\n \n „Ala” \nb", tx.first_line(v))[0] == "Ala" and _one(spark, " \n", tx.first_line(v))[0] is None
    assert _one(spark, "--- Page 1 ---\nab\n--- Page 2 ---\n \n--- Page 3 ---\nc", tx.page_blocks(v))[0] == ["ab", "c"]
    assert _one(spark, "x 4,5 % y <b>6,10<sub>%</sub></b>", tx.first_percent(v))[0] == "6,10" and _one(spark, "x <i>4,5</i> %", tx.first_percent(v))[0] == "4,5" and _one(spark, "none", tx.first_percent(v))[0] is None
    assert _one(spark, "```json\n{\"a\":1}\n```", tx.without_fence(v))[0] == '{"a":1}'


def test_article_reader():
    page = """<html><head><title>T</title><meta property="og:title" content="OG"><meta name="article:published_time" content="2024-05-06T10:00:00Z"></head>
    <body><nav>menu</nav><div class="post-content">post</div><article class="x"><h1>H</h1><p>Ala &amp; kot<br>dwa</p><div class="a newsletter">no</div><aside>no</aside><p>koniec</p></article></body>"""
    got = hx.read_article(page)
    assert got.text == "H\nAla & kot\ndwa\nkoniec" and got.title == "OG" and got.published.startswith("2024-05-06")
    assert hx.read_article('<div class="entry-content">a</div><div class="entry-content">b</div>').text == "a"
    assert hx.read_article("<p>none</p>").text == "" and hx.read_article('<h1>H</h1><time datetime="2020">').published == "2020"


def test_article_udf_and_dates(spark):
    df = spark.createDataFrame([("<article>x</article>",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(hx.article("v")["text"]).collect()] == ["x", None, ""]
    for raw, want in (("2024-05-06T10:00:00Z", "2024-05-06"), ("06.05.2024", "2024-05-06"), ("soon", ""), ("", "")):
        assert _one(spark, raw, hx.iso_date(F.col("v")))[0] == want


def test_levels_glossary_and_authorities(spark):
    df = spark.createDataFrame([(["x"], ["y" * 60, None], ["z"]), (None, [" " * 80], ["z"]), (None, None, None)], "a array<string>, b array<string>, c array<string>")
    got = [r[0] for r in df.select(tx.first_sufficient({"text": F.col("a"), "layout": F.col("b"), "ocr": F.col("c")})).collect()]
    assert [g and g.method for g in got] == ["layout", "ocr", None]
    assert _one(spark, "Ike i IKE+, ike2", tx.replace_terms(F.col("v"), {"IKE": "konto $1", "ike+": "x"}))[0] == "konto $1 i x, ike2"
    rows = spark.createDataFrame([("https://a.example/1", "https://a.example/2"), ("https://a.example:8/1", "https://a.example/2"), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(tx.same_authority(F.col("a"), F.col("b"))).collect()] == [True, False, False]
