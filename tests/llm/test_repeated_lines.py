from millrace.llm import repeated_lines as rl

SCHEMA = "record_id long, source_id string, page_content string, few string, bits string"


def _records(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_thresholds_forms_nulls_and_clashing_columns(spark):
    rows = [(i, "a", f"Text number {chr(97 + i)}{chr(98 + i)}\nShare this!" if i % 2 else f"Other {chr(97 + i)}\n  SHARE, this (12)\r") for i in range(8)]
    rows += [(100 + i, "b", "Only here") for i in range(4)]  # too few records
    rows += [(200, None, "Share this!"), (201, "a", None), (202, "a", ""), (203, "a", "123\n---")]
    df = _records(spark, rows)
    got = {tuple(r) for r in rl.occurrences(df).collect()}
    assert got == {(i, 1) for i in range(8)}
    clean = {r.record_id: r.page_content for r in rl.without_repeated_lines(df).collect()}
    assert len(clean) == len(rows)
    assert clean[1] == "Text number bc" and clean[201] is None and clean[202] == "" and clean[203] == "123\n---" and clean[200] == "Share this!"


def test_dense_containers_are_bit_fields(spark):
    df = spark.range(5000).selectExpr("id as record_id", "'s' as source_id", "concat('line ', id % 7, chr(10), 'same') as page_content", "1 as few", "2 as bits")
    df = df.coalesce(1)
    rows = rl.lines(df, rl.RepeatedLines())
    forms = rl.line_bitmaps(rows)
    assert forms.where("bits is not null").count() == 1  # 'same'; the seven forms of 'line' have some 700 documents each
    bitmaps = rl.excessive(df, rows)
    assert bitmaps.where("bits is not null").count() == 2  # together they have 5000
    assert rl.occurrences(df).count() == 10000


def test_scattered_ids_are_numbered_densely(spark):
    df = spark.range(4000).selectExpr("xxhash64(id) as record_id", "if(id % 2 = 0, 's', 't') as source_id", "'same' as page_content").coalesce(1)
    assert rl.excessive(df, rl.lines(df, rl.RepeatedLines())).count() == 2
    assert rl.occurrences(df).select("record_id").distinct().count() == 4000


def test_empty_table(spark):
    assert rl.occurrences(_records(spark, [])).count() == 0
    assert rl.without_repeated_lines(_records(spark, [])).count() == 0
