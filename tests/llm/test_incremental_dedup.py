import random

import numpy as np

from millrace.llm import incremental_dedup as dd
from millrace.llm import vectors as vec

SCHEMA = "record_id long, batch_no int, source_id string, page_content string, size int, axis string"
WORDS = [a + b + c for a in "bdgklmnprst" for b in "aeiou" for c in ("ra", "lis", "tom", "ner", "sk")]


def _article(rng, n=9):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 14))).capitalize() + "." for _ in range(n)]


def _variant(rng, text, drop=0, words=0):
    text = list(text)
    for _ in range(drop):
        text.pop(rng.randrange(len(text)))
    for _ in range(words):
        i = rng.randrange(len(text))
        w = text[i][:-1].split()
        w[rng.randrange(len(w))] = rng.choice(WORDS)
        text[i] = " ".join(w) + "."
    rng.shuffle(text)
    return text


def _corpus(seed, copies):
    rng = random.Random(seed)
    base = [_article(rng) for _ in range(12)]
    rows = [(i, 0, None, "\n".join(t)) for i, t in enumerate(base)]
    rid = 100
    for batch in (1, 2):
        for _ in range(15):
            t = rng.choice(base)
            kind = rng.random()
            if kind < 0.5:
                t = _variant(rng, t, drop=1, words=rng.randint(0, 4))
            elif kind < 0.7:
                t = t[:4] + _article(rng, 5)  # shares less than half
            else:
                t = _article(rng)
                base.append(t)
            rows.append((rid, batch, None, " ".join(t).upper() if rid % 3 == 0 else "\r\n".join(t)))
            rid += 1
    new = _article(rng)
    rows += [(rid + i, 2, None, " ".join(_variant(rng, new, words=i % 3))) for i in range(copies)]
    rows += [(900, 2, None, None), (901, 2, None, ""), (902, 2, "s", "123 --- 77"), (903, 1, None, "...")]
    return rows


def _brute(rows, cfg):
    cache, known, out = vec.Codes(), [], {}
    for rid, batch, _, text in sorted(rows, key=lambda r: (r[1], r[0])):
        if text is None:
            continue
        lens, words = vec.sentences(vec.fold(text).split("\n"), cache)
        own = (lens.tolist(), words)
        hits = [(vec.similarity(*k, *own, cfg.least), -i) for i, k in known if batch > 0]
        hits = [h for h in hits if h[0] >= cfg.least]
        if hits:
            out[rid] = -max(hits)[1]
        elif len(words):
            known.append((rid, own))
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_against_brute_force_and_batch_by_batch(spark, tmp_path):
    rows = _corpus(1, 30)
    df = _frame(spark, rows)
    expected = _brute(rows, dd.DedupConfig())
    assert {r.record_id_b: r.record_id_a for r in dd.duplicates(df).collect()} == expected and len(expected) > 30
    # each batch by an object of its own on the stored index
    cfg = dd.DedupConfig(broadcast_lines=-1)
    path = f"file://{tmp_path}/index"
    dd.DedupIndex(spark, path, cfg).build(df.where("batch_no = 0"))
    steps = [dd.DedupIndex(spark, path, cfg).add(df.where(f"batch_no = {b}")) for b in (1, 2)]
    assert {r.record_id_b: r.record_id_a for s in steps for r in s.collect()} == expected
    index = dd.DedupIndex(spark, path, cfg)
    assert index.deliveries == 3 and index.vectors().where("size > 0").count() == len({r[0] for r in rows}) - 3 - len(expected)


def test_hot_cells_change_nothing(spark):
    """A group of near copies, some of them far enough from its first record to be accepted themselves."""
    rng = random.Random(8)
    base = _article(rng, 12)
    rows = [(i, 1, None, "\n".join(_variant(rng, base, drop=i % 4, words=2 * (i % 3)))) for i in range(40)]
    rows += [(100 + i, 1, None, "\n".join(base[:6] + _article(rng, 3))) for i in range(6)]
    expected = _brute(rows, dd.DedupConfig())
    assert {r.record_id_b: r.record_id_a for r in dd.duplicates(_frame(spark, rows), dd.DedupConfig(hot_cell=4)).collect()} == expected


def test_a_line_known_from_earlier_deliveries_is_no_article(spark, tmp_path):
    rng = random.Random(4)
    notice = " ".join(rng.choice(WORDS) for _ in range(60))
    rows = [(i, 0, "s", "\n".join([*_article(rng), notice])) for i in range(20)]
    text = _article(rng)
    later = [(100, 1, "s", "\n".join([*text, notice])), (101, 2, None, "\n".join(text))]
    index = dd.DedupIndex(spark, f"file://{tmp_path}/index").build(_frame(spark, rows))
    assert index.add(_frame(spark, later[:1])).count() == 0
    assert [tuple(r) for r in index.add(_frame(spark, later[1:])).collect()] == [(100, 101)]


def test_copies_extra_rows_and_empty_tables(spark):
    text = "\n".join(_article(random.Random(5)))
    rows = [(i, 1, "s", text) for i in range(40)] + [(3, 1, "s", text)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    cfg = dd.DedupConfig(min_records=1000)
    assert {(r.record_id_a, r.record_id_b) for r in dd.duplicates(df, cfg).collect()} == {(0, i) for i in range(1, 40)}
    assert dd.duplicates(df.limit(0)).count() == 0
    # all lines are furniture of the source: nothing is left to compare
    assert dd.duplicates(df).count() == 0


def test_accepted_query_is_all_but_the_rejected(spark, tmp_path):
    from millrace.llm import registry

    rows = _corpus(3, 6)
    spark.createDataFrame(rows, "record_id long, batch_no int, source_id string, page_content string").write.parquet(f"file://{tmp_path}/web_records.parquet")
    rejected = {r.record_id_b for r in registry.p1_found(spark, f"file://{tmp_path}").collect()}
    accepted = {r.record_id for r in registry.p1_accepted(spark, f"file://{tmp_path}").collect()}
    assert rejected and accepted == {r[0] for r in rows} - rejected and 900 in accepted


def _edited(rng, text, kind):
    """A copy in which every sentence has words replaced, or has got or lost one."""
    out = []
    for line in text:
        w = line[:-1].lower().split()
        if kind == "replaced":  # one in each half
            w[rng.randrange(len(w) // 2)] = rng.choice(WORDS)
            w[rng.randrange(len(w) // 2, len(w))] = rng.choice(WORDS)
        elif kind == "added":
            w.insert(rng.randrange(len(w)), rng.choice(WORDS))
        elif kind == "removed":
            w.pop(rng.randrange(len(w)))
        else:  # three and a half of twelve: no duplicate
            for i in rng.sample(range(len(w)), rng.choice((3, 4, 4))):
                w[i] = rng.choice(WORDS)
        out.append(" ".join(w) + ".")
    return out


def test_copies_with_every_sentence_edited(spark):
    rng = random.Random(11)
    base = [[" ".join(rng.choice(WORDS) for _ in range(12)) + "." for _ in range(12)] for _ in range(400)]
    rows = [(i, 0, None, "\n".join(t)) for i, t in enumerate(base)]
    rows += [(1000 + i, 1, None, "\n".join(_edited(rng, t, ("replaced", "added", "removed", "far")[i % 4]))) for i, t in enumerate(base)]
    rows += [(2000 + i, 1, None, "\n".join([*t[:7], *_article(rng, 5)])) for i, t in enumerate(base[:20])]
    expected = _brute(rows, dd.DedupConfig())
    assert 300 <= len(expected) < 330
    got = {r.record_id_b: r.record_id_a for r in dd.duplicates(_frame(spark, rows)).collect()}
    assert got.items() <= expected.items() and len(got) >= 0.99 * len(expected)


def test_texts_are_not_shuffled_and_cells_of_new_records_once(spark, tmp_path, monkeypatch):
    rows = _corpus(5, 6)
    _frame(spark, rows).repartition(16).write.parquet(f"file://{tmp_path}/records")
    records = spark.read.parquet(f"file://{tmp_path}/records")
    plans, write = {}, dd.DedupIndex._write
    monkeypatch.setattr(dd.DedupIndex, "_write", lambda self, of, table: (plans.setdefault(table, []).append(of._jdf.queryExecution().executedPlan().toString()), write(self, of, table))[1])
    hot = []
    monkeypatch.setattr(dd.DedupIndex, "_hot_cells", lambda self, probes, found=dd.DedupIndex._hot_cells: (hot.append(1), found(self, probes))[1])
    assert {r.record_id_b: r.record_id_a for r in dd.duplicates(records).collect()} == _brute(rows, dd.DedupConfig())
    assert len(plans["vectors"]) == 2 and not any("Exchange" in p for p in plans["vectors"])
    assert len(hot) == 1


def test_pieces_between_white_space_say_all():
    """Codes and line keys against the whole text's folding, letter by letter; few pieces are folded."""
    rng = random.Random(2)
    odd = [*"aB1 \n\n\r\t\xa0\u2003\u3000\x85\x1c&;.!?…\"'”»)]ΣσςİßŁł´¨é\u0301\u200b_-²Ⅷ中문한#x", "&amp;", "&nbsp;", "&#10;", "&NewLine;", "&am", "p;", "&notit;", "ΑΣ", "1.000 000", "...", "?! "]
    codes, keys = vec.Codes(), {}
    for _ in range(3000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 60)))
        found = [vec._code(t) for t in vec._TOKEN.findall(vec.fold(text))]
        found = [c for i, c in enumerate(found) if c or not i or found[i - 1]]
        lens, words = vec.sentences(text.split("\n"), codes)
        assert words.tolist() == [c for c in found if c >= 0]
        runs = "".join("w" if c >= 0 else " " for c in found).split()
        assert lens.tolist() == [len(r) for r in runs]
        for line, key in zip(text.lower().split("\n"), vec.line_keys(text), strict=True):
            letters = "".join(filter(str.isalpha, line))
            assert (key == 0) == (letters == "") and keys.setdefault(key, letters) == letters
    assert len(set(keys.values())) == len(keys)
    folded, fold = [], vec.fold
    try:
        vec.fold = lambda text: (folded.append(text), fold(text))[1]
        codes = vec.Codes()
        for _ in range(5):
            vec.sentences(vec.article_lines("One two.\nTwo one.", ()), codes)
        assert len(folded) == 4
    finally:
        vec.fold = fold
