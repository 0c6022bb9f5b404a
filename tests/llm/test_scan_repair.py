import random

from millrace.llm import ocr_words as ow
from millrace.llm import scan_repair as sr

WORDS = [a + b + c for a in ("kred", "opłat", "składk", "rozlicz", "mieszkan", "umow", "dochod", "pożyczk", "wydatk", "ubezpiecz") for b in ("ow", "ni", "ar", "em") for c in ("anie", "nego", "icie", "ek")]


def _file(rng, n_pages, url, rid, noise):
    rows, truth = [], set()
    for page in range(1, n_pages + 1):
        lines, bad = ["Biuletyn oszczędzania numer 7"], {}
        for i in range(18):
            words = [rng.choice(WORDS) for _ in range(9)]
            if noise and rng.random() < 0.25:
                k = rng.randrange(9)
                w = words[k].replace("an", "@n", 1).replace("ow", "0w", 1)
                if w != words[k]:
                    words[k], bad[len(lines)] = w, "misread"
            lines.append(" ".join(words))
        for i in range(1, 18, 4):
            if noise:
                w = rng.choice(WORDS)
                lines[i] += f" {w[:5]}-"
                lines[i + 1] = f"{w[5:]} " + lines[i + 1]
                truth.add((rid, i, "broken_word"))
        lines[6] += " polsko-"
        lines[7] = "czeski " + lines[7]
        lines.append(f"- {page} -")
        truth |= {(rid, 0, "running_header"), (rid, len(lines) - 1, "page_number")} | {(rid, k, v) for k, v in bad.items()}
        rows.append((rid, url, page, n_pages, "\n".join(lines)))
        rid += 1
    return rows, truth


def test_defects_found_in_noisy_files(spark):
    rng = random.Random(2)
    rows, truth = [], set()
    for f in range(6):
        r, t = _file(rng, 6, f"file:///{f}.pdf", 100 * f, f % 2 == 0)
        rows += r
        truth |= t
    rows[0] = (*rows[0][:4], rows[0][4].replace("polsko-\nczeski", "polsko-czeski i polsko-czeski"))
    truth = {(a, b - (a == 0 and b > 6), c) for a, b, c in truth}
    rows += [(900, None, None, None, None), (901, None, None, None, ""), (902, "x", 1, 1, "12"), (903, None, 5, None, "słowo " * 30000)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "record_id long, url string, page int, page_total int, page_content string, defect string, line_no int")
    got = {tuple(r) for r in sr.defects(df).collect()}
    for kind, least in (("running_header", 0.98), ("page_number", 0.98), ("broken_word", 0.9), ("misread", 0.95)):
        a, b = {x for x in got if x[2] == kind}, {x for x in truth if x[2] == kind}
        assert len(a & b) >= least * len(b), (kind, len(a & b), len(b))
        assert len(a - b) <= 0.05 * len(b) + 1, (kind, sorted(a - b)[:5])
    text = {r.record_id: r.text for r in sr.repaired(df).collect()}
    assert 900 not in text and "Biuletyn" not in text[0] and "- 2 -" not in text[1]
    known = set(WORDS) | {"polsko-czeski", "i", "polsko-", "czeski"}
    words = " ".join(text[100 * f + p] for f in range(6) for p in range(6)).split()
    assert sum(w in known for w in words) >= 0.97 * len(words)


def test_empty_table(spark):
    df = spark.createDataFrame([], "record_id long, url string, page int, page_total int, page_content string")
    assert sr.defects(df).count() == 0 and sr.repaired(df).count() == 0


def test_page_numbers_and_confusions():
    assert ow.page_number("- 12 -")[0] == 12 and ow.page_number("Strona3")[0] == 3 and ow.page_number("xiv")[0] == 14
    assert ow.page_number("3/17") == (3, "arabict", 17) and ow.page_number("[l2]")[0] == 12
    assert ow.page_number("Art. 5") is None and ow.page_number("rok 2020 w banku") is None and ow.page_number("civic") is None
    assert ow.explain("ernisyjny", "emisyjny") and ow.explain("kredyt", "kredyt") == [] and ow.explain("rata", "kapitał") is None
    assert ow.restored("sp6łki") == "spółki" and ow.restored("3O") == "30" and ow.restored("kredyt") is None
    assert ow.skeleton("Wydawnictw0 Verronk, nakład 8600 egz.") == ow.skeleton("Wydawnictwo Verronk, nakład 77 egz.")


def test_numbering_and_units_are_no_misread_words(spark):
    rng = random.Random(4)
    rows, _ = _file(rng, 6, "file:///u.pdf", 0, False)
    rows = [(*r[:4], r[4].replace(" ", " art. 5a lokal 50 m2 ", 1)) for r in rows]
    df = spark.createDataFrame(rows, "record_id long, url string, page int, page_total int, page_content string")
    assert sr.defects(df).where("defect = 'misread'").count() == 0


def test_the_ranking_decides_on_words_the_corpus_does_not_hold(spark):
    cfg = sr.ScanConfig()
    rows = [(w, 20) for w in WORDS] + [("zyskowny", 1)] + [(w, 1) for w in ("k0nto", "@dres", "7O", "l2", "wyd@tkiem", "m2", "5a", "KVI0557", "a1b2c3d4e5f6a7b8", "zysk0wnym", "ubezpieczeni0wegoubezpieczeniowegoubezpieczeniowego")]
    df = spark.createDataFrame(rows, "word string, n long")
    got = {r.word for r in sr.corrections(df, sr.fit_words(dict(rows[: len(WORDS)]), cfg), cfg).collect()}
    assert got >= {"k0nto", "wyd@tkiem", "zysk0wnym", "7O"} and not got & {"m2", "5a", "KVI0557", "a1b2c3d4e5f6a7b8", "zyskowny", *WORDS}


def test_words_found_do_not_depend_on_deliveries(spark):
    rng = random.Random(8)
    rows = [r for f in range(6) for r in _file(rng, 6, f"file:///{f}.pdf", 100 * f, False)[0]]
    word = max(WORDS, key=lambda w: (sum(r[4].count(w) for r in rows[1:]), w))
    rows[0] = (*rows[0][:4], rows[0][4] + "\n" + word.replace("o", "c", 1).replace("e", "c", 1) + " x")
    schema = "record_id long, url string, page int, page_total int, page_content string"
    copies = rows + [(1000 * k + r[0], *r[1:]) for k in range(1, 5) for r in rows[:6]]
    count = lambda data: {r.word: r.n for r in sr.word_counts(sr._once(_body(spark.createDataFrame(data, schema)))).collect()}
    assert count(rows) == count(copies)
    one, many = ({tuple(x) for x in sr.defects(spark.createDataFrame(d, schema)).where("record_id < 1000 and defect = 'misread'").collect()} for d in (rows, copies))
    assert one == many


def _body(df):
    cfg = sr.ScanConfig()
    pages = sr._pages(df, cfg)
    return sr._with_furniture(pages, sr.furniture(pages, cfg))


def test_blocks_of_many_header_lines_and_long_footers(spark):
    rng = random.Random(6)
    head = ["Kancelaria Verronk i wspólnicy", "Oddział w Krakowie, ulica Długa", "Biuletyn oszczędzania", "Rozdział o składkach", "Wydanie dla doradców"]
    foot = " ".join(f"Zastrzeżenie {w}" for w in WORDS[:20])
    assert len(foot) > 160
    rows = [(p, "file:///h.pdf", p, 8, "\n".join([*head, *(" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(15)), foot])) for p in range(1, 9)]
    df = spark.createDataFrame(rows, "record_id long, url string, page int, page_total int, page_content string")
    got = {tuple(r) for r in sr.defects(df).where("defect = 'running_header'").collect()}
    assert got == {(p, n, "running_header") for p in range(1, 9) for n in (0, 1, 2, 3, 4, 20)}
