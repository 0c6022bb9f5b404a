import random

import numpy as np

from millrace.llm import main_content as mc

SENTENCES = ["Bank podnosi stopę o 3% w skali roku, dlatego klient płaci więcej.", "W praktyce rata rośnie do końca umowy, o ile inflacja nie spadnie.", "Nowy kredyt kosztuje coraz więcej, a oszczędności topnieją z każdym miesiącem."]


def _page(rng, article=True):
    title = f"Kredyt numer {rng.randrange(900)} drożeje"
    nav = [f'<li><a href="/{x}">{x}</a></li>' for x in rng.sample(["Start", "Kontakt", "Forum", "Sklep", "Podatki"], 4)]
    body = [f"<h1>{title}</h1>"] if article else []
    for _ in range(rng.randint(2, 5) if article else 0):
        body.append(f"<p>{rng.choice(SENTENCES)} {rng.choice(SENTENCES)}</p>")
        if rng.random() < 0.4:
            body += ['<div class="social-share">', "<span>Udostępnij ten wpis</span>", "</div>"]
    page = ["<!doctype html>", "<html><head>", f"<title>{title} – Serwis</title>", "<style>.menu{}</style>", "</head><body>", '<nav class="menu">', *nav, "</nav>", "<script>", "var x = 1;", "</script>"]
    page += (["<article>", *body, "</article>"] if article else []) + ['<div class="comments">', "<p>Komentarze (3)</p>", "<p>ola12</p>", "</div>", "<footer>", "<p>Regulamin</p>", "</footer>", "</body></html>"]
    return title, "\n".join(page)


def test_best_region_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        s = rng.normal(size=rng.integers(1, 20))
        first, end, total = mc.best_region(s)
        assert abs(total - max([0.0, *(s[a:b].sum() for a in range(len(s)) for b in range(a + 1, len(s) + 1))])) < 1e-9
        assert abs(s[first:end].sum() - total) < 1e-9


def _segments(s, first=0):
    """The best segment and, beside it, the best ones of what is left."""
    best = max(((s[a:b].sum(), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, a, b = best
    return [*_segments(s[:a], first), (first + a, first + b), *_segments(s[b:], first + b)]


def test_all_maximal_segments_against_their_definition():
    rng = np.random.default_rng(3)
    for _ in range(60):
        s = rng.normal(size=rng.integers(1, 16))
        assert [x[:2] for x in mc.maximal_segments(s)] == _segments(s)


def test_a_block_inside_the_region_is_cut_out():
    weights = mc.Weights(np.zeros(1), floor=-1.0)
    assert mc.main_lines(np.array([-1, 3, 2, -0.8, 2, -2, 0.5, -2, 4, -3.0]), weights).tolist() == [False, True, True, False, True, False, False, False, True, False]


def test_markup_lines_keep_numbers_and_hide_scripts():
    page = "<html><head>\n<title>t</title>\n</head><body>\n<!-- a\nb -->\n<p\nclass='x'>Ala &amp; kot</p>\n<script>\nx\n</script>\n\n<br>Ola</body>"
    lines, _ = mc.markup_lines(page)
    assert [(x.no, x.text) for x in lines] == [(6, "Ala & kot"), (11, "Ola")]
    assert all(page.split("\n")[x.no].find(x.text.split()[0]) >= 0 for x in lines)


def test_held_out_pages_with_tags_and_without(spark):
    rng = random.Random(7)
    pages = [_page(rng, i % 6 > 0) for i in range(120)]
    rows = [(i, t, p, True, 0) for i, (t, p) in enumerate(pages)]
    plain = {}
    for i, (t, p) in enumerate(pages[:40]):
        lines = mc.markup_lines(p)[0]
        plain[1000 + i] = [x.body and not x.furniture for x in lines]
        rows.append((1000 + i, t, "\n".join(x.text for x in lines), True, 0))
    rows += [(2000, None, None, True, 0), (2001, "t", "", True, 0), (2002, None, SENTENCES[0] * 3000, True, 0), (0, *pages[0], True, 0)]
    df = spark.createDataFrame(rows, "record_id long, title string, page_content string, main boolean, line_no int")
    train = df.where("record_id >= 40 and record_id < 1000")
    weights = mc.train(train)
    got = {}
    for r in mc.classified(df, weights=weights).collect():
        got.setdefault(r.record_id, []).append((r.line_no, r.main))
    right = total = 0
    for i, (_, p) in enumerate(pages[:40]):
        want = [x.body and not x.furniture for x in mc.markup_lines(p)[0]]
        for key, label in ((i, want), (1000 + i, plain[1000 + i])):
            have = [m for _, m in sorted(set(got[key]))]
            right += sum(a == b for a, b in zip(have, label))
            total += len(label)
    assert right >= 0.97 * total
    assert 2000 not in got and 2001 not in got and len(got[2002]) == 1
    text = {r.record_id: r.main_content for r in mc.extract(df, weights=weights).collect()}
    assert text[2000] is None and text[2001] == "" and "Regulamin" not in text[1]


def test_without_labelled_pages(spark):
    df = spark.createDataFrame([(1, None, "Start\n" + " ".join(SENTENCES) + "\nRegulamin")], "record_id long, title string, page_content string")
    assert {(r.record_id, r.line_no) for r in mc.furniture(df).collect()} == {(1, 0), (1, 2)}
    assert mc.furniture(df.limit(0)).count() == 0
