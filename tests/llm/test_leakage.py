import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import leakage as lk

NAMES = [a + b for a in "bdfgklmnprstwz" for b in ("adri", "elka", "ornis", "umta")]


def _brute_runs(hits, size, cfg):
    have = set(hits.tolist())
    exact = any(all(x + i in have for i in range(cfg.exact)) for x in have)
    windows = [(a, w) for a in range(size) for w in range(cfg.near, size - a + 1)]
    return exact, any((w - sum(x in have for x in range(a, a + w))) * cfg.one_in <= w for a, w in windows)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 40), max_size=36), st.integers(0, 6))
def test_runs(hits, more):
    cfg = lk.LeakConfig(exact=5, near=12, one_in=4)
    hits = np.array(sorted(hits), dtype=np.int64)
    size = int(hits.max(initial=-1)) + 1 + more
    assert lk.runs(hits, size, cfg) == _brute_runs(hits, size, cfg)


def test_one_rule_for_any_number_of_hits():
    cfg = lk.LeakConfig(exact=1000)
    near = np.array([i for i in range(54) if i % 8 != 0])  # replaced words also at the window's ends
    far = np.arange(600, 1760, 2)
    assert lk.runs(near, 2000, cfg) == lk.runs(np.concatenate((near, far)), 2000, cfg) == (False, True)
    assert lk.runs(far, 2000, cfg) == (False, False)


@given(st.lists(st.integers(0, 9), max_size=40))
def test_every_gap_is_probed(df):
    got = lk.choose_probes(np.array(df))
    assert all(any(a <= p < a + lk.GAP for p in got) for a in range(len(df) - lk.GAP + 1))


def test_leaks_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    sent = lambda n: [rng.choice(NAMES) for _ in range(n)]
    items = [(i, " ".join(sent(60))) for i in range(6)] + [(6, None), (7, "za krótki"), (8, ""), (2, "")]
    items[3] = (3, " ".join(items[0][1].split()[:25] + sent(30)))  # shares part of its passage
    docs, truth = [], set()
    for d in range(60):
        words = sent(80)
        item = rng.randrange(6)
        p = items[item][1].split()
        n = rng.choice((8, 11, 12, 20, 40))
        at = rng.randrange(len(p) - n + 1)
        part = list(p[at : at + n])
        if n == 40:
            for i in range(4, 40, 8):
                part[i] = "zamiast"
        text = [w if i % 5 else f"<b>{w.upper()}</b>," for i, w in enumerate(words[:20] + part + words[20:])]
        docs.append((d, " \n".join(text)))
    docs += [(100, None), (101, ""), (102, "x " * 5000 + items[1][1]), (102, "x " * 5000 + items[1][1])]
    schema = "doc_id long, text string, item_id long, term string"
    cfg = lk.LeakConfig(block_docs=7)
    got = {(r.doc_id, r.item_id) for r in lk.leaks(spark.createDataFrame([(*d, 0, "") for d in docs], schema), spark.createDataFrame(items, "item_id long, passage string"), cfg).collect()}
    for d, text in docs:
        w = lk.words(text or "")
        for i, passage in items:
            p = lk.words(passage or "")
            for g in range(-len(p), len(w)):
                hits = np.array([k for k in range(len(p)) if 0 <= k + g < len(w) and w[k + g] == p[k]], dtype=np.int64)
                if any(lk.runs(hits - max(0, -g), len(p) - max(0, -g), cfg)):
                    truth.add((d, i))
    assert got == truth and len(truth) > 20 and (102, 1) in truth
    # an index extended by a second delivery gives the same
    frame = spark.createDataFrame(docs[:64], "doc_id long, text string")
    path = f"file://{tmp_path}/postings"
    lk.build_index(frame.where("doc_id % 2 = 0"), cfg=cfg, path=path)
    index = lk.build_index(frame.where("doc_id % 2 = 1"), cfg=cfg, path=path)
    assert {(r.doc_id, r.item_id) for r in lk.leaks(frame, spark.createDataFrame(items, "item_id long, passage string"), cfg, index).collect()} == truth
    small = lk.LeakConfig(block_docs=7, broadcast_words=50)
    again = {(r.doc_id, r.item_id) for r in lk.leaks(spark.createDataFrame(docs[:64], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), small).collect()}
    assert again == truth
    assert lk.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).count() == 0
