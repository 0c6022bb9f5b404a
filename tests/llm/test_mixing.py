import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mixing as mx


def _best(lengths, counts, wanted, repeats):
    """Largest reachable sum by brute force, whole rounds first."""
    sums = {0}
    for size, n in zip(lengths, counts):
        sums = {s + k * size for s in sums for k in range(n * repeats + 1) if s + k * size <= wanted}
    return max(sums)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 90), st.integers(1, 3))
def test_fit_is_within_bounds_and_best(hist, wanted, repeats):
    lengths, counts = np.array(sorted(hist, reverse=True)), np.array([hist[k] for k in sorted(hist, reverse=True)])
    rounds, taken = mx.fit_lengths(lengths, counts, wanted, repeats, reserve=1000)
    assert (taken >= 0).all() and (taken <= counts).all() and rounds + (1 if taken.any() else 0) <= repeats
    total = int((lengths * (rounds * counts + taken)).sum())
    assert total <= wanted
    whole = int((lengths * counts).sum())
    left = wanted - rounds * whole
    assert total - rounds * whole == (_best(lengths, counts, left, 1) if rounds < repeats else 0)


def test_large_sums_are_met_exactly():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(30, 900, 300))[::-1]
    counts = rng.integers(1, 40, len(lengths))
    whole = int((lengths * counts).sum())
    for wanted in (whole // 3, whole // 2 + 17, 2 * whole + 12345):
        rounds, taken = mx.fit_lengths(lengths, counts, wanted, 8, reserve=20_000)
        assert int((lengths * (rounds * counts + taken)).sum()) == wanted


def test_table(spark):
    text = [" ".join(["rata"] * (3 + i % 9)) for i in range(120)]
    rows = [(i, t, (" WWW.A.test", "a.TEST ", "b.test")[i % 3], 1, "q") for i, t in enumerate(text)]
    rows += [(500, None, "a.test", 1, "q"), (501, "", "b.test", 1, "q"), (502, "słowo", None, 1, "q"), (0, text[0], "a.test", 1, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, h string")
    targets = spark.createDataFrame([("m", "a.test", 3.0, 2, 0.5), ("m", "b.test", 1.0, None, 0.5), ("m", "none.test", 1.0, 2, 0.5), ("n", "b.test", 1.0, 2, 5.0), ("n", None, 1.0, 2, 5.0)], "mix_name string, source string, target_share double, max_repeats int, budget_ratio double")
    cfg = mx.MixConfig(hash_bins=4)
    got = mx.mix(docs, targets, cfg).collect()
    again = mx.mix(docs, targets, cfg).collect()
    assert sorted(got) == sorted(again)
    sizes = {r.doc_id: r.n_tokens for r in mx.sized(docs, cfg).collect()}
    assert 500 not in sizes and sizes[501] == 0
    rep = {(r.mix_name, r.source): r for r in mx.report(docs, targets, cfg).collect()}
    for key in (("m", "a.test"), ("m", "b.test"), ("n", "b.test")):
        mine = [r for r in got if (r.mix_name, r.source) == key]
        assert sum(r.n_tokens * r.repeats for r in mine) == rep[key].tokens <= rep[key].wanted
        assert max(r.repeats for r in mine) <= rep[key].max_repeats
    assert 0 <= rep["m", "a.test"].wanted - rep["m", "a.test"].tokens < 10 and rep["m", "none.test"].tokens == 0
    assert {r.repeats for r in got if r.mix_name == "n"} == {2}
    assert mx.mix(docs.limit(0), targets, cfg).count() == 0 and mx.mix(docs, targets.limit(0), cfg).count() == 0
