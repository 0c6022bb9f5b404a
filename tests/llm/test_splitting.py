from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import splitting as sp

TEXT = " ".join(f"Zdanie numer {i} opisuje ratę {i * 37 % 91} złotych." + ("\n" if i % 9 == 0 else "") for i in range(400))


def _whole(text, pieces):
    return text[pieces[0][0] : pieces[0][1]] + "".join(text[a[1] : b[1]] for a, b in zip(pieces, pieces[1:]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\nż😀", max_size=900), st.integers(2, 90), st.integers(0, 40))
def test_bounds_overlap_and_round_trip(text, size, overlap):
    pieces = sp.cuts(text, size, overlap)
    overlap = min(overlap, size - 1)
    assert _whole(text, pieces) == text
    assert all(0 < b - a <= size for a, b in pieces) or text == ""
    assert all(b[0] == a[1] - overlap or b[0] < 0 for a, b in zip(pieces, pieces[1:]))
    assert (len(pieces) > 1) == (len(text) > size)


def test_cuts_at_boundaries_and_edits_stay_local():
    pieces = sp.cuts(TEXT, 512, 64)
    assert all(TEXT[b - 1].isspace() for _, b in pieces[:-1])
    edited = TEXT[:3000] + "Dopisane zdanie. " + TEXT[3000:]
    ends = {TEXT[b : b + 60] for _, b in pieces}
    same = sum(edited[b : b + 60] in ends for _, b in sp.cuts(edited, 512, 64))
    assert same >= 0.8 * len(pieces)


def test_table(spark):
    limits = spark.createDataFrame([("legal_text", 100, 10), ("default", 50, 5), ("default", 60, 5)], "content_type string, max_chars int, overlap_chars int")
    rows = [(1, " Legal_Text ", "x" * 100), (2, "LEGAL_TEXT", "x" * 101), (3, None, "y " * 30), (4, "other", "z" * 50), (5, "other", None), (6, "other", ""), (6, "other", "ż" * 51)]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "record_id long, content_type string, page_content string, start int, piece string")
    assert sorted(r[0] for r in sp.oversized(df, limits).collect()) == [2, 3, 6]
    got = sp.split_oversized(df, limits).collect()
    assert {r.record_id: r.piece_count for r in got if r.record_id in (1, 4)} == {1: 1, 4: 1}
    assert not [r for r in got if r.record_id == 5] and [r.piece for r in got if r.record_id == 6 and r.piece_count == 1] == [""]
    assert all(len(r.piece) == r.end - r.start <= (100 if r.record_id < 3 else 50) for r in got)
    assert sp.oversized(df.limit(0), limits).count() == 0
