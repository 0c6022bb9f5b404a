"""Noise in text from scanned pages (problem 5).

Furniture: lines at the edges of a page are paired with those of the next two pages of the file; a classifier on line
pairs says which pairs are the same running header or footer, and number lines must step with their pages. Joins: a line
end with a hyphen and the next body line's first word, if need be on the next page, are a pair for a second classifier.
Misread words: word forms are counted over all body lines; each form finds correction candidates among more frequent
ones through an inverted join on placed character bigrams, and gradient-boosted trees rank them. All three learn from the
corpus itself: words and headers corrupted by known confusions, words cut in two, and natural pairs as counterexamples.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import ocr_words as ow
from millrace.llm.boosting import Boosted, fit_logistic, logistic
from millrace.llm.storage import materialise, spread


@dataclass(frozen=True)
class ScanConfig:
    """``edge``: lines looked at together at either end of a page; more while all of them are furniture.
    ``neighbours``: share of the next two pages on either side that must have a running line too; ``far``: edits beyond which two lines are no pair;
    ``least_pages``, ``file_share``: or how many pages of the file, and what share of them. ``fit_words``, ``fit_pairs``: sample sizes of the
    learners. ``lexicon_count``: least count of a correction. ``min_ratio``: how much more frequent it must be
    than a form met at most ``few`` times, ``often_ratio``: than one met more often. ``fit_alike``: words of a bigram among which the
    learner looks for natural pairs that are alike. ``filter_bits``: most bits of the table by which tasks pass over words."""

    edge: int = 3
    neighbours: float = 0.4
    far: int = 10
    least_pages: int = 3
    file_share: float = 0.2
    fit_words: int = 4000
    fit_pairs: int = 4000
    lexicon_count: int = 2
    min_ratio: float = 3.0
    few: int = 2
    often_ratio: float = 15.0
    fit_alike: int = 200
    filter_bits: int = 27
    seed: int = 5
    id_col: str = "record_id"
    file_col: str = "url"
    page_col: str = "page"
    total_col: str = "page_total"
    text_col: str = "page_content"


def _pages(records: DataFrame, cfg: ScanConfig) -> DataFrame:
    own = F.concat(F.lit("record:"), F.col(cfg.id_col).cast("string"))
    rows = records.where(F.col(cfg.text_col).isNotNull() & F.col(cfg.id_col).isNotNull()).select(
        F.col(cfg.id_col).cast("long").alias("rid"),
        F.xxhash64(F.coalesce(F.col(cfg.file_col), own)).alias("file"),
        F.coalesce(F.col(cfg.page_col), F.lit(0)).cast("int").alias("page"),
        F.coalesce(F.col(cfg.total_col), F.lit(0)).cast("int").alias("total"),
        F.col(cfg.text_col).alias("text"),
    )
    return spread(rows)


# furniture ------------------------------------------------------------------------------------------------------------

EDGE = "rid long, file long, page int, total int, side int, slot int, line_no int, text string, number int, style string, of int, skel string"


def edges(pages: DataFrame, cfg: ScanConfig, start: int = 0) -> DataFrame:
    """The lines at the top (side 0) and bottom (side 1) of each page, from slot ``start`` inwards; ``sides`` says which sides."""
    most = cfg.edge

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in EDGE.split(", ")]
        for batch in batches:
            out = []
            for rid, file, page, total, text, sides in zip(*(c.to_pylist() for c in batch.columns)):
                lines = [(i, t.strip()) for i, t in enumerate(text.split("\n")) if t.strip()]
                for side, part in ((0, lines[start : start + most]), (1, lines[::-1][start : start + most])):
                    if side not in sides:
                        continue
                    for slot, (no, line) in enumerate(part, start):
                        number, style, of = ow.page_number(line) or (None, None, None)
                        out.append((rid, file, page, total, side, slot, no, line, number, style, of, ow.skeleton(line) if number is None else None))
            cols = list(zip(*out)) if out else [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return pages.select("rid", "file", "page", "total", "text", "sides").mapInArrow(cut, EDGE)


_ALONE = re.compile(r"(?<![^\W\d_@!])\d{1,9}(?![^\W\d_@!])")
def _low_start(line: str) -> bool:
    """Whether a line begins in the midst of a sentence."""
    return next((c for c in line if c.isalpha()), "A").islower()



def pair_features(a: str, b: str, same_slot: bool, step: int) -> list[float]:
    """Features of two edge lines, ``step`` pages apart, being the same furniture."""
    x, y = ow.skeleton(a), ow.skeleton(b)
    ga, gb = {x[i : i + 4] for i in range(max(1, len(x) - 3))}, {y[i : i + 4] for i in range(max(1, len(y) - 3))}
    old, new = ([int(n) for n in _ALONE.findall(t)] for t in (a, b))
    steps = float(any(n - m == step for m in old for n in new))
    gone, come = (sorted((Counter(x) - Counter(y)).elements()) for x, y in ((old, new), (new, old)))  # a page's number may change sides
    moved = list(zip(gone, come))
    if moved and not re.match(rf"\W*{moved[0][1]}\b", b) and not re.search(rf"\b{moved[0][1]}\W*$", b):
        moved = [(0, -1)] * 2  # a page's number stands at either end of its line
    alike = len(old) == len(new) and (not moved or len(moved) == 1 and moved[0][1] - moved[0][0] == step) or bool(re.search(r"\d[OlI]|[OlI]\d", a + b))
    return [float(x == y and len(x) > 2), len(ga & gb) / max(1, len(ga | gb)), min(len(x), len(y)) / max(1, len(x), len(y)), float(same_slot), steps, float(min(len(x), len(y)) > 2), float(alike), float(_low_start(a) and _low_start(b))]


def _misprint(line: str, rng: np.random.Generator) -> str:
    words = line.split(" ")
    for _ in range(int(rng.integers(0, 3))):
        i = int(rng.integers(len(words)))
        words[i] = ow.corrupted(words[i], rng) or words[i]
    return " ".join(words)


def fit_pairs(sample: list[tuple[int, int, str]], cfg: ScanConfig) -> np.ndarray:
    """Weights of the furniture classifier, from (file, slot, line): a line against its own misprint on another page, and
    against lines of other files. Lines that begin in the midst of a sentence are body text, whatever they are like."""
    rng = np.random.default_rng(cfg.seed)
    if len(sample) < 50:
        made = ow.made_up_words(rng, 400)
        sample = [*sample, *((-i, 0, " ".join(rng.choice(made, int(rng.integers(2, 7)))).capitalize()) for i in range(200))]
    x, y = [], []
    for i, (file, slot, line) in enumerate(sample):
        if len(ow.skeleton(line)) < 3:
            continue
        step = int(rng.integers(1, 3))
        a, b = (f"{line} | {i % 90}", f"{line} | {i % 90 + step}") if rng.random() < 0.3 else (line, line)
        if rng.random() < 0.1:
            a, b = (next((t[:k] + t[k:].lower() for k, c in enumerate(t) if c.isalpha()), t) for t in (a, b))
        x.append(pair_features(_misprint(a, rng), _misprint(b, rng), rng.random() < 0.9, step))
        y.append(float(not x[-1][-1]))
        for _ in range(6):
            other = sample[int(rng.integers(len(sample)))]
            if other[0] != file and ow.skeleton(other[2]) != ow.skeleton(line):
                x.append(pair_features(line, other[2], rng.random() < 0.4, step))
                y.append(0.0)
    return fit_logistic(np.array(x), np.array(y))


def number_features(number: int, style: str, of: int | None, page: int, total: int, other: int | None, other_style: str | None, step: int) -> list[float]:
    """Features of a number line and one of another page, ``step`` pages further, being the pages' numbers."""
    steps = other is not None and other - number == step and style[:5] == (other_style or "")[:5]
    return [float(steps), float(number == page and (not total or number <= total)), float(of is not None and of == total), float(style.endswith(".")), float(other is None)]


def fit_numbers(cfg: ScanConfig) -> np.ndarray:
    """Weights of the page number classifier, from made-up files: running numbers, some of them shifted, against numbering and amounts."""
    rng = np.random.default_rng(cfg.seed)
    x, y = [], []
    for _ in range(4000):
        total = int(rng.integers(2, 120))
        page, step = int(rng.integers(1, total + 1)), int(rng.choice([-2, -1, 1, 2]))
        real = rng.random() < 0.5
        style = rng.choice(["arabic", "arabicw", "arabicd", "roman", "arabic."] if real else ["arabic", "arabic.", "arabic.", "roman."])
        if real:
            shift = int(rng.choice([0, 0, 0, rng.integers(-5, 20)]))
            number, of = page + shift, total if rng.random() < 0.3 else None
            other = number + step if rng.random() < 0.85 else int(rng.integers(1, 200)) if rng.random() < 0.5 else None
        else:
            number, of = int(rng.integers(1, 200)), int(rng.integers(1, 200)) if rng.random() < 0.1 else None
            number = page if style.endswith(".") and rng.random() < 0.3 else number
            other = None if rng.random() < 0.6 else int(rng.integers(1, 200))
        x.append(number_features(number, style, of, page, total, other, style if other is not None else None, step))
        y.append(float(real))
    return fit_logistic(np.array(x), np.array(y))


def furniture(pages: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(rid, line_no, defect): running headers and footers, and page numbers.

    Where all lines looked at on a side are furniture, the next ones inwards are looked at too.
    """
    first = found = materialise(edges(pages.withColumn("sides", F.array(F.lit(0), F.lit(1))), cfg), "edges")
    sample = found.where("slot = 0 and number is null").select("file", "slot", "text").distinct().orderBy(F.xxhash64("file", "text"), "file", "text").limit(cfg.fit_pairs)
    weights = fit_pairs([(r.file, r.slot, r.text) for r in sample.collect()], cfg), fit_numbers(cfg)
    out, start = None, 0
    while True:
        now = materialise(_judged(found, first, weights, cfg), "edge-furniture")
        out = now if out is None else out.unionByName(now)
        start += cfg.edge
        full = found.join(now, ["rid", "line_no"], "left_semi").groupBy("rid", "side").agg(F.countDistinct("slot").alias("n")).where(F.col("n") == cfg.edge)
        inner = pages.join(full.groupBy("rid").agg(F.collect_set("side").alias("sides")), "rid")
        found = materialise(edges(inner, cfg, start), "edges")
        if found.isEmpty():
            return out.groupBy("rid", "line_no").agg(F.min("defect").alias("defect"))


def _judged(found: DataFrame, first: DataFrame, weights: tuple[np.ndarray, np.ndarray], cfg: ScanConfig) -> DataFrame:
    """The furniture among the lines ``found``; pages of a file are counted over ``first``, the outermost lines.

    Lines are paired with those of the next two pages on either side, and with one other page's line of the same skeleton.
    """
    like, numbered = weights
    kept = ("rid", "line_no", "slot", "text", "number", "style", "skel")
    a = found.select("file", "side", "page", "total", "of", *(F.col(c).alias(f"a_{c}") for c in kept), F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("step"))
    # a page delivered several times stands for itself once, so that copies pair in proportion to their number
    other = found.groupBy("file", "side", (F.col("page")).alias("at"), F.col("slot").alias("b_slot"), F.col("text").alias("b_text")).agg(F.first("number").alias("b_number"), F.first("style").alias("b_style"), F.first("skel").alias("b_skel"))
    # lines further apart than the classifier ever accepts are no pairs
    close = (F.length("a_skel") > 2) & (F.abs(F.length("a_skel") - F.length("b_skel")) <= cfg.far) & (F.levenshtein("a_skel", "b_skel", cfg.far) >= 0)
    numbers = F.col("a_number").isNotNull() & F.col("b_number").isNotNull()
    both = materialise(a.withColumn("at", F.col("page") + F.col("step")).join(other, ["file", "side", "at"]).where(close | numbers), "edge-pairs")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns[2:])))
            x = np.array([pair_features(a, b, sa == sb, step) for a, b, sa, sb, step in rows]).reshape(-1, 8)
            # both lines hold words, and their numbers stay or step with the page
            hit = np.flatnonzero((logistic(x, like) > 0.5) & (x[:, 5] > 0) & (x[:, 6] > 0)) if len(x) else np.zeros(0, dtype=np.int64)
            steps = np.array([r[4] for r in rows], dtype=np.int32)[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), batch.column(1).take(pa.array(hit)), pa.array(steps)], ["rid", "line_no", "step"])

    words = both.where("a_skel is not null and b_skel is not null").select("a_rid", "a_line_no", "a_text", "b_text", "a_slot", "b_slot", "step")
    # of the neighbouring pages there are, enough must have the line too
    sides = found.select("file", "side", F.col("page").alias("at")).distinct()
    around = a.select(F.col("a_rid").alias("rid"), "file", "side", "step", (F.col("page") + F.col("step")).alias("at")).distinct().join(sides, ["file", "side", "at"]).groupBy("rid").agg(F.countDistinct("step").alias("pages"))
    met = words.mapInArrow(judge, "rid long, line_no int, step int").groupBy("rid", "line_no").agg(F.countDistinct("step").alias("met"))
    near = met.join(around, "rid").where(F.col("met") >= F.col("pages") * cfg.neighbours).select("rid", "line_no")
    # or, where headers alternate or change with the chapter, enough pages of the whole file
    of = first.groupBy("file").agg(F.countDistinct("page").alias("of"))
    place = F.struct("page", "text", "slot")
    often = found.where(F.length("skel") > 3).groupBy("file", "side", "skel").agg(F.countDistinct("page").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi")).where(F.col("n") >= cfg.least_pages)
    often = often.join(of, "file").where(F.col("n") >= F.col("of") * cfg.file_share).select("file", "side", "skel", "lo", "hi")
    far = found.join(often, ["file", "side", "skel"]).withColumn("b", F.when(F.col("page") == F.col("lo.page"), F.col("hi")).otherwise(F.col("lo")))
    wide = far.select("rid", "line_no", "text", "b.text", "slot", "b.slot", (F.col("b.page") - F.col("page")).alias("step")).toDF("rid", "line_no", "a", "b", "sa", "sb", "step").mapInArrow(judge, "rid long, line_no int, step int")
    heads = near.unionByName(wide.select("rid", "line_no")).distinct().withColumn("defect", F.lit("running_header"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([number_features(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]).reshape(-1, 5)
            hit = pa.array(np.flatnonzero(logistic(x, numbered) > 0.5) if len(x) else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(hit), batch.column(1).take(hit)], ["rid", "line_no"])

    # each number line with the number lines around it, and with none
    pairs = both.where("a_number is not null and b_number is not null").select("a_rid", "a_line_no", "a_number", "a_style", "of", "page", "total", "b_number", "b_style", "step")
    alone = found.where("number is not null").select("rid", "line_no", "number", "style", "of", "page", "total", F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(1))
    numbers = pairs.union(alone).mapInArrow(count, "rid long, line_no int").distinct().withColumn("defect", F.lit("page_number"))
    return heads.unionByName(numbers).groupBy("rid", "line_no").agg(F.min("defect").alias("defect"))


# body lines -----------------------------------------------------------------------------------------------------------


def body_lines(text: str, gone: set[int]) -> list[tuple[int, str]]:
    """(line_no, text) of the lines that are neither blank nor furniture."""
    return [(i, t) for i, line in enumerate(text.split("\n")) if i not in gone and (t := line.rstrip()) and t.strip()]


def line_break(line: str) -> tuple[str, str] | None:
    """(first part of a word, hyphen) if the line ends in the midst of one."""
    last = line.split()[-1]
    if len(last) < 2 or last[-1] not in ow.HYPHENS or not last[-2].isalnum() and last[-2] not in "@!":
        return None
    return last[:-1].lstrip("([{„”\"'«•*|"), last[-1]


def first_word(line: str) -> str:
    return line.split()[0].rstrip(".,;:?!)]}”\"»")


def _with_furniture(pages: DataFrame, gone: DataFrame) -> DataFrame:
    per_page = gone.groupBy("rid").agg(F.collect_set("line_no").alias("gone"))
    return pages.join(per_page, "rid", "left").select("rid", "file", "page", "text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def _once(body: DataFrame) -> DataFrame:
    """Each page of a file once, however often it is delivered."""
    first = body.groupBy("file", "page", F.sha2("text", 256).alias("sig")).agg(F.min_by(F.struct("text", "gone"), "rid").alias("first"))
    return first.select("first.text", "first.gone")


def word_counts(body: DataFrame) -> DataFrame:
    """(word, n) over all body lines; the parts of broken words don't count, but stand there with 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                broken = True  # the first word of a page may be the rest of one
                for _, line in body_lines(text, set(gone)):
                    tokens = line.split()
                    first, broken = int(broken), line_break(line) is not None
                    end = len(tokens) - int(broken)
                    for k, token in enumerate(tokens):
                        word = ow.word_type(token)
                        if word is not None:
                            total[word] = total.get(word, 0) + int(first <= k < end)
            if len(total) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    return body.select("text", "gone").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# broken words ---------------------------------------------------------------------------------------------------------


def join_features(left: str, right: str, hyphen: str, joined: int, compound: int, n_left: int, n_right: int) -> list[float]:
    """Features of two parts being one word; the counts are those of the word, of its hyphenated form and of the parts."""
    return [
        float(np.log1p(joined)), float(np.log1p(compound)), float(hyphen != "-"), float(right[:1].islower() or right[:1] in "!@0156"), float(left.endswith("o")), float(np.log1p(n_left)), float(np.log1p(n_right)),
        float(left.isupper()), float(joined == 0 and compound == 0),
    ]


def fit_joins(words: dict[str, int], cfg: ScanConfig) -> np.ndarray:
    """Weights of the join classifier: words cut in two, known to the corpus or not, against compounds cut at their hyphen."""
    rng = np.random.default_rng(cfg.seed)
    x, y = [], []
    if sum("-" in w for w in words) < 10 or len(words) < 100:
        made = ow.made_up_words(rng, 400)
        words = {**{w: int(rng.zipf(1.6)) for w in made}, **{f"{a}-{b}": 1 + k % 3 for k, (a, b) in enumerate(zip(made[:40], made[40:80]))}, **words}
    for word, n in words.items():
        if "-" in word.strip("-"):
            left, _, right = word.partition("-")
            for known in (n, max(1, n // 10)):
                x.append(join_features(left, right, "-", 0, known, words.get(left, 0), words.get(right, 0)))
                y.append(0.0)
        elif len(word) >= 5 and word.isalpha():
            cut = int(rng.integers(2, len(word) - 1))
            left, right = word[:cut], word[cut:]
            known = 0 if rng.random() < 0.25 else n
            hyphen = "-" if rng.random() < 0.7 else "¬"
            x.append(join_features(left, right, hyphen, known, 0, words.get(left, 0), words.get(right, 0)))
            y.append(1.0)
    x_, y_ = np.array(x), np.array(y)
    # compounds are few: each counts as often as the words do together
    few = np.flatnonzero(y_ == 0)
    more = rng.choice(few, size=max(0, int((y_ == 1).sum() // 2 - len(few))))
    return fit_logistic(np.concatenate([x_, x_[more]]), np.concatenate([y_, y_[more]]))


def breaks(body: DataFrame, counts: DataFrame, weights: np.ndarray) -> DataFrame:
    """(rid, line_no, left, right) of the lines that end in the midst of a word."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, file, page, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
                lines = body_lines(text, set(gone))
                if lines:
                    out.append((rid, file, page, -1, None, first_word(lines[0][1]), None))
                for k, (no, line) in enumerate(lines):
                    got = line_break(line)
                    if got:
                        out.append((rid, file, page, no, got[0], first_word(lines[k + 1][1]) if k + 1 < len(lines) else None, got[1]))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["rid", "file", "page", "line_no", "left", "right", "hyphen"])

    rows = materialise(body.select("rid", "file", "page", "text", "gone").mapInArrow(ends, "rid long, file long, page int, line_no int, left string, right string, hyphen string"), "line-ends")
    firsts = rows.where("line_no < 0").groupBy("file", (F.col("page") - 1).alias("page")).agg(F.min(F.struct("rid", "right")).alias("next"))
    parts = rows.where("line_no >= 0").join(firsts, ["file", "page"], "left").withColumn("right", F.coalesce("right", "next.right")).where("right is not null and right <> ''")
    low = lambda c: F.lower(c)
    keyed = parts.select("rid", "line_no", "left", "right", "hyphen", low(F.concat("left", "right")).alias("w0"), low(F.concat_ws("-", "left", "right")).alias("w1"), low("left").alias("w2"), low("right").alias("w3"))
    for i in range(4):
        keyed = keyed.join(counts.select(F.col("word").alias(f"w{i}"), F.col("n").alias(f"n{i}")), f"w{i}", "left")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([join_features(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]).reshape(-1, 9)
            hit = pa.array(np.flatnonzero(logistic(x, weights) > 0.5) if len(x) else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(hit) for i in range(4)], ["rid", "line_no", "left", "right"])

    counted = keyed.select("rid", "line_no", "left", "right", "hyphen", *(F.coalesce(f"n{i}", F.lit(0)).alias(f"n{i}") for i in range(4)))
    return counted.mapInArrow(judge, "rid long, line_no int, left string, right string")


# misread words --------------------------------------------------------------------------------------------------------


def fit_words(words: dict[str, int], cfg: ScanConfig) -> Boosted:
    """The ranking of corrections: corrupted words against natural pairs of words that are alike, both made rare, and words
    with signs, known to the corpus or not, against numbering, units, codes and the like."""
    rng = np.random.default_rng(cfg.seed)
    common = [(w, n) for w, n in words.items() if n >= 3 and w.replace("-", "").isalpha()]
    if len(common) < 100:
        common += [(w, int(rng.zipf(1.5)) + 3) for w in ow.made_up_words(rng, 400)]
    known = {**dict(common), **words}
    by_gram: dict[str, list[str]] = {}
    for w, _ in common:
        for g in ow.near_grams(w):
            by_gram.setdefault(g, []).append(w)
    x, y = [], []
    for w, n in common:
        for _ in range(3):
            read = ow.corrupted(w, rng)
            if read and read not in known:
                x.append(ow.features(read, float(rng.integers(1, max(2, int(n * 0.04) + 1))), w, n))
                y.append(1.0)
        # with signs, however often it is misread so, and the same of a word that the corpus holds nowhere else, and of numbers
        read = ow.signed(w, rng)
        if read and ow.restored(read):
            x.append(ow.features(read, float(rng.integers(1, max(5, int(n * 0.3)))), w, n))
            x.append(ow.features(read, float(rng.integers(0, 6)), ow.restored(read), 0))
            y += [1.0, 1.0]
        digits = "".join(str(d) for d in rng.integers(0, 10, int(rng.integers(1, 5)))) + rng.choice(["", "", ",5", ".10"])
        read = digits.replace("0", "O").replace("1", rng.choice(["l", "I"]))
        if read != digits:
            x.append(ow.features(read, float(rng.integers(0, 3)), digits, 0))
            y.append(1.0)
        for _ in range(2):
            regular = ow.regular_mixture(rng)
            if ow.restored(regular):
                x.append(ow.features(regular, float(rng.integers(0, 20)), ow.restored(regular), 0))
                y.append(0.0)
        own = ow.grams(w)
        met: dict[str, int] = {}
        for g in own:
            for v in by_gram.get(g, ())[: cfg.fit_alike]:
                met[v] = met.get(v, 0) + 1
        alike = sorted((v for v, k in met.items() if v != w and k * 2 >= len(own) and 0.05 <= known[v] / n <= 20), key=lambda v: (-met[v], v))[:3]
        for v in alike:
            x.append(ow.features(w, float(rng.integers(1, max(2, int(known[v] * 0.1) + 1))), v, known[v]))
            y.append(0.0)
    return Boosted().fit(np.array(x), np.array(y))


def corrections(counts: DataFrame, model: Boosted, cfg: ScanConfig) -> DataFrame:
    """(word, printed) of the word forms taken for misread.

    The candidates of a form are the frequent forms that share a third of its placed bigrams, met through the inverted
    lists of its rarest bigrams (of so many that a form which shares a third must be met), and the form in which signs stand for
    letters again, whose bigrams it shares by definition. The boosted trees decide on all of them.
    """
    # frequent forms; what holds signs or digits corrects nothing
    lexicon = counts.where((F.col("n") >= cfg.lexicon_count) & ~F.col("word").rlike(r"[@!0-9]"))

    ids = pa.list_(pa.int32())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([[_gram_id(g) for g in ow.near_grams(w)] for w in batch.column(0).to_pylist()], ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), grams], ["printed", "of", "near"])

    known = materialise(lexicon.select("word", "n").mapInArrow(listed, "printed string, of long, near array<int>"), "lexicon")
    # as many as the alphabets have pairs of letters, by place
    sizes = known.select(F.explode("near").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("size")).toArrow()
    shared = counts.sparkSession.sparkContext.broadcast(dict(zip(sizes.column("gram").to_pylist(), sizes.column("size").to_pylist())))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[_gram_id(g) for g in _unread_grams(w)] for w in batch.column(0).to_pylist()]
            lists = []
            for grams in own:
                grams = sorted(grams, key=lambda g: (shared.value.get(g, 0), g))
                lists.append([g for g in grams[: len(grams) - -(-len(grams) // 3) + 1] if g in shared.value])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, ids), pa.array(lists, ids)], ["word", "n", "own", "rare"])

    reads = materialise(counts.where("n > 0").select("word", "n").mapInArrow(rarest, "word string, n long, own array<int>, rare array<int>"), "reads")
    rare_enough = (F.col("of") >= F.col("n") * cfg.min_ratio) & ((F.col("n") <= cfg.few) | (F.col("of") >= F.col("n") * cfg.often_ratio))
    met = reads.select("word", "n", F.explode("rare").alias("gram")).join(known.select("printed", "of", F.explode("near").alias("gram")), "gram")
    met = met.where(rare_enough & (F.abs(F.length("word") - F.length("printed")) <= 2) & (F.col("word") != F.col("printed"))).select("word", "printed").distinct()
    alike = met.join(reads.drop("rare"), "word").join(known, "printed").where(F.size(F.array_intersect("own", "near")) * 3 >= F.size("own")).select("word", "n", "printed", "of")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [ow.restored(w) for w in batch.column(0).to_pylist()]
            some = pa.array([i for i, g in enumerate(got) if g], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array([g for g in got if g], pa.string())], ["word", "n", "printed"])

    plain = counts.where(F.col("word").rlike(r"[@!0-9]")).select("word", "n").mapInArrow(restore, "word string, n long, printed string")
    plain = plain.join(lexicon.select(F.col("word").alias("printed"), F.col("n").alias("of")), "printed", "left").select("word", "n", "printed", F.coalesce("of", F.lit(0)).alias("of"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([ow.features(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]).reshape(-1, len(ow.FEATURES))
            score = np.where((x[:, 2] > 3) & (x[:, 10] == 0), 0.0, model.predict(x)) if len(x) else np.zeros(0)
            hit = np.flatnonzero(score > 0.5)
            at = pa.array(hit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(score[hit])], ["word", "printed", "score"])

    best = alike.unionByName(plain).mapInArrow(rank, "word string, printed string, score double").groupBy("word").agg(F.max(F.struct("score", "printed")).alias("best"))
    return best.select("word", F.col("best.printed").alias("printed"))


def _unread_grams(word: str) -> list[str]:
    """Bigrams of a form as read and of the one in which signs and digits stand for letters again."""
    plain = ow.restored(word)
    return list(dict.fromkeys([*ow.grams(word), *ow.grams(plain)])) if plain else ow.grams(word)


def _gram_id(gram: str) -> int:
    return zlib.crc32(gram.encode()) & 0x7FFFFFFF


def word_filter(wrong: DataFrame, cfg: ScanConfig) -> tuple[int, bytes]:
    """(bits, table): the hashes of misread forms, at 16 places a form or more up to 2^cfg.filter_bits; tasks pass over words that it
    doesn't hold before the exact join."""
    bits = max(10, min(cfg.filter_bits, (16 * wrong.count()).bit_length()))
    got = wrong.select(F.pmod(F.xxhash64("word"), F.lit(1 << bits)).cast("int").alias("k")).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            table[batch.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["table"])

    # one table a task, united here
    table = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in got.coalesce(8).mapInArrow(pack, "table binary").toLocalIterator():
        table |= np.frombuffer(row.table, dtype=np.uint8)
    return bits, table.tobytes()


def misread_words(body: DataFrame, wrong: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(rid, line_no, token, word) of every misread word of a body line."""
    shared = body.sparkSession.sparkContext.broadcast(word_filter(wrong, cfg))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packed = shared.value
        table = np.unpackbits(np.frombuffer(packed, dtype=np.uint8))
        seen: dict[str, str | None] = {}
        for batch in batches:
            out = []
            for rid, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
                for no, line in body_lines(text, set(gone)):
                    for token in line.split():
                        word = seen.get(token, "")
                        if word == "":
                            if len(seen) > 500_000:
                                seen.clear()
                            word = ow.word_type(token)
                            if word is not None and not table[xxhash.xxh64_intdigest(word, seed=42) & ((1 << bits) - 1)]:
                                word = None
                            seen[token] = word
                        if word is not None:
                            out.append((rid, no, token, word))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()))], ["rid", "line_no", "token", "word"])

    hits = body.select("rid", "text", "gone").mapInArrow(look, "rid long, line_no int, token string, word string")
    return hits.join(wrong, "word", "left_semi").select("rid", "line_no", "token", "word")


# the whole ------------------------------------------------------------------------------------------------------------


@dataclass
class Findings:
    pages: DataFrame
    furniture: DataFrame  # rid, line_no, defect
    broken: DataFrame  # rid, line_no, left, right
    misread: DataFrame  # rid, line_no, token, word
    wrong: DataFrame  # word, printed


def analyse(records: DataFrame, cfg: ScanConfig = ScanConfig()) -> Findings:
    """All defects of a table of pages. Null texts have none; rows that repeat a page are looked at each for itself."""
    pages = _pages(records, cfg)
    gone = materialise(furniture(pages, cfg), "furniture")
    body = _with_furniture(pages, gone)
    counts = materialise(word_counts(_once(body)), "words")
    # the learners see the most frequent words and compounds, at most cfg.fit_words of each
    top = counts.where(~F.col("word").contains("-")).orderBy(F.desc("n"), "word").limit(cfg.fit_words)
    hyphened = counts.where(F.col("word").contains("-")).orderBy(F.desc("n"), "word").limit(cfg.fit_words)
    words = {r.word: r.n for r in top.unionByName(hyphened).collect()}
    broken = breaks(body, counts, fit_joins(words, cfg))
    wrong = materialise(corrections(counts, fit_words(words, cfg), cfg), "misread")
    return Findings(pages, gone, broken, misread_words(body, wrong, cfg), wrong)


def defects(records: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """(record_id, line_no, defect), each once."""
    got = analyse(records, cfg)
    rows = got.furniture.unionByName(got.broken.select("rid", "line_no", F.lit("broken_word").alias("defect"))).unionByName(got.misread.select("rid", "line_no", F.lit("misread").alias("defect")))
    return rows.distinct().select(F.col("rid").alias(cfg.id_col), "line_no", "defect")


def repair_page(text: str, gone: set[int], broken: dict[int, str], fixes: dict[str, str], carried: bool) -> str:
    """A page's body as paragraphs: furniture gone, words joined and corrected. ``carried``: its first word stands on the page before."""
    paragraphs: list[list[str]] = [[]]
    skip = carried
    previous = ""
    longest = max((len(x) for x in text.split("\n")), default=0)
    for no, line in enumerate(text.split("\n")):
        if no in gone:
            continue
        tokens = line.split()
        if not tokens:
            if paragraphs[-1] and not skip:
                paragraphs.append([])
            continue
        if paragraphs[-1] and not skip and previous[-1:] in ".!?:" and len(previous) < 0.7 * longest:
            paragraphs.append([])
        if skip:
            tail = tokens[0][len(first_word(line)) :]
            tokens = tokens[1:]
            if tail and paragraphs[-1]:
                paragraphs[-1][-1] += tail
        skip = no in broken
        if skip and tokens:
            head = tokens[-1]
            tokens[-1] = head[: len(head) - len(head.lstrip("([{„”\"'«•*|"))] + broken[no]
        for token in tokens:
            core = ow.trimmed(token)
            fixed = fixes.get(token)
            paragraphs[-1].append(token.replace(core, fixed, 1) if fixed and core else token)
        previous = line.strip()
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def repaired(records: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """(record_id, text) of every page with text, as continuous paragraphs; a word broken over two pages stands on the first."""
    got = analyse(records, cfg)
    gone = got.furniture.groupBy("rid").agg(F.collect_set("line_no").alias("gone"))
    joined = got.broken.groupBy("rid").agg(F.collect_list(F.struct("line_no", F.concat("left", "right").alias("word"))).alias("broken"))
    fixes = got.misread.join(got.wrong, "word").groupBy("rid").agg(F.collect_set(F.struct("token", "printed")).alias("fixes"))
    last = got.broken.groupBy("rid").agg(F.max("line_no").alias("last"))
    body_end = _with_furniture(got.pages, got.furniture)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [(lines[-1][0] if (lines := body_lines(text, set(g))) else -1) for text, g in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ends, pa.int32())], ["rid", "file", "page", "end"])

    carried = body_end.mapInArrow(tails, "rid long, file long, page int, end int").join(last, "rid").where("last = end").select("file", (F.col("page") + 1).alias("page")).distinct().withColumn("carried", F.lit(True))
    rows = got.pages.join(gone, "rid", "left").join(joined, "rid", "left").join(fixes, "rid", "left").join(carried, ["file", "page"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, g, b, f, c in zip(*(x.to_pylist() for x in batch.columns[1:])):
                fix = {x["token"]: (x["printed"].capitalize() if ow.trimmed(x["token"])[:1].isupper() else x["printed"]) for x in f or ()}
                out.append(repair_page(text, set(g or ()), {x["line_no"]: x["word"] for x in b or ()}, fix, bool(c)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [cfg.id_col, "text"])

    return rows.select("rid", "text", "gone", "broken", "fixes", "carried").mapInArrow(write, f"{cfg.id_col} long, text string")
