"""Page boilerplate mixed with main content (problem 3).

A page is a row of lines; a line is a bag of tokens: its words, its tags, the tags open around it and where it stands. Every
token has a weight, positive where it speaks for the main body and negative where it speaks against it. The weights are
fitted on labelled pages: pages of the corpus whose classes name its furniture (menus, notices, related posts ...) and its
article; each of them is learned from twice, with its tags and as a plain text dump. The names of classes only give the
labels and are no tokens. A linear scan then finds the contiguous region with the greatest sum of weights, the main body;
the same scan with signs reversed finds the blocks of furniture that stand between its paragraphs.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import spread

BITS = 15
# fixed values: names by which markup says what a block is
BODY_TAGS = {"article", "main"}
BODY_CLASSES = {"entry-content", "post-content", "article-body", "article-content"}
FURNITURE_TAGS = {"nav", "aside", "footer", "header", "form"}
FURNITURE_CLASSES = {
    "menu", "sidebar", "widget", "related-posts", "cookie-banner", "cookie-notice", "comments", "social-share", "share", "ad", "ads",
    "newsletter", "breadcrumb", "breadcrumbs", "author-box", "entry-meta", "post-meta", "byline", "footer", "header", "navigation", "pagination",
}
HIDDEN_TAGS = {"script", "style", "head", "noscript", "template", "iframe"}
VOID_TAGS = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "col", "area", "base", "embed", "track", "param"}
BLOCK_TAGS = {"div", "section", "nav", "aside", "footer", "header", "article", "main", "form", "ul", "ol", "table", "blockquote", "figure", "body", "html", "head"}

_MARKUP = re.compile(r"<(?:!doctype|html|body|head|div|p|article|section|nav|li|h[1-6])[\s>]", re.I)
_TAG = re.compile(r"<!--.*?-->|<!doctype[^>]*>|<(/?)([a-zA-Z][\w-]*)([^<>]*)>", re.S | re.I)
_CLASS = re.compile(r"class\s*=\s*[\"']([^\"']*)[\"']", re.I)
_WORD = re.compile(r"[^\W\d_]+|\d+")
_MARKS = re.compile("[̀-ͯ]+")
_BLANK = re.compile(r"\s+")


@dataclass(frozen=True)
class ContentConfig:
    """``fit_pages``: pages with classes, those with the least id hashes, of which the labelled ones are what the weights are fitted on."""

    fit_pages: int = 4000
    rounds: int = 120
    id_col: str = "record_id"
    title_col: str = "title"
    text_col: str = "page_content"


@dataclass
class Line:
    no: int
    text: str
    body: bool = False  # inside an element that names itself the article
    furniture: bool = False  # inside an element that names itself furniture
    wrapped: int = 0  # classed or sectioning blocks open inside the article (or inside the page)
    tags: tuple[str, ...] = ()
    around: tuple[str, ...] = ()  # the block tags open


def _fold(text: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", text).casefold()).replace("ł", "l")


def is_markup(page: str) -> bool:
    """Whether a page is markup; the hint of its content type may be wrong."""
    return bool(_MARKUP.search(page))


def plain_lines(page: str) -> list[Line]:
    """Lines of a text dump that show text."""
    return [Line(i, t) for i, line in enumerate(page.split("\n")) if (t := _BLANK.sub(" ", line).strip())]


def markup_lines(page: str) -> tuple[list[Line], bool]:
    """(lines of a markup page that show text, whether its blocks name themselves)."""
    out: list[Line] = []
    stack: list[tuple[str, str, bool]] = []  # tag, kind (body, furniture, hidden, wrap, other), sectioning
    named = False
    no, parts, tags = 0, [], []
    seen: Line | None = None

    def state() -> Line:
        kinds = [k for _, k, _ in stack]
        last = max((i for i, k in enumerate(kinds) if k == "body"), default=-1)
        return Line(no, "", "body" in kinds, "furniture" in kinds[last + 1 :], sum(k in ("wrap", "furniture") for k in kinds[last + 1 :]), (), tuple(t for t, _, block in stack if block))

    def text(chunk: str) -> None:
        nonlocal no, parts, tags, seen
        pieces = chunk.split("\n")
        for i, piece in enumerate(pieces):
            if i:
                flush()
                no += 1
            if piece.strip() and not any(k == "hidden" for _, k, _ in stack):
                if seen is None or "h1" in (t for t, _, _ in stack):
                    seen = state()
                parts.append(piece)

    def flush() -> None:
        nonlocal parts, tags, seen
        shown = _BLANK.sub(" ", html.unescape(" ".join(parts) if len(parts) > 1 else "".join(parts))).strip()
        if shown and seen is not None:
            seen.text, seen.tags = shown, tuple(tags)
            out.append(seen)
        parts, tags, seen = [], [], None

    at = 0
    for m in _TAG.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            no_before = m.group(0).count("\n")
            for _ in range(no_before):
                flush()
                no += 1
            continue
        close, tag, rest = m.group(1), m.group(2).lower(), m.group(3)
        tags.append(("/" if close else "") + tag)
        if close:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
        elif tag not in VOID_TAGS and not rest.rstrip().endswith("/"):
            found = _CLASS.search(rest)
            classes = set(found.group(1).lower().split()) if found else set()
            if tag in HIDDEN_TAGS:
                kind = "hidden"
            elif tag in FURNITURE_TAGS or classes & FURNITURE_CLASSES:
                kind, named = "furniture", named or bool(classes & FURNITURE_CLASSES)
            elif tag in BODY_TAGS or classes & BODY_CLASSES:
                kind = "body"
            elif classes and tag in BLOCK_TAGS:
                kind = "wrap"
            else:
                kind = "other"
            stack.append((tag, kind, tag in BLOCK_TAGS))
        if "\n" in rest:
            for _ in range(rest.count("\n")):
                flush()
                no += 1
    text(page[at:])
    flush()
    return out, named


def _shape(text: str, words: list[str]) -> str:
    n = len(words)
    size = 0 if n <= 1 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 10 else 4 if n <= 18 else 5
    end = text[-1] if text[-1] in ".!?:»…”\"])" else "a" if text[-1].isalpha() else "9" if text[-1].isdigit() else "-"
    first = text[0]
    start = "U" if first.isupper() else "l" if first.islower() else "9" if first.isdigit() else first if first in "„\"[•»*©-–" else "-"
    return f"{size}{start}{end}"


class Tokens:
    """Token ids of lines; remembers the tokens, the lines and the tags seen."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.texts: dict[str, tuple[list[str], str, list[int]]] = {}
        self.places: dict[tuple, list[int]] = {}

    def id(self, token: str) -> int:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 400_000:
                self.known.clear()
            got = self.known[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        return got

    def text(self, t: str) -> tuple[list[str], str, list[int]]:
        """(words, shape, token ids) of a line by itself."""
        found = self.texts.get(t)
        if found is not None:
            return found
        w = _WORD.findall(_fold(t))
        s = _shape(t, w)
        got = ["bias", f"s={s}", f"len={s[0]}", f"end={s[2]}", f"start={s[1]}"]
        got += ["w=" + ("0" if x.isdigit() else x) for x in set(w)]
        if len(w) > 1:
            got += [f"b={w[0]} {w[1]}", f"e={w[-2]} {w[-1]}" if not w[-1].isdigit() else "e=0"]
        if t.isupper():
            got.append("caps")
        if t.isascii() and s[0] >= "3":
            got.append("ascii" + s[1])
        got += [f"has{sign}{s[0]}" for sign in ("|", "·", " > ", " / ", "–", "©", "\u00a0", "(") if sign in t]
        if w and sum(x.isdigit() for x in w) * 3 >= len(w):
            got.append("digits" + s[0])
        if len(self.texts) > 50_000:
            self.texts.clear()
        found = self.texts[t] = w, s, [self.id(x) for x in got]
        return found

    def place(self, line: Line) -> list[int]:
        """Token ids of a line's tags and of those open around it."""
        key = line.around, line.tags
        found = self.places.get(key)
        if found is None:
            if len(self.places) > 50_000:
                self.places.clear()
            got = ["markup", f"deep={min(len(line.around), 6)}", *(f"in={x}" for x in set(line.around)), f"on={' '.join(line.around[-2:])}", *(f"tag={x}" for x in set(line.tags)), f"first={line.tags[:1]}"]
            found = self.places[key] = [self.id(x) for x in got]
        return found

    def page(self, lines: list[Line], title: str | None, markup: bool) -> list[list[int]]:
        """The token ids of every line of a page."""
        n = len(lines)
        seen = [self.text(line.text) for line in lines]
        shapes = [s for _, s, _ in seen]
        prose = [s[0] >= "3" and s[1] in "U„\"" and s[2] in ".!?" for s in shapes]
        before = np.concatenate(([0], np.cumsum(prose))).tolist()
        total = before[-1]
        name = _WORD.findall(_fold(title or ""))
        joined = "".join(name)
        out = []
        for i, (line, (w, s, own)) in enumerate(zip(lines, seen)):
            got = []
            for j in (-2, -1, 1, 2):
                k = i + j
                if 0 <= k < n:
                    got.append(f"n{j}={shapes[k]}")
                    if j in (-1, 1):
                        got.append(f"n{j}w={' '.join(seen[k][0][:2])}")
                else:
                    got.append(f"n{j}=none")
            ahead, behind = total - before[i + 1], before[i]
            got += [f"ahead={min(ahead, 3)}", f"behind={min(behind, 3)}", f"ab={min(ahead, 2)}{min(behind, 2)}{s[0]}", f"total={min(total, 4)}", f"abe={min(ahead, 1)}{min(behind, 1)}{s}"]
            got += [f"top={min(i, 4)}", f"foot={min(n - i, 4)}"]
            if name:
                if w == name:
                    got += ["title", f"title{min(behind, 1)}"]
                elif len(w) > 3 and joined.startswith("".join(w[-3:])):
                    got.append("titlepart")
            else:
                got.append("untitled")
            ids = own + [self.id(x) for x in got]
            out.append(ids + self.place(line) if markup else ids)
        return out


@dataclass
class Weights:
    token: np.ndarray
    least: float = 0.0  # sum that a page's best region must exceed to be an article
    floor: float = -6.0  # a line takes no more than this from its region's sum, so that a notice doesn't part an article
    cut: float = 0.0  # sum that a block inside the region must fall below zero by to be furniture

    def regional(self, score: np.ndarray) -> np.ndarray:
        return np.clip(score, self.floor, 6.0)


def default_weights() -> Weights:
    """For corpora without labelled pages: prose between prose is content, short lines are not."""
    ids, w = Tokens(), np.zeros(1 << BITS, dtype=np.float32)
    for token, value in (("bias", -0.5), ("len=0", -1.5), ("len=1", -1.0), ("len=2", -0.3), ("len=4", 1.0), ("len=5", 2.0), ("end=.", 1.0), ("end=?", 1.0), ("end=!", 0.7), ("in=article", 2.0), ("in=main", 1.0), ("in=nav", -6.0), ("in=aside", -6.0), ("in=footer", -6.0), ("in=header", -4.0), ("in=form", -4.0), ("title", 4.0), ("caps", -1.0)):
        w[ids.id(token)] = value
    return Weights(w, 1.0, -1.5)


def scores(rows: list[list[int]], weights: Weights) -> np.ndarray:
    """The sum of token weights of every line."""
    lens = np.array([len(r) for r in rows], dtype=np.int64)
    if not len(lens):
        return np.zeros(0)
    flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(lens.sum()))
    return np.add.reduceat(weights.token[flat], np.cumsum(lens) - lens)


def best_region(score: np.ndarray) -> tuple[int, int, float]:
    """(first, end, sum) of the contiguous run with the greatest sum, found in one scan; the first of equal ones."""
    best, at, sum_, start = (0, 0, 0.0), 0, 0.0, 0
    for i, x in enumerate(score.tolist()):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += x
        if sum_ > best[2]:
            best = (start, i + 1, sum_)
    return best


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, sum) of all maximal-scoring contiguous segments, in one scan: the best one, the best ones beside it and so on."""
    found: list[tuple[int, int, float, float]] = []  # first, end, sums before and after
    total = 0.0
    for i, x in enumerate(score.tolist()):
        before, total = total, total + x
        if x <= 0:
            continue
        first, end, left, right = i, i + 1, before, total
        while True:
            j = next((k for k in range(len(found) - 1, -1, -1) if found[k][2] < left), None)
            if j is None or found[j][3] >= right:
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
        found.append((first, end, left, right))
    return [(first, end, right - left) for first, end, left, right in found]


def main_lines(score: np.ndarray, weights: Weights) -> np.ndarray:
    """Which lines are main body: those of the best region but for the blocks of furniture inside it, found with the same scores."""
    first, end, total = best_region(weights.regional(score))
    keep = np.zeros(len(score), dtype=bool)
    if total > weights.least:
        keep[first:end] = True
        inside = weights.regional(score[first:end])
        for a, b, against in maximal_segments(-inside) if (inside < 0).any() else ():
            if against > weights.cut:
                keep[first + a : first + b] = False
    return keep


def fit_weights(rows: list[list[int]], label: np.ndarray, pages: np.ndarray, rounds: int) -> Weights:
    """Logistic regression on token bags by full-batch gradients with adaptive steps; then the floor and the least region sum."""
    if not len(rows) or label.all() or not label.any():
        return default_weights()
    lens = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(lens.sum()))
    heads, line = np.cumsum(lens) - lens, np.repeat(np.arange(len(rows)), lens)
    w, past = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[flat], heads), -30, 30)))
        grad = np.bincount(flat, weights=(p - label)[line], minlength=1 << BITS) + 0.3 * w
        past += grad * grad
        w -= 0.35 * grad / np.sqrt(past)
    weights = Weights(w.astype(np.float32))
    got = scores(rows, weights)
    cuts = np.flatnonzero(np.concatenate(([True], pages[1:] != pages[:-1], [True])))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    best = None
    for floor in (-6.0, -3.0, -1.5, -0.75, -0.4, -0.2):
        weights.floor = floor
        regions = [best_region(weights.regional(got[a:b])) for a, b in spans]
        for cut in (0.0, 0.05, 0.1, 0.2):
            weights.cut, weights.least = cut, 0.0
            wrong = sum(int((main_lines(got[a:b], weights) != label[a:b]).sum()) for a, b in spans)
            if best is None or wrong < best[0]:
                best = (wrong, floor, regions, cut)
    weights.cut = best[3]
    weights.floor = best[1]
    sums, has = np.array([r[2] for r in best[2]]), np.array([label[a:b].any() for a, b in spans])
    tries = np.unique(np.concatenate(([0.0], sums[~has])))
    weights.least = float(min(tries, key=lambda t: (((sums > t) != has).sum(), t)))
    return weights


def labelled(page: str) -> list[tuple[Line, bool]] | None:
    """The lines of a markup page whose blocks name themselves, with their label (main body); None for all other pages."""
    if not is_markup(page):
        return None
    lines, named = markup_lines(page)
    if not named or any(line.wrapped and not line.furniture for line in lines):
        return None
    return [(line, line.body and not line.furniture) for line in lines]


def train(pages: DataFrame, cfg: ContentConfig = ContentConfig()) -> Weights:
    """Weights from a bounded sample of the labelled pages of a corpus."""
    hinted = pages.where(F.col(cfg.text_col).rlike("(?i)class\\s*=\\s*[\"']"))
    rows = hinted.select(F.xxhash64(cfg.id_col).alias("h"), F.col(cfg.title_col).alias("title"), F.col(cfg.text_col).alias("text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Tokens()
        for batch in batches:
            hs, views, labels, bags = [], [], [], []
            for h, title, text in zip(*(c.to_pylist() for c in batch.columns)):
                got = labelled(text)
                if got is None:
                    continue
                lines, label = [x for x, _ in got], [y for _, y in got]
                bare = [Line(line.no, line.text) for line in lines]
                for view, bag in ((0, ids.page(lines, title, True)), (1, ids.page(bare, title, False))):
                    hs += [h] * len(bag)
                    views += [view] * len(bag)
                    labels += label
                    bags += bag
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(views, pa.int32()), pa.array(labels, pa.bool_()), pa.array(bags, pa.list_(pa.int32()))], ["h", "view", "label", "bag"])

    chosen = rows.orderBy("h", "text").limit(cfg.fit_pages)
    got = chosen.repartition(pages.sparkSession.sparkContext.defaultParallelism).mapInArrow(tokens, "h long, view int, label boolean, bag array<int>").toArrow()
    h, view = got.column("h").to_numpy(), got.column("view").to_numpy()
    # full pages and dumps of the same page are pages of their own; the order within a page is kept
    page = np.unique(np.stack([h, view], axis=1), axis=0, return_inverse=True)[1].ravel() if len(h) else h
    by = np.argsort(page, kind="stable")
    bags = got.column("bag").to_pylist()
    return fit_weights([bags[i] for i in by], got.column("label").to_numpy(zero_copy_only=False)[by], page[by], cfg.rounds)


def page_lines(page: str, title: str | None, weights: Weights, ids: Tokens) -> list[tuple[Line, bool]]:
    """The lines of a page that show text, each with whether it is main body."""
    markup = is_markup(page)
    lines = markup_lines(page)[0] if markup else plain_lines(page)
    keep = main_lines(scores(ids.page(lines, title, markup), weights), weights)
    return list(zip(lines, keep.tolist()))


def classified(pages: DataFrame, cfg: ContentConfig = ContentConfig(), weights: Weights | None = None) -> DataFrame:
    """(record_id, line_no, text, main): every line that shows text, in pages with content.

    Null and blank pages have no lines; rows that repeat an id are pages of their own.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or train(pages, cfg))  # 2^BITS numbers

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Tokens()
        for batch in batches:
            rid, no, text, main = [], [], [], []
            for r, title, page in zip(*(c.to_pylist() for c in batch.columns)):
                for line, keep in page_lines(page, title, shared.value, ids):
                    rid.append(r)
                    no.append(line.no)
                    text.append(line.text)
                    main.append(keep)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(no, pa.int32()), pa.array(text, pa.string()), pa.array(main, pa.bool_())], ["record_id", "line_no", "text", "main"])

    rows = pages.where(F.col(cfg.text_col).isNotNull()).select(F.col(cfg.id_col).cast("long").alias("record_id"), F.col(cfg.title_col).alias("title"), F.col(cfg.text_col).alias("text"))
    return spread(rows).mapInArrow(split, "record_id long, line_no int, text string, main boolean")


def furniture(pages: DataFrame, cfg: ContentConfig = ContentConfig()) -> DataFrame:
    """(record_id, line_no) of every line that shows text outside the main body."""
    return classified(pages, cfg).where("not main").select("record_id", "line_no")


def extract(pages: DataFrame, cfg: ContentConfig = ContentConfig(), weights: Weights | None = None) -> DataFrame:
    """(record_id, main_content) of every row of ``pages``: the main body's lines, null for null pages, empty without an article."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or train(pages, cfg))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Tokens()
        for batch in batches:
            out = [None if page is None else "\n".join(line.text for line, keep in page_lines(page, title, shared.value, ids) if keep) for title, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["record_id", "main_content"])

    rows = pages.select(F.col(cfg.id_col).cast("long").alias("record_id"), F.col(cfg.title_col).alias("title"), F.col(cfg.text_col).alias("text"))
    return spread(rows).mapInArrow(cut, "record_id long, main_content string")
