"""Article text and metadata of HTML pages: irregular grammar, so Arrow batches through the standard parser."""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: elements that are no article text, and where an article is looked for, in this order
DROPPED_TAGS = {"nav", "header", "footer", "aside", "script", "style", "noscript", "iframe"}
DROPPED_CLASSES = {
    "sidebar", "widget", "cookie", "cookie-banner", "cookie-notice", "comment", "comments", "comment-section", "related-posts", "newsletter", "social-share", "breadcrumb", "pagination",
}
ARTICLE = (("tag", "article"), ("class", "entry-content"), ("class", "post-content"))
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Article:
    text: str = ""
    title: str = ""
    published: str = ""


class _Reader(HTMLParser):
    """Collects the text of every candidate container outside of dropped elements, and the page's metadata."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int | None]] = []  # tag, dropped, container of this element
        self.texts: list[list[str]] = []
        self.kinds: list[int] = []
        self.meta: dict[str, str] = {}
        self.heading: list[str] = []
        self.title: list[str] = []
        self.time = ""
        self.done_heading = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            for key in ("property", "name"):
                if a.get(key) and a.get("content"):
                    self.meta.setdefault(f"{key}:{a[key]}", a["content"])
        if tag == "time" and a.get("datetime") and not self.time:
            self.time = a["datetime"]
        if tag in _VOID:
            return
        classes = set(a.get("class", "").split())
        dropped = tag in DROPPED_TAGS or bool(classes & DROPPED_CLASSES)
        kind = next((i for i, (by, name) in enumerate(ARTICLE) if (tag == name if by == "tag" else name in classes)), None)
        container = None
        if kind is not None and not dropped and not any(d for _, d, _ in self.open):
            container = len(self.texts)
            self.texts.append([])
            self.kinds.append(kind)
        self.open.append((tag, dropped, container))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            self.done_heading |= any(t == "h1" for t, _, _ in self.open[at:])
            del self.open[at:]

    def handle_data(self, data):
        tags = [t for t, _, _ in self.open]
        if "title" in tags:
            self.title.append(data)
        if "h1" in tags and not self.done_heading:
            self.heading.append(data)
        piece = data.strip()
        if piece and not any(d for _, d, _ in self.open):
            for _, _, container in self.open:
                if container is not None:
                    self.texts[container].append(piece)


def read_article(page: str) -> Article:
    """Text of the first article-like element without furniture, one line per text node; title; date as written."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    first = min(range(len(reader.texts)), key=lambda i: (reader.kinds[i], i), default=None)
    lines = [] if first is None else [line for piece in reader.texts[first] for line in piece.splitlines() if line.strip()]
    meta = lambda name: reader.meta.get(f"property:{name}") or reader.meta.get(f"name:{name}") or ""
    title = meta("og:title") or "".join(reader.heading).strip() or "".join(reader.title).strip()
    published = meta("article:published_time") or meta("article:modified_time") or meta("og:updated_time") or reader.time
    return Article("\n".join(lines), title, published)


ARTICLE_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "title", "published")])


@F.pandas_udf(ARTICLE_TYPE)
def article(pages: pd.Series) -> pd.DataFrame:
    """``text``, ``title`` and ``published`` of each page; nulls for null."""
    got = [None if p is None else read_article(p) for p in pages]
    return pd.DataFrame({name: [None if g is None else getattr(g, name) for g in got] for name in ("text", "title", "published")})


def iso_date(raw):
    """A published date as ``YYYY-MM-DD``, empty where it can't be read."""
    tried = [F.try_to_timestamp(raw), F.try_to_timestamp(raw, F.lit("dd.MM.yyyy")), F.try_to_timestamp(raw, F.lit("d MMMM yyyy"))]
    return F.coalesce(F.date_format(F.coalesce(*tried), "yyyy-MM-dd"), F.lit(""))
