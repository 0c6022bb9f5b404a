"""Evaluation texts leaking into training text (problem 6).

A positional inverted index of the training text is written to the shared folder: every input batch is a block of
documents, and a block holds one row per term with its documents and positions as compressed lists. To find a passage,
its terms are ordered by their document counts in the index; positions with the rarest terms are chosen so that every
``GAP`` consecutive positions hold one. Their lists, shifted by the offset of the term in the passage, are intersected
on (document, item, diagonal); where two meet, which no reportable match can avoid, the lists of all other terms are
looked up along the diagonal, and runs of hits are returned as exact phrases or as proximity matches.

Blocks divide the documents, so a term's list is never gathered in one place, however frequent the term is.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import new_table, spread

#: Of every so many consecutive positions one is probed. 12 words then hold two probed ones at least, and so do the words
#: left of 30 or more when one in eight is replaced.
GAP, LEAST_MET = 5, 2
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_MARKS = re.compile("[̀-ͯ]+")
_WORD = re.compile(r"[^\W_]+")

INDEX_SCHEMA = "block long, term long, docs int, doc_ids binary, counts binary, positions binary"


@dataclass(frozen=True)
class LeakConfig:
    """``exact``: words of a phrase; ``near``: least words of a proximity match, of which one in ``one_in`` may be replaced.
    ``block_docs``, ``block_chars``: size of a block of the index. ``broadcast_words``: words of passages that tasks get at
    once; a larger test set is searched in several passes.
    """

    exact: int = 12
    near: int = 30
    one_in: int = 8
    block_docs: int = 4096
    block_chars: int = 16_000_000
    broadcast_words: int = 2_000_000


def words(text: str) -> list[str]:
    """Runs of letters or digits without case, diacritics and inline markup."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text).casefold()).replace("ł", "l"))


class TermIds:
    """64-bit ids of words; remembers those seen."""

    def __init__(self, limit: int = 1_000_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def of(self, tokens: list[str]) -> list[int]:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        try:
            return [known[t] for t in tokens]
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = xxhash.xxh64_intdigest(t) - (1 << 63)
            return [known[t] for t in tokens]


def index_block(doc_ids: np.ndarray, texts: list[str], ids: TermIds) -> pa.RecordBatch:
    """Posting lists of one block of documents, sorted by term."""
    rows = [ids.of(words(t)) for t in texts]
    lens = np.array([len(r) for r in rows], dtype=np.int64)
    term = np.fromiter((t for r in rows for t in r), dtype=np.int64, count=int(lens.sum()))
    doc = np.repeat(np.arange(len(rows)), lens)
    pos = np.arange(len(term)) - np.repeat(np.cumsum(lens) - lens, lens)
    by = np.argsort(term, kind="stable")  # documents and positions keep their order
    term, doc, pos = term[by], doc[by], pos[by].astype(np.int32)
    heads = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, dtype=np.int64)
    own = np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))) if len(term) else np.zeros(0, dtype=bool)
    firsts = np.flatnonzero(own)
    per_doc = np.diff(np.append(firsts, len(term))).astype(np.int32)
    doc_of = doc_ids[doc[firsts]]
    lists = np.searchsorted(firsts, np.append(heads, len(term)))
    ends = np.append(heads[1:], len(term))
    block = xxhash.xxh64_intdigest(doc_ids.tobytes()) - (1 << 63)
    ids_raw, counts_raw, pos_raw = doc_of.astype(np.int64).tobytes(), per_doc.tobytes(), pos.tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(heads), block, dtype=np.int64)),
            pa.array(term[heads]),
            pa.array(np.diff(lists).astype(np.int32)),
            pa.array([ids_raw[a * 8 : b * 8] for a, b in zip(lists[:-1], lists[1:])], pa.binary()),
            pa.array([counts_raw[a * 4 : b * 4] for a, b in zip(lists[:-1], lists[1:])], pa.binary()),
            pa.array([pos_raw[a * 4 : b * 4] for a, b in zip(heads, ends)], pa.binary()),
        ],
        ["block", "term", "docs", "doc_ids", "counts", "positions"],
    )


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: LeakConfig = LeakConfig(), path: str | None = None) -> DataFrame:
    """Write the positional index of all documents with text and read it back: ``INDEX_SCHEMA``.

    An index that stands at ``path`` already is extended by these documents; what it holds is not read for that.
    """
    most_docs, most_chars = cfg.block_docs, cfg.block_chars

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, doc_ids, texts, chars = TermIds(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                texts.append(text)
                chars += len(text)
                if len(texts) >= most_docs or chars >= most_chars:
                    yield index_block(np.array(doc_ids, dtype=np.int64), texts, ids)
                    doc_ids, texts, chars = [], [], 0
        if texts:
            yield index_block(np.array(doc_ids, dtype=np.int64), texts, ids)

    rows = documents.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = path or new_table(documents.sparkSession, "postings")
    spread(rows).mapInArrow(blocks, INDEX_SCHEMA).write.mode("append").option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


def passage_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "passage") -> DataFrame:
    """(item_id, at, term) of every word of every passage."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds()
        for batch in batches:
            rows = [ids.of(words(t)) for t in batch.column(1).to_pylist()]
            lens = [len(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), lens)), pa.array([i for n in lens for i in range(n)], pa.int32()), pa.array([t for r in rows for t in r], pa.int64())], ["item_id", "at", "term"]
            )

    rows = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("passage")).distinct()
    return rows.mapInArrow(split, "item_id long, at int, term long")


def choose_probes(frequency: np.ndarray, gap: int = GAP) -> np.ndarray:
    """Positions so that every ``gap`` consecutive ones hold a chosen one: the rarest of each window, the last of equals."""
    n = len(frequency)
    if n <= gap:
        return np.array([int(np.argmin(frequency))]) if n else np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(frequency, gap)[:, ::-1]
    return np.unique(np.arange(n - gap + 1) + gap - 1 - views.argmin(axis=1))


def runs(hits: np.ndarray, size: int, cfg: LeakConfig) -> tuple[bool, bool]:
    """Whether sorted positions hit on one diagonal hold an exact phrase, and whether they hold a proximity match.

    ``size`` is the number of the passage's positions. A window of at least ``near`` of them matches if no more than one in
    ``one_in`` is missed, wherever in the window; both are found in one scan.
    """
    if len(hits) < min(cfg.exact, cfg.near - cfg.near // cfg.one_in):
        return False, False
    exact = len(hits) >= cfg.exact and bool((hits[cfg.exact - 1 :] - hits[: len(hits) - cfg.exact + 1] == cfg.exact - 1).any())
    if size < cfg.near:
        return exact, False
    gain = np.full(size, 1 - cfg.one_in)
    gain[hits] = 1
    total = np.concatenate(([0], np.cumsum(gain)))  # a window matches if its gains don't sum below zero
    least = np.minimum.accumulate(total[: size + 1 - cfg.near])
    return exact, bool((total[cfg.near :] >= least).any())


def _decode(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, doc, position) of the lists of some index rows."""
    doc_ids = [np.frombuffer(b, dtype=np.int64) for b in rows.doc_ids]
    counts = [np.frombuffer(b, dtype=np.int32) for b in rows.counts]
    pos = [np.frombuffer(b, dtype=np.int32) for b in rows.positions]
    row = np.repeat(np.arange(len(rows)), [len(p) for p in pos])
    doc = np.concatenate([np.repeat(d, c) for d, c in zip(doc_ids, counts)]) if len(rows) else np.zeros(0, dtype=np.int64)
    return row, doc, np.concatenate(pos).astype(np.int64) if len(rows) else np.zeros(0, dtype=np.int64)


def _expand(row: np.ndarray, doc: np.ndarray, pos: np.ndarray, terms: np.ndarray, items: dict) -> tuple[np.ndarray, ...]:
    """Join postings with the passages' places of their terms: (doc, item, diagonal, place)."""
    starts, sizes, item, at = items["start"], items["size"], items["item"], items["at"]
    t = np.searchsorted(items["term"], terms)
    size = sizes[t][row]
    pick = np.repeat(np.arange(len(row)), size)
    inner = np.arange(len(pick)) - np.repeat(np.cumsum(size) - size, size)
    entry = starts[t][row[pick]] + inner
    return doc[pick], item[entry], pos[pick] - at[entry], at[entry]


def _by_term(item: np.ndarray, at: np.ndarray, term: np.ndarray) -> dict:
    order = np.lexsort((at, item, term))
    item, at, term = item[order], at[order], term[order]
    heads = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, dtype=np.int64)
    return {"term": term[heads], "start": heads, "size": np.diff(np.append(heads, len(term))), "item": item, "at": at.astype(np.int64)}


def _matches(block: pd.DataFrame, passages: dict, probes: dict, cfg: LeakConfig) -> pd.DataFrame:
    """The matches within one block: probe lists first, then a look at all lists along the diagonals met."""
    none = pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "item_id": pd.Series(dtype="int64"), "exact": pd.Series(dtype="bool"), "near": pd.Series(dtype="bool")})
    rare = block[np.isin(block.term.to_numpy(), probes["term"])]
    if not len(rare):
        return none
    doc, item, diagonal, _ = _expand(*_decode(rare), rare.term.to_numpy(), probes)
    by = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[by], item[by], diagonal[by]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])))
    heads = np.flatnonzero(new)
    heads = heads[np.diff(np.append(heads, len(doc))) >= LEAST_MET]
    doc, item, diagonal = doc[heads], item[heads], diagonal[heads]
    if not len(doc):
        return none
    docs = np.unique(doc)
    row, d, pos = _decode(block)
    inside = np.isin(d, docs)
    term, d, pos = block.term.to_numpy()[row[inside]], np.searchsorted(docs, d[inside]), pos[inside]
    width = int(pos.max()) + 1
    key = d * width + pos
    order = np.argsort(key)
    key, term = key[order], term[order]
    out = []
    for a, i, g in zip(doc, item, diagonal):
        first, last = passages["span"][i]
        at, want = passages["at"][first:last], passages["term"][first:last]
        there = at + g
        ok = (there >= 0) & (there < width)
        before = int((there < 0).sum())  # of the passage, only what can lie in the document counts
        look = np.searchsorted(docs, a) * width + there[ok]
        place = np.minimum(np.searchsorted(key, look), len(key) - 1)
        hits = at[ok][(key[place] == look) & (term[place] == want[ok])]
        exact, near = runs(hits - before, len(at) - before, cfg)
        if exact or near:
            out.append((a, i, exact, near))
    return pd.DataFrame(out, columns=["doc_id", "item_id", "exact", "near"]) if out else none


def leaks(documents: DataFrame, items: DataFrame, cfg: LeakConfig = LeakConfig(), index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, exact, near): the documents that hold an item's passage, as a phrase or nearly so.

    Null texts and passages match nothing; passages shorter than ``cfg.exact`` words can't be found. Rows that repeat a
    document or an item count once. A passage shared by two items counts for both.
    """
    index = index if index is not None else build_index(documents, cfg=cfg)
    terms = passage_terms(items)
    passes = max(1, -(-terms.count() // cfg.broadcast_words))
    parts = [terms if passes == 1 else terms.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n) for n in range(passes)]
    found = None
    for part in parts:
        now = _search(index, part, cfg)
        found = now if found is None else found.unionByName(now)
    return found.groupBy("doc_id", "item_id").agg(F.bool_or("exact").alias("exact"), F.bool_or("near").alias("near"))


def _search(index: DataFrame, terms: DataFrame, cfg: LeakConfig) -> DataFrame:
    """Matches of at most ``cfg.broadcast_words`` words of passages."""
    mine = index.join(terms.select("term").distinct(), "term", "left_semi")
    counts = mine.groupBy("term").agg(F.sum("docs").alias("df"))
    table = terms.join(counts, "term", "left").select("item_id", "at", "term", F.coalesce("df", F.lit(0)).alias("df")).toArrow()
    item, at, term, df = (table.column(c).to_numpy() for c in ("item_id", "at", "term", "df"))
    by = np.lexsort((at, item))
    item, at, term, df = item[by], at[by].astype(np.int64), term[by], df[by]
    heads = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, dtype=np.int64)
    span = {int(item[a]): (int(a), int(b)) for a, b in zip(heads, np.append(heads[1:], len(item)))}
    chosen = np.zeros(len(item), dtype=bool)
    for a, b in span.values():
        chosen[a + choose_probes(df[a:b])] = True
    shared = index.sparkSession.sparkContext.broadcast(({"span": span, "at": at, "term": term}, _by_term(item[chosen], at[chosen], term[chosen])))

    def match(block: pd.DataFrame) -> pd.DataFrame:
        return _matches(block, *shared.value, cfg)

    return mine.groupBy("block").applyInPandas(match, "doc_id long, item_id long, exact boolean, near boolean")
