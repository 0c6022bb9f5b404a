"""Sparse sentence vectors of texts, for duplicate search (problem 1).

A text becomes its sentences; a sentence becomes 16-bit codes of its folded words (case, diacritics, spacing,
punctuation and entities vanish; any number is code 0). The full vector of a text counts its words by sentence; a sketch
is its projection on a fixed number of bins. A cell is named by a few words of one sentence, drawn with weights that
favour rare words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Collection, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

_TOKEN = re.compile(r"[^\W_]+|[.!?…]+(?=[\s\"'”»)\]]|$)|\n")
_MARKS = re.compile("[̀-ͯ]+")
#: pieces of text that a cache holds, and characters of those that it remembers
_CACHE_LIMIT, _REMEMBERED = 200_000, 32

VECTOR_SCHEMA = "record_id long, batch_no int, size int, sketch binary, lens binary, words binary"
_LONGEST = 60_000  # words of a sentence; longer ones are cut


def fold(text: str) -> str:
    """Text without entities, case and diacritics."""
    if "&" in text:
        text = html.unescape(text)
    return _MARKS.sub("", unicodedata.normalize("NFKD", text).casefold()).replace("ł", "l")


def _code(token: str) -> int:
    if token[0] in ".!?…\n":
        return -1
    if any(map(str.isdigit, token)):
        return 0
    return 1 + xxhash.xxh32_intdigest(token) % 65535


class Codes(dict):
    """Codes of the tokens of what stands between white space, as 32-bit numbers one after another; remembers short pieces.

    No token, entity or mark depends on what lies beyond white space.
    """

    def __missing__(self, piece: str) -> bytes:
        codes = np.array([_code(token) for token in _TOKEN.findall(fold(piece))], dtype=np.int32).tobytes()
        if len(piece) <= _REMEMBERED:
            if len(self) >= _CACHE_LIMIT:
                self.clear()
            self[piece] = codes
        return codes


_LINE_END = np.array([-1], dtype=np.int32).tobytes()


def sentences(lines: list[str], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each sentence, all words' codes) of lines; no sentence runs over a line's end."""
    found = np.frombuffer(_LINE_END.join([b"".join(map(codes.__getitem__, line.split())) for line in lines]), dtype=np.int32)
    keep = np.ones(len(found), dtype=bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)  # a number in groups counts once
    found = found[keep]
    word = found >= 0
    lens = np.bincount(np.cumsum(~word)[word]) if word.any() else np.zeros(0, dtype=np.int64)
    lens = lens[lens > 0]
    if len(lens) and lens.max() > _LONGEST:
        lens = np.array([n for size in lens.tolist() for n in [_LONGEST] * (size // _LONGEST) + [size % _LONGEST] if n])
    return lens.astype(np.uint16), found[word].astype(np.uint16)


@cache
def _letters() -> np.ndarray:
    """Whether a character is a letter; none from the last one on is."""
    return np.array([chr(c).isalpha() for c in range(0x40001)])


def line_keys(text: str) -> list[int]:
    """A key for each line: the hash of its letters without case, 0 for a line without any."""
    chars = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero(_letters().take(chars, mode="clip"))
    letters = chars[at].tobytes()
    ends = [*(4 * np.searchsorted(at, np.flatnonzero(chars == 10))).tolist(), len(letters)]
    return [xxhash.xxh64_intdigest(letters[a:b]) - (1 << 63) if a < b else 0 for a, b in zip([0, *ends], ends)]


def source_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, text) -> (src, line) for each different line with letters of each text, and one with a null line."""
    for batch in batches:
        src, line = [], []
        for s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = {*line_keys(text), 0}
            src += [s] * len(keys)
            line += [k or None for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(line, pa.int64())], ["src", "line"])


def article_lines(text: str, gone: Collection[int]) -> list[str]:
    """The lines of a text but those whose key is in ``gone``."""
    lines = text.split("\n")
    return [line for line, key in zip(lines, line_keys(text)) if key not in gone] if gone else lines


def _binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def vectorise(batches: Iterator[pa.RecordBatch], gone: dict[int | None, set[int]]) -> Iterator[pa.RecordBatch]:
    """(record_id, batch_no, source, text, line keys left out) -> ``VECTOR_SCHEMA``; ``gone``: those of each source, too."""
    codes = Codes()
    for batch in batches:
        rows = []
        for src, text, own in zip(*(batch.column(i).to_pylist() for i in range(2, 5))):
            rows.append(sentences(article_lines(text, own or gone.get(src, ())), codes))
        words = _binary([w for _, w in rows])
        size = pa.array([len(w) for _, w in rows], pa.int32())
        drawn = _binary(list(sketches(words)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, drawn, _binary([n for n, _ in rows]), words], ["record_id", "batch_no", "size", "sketch", "lens", "words"])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of a column of 16-bit numbers without nulls."""
    _, offsets, data = column.buffers()
    of = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int32)
    raw = np.frombuffer(data, dtype=np.uint8)[of[0] : of[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return (of - of[0]) // 2, np.frombuffer(raw.tobytes(), dtype=np.uint16).astype(np.int64)


#: words of a sentence that make a cell, cells per sentence, and cells that a short text has at least
CELL_WORDS, CELLS, LEAST_CELLS = 4, 3, 24
CODES = 1 << 16
SKETCH = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Axes:
    """The frozen weights of the words and the orders in which a sentence's words are drawn: one per cell.

    A word is drawn the earlier the rarer it is (weighted minimum hashing), so a cell stays the same unless one of its own
    words goes or a word of greater weight comes.
    """

    def __init__(self, counts: np.ndarray, records: int):
        self.weight = np.log(1 + (1 + records) / (1 + counts.astype(np.float64))) ** 2
        self.orders: list[np.ndarray] = []

    def order(self, n: int) -> np.ndarray:
        while len(self.orders) <= n:
            h = _mixed(np.arange(CODES) * (2 * len(self.orders) + 3) + len(self.orders) * 1_000_003)
            drawn = -np.log(((h >> np.uint64(11)).astype(np.float64) + 1) / 2**53) / self.weight
            rank = np.empty(CODES, dtype=np.int64)
            rank[np.argsort(drawn, kind="stable")] = np.arange(CODES)
            self.orders.append(rank)
        return self.orders[n]

    def cells(self, lens_column: pa.Array, words_column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row and length of each sentence, sentence of each cell, cell)."""
        of, lens = flat(lens_column)
        _, words = flat(words_column)
        per_row = np.diff(of)
        row = np.repeat(np.arange(len(lens_column)), per_row)
        each = np.maximum(CELLS, -(-LEAST_CELLS // np.maximum(1, per_row)))[row] if len(row) else row
        sentence = np.repeat(np.arange(len(lens)), lens)
        at, cell = [], []
        for n in range(int(each.max()) if len(each) else 0):
            rank = self.order(n)
            on = each > n
            mine = np.flatnonzero(on[sentence]) if not on.all() else slice(None)
            key = np.sort((sentence[mine] << 16) | rank[words[mine]])
            if not len(key):
                continue
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            s = key >> 16
            heads = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            place = np.arange(len(key)) - np.repeat(heads, np.diff(np.append(heads, len(key))))
            drawn = place < CELL_WORDS
            s, h = s[drawn], _mixed((key[drawn] & 0xFFFF) + (n << 20))
            heads = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            with np.errstate(over="ignore"):
                total = np.add.reduceat(h, heads)
            at.append(s[heads])
            cell.append(_mixed(total).view(np.int64))
        none = np.zeros(0, dtype=np.int64)
        return row, lens, np.concatenate(at) if at else none, np.concatenate(cell) if cell else none


def word_counts(words_column: pa.Array) -> np.ndarray:
    """In how many rows each word code stands."""
    of, words = flat(words_column)
    return np.bincount(_bags(words, np.diff(of))[0] & (CODES - 1), minlength=CODES)


def sketches(words_column: pa.Array) -> np.ndarray:
    """The vectors projected on ``SKETCH`` bins, one byte each; the last byte of a row counts as 255 and more."""
    of, words = flat(words_column)
    row = np.repeat(np.arange(len(words_column)), np.diff(of))
    bins = (_mixed(words) >> np.uint64(40)).astype(np.int64) & (SKETCH - 1)
    count = np.bincount(row * SKETCH + bins, minlength=len(words_column) * SKETCH)
    return np.minimum(count, 255).astype(np.uint8).reshape(-1, SKETCH)


def most_shared(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """A bound from above on the words that two texts share, from their sketches: what bins could not hold is added."""
    over = np.minimum(a_size - a.sum(axis=1, dtype=np.int64), b_size - b.sum(axis=1, dtype=np.int64))
    return np.minimum(a, b).sum(axis=1, dtype=np.int64) + np.maximum(0, over)


def _bags(words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row and word as one number, how often), sorted."""
    key = np.sort(((np.repeat(np.arange(len(lens)), lens) << 16) | words).astype(np.uint32 if len(lens) < 1 << 16 else np.int64))
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    return key[heads], np.diff(np.append(heads, len(key)))


def shared_words(a_column: pa.Array, b_column: pa.Array) -> np.ndarray:
    """How many words the texts of each row of two columns share, whatever the sentence."""
    (a, a_n), (b, b_n) = (_bags(words, np.diff(of)) for of, words in (flat(a_column), flat(b_column)))
    if not len(a) or not len(b):
        return np.zeros(len(a_column), dtype=np.int64)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    return np.bincount(a[both] >> 16, weights=np.minimum(a_n[both], b_n[at[both]]), minlength=len(a_column)).astype(np.int64)


#: A sentence of which at most one word in so many differs stands in the other text as a whole.
ONE_IN = 6
WITHIN = 6


def similarity(a_lens, a_words, b_lens, b_words, least: float, same_sentence: float = 0.6) -> float:
    """Share of the longer text's words that stand in the other one in the same sentences; 0 as soon as it can't reach ``least``.

    Two sentences are the same when at least ``same_sentence`` of the longer one's words are shared; each sentence
    finds one partner at most, equal ones first. A sentence of ``WITHIN`` words or more may also stand inside a longer one
    and leaves the rest of it to others. Single words may differ: where no more than one in ``ONE_IN`` does, the
    whole sentence counts, else only the words shared.
    """
    longer = max(len(a_words), len(b_words))
    if not longer or min(len(a_words), len(b_words)) * ONE_IN < least * longer * (ONE_IN - 1):
        return 0.0

    def cut(lens, words):
        at, out = 0, []
        for n in lens:
            out.append(words[at : at + n].tobytes())
            at += n
        return out

    b_left: dict[bytes, int] = {}
    for s in cut(b_lens, b_words):
        b_left[s] = b_left.get(s, 0) + 1
    shared, a_left = 0, []
    for s in cut(a_lens, a_words):
        if b_left.get(s):
            b_left[s] -= 1
            shared += len(s) // 2
        else:
            a_left.append(s)
    rest = [s for s, n in b_left.items() for _ in range(n)]
    if (shared + min(sum(map(len, a_left)), sum(map(len, rest))) // 2 * ONE_IN / (ONE_IN - 1)) < least * longer:
        return 0.0

    # the sentences left, by their words: a word's second occurrence is a word of its own
    held: dict[tuple[int, int], list[int]] = {}
    size: list[int] = []

    def tokens(words: list[int]) -> list[tuple[int, int]]:
        seen: dict[int, int] = {}
        out = []
        for w in words:
            k = seen[w] = seen.get(w, -1) + 1
            out.append((w, k))
        return out

    def hold(words: list[int]) -> None:
        for token in tokens(words):
            held.setdefault(token, []).append(len(size))
        size.append(len(words))

    def minus(words: list[int], others: list[int]) -> list[int]:
        gone: dict[int, int] = {}
        for w in others:
            gone[w] = gone.get(w, 0) + 1
        out = []
        for w in words:
            if gone.get(w, 0):
                gone[w] -= 1
            else:
                out.append(w)
        return out

    def worth(n: int, common: int) -> int:
        return n if (n - common) * ONE_IN <= n else common

    words_of = [np.frombuffer(s, dtype=np.uint16).tolist() for s in rest]
    for words in words_of:
        hold(words)
    ahead = sum(map(len, a_left)) // 2
    for s in sorted(a_left, key=len, reverse=True):
        if (shared + ahead * ONE_IN / (ONE_IN - 1)) < least * longer:
            return 0.0
        own = np.frombuffer(s, dtype=np.uint16).tolist()
        ahead -= len(own)
        while own:
            n, met = len(own), {}
            for token in tokens(own):
                for j in held.get(token, ()):
                    met[j] = met.get(j, 0) + 1
            best, at, whole = 0, -1, False
            for j, common in sorted(met.items()):
                m = size[j]
                if common > best and m:
                    same = common >= same_sentence * max(n, m)
                    # a sentence whose end was lost stands inside a longer one
                    if same or min(n, m) >= WITHIN and common >= 0.8 * min(n, m):
                        best, at, whole = common, j, same
            if at < 0:
                break
            m, size[at] = size[at], 0
            shared += worth(max(n, m) if whole else min(n, m), best)
            if whole:
                break
            if n <= m:
                words_of.append(minus(words_of[at], own))
                hold(words_of[-1])
                break
            own = minus(own, words_of[at])
    return min(1.0, shared / longer)
