"""Per-document text quality statistics (problem 8).

Every line (long ones in pieces of about ``PIECE`` characters) is described by a few binned statistics. A hidden Markov
model with the states prose, list, table and junk labels the lines; a document's label shares are shares of characters.
No list of words or letters of a language goes into it: that prose has small words in its lines, letters that weren't read
byte by byte, sentences' ends and so on holds for languages the corpus has few documents of, too. Which words
are common is counted over all documents, by script. The model is fitted on a bounded sample: lines that plain rules can name hold their state, all others are free, and the
Baum-Welch algorithm does the rest. Statistics and labels cover every line of every document.

Counting is vectorised over the characters of a whole Arrow batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import spread

STATES = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
PIECE = 200

OTHER, LETTER, UPPER, DIGIT, SPACE, STOP, COMMA, MARK, ODD, DAMAGE = range(10)
# fixed values: signs, no letters, that appear where bytes are read in the wrong encoding
_DAMAGE_SIGNS = "¤¬³¢£¥¦¨©¯±²´¶¸¹¼½¾�™"
#: Function words are short in all languages with spaces between words: small words of so many letters count as common.
SHORT = 3


def _misread_pairs() -> tuple[np.ndarray, np.ndarray]:
    """First and second characters of letters of two UTF-8 bytes (Latin, Cyrillic) read as a one-byte encoding."""
    first, second = set(), set()
    for name in ("latin-1", "cp1250", "cp1252"):
        first.update(bytes([b]).decode(name, "ignore") for b in (0xC2, 0xC3, 0xC4, 0xC5, 0xD0, 0xD1))
        second.update(bytes([b]).decode(name, "ignore") for b in range(0x80, 0xC0))
    table = np.zeros((2, 1 << 16), dtype=bool)
    for k, chars in enumerate((first, second)):
        table[k, [ord(c) for c in chars if c]] = True
    return table[0], table[1]


def _kind(char: str) -> int:
    cat = unicodedata.category(char)
    if cat[0] == "L":
        return UPPER if cat in ("Lu", "Lt") else LETTER
    if cat[0] == "N":
        return DIGIT
    if cat[0] == "Z" or char in "\t\r\n\x0b\x0c":
        return SPACE
    return LETTER if cat == "Mc" else OTHER if cat == "Mn" else ODD


def _fold(char: str) -> int:
    return ord((unicodedata.normalize("NFKD", char).lower()[:1].replace("ł", "l") or char)[0])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Character class and folded lower-case letter of each code up to 65535."""
    kind = np.array([_kind(chr(code)) for code in range(1 << 16)], dtype=np.uint8)
    low = np.zeros(1 << 16, dtype=np.uint64)
    for code in np.flatnonzero((kind == LETTER) | (kind == UPPER)).tolist():
        low[code] = _fold(chr(code))
    for chars, k in ((".!?…", STOP), (",;:%()\"'„”“’–—-/", COMMA), ("|\t*#»•→=<>{}[]_\\^~`+&§@", MARK), (_DAMAGE_SIGNS, DAMAGE)):
        for char in chars:
            kind[ord(char)] = k
    return kind, low


_KIND, _LOW = _tables()
_FIRST, _SECOND = _misread_pairs()
#: words of more letters than this are never frequent ones
_POWERS = np.cumprod(np.full(16, 0x100000001B3, dtype=np.uint64))


def _word_hash(word: str) -> int:
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for i, c in enumerate(word):
            total += np.uint64(ord(c)) * _POWERS[i]
    return int(total)


def word_hashes(words: Iterable[str]) -> np.ndarray:
    """Sorted hashes of words without case and diacritics."""
    return np.array(sorted({_word_hash("".join(chr(_fold(c)) for c in w)) for w in words if len(w) <= len(_POWERS)}), dtype=np.uint64)


_NONE = np.zeros(0, dtype=np.uint64)

#: counts per line piece, in this order
COUNTS = ("chars", "letters", "upper", "digits", "spaces", "stops", "commas", "marks", "odd", "damage", "words", "common", "numbers", "low_words", "seps", "ends", "bullet", "short")


@dataclass
class Lines:
    doc: np.ndarray
    counts: np.ndarray  # one row per piece, columns as COUNTS
    end_line: np.ndarray = field(default=None)  # the piece ends its line


def line_counts(texts: list[str], frequent: np.ndarray = _NONE) -> Lines:
    """Counts for every non-blank line piece of the texts; ``frequent``: hashes of the words that count as common."""
    joined = "\n".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(code)
    none = Lines(np.zeros(0, dtype=np.int64), np.zeros((0, len(COUNTS)), dtype=np.int64), np.zeros(0, dtype=bool))
    if not n:
        return none
    small = np.minimum(code, 0xFFFF).astype(np.uint16)
    kind, folded = _KIND[small], _LOW[small]
    far = np.flatnonzero(code > 0xFFFF)
    if len(far):
        chars, at = np.unique(code[far], return_inverse=True)
        kind[far] = np.array([_kind(chr(c)) for c in chars], dtype=np.uint8)[at]
        folded[far] = code[far]
    # letters of several bytes that were read byte by byte
    pair = np.flatnonzero(_FIRST[small[:-1]] & _SECOND[small[1:]])
    damaged = kind == DAMAGE
    damaged[pair] = damaged[pair + 1] = True
    breaks = np.flatnonzero(code == 10)
    # long lines are cut at the first space of each block of PIECE characters
    spaces = np.flatnonzero(kind == SPACE)
    line_of = np.searchsorted(breaks, spaces, side="left")
    first = np.concatenate(([0], breaks + 1))
    block = (spaces - first[line_of]) // PIECE
    new = np.zeros(len(spaces), dtype=bool)
    new[1:] = (block[1:] != block[:-1]) & (line_of[1:] == line_of[:-1]) & (block[1:] > 0)
    cuts = np.unique(np.concatenate(([0], breaks + 1, spaces[new] + 1)))
    cuts = cuts[cuts < n]
    ends = np.concatenate((cuts[1:], [n]))

    def per_piece(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[ends] - total[cuts]

    letter = (kind == LETTER) | (kind == UPPER)
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    at = np.flatnonzero(starts)
    stop = letter.copy()
    stop[:-1] &= ~letter[1:]
    length = np.flatnonzero(stop) - at + 1
    common = np.zeros(n, dtype=bool)
    fit = length <= len(_POWERS)
    if len(frequent) and fit.any():
        s, ln = at[fit], length[fit]
        total = np.zeros(len(s), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(int(ln.max())):
                on = np.flatnonzero(ln > i)
                total[on] += folded[s[on] + i] * _POWERS[i]
        common[s[np.isin(total, frequent)]] = True
    little = np.zeros(n, dtype=bool)
    little[at[(length <= SHORT) & (kind[at] == LETTER)]] = True
    low_word = np.zeros(n, dtype=bool)
    low_word[at[(length > 1) & (kind[at] == LETTER)]] = True
    digit = kind == DIGIT
    number = digit.copy()
    number[1:] &= ~digit[:-1]
    sep = (small == ord("|")) | (small == 9) | (small == ord(";"))
    sep[1:-1] |= (small[1:-1] == ord(",")) & (kind[:-2] != SPACE) & (kind[2:] != SPACE) & ~(digit[:-2] & digit[2:])
    sep[1:-1] |= (small[1:-1] == ord(":")) & (kind[2:] == SPACE)
    cols = [ends - cuts, per_piece(letter), per_piece(kind == UPPER), per_piece(digit), per_piece(kind == SPACE), per_piece(kind == STOP), per_piece(kind == COMMA), per_piece(kind == MARK), per_piece(kind == ODD), per_piece(damaged)]
    cols += [per_piece(starts), per_piece(common), per_piece(number), per_piece(low_word), per_piece(sep)]
    counts = np.stack(cols, axis=1)
    seen = np.flatnonzero(kind != SPACE)
    filled = counts[:, 0] > counts[:, 4]
    if not filled.any():
        return none
    head = seen[np.searchsorted(seen, cuts[filled])]
    tail = seen[np.searchsorted(seen, ends[filled]) - 1]
    closes = kind[tail] == STOP
    after = np.minimum(head + 1, n - 1)
    third = np.minimum(head + 2, n - 1)
    signs = np.isin(small[head], np.array([ord(c) for c in "-*•→»#[(–·"], dtype=np.uint16))
    numbered = digit[head] & (np.isin(small[after], [ord("."), ord(")")]) | digit[after] & np.isin(small[third], [ord("."), ord(")")]))
    counts = np.column_stack([counts[filled], closes, signs | numbered, per_piece(little)[filled]])
    last = np.isin(ends[filled] - 1, breaks) | (ends[filled] == n)
    # documents: which text a piece belongs to
    lens = np.array([len(t) + 1 for t in texts])
    doc = np.searchsorted(np.cumsum(lens), cuts[filled], side="right")
    return Lines(doc, counts, last)


_BINS = (  # (name, value of the counts, upper bounds of the bins)
    ("short", lambda c: c["short"] / np.maximum(1, c["words"]), (0.001, 0.05, 0.08, 0.11, 0.15, 0.22)),
    ("sentence", lambda c: (c["stops"] + c["upper"]) / np.maximum(1, c["words"]), (0.001, 0.08, 0.3, 1.0)),
    ("words", lambda c: c["words"], (1, 3, 6, 12, 25)),
    ("low", lambda c: c["low_words"] / np.maximum(1, c["words"]), (0.2, 0.5, 0.75, 0.95)),
    ("letters", lambda c: c["letters"] / np.maximum(1, c["chars"] - c["spaces"]), (0.15, 0.5, 0.75, 0.9)),
    ("numbers", lambda c: c["numbers"] / np.maximum(1, c["words"] + c["numbers"]), (0.001, 0.2, 0.45, 0.7)),
    ("seps", lambda c: c["seps"] / np.maximum(1, c["words"] + c["numbers"]), (0.001, 0.1, 0.25)),
    ("odd", lambda c: (c["marks"] + c["odd"] + c["damage"]) / np.maximum(1, c["chars"]), (0.001, 0.03, 0.1)),
    ("damage", lambda c: c["damage"] / np.maximum(1, c["chars"]), (0.01, 0.05)),
    ("length", lambda c: c["letters"] / np.maximum(1, c["words"]), (2.5, 4, 9, 14)),
    ("ends", lambda c: c["ends"], (0.5,)),
    ("bullet", lambda c: c["bullet"], (0.5,)),
)
SIZES = tuple(len(bounds) + 1 for _, _, bounds in _BINS)


def _named(counts: np.ndarray) -> dict[str, np.ndarray]:
    return {name: counts[:, i] for i, name in enumerate(COUNTS)}


def observe(counts: np.ndarray) -> np.ndarray:
    """Bins of the line statistics: one row per piece, one column per statistic."""
    c = _named(counts)
    return np.stack([np.digitize(value(c), bounds) for _, value, bounds in _BINS], axis=1).astype(np.int8)


def seeds(counts: np.ndarray) -> np.ndarray:
    """The state of lines that plain rules can name, -1 for all others."""
    c = _named(counts)
    words, numbers = np.maximum(1, c["words"]), c["numbers"]
    common = c["short"] / words
    tokens = np.maximum(1, c["words"] + numbers)
    odd = (c["marks"] + c["odd"] + c["damage"]) / np.maximum(1, c["chars"])
    solid = c["letters"] / np.maximum(1, c["chars"] - c["spaces"])
    out = np.full(len(counts), -1)
    out[(words >= 8) & (common >= 0.12) & (solid > 0.8) & (odd < 0.02) & (c["seps"] / tokens < 0.15)] = PROSE
    out[(c["bullet"] > 0) & (words <= 5) & (common < 0.05)] = LIST
    out[(c["seps"] / tokens >= 0.3) & (tokens >= 4) & (common < 0.05)] = TABLE
    out[(numbers / tokens > 0.8) & (tokens >= 4)] = TABLE
    out[(c["letters"] / words > 16) & (c["chars"] > 40)] = JUNK
    out[c["damage"] / np.maximum(1, c["chars"]) > 0.06] = JUNK
    out[(odd > 0.12) & (c["seps"] / tokens < 0.3)] = JUNK
    out[(words >= 12) & (common < 0.1) & (c["upper"] + c["stops"] == 0) & (numbers / tokens < 0.2)] = JUNK
    out[(words >= 12) & (c["short"] == 0) & (c["ends"] == 0) & (numbers / tokens < 0.2)] = JUNK
    return out


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]  # per statistic: states x bins, logarithms

    def score(self, obs: np.ndarray) -> np.ndarray:
        return sum(table[:, obs[:, i]].T for i, table in enumerate(self.emit))


def _steps(doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each position t within a document: (indexes of the pieces at t, indexes of the pieces before them)."""
    head = np.searchsorted(doc, doc)
    place = np.arange(len(doc)) - head
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(place.max() + 2)) if len(doc) else [0]
    for t in range(len(bounds) - 1):
        at = order[bounds[t] : bounds[t + 1]]
        yield at, at - 1


def viterbi(model: Model, doc: np.ndarray, obs: np.ndarray) -> np.ndarray:
    """The most likely states of all documents' pieces at once; ``doc`` is sorted."""
    if not len(doc):
        return np.zeros(0, dtype=np.int64)
    score, back = model.score(obs), np.zeros((len(doc), len(STATES)), dtype=np.int8)
    steps = list(_steps(doc))
    score[steps[0][0]] += model.start
    for at, prev in steps[1:]:
        ways = score[prev][:, :, None] + model.move[None]
        back[at] = ways.argmax(axis=1)
        score[at] += ways.max(axis=1)
    state = score.argmax(axis=1)  # right for the last piece of each document
    for at, prev in reversed(steps[1:]):
        state[prev] = back[at, state[at]]
    return state


def fit(doc: np.ndarray, obs: np.ndarray, held: np.ndarray, rounds: int = 6) -> Model:
    """Baum-Welch with the held states fixed; counts are smoothed, so that no bin is impossible."""
    k, n = len(STATES), len(doc)
    post = np.full((n, k), 1.0 / k)
    post[held >= 0] = 0
    post[held >= 0, held[held >= 0]] = 1
    # the free lines begin as their document's held ones, so that the first model is one of held lines
    weight = np.where(held >= 0, 1.0, 0.02)
    move = np.full((k, k), 0.04) + np.eye(k) * 0.84
    start = np.full(k, 0.25)
    steps = list(_steps(doc)) if n else []
    model = None
    for turn in range(rounds):
        emit = []
        for i, size in enumerate(SIZES):
            table = np.full((k, size), 0.5)
            np.add.at(table.T, obs[:, i], post * weight[:, None])
            emit.append(np.log(table / table.sum(axis=1, keepdims=True)))
        model = Model(np.log(start), np.log(move), emit)
        if not n:
            break
        score = model.score(obs)
        score[held >= 0] += np.where(post[held >= 0] > 0.5, 0.0, -50.0) if turn == 0 else np.where(np.eye(k)[held[held >= 0]] > 0, 0.0, -50.0)
        fwd, bwd = score.copy(), np.zeros((n, k))
        fwd[steps[0][0]] += model.start
        for at, prev in steps[1:]:
            fwd[at] += np.logaddexp.reduce(fwd[prev][:, :, None] + model.move[None], axis=1)
        pairs = np.full((k, k), 1.0)
        for at, prev in reversed(steps[1:]):
            bwd[prev] = np.logaddexp.reduce(model.move[None] + (score[at] + bwd[at])[:, None, :], axis=2)
            joint = fwd[prev][:, :, None] + model.move[None] + (score[at] + bwd[at])[:, None, :]
            joint -= np.logaddexp.reduce(joint.reshape(len(at), -1), axis=1)[:, None, None]
            pairs += np.exp(joint).sum(axis=0)
        both = fwd + bwd
        post = np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])
        weight = np.where(held >= 0, 1.0, 0.3)
        move = pairs / pairs.sum(axis=1, keepdims=True)
        start = (1 + post[steps[0][0]].sum(axis=0)) / (k + len(steps[0][0]))
    return model


@dataclass(frozen=True)
class QualityConfig:
    """``fit_documents``: documents in the sample the model is fitted on (those with the least id hashes).
    ``frequent``: share of the documents of a script in which a common word stands at least."""

    fit_documents: int = 1500
    frequent: float = 0.05
    id_col: str = "doc_id"
    text_col: str = "text"


_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari")


def frequent_words(documents: DataFrame, cfg: QualityConfig = QualityConfig()) -> np.ndarray:
    """Hashes of the common words of each script, from the counts of all documents.

    At most (1 / cfg.frequent) times as many words as a document has different ones on average, however many documents.
    """
    words = documents.where(F.col(cfg.text_col).isNotNull()).select(F.array_distinct(F.regexp_extract_all(F.lower(cfg.text_col), F.lit(r"(\p{L}+)"), F.lit(1))).alias("ws"))

    def script(word: Column) -> Column:
        out = F.when(word.isNull(), None)
        for name in _SCRIPTS:
            out = out.when(word.rlike(rf"^\p{{Is{name}}}"), name)
        return out.otherwise("other")

    per_word = words.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("script", script(F.col("word")))
    of = words.select(F.explode(F.array_distinct(F.transform(F.array_distinct(F.transform("ws", lambda w: F.substring(w, 1, 1))), script))).alias("script")).groupBy("script").agg(F.count(F.lit(1)).alias("of"))
    got = per_word.join(F.broadcast(of), "script").where(F.col("n") >= cfg.frequent * F.col("of")).select("word")
    return word_hashes(got.toArrow().column("word").to_pylist())


def train(documents: DataFrame, cfg: QualityConfig = QualityConfig()) -> Model:
    """The line model of a corpus, from a bounded sample of its documents."""
    chosen = documents.where(F.col(cfg.text_col).isNotNull()).select(F.xxhash64(cfg.id_col).alias("h"), F.col(cfg.text_col).alias("text")).orderBy("h", "text").limit(cfg.fit_documents)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = line_counts(batch.column(1).to_pylist())
            seen = [row.tobytes() for row in observe(got.counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(got.doc)), pa.array(np.arange(len(got.doc))), pa.array(seen, pa.binary()), pa.array(seeds(got.counts))], ["h", "k", "obs", "held"]
            )

    got = chosen.mapInArrow(sample, "h long, k long, obs binary, held long").orderBy("h", "k").toArrow()
    _, doc = np.unique(got.column("h").to_numpy(), return_inverse=True)
    obs = np.frombuffer(b"".join(got.column("obs").to_pylist()), dtype=np.int8).reshape(-1, len(SIZES))
    return fit(doc, obs, got.column("held").to_numpy())


STATS_SCHEMA = (
    "doc_id long, n_chars long, n_words long, mean_word_length double, symbol_ratio double, digit_ratio double, upper_ratio double, "
    "line_end_share double, common_share double, prose_share double, list_share double, table_share double, junk_share double"
)


def statistics(documents: DataFrame, cfg: QualityConfig = QualityConfig(), model: Model | None = None) -> DataFrame:
    """One row per row of ``documents``: ``STATS_SCHEMA``.

    Ratios are shares of characters; ``line_end_share`` is the share of lines that end in a stop, ``common_share`` that
    of words which are frequent in the corpus. A null text gives nulls, a blank one zeros and no label shares.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model or train(documents, cfg), frequent_words(documents, cfg)))  # a few thousand numbers

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent = shared.value
        for batch in batches:
            raw = batch.column(1).to_pylist()
            texts = [t or "" for t in raw]
            n = len(texts)
            got = line_counts(texts, frequent)
            state = viterbi(model, got.doc, observe(got.counts)) if len(got.doc) else np.zeros(0, dtype=np.int64)
            c = _named(got.counts)
            add = lambda x, by=got.doc: np.bincount(by, weights=x, minlength=n)[:n]
            size = np.array([len(t) for t in texts], dtype=np.float64)
            words, seen = add(c["words"]), add(c["chars"])
            lines = add(got.end_line.astype(float))
            null = np.array([t is None for t in raw], dtype=bool)
            share = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
            cols = [share(add(c["letters"]), words), share(add(c["marks"] + c["odd"] + c["damage"]), size), share(add(c["digits"]), size), share(add(c["upper"]), size), share(add(c["ends"] * got.end_line), lines), share(add(c["common"]), words)]
            labels = [share(add(c["chars"] * (state == k)), seen) for k in range(len(STATES))]
            arrays = [batch.column(0), pa.array(size.astype(np.int64), mask=null), pa.array(words.astype(np.int64), mask=null)]
            arrays += [pa.array(x, mask=null) for x in cols] + [pa.array(x, mask=null | (seen == 0)) for x in labels]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in STATS_SCHEMA.split(", ")])

    rows = documents.select(F.col(cfg.id_col).cast("long").alias("doc_id"), F.col(cfg.text_col).alias("text"))
    return spread(rows).mapInArrow(describe, STATS_SCHEMA)


def no_prose(documents: DataFrame, cfg: QualityConfig = QualityConfig(), most: float = 0.5) -> DataFrame:
    """Ids of documents of which more than ``most`` of the characters are list, table or junk."""
    return statistics(documents, cfg).where(F.col("list_share") + F.col("table_share") + F.col("junk_share") > most).select("doc_id")
