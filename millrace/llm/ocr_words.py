"""Words of recognised text: tokens, character confusions, features of a correction."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: fixed values: what a printed character is commonly misrecognised as (printed, read)
CONFUSIONS = (
    ("o", "0"), ("l", "1"), ("l", "I"), ("i", "!"), ("i", "1"), ("a", "@"), ("s", "5"), ("ó", "6"), ("b", "6"), ("g", "9"), ("z", "2"), ("B", "8"), ("e", "c"), ("c", "e"),
    ("c", "o"), ("o", "c"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("d", "cl"), ("n", "ii"), ("n", "ri"), ("h", "li"), ("u", "ii"), ("i", "l"), ("l", "i"), ("t", "f"), ("f", "t"),
    ("ą", "a"), ("ć", "c"), ("ę", "e"), ("ł", "l"), ("ł", "t"), ("ń", "n"), ("ó", "o"), ("ś", "s"), ("ź", "z"), ("ż", "z"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("O", "0"), ("I", "l"), ("S", "5"), ("I", "1"),
)
_DIACRITIC = {(a, b) for a, b in CONFUSIONS if len(a) == 1 and not a.isascii() and b.isalpha()}
_READ: dict[str, list[str]] = {}
for _printed, _read in CONFUSIONS:
    _READ.setdefault(_read, []).append(_printed)
HYPHENS = "-­¬‐"
_EDGE = ".,;:?()[]{}„”“\"'»«•…|–—*"
_CODE = re.compile(r"[A-Z]{2,}[-/]?\d[\d-]*|\d+(?:[.,:/-]\d+)*%?")
_NUMBERLIKE = re.compile(r"(?=.*\d)(?=.*[OolI])[\dOolI.,]+%?")
_SYMBOL = re.compile(r"[@!0-9]")
_NUMBERED = re.compile(r"\d+[a-z]{1,2}|[a-z]{1,3}\d")


def trimmed(token: str) -> str:
    """A token without punctuation and hyphens at its ends."""
    return token.strip(_EDGE + HYPHENS).rstrip("!").strip(_EDGE + HYPHENS)


def word_type(token: str) -> str | None:
    """The form under which a token is counted, None for numbers, codes and signs; regular capitals are lowered."""
    t = trimmed(token)
    if not t or _CODE.fullmatch(t):
        return None
    letters = sum(c.isalpha() for c in t)
    if letters < 2 and not _NUMBERLIKE.fullmatch(t) and not (letters and _SYMBOL.search(t) and len(t) <= 3):
        return None
    if t.isupper() and letters == len(t) or t.istitle() or t[1:].islower():
        return t.lower()
    return t


_LETTERS = str.maketrans({"0": "o", "1": "l", "!": "i", "@": "a", "5": "s", "6": "ó"})
_NUMERALS = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1"})


def restored(word: str) -> str | None:
    """The form in which signs and digits stand for letters again, in a number letters for digits; None where nothing changes."""
    if _NUMBERLIKE.fullmatch(word):
        plain = word.translate(_NUMERALS)
    else:
        plain = word.translate(_LETTERS)
    return plain if plain != word else None


def explain(read: str, printed: str, most: int = 3) -> list[tuple[str, str, int]] | None:
    """The fewest confusions (printed, read, place) that turn ``printed`` into ``read``, None beyond ``most``."""
    best: dict[tuple[int, int], list] = {(0, 0): []}
    queue = [(0, 0)]
    while queue:
        i, j = queue.pop(0)
        ops = best[i, j]
        steps = []
        if i < len(read) and j < len(printed) and read[i] == printed[j]:
            steps.append((i + 1, j + 1, ops))
        if len(ops) < most:
            for n in (1, 2):
                seen = read[i : i + n]
                if len(seen) == n:
                    for p in _READ.get(seen, ()):
                        if printed.startswith(p, j):
                            steps.append((i + n, j + len(p), [*ops, (p, seen, i)]))
        for a, b, o in steps:
            if (a, b) not in best or len(o) < len(best[a, b]):
                best[a, b] = o
                queue.append((a, b))
    return best.get((len(read), len(printed)))


def grams(word: str) -> list[str]:
    """Character bigrams of a padded word without diacritics, each with its rough place."""
    w = "^" + "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)).replace("ł", "l") + "$"
    return list(dict.fromkeys(f"{w[i : i + 2]}{i // 3}" for i in range(len(w) - 1)))


def near_grams(word: str) -> list[str]:
    """The bigrams under which a dictionary word is found: also one place on either side."""
    w = "^" + "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)).replace("ł", "l") + "$"
    return list(dict.fromkeys(f"{w[i : i + 2]}{p}" for i in range(len(w) - 1) for p in range(max(0, i - 1) // 3, (i + 1) // 3 + 1)))


FEATURES = (
    "ratio", "count", "ops", "diacritic", "at_end", "length", "symbols", "grams", "odd_ops", "inner_capital", "unknown", "numberlike", "numbered", "capitals", "letters", "small", "sign_first", "dot", "long",
)


def features(read: str, n_read: float, printed: str, n_printed: float) -> list[float]:
    """Features of reading ``printed`` as ``read``; the counts are those of the corpus, 0 for a form that is only restored."""
    ops = explain(read, printed)
    a, b = set(grams(read)), set(grams(printed))
    if ops is None:
        ops_n, dia, end, odd = 9.0, 0.0, 0.0, 9.0
    else:
        ops_n = float(len(ops))
        dia = float(sum((p, r) in _DIACRITIC for p, r, _ in ops))
        end = float(sum(i + len(r) == len(read) for _, r, i in ops))
        odd = float(sum((p, r) in {("i", "l"), ("l", "i"), ("t", "f"), ("f", "t"), ("c", "e"), ("o", "c"), ("rn", "m"), ("ł", "t")} for p, r, _ in ops))
    inside = read[:-1] if read.endswith("!") else read
    symbols = float(len(_SYMBOL.findall(inside)))
    shape = [n_printed == 0, _NUMBERLIKE.fullmatch(read) is not None, _NUMBERED.fullmatch(read) is not None, sum(c.isupper() for c in read[1:]) > 2, sum(c.isalpha() for c in read) * 2 >= len(read), any(c.islower() for c in read), read[0] in "@!", "." in read, len(read) > 30]
    inner = float(any(c.isupper() for c in read[1:]) and any(c.islower() for c in read))
    return [float(np.log((1 + n_printed) / (1 + n_read))), float(np.log1p(n_read)), ops_n, dia, end, float(min(len(read), 12)), symbols, len(a & b) / max(1, len(a | b)), odd, inner, *map(float, shape)]


def made_up_words(rng: np.random.Generator, n: int) -> list[str]:
    """Words of syllables, to learn from where a corpus has too few."""
    syllable = lambda: "".join(rng.choice(list(x)) for x in ("bcdfgklmnprstwz", "aeiou", " mnrsl")).strip()
    return ["".join(syllable() for _ in range(int(rng.integers(2, 5)))) for _ in range(n)]


def signed(word: str, rng: np.random.Generator) -> str | None:
    """The word with one or two letters read as signs or digits; None where none can be."""
    ways = [(i, r) for p, r in CONFUSIONS for i in range(len(word)) if len(p) == 1 and word[i] == p and r in "0123456789!@"]
    for k in rng.permutation(len(ways))[: 1 + int(rng.random() < 0.2)]:
        i, r = ways[int(k)]
        word = word[:i] + r + word[i + 1 :]
    return word if ways else None


def regular_mixture(rng: np.random.Generator) -> str:
    """A regular form of letters and digits: numbering, a unit, a code, a key, a name of a file or an account."""
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnoprstuwz"), n))
    kind = int(rng.integers(7))
    if kind == 0:
        return digits(int(rng.integers(1, 3))) + letters(1)
    if kind == 1:
        return letters(int(rng.integers(1, 3))) + str(rng.integers(1, 4))
    if kind == 2:
        return letters(int(rng.integers(1, 4))).upper() + digits(int(rng.integers(1, 4))) + letters(int(rng.integers(0, 3)))
    if kind == 3:
        return "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(8, 41))))
    if kind == 4:
        return "".join(rng.choice(list("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), int(rng.integers(10, 41))))
    if kind == 5:
        return letters(int(rng.integers(3, 9))) + rng.choice([".", "@"]) + letters(3) + digits(1)
    return "@" + letters(int(rng.integers(3, 9)))


def corrupted(word: str, rng: np.random.Generator) -> str | None:
    """The word with one confusion, sometimes two; None where none applies."""
    out = word
    for _ in range(1 + (rng.random() < 0.15)):
        ways = [(i, p, r) for p, r in CONFUSIONS for i in range(len(out)) if out.startswith(p, i)]
        if not ways:
            return None
        i, p, r = ways[int(rng.integers(len(ways)))]
        out = out[:i] + r + out[i + len(p) :]
    return out if out != word else None


_FOLD = str.maketrans({"0": "o", "6": "o", "c": "o", "e": "o", "1": "l", "i": "l", "!": "l", "j": "l", "@": "a", "5": "s"})


def skeleton(line: str) -> str:
    """What is left of a line when all that is commonly confused is made equal and numbers, spaces and signs are dropped."""
    text = re.sub(r"(?<![^\W\d_@!])[\dOlI]+(?![^\W\d_@!])", " ", line)  # numbers standing alone
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).replace("ł", "l")
    for a, b in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "n")):
        text = text.replace(a, b)
    return re.sub(r"[\W\d_]+", "", text.translate(_FOLD))


_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_NUMBER = re.compile(r"[\s\W]*(?:(strona|str|s|page|p|seite)\.?\s*)?([\dOlI]{1,5}|[ivxlcdm]{1,8})\s*(?:(?:/|z|of|von)\s*([\dOlI]{1,5}))?[\s\W]*", re.I)
_ROMAN_DIGITS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def page_number(line: str) -> tuple[int, str, int | None] | None:
    """(number, style, of how many) of a line that gives nothing but a number, None for all others."""
    m = _NUMBER.fullmatch(_SPELL.sub(lambda k: k.group().translate(_UNREAD), line.strip()))
    if not m:
        return None
    word, number, total = m.groups()
    if any(c.isdigit() for c in number) or word and number.translate(_DIGITS).isdigit():
        n = int(number.translate(_DIGITS))
        kind = "arabic"
    elif number.islower() or number.isupper():
        low = number.lower()
        if not _ROMAN.fullmatch(low):
            return None
        values = [_ROMAN_DIGITS[c] for c in low]
        n = sum(-v if i + 1 < len(values) and v < values[i + 1] else v for i, v in enumerate(values))
        kind = "roman"
    else:
        return None
    style = kind + ("w" if word else "") + ("t" if total else "") + ("d" if re.search(r"[-–—\[\](|•*]", line) else "") + ("." if line.strip().endswith(".") else "")
    return n, style, int(total.translate(_DIGITS)) if total else None


_DIGITS = str.maketrans("OlI", "011")
_SPELL = re.compile(r"[sS5][tl1f]r[o0c]n[a@]", re.I)
_UNREAD = str.maketrans({"5": "s", "1": "t", "l": "t", "f": "t", "0": "o", "c": "o", "@": "a"})
