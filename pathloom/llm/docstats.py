"""Statistics of single documents, which the quality operators share."""

from __future__ import annotations

import math
from operator import eq

import numpy as np

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL_CODES = np.frombuffer(SYMBOLS.encode(), np.uint8)
_SPACES = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
_PUNCTUATION = np.frombuffer(b"!\"'(),-./:;?@[\\]^_`{}~+=", np.uint8)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPES = ("n_lines", "upper", "lower", "digits", "punctuation", "bangs", "bars", "stops", "beyond", "distinct_words", "twin_words", "distinct_triples", "entropy")


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words in three-word windows that occur twice or more in the list, number of distinct windows)."""
    n = len(words) - 2
    if n < 1:
        return 0, 0
    triples = list(zip(words, words[1:], words[2:], strict=False))
    distinct = set(triples)
    if len(distinct) == n:
        return 0, n
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, t in enumerate(triples):
        j = first.setdefault(t, i)
        if j != i:
            covered[j : j + 3] = covered[i : i + 3] = b"\1\1\1"
    return covered.count(1), len(distinct)


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of COUNTS and then SHAPES. Words end at ASCII white space; a null text has none of anything."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    spaces = int(hist[_SPACES].sum())
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
    repeat, triples = repeated_words(words)
    used = hist[hist > 0] / max(n, 1)
    return (
        len(words), len(text) - spaces, int(hist[_SYMBOL_CODES].sum()), dup, repeat,
        len(lines), int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[48:58].sum()), int(hist[_PUNCTUATION].sum()), int(hist[33]), int(hist[124]), int(hist[46] + hist[44]), int(hist[128:].sum()), len(set(words)), sum(map(eq, words, words[1:])), triples, float(-(used * np.log(used)).sum()),
    )


def features(stats: tuple[float, ...]) -> list[float]:
    """What classifiers see of the statistics: sizes on a log scale and shares."""
    s = dict(zip(COUNTS + SHAPES, stats, strict=True))
    words, chars = max(s["n_words"], 1), max(s["word_chars"], 1)
    letters = max(s["upper"] + s["lower"], 1)
    return [
        math.log1p(s["n_words"]), math.log1p(s["word_chars"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_symbols"] / chars,
        s["n_dup_lines"] / s["n_lines"], s["n_repeat_words"] / words, words / s["n_lines"], s["upper"] / letters, s["digits"] / chars,
        s["punctuation"] / words, s["bangs"] / words, s["bars"] / words, s["stops"] / words, s["beyond"] / chars,
        s["distinct_words"] / words, s["twin_words"] / words, s["distinct_triples"] / max(words - 2, 1), s["entropy"],
    ]


N_FEATURES = 19
