"""Language ID by a linear-chain conditional random field over the words of a text.

Each word is scored for each language by the learned weights of its affixes and n-grams (all byte n-grams of the word with
its ends marked) and of its entry in a lexicon of training words; learned transitions join neighbours. Forward-backward
gives each word's posterior, so a text that switches between languages is labelled word by word; their mean decides the
text. Training minimizes the negative log-likelihood of sequences spliced from documents of different languages."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import by_batches, crc_of_id, slices, texts_of

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_TABLE = 1 << 16
_ORDERS = (1, 2, 3, 4)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; none if the text has no letter."""
    found = _WORD.findall((text or "").lower())
    return found if any(map(str.isalpha, found)) or any(map(str.isalpha, text or "")) else []


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all words in a row, where each word's begin)."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(raw)), sizes)
    hashes, owners = [], []
    rolled = np.zeros(len(codes), np.uint64)
    for n in _ORDERS:
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0x9E3779B1) + codes[n - 1 :]
        whole = owner[: len(rolled)] == owner[n - 1 :]
        mixed = (rolled + np.uint64(n)) * np.uint64(0xFF51AFD7ED558CCD)
        hashes.append((mixed >> np.uint64(48)).astype(np.int64)[whole])
        owners.append(owner[: len(rolled)][whole])
    by = np.argsort(np.concatenate(owners), kind="stable")
    owner = np.concatenate(owners)[by]
    return np.concatenate(hashes)[by], np.searchsorted(owner, np.arange(len(raw)))


@dataclass
class Field:
    """The random field: languages, weights of n-grams [hash, language] and lexicon words, start and transition scores."""

    languages: list[str]
    grams: np.ndarray
    lexicon: dict[str, int]
    entries: np.ndarray
    start: np.ndarray
    transitions: np.ndarray
    most: int = 150_000
    cache: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "table": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        """The scores [word, language] of words, each looked up alone, a few thousand at a time."""
        if len(words) > 4096:
            return np.concatenate([self.emissions(words[i : i + 4096]) for i in range(0, len(words), 4096)])
        hashes, starts = gram_rows(words)
        out = np.add.reduceat(self.grams[hashes], starts, axis=0)
        known = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        if known:
            i, j = map(list, zip(*known, strict=True))
            out[i] += self.entries[j]
        return out

    def rows(self, docs: list[list[str]]) -> list[np.ndarray]:
        """For each document the rows of `table` that hold its words' emissions, exponentiated. The table is bounded."""
        if len(self.cache) > self.most or self.table is None:
            self.cache, self.table = {}, np.empty((0, len(self.languages)), np.float32)
        cache = self.cache
        new = [w for w in dict.fromkeys(w for d in docs for w in d) if w not in cache]
        if new:
            scores = self.emissions(new)
            cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)])
        get = cache.__getitem__
        return [np.fromiter(map(get, d), np.int64, len(d)) for d in docs]

    def posteriors(self, docs: list[list[str]]) -> list[np.ndarray]:
        """For each list of words its [word, language] posteriors."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        rows = self.rows([docs[i] for i in order])
        found = forward_backward([self.table[r] for r in rows], np.exp(self.start), np.exp(self.transitions))
        out: list[np.ndarray] = [np.empty(0)] * len(docs)
        for i, p in zip(order, found, strict=True):
            out[i] = p
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its mean posterior of each text; `und` and 0 for those without letters."""
        docs = [words_of(t) if self.languages else [] for t in texts]
        out = []
        for p in self.posteriors(docs):
            mean = p.mean(axis=0) if len(p) else None
            out.append((UNKNOWN, 0.0) if mean is None else (self.languages[int(mean.argmax())], float(min(mean.max(), 1.0))))
        return out

    def switches(self, text: str | None) -> list[tuple[str, int]]:
        """The text's words as runs of one language: (language, number of words)."""
        runs: list[tuple[str, int]] = []
        words = words_of(text)
        for k in self.posteriors([words])[0].argmax(axis=1) if words and self.languages else []:
            runs.append((self.languages[k], 1 + runs.pop()[1] if runs and runs[-1][0] == self.languages[k] else 1))
        return runs


def forward_backward(emissions: list[np.ndarray], start: np.ndarray, moves: np.ndarray) -> list[np.ndarray]:
    """Posteriors of chains, longest first: all chains take a step at once, scaled at each so that no product underflows."""
    lengths = np.array([len(e) for e in emissions])
    if not len(lengths) or not lengths[0]:
        return [np.empty((0, len(start))) for _ in emissions]
    begins = np.concatenate([[0], lengths.cumsum()[:-1]])
    flat = np.concatenate(emissions).astype(float)
    alpha, beta = np.empty_like(flat), np.ones_like(flat)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    at = begins[: active[0]]
    now = start * flat[at]
    now /= now.sum(axis=1, keepdims=True)
    alpha[at] = now
    for t in range(1, lengths[0]):
        k = active[t]
        at = begins[:k] + t
        now = (now[:k] @ moves) * flat[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    back = np.ones((0, len(start)))
    turned = moves.T
    for t in range(lengths[0] - 2, -1, -1):
        k = active[t + 1]
        at = begins[:k] + t + 1
        if len(back) < k:
            back = np.concatenate([back, np.ones((k - len(back), len(start)))])
        back = (back * flat[at]) @ turned
        back /= back.sum(axis=1, keepdims=True)
        beta[at - 1] = back
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    return np.split(both, lengths.cumsum()[:-1])


def fit_field(texts: list[str], langs: list[str], length: int = 120, passes: int = 5, rate: float = 0.25, decay: float = 1e-4, lexicon: int = 20_000, seed: int = 7) -> Field:
    """The field that makes the training words' languages likely, by Adagrad on sequences of `length` words.

    Sequences are spliced from stretches of 5 to 40 words of the documents in random order, so that transitions see both
    staying and switching. Without texts the field has no language and calls everything `und`."""
    languages = sorted(set(langs))
    n_lang, rng = len(languages), np.random.default_rng(seed)
    docs = [(words_of(t), languages.index(k)) for t, k in zip(texts, langs, strict=True)]
    counts = Counter(w for d, _ in docs for w in d)
    entries = {w: i for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:lexicon]) if n >= 3}
    out = Field(languages, np.zeros((_TABLE, n_lang)), entries, np.zeros((len(entries), n_lang)), np.zeros(n_lang), np.zeros((n_lang, n_lang)))
    stretches = []
    for words, k in docs:
        at = 0
        while at < len(words):
            n = int(rng.integers(5, 41))
            stretches.append((words[at : at + n], k))
            at += n
    if not stretches:
        return Field([], out.grams, {}, out.entries, out.start, out.transitions)
    types = {w: i for i, w in enumerate(counts)}
    mixed = [stretches[i] for i in rng.permutation(len(stretches))]
    x = np.array([types[w] for words, _ in mixed for w in words])
    y = np.array([k for words, k in mixed for _ in words])
    rows = max(1, len(x) // length)
    x, y = (a[: rows * length].reshape(rows, -1) for a in (x, y))
    hashes, starts = gram_rows(list(types))
    ends = np.append(starts[1:], len(hashes))
    listed = list(types)
    known = np.array([entries.get(w, -1) for w in listed])
    sums = [np.zeros_like(w) + 1e-3 for w in (out.grams, out.entries, out.start, out.transitions)]
    batches = max(1, rows // max(16, min(500, 4000 // n_lang)))
    for _ in range(passes):
        for part in np.array_split(rng.permutation(rows), batches):
            bx, by = x[part], y[part]
            used, inverse = np.unique(bx, return_inverse=True)
            inverse = inverse.reshape(bx.shape)
            sizes = ends[used] - starts[used]
            flat = np.repeat(starts[used] - np.concatenate([[0], sizes.cumsum()[:-1]]), sizes) + np.arange(sizes.sum())
            grams, owner = hashes[flat], np.repeat(np.arange(len(used)), sizes)
            scores = np.add.reduceat(out.grams[grams], np.concatenate([[0], sizes.cumsum()[:-1]]), axis=0)
            lex = known[used]
            scores[lex >= 0] += out.entries[lex[lex >= 0]]
            e = np.exp(scores - scores.max(axis=1, keepdims=True))[inverse]
            alpha, beta = np.empty_like(e), np.ones_like(e)
            first, moves = np.exp(out.start), np.exp(out.transitions)
            alpha[:, 0] = first * e[:, 0]
            alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, bx.shape[1]):
                a = (alpha[:, t - 1] @ moves) * e[:, t]
                alpha[:, t] = a / a.sum(axis=1, keepdims=True)
            for t in range(bx.shape[1] - 2, -1, -1):
                b = (beta[:, t + 1] * e[:, t + 1]) @ moves.T
                beta[:, t] = b / b.sum(axis=1, keepdims=True)
            p = alpha * beta
            p /= p.sum(axis=2, keepdims=True)
            # the posteriors of neighbours, summed over all places by one product of matrices
            ahead = e[:, 1:] * beta[:, 1:]
            before = alpha[:, :-1] / ((alpha[:, :-1] @ moves) * ahead).sum(axis=2, keepdims=True)
            pairs = moves * (before.reshape(-1, n_lang).T @ ahead.reshape(-1, n_lang))
            gold = np.eye(n_lang)[by]
            off = gold - p
            word_off = np.stack([np.bincount(inverse.ravel(), off[..., k].ravel(), len(used)) for k in range(n_lang)], axis=1)
            gold_pairs = np.bincount((by[:, :-1] * n_lang + by[:, 1:]).ravel(), minlength=n_lang * n_lang).reshape(n_lang, n_lang)
            steps = [
                np.stack([np.bincount(grams, word_off[owner, k], _TABLE) for k in range(n_lang)], axis=1),
                np.stack([np.bincount(lex[lex >= 0], word_off[lex >= 0, k], len(entries)) for k in range(n_lang)], axis=1) if len(entries) else np.zeros((0, n_lang)),
                off[:, 0].sum(axis=0),
                gold_pairs - pairs,
            ]
            for w, g, s in zip((out.grams, out.entries, out.start, out.transitions), steps, sums, strict=True):
                g = g / bx.size - decay / len(languages) * w
                s += g * g
                w += rate * g / np.sqrt(s)
    return out


def third(doc_id: str) -> Column:
    """Whether the crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(False))


def learn_languages(docs: DataFrame, held_out: Callable, per_language: int = 320, longest: int = 1 << 16, buckets: int = 64) -> Field:
    """A field fitted on at most `per_language` documents each of all languages of docs.lang.

    They are those with the smallest hashes of the id among the rows with id, lang and a text of at most `longest` bytes that
    held_out(id) leaves. Buckets by that hash are ranked first, so that no task ranks all rows of a frequent language. Of
    rows of equal doc_id and lang the smallest text teaches."""
    usable = docs.filter("doc_id is not null and lang is not null").filter(F.octet_length("text") <= longest).filter(~held_out("doc_id"))
    known = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("k")).distinct()
    for group in (Window.partitionBy("lang", F.pmod("k", F.lit(buckets))), Window.partitionBy("lang")):
        known = known.withColumn("r", F.row_number().over(group.orderBy("k", "doc_id"))).filter(F.col("r") <= per_language)
    rows = texts_of(docs, known.select("doc_id", "lang"), ["doc_id", "lang"], longest).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.lang, r.text))
    return fit_field([r.text for r in rows], [r.lang for r in rows])


def predict_languages(docs: DataFrame, model: Field, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns `lang_pred` and `score`. A null text or one without letters is `und` with score 0; old columns
    of these names go."""
    rest = [c for c in docs.columns if c not in (lang_pred, score, "text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest, "text").schema)

    shared = docs.sparkSession.sparkContext.broadcast(model)  # a worker keeps it, and its table of words, between tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, rows=256, size=max(1 << 16, (4 << 20) // max(len(model.languages), 4))):
            found = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k for k, _ in found]), pa.array([s for _, s in found])], names=[*b.schema.names, lang_pred, score])

    return by_batches(docs.select(*rest, "text"), run, f"{fields}, `{lang_pred}` string, `{score}` double")
