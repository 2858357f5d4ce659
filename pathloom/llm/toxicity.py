"""Toxicity by a subsequence string kernel: a support vector machine over Nyström landmarks.

The kernel of two words sums, over all subsequences of `order` letters that they share, decay to the power of the stretches
they span; it is normalized to 1 for equal words. A gap or an inserted character costs a factor, no more. Landmarks are
words of the training sentences; a word's kernel with them, whitened, is its feature vector. A sentence counts as toxic as
its most toxic word. Labels hold for documents, so training picks a witness in every toxic one, fits the machine against
the words of clean sentences, and repeats."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import by_batches, crc_of_id, sampled, slices, texts_of

ORDER, DECAY, WIDTH, SHARPNESS = 3, 0.5, 14, 1.5
_SENTENCE = re.compile(r"[.!?\n]+")
#: Three or more single characters apart count as one word.
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_MARKS = re.compile(r"[^\w]+|_+")


def units(text: str | None) -> list[str]:
    """Lower-case words, and spaced-out letters drawn together."""
    text = (text or "").lower()
    found = text.split()
    for run in _SPACED.findall(text):
        found.append("".join(run.split()))
    return found


def core_of(unit: str) -> str:
    return _MARKS.sub("", unit)


def forms(unit: str) -> list[str]:
    """What the kernel sees of a unit: without marks, and a long one as overlapping windows."""
    core = core_of(unit)
    if len(core) <= WIDTH:
        return [core]
    return [core[i : i + WIDTH] for i in range(0, len(core) - WIDTH // 2, WIDTH // 2)]


def _codes(words: list[str], blank: int) -> np.ndarray:
    out = np.full((len(words), WIDTH), blank, np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w[:WIDTH]]
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over shared subsequences of length ORDER of codes a[..., WIDTH] and b[..., WIDTH], which broadcast."""
    shape, decay = np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.float32(DECAY)
    used_a, used_b = (int((x >= 0).any(axis=tuple(range(x.ndim - 1))).sum()) for x in (a, b))
    # seen[j][t]: weight of the subsequences of j letters of a so far and of b before t; of none it is 1 everywhere
    seen = {j: np.zeros((used_b + 1, *shape), np.float32) for j in range(1, ORDER)}
    total = np.zeros(shape, np.float32)
    for s in range(used_a):
        same = [(a[..., s] == b[..., t]).astype(np.float32) for t in range(used_b)]
        for t in range(used_b):
            total += same[t] * seen[ORDER - 1][t]
        for j in range(ORDER - 1, 0, -1):
            seen[j] *= decay
            run = np.zeros(shape, np.float32)
            for t in range(used_b):
                run *= decay
                run += same[t] if j == 1 else same[t] * seen[j - 1][t]
                seen[j][t + 1] += run
    return total


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel [word, landmark]: a Gaussian of the distance that the normalized subsequence kernel spans, 1 for equal words
    and exp(-2 * SHARPNESS) for those that share no subsequence, so that no sum of faint likenesses looks like an insult."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    by_size = sorted(range(len(words)), key=lambda i: len(words[i]))
    marks = sorted(range(len(landmarks)), key=lambda i: len(landmarks[i]))
    groups = [g for g in (marks[: len(marks) // 2], marks[len(marks) // 2 :]) if g]
    sides = []
    for g in groups:
        b = _codes([landmarks[i] for i in g], -2)
        sides.append((g, b, _pairs(np.where(b < 0, -1, b), np.where(b < 0, -3, b))))
    for at in range(0, len(words), 1024):
        part = by_size[at : at + 1024]
        a = _codes([words[i] for i in part], -1)
        own = _pairs(a, np.where(a < 0, -3, a))
        for g, b, own_b in sides:
            out[np.ix_(part, g)] = _pairs(a[:, None, :], b[None, :, :]) / np.sqrt(np.maximum(np.outer(own, own_b), np.float32(1e-12)))
    return np.exp(2 * SHARPNESS * (out - 1))


@dataclass
class Machine:
    """Landmarks, the weight of each, and the calibration of a document's largest decision value to a probability."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    most: int = 200_000
    young: dict[str, float] = field(default_factory=dict)
    old: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"young": {}, "old": {}}

    def decide(self, unit_list: list[str]) -> np.ndarray:
        """Decision values of units, each that of its most toxic form."""
        if not self.landmarks or not unit_list:
            return np.full(len(unit_list), self.bias)
        parts = [forms(u) for u in unit_list]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        values = kernel([f for p in parts for f in p], self.landmarks) @ self.weights + self.bias
        return np.maximum.reduceat(values, np.concatenate([[0], sizes.cumsum()[:-1]]))

    def tops(self, texts: list[str | None]) -> np.ndarray:
        """The largest decision value of each text's units; the bias where there is none."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        sets = [set(units(t)) for t in texts]
        new = []
        for u in set().union(*sets).difference(self.young):
            if (known := self.old.get(u)) is None:
                new.append(u)
            else:
                self.young[u] = known
        self.young.update(zip(new, self.decide(new).tolist(), strict=True))
        get = self.young.__getitem__
        return np.array([max(map(get, s), default=self.bias) for s in sets])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.tops(texts) + self.shift, -60, 60)))

    def sentences(self, text: str | None) -> list[tuple[str, float]]:
        """The text's sentences, each with its own score."""
        found = [s for s in _SENTENCE.split(text or "") if s.strip()]
        return list(zip(found, self.score(found).tolist(), strict=True))


def _fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge support vector machine, by Newton steps on the rows within the margin."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    free = np.eye(z.shape[1])
    free[-1, -1] = 1e-3
    w = np.zeros(z.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(v @ free @ v / 2 + c * (weight * np.maximum(0, 1 - y * (z @ v)) ** 2).sum())

    for _ in range(rounds):
        on = y * (z @ w) < 1
        part = z[on] * weight[on, None]
        step = np.linalg.solve(free + 2 * c * part.T @ z[on], 2 * c * part.T @ y[on]) - w
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def fit_machine(texts: list[str], toxic: list[int], landmarks: int = 28, clean_landmarks: int = 6, negatives: int = 3_000, rounds: int = 3, seed: int = 3) -> Machine:
    """A machine for the labelled texts; a constant that calls nothing toxic if one of the labels is missing."""
    bags = [sorted(set(units(t))) for t in texts]
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return Machine([], np.zeros(0), -1.0, 1.0, -2.0)
    rng = np.random.default_rng(seed)
    cores = [{c for c in map(core_of, bag) if ORDER <= len(c) <= WIDTH} for bag in bags]
    inside, outside = Counter(), Counter()
    seen: set[int] = set()
    n1 = 0
    for text, own, t in zip(texts, cores, y, strict=True):
        if not t:
            outside.update(own)
            continue
        words = text.lower().split()
        triples = {hash(x) for x in zip(words, words[1:], words[2:], strict=False)}
        # copies would make every word of theirs telling
        if not triples or 2 * len(triples & seen) < len(triples):
            n1 += 1
            inside.update(own)
        seen |= triples
    n0 = int((~y).sum())

    def odds(core: str) -> float:
        return float(np.log((inside[core] + 0.5) / (n1 + 1)) - np.log((outside[core] + 0.5) / (n0 + 1)))

    share1 = n1 / (n1 + n0)

    def evidence(core: str) -> float:
        """The likelihood-ratio statistic of the word's counts against the share of toxic documents."""
        n, m = inside[core], outside[core]
        return 2 * (n * np.log(n / ((n + m) * share1)) + (m * np.log(m / ((n + m) * (1 - share1))) if m else 0.0))

    telling = sorted((c for c, n in inside.items() if n >= 4 and odds(c) > 2 and evidence(c) > 20), key=lambda c: (-inside[c], c))[:600]
    if not telling:
        return Machine([], np.zeros(0), -1.0, 1.0, -2.0)
    # landmarks cover the toxic documents: telling words, or stems of at least three of them, that clean documents lack
    stems = Counter(x for w in telling for x in {w[i:j] for i in range(len(w)) for j in range(i + ORDER + 1, len(w) + 1)})
    clean_line = "\n".join(outside)
    spots: dict[str, set[int]] = {}
    toxic_cores = [own for own, t in zip(cores, y, strict=True) if t]
    known = set(telling)
    for i, own in enumerate(toxic_cores):
        for w in own & known:
            spots.setdefault(w, set()).add(i)
    covers: dict[str, set[int]] = {}
    for x in [x for x, n in stems.items() if n >= 3 or x in known]:
        if x not in clean_line or sum(n for w, n in outside.items() if x in w) <= 0.002 * n0:
            covers[x] = set().union(*(spots.get(w, ()) for w in telling if x in w))
    chosen: list[str] = []
    left = np.full(len(toxic_cores), 1)
    while covers and len(chosen) < landmarks:
        best = max(covers, key=lambda x: (sum(left[i] > 0 for i in covers[x]), len(x), x))
        if sum(left[i] > 0 for i in covers[best]) < 3:
            break
        chosen.append(best)
        for i in covers.pop(best):
            left[i] -= 1
    # an insult that others mostly stand beside is a landmark all the same
    chosen += [c for c in telling if c not in chosen and inside[c] >= 0.01 * n1 and kernel([c], chosen or [c]).max() < 0.3][: landmarks - len(chosen)]
    if not chosen:
        return Machine([], np.zeros(0), -1.0, 1.0, -2.0)
    insults = list(chosen)
    chosen += [c for c, _ in outside.most_common(2000) if ORDER < len(c) and c not in chosen][:clean_landmarks]
    gram = kernel(chosen, chosen).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    clean = sorted({f for bag, t in zip(bags, y, strict=True) if not t for u in bag for f in forms(u) if len(f) >= ORDER})
    clean = [clean[i] for i in sorted(rng.permutation(len(clean))[: 20 * negatives].tolist())]
    # the commonest clean words and landmarks, those nearest to any insult, and others at random
    clean = list(dict.fromkeys([*chosen[len(insults) :], *(c for c, _ in outside.most_common(negatives // 3)), *clean]))
    near = kernel(clean, chosen)
    picked = sorted({*range(min(len(clean), negatives // 3)), *np.argsort(-near[:, : len(insults)].max(axis=1), kind="stable")[: negatives // 2].tolist(), *rng.permutation(len(clean))[: negatives // 3].tolist()})
    x0 = near[picked] @ whiten
    # insults with a character put in are toxic too
    bent = sorted({w[:i] + c + w[i:] for w in insults for i in range(1, len(w)) for c in "x0"})
    bent_x = kernel(bent, chosen) @ whiten
    toxic_bags = [bag for bag, t in zip(bags, y, strict=True) if t]
    words = sorted({f for bag in toxic_bags for u in bag for f in forms(u)})
    place = {f: i for i, f in enumerate(words)}
    within = [np.unique([place[f] for u in bag for f in forms(u)]).astype(int) for bag in toxic_bags]
    x = kernel(words, chosen) @ whiten
    sure = {place[c] for c in telling if c in place}
    value = np.array([odds(w) if i in sure else -9.0 for i, w in enumerate(words)])
    machine = Machine(chosen, np.zeros(len(chosen)), -1.0, 1.0, 0.0)
    for _ in range(rounds):
        witness = {int(w[np.argmax(value[w])]) for w in within if len(w)}
        good = sorted(sure | {i for i in witness if value[i] > 0 and inside[words[i]] >= 2 and odds(words[i]) > 1 and evidence(words[i]) > 5})
        both = np.vstack([x[good], bent_x, x0])
        sign = np.concatenate([np.ones(len(good) + len(bent)), -np.ones(len(x0))])
        share = np.concatenate([np.full(len(good), len(x0) / max(len(good), 1)), np.full(len(bent), 0.2 * len(x0) / max(len(bent), 1)), np.ones(len(x0))])
        w, b = _fit_linear(both, sign, share, c=5.0)
        machine.weights, machine.bias = whiten @ w, b
        value = x @ w + b
    top = machine.tops(texts)
    machine.slope, machine.shift = _calibrated(top, y.astype(float))
    machine.young, machine.old = {}, {}
    return machine


def _calibrated(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits labels y to values x (targets drawn in a little from 0 and 1)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    v, z = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], axis=1)

    def loss(u: np.ndarray) -> float:
        m = z @ u
        return float((np.logaddexp(0, m) - target * m).sum() + 1e-4 * u @ u)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 2e-4 * np.eye(2)
        step, size = np.linalg.solve(h, z.T @ (p - target) + 2e-4 * v), 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
    return float(max(v[0], 0.0)), float(v[1])


def third(doc_id: str) -> Column:
    """Whether the crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(False))


def learn_toxicity(docs: DataFrame, labels: DataFrame, held_out: Callable, most: int = 1_500, longest: int = 1 << 16) -> Machine:
    """A machine fitted on at most `most` toxic and twice as many clean labelled documents that held_out(id) leaves.

    They are the documents with the smallest hash of the id; texts of over `longest` bytes are passed over, which bounds what
    the driver holds. Rows without an id or with another label teach nothing; of rows of equal doc_id the smallest text does."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out("doc_id")).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = sampled(usable.filter("toxic = 1"), most, F.col("doc_id")).union(sampled(usable.filter("toxic = 0"), 2 * most, F.col("doc_id")))
    rows = texts_of(docs, chosen, ["doc_id"], longest).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text, r.toxic))
    return fit_machine([r.text for r in rows], [r.toxic for r in rows])


def score_toxicity(docs: DataFrame, model: Machine, score: str = "score") -> DataFrame:
    """docs with the column `score`, the probability that the text is toxic. A null text counts as empty; an old column of
    that name goes."""
    rest = [c for c in docs.columns if c not in (score, "text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest, "text").schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a worker keeps it, and the words it knows, between tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(b.column("text").to_pylist()))], names=[*b.schema.names, score])

    return by_batches(docs.select(*rest, "text"), run, f"{fields}, `{score}` double")
