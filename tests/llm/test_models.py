import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import docstats, language_model, quality_model, quality_rules, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, score double, distance string"
SF = "/root/testdata/sf0.001"
ODD = [(1, None, None, None, 1.0, "x"), (1, "", "en", "a", 1.0, "x"), (None, "some words here", "en", None, None, None), (2, "word " * 30000, "en", "a", 1.0, "x"), (3, "123 !!!", "fr", "a", 1.0, "x"), (3, "123 !!!", "fr", "a", 1.0, "x")]


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {k for i, g in enumerate(grams) if count[g] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("seed", range(4))
def test_counts_by_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b ", "ab", " ", "\n", "\n\n", "é", "\x0b", "\x85", "#", "<|>", "c\n", "a b c ", "\xa0"]) for _ in range(rng.randint(0, 80)))
        assert docstats.statistics(text)[:5] == _base(text)
    assert docstats.statistics(None)[:5] == (0, 0, 0, 0, 0)
    assert len(docstats.features(docstats.statistics("x"))) == docstats.N_FEATURES


def test_outliers_are_rejected_and_others_kept(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "with", "water", "stone", "river"]

    def clean():
        return ". ".join(" ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(10)) for _ in range(rng.randint(10, 30)))

    rows = [(i, clean(), "en", f"s{i % 3 if i % 2 else 0}", None, None) for i in range(600)]
    junk = [(1000 + i, re.sub(r"\w+", lambda m: m[0].upper() + "!!###", clean()), "en", "s0", None, None) for i in range(30)]
    got = quality_rules.judge(quality_rules.statistics_of(spark.createDataFrame(rows + junk, DOCS))).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {r[0] for r in rows}
    assert len(got) == 630


def _plain_estimate(x, part=0.75):
    """The estimate of one group by numpy: squared distances on the scale of the chi-square distribution."""
    def rank(v, p):
        return np.sort(v)[math.ceil(p * len(v)) - 1]

    floors = np.square(list(quality_rules.VECTOR.values()))
    q1, q2, q3 = ([rank(c, p) for c in x.T] for p in (0.25, 0.5, 0.75))
    mean, cov, last = np.array(q2), np.diag(np.square((np.array(q3) - np.array(q1)) / 1.349) + floors), None
    while True:
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        near = x[d <= rank(d, part)]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(floors)
        now = np.linalg.slogdet(cov)[1]
        if last is not None and last - now <= 1e-3:
            break
        last = now
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    k = x.shape[1]
    return d / (rank(d, 0.5) / (k * (1 - 2 / (9 * k)) ** 3))


def test_distances_by_a_plain_estimate(spark):
    rng = np.random.default_rng(5)
    sizes = {("en", "a"): 400, ("en", "b"): 150, ("fr", "a"): 20}
    k = quality_rules.K
    parts = {g: rng.normal(0, 1, (n, k)) @ rng.normal(0, 1, (k, k)) + rng.normal(0, 3, k) for g, n in sizes.items()}
    for x in parts.values():
        x[: len(x) // 10] += 25
    rows, i = [], 0
    for (lang, source), x in parts.items():
        for v in x.tolist():
            rows.append((i, lang, source, 100, 500, 0, 0, 0, v))
            i += 1
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, quality_rules.STATISTICS)).collect()}
    everything = np.vstack(list(parts.values()))
    expected = np.concatenate([_plain_estimate(parts["en", "a"]), _plain_estimate(parts["en", "b"]), _plain_estimate(everything)[-20:]])
    assert np.allclose([got[j].distance for j in range(i)], expected, rtol=1e-6)
    assert all(got[j].kept == (expected[j] <= k / 0.05) for j in range(i))


def test_outlier_rules_of_odd_tables(spark):
    df = spark.createDataFrame(ODD, DOCS)
    got = quality_rules.judge(quality_rules.statistics_of(df)).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept is not None
    assert quality_rules.judge(quality_rules.statistics_of(df.limit(0))).count() == 0


def test_rules_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_robust_outlier_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _base(texts[r.doc_id])


def test_forest_learns_and_survives_poor_data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = quality_model.fit_forest(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    for poor in (quality_model.fit_forest(x[:0], y[:0]), quality_model.fit_forest(x[:50], np.ones(50))):
        assert np.ptp(poor.score(x)) == 0 and 0 < poor.score(x)[0] < 1


def test_quality_on_held_out_documents(spark):
    rows = queries.op5_quality_classifier(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert sum(r.predicted for r in rows if r.quality) / sum(r.quality for r in rows) > 0.98


def test_quality_of_odd_tables(spark):
    df = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (2, 5)], "doc_id long, quality int")
    forest = quality_model.learn_quality(df, labels, quality_model.fifth)
    got = quality_model.score_quality(df, forest)
    assert got.columns.count("score") == 1 and got.count() == len(ODD)
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert quality_model.score_quality(df.limit(0), forest).count() == 0


def test_forward_backward_by_brute_force():
    rng = np.random.default_rng(2)
    chains = [rng.random((n, 3)) for n in (5, 3, 3, 1)]
    start, moves = rng.random(3), rng.random((3, 3))
    for e, p in zip(chains, language_model.forward_backward(chains, start, moves), strict=True):
        mass = np.zeros_like(e)
        for path in itertools.product(range(3), repeat=len(e)):
            w = start[path[0]] * math.prod(e[i, k] for i, k in enumerate(path)) * math.prod(moves[a, b] for a, b in itertools.pairwise(path))
            for i, k in enumerate(path):
                mass[i, k] += w
        assert np.allclose(p, mass / mass.sum(axis=1, keepdims=True))


def test_rare_languages_are_learned_and_many_fit():
    rng = np.random.default_rng(4)
    texts, langs = [], []
    for k in range(60):
        stem = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(20)]
        for _ in range(2):
            texts.append(" ".join(rng.choice(stem, 60)))
            langs.append(f"l{k}")
    model = language_model.fit_field(texts, langs)
    assert len(model.languages) == 60
    assert np.mean([p == k for (p, _), k in zip(model.predict(texts), langs, strict=True)]) > 0.9


def test_training_rows_are_defined(spark):
    rows = [(i, f"mot numero {i} " * 3, "fr") for i in range(40)] + [(7, "another text of seven", "fr"), (8, "x " * 40_000, "de"), (None, "no id", "en"), (9, None, "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    for n in (1, 3):
        fitted = language_model.learn_languages(df.repartition(n), language_model.third, per_language=5)
        seen.append((fitted.languages, sorted(fitted.lexicon), fitted.transitions.round(9).tolist()))
    assert seen[0] == seen[1] and seen[0][0] == ["fr"]


def test_grams_by_brute_force():
    words = ["a", "été", "languages"]
    hashes, starts = language_model.gram_rows(words)
    sizes = np.diff(np.append(starts, len(hashes)))
    assert sizes.tolist() == [sum(max(len(w.encode()) + 2 - n + 1, 0) for n in (1, 2, 3, 4)) for w in words]
    alone = [sorted(language_model.gram_rows([w])[0]) for w in words]
    assert [sorted(x) for x in np.split(hashes, starts[1:])] == alone


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95


def test_switches_and_odd_texts(spark):
    texts = ["the house of the king was old and the door was wide open", "la maison du roi est vieille et la porte est grande ouverte"] * 30
    field = language_model.fit_field(texts, ["en", "fr"] * 30)
    runs = field.switches("the king was old and la porte est grande")
    assert runs[0][0] == "en" and runs[-1][0] == "fr" and sum(n for _, n in runs) == 9
    assert field.predict([None, "", "12 !? ²", "²³ x"])[:3] == [("und", 0.0)] * 3
    df = spark.createDataFrame(ODD, DOCS)
    got = language_model.predict_languages(df, field).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id == 3} == {"und"}
    empty = language_model.learn_languages(df.limit(0), language_model.third)
    assert empty.predict(["some text"]) == [("und", 0.0)]
    assert language_model.predict_languages(df, empty).count() == len(ODD)


def _subsequences(s, t):
    total = 0.0
    for a in itertools.combinations(range(len(s)), toxicity.ORDER):
        for b in itertools.combinations(range(len(t)), toxicity.ORDER):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += toxicity.DECAY ** (a[-1] - a[0] + b[-1] - b[0] - 2 * (toxicity.ORDER - 1))
    return total


def test_kernel_by_brute_force():
    words = ["worthless", "w0rthless", "wo", "less", "scum", "sccum", "thworth"]
    got = toxicity.kernel(words, words[:1] + words[3:5])
    for i, s in enumerate(words):
        for j, t in enumerate(words[:1] + words[3:5]):
            norm = math.sqrt(_subsequences(s, s) * _subsequences(t, t))
            k = _subsequences(s, t) / norm if norm else 0.0
            assert got[i, j] == pytest.approx(math.exp(2 * toxicity.SHARPNESS * (k - 1)), abs=1e-4)


def test_toxicity_learns_gapped_insults():
    rng = random.Random(8)
    plain = ["river", "stone", "water", "house", "garden", "window", "letter", "morning", "worth", "less", "this", "that"]
    texts, labels = [], []
    for i in range(300):
        words = [rng.choice(plain) + rng.choice(["", "", "s", "ed"]) for _ in range(40)]
        if i % 3 == 0:
            words.insert(rng.randrange(40), rng.choice(["worthless", "scumbag", "idiot"]))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    m = toxicity.fit_machine(texts, labels)
    clean, toxic, gapped, dotted, spaced = m.score(["the river and the garden this morning", "you idiot", "you worthleess", "you i-d-i-o-t", "you i d i o t here"])
    assert clean < 0.5 < min(toxic, dotted, spaced) and gapped > clean
    assert m.sentences("You idiot. The river was wide.")[1][1] < 0.5
    assert all(0 <= s <= 1 for s in m.score([None, "", " ", "x" * 5000]))


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    found = sum(r.predicted and r.toxic for r in rows)
    assert found / sum(r.predicted for r in rows) > 0.9
    assert found / sum(r.toxic for r in rows) > 0.5


def test_toxicity_of_odd_tables(spark):
    df = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(df, labels, toxicity.third)
    got = toxicity.score_toxicity(df, model)
    assert got.columns.count("score") == 1 and got.count() == len(ODD)
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_held_out_rows(spark):
    ids = spark.range(200).select(F.col("id").alias("doc_id"), quality_model.fifth("id").alias("a"), language_model.third("id").alias("b"))
    import zlib

    for r in ids.collect():
        crc = zlib.crc32(str(r.doc_id).encode())
        assert (r.a, r.b) == (crc % 5 == 0, crc % 3 == 1)
