"""The learned operators against plain Python on small tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from fieldloom.llm import language_id, quality

VOCABULARY = {"aa": ["lorem", "ipsum", "dolor", "amet", "sit"], "bb": ["quux", "wibble", "frotz", "xyzzy"], "cc": ["naïve", "façade", "über"]}


def test_language_scores_equal_brute_force(spark):
    """Counts, backoff and scores written out once more, word by word."""
    rnd = random.Random(1)
    rows = [(" ".join(rnd.choice(VOCABULARY[k]) for _ in range(rnd.randint(1, 30))), k) for k in VOCABULARY for _ in range(rnd.randint(10, 30))]
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    counts = {"w": {}, "g": {}}
    for t, k in rows:
        for w in words(t):
            counts["w"].setdefault(w, Counter())[k] += 1
            for n in range(1, 6):
                for g in grams(w, n):
                    counts["g"].setdefault(g, Counter())[k] += 1
    known = {kind: {x: c for x, c in own.items() if sum(c.values()) >= 2} for kind, own in counts.items()}
    totals = {kind: {k: sum(c[k] for c in own.values()) for k in VOCABULARY} for kind, own in known.items()}
    log = lambda kind, x, k: math.log((known[kind][x][k] + 0.5) / (totals[kind][k] + 0.5 * len(known[kind])))

    def expected(text):
        own = words(text)
        total = dict.fromkeys(VOCABULARY, 0.0)
        for w in own:
            hits = [("w", w)] if w in known["w"] else next((h for n in range(5, 0, -1) if (h := [("g", g) for g in grams(w, n) if g in known["g"]])), [])
            for k in total:
                total[k] += sum(log(kind, x, k) for kind, x in hits) / max(1, len(hits))
        best = max(sorted(total), key=total.get)
        return best, 1 / sum(math.exp((v - total[best]) / len(own) * min(len(own), 30)) for v in total.values())

    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    texts = ["lorem quux naïve", "wibbly loremipsum", "ÜBER façades 12", "sit sit xyz", " ".join(t for t, _ in rows[:20])]
    got = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        best, score = expected(texts[r.doc_id])
        assert r.lang_pred == best and abs(r.score - score) < 1e-9


def test_held_out_languages_are_right(spark):
    """Nine in ten and more of the documents that were not learned from, on the given table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect() if r.lang]
    model = language_id.learn(spark.createDataFrame([(t, lang) for i, t, lang in rows if fold(i)], "text string, lang string"))
    held = [(t, lang) for i, t, lang in rows if not fold(i) and language_id.words_of(t)]
    got = [p for p, _ in model.predict([t for t, _ in held], {})]
    assert sum(p == lang for p, (_, lang) in zip(got, held, strict=True)) >= 0.9 * len(held)


def test_quality_equals_ridge_over_all_rows(spark):
    """Normal equations, weights and calibration from whole matrices, without partial sums."""
    rnd = random.Random(2)
    text = lambda good: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rnd.randint(5, 60))) + ("." if good else "!! BUY " * rnd.randint(0, 9))
    rows = [(i, text(i % 2), i % 2 if rnd.random() < 0.9 else 1 - i % 2) for i in range(400)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    model = quality.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), waves=32)
    used = [(np.array(quality.statistics(t), float), y, fold(i)) for i, t, y in rows if fold(i)]
    stats = np.stack([s for s, *_ in used])
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.scale, stats.std(axis=0) + 1e-6, atol=1e-4)
    x = model.features(stats)
    y, folds = np.array([v for _, v, _ in used], float), np.array([f for *_, f in used])
    part = folds >= 2
    penalty = np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    weights = np.linalg.solve(x[part].T @ x[part] + penalty, x[part].T @ y[part])
    assert np.allclose(x @ model.weights, x @ weights, atol=1e-6)
    raw = np.clip(x[folds == 1] @ weights, -0.5, 1.5)
    bins = np.minimum(((raw + 0.5) / 2 * quality.BINS).astype(int), quality.BINS - 1)
    groups = [(raw[bins == b].mean(), y[folds == 1][bins == b].mean(), (bins == b).sum()) for b in np.unique(bins)]
    assert np.allclose(model.steps, quality.isotonic(*map(np.array, zip(*groups, strict=True))), atol=1e-6)
    scores = np.array([r.quality_score for r in quality.score(docs, model).orderBy("doc_id").collect()])
    every = model.features(np.array([quality.statistics(t) for _, t, _ in rows], float)) @ weights
    assert np.allclose(scores, np.interp(every, model.steps[:, 0], model.steps[:, 1]), atol=1e-6)
