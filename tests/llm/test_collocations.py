"""Operator 12 against plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from fieldloom.llm import collocations, queries

DOCS = "doc_id long, text string, lang string, w1 string, n int"


def brute(rows, least=10, most=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        if len(p) == 2 and any(len(q) == 3 and lg == lang and p in (q[:2], q[1:]) and 100 * b >= 50 * a for (lg, q), b in candidates.items()):
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:most]))


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts(seed, n=120):
    rnd = random.Random(seed)
    words = ["New", "york", "Élan", "the", "of", "a", "zoo", "und", "x-y", "9", "日本", "longer-word" * 3]
    weights = [9, 9, 3, 30, 20, 20, 2, 2, 2, 2, 2, 1]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 60)):
            parts += rnd.choices(["in the city", "IN THE TOWN", rnd.choices(words, weights)[0]], [1, 1, 12])
            parts.append(rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "!? "]))
        rows.append((i, "".join(parts), rnd.choice(["en", "en", "en", "de", None])))
    rows += [(n, None, "en"), (n + 1, "", "fr"), (n + 2, "a b c", "es"), (n + 3, ".,;", "it"), (n + 4, "z z q " * 3000, "en"), (n + 5, "one two " * 40, None)]
    return rows + [rows[3]] * 30


@pytest.mark.parametrize("sizes", [{}, {"block": 300, "group": 400, "limit": 40, "sample": 1}, {"block": 2000, "limit": 10, "sample": 1}])
def test_equals_plain_counting(spark, sizes):
    rows = texts(1)
    df = spark.createDataFrame([(i, t, lang, "clash", 3) for i, t, lang in rows], DOCS).repartition(3)
    got = rows_of(collocations.collocations(df, **sizes))
    assert got == brute([(t, lang) for _, t, lang in rows])
    assert {g[0] for g in got} == {"en", "de", "und"}


def test_report_is_cut_with_ties(spark):
    rows = [(i, "b c. a d. C B! d a", "en") for i in range(12)]
    df = spark.createDataFrame([(i, t, lang, "", 0) for i, t, lang in rows], DOCS)
    assert rows_of(collocations.collocations(df, most=3)) == brute([(t, lang) for _, t, lang in rows], most=3)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 0), (2, "rare words only", "en", "", 0)], DOCS)).count() == 0


def test_counts_beyond_a_long(spark):
    n = 3_000_000_000
    counts = spark.createDataFrame([("en", "a", None, None, n), ("en", "b", None, None, n), ("en", "a", "b", None, n - 1), ("en", "b", "a", None, 11)], collocations.PHRASES)
    got = {r.phrase: r.score for r in collocations.scored(counts).collect()}
    assert got == {"a b": 1000000 * (n - 1) ** 2 // n**2, "b a": 0}


def test_multikey_parts():
    rnd = np.random.default_rng(4)
    symbols = rnd.integers(0, 4, (4, 5000)).astype(np.int32) + np.array([[1], [0], [0], [0]], np.int32)
    weights = rnd.integers(1, 5, 5000)
    want = Counter()
    for j in range(5000):
        for d in range(1, 5):
            if symbols[d - 1, j] == 0:
                break
            want[tuple(symbols[:d, j])] += weights[j]
    got = {tuple(symbols[:d, p]): n for d, at, totals in collocations.multikey_parts(symbols, weights, 60) for p, n in zip(at, totals, strict=True)}
    assert got == {k: n for k, n in want.items() if n >= 60}


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duck.sql(queries.ORACLE_SQL["op12_collocations"])
    got = queries.QUERIES["op12_collocations"](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(got) == sorted(want.select(*names).fetchall()) and got.count() > 100
