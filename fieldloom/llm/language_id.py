"""Language identification by word-first backoff.

A word of the text that the model knows is scored by its log frequency in each
language.  A word it has not seen falls back to its longest character n-grams
that the model knows: 5 characters first, then 4, 3, 2 and 1, the order that
yields any hit giving the mean of its hits.  Scores add up over the words of the
whole text; the best language wins.

Learning counts words and n-grams of a sample of the training rows with one
``groupBy``.  The sample is bounded by ``max_rows`` (expected size; rows are
drawn one by one, copies too, and it is never empty where there is a row).  The model holds every key that the sample
has ``least`` times, so what is broadcast is bounded by the sample and does not
grow with the corpus.

Defined results
---------------
* null texts and texts without a letter are ``und`` with score 0.
* texts whose every word is unknown at all orders get the language with the most
  training words, with an even score; ties go to the language first in order.
* without any usable training row there is no language to predict: ``und``, 0.
* only ``text`` is read for a prediction, in full; other columns are kept out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Words longer than this are not cached.
LONG_WORD = 64


def words_of(text: str | None) -> list[str]:
    words = WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def grams(word: str, order: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


@dataclass
class LanguageModel:
    """Log frequencies per language; row i of ``logs`` belongs to the key numbered i."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray
    prior: int

    def rows_of(self, word: str) -> list[int]:
        known = self.words.get(word)
        if known is not None:
            return [known]
        get = self.grams.get
        for order in ORDERS:
            hits = [i for g in grams(word, order) if (i := get(g)) is not None]
            if hits:
                return hits
        return []

    def predict(self, texts: list[str | None], cache: dict[str, list[int]]) -> Iterator[tuple[str, float]]:
        for text in texts:
            words = words_of(text)
            if not words or not self.languages:
                yield "und", 0.0
                continue
            rows: list[int] = []
            weights: list[float] = []
            for word, n in Counter(words).items():
                hits = cache.get(word)
                if hits is None:
                    hits = self.rows_of(word)
                    if len(cache) > 300_000:
                        cache.clear()
                    if len(word) <= LONG_WORD:
                        cache[word] = hits
                if len(hits) == 1:
                    rows.append(hits[0])
                    weights.append(n)
                elif hits:
                    rows.extend(hits)
                    weights.extend([n / len(hits)] * len(hits))
            if not rows:
                yield self.languages[self.prior], 1 / len(self.languages)
                continue
            total = np.asarray(weights) @ self.logs[rows]
            best = int(np.argmax(total))
            # The mean log ratio of a word, counted for at most 30 words: sure, but not of everything.
            ratio = (total - total[best]) / len(words) * min(len(words), 30)
            yield self.languages[best], float(1 / np.exp(np.maximum(ratio, -700)).sum())


def learn(training: DataFrame, max_rows: int = 20_000, least: int = 2) -> LanguageModel:
    """A model of ``training`` (text, lang); rows with a null in either are left out."""
    rows = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    total = rows.count()
    if total > max_rows:
        # By row, so that copies of a text are drawn one by one like other rows.
        drawn = rows.sample(max_rows / total, seed=23)
        rows = rows.limit(max_rows) if drawn.isEmpty() else drawn

    def count(batches):
        for batch in batches:
            per_lang: dict[str, Counter] = {}
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                per_lang.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in per_lang.items():
                parts: Counter = Counter()
                for w, n in words.items():
                    for order in ORDERS:
                        for g in grams(w, order):
                            parts[g] += n
                yield pd.DataFrame(
                    {"kind": ["w"] * len(words) + ["g"] * len(parts), "key": [*words, *parts], "lang": lang, "n": [*words.values(), *parts.values()]}
                )

    counts = rows.mapInPandas(count, "kind string, key string, lang string, n long")
    per_key = counts.groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")).groupBy("kind", "key")
    per_key = per_key.agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")).where(F.col("total") >= least)
    index: tuple[dict[str, int], dict[str, int]] = ({}, {})
    counted: tuple[list, list] = ([], [])
    # A partition at a time, so that the driver keeps no rows but the numbers in them.
    for r in per_key.toLocalIterator():
        own, found = index["wg".index(r.kind)], counted["wg".index(r.kind)]
        found.extend((len(own), lang, n) for lang, n in r.by_lang.items())
        own[r.key] = len(own)
    languages = sorted({lang for found in counted for _, lang, _ in found})
    column = {lang: i for i, lang in enumerate(languages)}
    logs: list[np.ndarray] = []
    prior = 0
    for part, own in zip(counted, index, strict=True):
        table = np.zeros((len(own), len(languages)))
        for i, lang, n in part:
            table[i, column[lang]] = n
        if own is index[0] and own:
            prior = int(np.argmax(table.sum(axis=0)))
        logs.append(np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * max(1, len(own)))))
    for key in index[1]:
        index[1][key] += len(index[0])
    return LanguageModel(languages, index[0], index[1], np.concatenate(logs) if languages else np.zeros((0, 0)), prior)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (doc_id, text, ...) as (doc_id, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        cache: dict[str, list[int]] = {}
        for batch in batches:
            got = list(shared.value.predict(batch["text"].tolist(), cache))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(predict, f"doc_id {id_type}, lang_pred string, score double")
