"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max WAND.

Spark computes the statistics of the (comparatively few) benchmark items and the
impact of each word on each item, and builds the index in shards that are bounded
by their bytes.  Every document is cut into overlapping passages, long enough that
any item of the index lies whole in one of them, and every passage is a query.

A passage is searched in three steps, all of which keep every item that can reach
its threshold:

1. *Pivots.*  An item's words of least impact that add up to less than ``SLACK`` of
   its threshold can never decide alone: they are left out of the postings and
   counted in full.  Postings hold block maxima: per word and block of ``BLOCK``
   items the largest impact, as a share of the item's threshold.  The sum of the
   maxima of a passage's words bounds every item of the block; a block whose bound
   stays below 1 is skipped.
2. *Scores.*  The items of the blocks that are left are scored exactly.
3. *Verification.*  A retrieved item's question (all but the last sentence) and its
   answer (the last sentence) must both be found in the passage, by the share of
   their shingles of five words; a part of fewer words is one shingle.

Items are indexed by length class, so that a long one makes no long passages for the
others.  A shard's index is made by a task, goes through the shared checkpoint folder
and is broadcast alone; more items mean more passes over the documents.

Defined results
---------------
* null texts and texts without words match nothing; items without text or words
  are left out; items with the same words are each reported; an item of one word is
  found in every document that has the word.
* an item of one sentence is question and answer at once.
* a document and item are reported once, with the best passage's figures.
* ``threshold`` is the share of an item's BM25 score against itself that a
  passage must reach.
* only ``doc_id`` and ``text``, ``item_id`` and ``text`` are read.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reliable

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
K1, B, BLOCK, SHINGLE, SLACK = 1.2, 0.75, 4, 5, 0.4
THRESHOLD, OVERLAP = 0.5, 0.8
#: Bytes of benchmark text in a shard; the index of a shard takes some ten times that.
SHARD_BYTES = 8 << 20
#: The shortest length class, in words; each further class is twice as long.
SHORTEST_CLASS = 64
#: Cells times blocks that are bounded at a time.
AT_ONCE = 1 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def part_of(words: list[str]) -> tuple[int, set[tuple[str, ...]]]:
    """(words of a shingle, shingles) of an item's question or answer."""
    n = min(SHINGLE, len(words))
    return n, shingles(words, n)


def parts_of(text: str) -> tuple[tuple[int, set], tuple[int, set]]:
    """An item's question and answer; both are the whole item if it has one sentence."""
    words = words_of(text)
    sentences = [w for s in SENTENCE.split(text) if (w := words_of(s))]
    last = len(sentences[-1]) if sentences else 0
    if len(sentences) < 2 or sum(map(len, sentences)) != len(words):
        return part_of(words), part_of(words)
    return part_of(words[:-last]), part_of(words[-last:])


def impact(tf, df, length, n, mean):
    """BM25 weight of a word in an item."""
    return np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


@dataclass
class Index:
    """Inverted index of the items of one length class; words are known by the numbers of the shard's vocabulary."""

    stride: int
    ids: list = field(default_factory=list)
    questions: list = field(default_factory=list)
    answers: list = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)  # of each item, ascending
    impacts: list[np.ndarray] = field(default_factory=list)
    limits: list[float] = field(default_factory=list)  # score that a passage must reach
    starts: np.ndarray | None = None  # where each word's postings begin
    blocks: np.ndarray | None = None
    maxima: np.ndarray | None = None  # largest share of a limit that the word has in the block
    rest: np.ndarray | None = None  # per block, the largest share that words without postings add up to

    def finish(self, vocabulary: int) -> None:
        """Postings from the items."""
        most: dict[tuple[int, int], float] = defaultdict(float)
        self.rest = np.zeros(-(-len(self.ids) // BLOCK))
        for i, (terms, impacts, limit) in enumerate(zip(self.terms, self.impacts, self.limits, strict=True)):
            shares = impacts / max(limit, 1e-12)
            order = np.argsort(shares)
            light = np.searchsorted(np.cumsum(shares[order]), SLACK)
            self.rest[i // BLOCK] = max(self.rest[i // BLOCK], shares[order[:light]].sum())
            for t, s in zip(terms[order[light:]].tolist(), shares[order[light:]].tolist(), strict=True):
                most[t, i // BLOCK] = max(most[t, i // BLOCK], s)
        keys = sorted(most)
        self.starts = np.searchsorted([t for t, _ in keys], np.arange(vocabulary + 1))
        self.blocks = np.array([b for _, b in keys], np.int64)
        self.maxima = np.array([most[k] for k in keys])

    def pivots(self, terms: np.ndarray):
        """(first word of the passage, block) of the passages and blocks that step 1 keeps; ``terms``: a document's words."""
        n = len(self.rest)
        cells = max(1, -(-len(terms) // self.stride))
        step = max(1, AT_ONCE // n)
        for at in range(0, cells, step):
            inside = terms[at * self.stride : (at + step + 1) * self.stride]
            known = np.flatnonzero(inside >= 0)
            distinct = np.unique(known // self.stride * (len(self.starts) - 1) + inside[known])
            cell, term = np.divmod(distinct, len(self.starts) - 1)
            counts = self.starts[term + 1] - self.starts[term]
            places = np.repeat(self.starts[term] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            width = -(-len(inside) // self.stride)
            sums = np.bincount(np.repeat(cell, counts) * n + self.blocks[places], self.maxima[places], width * n).reshape(width, n)
            bound = (sums[:-1] + sums[1:] if width > 1 else sums) + self.rest
            for passage, block in np.argwhere(bound >= 1 - 1e-6):
                yield (at + int(passage)) * self.stride, int(block)

    def search(self, words: list[str], terms: np.ndarray):
        """(item, score, question overlap, answer overlap) of every passage's verified items."""
        begin, here, found = None, None, {}
        for s, block in self.pivots(terms):
            if s != begin:
                begin, found = s, {}
                here = np.unique(terms[s : s + 2 * self.stride])
            for item in range(block * BLOCK, min(len(self.ids), (block + 1) * BLOCK)):
                at = np.minimum(np.searchsorted(here, self.terms[item]), len(here) - 1)
                score = float(self.impacts[item][here[at] == self.terms[item]].sum())
                if score < self.limits[item] - 1e-9:
                    continue
                overlaps = []
                for n, wanted in (self.questions[item], self.answers[item]):
                    if n not in found:
                        found[n] = shingles(words[s : s + 2 * self.stride], n)
                    overlaps.append(len(wanted & found[n]) / len(wanted))
                if min(overlaps) >= OVERLAP:
                    yield self.ids[item], score, *overlaps


@dataclass
class Shard:
    """The indexes of a share of the items, one for each length class."""

    words: dict[str, int]
    indexes: list[Index]

    def dumped(self) -> bytes:
        """Plain data only, so that it can be read wherever this module is."""
        return pickle.dumps((self.words, [vars(i) for i in self.indexes]), pickle.HIGHEST_PROTOCOL)

    @classmethod
    def loaded(cls, blob: bytes) -> Shard:
        words, indexes = pickle.loads(blob)
        return cls(words, [Index(**i) for i in indexes])

    def search(self, text: str | None) -> dict:
        """item_id -> (score, question overlap, answer overlap), the best of a whole text."""
        out: dict = {}
        words = words_of(text)
        if words and self.indexes:
            terms = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
            for index in self.indexes:
                for item, *figures in index.search(words, terms):
                    out[item] = tuple(map(max, out[item], figures)) if item in out else tuple(figures)
        return out


def build_shard(items: list[tuple], rows: list[tuple], threshold: float = THRESHOLD) -> Shard:
    """The index of a shard: ``items`` are (item number, item_id, text), ``rows`` (item number, word, impact)."""
    of_item = defaultdict(list)
    for number, word, weight in rows:
        of_item[number].append((word, weight))
    words = {w: i for i, w in enumerate(sorted({w for _, w, _ in rows}))}
    by_class: dict[int, Index] = {}
    for number, item_id, text in sorted(items):
        if number not in of_item:
            continue
        stride = SHORTEST_CLASS
        while stride < len(words_of(text)):
            stride *= 2
        index = by_class.setdefault(stride, Index(stride))
        terms = sorted((words[w], float(x)) for w, x in of_item[number])
        index.ids.append(item_id)
        index.terms.append(np.array([t for t, _ in terms], np.int64))
        index.impacts.append(np.array([x for _, x in terms]))
        index.limits.append(threshold * sum(x for _, x in terms))
        question, answer = parts_of(text)
        index.questions.append(question)
        index.answers.append(answer)
    for index in by_class.values():
        index.finish(len(words))
    return Shard(words, [by_class[k] for k in sorted(by_class)])


def shards(benchmark: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, blob): the pickled index of each shard, in the checkpoint folder.  No step passes the driver."""
    numbered = reliable(
        benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text").distinct().withColumn("number", F.monotonically_increasing_id())
    )
    total = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    items = numbered.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(max(1, -(-total // shard_bytes)))).cast("int"))

    def count(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                rows = []
                for shard, number, text in zip(part["shard"], part["number"], part["text"], strict=True):
                    words = words_of(text)
                    rows += [(shard, number, w, n, len(words)) for w, n in Counter(words).items()]
                yield pd.DataFrame(rows, columns=["shard", "number", "word", "tf", "length"])

    tf = reliable(items.select("shard", "number", "text").mapInPandas(count, "shard int, number long, word string, tf long, length long"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n, mean = tf.groupBy("number").agg(F.first("length").alias("length")).agg(F.count(F.lit(1)), F.avg("length")).first()
    weight = lambda c: F.col(c).cast("double")
    scored = tf.join(df, "word").select("shard", "number", "word", impact_column(weight("tf"), weight("df"), weight("length"), n, mean or 1.0).alias("impact"))

    def build(own: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"shard": [], "blob": []})
        made = build_shard(list(own[["number", "item_id", "text"]].itertuples(index=False, name=None)), list(terms[["number", "word", "impact"]].itertuples(index=False, name=None)), threshold)
        return pd.DataFrame({"shard": own["shard"].iloc[:1], "blob": [made.dumped()]})

    return reliable(items.groupBy("shard").cogroup(scored.groupBy("shard")).applyInPandas(build, "shard int, blob binary"))


def impact_column(tf, df, length, n: int, mean: float):
    """:func:`impact` as a column."""
    return F.log1p((F.lit(float(n)) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + F.lit(K1) * (1 - B + B * length / F.lit(float(mean))))


class Shared:
    """A pickled shard; each Python worker unpickles it once."""

    def __init__(self, blob: bytes):
        self.blob, self.shard = blob, None

    def search(self, text: str | None) -> dict:
        if self.shard is None:
            self.shard = Shard.loaded(self.blob)
        return self.shard.search(text)

    def __getstate__(self):
        return self.blob

    def __setstate__(self, blob):
        self.blob, self.shard = blob, None


def broadcasts(built: DataFrame):
    """One shard after the other as a broadcast variable of bounded size."""
    for (shard,) in built.select("shard").orderBy("shard").collect():
        blob = built.where(F.col("shard") == shard).first()["blob"]
        yield built.sparkSession.sparkContext.broadcast(Shared(bytes(blob)))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document and item that leaks into it."""
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id string, score double, question_overlap double, answer_overlap double"
    built = shards(benchmark, threshold, shard_bytes)
    several = built.count() > 1
    out = docs.sparkSession.createDataFrame([], schema)
    for index in broadcasts(built):

        def search(batches, index=index):
            for batch in batches:
                rows = [(doc, item, *figures) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) for item, figures in index.value.search(text).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select("doc_id", "text").mapInPandas(search, schema)
        if several:  # what one shard finds is written before the next is broadcast
            part = reliable(part)
            index.unpersist()
        out = part if not several else out.unionByName(part)
    best = out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
    return best.withColumn("item_id", F.col("item_id").cast(item_type))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay and, with one shard, nothing is shuffled."""
    built = shards(benchmark, threshold, shard_bytes)
    if built.count() <= 1:
        for index in broadcasts(built):
            docs = docs.where(~_leaked(index)(F.col("text")))
        return docs
    held = reliable(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    gone = None
    for index in broadcasts(built):
        part = reliable(held.where(_leaked(index)(F.col("doc.text"))).select("row"))
        index.unpersist()
        gone = part if gone is None else gone.union(part)
    return held.join(gone.distinct(), "row", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def _leaked(index):
    @F.pandas_udf("boolean")
    def leaked(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(index.value.search(t)) for t in texts], dtype=bool)

    return leaked
