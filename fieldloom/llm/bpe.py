"""BPE encoding and decoding by tree concatenation.

Where white space never lies inside a token of the tokenizer, text between white
space is encoded on its own and looked up in a bounded cache when seen before; the
tokenizer is probed for that (``independent_words``), and others encode whole texts
by the tree.  Long unsplit text is encoded by halves, recursively; at each join a
window around the cut is encoded again and grows until its tokens agree with the
left half on one side and with the right half on the other.  Documents longer
than ``PIECE`` characters become several rows first, so their pieces are encoded
by different tasks and joined in the same way afterwards.

Why agreement suffices: a sequence of BPE tokens is the encoding of its text when
every adjacent pair is.  Left half, window and right half are encodings, so a
token that two of them share (same id at the same place) joins them; runs of
``AGREE`` shared tokens are asked for, so that what precedes a pre-token (a
contraction, a special token, a combining mark) is settled too.

The tokenizer's file is a parameter; it is read on the driver and its content
sent to the executors.

Defined results
---------------
* null text is encoded as the empty text: no ids, empty decoded text.
* repeated rows each give a row; ids and other columns of the input never matter.
* strings of special tokens in a text become special tokens, as the library does.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PIECE, LEAF, WINDOW, AGREE, CACHE = 65_536, 4096, 64, 4, 50_000
#: Punctuation that neither begins a contraction nor belongs to a special token.
PLAIN = ".,;:!?#$%&*"
#: White space that Python's split() also cuts at, but that is left inside the chunks here.
OTHER_SPACE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile("[^ \t\n\r]+")


def load(content: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoded:
    """Ids of a text and the characters that each covers."""

    def __init__(self, ids, starts, ends):
        self.ids, self.starts, self.ends = (np.asarray(x, np.int64) for x in (ids, starts, ends))

    @classmethod
    def of(cls, tokenizer: Tokenizer, text: str, at: int = 0) -> Encoded:
        e = tokenizer.encode(text, add_special_tokens=False)
        offsets = np.asarray(e.offsets, np.int64).reshape(-1, 2) + at
        return cls(e.ids, offsets[:, 0], offsets[:, 1])

    def __getitem__(self, part: slice) -> Encoded:
        return Encoded(self.ids[part], self.starts[part], self.ends[part])

    def moved(self, by: int) -> Encoded:
        return Encoded(self.ids, self.starts + by, self.ends + by)

    def keys(self) -> list[tuple[int, int, int]]:
        return list(zip(self.starts.tolist(), self.ends.tolist(), self.ids.tolist(), strict=True))

    @staticmethod
    def chain(*parts: Encoded) -> Encoded:
        return Encoded(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("ids", "starts", "ends")))


def _shared_run(outer: list, window: list) -> list[tuple[int, int]]:
    """Index pairs (outer, window) at which AGREE consecutive tokens are the same."""
    at: dict = {}
    for i, k in enumerate(outer):
        at.setdefault(k, i)
    return [(i, j) for j in range(len(window) - AGREE + 1) if (i := at.get(window[j])) is not None and outer[i : i + AGREE] == window[j : j + AGREE]]


def join(tokenizer: Tokenizer, text: str, left: Encoded, right: Encoded, cut: int) -> Encoded:
    """The encoding of ``text`` from those of ``text[:cut]`` and ``text[cut:]`` (offsets in ``text``)."""
    size = WINDOW
    while True:
        lo, hi = max(0, cut - size), min(len(text), cut + size)
        window = Encoded.of(tokenizer, text[lo:hi], lo)
        if lo == 0 and hi == len(text):
            return window
        keys = window.keys()
        head, tail = Encoded([], [], []), Encoded([], [], [])
        begin, end = 0, len(keys)
        agreed = True
        if lo > 0:
            first = int(np.searchsorted(left.ends, lo, side="right"))
            runs = _shared_run(left[first:].keys(), [k for k in keys if k[1] <= cut])
            agreed = bool(runs)
            if runs:
                i, begin = runs[0]
                head = left[: first + i]
        if agreed and hi < len(text):
            skip = sum(k[0] < cut for k in keys)
            last = int(np.searchsorted(right.starts, hi))
            runs = _shared_run(right[:last].keys(), keys[skip:])
            agreed = bool(runs)
            if runs:
                i, j = runs[-1]
                end = skip + j
                tail = right[i:]
        if agreed and begin <= end:
            return Encoded.chain(head, window[begin:end], tail)
        size *= 2


def encode_tree(tokenizer: Tokenizer, text: str, leaf: int = LEAF) -> Encoded:
    """Encoding of a text by halves."""
    if len(text) <= leaf:
        return Encoded.of(tokenizer, text)
    cut = len(text) // 2
    return join(tokenizer, text, encode_tree(tokenizer, text[:cut], leaf), encode_tree(tokenizer, text[cut:], leaf).moved(cut), cut)


def join_pieces(tokenizer: Tokenizer, texts: list[str], parts: list[Encoded]) -> Encoded:
    """Encoding of the concatenated texts, joined pairwise up a tree; offsets of a part count from its own text."""
    while len(parts) > 1:
        pairs = list(range(0, len(parts) - 1, 2))
        joined = [join(tokenizer, texts[i] + texts[i + 1], parts[i], parts[i + 1].moved(len(texts[i])), len(texts[i])) for i in pairs]
        rest = len(parts) % 2
        texts = [texts[i] + texts[i + 1] for i in pairs] + texts[len(texts) - rest :]
        parts = joined + parts[len(parts) - rest :]
    return parts[0]


#: What a tokenizer is probed with.
PROBES = ("the", "Hello", "xqzzk", "UPPER", "Antidisestablishmentarianism", "zzzz", "a", "don't", "1234", "naïve", "\U0001f600", "<|endoftext|>", "abc.", "what?!", "end;", "x#", "ok,")


def independent_words(tokenizer: Tokenizer) -> bool:
    """Whether words between white space are encoded and decoded on their own, and letters apart from plain punctuation."""
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    decode = lambda ids: tokenizer.decode(ids, skip_special_tokens=False)
    for space in (" ", "\n", "\t ", "\r\n  "):
        ids = [encode(p) for p in PROBES]
        whole = [i for part in ids for i in part]
        if encode(space.join(PROBES) + space) != whole or decode(whole) != " ".join(map(decode, ids)):
            return False
    for word in filter(lambda p: p.isascii() and p.isalpha(), PROBES):
        stem = [t.id for t in tokenizer.model.tokenize(word.lower())]
        for tail in (".", "!?", ",;"):
            if encode(word) != stem or encode(word + tail) != stem + encode(tail) or decode(stem) != " ".join(t.value for t in tokenizer.model.tokenize(word.lower())):
                return False
    return True


class CachedEncoder:
    """Whole texts to (ids as little-endian 32-bit integers, decoded text).

    Two bounded caches: chunks as they stand between white space, and the stems of
    chunks that are ASCII letters followed by plain punctuation, which the
    pre-tokenizer separates in any case.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.words = independent_words(tokenizer)
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.parts: dict[str, tuple[bytes, str]] = {}

    def _stem(self, stem: str) -> tuple[bytes, str]:
        """A run of lower-case ASCII letters: one pre-token, whose bytes stand for themselves."""
        got = self.parts.get(stem)
        if got is None:
            tokens = self.tokenizer.model.tokenize(stem)
            got = self.parts[stem] = (np.array([t.id for t in tokens], "<u4").tobytes(), " ".join([t.value for t in tokens]))
        return got

    def _tail(self, tail: str) -> tuple[bytes, str]:
        got = self.parts.get(tail)
        if got is None:
            ids = self.tokenizer.encode(tail, add_special_tokens=False).ids
            got = self.parts[tail] = (np.array(ids, "<u4").tobytes(), self.tokenizer.decode(ids, skip_special_tokens=False))
        return got

    def _learn(self, chunks: set[str]) -> None:
        whole = []
        for c in chunks:
            stem = c.rstrip(PLAIN)
            if len(c) <= LEAF and stem.isascii() and stem.isalpha():
                i, t = self._stem(stem.lower())
                if len(stem) < len(c):
                    j, u = self._tail(c[len(stem) :])
                    i, t = i + j, f"{t} {u}"
                self.ids[c], self.text[c] = i, t
            else:
                whole.append(c)
        short = [c for c in whole if len(c) <= LEAF]
        long = [c for c in whole if len(c) > LEAF]
        ids = [e.ids for e in self.tokenizer.encode_batch(short, add_special_tokens=False)]
        ids += [encode_tree(self.tokenizer, c).ids.tolist() for c in long]
        decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        for c, i, d in zip(short + long, ids, decoded, strict=True):
            self.ids[c], self.text[c] = np.array(i, "<u4").tobytes(), d

    def __call__(self, texts: list[str]) -> list[tuple[bytes, str]]:
        if not self.words:
            ids = [encode_tree(self.tokenizer, t).ids.tolist() for t in texts]
            return [(np.array(i, "<u4").tobytes(), d) for i, d in zip(ids, self.tokenizer.decode_batch(ids, skip_special_tokens=False), strict=True)]
        split = [CHUNK.findall(t) if any(map(t.__contains__, OTHER_SPACE)) else t.split() for t in texts]
        chunks = set(chain.from_iterable(split))
        missing = chunks.difference(self.ids)
        if len(self.ids) + len(missing) > CACHE:
            self.ids.clear()
            self.text.clear()
            missing = chunks
        if len(self.parts) > 2 * CACHE:
            self.parts.clear()
        if missing:
            self._learn(missing)
        return [(b"".join(map(self.ids.__getitem__, c)), " ".join(filter(None, map(self.text.__getitem__, c)))) for c in split]


class Vocabulary:
    """A tokenizer file's content; each Python worker makes one encoder of it and keeps it for its later tasks."""

    def __init__(self, content: str):
        self.content, self.encoder = content, None

    def loaded(self) -> CachedEncoder:
        if self.encoder is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would each keep memory
            self.encoder = CachedEncoder(load(self.content))
        return self.encoder


OUT = "ids binary, decoded string"


def encode(docs: DataFrame, tokenizer_path: str, piece: int = PIECE) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(Vocabulary(f.read()))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches):
        encoder = content.value.loaded()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                got = encoder(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [g[0] for g in got], "decoded": [g[1] for g in got]})

    def pieces(batches):
        tokenizer = content.value.loaded().tokenizer
        for batch in batches:
            parts = [encode_tree(tokenizer, t) for t in batch["text"]]
            yield batch.assign(**{n: [getattr(p, n).astype("<u4").tobytes() for p in parts] for n in ("ids", "starts", "ends")})

    def joined(batch: pd.DataFrame) -> pd.DataFrame:
        tokenizer = content.value.loaded().tokenizer
        batch = batch.sort_values("pos")
        parts = [Encoded(*(np.frombuffer(x, "<u4") for x in row)) for row in zip(batch["ids"], batch["starts"], batch["ends"], strict=True)]
        e = join_pieces(tokenizer, batch["text"].tolist(), parts)
        return pd.DataFrame({"doc_id": batch["doc_id"].iloc[:1], "ids": [e.ids.astype("<u4").tobytes()], "decoded": [tokenizer.decode(e.ids.tolist(), skip_special_tokens=False)]})

    short = rows.where(F.length("text") <= piece).mapInPandas(whole, f"doc_id {id_type}, {OUT}")
    long = (
        rows.where(F.length("text") > piece)
        .withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "row", F.posexplode(F.expr(f"transform(sequence(0, cast((length(text) - 1) div {piece} as int)), i -> substring(text, i * {piece} + 1, {piece}))")).alias("pos", "text"))
        .repartition(F.col("row"), F.col("pos"))
        .mapInPandas(pieces, f"doc_id {id_type}, row long, pos int, text string, ids binary, starts binary, ends binary")
        .groupBy("row")
        .applyInPandas(joined, f"doc_id {id_type}, {OUT}")
    )
    return short.unionByName(long)
