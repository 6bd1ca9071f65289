"""Substring dedup by content-defined chunking with a gear rolling hash.

The UTF-8 bytes of each whole text run through a gear hash, whose value depends
on the last 32 bytes only; a chunk ends where the hash has a fixed pattern, so
an insertion moves no boundary farther on.  Chunks are at least ``LEAST`` and at
most ``MOST`` bytes long and known by a 128-bit digest.  A digest that occurs
twice or more is a repeat; its first place, by document and offset, is the one
to keep.  Neighbouring repeats of a document form a span, and spans of at least
``WORDS`` words are reported, so a chance repeat of one chunk is not.

Texts are chunked once: the chunks are shuffled by digest, a window counts the copies
and finds the first place, and only repeats go on, by document.  A digest that holds
more than a ``SHARE``-th of all chunks (a licence line that every document has) is dealt
over ``SALTS`` groups, whose counts and first places are then added up; at most ``SHARE``
digests can be so frequent, so their totals are broadcast.  Which digests are dealt is
estimated from a sample of the rows and changes no result.

Defined results
---------------
* null and empty texts have no chunks and are left as they are.
* offsets count code points; a chunk never ends inside a character.
* with ``across`` off, as in the registered query, repeats inside one document count as well.
* each row is a document of its own, also one without a ``doc_id`` or one that repeats another row.
  Rows are numbered as they are read, so ``docs`` must come in the same order each time, as files do.
* rows without a ``doc_id`` come after all others in the order of places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable

LEAST, MOST, BITS, WORDS = 12, 128, 4, 12
#: Share of all chunks from which a digest is dealt over groups, the number of groups, and the rows of which one is looked at for it.
SHARE, SALTS, EVERY = 2000, 64, 64
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of GEAR[byte i - j] << j for j < 32, by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks, in bytes; the last is the length."""
    n = len(data)
    if not n:
        return []
    starts_character = np.ones(n + 1, bool)
    starts_character[:n] = (data & 0xC0) != 0x80
    allowed = np.flatnonzero((gear(data) >> np.uint32(32 - BITS)) == 0) + 1
    allowed = allowed[starts_character[allowed]].tolist()
    out, last, i, m = [], 0, 0, len(allowed)
    while last < n:
        while i < m and allowed[i] < last + LEAST:
            i += 1
        limit = last + MOST
        if i < m and allowed[i] <= limit:
            end = allowed[i]
        else:
            end = min(limit, n)
            while not starts_character[end]:
                end += 1
        out.append(end)
        last = end
    return out


def chunks_of(text: str | None) -> tuple[bytes, list[int]]:
    raw = (text or "").encode("utf-8", "replace")
    return raw, boundaries(np.frombuffer(raw, np.uint8))


def digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def measured(text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(digests, character offsets of the boundaries, words begun in each chunk) of a whole text."""
    raw, ends = chunks_of(text)
    data = np.frombuffer(raw, np.uint8)
    cuts = np.array([0, *ends])
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begun = ~blank
    begun[1:] &= blank[:-1]
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])[cuts]
    return [digest(raw[s:e]) for s, e in zip([0, *ends], ends, strict=False)], total((data & 0xC0) != 0x80), np.diff(total(begun))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text) of the rows with a text; ``row`` numbers them as they are read."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").where(F.length("text") > 0)


def chunk_table(rows: DataFrame) -> DataFrame:
    """(doc_id, row, n, start, end, words, hi, lo): chunk number n of each of the :func:`numbered` rows.

    ``start`` and ``end`` count characters, ``words`` the words that begin in the
    chunk, ``hi`` and ``lo`` are the halves of its digest.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                got = [measured(t) for t in part["text"]]
                sizes = [len(g[0]) for g in got]
                halves = np.frombuffer(b"".join([d for g in got for d in g[0]]), np.int64).reshape(-1, 2)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].repeat(sizes).to_numpy(),
                        "row": np.repeat(part["row"].to_numpy(), sizes),
                        "n": np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]),
                        "start": np.concatenate([g[1][:-1] for g in got]).astype(np.int32),
                        "end": np.concatenate([g[1][1:] for g in got]).astype(np.int32),
                        "words": np.concatenate([g[2] for g in got]).astype(np.int32),
                        "hi": halves[:, 0],
                        "lo": halves[:, 1],
                    }
                )

    return rows.mapInPandas(cut, f"doc_id {id_type}, row long, n int, start int, `end` int, words int, hi long, lo long")


def place() -> Column:
    """The order of places: ids first, then nulls."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"), F.col("n").alias("n"))


def frequent(rows: DataFrame, share: int = SHARE, every: int = EVERY) -> DataFrame:
    """(hi, lo): digests that seem to hold more than a ``share``-th of all chunks, by one row of ``every``; at most ``share``."""
    counted = reliable(chunk_table(rows.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0)).groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1"))
    total = counted.agg(F.sum("seen")).first()[0] or 0
    return counted.where(F.col("seen") > max(1, total // share)).orderBy(F.desc("seen"), "hi", "lo").limit(share).select("hi", "lo")


def repeats(docs: DataFrame, across: bool = True, every: int = EVERY) -> DataFrame:
    """Every chunk whose digest occurs more than once, with its copies, the id of its first place, and whether it is that.

    ``across``: only chunks that two different rows hold, not those that one row alone repeats.
    """
    return repeats_of(numbered(docs), across, every)


def repeats_of(rows: DataFrame, across: bool = True, every: int = EVERY) -> DataFrame:
    """:func:`repeats` of rows that are numbered already."""
    digest_ = ["hi", "lo"]
    hot = reliable(frequent(rows, every=every).withColumn("hot", F.lit(True)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    dealt = chunk_table(rows).join(F.broadcast(hot), digest_, "left").withColumn("salt", salt).drop("hot")
    group = Window.partitionBy(*digest_, "salt")
    own = {"copies": F.count(F.lit(1)), "first": F.min(place()), "low": F.min("row"), "high": F.max("row")}
    found = dealt.select("*", *[v.over(group).alias(k) for k, v in own.items()]).where((F.col("copies") > 1) | F.col("salt").isNotNull())
    if not hot.isEmpty():
        found = reliable(found)
        parts = found.where(F.col("salt").isNotNull()).groupBy(*digest_, "salt").agg(*[F.first(k).alias(k) for k in own])
        whole = parts.groupBy(*digest_).agg(F.sum("copies").alias("copies"), F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"))
        totals = whole.select(*digest_, F.struct(*own).alias("total"))  # at most SHARE rows
        found = found.join(F.broadcast(totals), digest_, "left").withColumns({k: F.coalesce(F.col(f"total.{k}"), F.col(k)) for k in own})
    return found.where((F.col("copies") > 1) & ((F.col("low") < F.col("high")) | F.lit(not across))).select(
        "doc_id", "row", "n", "start", "end", "words", "copies", F.col("first.doc_id").alias("first_doc_id"), (place() == F.col("first")).alias("kept")
    )


def repeated_spans(docs: DataFrame, words: int = WORDS, across: bool = True) -> DataFrame:
    """(doc_id, row, start, end, words, copies, first_doc_id, kept): spans of neighbouring repeats.

    ``kept`` marks spans made of first places, ``copies`` is the smallest count among
    the chunks, ``first_doc_id`` the smallest id at which one of them is first.
    Windows and groups are those of one document each.
    """
    return spans_of(numbered(docs), words, across)


def spans_of(rows: DataFrame, words: int = WORDS, across: bool = True) -> DataFrame:
    """:func:`repeated_spans` of rows that are numbered already."""
    found = repeats_of(rows, across).repartition("row")
    order = Window.partitionBy("row", "doc_id", "kept").orderBy("n")
    return (
        found.withColumn("island", F.col("n") - F.row_number().over(order))
        .groupBy("row", "doc_id", "kept", "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("words").cast("int").alias("words"),
            F.min("copies").alias("copies"),
            F.min("first_doc_id").alias("first_doc_id"),
        )
        .where(F.col("words") >= words)
        .select("doc_id", "row", "start", "end", "words", "copies", "first_doc_id", "kept")
    )


def deduplicated(docs: DataFrame, words: int = WORDS, across: bool = True) -> DataFrame:
    """``docs`` with every repeated span but its first place cut out of the text."""
    # The input's columns travel in one struct, so none can clash with those that are made here.
    held = reliable(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    cuts = (
        spans_of(held.select("doc.doc_id", "row", "doc.text").where(F.length("text") > 0), words, across)
        .where(~F.col("kept"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    )
    shortened = F.expr(
        "array_join(zip_with(concat(array(0), cuts.end), concat(cuts.start, array(length(doc.text))), (a, b) -> substring(doc.text, a + 1, b - a)), '')"
    )
    text = F.when(F.size("cuts") > 0, shortened).otherwise(F.col("doc.text"))
    return held.join(cuts, "row", "left").select(*[text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
