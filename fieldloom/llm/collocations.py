"""Phrases that hold together: counts by multikey three-way quicksort of suffix pointers.

Every place of a word in a piece of text is a suffix; its first ``LONGEST`` words decide all counts.  Tasks read whole
texts, number the words of some megabytes at a time and add up equal suffixes before anything is shuffled.  Suffixes
are routed by their two leading words, so all suffixes that begin alike meet in one group of bounded expected size,
where a multikey three-way quicksort of pointers parts them word by word: the size of a part equal so far is the count
of its leading words, and a part that is too small is abandoned, as no phrase in it can be frequent.  Frequent phrases
are then joined with the counts of their own parts and scored in exact decimals.

Pairs of words with more suffixes than a group should take are routed by all three words, and what is counted for the
pair travels apart; which pairs those are is estimated from one row in ``SAMPLE`` (at most ``MOST_HOT`` pairs, the
commonest) and changes no result.  Single words travel as counts of a task, never as suffixes.

Defined results
---------------
* a null text has no words; a null ``lang`` is ``und``; empty texts, empty tables and languages without candidates give
  no row.  Repeated rows each count.  Very long texts are numbered piece by piece.
* equal scores are ordered by count, then by the bytes of the phrase, so ranks are total.
* other columns are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint_folder, reliable, remove

LONGEST = 3
#: Suffixes that a group should take, bytes of text that a task numbers at a time, suffixes that make a pair hot.
GROUP, BLOCK, HOT = 1_000_000, 8 << 20, 500_000
SAMPLE, MOST_HOT = 64, 50_000
WORD_BYTES = 6  # of text for each word, about: sets the number of groups only
MERGE = 64  # parts of a language that are ranked before they are ranked together

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
SUFFIX, HOT_SUFFIX, WORD = 0, 1, 2  # what a routed row stands for
BLOBS = "route int, lang string, words binary, rows binary"
PHRASES = "lang string, w1 string, w2 string, w3 string, f long"


# -- words of texts as numbers --------------------------------------------------------------------------------------


def pieces_of(buffer: bytes, most: int) -> Iterator[bytes]:
    """``buffer`` in parts of about ``most`` bytes, cut where a piece ends (a longer piece stays whole)."""
    start = 0
    while len(buffer) - start > most:
        cut = max(buffer.rfind(c, start, start + most) for c in (b"\n", b".", b","))
        if cut < start:
            following = [at for at in (buffer.find(c, start + most) for c in (b"\n", b".", b",")) if at >= 0]
            if not following:
                break
            cut = min(following)
        yield buffer[start:cut]
        start = cut + 1
    yield buffer[start:]


def numbered(buffer: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, first, second and third word of every suffix as numbers from 1; 0 beyond the end of its piece)."""
    a = np.frombuffer(buffer.lower(), np.uint8)  # lower() of bytes changes A-Z only
    kind = _KIND[a]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])]).dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    first = np.asarray(words.indices).astype(np.int32) + 1

    def later(k: int) -> np.ndarray:
        out = np.zeros(len(first), np.int32)
        if len(first) > k:
            out[:-k] = np.where(piece[:-k] == piece[k:], first[k:], 0)
        return out

    return words.dictionary, first, later(1), later(2)


def _distinct(first: np.ndarray, second: np.ndarray, third: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes and how often each occurs."""
    bits = max(1, int(words).bit_length())
    if 3 * bits > 63:
        rows, n = np.unique(np.stack([first, second, third], axis=1), axis=0, return_counts=True)
        return rows[:, 0], rows[:, 1], rows[:, 2], n
    key = np.sort((first.astype(np.int64) << (2 * bits)) | (second.astype(np.int64) << bits) | third)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, n, low = key[new], np.diff(np.concatenate([new, [len(key)]])), (1 << bits) - 1
    return (key >> (2 * bits)).astype(np.int32), ((key >> bits) & low).astype(np.int32), (key & low).astype(np.int32), n


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, the same in every task; entry 0 is that of no word."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    out = np.zeros(len(words) + 1, np.uint64)
    if len(words):
        lengths = np.diff(offsets)
        letters = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
        starts = offsets[:-1] - offsets[0]
        powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        out[1:] = np.add.reduceat(letters * powers[np.arange(len(letters)) - np.repeat(starts, lengths)], starts)
    return out


def _routes(groups: int, *hashes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(hashes[0]), np.uint64)
    for x in hashes:
        h = (h ^ (x + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(groups)).astype(np.int32)


def _is_hot(words: pa.Array, hashes: np.ndarray, first: np.ndarray, second: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether the pair of a suffix is routed apart: told by a hash, as that changes the route only and alike for all."""
    pair = hashes[first] * np.uint64(0xD6E8FEB86659FD93) + hashes[second]
    at = np.searchsorted(hot, pair)
    return (hot[np.minimum(at, len(hot) - 1)] == pair) if len(hot) else np.zeros(len(pair), bool)


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def _blobs(lang: str, buffer: bytes, groups: int, hot: np.ndarray, block: int) -> Iterator[tuple]:
    """Rows of :data:`BLOBS` of a language's texts: the counted suffixes of each route with the words they use."""
    own = np.uint64(zlib.crc32(lang.encode()))
    for part in pieces_of(buffer, block):
        words, first, second, third = numbered(part)
        if not len(first):
            continue
        hashes = _word_hashes(words)
        counts = np.bincount(first, minlength=len(words) + 1)[1:]
        a, b, c, n = _distinct(first, second, third, len(words))
        a, b, c, n = (x[b > 0] for x in (a, b, c, n))
        apart = _is_hot(words, hashes + own, a, b, hot)
        none = np.zeros(len(words), np.int32)
        every = np.arange(1, len(words) + 1, dtype=np.int32)
        pa_, pb, _, pn = _distinct(np.repeat(a[apart], n[apart]), np.repeat(b[apart], n[apart]), np.zeros(int(n[apart].sum()), np.int32), len(words))
        three = apart & (c > 0)
        kinds = [(SUFFIX, a[~apart], b[~apart], c[~apart], n[~apart]), (SUFFIX, pa_, pb, np.zeros_like(pa_), pn), (HOT_SUFFIX, a[three], b[three], c[three], n[three]), (WORD, every, none, none, counts)]
        table = np.concatenate([np.stack([np.full(len(k[1]), k[0]), *k[1:]], axis=1).astype(np.int32) for k in kinds])
        third_hash = np.where(table[:, 0] == HOT_SUFFIX, hashes[table[:, 3]], np.uint64(0))
        route = _routes(groups, np.full(len(table), own), hashes[table[:, 1]], hashes[table[:, 2]], third_hash)
        order = np.argsort(route, kind="stable")
        table, route = table[order], route[order]
        edges = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1], [True]]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows = table[lo:hi]
            used, codes = np.unique(rows[:, 1:4], return_inverse=True)
            codes = codes.reshape(-1, 3) + (0 if used[0] == 0 else 1)
            spelled = words.take(pa.array(used[used > 0] - 1)).to_pylist()
            packed = np.concatenate([rows[:, :1], codes, rows[:, 4:]], axis=1).astype(np.int32)
            yield int(route[lo]), lang, _packed(b"\n".join(spelled)), _packed(np.ascontiguousarray(packed.T).tobytes())


def _batches_of(texts, most: int) -> Iterator[dict[str, bytes]]:
    """Texts by language, some megabytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in texts:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            held.setdefault(lang, []).append(raw)
            size += len(raw) + 1
            if size >= most:
                yield {k: b"\n".join(v) for k, v in held.items()}
                held, size = {}, 0
    yield {k: b"\n".join(v) for k, v in held.items()}


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.encode("text", "UTF-8").alias("text"))


def hot_pairs(docs: DataFrame, limit: int = HOT, sample: int = SAMPLE) -> np.ndarray:
    """Hashes of the pairs of words estimated to begin more than ``limit`` suffixes, at most ``MOST_HOT`` of them."""

    def pairs(batches):
        for texts in _batches_of(batches, BLOCK):
            for lang, buffer in texts.items():
                for part in pieces_of(buffer, BLOCK):
                    words, first, second, _ = numbered(part)
                    hashes = _word_hashes(words) + np.uint64(zlib.crc32(lang.encode()))
                    pair = hashes[first[second > 0]] * np.uint64(0xD6E8FEB86659FD93) + hashes[second[second > 0]]
                    found, n = np.unique(pair, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["pair", "n"])

    counted = _texts(docs.sample(1 / sample, seed=17)).mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") * sample > limit).orderBy(F.desc("n"), "pair").limit(MOST_HOT).select("pair").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


# -- the sort ---------------------------------------------------------------------------------------------------------


def multikey_parts(symbols: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, pointers, weights): a pointer into each part that is equal in its first ``depth`` symbols, with its weight.

    Multikey three-way quicksort of pointers, all open parts a step at a time: a part's pivot is the symbol of its middle
    pointer at the part's depth; smaller and larger symbols stay at that depth, equal ones go one deeper.  Parts that
    weigh under ``least`` are abandoned; ``symbols`` is (depth, suffix), the symbol 0 at a depth ends a suffix.
    """
    deepest, n = symbols.shape
    pointers, sizes, depths = np.arange(n, dtype=np.int32), np.array([n]), np.array([0])
    flat = symbols.reshape(-1)
    place = np.int32 if symbols.size < 2**31 else np.int64
    while len(pointers):
        starts = np.cumsum(sizes) - sizes
        heavy = np.add.reduceat(weights[pointers], starts) >= least
        if not heavy.all():
            pointers, sizes, depths = pointers[np.repeat(heavy, sizes)], sizes[heavy], depths[heavy]
            if not len(pointers):
                return
            starts = np.cumsum(sizes) - sizes
        at = flat[np.repeat((depths * n).astype(place), sizes) + pointers]
        trio = np.sort(np.stack([at[starts], at[starts + sizes // 2], at[starts + sizes - 1]]), axis=0)
        pivot = np.repeat(trio[1], sizes)
        side = (at >= pivot).astype(np.int8) + (at > pivot)
        part = np.repeat(np.arange(0, 3 * len(sizes), 3, dtype=np.int32), sizes) + side
        split = np.bincount(part, minlength=3 * len(sizes))
        target = np.cumsum(split) - split
        moved = np.empty_like(pointers)
        for s in range(3):
            own = np.flatnonzero(side == s)
            counts = split[s::3]
            moved[np.arange(len(own)) + np.repeat(target[s::3] - (np.cumsum(counts) - counts), counts)] = pointers[own]
        equal = np.zeros(len(split), bool)
        equal[1::3] = True
        deeper = np.repeat(depths, 3) + equal
        there = split > 0
        # An equal part is counted, and goes on unless its suffixes end here or have no further symbol.
        ends = equal & (np.repeat(trio[1], 3) == 0)
        totals = np.zeros(len(split), np.int64)
        totals[there] = np.add.reduceat(weights[moved], target[there])
        for depth in np.unique(deeper[equal]):
            done = np.flatnonzero(equal & ~ends & (deeper == depth) & (totals >= least))
            if len(done):
                yield int(depth), moved[target[done]], totals[done]
        keep = there & (totals >= least) & ~ends & (deeper < deepest)
        pointers, sizes, depths = moved[np.repeat(keep, split)], split[keep], deeper[keep]


def _counted(least: int):
    """Frequent words and phrases of one route's blobs, and the number of its words."""

    def count(group: pa.Table) -> pa.Table:
        lang_of, tables, spelled = {}, [], []
        base = 0
        for lang, words, rows in zip(group.column("lang").to_pylist(), group.column("words"), group.column("rows"), strict=True):
            own = pa.array(_unpacked(words.as_py()).split(b"\n"), pa.large_binary())
            t = np.frombuffer(_unpacked(rows.as_py()), np.int32).reshape(5, -1).copy()
            t[1:4] += np.where(t[1:4] > 0, np.int32(base), np.int32(0))
            t[0] += lang_of.setdefault(lang, len(lang_of) * 3 + 1)
            base += len(own)
            spelled.append(own)
            tables.append(t)
        symbols = np.concatenate(tables, axis=1)
        del tables
        weights = symbols[4].astype(np.int64)
        symbols = symbols[:4]
        encoded = pa.chunked_array(spelled, pa.large_binary()).combine_chunks().dictionary_encode()
        del spelled
        number = np.concatenate([[0], np.asarray(encoded.indices) + 1]).astype(np.int32)
        for d in (1, 2, 3):
            symbols[d] = number[symbols[d]]
        names = encoded.dictionary.cast(pa.large_string())
        back = list(lang_of)
        out: list[list] = [[], [], [], [], []]

        def add(columns):
            for held, c in zip(out, columns, strict=True):
                held.extend(c)

        kind = (symbols[0] - 1) % 3
        for i, lang in enumerate(back):
            n = int(weights[symbols[0] == i * 3 + 1 + WORD].sum())
            if n:
                add(([lang], [None], [None], [None], [n]))
        for depth, at, n in multikey_parts(symbols, weights, least):
            counted = {WORD: (2,), SUFFIX: (3, 4), HOT_SUFFIX: (4,)}
            fits = np.isin(kind[at], [k for k, d in counted.items() if depth in d])
            at, n = at[fits], n[fits]
            name = lambda d: names.take(pa.array(symbols[d, at] - 1)).to_pylist() if depth > d else [None] * len(at)  # noqa: E731, B023
            add(([back[(s - 1) // 3] for s in symbols[0, at]], name(1), name(2), name(3), n.tolist()))
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(),) * 4 + (pa.int64(),), strict=True)], ["lang", "w1", "w2", "w3", "f"])

    return count


def frequent_phrases(docs: DataFrame, least: int = 10, group: int = GROUP, block: int = BLOCK, limit: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """(lang, w1, w2, w3, f): words, pairs and triples that occur ``least`` times; without words, the number of all words (in parts)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(-(-size // (WORD_BYTES * group)), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = hot_pairs(docs, limit, sample) if size // WORD_BYTES > limit else np.zeros(0, np.uint64)

    def blobs(batches):
        for texts in _batches_of(batches, block):
            rows = (row for lang, buffer in texts.items() for row in _blobs(lang, buffer, groups, hot, block))
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["route", "lang", "words", "rows"])

    return _texts(docs).mapInArrow(blobs, BLOBS).groupBy("route").applyInArrow(_counted(least), PHRASES)


# -- scores -------------------------------------------------------------------------------------------------------------


def scored(counts: DataFrame, kept_percent: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one takes in; ``counts`` is read several times."""
    joined = lambda *c: F.concat_ws(" ", *c)
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), joined(*left).alias("left"), joined(*right).alias("right"))
    named = counts.where("w1 is not null").select("lang", joined("w1", "w2", "w3").alias("phrase"), "f", "w1", "w2", "w3")
    pairs = named.where("w2 is not null and w3 is null").withColumn("cuts", F.array(cut(1, ["w1"], ["w2"])))
    triples = named.where("w3 is not null").withColumn("cuts", F.array(cut(1, ["w1"], ["w2", "w3"]), cut(2, ["w1", "w2"], ["w3"])))
    inside = (
        triples.select("lang", F.explode(F.array(joined("w1", "w2"), joined("w2", "w3"))).alias("phrase"), F.col("f").alias("longer"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    left_over = pairs.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < kept_percent * F.col("f"), F.lit(True))).drop("longer")
    part = named.select("lang", F.col("phrase").alias("part"), F.col("f").alias("n_part"))
    cuts = left_over.unionByName(triples).select("lang", "phrase", F.col("f").alias("a"), F.explode("cuts").alias("cut")).select("lang", "phrase", "a", "cut.*")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.withColumnsRenamed({"part": side, "n_part": name}), ["lang", side])
    # At most 10**6, as neither part is rarer than the phrase; its parts need more than a long.
    score = F.expr("(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("m")
    return cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def best(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best phrases of each language with their ``rank``: parts of a language first, so no task ranks all of them."""

    def ranked(df: DataFrame, *by: Column | str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(MERGE)))
    return ranked(ranked(parts, "lang", "part").drop("part", "rank"), "lang")


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/collocations-{uuid.uuid4().hex}"
    try:
        frequent_phrases(docs, least, **sizes).write.parquet(folder)
        counts = spark.read.schema(PHRASES).parquet(folder)
        words = counts.where("w1 is null").groupBy("lang").agg(F.sum("f").alias("n"))
        # No more rows than languages times ``most``: kept apart, so what they come from can go.
        return reliable(best(scored(counts), most).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    finally:
        remove(spark, folder)
