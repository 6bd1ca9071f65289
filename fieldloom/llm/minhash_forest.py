"""Near-duplicate documents by a MinHash LSH forest.

1. A document's set is its distinct five-word shingles, known by 64-bit hashes.
   Documents with the same set form a class; from here on a class counts once.
2. Each class has ``TREES`` sequences of ``DEPTH`` min-hashes.  Sorting all
   classes by a sequence is one tree of the forest, kept as a range-partitioned
   sort, so that a dense region spreads over as many tasks as it needs.
3. Candidates are neighbours by longest common prefix: along each sorted order a
   class meets the ``WINDOW`` classes on either side with which it shares a
   prefix, and keeps the ``PARTNERS`` whose whole signatures agree best.  The
   depth of a meeting adapts to its region: where a short prefix is rare it is
   enough, in a dense region only classes with a long common prefix are near.
4. Beside the neighbours, each region, at a shallow and at a deeper prefix, has a
   leader: the class whose prefixes are the most shared over all trees, which in
   a family of edited copies is the text closest to the common original.  All
   classes of the region meet the leader, so the links of a family of any size
   are tried in a star and never pairwise.
5. A candidate whose signatures agree far less than the threshold is dropped
   (``SLACK`` below it, about 3.5 standard errors); all others are confirmed on
   full shingle sets.
6. Links become components by alternating star contractions; each round is a few
   grouped aggregates and joins, and its result goes to the checkpoint folder.
7. Partners and the window leave links between dense families out.  So in each
   region at the deeper prefix all classes of different components are compared,
   however many there are: by signatures first, with ``CERTAIN`` standard errors to
   spare, and those that are left on full shingle sets.  A region is dealt into
   tiles, and the tiles of its largest component meet those of the others only, so
   a task holds two tiles whatever the size of the region.

Signatures are probabilistic: a true link between two components is missed only if
the pair shares the deeper prefix in no tree, and is no neighbour and no leader's
link: for a pair just at the threshold t that has probability (1 - t^3)^16, 3e-7 at
0.85 and 1e-5 at 0.80.  The tests measure the recall against brute force.

Regions, texts and roots that hold more than a fixed share of the rows are joined
apart from the others (``spread_join``).

Defined results
---------------
* words are runs of anything but ASCII white space, A-Z lower-cased; fewer than
  five words form one shingle; null texts and texts without words have an empty
  set and are linked with nothing.
* ``component_id`` is the smallest ``doc_id`` reachable.  A row without a
  ``doc_id`` takes no part: its ``component_id`` is null and it is kept.
* repeated rows are in one component; rows that repeat the smallest id are kept.
* ``doc_id`` may have any type that has an order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import hot_keys, reliable, spread_join, with_hot_keys

SHINGLE, TREES, DEPTH = 5, 16, 8
#: Prefix lengths whose regions get a leader.
DEPTHS = (1, 3)
WINDOW, PARTNERS, SLACK = 24, 3, 0.11
#: Standard errors below the threshold at which two components still go on to full sets.
CERTAIN = 6
#: Classes and shingles of a tile.
TILE, TILE_SHINGLES = 8192, 2_000_000
LANES = TREES * DEPTH
_DRAW = np.random.default_rng(20240301)
_A = _DRAW.integers(1, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 2**63, LANES, dtype=np.uint64)
_POWERS = _DRAW.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower changes A-Z only and bytes.split cuts at 0x20 and 0x09-0x0D, just as asked."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    if len(words) < SHINGLE:
        total = np.uint64(len(words))
        for x, p in zip(h, _POWERS, strict=False):
            total = total * np.uint64(0x9E3779B97F4A7C15) + x * p
        return _mixed(np.array([total], np.uint64))
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i, p in enumerate(_POWERS):
        total = _mixed(total + h[i : i + n] * p)
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """LANES min-hashes of 32 bits."""
    out = np.empty(LANES, np.uint32)
    for at in range(0, LANES, 16):
        part = slice(at, at + 16)
        least = None
        for s in range(0, len(shingles), 4096):
            got = ((shingles[s : s + 4096, None] * _A[None, part] + _B[None, part]) >> np.uint64(32)).min(axis=0)
            least = got if least is None else np.minimum(least, got)
        out[part] = least
    return out


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, signature) of every row; the last two null for empty sets."""
    id_type = docs.schema["doc_id"].dataType

    def measure(batches):
        old = np.seterr(over="ignore")
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            signatures = [signature(s) if len(s) else None for s in sets]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "text_hash": batch["text_hash"],
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "signature": [s if s is None else s.astype(">u4").tobytes() for s in signatures],
                }
            )
        np.seterr(**old)

    # Ids cross as text: a batch with a null among numbers would turn them into floating-point ones.
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInPandas(
        measure, "doc_id string, text_hash long, n_shingles long, set_key binary, signature binary"
    ).withColumn("doc_id", F.col("doc_id").cast(id_type))


def sketches_of(signature: str) -> Column:
    """The lowest byte of each min-hash of a signature: enough to estimate how far two classes agree.  It is read off once a class, so rows do not carry it."""
    return F.unhex(F.regexp_replace(F.hex(signature), "(?:.{6})(.{2})", "$1")).alias("sketch")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def prefix(tree: int | str, depth: int):
    """The number of the region of a class's ``depth`` first min-hashes in a tree."""
    return F.xxhash64(F.lit(depth), F.lit(tree) if isinstance(tree, int) else F.col(tree), F.expr(f"substring(signature, {tree} * {DEPTH * 4} + 1, {depth * 4})"))


def regions(classes: DataFrame, many: bool) -> tuple[DataFrame, list]:
    """(cls, tree, depth, region, size): the regions of two or more classes, at a shallow and a deeper prefix; the hot ones."""
    rows = (
        classes.select("cls", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        .select("cls", "tree", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix("tree", d).alias("region")) for d in DEPTHS])).alias("r"))
        .select("cls", "tree", "r.depth", "r.region")
    )
    sizes, hot = with_hot_keys(rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "region", "size", many)
    return reliable(spread_join(rows, sizes, "region", hot)), hot


def neighbours(classes: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """(a, b): candidates from the sorted orders.  ``classes`` has (cls, signature, sketch).

    Only classes that share their first min-hash in a tree are sorted there: the
    others have no neighbour with a common prefix.  The sort is by tree and
    sequence over ranges; at the edge of a range the last and first ``WINDOW``
    rows are handed on and compared afterwards.
    """
    spark = classes.sparkSession
    low = threshold - SLACK
    rows = placed.where(F.col("depth") == DEPTHS[0]).select("cls", "tree").join(classes, "cls").select(
        "tree", "cls", F.expr(f"substring(signature, tree * {DEPTH * 4} + 1, {DEPTH * 4})").alias("path"), "sketch"
    )
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = rows.repartitionByRange(parts, "tree", "path", "cls").sortWithinPartitions("tree", "path", "cls")

    def compare(frame: pd.DataFrame, fresh: int) -> list[tuple]:
        """Candidate pairs whose later row is at or after position ``fresh``."""
        if len(frame) < 2:
            return []
        sketches = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), LANES)
        tree, cls = frame["tree"].to_numpy(), frame["cls"].to_numpy()
        head = np.frombuffer(b"".join(p[:4] for p in frame["path"]), ">u4")
        i_all, j_all, s_all = [], [], []
        for step in range(1, min(WINDOW, len(frame) - 1) + 1):
            i = np.flatnonzero((tree[step:] == tree[:-step]) & (head[step:] == head[:-step]) & (np.arange(step, len(frame)) >= fresh))
            if not len(i):
                break
            s = _agreement(sketches[i], sketches[i + step])
            fine = s >= low
            i_all.append(i[fine])
            j_all.append(i[fine] + step)
            s_all.append(s[fine])
        if not i_all:
            return []
        i, j, s = (np.concatenate(x) for x in (i_all, j_all, s_all))
        # The best partners of either side.
        best: set[int] = set()
        for own in (i, j):
            order = np.lexsort((-s, own))
            groups = own[order]
            place = np.arange(len(order)) - np.searchsorted(groups, groups)
            best.update(order[place < PARTNERS].tolist())
        picked = sorted(best)
        return list(zip(cls[i[picked]].tolist(), cls[j[picked]].tolist(), strict=True))

    def walk(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kept, seen = None, 0
        edges: list[pd.DataFrame] = []
        for batch in batches:
            for at in range(0, len(batch), 4096):
                block = batch.iloc[at : at + 4096]
                if seen < WINDOW:
                    edges.append(block.iloc[: WINDOW - seen].assign(edge=np.arange(seen, min(WINDOW, seen + len(block)))))
                frame = block if kept is None else pd.concat([kept, block], ignore_index=True)
                pairs = compare(frame, 0 if kept is None else len(kept))
                seen += len(block)
                kept = frame.iloc[-WINDOW:].reset_index(drop=True)
                yield _pairs(pairs)
        if kept is not None and seen > WINDOW:
            edges.append(kept.assign(edge=np.arange(WINDOW, WINDOW + len(kept))))
        for e in edges:
            yield pd.DataFrame({"a": e["cls"], "b": e["cls"], "part": part, "edge": e["edge"].astype("int32"), "tree": e["tree"], "path": e["path"], "sketch": e["sketch"]})[_COLUMNS]

    found = reliable(ranged.select("tree", "cls", "path", "sketch").mapInPandas(walk, "a long, b long, part int, edge int, tree int, path binary, sketch binary"))
    # Edges: the last rows of a range and the first of the next are compared under the number of the border between them.
    border = found.where(F.col("part").isNotNull()).select(
        F.explode(F.array("part", F.col("part") + 1)).alias("border"), "part", F.col("a").alias("cls"), "tree", "path", "sketch"
    )

    def across(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["part", "tree", "path", "cls"]).sort_values(["part", "tree", "path", "cls"], ignore_index=True)
        before = int((group["part"] < group["border"].iloc[0]).sum())
        group = pd.concat([group.iloc[max(0, before - WINDOW) : before], group.iloc[before : before + WINDOW]], ignore_index=True)
        return pd.DataFrame(compare(group, min(before, WINDOW)), columns=["a", "b"], dtype="int64")

    return found.where(F.col("part").isNull()).select("a", "b").unionByName(border.groupBy("border").applyInPandas(across, "a long, b long"))


_COLUMNS = ["a", "b", "part", "edge", "tree", "path", "sketch"]


def _pairs(pairs: list[tuple]) -> pd.DataFrame:
    n = len(pairs)
    none = pd.array([None] * n, dtype="Int32")
    return pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs], "part": none, "edge": none, "tree": none, "path": [None] * n, "sketch": [None] * n})[_COLUMNS]


def leaders(placed: DataFrame, hot: list) -> DataFrame:
    """(a, b): each class with the leaders of its regions."""
    # How much of its forest a class shares: large for the text that a family descends from.
    central = placed.groupBy("cls").agg(F.sum(F.log2("size")).alias("central"))
    scored = placed.join(central, "cls")
    led = scored.groupBy("region").agg(F.max(F.struct(F.round("central", 6).alias("central"), (-F.col("cls")).alias("order"))).alias("best")).select("region", (-F.col("best.order")).alias("leader"))
    return spread_join(placed, led, "region", hot).where(F.col("cls") != F.col("leader")).select(F.col("cls").alias("a"), F.col("leader").alias("b"))


def texts_of(docs: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """(cls, text) of the ``needed`` classes.  They are picked before they meet the documents, so that texts are shuffled once."""
    of = classes.join(needed, "cls", "left_semi").select("cls", "doc_id", "text_hash")
    return docs.withColumn("text_hash", F.xxhash64("text")).join(of, ["doc_id", "text_hash"]).select("cls", "text")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, inter: int, union: int, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` with ``inter`` * intersection >= ``union`` * union on full shingle sets."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda n: classes.select(F.col("cls").alias(n), F.col("sketch").alias(f"s_{n}"), F.col("n_shingles").alias(f"n_{n}"))
    # Sets whose sizes alone rule the threshold out need no look at their members.
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(inter * F.least("n_a", "n_b") >= union * F.greatest("n_a", "n_b"))
    low = threshold - SLACK

    def likely(batches):
        for b in batches:
            if len(b):
                s = _agreement(*(np.frombuffer(b"".join(b[c]), np.uint8).reshape(len(b), LANES) for c in ("s_a", "s_b")))
                yield b.loc[s >= low, ["a", "b"]]

    near = reliable(sized.select("a", "b", "s_a", "s_b").mapInPandas(likely, "a long, b long"))
    needed = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    own = texts_of(docs, classes, needed)

    def check(batches):
        old = np.seterr(over="ignore")
        for batch in batches:
            known: dict[str, np.ndarray] = {}
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                s, t = (known[v] if v in known else known.setdefault(v, shingle_set(v)) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(inter * both >= union * (len(s) + len(t) - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]
        np.seterr(**old)

    return (
        near.join(own.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a")
        .join(own.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInPandas(check, "a long, b long")
    )


def components(links: DataFrame, many: bool = True) -> DataFrame:
    """(cls, root): the smallest class reachable, for every class that has a link.

    Alternating stars: every node hands its larger neighbours to the smallest one
    (large star), then its smaller ones likewise (small star), until the links are
    stars around the smallest nodes.  Edges never outnumber those at the start, and
    the sums per node are partial aggregates, so a hot node is no hot task.
    """
    edges = reliable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        least, hot = with_hot_keys(least, "u", possible=many)
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # the second of an edge is the smaller one
        large = spread_join(larger, least.drop("n"), "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Every node of a large star has smaller neighbours only, and few of them: the smallest of each star it was in.
        large = large.repartition("u").distinct().withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = large.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = reliable(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("root"))
        state = now


def runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each key at a time; they come sorted by it."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        keys = batch[key].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if kept and kept[0][key].iat[0] != keys[s]:
                yield kept[0] if len(kept) == 1 else pd.concat(kept, ignore_index=True)
                kept = []
            kept.append(batch.iloc[s:e])
    if kept:
        yield kept[0] if len(kept) == 1 else pd.concat(kept, ignore_index=True)


def disputed(root: np.ndarray, side: np.ndarray, tree: int, sketches: np.ndarray, deep: np.ndarray, sizes: np.ndarray, inter: int, union: int) -> np.ndarray:
    """Which classes of a meeting may be linked with another component there, by sizes and signatures.

    Where there are two sides, classes of the one meet those of the other.  A pair that
    shares the region of an earlier tree (``deep``: one of each tree) is left to that tree.
    """
    threshold = union / inter
    low = threshold - CERTAIN * np.sqrt(threshold * (1 - threshold) / LANES)
    earlier = deep[:, :tree]
    found = np.zeros(len(root), bool)
    # The largest component needs no walk of its own: the others meet it.
    _, part, counts = np.unique(root, return_inverse=True, return_counts=True)
    two = bool((side == 1).any())
    left = side == 1 if two else np.ones(len(root), bool)  # whom a class still has to meet
    for i in np.flatnonzero(side == 0 if two else part != np.argmax(counts)):
        if not two:
            left[i] = False
        j = np.flatnonzero((part != part[i]) & left & (inter * np.minimum(sizes, sizes[i]) >= union * np.maximum(sizes, sizes[i])))
        j = j[_agreement(sketches[j], sketches[i]) >= low]
        j = j[~(earlier[j] == earlier[i]).any(axis=-1)]
        if len(j):
            found[i] = True
            found[j] = True
    return found


def joined(root: np.ndarray, sets: list[np.ndarray], inter: int, union: int) -> list[tuple[int, int]]:
    """Pairs of components that links on full sets make one; all their pairs are tried until they are."""
    names, part, counts = np.unique(root, return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    members = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(members, kind="stable")
    owner, (_, ids, holders) = owner[order], np.unique(members, return_inverse=True, return_counts=True)
    ends = np.cumsum(holders)
    own = np.concatenate([[0], np.cumsum(sizes)])
    now, out = part.copy(), []
    for i in np.flatnonzero(part != np.argmax(counts)):
        if (now == now[i]).all():
            continue
        shared = ids[own[i] : own[i + 1]]
        shared = shared[holders[shared] > 1]
        if not len(shared):
            continue
        both = np.bincount(np.concatenate([owner[ends[x] - holders[x] : ends[x]] for x in shared]), minlength=len(sets))
        for j in np.flatnonzero((now != now[i]) & (inter * both >= union * (sizes + sizes[i] - both))):
            if now[j] != now[i]:
                out.append((int(names[part[i]]), int(names[part[j]])))
                now[now == now[j]] = now[i]
    return out


def meetings(deep: DataFrame, many: bool = True) -> DataFrame:
    """Rows (region, root, n_shingles, ...) of the regions with several components, with the tile pairs they take part in.

    ``meeting`` names the pair of tiles, ``side`` is 0 for the tile whose classes meet all others and 1 for a second one.
    Tiles are dealt by hash, as many as classes and shingles ask for, and the largest component of a region has its own.
    """
    per = deep.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    tiles = lambda n, s: F.ceil(F.greatest(n / TILE, s / TILE_SHINGLES)).cast("int")
    most = F.max(F.struct("n", "root", "shingles"))
    stats = (
        per.groupBy("region")
        .agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), most.alias("most"))
        .where("roots > 1")
        .select("region", "n", "most.root", tiles(F.col("most.n"), F.col("most.shingles")).alias("own"), tiles(F.col("n") - F.col("most.n"), F.col("shingles") - F.col("most.shingles")).alias("others"))
        .withColumnRenamed("root", "largest")
    )
    stats, hot = with_hot_keys(stats, "region", possible=many)
    rows = spread_join(deep, stats.drop("n"), "region", hot)
    is_largest = F.col("root") == F.col("largest")
    tile = F.pmod(F.xxhash64("cls"), F.when(is_largest, F.col("own")).otherwise(F.col("others"))).cast("int")
    one = lambda a, b, side: F.struct(F.xxhash64("region", a, b).alias("meeting"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # A small region is one meeting; in others a tile of the largest component meets each tile of the rest, and those meet one another.
    mine = F.when(is_largest, F.transform(upto("others"), lambda i: one(-tile - 1, i, F.lit(1)))).otherwise(
        F.concat(F.transform(upto("own"), lambda j: one(-j - 1, tile, F.lit(0))), F.transform(upto("others"), lambda i: one(F.least(tile, i), F.greatest(tile, i), tile > i)))
    )
    single = (F.col("own") == 1) & (F.col("others") == 1)
    return rows.withColumn("m", F.explode(F.when(single, F.array(one(F.lit(0), F.lit(0), F.lit(0)))).otherwise(mine))).select("m.meeting", "m.side", *[c for c in deep.columns if c != "region"])


def bridges(classes: DataFrame, placed: DataFrame, roots: DataFrame, docs: DataFrame, inter: int, union: int, many: bool) -> DataFrame:
    """(a, b): components of ``roots`` (cls, root) between which there is a link."""
    deep = placed.where(F.col("depth") == DEPTHS[-1]).select("cls", "tree", "region").join(roots, "cls").join(classes.select("cls", "n_shingles"), "cls")
    met = meetings(deep, many)
    described = classes.select("cls", "sketch", F.array(*[prefix(t, DEPTHS[-1]) for t in range(TREES)]).alias("deep"))

    def likely(batches):
        for r in runs(batches, "meeting"):
            sketches = np.frombuffer(b"".join(r["sketch"]), np.uint8).reshape(len(r), LANES)
            found = disputed(r["root"].to_numpy(), r["side"].to_numpy(), int(r["tree"].iat[0]), sketches, np.stack(r["deep"]), r["n_shingles"].to_numpy(np.int64), inter, union)
            if found.any():
                yield r.loc[found, ["meeting", "cls", "root"]]

    def check(batches):
        old = np.seterr(over="ignore")
        for r in runs(batches, "meeting"):
            pairs = joined(r["root"].to_numpy(), [shingle_set(t) for t in r["text"]], inter, union)
            if pairs:
                yield pd.DataFrame(pairs, columns=["a", "b"])
        np.seterr(**old)

    sort = lambda df: df.repartition("meeting").sortWithinPartitions("meeting")
    rows = met.join(described, "cls").select("meeting", "side", "cls", "root", "tree", "sketch", "deep", "n_shingles")
    near = reliable(sort(rows).mapInPandas(likely, "meeting long, cls long, root long"))
    own = texts_of(docs, classes, near.select("cls").distinct())
    return sort(near.join(own, "cls").select("meeting", "root", "text")).mapInPandas(check, "a long, b long")


def near_duplicates(docs: DataFrame, inter: int = 100, union: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Linked are sets with ``inter`` * intersection >= ``union`` * union.
    """
    docs = docs.select("doc_id", "text")
    threshold = union / inter
    sets = reliable(sets_of(docs))
    usable = sets.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    # Classes are numbered in the checkpoint; the 128 bits of their key tell them apart.
    classes = reliable(
        usable.groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("n"))
        .select(F.monotonically_increasing_id().alias("cls"), "set_key", "first.doc_id", "first.text_hash", "n_shingles", "signature", sketches_of("signature"), "n")
    )
    many = sets.count() > common.HOT_ROWS
    of_text = hot_keys(classes, "set_key") if many else []
    # Rows that repeat an id with other texts link their classes.
    heads = spread_join(usable.select("doc_id", "set_key"), classes.select("set_key", "cls"), "set_key", of_text).select("doc_id", "cls").distinct()
    repeated = heads.groupBy("doc_id").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same_id = heads.join(repeated, "doc_id").select(F.col("cls").alias("a"), "b")
    placed, hot = regions(classes, many)
    pairs = neighbours(classes, placed, threshold).unionByName(leaders(placed, hot))
    links = confirmed(pairs, classes, docs, inter, union, threshold).unionByName(same_id)
    roots = reliable(classes.select("cls").join(components(links, many), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root")))
    wider = components(bridges(classes, placed, roots, docs, inter, union, many), many).select(F.col("cls").alias("root"), F.col("root").alias("wider"))
    rooted = classes.select("cls", "set_key", "doc_id").join(roots, "cls")
    of_root = (rooted.groupBy("root").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n")).join(wider, "root", "left").withColumn("wider", F.coalesce("wider", "root")))
    smallest = of_root.groupBy("wider").agg(F.min("smallest").alias("smallest"))
    of_root, hot_roots = with_hot_keys(of_root.select("root", "wider", "n").join(smallest, "wider"), "root", possible=many)
    of_class = spread_join(rooted, of_root.select("root", "smallest"), "root", hot_roots).select("set_key", "smallest")
    component = F.coalesce("smallest", "doc_id")
    return spread_join(sets.select("doc_id", "n_shingles", "set_key"), of_class, "set_key", of_text, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
