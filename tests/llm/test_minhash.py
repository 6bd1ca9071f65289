import math
import pathlib
import random

from pyspark.sql import functions as F

from fieldloom.llm import common, minhash_forest


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows, inter, union):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and inter * len(a & b) >= union * len(a | b) and find(i) != find(j):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: find(i) for i, _ in sets}


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.random()}"
    return " ".join(words)


def test_components_equal_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(400)}"
    base = [word() for _ in range(120)]
    rows = [(i, edited(rnd, base, rnd.randrange(4))) for i in range(120)]
    rows += [(200 + i, " ".join(word() for _ in range(60)) + " " + " ".join(base[:50])) for i in range(60)]
    rows += [(300 + i, "Short Text") for i in range(3)] + [(310, "short\ttext"), (311, ""), (312, None), (313, "  \n"), (314, "   "), (315, "one"), (316, " ".join(base).upper())]
    rows += [(320, "É a b c d e"), (321, "é a b c d e"), (330, " ".join(base)), (330, " ".join(base)), (None, "short text")]
    chain = [f"c{i}" for i in range(200)]
    for k in range(6):
        rows.append((400 + k, " ".join(chain)))
        for _ in range(2):
            chain[rnd.randrange(200)] = f"n{rnd.random()}"
    for union in (85, 80):
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
        want = brute(rows, 100, union)
        got = minhash_forest.near_duplicates(docs, 100, union).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert r.component_id == want[r.doc_id], r
                assert r.kept == (r.doc_id == r.component_id)
    texts = dict(rows)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(shingles(t)) for i, t in texts.items() if i is not None}


def test_ids_that_repeat_link_their_texts(spark):
    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (3, "g h i j k l"), (9, "a b c d e f")]
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {3}


def test_long_text_and_nothing(spark):
    long = " ".join(f"w{i % 5000}x{i // 5000}" for i in range(60000))
    got = minhash_forest.near_duplicates(spark.createDataFrame([(2, long), (1, long + " tail")], "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}
    assert minhash_forest.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.cls: r.root for r in minhash_forest.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000} and math.isfinite(n)


def families(rnd, n):
    """Two families of single edits, linked by the first of each alone: they agree on 150 of 170 shingles, other pairs on less than 85 %."""
    words = [f"w{rnd.random()}" for _ in range(164)]
    other = list(words)
    for at in (20, 60, 100, 140):
        other[at] = f"o{rnd.random()}"
    bridge = [[other[20] if i == 20 else w for i, w in enumerate(words)], [words[140] if i == 140 else w for i, w in enumerate(other)]]
    return [[" ".join(x)] + [edited(rnd, base, 1) for _ in range(n - 1)] for x, base in zip(bridge, (words, other), strict=True)]


def test_a_single_link_between_two_families(spark):
    rnd = random.Random(11)
    groups = [a + b for a, b in (families(rnd, 300) for _ in range(5))]
    apart = families(rnd, 300)
    groups += [apart[0], apart[1][1:]]  # without one side of the link
    rows = [(1000 * g + k, t) for g, texts in enumerate(groups) for k, t in enumerate(texts)]
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 1000 * 1000 for i, _ in rows}


def test_regions_of_many_tiles_lose_no_link(spark, monkeypatch):
    """Families of near copies around one text, in tiles of a few classes; hot regions and roots are joined apart."""
    monkeypatch.setattr(minhash_forest, "TILE", 7)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rnd = random.Random(12)
    base = [f"w{rnd.random()}" for _ in range(150)]
    rows = [(i, edited(rnd, base, rnd.choice([1, 2, 9, 9, 9]))) for i in range(250)] + [(1000 + i, " ".join(base)) for i in range(250)]
    rows += [(5000 + i, " ".join(f"u{rnd.random()}" for _ in range(20))) for i in range(100)]
    want = brute(rows, 100, 85)
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_meetings_bring_every_two_components_of_a_region_together(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "TILE", 3)
    rnd = random.Random(13)
    rows = [(c, 0, g, 100 * g + rnd.choice([0, 0, 0, *range(n)]), 10) for g, n in enumerate((1, 2, 5, 30)) for c in range(1000 * g, 1000 * g + 40)]
    met = minhash_forest.meetings(spark.createDataFrame(rows, "cls long, tree int, region long, root long, n_shingles long")).collect()
    together = set()
    for m in {r.meeting for r in met}:
        own = [r for r in met if r.meeting == m]
        assert len(own) <= 40 and len({r.cls for r in own}) == len(own)
        two = any(r.side for r in own)
        together |= {frozenset((a.cls, b.cls)) for a in own for b in own if a.root != b.root and (not two or a.side != b.side)}
    assert together == {frozenset((a[0], b[0])) for a in rows for b in rows if a[2] == b[2] and a[3] != b[3]}


def test_ids_of_any_type_and_size(spark):
    rows = [("b", "x y z a b c"), ("a", "X Y Z A B C"), (None, "x y z a b c"), ("c", "q")]
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {("b", "a", False), ("a", "a", True), (None, None, True), ("c", "c", True)}
    big = 2**60 + 1
    got = minhash_forest.near_duplicates(spark.createDataFrame([(big, "x y"), (big + 1, "x y"), (None, "x y")], "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(big, big), (big + 1, big), (None, None)}


def test_rows_carry_signatures_once_and_texts_meet_the_needed_classes_only(spark):
    docs = spark.createDataFrame([(i, f"a b c d e{i}") for i in range(6)], "doc_id long, text string")
    sets = minhash_forest.sets_of(docs)
    assert "sketch" not in sets.columns
    classes = sets.selectExpr("doc_id as cls", "doc_id", "text_hash", "signature").select("cls", "doc_id", "text_hash", "signature", minhash_forest.sketches_of("signature"))
    for r in classes.collect():
        assert bytes(r.sketch) == bytes(r.signature)[3::4] and len(r.sketch) == minhash_forest.LANES
    own = minhash_forest.texts_of(docs, classes.drop("signature", "sketch"), spark.createDataFrame([(1,), (4,)], "cls long"))
    assert {(r.cls, r.text) for r in own.collect()} == {(1, "a b c d e1"), (4, "a b c d e4")}


def test_what_was_shuffled_for_a_checkpoint_goes_with_it(spark):
    files = lambda: set(pathlib.Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*"))
    sums = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
    before, setting = files(), spark.conf.get(common.TIDY)
    got = common.reliable(sums.join(sums.select("k", F.col("s").alias("t")), "k"))
    assert not files() - before
    assert spark.conf.get(common.TIDY) == setting
    assert {(r.k, r.s, r.t) for r in got.collect()} == {(k, s, s) for k in range(10) for s in [sum(range(k, 1000, 10))]}
