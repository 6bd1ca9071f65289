import hashlib
import math
import random
import re
from collections import Counter

import numpy as np

from fieldloom.llm import bpe, decontaminate, language_id, quality, queries, substring_dedup
from fieldloom.llm.queries import word_bpe_path

WORDS = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["quux", "wibble", "frotz", "xyzzy"]}


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


def test_language_of_known_and_unseen_words(spark):
    rnd = random.Random(1)
    rows = [(prose(rnd, WORDS[k], 30), k) for k in WORDS for _ in range(40)] + [(None, "aa"), ("x y", None)]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    docs = [(1, "LOREM ipsum"), (2, "wibbles frotzy"), (3, None), (4, ""), (5, "123 !? _"), (6, "²"), (7, "中文"), (8, "lorem " * 50000), (8, "quux"), (None, "quux")]
    got = language_id.identify(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, lang_pred string"), model).collect()
    by = {(r.doc_id, (r.lang_pred, round(r.score, 6))) for r in got}
    pred = {i: p for i, (p, _) in by if i in (1, 2, 3, 4, 5, 6, 7)}
    assert pred == {1: "aa", 2: "bb", 3: "und", 4: "und", 5: "und", 6: "und", 7: pred[7]} and pred[7] in WORDS
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    nothing = language_id.learn(spark.createDataFrame([], "text string, lang string"))
    assert language_id.identify(spark.createDataFrame([(1, "a")], "doc_id long, text string"), nothing).first().lang_pred == "und"


def test_a_rare_language_keeps_its_keys(spark):
    rnd = random.Random(3)
    common = "\n".join(sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(60_500)}))
    model = language_id.learn(spark.createDataFrame([(common, "aa")] * 3 + [("αβγδε ζηθικ", "bb")] * 2, "text string, lang string"))
    assert model.languages == ["aa", "bb"] and [x for x, _ in model.predict(["ζηθικ", "γδε", common], {})] == ["bb", "bb", "aa"]


def test_long_words_count_in_full():
    keys = {"abcde": 0, "vwxyz": 1}
    model = language_id.LanguageModel(["aa", "bb"], {}, keys, np.log([[0.9, 0.1], [0.1, 0.9]]), 0)
    long = "abcde" * 7 + "vwxyz" * 100 + "abcde" * 7
    cache = {}
    assert [x for x, _ in model.predict([long, "abcdeabcde"], cache)] == ["bb", "aa"] and list(cache) == ["abcdeabcde"]


def test_quality_separates_and_handles_odd_rows(spark):
    rnd = random.Random(2)
    good = [(i, prose(rnd, WORDS["aa"] + WORDS["bb"] + [f"w{j}" for j in range(200)], 80) + ".") for i in range(300)]
    bad = [(1000 + i, "!! ".join(["SPAM"] * 60)) for i in range(120)]
    docs = spark.createDataFrame([(*r, 1) for r in good + bad + [(5000, None), (5001, ""), (5002, "x" * 300000)]], "doc_id long, text string, quality_score int")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(1, None), (0, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    assert min(got[i] for i, _ in good) > 0.6 and max(got[i] for i, _ in bad) < 0.3
    assert all(0 <= got[i] <= 1 for i in (5000, 5001, 5002))
    for some in ([], [(1, 1), (2, 1)]):
        empty = quality.learn(docs, spark.createDataFrame(some, "doc_id long, quality int"))
        assert {r.quality_score for r in quality.score(docs, empty).collect()} == {float(bool(some))}


def test_isotonic_is_the_least_squares_fit():
    x, y = np.arange(6.0), np.array([1, 0, 2, 5, 3, 4.0])
    fit = quality.isotonic(x, y, np.ones(6))
    assert np.allclose(fit, [(0.5, 0.5), (2, 2), (4, 4)])


ALPHABET = "aAbß é'’s!.,#<|>endoftextİſ̣́ \x1c12٣中文\U0001f600\n\t"


def test_bpe_equals_the_library(spark):
    tokenizer = bpe.load(open(word_bpe_path(), encoding="utf-8").read())
    rnd = random.Random(3)
    texts = [None, "", " \n", "Hello, world!! <|endoftext|> don't", "a" * 9000, "".join(rnd.choice("abcxyz") for _ in range(9000)), "!?" * 6000]
    texts += ["".join(rnd.choice(ALPHABET) for _ in range(rnd.choice([5, 60, 700]))) for _ in range(150)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "no id", "x")]
    for piece in (bpe.PIECE, 300):
        got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), word_bpe_path(), piece).collect()
        assert len(got) == len(rows)
        for r in got:
            want = tokenizer.encode((texts[r.doc_id] if r.doc_id is not None else "no id") or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_other_tokenizers_are_encoded_whole(spark):
    """A byte-level tokenizer keeps white space: no cache of words is used, and the tree gives the library's ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = bpe.load(open(path, encoding="utf-8").read())
    assert not bpe.independent_words(tokenizer) and bpe.independent_words(bpe.load(open(word_bpe_path(), encoding="utf-8").read()))
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(n)) for n in (0, 5, 60, 700, 1500)] + ["a  b " * 400]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 300).collect()
    for r in got:
        want = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_tree_joins_equal_whole_encodings():
    tokenizer = bpe.load(open(word_bpe_path(), encoding="utf-8").read())
    rnd = random.Random(4)
    for base in ("ab", "a", "!?", "thequickbrownfox", "a1", "é", "don't", "<|endoftext|>"):
        text = (base * 4000)[: rnd.randint(3000, 4000)]
        assert bpe.encode_tree(tokenizer, text, leaf=128).ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(100):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(20, 900)))
        assert bpe.encode_tree(tokenizer, text, leaf=32).ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [(i, prose(rnd, vocabulary, rnd.randint(6, 40)).capitalize() + ". " + prose(rnd, vocabulary, rnd.randint(1, 12)) + ".") for i in range(60)]
    items += [(60, None), (61, ""), (62, "Word"), (63, items[0][1]), (None, "an item without number but with words")]
    docs = []
    for d in range(150):
        text = prose(rnd, vocabulary, rnd.randint(0, 400))
        for _ in range(rnd.randrange(3)):
            words = rnd.choice(items[:60])[1].split()
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(len(words))] = "zz"
            text += rnd.choice([" ", "\n", " ## "]) + " ".join(words).upper() + " " + prose(rnd, vocabulary, rnd.randint(0, 90))
        docs.append((d, text))
    docs += [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1]), (None, items[4][1])]
    want = brute_leaks(docs, items)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string").repartition(3)
    bench = spark.createDataFrame([(i, x, "y") for i, x in items], "item_id long, text string, shard string").repartition(3)
    leaked = {d for d, _ in want}
    for shard_bytes in (decontaminate.SHARD_BYTES, 2000):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(frame, bench, shard_bytes=shard_bytes).collect()}
        assert set(got) == set(want) and len(want) > 30
        assert all(abs(r.score - want[k]) < 1e-6 for k, r in got.items())
        cleaned = decontaminate.clean(frame, bench, shard_bytes=shard_bytes)
        assert cleaned.columns == frame.columns
        assert sorted(str(r.doc_id) for r in cleaned.collect()) == sorted(str(d) for d, _ in docs if d not in leaked)
    none = bench.where("false")
    assert decontaminate.leaks(frame, none).count() == 0 and decontaminate.clean(frame, none).count() == len(docs)


def brute_leaks(docs, items):
    """Every passage against every item, without index or bounds: {(doc_id, item_id): best score}."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    known = [(i, x, words(x)) for i, x in sorted({(i, x) for i, x in items if words(x)}, key=str)]
    df = Counter(w for _, _, ws in known for w in set(ws))
    mean = sum(len(ws) for *_, ws in known) / len(known)

    def held(part, passage):
        n = min(5, len(part))
        grams = lambda ws: {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
        return len(grams(part) & grams(passage)) >= 0.8 * len(grams(part))

    out = {}
    for i, x, ws in known:
        stride = 64
        while stride < len(ws):
            stride *= 2
        tf = Counter(ws)
        weight = {w: math.log1p((len(known) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, n in tf.items()}
        sentences = [words(s) for s in re.split(r"(?<=[.!?])\s+", x) if words(s)]
        question, answer = (ws, ws) if len(sentences) < 2 else (ws[: -len(sentences[-1])], sentences[-1])
        for d, t in docs:
            all_words = words(t)
            for at in range(0, max(1, len(all_words) - stride), stride):
                passage = all_words[at : at + 2 * stride]
                score = sum(weight[w] for w in set(passage) & set(weight))
                if passage and score >= 0.5 * sum(weight.values()) - 1e-9 and held(question, passage) and held(answer, passage):
                    out[d, i] = max(score, out.get((d, i), 0))
    return out


def test_pivots_keep_every_item_above_its_limit():
    """Bounds never rule out a passage and item that the exact scores keep, whatever fits in a step."""
    rnd = random.Random(6)
    texts = [prose(rnd, [f"t{i}" for i in range(60)], rnd.randint(1, 15)) for _ in range(80)]
    df = Counter(w for t in texts for w in set(t.split()))
    rows = [(i, w, float(decontaminate.impact(n, df[w], len(t.split()), 80, 8.0))) for i, t in enumerate(texts) for w, n in Counter(t.split()).items()]
    shard = decontaminate.build_shard([(i, i, t) for i, t in enumerate(texts)], rows)
    (index,) = shard.indexes
    index.stride = 8
    for at_once in (decontaminate.AT_ONCE, 40):
        decontaminate.AT_ONCE, kept = at_once, decontaminate.AT_ONCE
        for _ in range(40):
            words = prose(rnd, [f"t{i}" for i in range(70)], rnd.randint(1, 60)).split()
            terms = np.array([shard.words.get(w, -1) for w in words])
            found = set(index.pivots(terms))
            for s in range(0, max(1, len(words) - 8), 8):
                inside = set(words[s : s + 16])
                for i in range(80):
                    score = sum(x for j, w, x in rows if j == i and w in inside)
                    assert score < index.limits[i] - 1e-9 or (s, i // decontaminate.BLOCK) in found
        decontaminate.AT_ONCE = kept


def test_short_answers_and_single_words_are_verified(spark):
    bench = spark.createDataFrame([(1, "What is the name of the largest moon of that planet? Titan."), (2, "zyzzyva")], "item_id long, text string")
    question = "what is the name of the largest moon of that planet"
    docs = spark.createDataFrame([(1, f"{question} it is Titan of course"), (2, f"{question} nobody knows"), (3, "a Zyzzyva here"), (4, "titan"), (5, "x " * 200_000 + f"{question}? titan " + "y " * 200_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == [(1, 1), (3, 2), (5, 1)]


def test_chunks_are_whole_and_resist_shifts():
    rnd = random.Random(7)
    text = prose(rnd, [f"wörd{i}" for i in range(500)], 2000)
    raw, ends = substring_dedup.chunks_of(text)
    assert ends[-1] == len(raw) and all(raw[s:e].decode() for s, e in zip([0, *ends], ends, strict=False))
    assert all(e - s <= substring_dedup.MOST + 3 for s, e in zip([0, *ends], ends, strict=False))
    a, b = ({substring_dedup.digest(r[s:e]) for s, e in zip([0, *x], x, strict=False)} for r, x in ((raw, ends), substring_dedup.chunks_of("inserted words " + text)))
    assert len(a & b) >= 0.97 * len(a)
    data = np.frombuffer(raw[:200], np.uint8)
    assert substring_dedup.gear(data)[150] == sum(int(substring_dedup._GEAR[data[150 - j]]) << j for j in range(32)) % 2**32


def test_repeated_passages_are_reported_and_cut(spark):
    rnd = random.Random(8)
    new = lambda n: prose(rnd, [f"{a}{b}{c}" for a in "abcdefgh" for b in "klmnop" for c in "uvwxyz"], n)
    passage = new(120)
    rows = [(i, f"{new(40)} {passage} {new(40)}") for i in range(5)] + [(10 + i, new(80)) for i in range(20)]
    rows += [(40, None), (41, ""), (42, "again " * 300), (50, f"{passage} {new(40)}"), (None, f"{new(40)} {passage} {new(40)}")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, version string")
    got = substring_dedup.repeated_spans(docs).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 50, None}
    texts = dict(rows)
    for r in got:
        assert texts[r.doc_id][r.start : r.end] in f"{texts[0]}" or r.words < 130
        assert (r.doc_id == 0) == r.kept and r.first_doc_id == 0
    cut = {r.doc_id: r.text for r in substring_dedup.deduplicated(docs).collect()}
    assert cut[0] == texts[0] and cut[11] == texts[11] and cut[42] == texts[42] and cut[40] is None
    assert len(cut[3]) < len(texts[3]) - 250
    assert substring_dedup.repeated_spans(docs.where("false")).count() == 0
    assert 42 in {r.doc_id for r in substring_dedup.repeated_spans(docs, across=False).collect()}


def test_passages_of_51_to_60_words_are_caught():
    rnd = random.Random(0)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.choice([2, 3, 4, 5, 5, 6, 7, 8]))) for _ in range(2000)]
    missed = 0
    for k in range(500):
        passage = prose(rnd, words, 51 + k % 10)
        (first, *_), (second, _, begun) = (substring_dedup.measured(f"{prose(rnd, words, 60)} {passage} {prose(rnd, words, 60)}") for _ in range(2))
        known, run, best = set(first), 0, 0
        for d, n in zip(second, begun, strict=True):
            run = run + n if d in known else 0
            best = max(best, run)
        missed += best < substring_dedup.WORDS
    assert missed == 0


def test_repeats_within_a_document_and_of_whole_rows(spark, tmp_path):
    rnd = random.Random(9)
    new = lambda n: prose(rnd, [f"{a}{b}{c}" for a in "abcdefgh" for b in "klmnop" for c in "uvwxyz"], n)
    inside, whole, anonymous = new(80), new(80), new(80)
    rows = [(1, f"{inside} {new(40)} {inside} {new(40)}"), (2, whole), (2, whole), (None, anonymous), (None, anonymous), (3, new(80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = substring_dedup.deduplicated(docs, across=False).collect()
    size = lambda i: sorted(len(r.text) for r in cut if r.doc_id == i)
    assert size(1)[0] < len(rows[0][1]) - 150 and size(3) == [len(rows[5][1])]
    assert size(2) == [0, len(whole)] and size(None) == [0, len(anonymous)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_substring_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(i, k) for i in (1, 2, None) for k in (True, False)}


def test_repeats_equal_brute_force(spark):
    """Counts, first places and documents of every chunk, with digests that most rows hold and without dealing them."""
    rnd = random.Random(10)
    new = lambda n: prose(rnd, [f"{a}{b}{c}" for a in "abcdefgh" for b in "klmnop" for c in "uvwxyz"], n)
    licence, passage = new(30), new(60)
    rows = [(i, f"{new(20)} {licence} {new(10)}" + (f" {passage}" if i % 5 == 0 else "")) for i in range(60)]
    rows += [(7, rows[7][1]), (None, licence), (None, None), (100, ""), (101, new(60_000)), (102, "é" * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, `first` string, salt int").coalesce(1)
    held: dict = {}
    for row, (i, t) in enumerate(rows):
        digests, cuts, _ = substring_dedup.measured(t)
        for n, d in enumerate(digests):
            held.setdefault(d, []).append((i is None, i or 0, row, n, int(cuts[n]), int(cuts[n + 1])))
    for across in (False, True):
        want = []
        for places in held.values():
            if len(places) > 1 and (not across or len({p[2] for p in places}) > 1):
                first = min(places)
                want += [(str(None if p[0] else p[1]), *p[3:], len(places), str(None if first[0] else first[1]), p == first) for p in places]
        for every in (1, 10**9):
            got = substring_dedup.repeats(docs, across, every).collect()
            assert sorted((str(r.doc_id), r.n, r.start, r.end, r.copies, str(r.first_doc_id), r.kept) for r in got) == sorted(want)


def test_digests_are_stable():
    assert hashlib.blake2b(b"x", digest_size=16).digest() == substring_dedup.digest(b"x") and re.match("x", "x")


def test_language_sample_is_drawn_by_row(spark):
    for n in range(4):
        copies = spark.createDataFrame([(f"the same words again {n}", "en")], "text string, lang string").crossJoin(spark.range(3000)).drop("id").repartition(3)
        model = language_id.learn(copies, max_rows=200)
        assert model.languages == ["en"]
    assert language_id.learn(spark.createDataFrame([("a few words", "en")] * 3, "text string, lang string"), max_rows=1, least=1).languages == ["en"]


def test_columns_of_the_input_do_not_clash(spark):
    words = random.Random(7)
    passage = prose(words, [f"p{i}" for i in range(200)], 80)
    docs = spark.createDataFrame([(i, f"{prose(words, [f'w{j}' for j in range(300)], 60)} {passage}", 1, "x", "y", i) for i in range(4)], "doc_id long, text string, _row long, cuts string, doc string, row long").repartition(2)
    assert len({r.doc_id for r in substring_dedup.repeated_spans(docs).collect()}) == 4
    cut = substring_dedup.deduplicated(docs)
    assert cut.columns == docs.columns
    assert sorted((r.doc_id, r._row, r.cuts, r.doc, r.row) for r in cut.collect()) == [(i, 1, "x", "y", i) for i in range(4)]
    bench = spark.createDataFrame([(1, passage), (2, prose(words, [f"q{i}" for i in range(200)], 60))], "item_id long, text string")
    kept = docs.unionByName(spark.createDataFrame([(9, "clean words only", 1, "x", "y", 9)], docs.schema))
    for shard_bytes in (decontaminate.SHARD_BYTES, 300):
        left = decontaminate.clean(kept, bench, shard_bytes=shard_bytes)
        assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(9, "clean words only", 1, "x", "y", 9)]
