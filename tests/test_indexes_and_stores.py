"""Index of fragments, places of values, required texts of patterns, stores in buckets, learning streams, table strategies."""

import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import classify, enrich, feedback, layout
from fieldloom.operators.candidates import Strategy, generate, table_strategy
from fieldloom.plans import cases
from fieldloom.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fragments_meet_the_names_that_contain_them(spark):
    rnd = random.Random(1)
    word = lambda k: "".join(rnd.choice("abc ü") for _ in range(k))
    names = sorted({word(rnd.randint(1, 9)) for _ in range(120)})
    wanted = sorted({word(rnd.randint(1, 5)) for _ in range(150)} | {"", "zzz", names[3]})
    dim = spark.createDataFrame(list(enumerate(names)), "ord int, alias string")
    asked = spark.createDataFrame([(w,) for w in wanted if w], "_q string")
    got = enrich.containing(asked, dim)
    assert sorted((r._q, r.alias) for r in got.collect()) == sorted((w, n) for w in wanted if w for n in names if w in n)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_carriers_come_by_definition_and_exact_hits_stand_alone(spark):
    dim = spark.createDataFrame([(1, "Acme Mutual", "A"), (2, "Beta", "B"), (3, "acme", "B"), (4, "Gamma Acme", "C"), (5, "beta", "C")], "ord int, alias string, cocode string")
    rows = spark.createDataFrame([(1, " MUT "), (2, "acme"), (3, "cme"), (4, "Beta"), (5, None), (6, "  "), (7, "a")], "id int, text string")
    got = sorted((r.id, r["rank"], r.cocode, r.exact) for r in enrich.carrier_search(rows, dim).collect())
    assert got == [(1, 1, "A", False), (2, 1, "B", True), (3, 1, "A", False), (3, 2, "B", False), (3, 3, "C", False), (4, 1, "C", True), (7, 1, "A", False), (7, 2, "B", False), (7, 3, "C", False)]


def test_places_equal_a_search_of_all_blocks(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["Ann", "Lee", "12 Elm", "x\ny", "", "é ü", "Lee, Ann", "ab", None])
    blocks = [(d, p, n, f"{word() or ''} {word() or ''}" if rnd.random() < 0.9 else None, {"l": float(n), "t": 1.0, "r": 2.0, "b": 0.0}) for d in range(6) for p in (1, 2) for n in range(8)]
    values = [(d, f"f{i}", rnd.choice(["ann", "LEE", "lee, ann", "elm", "x y", "Ü", "   ", "nn 1", "nothing", None, "ab", "12 Elm Ann"]), "kept") for d in range(8) for i in range(12)]
    found = spark.createDataFrame(blocks, "doc_id int, page int, reading_order int, text string, bbox struct<l:double,t:double,r:double,b:double>")
    got = layout.provenance(spark.createDataFrame(values, "doc_id int, field_id string, value string, more string"), found).collect()
    flat = lambda t: (t or "").lower().replace("\n", " ").strip()
    for r in got:
        hits = [(p, n) for d, p, n, t, _ in sorted(blocks, key=lambda b: b[:3]) if d == r.doc_id and r.value is not None and len(r.value) >= 3 and flat(r.value) in flat(t)]
        assert ((r.page, r.bbox.l) if r.page else None) == ((hits[0][0], float(hits[0][1])) if hits else None), r
        assert r.more == "kept"
    assert len(got) == len(values)


FINGERPRINTS = [
    ("a", (r"CHP[\s\-]*555\b", r"OTS\s+(?:FORM\s+)?555")), ("b", (r"\bCR[-–]3\b.{0,40}(?:TEXAS|CRASH)", r"TEXAS\s+PEACE")), ("c", (r"(?:REPORTING\s+DISTRICT|BEAT).{0,40}CHP", r"\d{3}-X")),
    ("d", (r"peace(?:ful)?ly?", r"[a-c]x+yz")), ("e", (r"K\.S\. report",)),
]


def test_required_texts_change_no_form(spark):
    rnd = random.Random(3)
    parts = ["chp", "CHP 555", "ots form 555", "OTS 555", "texas", "Texas  peace", "CR-3 x crash", "CR–3", "BEAT of chp", "reporting district", "123-x", "peacefu", "peaceful", "peac", "axxyz", "byz", "k.s. Report", "\n", " ", "-", "é"]
    docs = spark.createDataFrame([(i, "".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 6)))) for i in range(600)] + [(600, None), (601, "x" * 9000 + "CHP 555")], "doc_id int, text string")
    rows = docs.select(classify.form_of(F.col("text"), FINGERPRINTS).alias("a"), classify.form_of(F.col("text"), FINGERPRINTS, prefilter=False).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and {r.a for r in rows} == {"a", "b", "c", "d", "e", None}


def test_required_texts_leave_few_patterns_of_a_library(spark):
    library = cases.library_fingerprints(spark)
    n = sum(len(p) for _, p in library)
    assert len(library) >= 50 and n >= 150
    docs = cases.table(spark, "/root/testdata/sf0.001", "documents")
    left = [r[0] for r in docs.select(classify.patterns_left(F.col("text"), library)).collect()]
    assert sum(left) < 0.05 * n * len(left)
    for p in ("a|b", r"\d+", "(?:x)?", "", "[ab]c"):
        assert classify.required_literals(p) is None
    assert classify.required_literals(r"(?:AB|CDE)F\s+xyz?") == {"xy"} and classify.required_literals(r"(?:ABC|DEF)\s*q") == {"abc", "def"}


SCHEMA = "doc_id long, version long, note string"


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/*/*.parquet")}


def test_a_change_rewrites_the_buckets_that_it_touches(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("version"), F.lit("first").alias("note"))
    feedback.write_store(rows, folder, ["doc_id"], 50)
    before = files(folder)
    assert len(before) == 50
    change = spark.createDataFrame([(7, 2, "second"), (8, 0, "stale"), (9000, 1, "new")], SCHEMA)
    feedback.upsert_store(spark, folder, SCHEMA, change, "doc_id", "version", 50)
    after = files(folder)
    assert 45 <= len(before.items() & after.items()) < 50
    got = {r.doc_id: r.note for r in feedback.read_store(spark, folder, SCHEMA).collect()}
    assert len(got) == 2001 and got[7] == "second" and got[8] == "first" and got[9000] == "new"
    # A bucket that a deletion empties goes; all others stay untouched.
    bucket = feedback.read_store(spark, folder, SCHEMA).where(feedback.bucket_of(["doc_id"], 50) == 3).select("doc_id")
    gone = [r[0] for r in bucket.collect()]
    feedback.delete_from_store(spark, folder, SCHEMA, spark.createDataFrame([(g,) for g in gone], "doc_id long"), ["doc_id"], 50)
    assert set(r.doc_id for r in feedback.read_store(spark, folder, SCHEMA).collect()) == set(got) - set(gone)
    assert len(files(folder)) == 49 and sorted(os.listdir(tmp_path)) == ["store"]


def test_a_change_that_fails_leaves_the_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    feedback.write_store(spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], SCHEMA), folder, ["doc_id"], 4)
    bad = spark.createDataFrame([(1, 2, "z")], SCHEMA).withColumn("note", F.when(F.raise_error(F.lit("broken")).isNull(), "z"))
    with pytest.raises(Exception, match="broken"):
        feedback.upsert_store(spark, folder, SCHEMA, bad, "doc_id", "version", 4)
    assert sorted(r.note for r in feedback.read_store(spark, folder, SCHEMA).collect()) == ["x", "y"] and os.listdir(tmp_path) == ["store"]


def test_a_learning_stream_that_stops_in_a_batch_stores_nothing_twice(spark, tmp_path):
    schema = "id long, doc_id long, field_name string, original_value string, new_value string"
    raw = spark.createDataFrame([(1, "Agency: Springfield Police\nx\n| Chassis Ref | Name |\n|---|---|\n| C-1 | z |"), (2, "Agency: Other Town Police\nx\n| Chassis Ref | Name |\n|---|---|\n| C-2 | z |")], "doc_id long, text string")
    fix = lambda i, doc, value, number: [(i, doc, "agency", "Unknown", value), (i + 100, doc, "vin", "Unknown", number)]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for q in jobs.learn_from_arriving(jobs.arriving_rows(spark, source, schema, 1), raw, out, checkpoint):
            q.awaitTermination()
        return sorted(tuple(r)[:2] for kind, s in (("aliases", jobs.ALIAS_SCHEMA), ("patterns", jobs.PATTERN_SCHEMA)) for r in jobs.learned(spark, f"{out}/{kind}", s).collect())

    first = arrive(fix(1, 1, "Springfield Police", "C-1"))
    assert [r[0] for r in first] == ["agency", "vin"]
    # The last batch counts as begun but not done: it runs again, with what has arrived since.
    for kind in ("aliases", "patterns"):
        last = max(glob.glob(f"{checkpoint}/{kind}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
        os.remove(last)
        crc = f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    assert arrive(fix(2, 2, "Other Town Police", "C-2")) == first
    more = arrive([(3, 1, "location", "", "Springfield Police")])
    assert len(more) == len(first) + 1 and set(first) < set(more)


def test_table_strategies_stand_beside_others(spark):
    @table_strategy("test_words")
    def words(s):
        class Words:
            def eval(self, text):
                for m in re.finditer(s.config["pattern"], text):
                    yield m[0], m[0], m.start(), m.end(), None, 0.5

        return Words

    docs = spark.createDataFrame([(1, "b aa b"), (2, None), (3, "")], "doc_id long, text string")
    got = generate(docs, [Strategy("x", "test_words", priority=1, config={"pattern": "a+|b"}), Strategy("x", patterns=("(a+)",), priority=2)]).orderBy("doc_id", "gen_order").collect()
    assert [(r.doc_id, r.value, r.strategy, r.start, r.preset, r.window) for r in got] == [
        (1, "b", "test_words", 0, 0.5, "b aa b"), (1, "aa", "test_words", 2, 0.5, "b aa b"), (1, "b", "test_words", 5, 0.5, "b aa b"), (1, "aa", "global_regex", 2, None, "b aa b"),
    ]
    with pytest.raises(ValueError, match="no such strategy"):
        generate(docs, [Strategy("x", "nothing")])


def test_labels_join_their_values_as_line_after_line_would(spark):
    """Against one pass over the lines that holds a label until its value comes."""
    from fieldloom.functions import text as texts

    rnd = random.Random(5)
    parts = ["NAME:", "Date", "DOB", "plain words here", "x1", "42", "AB-1", "DRIVER 1", "VEHICLE", "Make", "", "", "", "  ", "Address", "CAPS ONLY", "é"]
    rows = [(i, "\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))) for i in range(300)] + [(300, None), (301, "NAME:\n\nx" + "\n\nDOB" * 500), (302, "\n\n")]

    def plain(text):
        out, label, held = [], None, 0
        for line in [x.strip() for x in text.split("\n")] + [None]:
            if line == "":
                if label is None:
                    out.append("")
                held += 1
                continue
            if label is not None:
                known = re.search(texts.KNOWN_LABEL, label)
                if line is not None and held and (known or re.search(texts.VALUE, line)) and not re.search(texts.DELIMITER, line):
                    out.append(label + (" " if label.endswith(":") else ": ") + line)
                    label = None
                    held = 0
                    continue
                out += [label] + [""] * held
            label, held = None, 0
            if line is not None and (line.endswith(":") or not re.search("[a-z]", line) or re.search(texts.KNOWN_LABEL, line)):
                label = line
            elif line is not None:
                out.append(line)
        return "\n".join(out)

    frame = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.text for r in frame.select("doc_id", texts.labels_joined(F.col("text")).alias("text")).collect()}
    assert got[300] is None
    for i, t in rows:
        if t is not None:
            assert got[i] == plain(t), repr(t)
    assert "Exchange" not in plan_of(texts.join_labels(frame))


def test_tables_flatten_as_row_after_row_would(spark):
    from fieldloom.functions import text as texts

    rnd = random.Random(6)
    row = lambda: "| " + " | ".join(rnd.choice(["NAME", "Age", "x", "", "42", "KEY:", "Val b"]) for _ in range(rnd.randint(1, 4))) + " |"
    parts = [row, row, row, lambda: "|---|---|", lambda: "plain", lambda: "", lambda: "lead | a | b |"]
    rows = [(i, "\n".join(rnd.choice(parts)() for _ in range(rnd.randint(0, 14)))) for i in range(300)] + [(300, None), (301, "\n".join(row() for _ in range(150)))]

    def plain(text):
        out, body, head = [], False, None
        for no, line in enumerate(x.strip() for x in text.split("\n")):
            if "|" in line and not line.startswith("|") and line.endswith("|"):
                line = line[line.index("|") :]
            if not re.fullmatch(r"\|.*\|", line):
                body, head = False, None
                continue
            if re.fullmatch(r"\|[\s\-|]+\|", line):
                body = True
                continue
            cells = [c.strip(" ") for c in re.sub(r"^\||\|$", "", line).split("|")]
            keys = [c for c in cells[::2] if c]
            two = lambda c: len(c) == 2 and all(c)
            if len(cells) % 2 == 0 and keys and all((re.search("[A-Z]", c) and not re.search("[a-z]", c)) or c.endswith(":") for c in keys):
                own = [f"{a}: {b}" if a else None for a, b in zip(cells[::2], cells[1::2])]
            else:
                if not body:
                    head = cells
                first = [f"{cells[0]}: {cells[1]}" if two(cells[:2]) else None]
                if not body:
                    own = first if two(cells) else []
                elif head is None:
                    own = []
                else:
                    own = first if two(head) else [f"{h}: {c}" if h and c else None for h, c in zip(head, cells)]
            out += [(no, i, x) for i, x in enumerate(own) if x]
        return out

    frame = spark.createDataFrame(rows, "doc_id int, text string")
    flat = texts.flatten_tables(frame)
    got = [tuple(r) for r in flat.collect()]
    for i, t in rows:
        assert sorted(x[1:] for x in got if x[0] == i) == (plain(t) if t is not None else []), repr(t)
    assert "Exchange" not in plan_of(flat) and "Exchange" not in plan_of(texts.table_rows(frame))


def test_required_texts_run_on_over_white_space(spark):
    library = cases.library_fingerprints(spark)
    assert classify.required_literals(r"\bTX\s+FORM\s+CR[\s\-_]*3\b", blanks=True) == {"tx form cr"}
    assert classify.required_literals(r"A \s+\nB\s*C", blanks=True) == {"a b"} and classify.required_literals(r"ab\Scd", blanks=True) == {"ab"}
    docs = spark.createDataFrame([("report form of nobody, notice of loss",), ("TX \n\t form\x0bcr 3",), ("a report  of\nny mv-104 a",)], "text string").repartition(1)
    docs = docs.select("text", F.replace("text", F.lit("-104 a"), F.lit("104a")).alias("plain"))
    rows = docs.select("text", classify.patterns_left(F.col("text"), library).alias("left"), classify.form_of(F.col("text"), library).alias("a"), classify.form_of(F.col("text"), library, prefilter=False).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[1].a == "tx_cr3"
    assert {r.text[:6]: r.left for r in rows}["report"] == 0  # words that all forms share leave nothing to try


def test_gathered_blocks_are_not_shuffled_and_give_the_same(spark):
    rows = spark.createDataFrame([(d, f"b{n}", t, {"l": 50.0 + 150 * (n % 2), "t": 10.0 - n // 2, "r": 100.0, "b": 0.0}, 1, "text", n) for d in range(3) for n, t in enumerate(("DATE", f"day {d}", "NAME", "Ann"))], "doc_id int, block_id string, text string, bbox struct<l:double,t:double,r:double,b:double>, page int, label string, reading_order int")
    once = layout.gathered(rows)
    spec = layout.SpatialLabel("date", ("^DATE$",), "right", 300.0)
    assert sorted(layout.spatial_values(once, spec).collect(), key=str) == sorted(layout.spatial_values(rows, spec).collect(), key=str) and layout.gathered(once) is once
    values = spark.createDataFrame([(d, "name", "ann") for d in range(4)], "doc_id int, field_id string, value string")
    assert sorted(layout.provenance(values, once).collect(), key=str) == sorted(layout.provenance(values, rows).collect(), key=str)
    forms = cases.form_blocks(spark, "/root/testdata/sf0.001")
    assert forms.columns == ["doc_id", "blocks"] and "Generate" not in forms._jdf.queryExecution().executedPlan().toString()


def test_arriving_forms_are_dealt_over_files_by_their_number(spark, monkeypatch, tmp_path):
    from fieldloom.plans import records

    monkeypatch.setattr(records, "FORMS_A_FILE", 100)
    monkeypatch.setattr(records, "shared_folder", lambda spark: str(tmp_path))
    orders = cases.table(spark, "/root/testdata/sf0.001", "orders").count()
    assert records.streamed_items(spark, "/root/testdata/sf0.001").count() > 0
    assert len(glob.glob(f"{tmp_path}/in/*.parquet")) == max(4, orders // 100)
