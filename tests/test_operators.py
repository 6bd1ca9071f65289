import json

from pyspark.sql import functions as F

from fieldloom.functions import plausible, values
from fieldloom.operators import entities, evaluate, feedback, layout
from fieldloom.operators.candidates import Strategy, generate
from fieldloom.operators.score import score
from fieldloom.operators.select import audit, best
from fieldloom.operators.templates import custom_patterns, java_pattern, raw_specificity
from fieldloom.operators.validate import Rule, validate


def test_a_checked_option_scores_the_known_constant(spark):
    """Preset of page one, no pattern, no span, labels declared: 0.635 plus the bonus of priority 1."""
    docs = spark.createDataFrame([(1, "WEATHER [X] Windmill [ ] Other")], "doc_id long, text string")
    s = Strategy("some_field", "checkbox_grid", priority=1, config={"anchor": "WEATHER", "options": {"Windmill": "Windmill", "Other": "Other"}})
    got = score(validate(generate(docs, [s]), {}), {"some_field": ["weather"]}).collect()
    assert [(r.value, round(r.confidence, 4)) for r in got] == [("Windmill", round(0.15 * 0.1 + 0.15 + 0.025 + 0.07 + 0.05 + 0.15 * 0.6 + 0.35 * 0.5 + 0.0198, 4))]


def test_ties_go_to_the_candidate_generated_first_and_rejected_ones_lose(spark):
    docs = spark.createDataFrame([(1, "id: AA-1 id: BB-2 id: AA-1"), (2, "nothing")], "doc_id long, text string")
    found = validate(generate(docs, [Strategy("f", patterns=(r"id: (?P<value>[A-Z]{2}-\d)",))]), {"f": [Rule("blacklist", values=("BB-2",))]})
    scored = score(found)
    assert [(r.value, r.start) for r in best(scored).collect()] == [("AA-1", 0)]
    assert {r.value: r.confidence == 0 for r in scored.collect()} == {"AA-1": False, "BB-2": True}
    rows = {(r.doc_id, r.field_id): r for r in audit(docs, [("f", False), ("g", True)], scored).collect()}
    assert rows[(1, "f")].considered == 3 and rows[(1, "f")].rejected_count == 1
    assert rows[(2, "g")].value is None and rows[(2, "g")].needs_review and not rows[(2, "f")].needs_review


def test_patterns_for_java():
    assert java_pattern(r"(?i)(?P<road_surface>\w+)(x)\Z") == (r"(?i)(\w+)(x)\z", 1)
    assert java_pattern(r"(a)(?P<value>b)") == ("(a)(b)", 2)
    assert java_pattern(r"[(](?:x)\(") == (r"[(](?:x)\(", 0)
    assert custom_patterns(["Claim #", "Claim #"])[0][0] == "dynamic_Claim #"


def test_specificity(spark):
    df = spark.createDataFrame([(r"\d\d",), (r".+",), (r"^Case$",), ("x.*y.*z.*",)], "p string")
    got = [round(r.s, 3) for r in df.select(raw_specificity(F.col("p")).alias("s")).collect()]
    assert got == [0.66, 0.3, 0.645, 0.05]


def test_plausibility_bounds(spark):
    cases = [
        ("date_time", "5/13/2024", 1.0), ("date_time", "5/13/1975", 0.5), ("date_time", "soon", 0.2), ("report_number", "AB-2024-123", 1.0), ("vin", "1HGCM82633A004352", 1.0),
        ("year", "1980", 0.2), ("weather", "Partly cloudy", 1.0), ("weather", "5", 0.3), ("officer", "Jane Doe", 1.0), ("location", "100 Main Street", 1.0), ("location", "short", 0.2),
        ("accident_type", "Rear-end", 1.0), ("contributing_factors", "[03] other", 1.0), ("property_damage", "(VEHICLE DAMAGE)", 0.2), ("ems_agency", "N/A", 0.3), ("road_surface", "Dry", 1.0), ("unlisted", "x", 0.5),
    ]
    df = spark.createDataFrame([(f, v) for f, v, _ in cases], "f string, v string")
    assert [r.s for r in df.select(plausible.plausibility(F.col("f"), F.col("v")).alias("s")).collect()] == [s for *_, s in cases]


def test_cleaners_and_comparison(spark):
    df = spark.createDataFrame([("date_time", "1/2/24 10:00"), ("vin", " 1hgcm82633a004352"), ("report_number", "a b c d e"), ("officer", "NAME OF THE OFFICER"), ("officer", None)], "f string, v string")
    assert [r.c for r in df.select(values.clean(F.col("f"), F.col("v")).alias("c")).collect()] == ["01/02/2024", "1HGCM82633A004352", "Unknown", "Unknown", None]
    pairs = spark.createDataFrame([("a", "Foo bar", "foo  BAR", "CORRECT"), ("a", "Foo", "foo,", "CORRECT_AFTER_TRIM"), ("a", "Foo bar", "bar", "CORRECT_BY_CONTAINMENT"), ("a", "x", "y", "INCORRECT"), ("a", "x", None, "MISSED"), ("a", None, "y", "SPURIOUS"), ("a", None, "", "TRUE_NEGATIVE"), ("date_time", "1/2/2024", "2024-01-02", "CORRECT"), ("vehicles", "A, B", "b,a", "CORRECT")], "f string, t string, g string, want string")
    assert all(r.want == r.got for r in pairs.select("want", evaluate.status(F.col("f"), F.col("t"), F.col("g")).alias("got")).collect())
    lists = spark.createDataFrame([("vehicles", json.dumps([{"plate": "P1"}, {"vin": "V"}, {"year": "2001", "make": "M"}])), ("operators", json.dumps([{"role": "Officer", "name": "X"}, {"name": "Ann"}])), ("vehicles", "plain")], "f string, v string")
    assert [r.x for r in lists.select(evaluate.flattened(F.col("f"), F.col("v")).alias("x")).collect()] == ["P1, V, 2001 M", "Ann", "plain"]


def test_layout_json(spark, tmp_path):
    box = {"l": 0.0, "t": 100.0, "r": 100.0, "b": 0.0}
    doc = {"pages": {"1": {"size": {"width": 612.0, "height": 792.0}}}, "texts": [{"text": "Name", "label": "text", "prov": [{"page_no": 1, "bbox": box}]}, {"text": "no box", "prov": []}, {"text": "far", "prov": [{"page_no": 2, "bbox": box}]}], "tables": [{"prov": [{"page_no": 1, "bbox": box}], "data": {"num_rows": 2, "num_cols": 2, "table_cells": [{"text": "c", "start_row_offset_idx": 1, "start_col_offset_idx": 1, "row_span": 1, "col_span": 1}]}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    read = layout.read_layout(spark, str(tmp_path))
    got = {r.text: r for r in layout.blocks(read).collect()}
    assert set(got) == {"Name", "far", "c"} and tuple(got["c"].bbox) == (50.0, 50.0, 100.0, 0.0) and got["c"].reading_order == 101
    assert {r.page_no: r.width_pt for r in layout.pages(read).collect()} == {1: 612.0, 2: None}


def test_equal_entity_ids_merge_and_sections_close(spark):
    text = "VEHICLE 1:\nYear: 2001\nMake: A\nVEHICLE 2:\nYear: 2002\nVEHICLE 1:\nMake: B\nSECTION 3\nMake: C"
    got = entities.vehicles(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("entity_no").collect()
    assert [(r.entity_no, r.year, r.make) for r in got] == [(1, "2001", "B"), (2, "2002", "Unknown")]


def test_learned_patterns_need_a_label(spark):
    raw = spark.createDataFrame([(1, "Agency: Springfield Police\nx"), (2, "12: Springfield")], "doc_id long, text string")
    fixes = spark.createDataFrame([(1, 1, "agency", "Unknown", "Springfield Police"), (2, 2, "agency", "", "Springfield"), (3, 1, "agency", "Other", "Springfield Police"), (4, 1, "weather", "", "Springfield Police")], "id long, doc_id long, field_name string, original_value string, new_value string")
    assert [r.example for r in feedback.learn_patterns(fixes, raw).collect()] == ["Springfield Police"]
