"""What grows with the tables: how often rows are moved, sorted and read."""

from pyspark.sql import functions as F

from fieldloom.operators import entities as ent
from fieldloom.functions import text as texts
from fieldloom.operators import enrich, feedback, generic, layout, report
from fieldloom.operators.candidates import Strategy, generate
from fieldloom.plans import forms

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entities_are_read_in_their_row(spark):
    section = ent.Section(r"^ITEM ?(\w*)", r"^END", (ent.Attribute("a", "^a=(.*)$"), ent.Attribute("b", "^b=(.*)$", "first")), reopens=False)
    text = "a=0\nITEM 2\na=1\na=2\nb=\nb=3\n\nITEM\nb=4\nITEM 2\na=5\nb=6\nEND ITEM 9\nITEM 7\na=8"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "none"), (4, "ITEM x\n" * 200 + "a=1")], "doc_id int, text string")
    found = ent.entities(docs, section)
    assert [tuple(r) for r in found.orderBy("doc_id", "entity_no").collect()] == [(1, 1, "2", "5", "3"), (1, 2, "7", None, "4"), (4, 1, "x", "1", None)]
    again = ent.entities(docs, ent.Section(section.opens, section.closes, section.attributes))
    # An item without a number goes by its line, which is 7; the item 7 behind the end is the same then.
    assert [tuple(r)[1:] for r in again.where("doc_id = 1").orderBy("entity_no").collect()] == [(1, "2", "5", "3"), (2, "7", "8", "4")]
    assert "Window" not in plan_of(found) and "Aggregate" not in plan_of(found)


def test_items_of_a_form_are_numbered_in_its_row(spark):
    assert "Window" not in plan_of(forms.order_forms(spark, SF))
    assert forms.order_forms(spark, SF).where(F.contains("text", F.lit("ITEM 2: "))).count() > 0


def test_a_record_is_scored_in_its_row(spark):
    record = spark.createDataFrame([(1, "weather", "Rain")], "doc_id int, field_id string, value string")
    assert "Join" not in plan_of(report.score_records(record, record.select("doc_id", "field_id")))


def test_each_test_of_a_checkbox_looks_once(spark):
    docs = spark.createDataFrame([(1, "STATUS: [X] Open")], "doc_id int, text string")
    found = generate(docs, [Strategy("s", "checkbox_grid", config={"anchor": "STATUS:", "options": {"Open": "O"}})])
    assert plan_of(found).count("RLIKE") == 1 and [r.value for r in found.collect()] == ["O"]


def test_fields_and_pairs_are_looked_for_once(spark):
    docs = spark.createDataFrame([(1, "a: b\nRoad   \n")], "doc_id int, text string")
    assert plan_of(generic.custom_values(docs, ["Road"])).count("regexp_extract(") == 1
    assert plan_of(generic.key_values(docs)).count("regexp_replace(") <= 4


def test_fills_move_one_row_a_document(spark):
    docs = spark.createDataFrame([(1, "Weather: rain")], "doc_id int, text string")
    record = spark.createDataFrame([(1, "weather", "Unknown")], "doc_id int, field_id string, value string")
    filled = enrich.contextual_fill(record, docs, enrich.POLICE_FILLS)
    assert "Generate" not in plan_of(filled) and [r.value for r in filled.collect()] == ["rain"]


def test_texts_without_pipes_are_not_read_for_tables(spark):
    docs = spark.createDataFrame([(1, "| a |\n| b |"), (2, "a")], "doc_id int, text string")
    assert "Contains(text" in plan_of(texts.table_rows(docs)) and texts.table_rows(docs).count() == 2


def test_most_blocks_meet_no_expression_of_their_own(spark):
    around = [("b", 60.0, 100.0, 160.0, 90.0), ("c", 300.0, 101.0, 400.0, 91.0), ("d", 60.0, 80.0, 160.0, 70.0), ("e", 60.0, 100.0, None, 90.0), ("f", 60.0, 101.0, 160.0, None)]
    blocks = [(1, i, i, dict(zip("ltrb", box, strict=True)), page, "text", n) for page in (1, 2) for n, (i, *box) in enumerate(around)]
    rows = spark.createDataFrame([(1, "a", "Date", {"l": 0.0, "t": 100.0, "r": 50.0, "b": 90.0}, 1, "text", 0), *blocks], "doc_id int, block_id string, text string, bbox struct<l:double,t:double,r:double,b:double>, page int, label string, reading_order int")
    spec = layout.SpatialLabel
    found = layout.spatial_values(
        rows, spec("right", ("^DATE$",), radius=400.0, flags=("IGNORECASE",)), spec("last", ("(Date)",), radius=400.0, choose="rightmost"), spec("below", ("date",), "below", 100.0, match="literal"),
        spec("none", ("Date",), radius=10.0, match="exact"), spec("self", ("no", "D.te"), "self"),
    )
    # A box without a bottom is a line; one without a right side has no centre and lies nowhere.
    assert {r.field_id: (r.value, r.page, r.label_distance) for r in found.collect()} == {"right": ("b", 1, 85.0), "last": ("c", 1, (325.0**2 + 1) ** 0.5), "below": ("d", 1, (85.0**2 + 20.0**2) ** 0.5), "self": ("Date", 1, 0.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "filter(blocks" not in plan


def test_texts_are_searched_for_unfilled_fields_only(spark):
    docs = spark.createDataFrame([(1, "Weather: rain\nAgency: Blue")], "doc_id int, text string")
    record = spark.createDataFrame([(1, "weather", "Unknown"), (1, "agency", None), (1, "officer", "N/A"), (2, "weather", "Unknown")], "doc_id int, field_id string, value string")
    learned = spark.createDataFrame([("agency", 1, "Agency: (.{2,80})")], "field_name string, pattern_id int, pattern string")
    filled = enrich.learned_and_contextual_fill(record, docs, learned, enrich.POLICE_FILLS)
    assert sorted(map(tuple, filled.collect())) == [(1, "agency", "Blue"), (1, "officer", "N/A"), (1, "weather", "rain"), (2, "weather", "Unknown")]
    plan = plan_of(filled)
    assert plan.rindex("regexp_extract(") < plan.index("Join")  # the plan is written from its end: no search before the record is there


def test_each_step_of_learning_is_computed_once(spark):
    docs = spark.createDataFrame([(1, "Agency: Blue\n"), (2, "Blue"), (3, "7 x: Blue"), (4, "Agency Blue and"), (5, "Agency Bluebell")], "doc_id int, text string")
    corrections = spark.createDataFrame([(i, i, "agency", "N/A", "blue") for i in range(1, 6)], "id int, doc_id int, field_name string, original_value string, new_value string")
    found = feedback.pattern_hits(corrections, docs)
    assert sorted((r.doc_id, r.pattern) for r in found.collect()) == [(i, r"(?i)Agency[\s:*\-]{0,5}(.{3,80})(?:\n|$)") for i in (1, 4, 5)]
    assert plan_of(found).count("locate(") == 1 and plan_of(found).count("RLIKE") == 2
