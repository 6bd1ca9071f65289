"""Queries over sources, sinks, lookups, fills, bands and streams, and their SQL.

Inputs are made of the given tables by expressions, so that the truth is in those
tables and the SQL reads it there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions import values
from ..operators import classify, crash_tables, enrich, evaluate, feedback, generic, layout, report, templates
from ..operators.candidates import Strategy, generate, table_strategy, with_boxes
from ..operators.score import score
from ..operators.select import audit, best
from ..operators.validate import Rule, validate
from ..sources import scans
from ..streaming import jobs
from .forms import order_forms, shared_folder, table
from .records import form_blocks


def picked(options, k: Column) -> Column:
    """One of a few literal options by a number."""
    return F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), (F.pmod(k, F.lit(len(options))) + 1).cast("int"))


# ---- scans and sinks


def scanned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file per nation, in a folder of its own, read back as documents."""
    folder = shared_folder(spark)
    nations = table(spark, sf_dir, "nation").select(F.concat_ws("\n", "n_name", F.col("n_regionkey").cast("string")).alias("value"), "n_nationkey")
    nations.write.partitionBy("n_nationkey").text(folder)
    return scans.read_texts(spark, f"{folder}/*").select(F.regexp_extract("source_path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), values.stripped(F.col("text")).alias("text"))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout document per supplier: a title, a text without a box, a blank one, and a table of two by two cells, one with a box of its own."""
    k = F.col("s_suppkey").cast("string")
    box = lambda l, t, r, b: f'[{{"page_no":1,"bbox":{{"l":{l},"t":{t},"r":{r},"b":{b}}}}}]'
    cell = lambda text, r, c, prov="[]": f'{{"text":"{text}","start_row_offset_idx":{r},"start_col_offset_idx":{c},"row_span":1,"col_span":1,"prov":{prov}}}'
    body = (
        '{"version":"1","pages":{"1":{"size":{"width":612,"height":792}}},"texts":['
        f'{{"text":"%s","label":"title","prov":{box(50, 700, 150, 690)}}},{{"text":"unplaced","label":"text","prov":[]}},{{"text":" ","label":"text","prov":{box(50, 600, 150, 590)}}}],'
        f'"tables":[{{"prov":{box(100, 500, 300, 400)},"data":{{"num_rows":2,"num_cols":2,"table_cells":['
        f'{cell("Key", 0, 0)},{cell("%s", 0, 1)},{cell("Own", 1, 0, box(1, 9, 2, 8))},{cell("Last", 1, 1)}]}}}}]}}'
    )
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.format_string(body, "s_name", k).alias("value"))


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of layout files: texts with a box, and table cells, whose boxes come from the grid where they have none."""
    folder = shared_folder(spark)
    layouts(spark, sf_dir).where("doc_id <= 50").write.partitionBy("doc_id").text(folder)
    read = layout.read_layout(spark, f"{folder}/*").withColumn("doc_id", F.regexp_extract("doc_id", r"doc_id=(\d+)", 1).cast("long"))
    b = F.col("bbox")
    return layout.blocks(read).select("doc_id", "block_id", "text", "page", "label", "reading_order", b["l"].alias("l"), b["t"].alias("t"), b["r"].alias("r"), b["b"].alias("b"))


def template_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template files, one per region with a field per nation, read back as patterns in generation order."""
    folder = shared_folder(spark)
    one = F.struct(F.concat(F.lit("f_"), "n_nationkey").alias("field_id"), F.lit("text").alias("type"), F.lit(False).alias("required"), F.array(
        F.struct(F.lit("global_regex").alias("name"), F.col("n_nationkey").alias("priority"), F.array(F.concat("n_name", F.lit(": (.+)")), F.lit("x")).alias("patterns")),
        F.struct(F.lit("nearby_text").alias("name"), F.lit(90).alias("priority"), F.array("n_name").alias("patterns")),
    ).alias("strategies"))
    made = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(one)).alias("fields"))
    made.select(F.to_json(F.struct(F.concat(F.lit("region "), "n_regionkey").alias("doc_type"), "fields")).alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(folder)
    read = templates.read_templates(spark, f"{folder}/*")
    return templates.patterns_of(read).select("field_id", "strategy", "priority", "strategy_idx", "pattern_idx", "pattern")


def truth_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, a file per nation, read back as one row per field."""
    folder = shared_folder(spark)
    fields = F.create_map(F.lit("agency"), F.col("n_name"), F.lit("officer"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("J. Doe")), F.lit("region"), F.col("n_regionkey").cast("string"))
    doc = F.struct(F.concat("n_name", F.lit(".pdf")).alias("filename"), F.lit("tx_cr3").alias("expected_form_id"), fields.alias("fields"))
    made = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.lit("1").alias("_schema_version"), F.array(doc).alias("documents")), {"ignoreNullFields": "false"}).alias("value"), "n_nationkey")
    made.write.partitionBy("n_nationkey").text(folder)
    return scans.read_truth(spark, f"{folder}/*")


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction results written by form and read back; every ninth document has no text and fails with a reason."""
    docs = order_forms(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 9 != 0, F.col("text")))
    scored = score(validate(generate(docs, [Strategy("customer", patterns=(r"CUSTOMER: (\S+)",))]), {}))
    record = best(scored).select("doc_id", "field_id", "value")
    forms = docs.select("doc_id", F.concat(F.lit("form_"), F.col("doc_id") % 3).alias("form_id"))
    folder = shared_folder(spark)
    scans.write_results(scans.result_rows(record, audit(docs, [("customer", False)], scored), forms, docs), folder)
    return spark.read.parquet(folder).select("doc_id", "form_id", "status", "error", F.get_json_object("record", "$.customer").alias("customer"), F.get_json_object("audit", "$[0].considered").cast("int").alias("considered"))


def appended_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections appended in two writes, and the fields of one kind read back."""
    folder = shared_folder(spark)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("field_name"), F.col("user_id").alias("doc_id"))
    feedback.append(events.where("id % 2 = 0"), folder)
    feedback.append(events.where("id % 2 = 1"), folder)
    return feedback.for_field(spark.read.parquet(folder), "field_name", "purchase").groupBy("field_name").agg(F.count(F.lit(1)).alias("n"), F.sum("id").cast("long").alias("ids"))


def custom_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of custom fields of all documents."""
    return feedback.custom_field_names(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field_name")))


def custom_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' fields by their three generated patterns: a table cell, a heading's body, a label."""
    k = F.col("o_orderkey")
    body = picked((F.concat(F.lit("| Claim # | C"), k, F.lit(" |")), F.concat(F.lit("## Claim #\n\nC"), k, F.lit("\nrest")), F.concat(F.lit("Insured by us\nclaim - C"), k, F.lit("\nend"))), k)
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), body.alias("text"))
    given = [Strategy(f, patterns=tuple(p), priority=60) for f, p in templates.custom_patterns(["Claim #", "claim"])]
    return generate(docs, given).select("doc_id", "field_id", "value", F.col("gen_order.pattern").alias("pattern_idx"))


def assembled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extraction reads: narrative-free text and tables for adjuster reports, the page text otherwise."""
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(k, picked(("ia", "police"), k).alias("doc_type"), F.concat(F.lit("page "), k, F.lit("\nNARRATIVE\nlong story")).alias("page_text"), F.concat(F.lit("A: "), k).alias("tables"))
    before, _ = texts.split_narrative(F.col("page_text"))
    return docs.select(k.alias("doc_id"), texts.assembled(F.col("doc_type"), F.col("page_text"), before, F.col("tables")).alias("text"))


# ---- forms


def form_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and overlay of forms: known ones, the generic ones, unknown ones."""
    form = picked((*classify.FORM_IDS, "generic_mmucc", "municipal_pd_collision", "zz_none"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.state_of_form(form).alias("state"), classify.overlay_of_form(form).alias("overlay"))


def accuracy_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier accuracy by tier; labels are wrong for every fifth document."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    found = o.select(k.alias("doc_id"), picked(("tx_cr3", "ca_chp555"), k).alias("form_id"))
    expected = o.select(k.alias("doc_id"), F.when(k % 5 == 0, "ny_mv104a").otherwise(picked(("tx_cr3", "ca_chp555"), k)).alias("expected"), picked(("high", "medium", None), k).alias("tier"))
    return classify.accuracy(found, expected, "tier")


def forced_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified forms with the labelled form where there is a label."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit("generic_mmucc").alias("form_id"))
    return evaluate.with_forced_form(o, o.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("f"), F.col("doc_id") % 7).alias("expected")))


# ---- candidates


def checked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of evidence for a checked option, with and without the anchor."""
    k = F.col("o_orderkey")
    cases = ("WEATHER [x] Rain [ ] Snow", "WEATHER Rain [X]", "weather: Rain: Yes", "WEATHER X Rain", "no anchor ● Snow", "WEATHER [X]    Rain", "WEATHER ☒ Rain  ☒ Snow", "Xrain Xsnow", "WEATHER ( ) Rain (X) Snow")
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), picked(cases, k).alias("text"))
    s = Strategy("weather", "checkbox_grid", config={"anchor": "WEATHER", "options": {"Rain": "Rain", "Snow": "Snow"}})
    return generate(docs, [s]).select("doc_id", "value", "preset", "raw_match")


def flagged_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with the flags of their strategy; one that does not compile is left out."""
    s = Strategy("customer", patterns=(r"^customer: (?P<value>.+?)$", r"broken(", r"STATUS.*SECTION 2"), config={"flags": ("IGNORECASE", "MULTILINE", "DOTALL")})
    return generate(order_forms(spark, sf_dir), [s]).select("doc_id", F.when(F.col("gen_order.pattern") == 0, F.col("value")).otherwise(F.right("value", F.lit(9))).alias("value"), F.col("gen_order.pattern").alias("pattern_idx"))


def nearby_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where anchors lie, what was matched, and the value beside them."""
    s = Strategy("date", "nearby_text", (r"CUSTOMER:",), config={"radius": 60, "value_pattern": r"STATUS: (\[.\])"})
    return generate(order_forms(spark, sf_dir), [s]).select("doc_id", "value", "raw_match", "start", "end")


def preset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of checkboxes score by their signals, not by their preset: 0.15 x 0.1 + 0.15 + 0.025 + 0.07 + 0.05 + 0.09 + 0.175 + bonus."""
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit("KIND [X] Windmill").alias("text"), (k % 3).alias("n"))
    made = [generate(docs.where(F.col("n") == i), [Strategy("kind", "checkbox_grid", priority=p, config={"anchor": "KIND", "options": {"Windmill": "Windmill"}})]) for i, p in enumerate((1, 50, 150))]
    scored = score(validate(made[0].unionByName(made[1]).unionByName(made[2]), {"kind": [Rule("min_length", 3)]}), {"kind": ["kind"]})
    return scored.select("doc_id", F.round("confidence", 6).alias("confidence"))


def state_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A positional state form per supplier: values stand beside labels and page footers."""
    k = F.col("s_suppkey").cast("string")
    n = F.col("s_suppkey")
    second = F.when(n % 2 == 0, F.lit("STATE OF REGISTRATION\n2019Zap Runner\n12\nACME LEASING")).otherwise(F.lit("Q1\nnone\nX\nACME LEASING"))
    return table(spark, sf_dir, "supplier").select(n.alias("doc_id"), F.concat(
        F.lit("## DATE OF REPORT\n\n"), F.when(n % 4 == 3, "soon\n?\n").otherwise(F.concat(F.lit("05/13/202410:30\nCASE-"), k, F.lit("\n"))), F.lit("short\n\nWanda WITNESS   12 Oak Ave   no statement yet\nREPORTING AGENCY\n"),
        F.when(n % 5 == 0, "Page 2").otherwise(F.concat(k, F.lit(" MAIN ST"))), F.lit("\nHSMV 90010 S (E)\nREPORTING AGENCY CASE NUMBER\nx\nTOO EARLY\nP-"), k, F.lit("\n2020TOYOTACAMRY\nsilver\nJOHN DOE 456 ELM ST\nHSMV 90010 S (V/P)\n"),
        F.lit("Miami Police Department\n"), second, F.lit("\nhsmv 90010 s (v/p)\nTRAILER\na\nb\nPage 4\nHSMV 90010 S (V/P)\nREPORTING AGENCY CASE NUMBER\nHSMV CRASH REPORT NUMBER\nJANE ROE\nD12345\n01/02/1990\n1HGCM82633A004352\n2HGCM82633A004352"),
    ).alias("text"))


def state_form_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generic.state_form_record(state_forms(spark, sf_dir))
    listed = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *[x[n] for n in names])), "; ").alias(c)
    return found.select(
        "doc_id", "date_time", "report_number", "location", "agency", listed("witnesses", "name", "address"),
        listed("vehicles", "plate", "year", "make", "model", "color", "owner_name", "owner_address", "vin"), listed("parties", "name", "dob", "license_number"),
    )


# ---- fills and lookups


def contextual_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of police records filled by labels, by the pickers where there is no label, or not at all; known values stay."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    labelled = F.concat(
        F.lit("Date of Crash: 05/13/2024 noon\nPlace of crash - Mile "), n, F.lit("\nRank and Name: Sgt Jane Roe\nCrash report number: CR-"), n, F.lit("\nRoad conditions: wet and icy\n"),
        F.lit("Primary contributing, speed "), n, F.lit("\nEstimated damage: a fence\nFirst harmful event: Angle\nthe Springfield Police Department came"),
    )
    loose = F.concat(F.lit("The collision 5/14/24 was at "), n, F.lit(" old Mill Road near, the inn. Deputy Ann B. Lee of STATE OF TX - Harris County Sheriffs Office"))
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), picked((labelled, loose, F.lit("nothing here")), k).alias("text"))
    fields = sorted({*enrich.POLICE_FILLS, *enrich.PICKS})
    record = docs.select("doc_id", F.explode(F.array(*map(F.lit, fields))).alias("field_id")).withColumn("value", F.when((F.col("doc_id") % 6 == 0) & (F.col("field_id") == "weather"), "Fog").otherwise(picked(("Unknown", "N/A", " ", None), F.col("doc_id"))))
    return enrich.rendered(enrich.contextual_fill(record, docs, enrich.POLICE_FILLS, enrich.PICKS))


def adjuster_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of adjuster records filled by labels; a settlement gets its dollar sign."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    labelled = F.concat(F.lit("Date inspected: May 13\nPeril: wind\nLoss reserve: $"), n, F.lit(".50 in all\nSubrogation potential: none seen"))
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), picked((labelled, F.concat(F.lit("incident 1-2-2024. Total claim "), n), F.lit("")), k).alias("text"))
    record = docs.select("doc_id", F.explode(F.array(*map(F.lit, enrich.ADJUSTER_FILLS))).alias("field_id"), F.lit("Unknown").alias("value"))
    return enrich.contextual_fill(record, docs, enrich.ADJUSTER_FILLS, enrich.ADJUSTER_PICKS)


def learned_pattern_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned patterns in their order: the first that gives two characters; invalid ones are skipped, known values stay."""
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.concat(F.lit("Unit: "), F.substring(k.cast("string"), 1, 1), F.lit("\nTeam: T"), k, F.lit("\n")).alias("text"))
    record = docs.select("doc_id", F.lit("agency").alias("field_id"), F.when(F.col("doc_id") % 4 == 0, "Known").otherwise("Unknown").alias("value"))
    learned = spark.createDataFrame([("agency", 1, "Unit: (.)"), ("agency", 0, "bad("), ("agency", 2, "Team: (.{2,80})(?:\\n|$)"), ("other", 3, "(x)")], "field_name string, pattern_id int, pattern string")
    return enrich.learned_fill(record, docs, learned)


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown fields taken from another run, for the fields named, and missing ones rendered."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    first = o.select(k.alias("doc_id"), F.explode(F.array(F.lit("agency"), F.lit("weather"))).alias("field_id"), picked(("Unknown", "Kept", None), k).alias("value"))
    other = o.where("o_orderkey % 2 = 0").select(k.alias("doc_id"), F.explode(F.array(F.lit("agency"), F.lit("weather"))).alias("field_id"), F.concat(F.lit("second "), k).alias("value"))
    return enrich.rendered(enrich.fill_from(first, other, ["agency"]), "none")


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence bands of fields (80, 50) and of records (90, 70)."""
    v = F.col("o_orderkey") % 101
    return table(spark, sf_dir, "orders").select("o_orderkey", values.band(v, 80, 50).alias("field_band"), values.band(v, 90, 70).alias("record_band"))


def carrier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers whose name contains a fragment, in the order of their definition, or the one exact hit."""
    dim = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("alias"), F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("cocode"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), picked((" Nation_2 ", "ON_1", "nation_1", "", "zz", "2", "T", "tion_2"), F.col("c_custkey")).alias("text"))
    return enrich.carrier_search(rows, dim, "text").select("id", "cocode", "exact", "rank")


def group_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers of the groups that a fragment names."""
    dim = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("cocode"), F.col("n_name").alias("name"), F.col("r_name").alias("group_name"))
    return enrich.carriers_of_group(dim, " Asi").select("cocode", "name")


def state_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few tables of codes per region, which stand for states."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("S"), "n_regionkey").alias("state"), picked(("weather", "surface"), F.col("n_nationkey")).alias("table_name"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))


def decoded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single codes and lists decoded by state; unknown codes, tables and states leave the code."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", picked(("s0", "S1", "S9"), k).alias("state"), picked(("weather", "surface", "none"), k).alias("tab"), F.concat((k % 25).cast("string"), picked(("", "; 2,x"), k)).alias("code"))
    return enrich.decode(state_codes(spark, sf_dir), F.col("state"), F.col("tab"), F.col("code"), rows).select("o_orderkey", "code", "label")


def state_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables a state has, with the version of the lookups."""
    return enrich.with_version(enrich.tables_for_state(state_codes(spark, sf_dir)), "2026-01")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("element_id"), F.col("n_name").alias("name"), F.concat(F.lit("field_"), "n_regionkey").alias("field_map"), (F.col("n_nationkey") % 3 == 0).alias("required"))


def crash_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record field its elements, and how many of them are required."""
    dim = elements(spark, sf_dir)
    by_field = enrich.elements_by_field(dim).select("field_map", F.array_join("element_ids", ",").alias("element_ids"))
    return by_field.join(enrich.required_elements(dim).groupBy("field_map").agg(F.count(F.lit(1)).alias("required")), "field_map", "left")


def crash_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by id, and codes of elements by their labels; unknown codes stay."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("C"), F.lpad((k % 30).cast("string"), 2, "0")).alias("element_id"), F.concat(F.lit(" "), k % 4).alias("code"))
    dim = elements(spark, sf_dir)
    meanings = dim.select("element_id", F.explode(F.array(F.struct(F.lit("1").alias("code"), F.concat("name", F.lit(" one")).alias("label")), F.struct(F.lit("2").alias("code"), F.concat("name", F.lit(" two")).alias("label")))).alias("c")).select("element_id", "c.*")
    return enrich.element_labels(enrich.elements_by_id(rows, dim), meanings).select("o_orderkey", "element_name", "field_map", "label")


# ---- evaluation and learning


def flattened_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List fields given as JSON flattened to plates and names; what is no list stays."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    cases = (
        ("vehicles", F.concat(F.lit('[{"plate":"P'), n, F.lit('","vin":"V"},{"vin":"W'), n, F.lit('"},{"year":"2020","make":"Ford"}]'))),
        ("operators", F.concat(F.lit('[{"name":"A'), n, F.lit('","role":"Driver"},{"name":"Cop","role":"Officer"},{"first_name":"B","last_name":"C"}]'))),
        ("witnesses", F.concat(F.lit('[{"full_name":"W'), n, F.lit('","role":"witness"},{"name":"X","role":"driver"},{"name":"Y"}]'))),
        ("vehicles", F.concat(F.lit("plain, "), n)),
        ("agency", F.lit('[{"name":"kept"}]')),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", picked([f for f, _ in cases], k).alias("field_id"), picked([v for _, v in cases], k).alias("value"))
    return rows.select("o_orderkey", evaluate.flattened(F.col("field_id"), F.col("value")).alias("flat"))


def corrections_and_forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fixed = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("doc_id"), F.lit("agency").alias("field_name"), F.lit("Unknown").alias("original_value"), F.col("c_name").alias("new_value"))
    return fixed, order_forms(spark, sf_dir)


def learned_on_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns learned from corrections that arrive as files in several batches: no pattern is stored twice."""
    folder = shared_folder(spark)
    fixed, raw = corrections_and_forms(spark, sf_dir)
    fixed.repartition(4).write.parquet(f"{folder}/in")
    raw.write.parquet(f"{folder}/raw")
    arriving = jobs.arriving_rows(spark, f"{folder}/in", fixed.schema, 1)
    for query in jobs.learn_from_arriving(arriving, spark.read.parquet(f"{folder}/raw"), f"{folder}/out", f"{folder}/checkpoint"):
        query.awaitTermination()
    return jobs.learned(spark, f"{folder}/out/patterns", jobs.PATTERN_SCHEMA).groupBy("field_name", "pattern").agg(F.count(F.lit(1)).alias("n"))


def aliases_on_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers learned from corrections that arrive as files in several batches: each is stored once, and the next extraction reads under it."""
    folder = shared_folder(spark)
    n = F.col("s_suppkey").cast("string")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("V1:\nChassis Ref: C-"), n).alias("report"), F.concat(F.lit("| Chassis Ref | Name of Street |\n|---|---|\n| C-"), n, F.lit(" | Elm |")).alias("text"), F.concat(F.lit("C-"), n).alias("new_value"))
    s.select("doc_id", F.lit("vin").alias("field_name"), F.lit("Unknown").alias("original_value"), "new_value", F.col("doc_id").alias("id")).repartition(3).write.parquet(f"{folder}/in")
    s.select("doc_id", "text").write.parquet(f"{folder}/raw")
    fixed = spark.read.parquet(f"{folder}/in")
    for query in jobs.learn_from_arriving(jobs.arriving_rows(spark, f"{folder}/in", fixed.schema, 1), spark.read.parquet(f"{folder}/raw"), f"{folder}/out", f"{folder}/checkpoint"):
        query.awaitTermination()
    stored = jobs.learned(spark, f"{folder}/out/aliases", jobs.ALIAS_SCHEMA)
    n_stored = stored.where("canonical_field = 'vin'").count()
    found = crash_tables.vehicles(s.select("doc_id", F.col("report").alias("text")), feedback.alias_lists(stored))
    return found.select("doc_id", "vin", F.lit(n_stored).alias("n_stored"))


# ---- one table of candidates from text and page, user strategies, forms of a library, stores in buckets


def boxed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of candidates from text and page: a value beside its label beats one far from any, a label taken for a value is fined, a plausible date in the text beats its box."""
    docs, spec = order_forms(spark, sf_dir), layout.SpatialLabel
    text = generate(docs, [Strategy("customer", "nearby_text", (r"ORDER REPORT",), priority=10), Strategy("date_time", patterns=(r"DATE: (\d{2}/\d{2}/\d{4})",), priority=10)])
    page = layout.spatial_candidates(
        form_blocks(spark, sf_dir), spec("customer", ("^CUSTOMER$",), "right", 200.0, priority=10, idx=1), spec("own", ("^STATUS$",), "self", priority=10), spec("date_time", ("^DATE$",), "right", 200.0, priority=10, idx=1)
    )
    scored = score(validate(with_boxes(text).unionByName(page), {}), labels={"customer": ["nowhere"], "date_time": ["DATE"]})
    seen = F.col("strategy") == "spatial_label"
    return best(scored).select("doc_id", "field_id", "value", "strategy", F.when(seen, F.round("confidence", 4)).alias("confidence"), "overlap_penalty", F.round("bbox.l", 1).alias("l"))


@table_strategy("even_numbers")
def even_numbers(s: Strategy):
    """Numbers of some digits after a prefix whose digits add up to an even sum, which no pattern tells."""
    import re

    pattern = re.compile(s.config["prefix"] + r"(\d+)")

    class Numbers:
        def eval(self, text):
            for m in pattern.finditer(text):
                if sum(map(int, m[1])) % 2 == 0:
                    yield m[1], m[0], m.start(1), m.end(1), None, None

    return Numbers


def table_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's table function beside a pattern: where it finds a value, its higher priority makes it the first candidate."""
    found = generate(order_forms(spark, sf_dir), [Strategy("number", "even_numbers", priority=5, config={"prefix": "OR-"}), Strategy("number", patterns=(r"REPORT NO\.: (\S+)",), priority=50, idx=1)])
    first = found.groupBy("doc_id").agg(F.min_by(F.struct("value", "strategy", "start"), "gen_order").alias("c"), F.count(F.lit(1)).alias("n"))
    return first.select("doc_id", "c.*", "n")


def form_patterns(form_id: str) -> list[str]:
    """Three patterns of a form, by rule from its id: state and number after FORM, before REPORT, after REPORT OF."""
    state, code = form_id.upper().split("_", 1)
    number = r"[\s\-_]*".join(re.findall(r"[A-Z]+|\d+", code))
    return [rf"\b{state}\s+FORM\s+{number}\b", rf"\b{state}-{number}\b.{{0,40}}REPORT", rf"(?:REPORT|NOTICE)\s+OF\s+{state}\s+{number}\b"]


def library_fingerprints(spark: SparkSession) -> list[tuple[str, tuple[str, ...]]]:
    """Fingerprints of all forms with an overlay, written to a file as people keep it and read back."""
    folder = shared_folder(spark)
    rows = [(f, form_patterns(f), i) for i, f in enumerate(classify.FORM_IDS)]
    spark.createDataFrame(rows, "form_id string, patterns array<string>, position int").write.json(folder)
    return classify.read_fingerprints(spark, folder)


def library_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of a whole library in three spellings, and other texts, classified with their states and overlays."""
    k = F.col("o_orderkey")
    ids = F.array(*map(F.lit, classify.FORM_IDS))
    form = F.get(ids, (k % 60).cast("int"))
    code = F.upper(F.substring_index(form, "_", 1)), F.regexp_replace(F.upper(F.regexp_replace(form, "^[a-z]+_", "")), r"(?<=[A-Z])(?=\d)|_", "-")
    marks = [F.concat(code[0], F.lit(" form "), code[1]), F.concat(code[0], F.lit("-"), code[1], F.lit(" crash report")), F.concat(F.lit("Notice of\n"), code[0], F.lit(" "), code[1])]
    mark = F.coalesce(picked(marks, F.floor(k / 60)), F.lit("form report of no state"))
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.concat(F.repeat(F.lit("lines of a header - "), 20), F.lit("\n"), mark, F.lit("\nDriver 1")).alias("text"))
    found = docs.select("doc_id", classify.form_of(F.col("text"), library_fingerprints(spark)).alias("form_id"))
    return found.select("doc_id", "form_id", classify.state_of_form(F.col("form_id")).alias("state"), classify.overlay_of_form(F.col("form_id")).alias("overlay"))


def bucketed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store in buckets after an upsert of some keys, new ones too, and the deletion of others."""
    folder, schema = f"{shared_folder(spark)}/store", "doc_id long, version long, note string"
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).cast("long").alias("version"), F.lit("first").alias("note"))
    feedback.write_store(c, folder, ["doc_id"], 64)
    newer = c.where("doc_id % 7 = 0").select("doc_id", F.lit(2).cast("long").alias("version"), F.lit("second").alias("note"))
    older = c.where("doc_id % 7 = 1").select("doc_id", F.lit(0).cast("long").alias("version"), F.lit("stale").alias("note"))
    added = c.where("doc_id % 7 = 2").select(-F.col("doc_id") - 1, F.lit(1).cast("long"), F.lit("added")).toDF("doc_id", "version", "note")
    feedback.upsert_store(spark, folder, schema, newer.unionByName(older).unionByName(added), "doc_id", "version", 64)
    feedback.delete_from_store(spark, folder, schema, c.where("doc_id % 5 = 0").select("doc_id"), ["doc_id"], 64)
    return feedback.read_store(spark, folder, schema)


def evaluation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of an evaluation run as a stored document: counts of each status, overall rates, and per-document figures."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    truth = o.select(k.alias("doc_id"), F.lit("agency").alias("field_id"), picked(("right", "right", None, "right", None), k).alias("value"))
    got = o.select(k.alias("doc_id"), F.lit("agency").alias("field_id"), picked(("right", "other", "extra", None, None), k).alias("value"), (k % 10 / 10).alias("confidence"))
    folder = shared_folder(spark)
    evaluate.write_results(evaluate.compare(truth, got), folder)
    return evaluate.read_results(spark, folder).select("field_id", "correct", "incorrect", "missed", "spurious", "true_negative", "precision", "recall", "f1", "accuracy")


def calibrated_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidences of right and wrong values per document group, from confidences that differ."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    truth = o.select((k % 50).alias("doc_id"), k.cast("string").alias("field_id"), F.lit("abc").alias("value"))
    got = o.select((k % 50).alias("doc_id"), k.cast("string").alias("field_id"), picked(("abc", "zzz", "ABC.", "xabcx"), k).alias("value"), (k % 64 / 64).alias("confidence"))
    return evaluate.per_document(evaluate.compare(truth, got))


def low_fill_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which fewer than three in ten fields have a value."""
    k = F.col("o_orderkey")
    record = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("i")).select("doc_id", F.concat(F.lit("f"), "i").alias("field_id"), F.when(F.col("i") <= F.col("doc_id") % 11, "v").alias("value"))
    _, _, low = evaluate.fill_rates(record, record.select("doc_id", F.lit("TX").alias("state")).distinct())
    return low


def vehicle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record scores with vehicles of which zero, three or five attributes are known, and records without vehicles."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    record = s.select(k.alias("doc_id"), F.lit("report_number").alias("field_id"), F.lit("R-1234").alias("value"))
    known = lambda n: F.when(k % 4 >= n, "x1").otherwise("Unknown")
    vehicles = s.where("s_suppkey % 4 <> 3").select(k.alias("doc_id"), known(1).alias("vin"), known(1).alias("plate"), known(1).alias("make"), known(2).alias("year"), known(2).alias("model"))
    return report.score_records(record, record.select("doc_id", "field_id"), vehicles, core=["report_number"], scored=["report_number"]).select("doc_id", "score")


ORACLE_SQL = {
    "scanned_texts": "SELECT n_nationkey, n_name || chr(10) || n_regionkey AS text FROM nation",
    "layout_blocks": """
        SELECT s_suppkey AS doc_id, b.* FROM (SELECT * FROM supplier WHERE s_suppkey <= 50), LATERAL (VALUES
            ('text-0', s_name, 1, 'title', 0, 50.0::DOUBLE, 700.0::DOUBLE, 150.0::DOUBLE, 690.0::DOUBLE), ('cell-0-0-0', 'Key', 1, 'table_cell', 0, 100, 500, 200, 450),
            ('cell-0-0-1', s_suppkey::VARCHAR, 1, 'table_cell', 1, 200, 500, 300, 450), ('cell-0-1-0', 'Own', 1, 'table_cell', 100, 1, 9, 2, 8), ('cell-0-1-1', 'Last', 1, 'table_cell', 101, 200, 450, 300, 400)
        ) b(block_id, text, page, label, reading_order, l, t, r, b)
    """,
    "template_patterns": """
        SELECT 'f_' || n_nationkey AS field_id, 'global_regex' AS strategy, n_nationkey::INT AS priority, 0 AS strategy_idx, i::INT AS pattern_idx, CASE i WHEN 0 THEN n_name || ': (.+)' ELSE 'x' END AS pattern FROM nation, (VALUES (0), (1)) v(i)
        UNION ALL SELECT 'f_' || n_nationkey, 'nearby_text', 90, 1, 0, n_name FROM nation
    """,
    "truth_fields": """
        SELECT n_name || '.pdf' AS doc_id, 'tx_cr3' AS expected_form_id, f AS field_id, CASE f WHEN 'agency' THEN n_name WHEN 'region' THEN n_regionkey::VARCHAR ELSE CASE WHEN n_nationkey % 2 = 0 THEN 'J. Doe' END END AS value
        FROM nation, (VALUES ('agency'), ('officer'), ('region')) v(f)
    """,
    "stored_results": """
        SELECT o_orderkey AS doc_id, 'form_' || o_orderkey % 3 AS form_id, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 9 = 0 THEN 'no text' END AS error,
               CASE WHEN o_orderkey % 9 <> 0 THEN c_name END AS customer, CASE WHEN o_orderkey % 9 <> 0 THEN 1 ELSE 0 END AS considered
        FROM orders JOIN customer ON o_custkey = c_custkey
    """,
    "appended_corrections": "SELECT event_type AS field_name, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "custom_names": "SELECT DISTINCT event_type AS field_name FROM events",
    "custom_field_values": """
        SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 2 THEN 'dynamic_claim' ELSE 'dynamic_Claim #' END AS field_id, 'C' || o_orderkey AS value, (o_orderkey % 3)::INT AS pattern_idx FROM orders
    """,
    "assembled_texts": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'page ' || o_orderkey || chr(10) || chr(10) || 'A: ' || o_orderkey ELSE 'page ' || o_orderkey || chr(10) || 'NARRATIVE' || chr(10) || 'long story' END AS text FROM orders",
    "form_lookups": f"""
        WITH f AS (SELECT o_orderkey, [{", ".join(f"'{x}'" for x in classify.FORM_IDS)}, NULL, NULL, NULL][o_orderkey % {len(classify.FORM_IDS) + 3} + 1] AS form FROM orders)
        SELECT o_orderkey, upper(form[1:2]) AS state, CASE WHEN form = 'fl_hsmv' THEN 'fl_hsmv90010.json' ELSE form || '.json' END AS overlay FROM f
    """,
    "accuracy_by_tier": """
        SELECT CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'none' END AS tier, count(*) AS documents, count_if(o_orderkey % 5 <> 0)::BIGINT AS correct, round(avg((o_orderkey % 5 <> 0)::INT), 4) AS accuracy FROM orders GROUP BY 1
    """,
    "forced_forms": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'f' || o_orderkey % 7 ELSE 'generic_mmucc' END AS form_id FROM orders",
    "checked_boxes": """
        SELECT o_orderkey AS doc_id, v.value, v.preset, v.raw AS raw_match FROM orders JOIN (VALUES
            (0, 'Rain', 0.85::DOUBLE, '[x] Rain'), (1, 'Rain', 0.85, 'Rain [X]'), (2, 'Rain', 0.7, 'Rain: Yes'), (3, 'Rain', 0.7, 'X Rain'), (4, 'Snow', 0.85, '● Snow'),
            (6, 'Rain', 0.85, '☒ Rain'), (6, 'Snow', 0.85, '☒ Snow'), (8, 'Rain', 0.85, 'Rain (X)'), (8, 'Snow', 0.85, '(X) Snow')
        ) v(n, value, preset, raw) ON o_orderkey % 9 = n
    """,
    "flagged_patterns": """
        SELECT o_orderkey AS doc_id, c_name AS value, 0 AS pattern_idx FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT o_orderkey, 'SECTION 2', 2 FROM orders
    """,
    "nearby_spans": """
        SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' THEN '[X]' ELSE '[ ]' END AS value,
               left(' ' || c_name || chr(10) || 'STATUS: ' || CASE o_orderstatus WHEN 'O' THEN '[X] Open  [ ] Filled  [ ] Pending' WHEN 'F' THEN '[ ] Open  [X] Filled  [ ] Pending' ELSE '[ ] Open  [ ] Filled  [X] Pending' END, 60) AS raw_match,
               20 + 24 + 17 AS start, 20 + 24 + 17 + 9 + 60 AS "end"
        FROM orders JOIN customer ON o_custkey = c_custkey
    """,
    "state_form_records": """
        WITH s AS (SELECT s_suppkey AS k FROM supplier)
        SELECT k AS doc_id, CASE WHEN k % 4 = 3 THEN 'soon' ELSE '05/13/2024 10:30' END AS date_time, CASE WHEN k % 4 = 3 THEN 'Unknown' ELSE 'CASE-' || k END AS report_number,
               CASE WHEN k % 5 = 0 THEN 'Unknown' ELSE k || ' MAIN ST' END AS location, 'Miami Police Department' AS agency,
               'Wanda Witness|12 Oak Ave' AS witnesses,
               'P-' || k || '|2020|Toyota|Camry|Silver|John Doe|456 ELM ST|1HGCM82633A004352; ' || CASE WHEN k % 2 = 0 THEN 'Unknown|2019|Zap|Runner|Unknown|Acme Leasing|Unknown|Unknown' ELSE 'Q1|Unknown|Unknown|Unknown|Unknown|Acme Leasing|Unknown|Unknown' END AS vehicles,
               'Jane Roe|01/02/1990|D12345' AS parties
        FROM s
    """,
    "preset_scores": "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 0.5948 WHEN 1 THEN 0.585 ELSE 0.575 END::DOUBLE AS confidence FROM orders",
    "contextual_values": """
        SELECT o_orderkey AS doc_id, f AS field_id, CASE WHEN f = 'weather' AND o_orderkey % 6 = 0 THEN 'Fog'
            WHEN o_orderkey % 3 = 0 THEN CASE f WHEN 'date_time' THEN '05/13/2024 noon' WHEN 'location' THEN 'Mile ' || o_orderkey WHEN 'officer' THEN 'Sgt Jane Roe' || chr(10) || 'Crash report number' WHEN 'report_number' THEN 'CR-' || o_orderkey
                WHEN 'weather' THEN 'wet' WHEN 'contributing_factors' THEN 'speed ' || o_orderkey WHEN 'property_damage' THEN 'a fence' WHEN 'accident_type' THEN 'Angle' WHEN 'agency' THEN 'Springfield Police Department' END
            WHEN o_orderkey % 3 = 1 AND f = 'date_time' THEN '5/14/24' WHEN o_orderkey % 3 = 1 AND f = 'location' THEN '24 was at ' || o_orderkey || ' old Mill Road near'
            WHEN o_orderkey % 3 = 1 AND f = 'officer' THEN 'Ann B. Lee' WHEN o_orderkey % 3 = 1 AND f = 'agency' THEN 'Harris County Sheriffs Office'
            ELSE ['Unknown', 'N/A', 'N/A', 'N/A'][o_orderkey % 4 + 1] END AS value
        FROM orders, (SELECT unnest(['date_time', 'location', 'officer', 'report_number', 'weather', 'contributing_factors', 'property_damage', 'accident_type', 'agency']) AS f)
    """,
    "adjuster_values": """
        SELECT o_orderkey AS doc_id, f AS field_id, CASE o_orderkey % 3
            WHEN 0 THEN CASE f WHEN 'inspection_date' THEN 'May 13' WHEN 'cause_of_loss' THEN 'wind' WHEN 'settlement' THEN '$' || o_orderkey || '.50' ELSE 'none seen' END
            WHEN 1 THEN CASE f WHEN 'inspection_date' THEN '1-2-2024' WHEN 'settlement' THEN '$' || o_orderkey ELSE 'Unknown' END ELSE 'Unknown' END AS value
        FROM orders, (SELECT unnest(['inspection_date', 'cause_of_loss', 'settlement', 'subrogation']) AS f)
    """,
    "learned_pattern_values": "SELECT o_orderkey AS doc_id, 'agency' AS field_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Known' ELSE 'T' || o_orderkey END AS value FROM orders",
    "second_source": """
        SELECT o_orderkey AS doc_id, f AS field_id, CASE WHEN o_orderkey % 3 = 1 THEN 'Kept' WHEN f = 'agency' AND o_orderkey % 2 = 0 THEN 'second ' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'Unknown' ELSE 'none' END AS value
        FROM orders, (VALUES ('agency'), ('weather')) v(f)
    """,
    "bands": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 101 >= 80 THEN 'high' WHEN o_orderkey % 101 >= 50 THEN 'medium' ELSE 'low' END AS field_band,
               CASE WHEN o_orderkey % 101 >= 90 THEN 'high' WHEN o_orderkey % 101 >= 70 THEN 'medium' ELSE 'low' END AS record_band FROM orders
    """,
    "carrier_hits": """
        WITH q AS (SELECT c_custkey AS id, ['nation_2', 'on_1', 'nation_1', NULL, 'zz', '2', 't', 'tion_2'][c_custkey % 8 + 1] AS q FROM customer)
        SELECT id, lpad(n_nationkey::VARCHAR, 5, '0') AS cocode, lower(n_name) = q AS exact, row_number() OVER (PARTITION BY id ORDER BY n_nationkey)::INT AS rank
        FROM q JOIN nation ON CASE WHEN q IN (SELECT lower(n_name) FROM nation) THEN lower(n_name) = q ELSE contains(lower(n_name), q) END
    """,
    "group_carriers": "SELECT n_nationkey AS cocode, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "decoded_codes": """
        WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS region, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS parity, (o_orderkey % 25)::VARCHAR AS a, o_orderkey % 2 = 1 AS listed FROM orders),
             m AS (SELECT n_nationkey::VARCHAR AS code, n_name, n_regionkey, n_nationkey % 2 AS parity FROM nation)
        SELECT o_orderkey, a || CASE WHEN listed THEN '; 2,x' ELSE '' END AS code,
               CASE WHEN region IS NULL OR NOT EXISTS (SELECT 1 FROM m WHERE n_regionkey = region AND m.parity = r.parity) THEN a || CASE WHEN listed THEN '; 2,x' ELSE '' END
                    ELSE coalesce((SELECT n_name FROM m WHERE code = a AND n_regionkey = region AND m.parity = r.parity), a)
                         || CASE WHEN listed THEN ', ' || coalesce((SELECT n_name FROM m WHERE code = '2' AND n_regionkey = region AND m.parity = r.parity), '2') || ', x' ELSE '' END END AS label
        FROM r
    """,
    "state_tables": "SELECT DISTINCT 'S' || n_regionkey AS state, CASE WHEN n_nationkey % 2 = 0 THEN 'weather' ELSE 'surface' END AS table_name, '2026-01' AS table_version FROM nation",
    "crash_elements": """
        SELECT 'field_' || n_regionkey AS field_map, string_agg('C' || lpad(n_nationkey::VARCHAR, 2, '0'), ',' ORDER BY n_nationkey) AS element_ids, nullif(count_if(n_nationkey % 3 = 0), 0)::BIGINT AS required FROM nation GROUP BY n_regionkey
    """,
    "crash_codes": """
        SELECT o_orderkey, n_name AS element_name, 'field_' || n_regionkey AS field_map,
               CASE WHEN n_name IS NOT NULL AND o_orderkey % 4 = 1 THEN n_name || ' one' WHEN n_name IS NOT NULL AND o_orderkey % 4 = 2 THEN n_name || ' two' ELSE ' ' || o_orderkey % 4 END AS label
        FROM orders LEFT JOIN nation ON o_orderkey % 30 = n_nationkey
    """,
    "flattened_lists": """
        SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'P' || o_orderkey || ', W' || o_orderkey || ', 2020 Ford' WHEN 1 THEN 'A' || o_orderkey || ', B C' WHEN 2 THEN 'W' || o_orderkey || ', Y'
               WHEN 3 THEN 'plain, ' || o_orderkey ELSE '[{"name":"kept"}]' END AS flat FROM orders
    """,
    "learned_on_arrival": r"""SELECT 'agency' AS field_name, '(?i)CUSTOMER[\s:*\-]{0,5}(.{3,80})(?:\n|$)' AS pattern, 1::BIGINT AS n""",
    "learned_patterns": r"""
        SELECT 'agency' AS field_name, '(?i)CUSTOMER[\s:*\-]{0,5}(.{3,80})(?:\n|$)' AS pattern, c_name AS example, o_orderkey AS source_doc
        FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 1
    """,
    "aliases_on_arrival": "SELECT s_suppkey AS doc_id, 'C-' || s_suppkey AS vin, 1::BIGINT AS n_stored FROM supplier",
    "boxed_fields": """
        WITH w AS (SELECT 0.15 AS whole, 0.15 * (1 - (150 - 30) / 170.0) AS beside, 0.15 + 0.05 * 0.5 + 0.10 * 0.70 + 0.05 * 1.0 + 0.15 * 0.5 + 0.35 * 0.5 + (100 - 10) * 0.0002 AS same)
        SELECT o_orderkey AS doc_id, 'customer' AS field_id, c_name AS value, 'spatial_label' AS strategy, round(beside + same, 4)::DOUBLE AS confidence, 0.0::DOUBLE AS overlap_penalty, 200.0::DOUBLE AS l FROM orders JOIN customer ON o_custkey = c_custkey, w
        UNION ALL SELECT o_orderkey, 'own', 'STATUS', 'spatial_label', round(whole + same - 0.05, 4)::DOUBLE, 1.0, 50.0 FROM orders, w
        UNION ALL SELECT o_orderkey, 'date_time', strftime(o_orderdate, '%m/%d/%Y'), 'global_regex', NULL, 0.0, NULL FROM orders
    """,
    "table_strategies": """
        WITH r AS (SELECT o_orderkey AS doc_id, lpad(o_orderkey::VARCHAR, 8, '0') AS number FROM orders), e AS (SELECT *, list_sum(list_transform(string_split(number, ''), lambda c: c::INT)) % 2 = 0 AS even FROM r)
        SELECT doc_id, CASE WHEN even THEN number ELSE 'OR-' || number END AS value, CASE WHEN even THEN 'even_numbers' ELSE 'global_regex' END AS strategy, (CASE WHEN even THEN 35 ELSE 20 END)::INT AS start, CASE WHEN even THEN 2 ELSE 1 END AS n FROM e
    """,
    "library_forms": f"""
        WITH r AS (SELECT o_orderkey AS doc_id, [{", ".join(f"'{f}'" for f in classify.FORM_IDS)}][o_orderkey % 60 + 1] AS form_id FROM orders)
        SELECT doc_id, form_id, upper(left(form_id, 2)) AS state, CASE WHEN form_id = 'fl_hsmv' THEN 'fl_hsmv90010' ELSE form_id END || '.json' AS overlay FROM r
    """,
    "bucketed_store": """
        SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN c_custkey % 7 = 0 THEN 'second' ELSE 'first' END AS note FROM customer WHERE c_custkey % 5 <> 0
        UNION ALL SELECT -c_custkey - 1, 1, 'added' FROM customer WHERE c_custkey % 7 = 2
    """,
    "evaluation_results": """
        WITH c AS (SELECT count_if(o_orderkey % 5 = 0) AS r, count_if(o_orderkey % 5 = 1) AS i, count_if(o_orderkey % 5 = 2) AS s, count_if(o_orderkey % 5 = 3) AS m, count_if(o_orderkey % 5 = 4) AS n FROM orders),
             p AS (SELECT *, round(r / (r + s + i), 4) AS precision, round(r / (r + m + i), 4) AS recall FROM c)
        SELECT f AS field_id, r::BIGINT AS correct, i::BIGINT AS incorrect, m::BIGINT AS missed, s::BIGINT AS spurious, n::BIGINT AS true_negative, precision, recall,
               round(2 * precision * recall / (precision + recall), 4) AS f1, round(r / (r + s + m + 2 * i), 4) AS accuracy FROM p, (VALUES ('agency'), (NULL)) v(f)
    """,
    "calibrated_means": """
        SELECT o_orderkey % 50 AS doc_id, count_if(o_orderkey % 4 <> 1)::BIGINT AS correct, count(*) AS total,
               round(avg(CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey % 64 / 64 END), 4) AS confidence_correct, round(avg(CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 64 / 64 END), 4) AS confidence_incorrect
        FROM orders GROUP BY 1
    """,
    "low_fill_documents": "SELECT o_orderkey AS doc_id, (o_orderkey % 11) / 10 AS fill_rate FROM orders WHERE o_orderkey % 11 < 3",
    "vehicle_scores": """
        SELECT s_suppkey AS doc_id, round((1.5 + CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.6 WHEN 2 THEN 1 ELSE 0 END * 1.5) / 3 * 100, 1)::DOUBLE AS score FROM supplier
    """,
}

QUERIES = {
    f.__name__: f
    for f in (
        scanned_texts, layout_blocks, template_patterns, truth_fields, stored_results, appended_corrections, custom_names, custom_field_values, assembled_texts, form_lookups, accuracy_by_tier, forced_forms,
        checked_boxes, flagged_patterns, nearby_spans, state_form_records, preset_scores, contextual_values, adjuster_values, learned_pattern_values, second_source, bands, carrier_hits, group_carriers, decoded_codes,
        state_tables, crash_elements, crash_codes, flattened_lists, learned_on_arrival, aliases_on_arrival, boxed_fields, table_strategies, library_forms, bucketed_store, evaluation_results, calibrated_means, low_fill_documents, vehicle_scores,
    )
}
