"""Queries over rendered forms: entities, tables, layout, lookups, feedback, evaluation.

The forms are rendered from the order tables, so the truth is in those tables and
the SQL reads it there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions.geometry import box
from ..operators import entities as ent
from ..operators import enrich, evaluate, feedback, generic, layout, report, templates
from ..operators.candidates import Strategy, generate
from ..sources import scans
from ..streaming import jobs
from .forms import numbered_items, order_forms, shared_folder, table

ITEMS = ent.Section(
    opens=r"^ITEM (\d+):", closes=r"^SECTION 3\b",
    attributes=(ent.Attribute("name", r"^ITEM \d+: (.+) \([^)]*\)$"), ent.Attribute("quantity", r"^Quantity: (\d+)$"), ent.Attribute("price", r"^Price: \$([\d,.]+)$"), ent.Attribute("code", r"^Code: (\w)$")),
)


def items_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered items read back from the forms."""
    found = ent.entities(order_forms(spark, sf_dir), ITEMS)
    return found.select("doc_id", "entity_no", F.col("entity_id").cast("int").alias("item_no"), "name", F.col("quantity").cast("int").alias("quantity"), F.replace("price", F.lit(","), F.lit("")).cast("double").alias("price"), "code")


def flattened_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables as ``header: cell`` lines."""
    flat = texts.flatten_tables(order_forms(spark, sf_dir, "table"))
    return flat.groupBy("doc_id", F.regexp_extract("line", "^([^:]+): ", 1).alias("header")).agg(F.count(F.lit(1)).alias("cells"), F.max(F.regexp_replace("line", "^[^:]+: ", "")).alias("largest"))


def mined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``key: value`` lines of every form; of equal keys the last.  Keys lose their signs, values keep theirs."""
    more = F.concat("text", F.lit("\nRe-port #: |x|\nA_b: "), "doc_id", F.lit("\n"), F.repeat(F.lit("k"), 50), F.lit(": too long\n--: no key\nkey/2: **\nempty:\nnone"))
    return generic.key_values(order_forms(spark, sf_dir).withColumn("text", more)).where(~F.col("key").startswith("ITEM") & ~F.col("key").isin("Price", "STATUS"))


def joined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on lines of their own joined to their values."""
    docs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("## REPORT NO.\n\nOR-"), "o_orderkey", F.lit("\n\nCUSTOMER:\n\n\n"), "c_name", F.lit("\nplain line\n\nDate: 1/2/2024\nTime: 10:30\n\nDRIVER 1")).alias("text"),
    )
    return texts.join_labels(docs)


COMPOUND_CASES = (
    "Weather Rain Light Conditions Dark - Lighted Road Surface NWet more", "(cid:12)weather clear light conditions dawn", "Road Alignment Curve Direction Eof Crash Same DiRrection (Rear EndE) Areas of Damage x",
    "CASE NUMBER 7 WEATHER Fog TYPE OF Angle / 2", "TYPE OF Sideswipe / 2", "TYPE OF COLLISION x", "COLLISION TYPE Head On TOTAL VEHICLES 2", "the weather event: none",
)


def compound_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound lines of every rule, between lines that stay."""
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.concat(F.lit("Order "), k.cast("string"), F.lit("\n"), F.element_at(F.array(*map(F.lit, COMPOUND_CASES)), (k % len(COMPOUND_CASES) + 1).cast("int")), F.lit("\nend")).alias("text"))
    return texts.expand_compound_lines(docs)


def narrative_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("A"), "o_orderkey", F.lit("\n"), F.when(F.col("o_orderkey") % 2 == 0, "SECTION 4 - OFFICER NARRATIVE\nIt rained").otherwise("no story")).alias("text"))
    before, after = texts.split_narrative(F.col("text"))
    return docs.select(F.col("o_orderkey").alias("doc_id"), before.alias("before"), after.alias("narrative"), texts.plain_paragraph(F.concat(F.lit("a*b  c~"), "o_orderkey")).alias("plain"))


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages joined in order."""
    pages = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no")).agg(F.min("text").alias("text"))
    return scans.page_texts(pages)


def checked_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Strategy("status", "checkbox_grid", priority=10, config={"anchor": "STATUS:", "options": {"Open": "O", "Filled": "F", "Pending": "P"}})
    return generate(order_forms(spark, sf_dir), [s]).select("doc_id", "value", "preset")


def nearby_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = [Strategy("customer", "nearby_text", (r"CUSTOMER:",), config={"radius": 30}), Strategy("after", "nearby_text", (r"REPORT NO\.:",), idx=1, config={"after_newline": True, "radius": 16})]
    return generate(order_forms(spark, sf_dir), s).select("doc_id", "field_id", "value")


def form_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, blocks): the labelled lines of the forms as blocks on a grid, in reading order: labels at 50 points, values at 200.  Blocks are made in their document's row."""

    # The boxes of a page's 45 lines.
    grid = {left: F.array(*[box(F.lit(left), F.lit(710 - 14 * n), F.lit(left + 100), F.lit(700 - 14 * n)) for n in range(45)]) for left in (50, 200)}

    def parts(x: Column) -> Column:
        page = (F.floor(x["no"] / 45) + 1).cast("int")
        part = lambda i, left, text: F.struct(page.alias("page"), (x["no"] * 2 + i).alias("reading_order"), F.concat(F.lit(f"{i}-"), x["no"].cast("string")).alias("block_id"), text.alias("text"), F.get(grid[left], x["no"] % 45).alias("bbox"), F.lit("text").alias("label"))
        return F.array(part(0, 50, F.substring(x["line"], F.lit(1), x["colon"] - 1)), part(1, 200, F.substring(x["line"], x["colon"] + 2, F.length(x["line"]))))

    # Lines of a label are those whose first colon stands behind something and before a blank; patterns would cost several times as much.
    tidy = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    lines = F.transform(tidy, lambda x, i: F.struct(i.alias("no"), x.alias("line"), F.locate(":", x).alias("colon")))
    labelled = F.filter(lines, lambda x: (x["colon"] > 1) & (F.substring(x["line"], x["colon"] + 1, F.lit(1)) == " "))
    return order_forms(spark, sf_dir).select("doc_id", F.flatten(F.transform(labelled, parts)).alias("blocks"))


def spatial_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = form_blocks(spark, sf_dir)
    spec = layout.SpatialLabel
    values = layout.spatial_values(
        found,
        spec("report_number", ("^REPORT ID$", "^REPORT NO\\.$"), "right", 200.0, value_pattern=r"OR-(\d+)"),
        spec("below_report", ("^REPORT NO\\.$",), "below", 30.0),
        spec("own", ("^CUST(OMER)$",), "self", value_pattern="CUST(OMER)"),
        spec("literal", ("no such", "status",), "left", 200.0, match="literal"),
        spec("exact", ("date", "DATE"), "right", 200.0, match="exact"),
        spec("above", ("^status$",), "above", 100.0, flags=("IGNORECASE",), choose="leftmost", skip_labels=("title",)),
    )
    return values.select("doc_id", "field_id", "value", "page", F.round("label_distance", 4).alias("label_distance"))


def value_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each customer's name stands on the page."""
    values = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), F.lit("customer").alias("field_id"), F.lower("c_name").alias("value"))
    return layout.provenance(values, form_blocks(spark, sf_dir)).select("doc_id", "value", "page", F.col("bbox.l").alias("l"), F.col("bbox.t").alias("t"))


def entity_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sub-fields of vehicles and parties stand on the pages of their reports: one block a line, 20 lines a page."""
    docs = crash_forms(spark, sf_dir)
    blocks = texts.lines_of(docs).select(
        "doc_id", (F.floor(F.col("line_no") / 20) + 1).cast("int").alias("page"), F.col("line_no").alias("reading_order"), F.col("line").alias("text"), box(F.lit(50.0), 700 - (F.col("line_no") % 20) * 20.0, F.lit(500.0), 690 - (F.col("line_no") % 20) * 20.0).alias("bbox"),
    )
    parties = ent.parties(docs)
    values = layout.entity_values(ent.vehicles(docs), "vehicles", layout.VEHICLE_PLACES)
    for role in ent.ROLES:
        values = values.unionByName(layout.entity_values(ent.with_role(parties, role), role, layout.PARTY_PLACES))
    return layout.provenance(values, blocks).select("doc_id", "field_id", "value", "page", F.col("bbox.t").alias("t"))


def widget_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    record = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("weather").alias("field_id"), F.when(F.col("o_orderkey") % 4 == 0, "Fog").otherwise("Unknown").alias("value"))
    widgets = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.when(F.col("o_orderstatus") == s, "Yes").otherwise("Off").alias("value")) for i, (n, s) in enumerate((("Weather_Rainy", "O"), ("weather clear sky", "F"), ("Weather other", "P")))])).alias("w")).select("doc_id", "w.*")
    return layout.widget_fills(record, widgets, {"weather": ["weather"]}, {"weather": [("rain", "Rain"), ("clear", "Clear")]})


def loss_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss notices with labels and signs, with labels only, without any, and with some."""
    k = F.col("c_custkey")
    labelled = F.concat(F.lit("AGENCY: "), "c_mktsegment", F.lit(" Inc.\nCompany: Big Mutual\nPOLICY NUMBER: P-"), k, F.lit("\nNAMED INSURED: Joe Doe\nDATE OF LOSS: 01/02/2024\nDESCRIPTION OF LOSS: water * damage\nin unit "), k, F.lit("\nSIGNATURE: x"))
    bare = F.concat(F.lit("Producer Acme LLC\nCompany Big Mutual\nPolicy Number AB-"), k, F.lit("\nNamed Insured Joe Doe\nDate of Loss 2024-01-02\nDescription of Loss fire & smoke"))
    some = F.concat(F.lit("policy number"), k, F.lit(" and description of loss: "))
    docs = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.when(k % 4 == 0, labelled).when(k % 4 == 1, bare).when(k % 4 == 2, some).otherwise("hello").alias("text"))
    return generic.loss_notice(docs).withColumn("accuracy_reasons", F.array_join("accuracy_reasons", "; "))


def custom_fields_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom fields that are mined already, follow with or without a sign, or do not occur."""
    docs = order_forms(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nWeather Conditions Sunny, warm\nRoad: Wet")))
    return generic.custom_values(docs, ["CUSTOMER", "Broker", "ORDER REPORT FORM", "section 2", "Weather Conditions", "road"])


def positional_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at offsets from anchor lines."""
    return generic.anchored_lines(order_forms(spark, sf_dir), {"date": (r"^REPORT NO\.", 1), "form": (r"^REPORT NO\.", -1), "beyond": (r"^SECTION 3", 2)}).select("doc_id", "field_id", "value")


def glued_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat((F.col("p_partkey") % 20 + 2000).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "FORD").otherwise("FORDSON"), F.lit("M"), F.col("p_size").cast("string")).alias("v"), F.concat(F.lit("1/2/"), F.col("p_partkey") % 20 + 2000, F.lit("10:30 AM")).alias("d"))
    year, make, model = generic.split_year_make_model(F.col("v"), ["Ford", "Fordson"])
    day, clock = generic.split_date_time(F.col("d"))
    return rows.select("p_partkey", year.alias("year"), make.alias("make"), model.alias("model"), day.alias("day"), clock.alias("clock"))


def crash_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crash report per supplier, in four shapes: labelled values, column tables, words of rules, a theft report."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    n, year, vin = k.cast("string"), (k % 30 + 1990).cast("string"), F.lpad(k.cast("string"), 17, "A")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    labelled = text(
        "SECTION 2 - VEHICLES\nVEHICLE 1: ", year, " Make", n, " Runner (Red)\nVIN: ", vin, "\nOwner: same as driver\nPlate: OLD\nPlate: P-", n, "\nType of Collision: Rear-End\nVEHICLE 2:\nYear: ", (k % 10 + 2010).cast("string"),
        "\nManufacturer: Other\nTowed: yes\nEMS - Unit 14 came\nSECTION 3 - PARTIES\nDRIVER 1\nName: ", F.col("s_name"), "\nAddress: ", n, " Main Street\nInjury: ", F.when(k % 8 == 0, "bruise, alcohol").otherwise("bruise"),
        "\nCitations: speeding\nCharge: ", n, "|\nPASSENGER 2\nName: Pat Doe\nTaken to: City Hospital\nPEDESTRIAN 3\nDOB: 3/4/1991\nPASSENGER 4\nSECTION 6 - WITNESSES\nDRIVER 9\nName: Nobody\n"
        "WITNESS 1: Ann B. Smith\nPhone: 555-123-4567\nStatement: saw it",
    )
    columns = text(
        "# Year / Make / Model VIN Plate Damage\nV1 ", year, " Make", n, " Runner ", vin, " P-", n, " dent\nV2 2010 Other Plain\nSECTION 3 - DRIVERS\nParty Name DOB License Citation\nDriver V1 Kay Alan 01/02/1990 D", F.lpad(n, 6, "0"),
        " speeding; ", n, "\nSECTION 4 - PASSENGERS\nVeh Name DOB Injury\nV1 Pat L. 3/4/1991 bruise Yes\nDoe more\nPED- Lou Roe (walking) 5/6/1992 No\nSECTION 6 - WITNESSES & OFFICERS\n# Name Address Phone Statement\n1 Ann Smith ", n,
        " Elm St (555) 123-4567 saw it\n2 Bo Li\nInvestigating Officer Poe\nName: Nobody",
    )
    words = text(
        "Unit 1:\nYear ", year, " Make Make", n, " Model Runner Color Red\nYear 1900 Make Ignored\nVIN ", vin, "\nLicense Plate P-", n, "\nRegistered Owner same as driver\nUnit 2:\n2010 Other Plain (Blue)\nTowed from Scene Yes\nSECTION 3\n"
        "Driver Information\nDriver Name Kay Alan DOB 01/02/1990\nHome Address ", n, " Main Street City/State/Zip Waco\nInjury Severity bruise Taken To City Hospital\nCitations Issued speeding\nCitations Issued ", n,
        "\nPedestrian 2\nName Pat Doe (adult)\nTransported No\nNARRATIVE\nName Nobody\nW1: Ann Smith, walker\nJones x",
    )
    theft = text(
        "VEHICLE - STOLEN / INVOLVED\nYear / Make / Model ", year, " Make", n, " Runner\nLicense Plate / State TX-", F.lpad(n, 5, "0"), " (TX)\nVICTIM / COMPLAINANT\nName: Kay Alan\nSUSPECT Pat Doe (DOB: 3/4/1991)\nDriver: Violation 22350\nName: Nobody",
    )
    return s.select(k.alias("doc_id"), F.when(k % 4 == 0, labelled).when(k % 4 == 1, columns).when(k % 4 == 2, words).otherwise(theft).alias("text"))


def crash_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = crash_forms(spark, sf_dir)
    return ent.owner_backfill(ent.vehicles(docs), ent.parties(docs)).select("doc_id", "entity_no", "year", "make", "model", "color", "vin", "plate", "owner_name", "owner_address", "towed")


def crash_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ent.party_list(ent.parties(crash_forms(spark, sf_dir))).select("doc_id", "party_no", "role", "name", "address", "condition", "injuries", "substance_involvement", "transported", "citations")


def crash_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone in a report, victims and suspects too."""
    return ent.parties(crash_forms(spark, sf_dir)).select("doc_id", "entity_no", "role", "name", "dob", "license_number", "transported_to")


def crash_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ent.witnesses(crash_forms(spark, sf_dir)).select("doc_id", "entity_no", "name", "address", "phone", "statement")


def learned_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What corrections teach the next extraction: reports under headers of their own, read before and after learning.

    People corrected the numbers in the tables of every tenth report; the headers of those columns become aliases of
    the fields, and the same reports are read again with them.
    """
    s = table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    reports = s.select(k.alias("doc_id"), F.concat(F.lit("V1: 2020 Ford Focus\nChassis Ref: C-"), n, F.lit("\nReg Mark: R-"), n, F.lit("\nDRIVER 1\nSurname and Forename: Kay\nNational Permit: D-"), n).alias("text"))
    corrected = s.where(k % 10 == 0)
    tables = corrected.select(k.alias("doc_id"), F.concat(F.lit("| Chassis Ref | Reg Mark | National Permit | Name of Street |\n|---|---|---|---|\n| C-"), n, F.lit(" | R-"), n, F.lit(" | D-"), n, F.lit(" | Elm |")).alias("text"))
    fixes = corrected.select(k.alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.concat(F.lit(p), n).alias("new_value")) for f, p in (("vin", "C-"), ("plate", "R-"), ("license_number", "D-"))])).alias("c")).select("doc_id", "c.*")
    aliases = feedback.alias_lists(feedback.learn_aliases(fixes, tables))
    cars = lambda known: ent.vehicles(reports, known).select("doc_id", "vin", "plate")
    people = lambda known: ent.parties(reports, known).select("doc_id", "license_number")
    before = cars({}).select("doc_id", F.col("vin").alias("vin_before"), F.col("plate").alias("plate_before"))
    return before.join(cars(aliases), "doc_id").join(people(aliases), "doc_id")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("S"), "n_regionkey").alias("state"), F.lit("weather").alias("table_name"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))


def decoded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lists of every order decoded by the tables of its region."""
    orders = table(spark, sf_dir, "orders")
    record = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("weather").alias("field_id"), F.concat((F.col("o_orderkey") % 25).cast("string"), F.lit(", 3;x")).alias("value"))
    forms = orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("S"), F.col("o_orderkey") % 5).alias("state"))
    return enrich.decode_codes(record, forms, codes(spark, sf_dir), ["weather"])


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("cocode"), F.concat("n_name", F.lit(" MUTUAL")).alias("name"), F.col("r_name").alias("group_name"), F.col("n_nationkey").alias("ord"))


def carrier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    return enrich.carrier_by_code(rows, carriers(spark, sf_dir)).select("c_custkey", "carrier", "carrier_group")


def canonical_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier names as people write them: whole, without the ending, with another ending, or unknown."""
    dim = carriers(spark, sf_dir)
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lower("n_name"), F.lit(" mutual"))).when(F.col("c_custkey") % 3 == 1, F.concat("n_name", F.lit(" Mutual Inc"))).otherwise("Nobody Knows").alias("text")
    )
    return enrich.canonical_carrier(rows, dim.select("ord", F.col("name").alias("alias"), "cocode"), dim)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes written with and without the names of codes, leading zeros and commas, in states of any case."""
    k = F.col("o_orderkey")
    dim = table(spark, sf_dir, "nation").select(F.lit("CA").alias("state"), (F.col("n_nationkey") + 22350).cast("string").alias("statute"), F.col("n_name").alias("description"))
    forms = F.array(*map(F.lit, ("CVC ", "Veh. Code ", "0", "", "vehcode", "F.S. ")))
    number = (k % 30 + 22350).cast("string")
    written = F.when(k % 5 == 0, F.concat(F.left(number, F.lit(2)), F.lit(","), F.right(number, F.lit(3)))).otherwise(number)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 0, "ca").when(k % 3 == 0, "NV").otherwise("CA").alias("state"), F.concat(F.element_at(forms, (k % 6 + 1).cast("int")), written).alias("statute"))
    return enrich.citation_descriptions(rows, dim).select("o_orderkey", "statute", "description")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("field_name"), F.when(F.col("value") < 50, "Unknown").otherwise(F.col("value").cast("string")).alias("original_value"), (F.col("value") + 1).cast("string").alias("new_value"), F.col("ts").alias("timestamp")
    )


def top_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.top_corrected(corrections(spark, sf_dir))


def recent_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.recent(corrections(spark, sf_dir)).select("id", "doc_id", "field_name", "original_value")


def correction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.totals(corrections(spark, sf_dir), 2)


def user_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 50, "up").otherwise("down").alias("action"))
    return feedback.ratings(actions).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def store_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents after an upsert, a delete and an insert-or-ignore."""
    orders = table(spark, sf_dir, "orders")
    old = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("version"))
    new = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") + 1_000_000_000).alias("version"))
    store = feedback.deleted(feedback.upserted(old, new, "doc_id", "version"), orders.where("o_custkey % 5 = 0").select(F.col("o_custkey").alias("doc_id")), ["doc_id"])
    return store.unionByName(feedback.new_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(-1).cast("long").alias("version")), store, ["doc_id"]))


def learned_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers learned from corrections whose values stand in the item tables."""
    prices = numbered_items(spark, sf_dir).where("item_no = 1").select(F.col("l_orderkey").alias("doc_id"), F.lit("amount").alias("field_name"), F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("new_value"))
    named = order_forms(spark, sf_dir, "table").withColumn("text", F.replace("text", F.lit("| No | Part |"), F.lit("| No | Part name |")))
    return feedback.learn_aliases(prices, named)


def learned_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns learned from corrected agencies that stand behind a label."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("doc_id"), F.lit("agency").alias("field_name"), F.lit("Unknown").alias("original_value"), F.col("c_name").alias("new_value"))
    return feedback.learn_patterns(rows, order_forms(spark, sf_dir))


def learned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown agencies filled by the learned pattern, the rest by contextual ones."""
    orders = table(spark, sf_dir, "orders")
    learned = learned_patterns(spark, sf_dir).groupBy("field_name", "pattern").count().select("field_name", "pattern", F.lit(1).alias("pattern_id"))
    record = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit("agency"), F.lit("report_number"))).alias("field_id"), F.lit("Unknown").alias("value"))
    docs = order_forms(spark, sf_dir)
    return enrich.learned_and_contextual_fill(record, docs, learned, enrich.POLICE_FILLS, enrich.PICKS)


EVAL = [
    Strategy("report_number", patterns=(r"REPORT NO\.: (OR-\d+(?: / X)?)",)), Strategy("customer", patterns=(r"CUSTOMER: ([^\n]+)",)), Strategy("date_time", patterns=(r"DATE: ([\d/]+)",)),
]


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms with planted errors read back and compared with the tables."""
    k = F.col("doc_id")
    docs = order_forms(spark, sf_dir).withColumn("text", F.when(k % 7 == 0, F.regexp_replace("text", "DATE: [^\n]+\n", "")).when(k % 11 == 0, F.regexp_replace("text", r"(REPORT NO\.: OR-\d+)", "$1 / X")).when(k % 13 == 0, F.regexp_replace("text", "(CUSTOMER: [^\n]+)", "$1,")).otherwise(F.col("text")))
    record = generate(docs, EVAL).select("doc_id", "field_id", "value", F.lit(0.8).alias("confidence"))
    base = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    truth = base.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.map_from_arrays(F.array(*map(F.lit, ("report_number", "customer", "date_time", "witnesses"))), F.array(F.concat(F.lit("OR-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")), F.col("c_name"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(None)))).alias("field_id", "value"))
    return evaluate.compare(truth, record)


def extraction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(compared(spark, sf_dir))


def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_document(compared(spark, sf_dir)).select("doc_id", "correct", "total")


def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.calibration(compared(spark, sf_dir))


def worst_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_failures(compared(spark, sf_dir).withColumn("status", F.when(F.col("status") == "CORRECT_BY_CONTAINMENT", "INCORRECT").otherwise(F.col("status")))).select("doc_id", "field_id", "truth", "extracted")


def fill_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = compared(spark, sf_dir).select("doc_id", "field_id", F.col("extracted").alias("value"))
    _, by_state, _ = evaluate.fill_rates(record, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("state")))
    return by_state


def structure_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ent.entities(order_forms(spark, sf_dir), ITEMS)
    return evaluate.structure_check(items, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(4).alias("least"))).select("doc_id", "found", "ok")


def record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a date, a number and a type; the fields without a value have no evidence."""
    o = table(spark, sf_dir, "orders")
    parts = {"date_time": F.date_format("o_orderdate", "MM/dd/yyyy"), "report_number": F.concat(F.lit("OR-"), "o_orderkey"), "location": F.when(F.col("o_orderkey") % 2 == 0, "12 Main"), "accident_type": F.when(F.col("o_orderkey") % 3 == 0, "theft").otherwise("crash")}
    record = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*parts.values()))).alias("field_id", "value"))
    seen = record.where("value is not null").select("doc_id", "field_id")
    return report.score_records(record, seen).select("doc_id", "score", F.size("reasons").alias("n_reasons"))


def police_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide police records, one per supplier, in which every field is present, Unknown, blank or null for some."""
    k = F.col("s_suppkey")
    some = lambda n, v: F.when(k % n == 0, v).when(k % n == 1, "Unknown").when(k % n == 2, " ")
    fields = {
        "report_number": some(4, F.concat(F.lit("R-"), k.cast("string"))), "date_time": some(5, F.lit("05/13/2024 10:30")), "location": some(6, F.concat(k.cast("string"), F.lit(" Main Street"))),
        "weather": some(7, F.lit("Rain")), "agency": some(5, F.col("s_name")), "officer": some(4, F.lit("J. Doe")), "accident_type": some(3, F.lit("Rear-end")),
        "ems_agency": some(5, F.lit("City EMS")), "contributing_factors": some(4, F.lit("speeding")), "property_damage": some(6, F.lit("a fence")),
    }
    return table(spark, sf_dir, "supplier").select(k.alias("doc_id"), *[v.alias(c) for c, v in fields.items()])


def report_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes over records with and without vehicles, parties and witnesses (every eighth has none)."""
    docs = crash_forms(spark, sf_dir).where("doc_id % 8 <> 0")
    return report.police_note(police_records(spark, sf_dir), ent.vehicles(docs), ent.parties(docs), ent.witnesses(docs)).select("doc_id", "note")


def adjuster_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide adjuster records, one per supplier."""
    k = F.col("s_suppkey")
    some = lambda n, v: F.when(k % n == 0, v).when(k % n == 1, "")
    fields = {
        "cause_of_loss": some(3, F.lit("Fire")), "inspection_date": some(4, F.lit("05/13/2024")), "inspection_firm": some(5, F.col("s_name")), "coverage_a": some(3, F.lit("$100,000")),
        "coverage_b": some(4, F.lit("$20,000")), "coverage_c": some(5, F.lit("$5,000")), "coverage_d": some(6, F.lit("none")), "coverages": some(4, F.lit("HO-3")), "officials": some(3, F.lit("Fire Dept")),
        "settlement": some(5, F.lit("$9,000")), "subrogation": some(4, F.lit("to be investigated")), "payment_summary": some(6, F.lit("$100 paid")), "recommendations": some(3, F.lit("close")),
    }
    return table(spark, sf_dir, "supplier").select(k.alias("doc_id"), (k % 2 == 0).alias("reserve"), *[v.alias(c) for c, v in fields.items()])


def adjuster_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.adjuster_note(adjuster_records(spark, sf_dir), F.col("reserve")).select("doc_id", "note")


def claim_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    ia = o.select(k.alias("claim_id"), F.element_at(F.array(*map(F.lit, ("Collision", "Fire", "UNKNOWN", "collision", ""))), (k % 5 + 1).cast("int")).alias("cause_of_loss"))
    police = o.select(k.alias("claim_id"), F.when(k % 3 == 0, "Collision").when(k % 3 == 1, "Rear-end collision").alias("accident_type"), F.when(k % 2 == 0, "No Damages").otherwise("dent").alias("first_damages"))
    return report.discrepancies(ia, police)


def record_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), F.when(F.col("o_orderstatus") == "O", "Agency").when(F.col("o_orderstatus") == "F", "Unknown").alias("agency"), F.when(k % 2 == 0, "Under INVESTIGATION").otherwise("none").alias("subrogation"),
        (k % 6).alias("n_parties"), (k % 3).alias("n_vehicles"), (k % 7 == 0).alias("reserve"), F.when(k % 2 == 0, F.concat(F.lit("$"), k.cast("string"))).alias("settlement"), F.when(k % 5 == 0, "$1").alias("coverage_a"),
    )
    return report.insights(o).select("doc_id", F.array_join("chips", "; ").alias("chips"), F.array_join("actions", "; ").alias("actions"))


def merged_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template per brand overlaid on the template of all types; field ids are part types."""
    shape = lambda df, lab: df.select("field_id", "position", F.array(F.struct(F.lit("global_regex").alias("name"), F.lit(1).alias("priority"), F.array(F.concat("field_id", F.lit(lab))).alias("patterns"))).alias("strategies"), (F.array("field_id") if lab == "b" else F.array().cast("array<string>")).alias("label_text"), F.lit("header" if lab == "b" else "").alias("expected_position"), F.array().cast("array<struct<type:string,value:string,values:array<string>,pattern:string>>").alias("validators"))
    fields = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("field_id")).agg(F.min("p_partkey").cast("int").alias("position"), F.max("p_size").alias("size"))
    merged = templates.merge(shape(fields.where("position % 3 <> 0"), "b"), shape(fields.where("position % 2 = 0"), "o"))
    return merged.select("field_id", F.col("strategies")[0]["patterns"][0].alias("pattern"), F.size("label_text").alias("labels"), "expected_position", "overlaid")


FILE_NAMES = ("claim_IA_1", "my-acord.form", "fl_HSMV-x", "Police 2024", "misc", "HO90010a", "the.property.photos", "adjuster_acord", "diary", "hsmvia", "ia hsmv", "malacord")


def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.element_at(F.array(*map(F.lit, FILE_NAMES)), (F.col("o_orderkey") % len(FILE_NAMES) + 1).cast("int")), F.lit("_"), F.col("o_orderkey") % 7, F.lit(".pdf")).alias("name"))
    return names.select("o_orderkey", scans.route(F.col("name")).alias("doc_type"))


#: Forms in a file of those that arrive.
FORMS_A_FILE = 100_000


def streamed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items read from forms that arrive as files: the same rows as in batch."""
    folder = shared_folder(spark)
    files = max(4, table(spark, sf_dir, "orders").count() // FORMS_A_FILE)  # their size is bounded, not their number
    order_forms(spark, sf_dir).repartition(files).write.parquet(f"{folder}/in")
    query = jobs.extract_arriving(spark, f"{folder}/in", "doc_id long, text string", lambda d: ent.entities(d, ITEMS), f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", F.col("entity_id").cast("int").alias("item_no"), "name", F.col("quantity").cast("int").alias("quantity"))


_ITEMS = """
    WITH items AS (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS item_no
        FROM lineitem JOIN part ON l_partkey = p_partkey
    )
"""
_COMPARED = """
    WITH rows AS (
        SELECT o_orderkey AS doc_id, 'report_number' AS field_id, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 THEN 'CORRECT_BY_CONTAINMENT' ELSE 'CORRECT' END AS status FROM orders
        UNION ALL SELECT o_orderkey, 'customer', CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0 THEN 'CORRECT_AFTER_TRIM' ELSE 'CORRECT' END FROM orders
        UNION ALL SELECT o_orderkey, 'date_time', CASE WHEN o_orderkey % 7 = 0 THEN 'MISSED' ELSE 'CORRECT' END FROM orders
        UNION ALL SELECT o_orderkey, 'witnesses', 'TRUE_NEGATIVE' FROM orders
    )
"""
ORACLE_SQL = {
    "adjuster_notes": """
        SELECT s_suppkey AS doc_id, concat_ws(' ',
            'The cause of loss was ' || CASE WHEN s_suppkey % 3 = 0 THEN 'Fire' ELSE 'not specified' END || '.',
            'Coverage A was inspected on ' || CASE WHEN s_suppkey % 4 = 0 THEN '05/13/2024' ELSE 'not recorded' END || ' by ' || CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE 'not recorded' END || '.',
            'Coverage A is ' || CASE WHEN s_suppkey % 3 = 0 THEN '$100,000' ELSE 'N/A' END || '.', 'Coverage B is ' || CASE WHEN s_suppkey % 4 = 0 THEN '$20,000' ELSE 'N/A' END || '.',
            'Coverage C is ' || CASE WHEN s_suppkey % 5 = 0 THEN '$5,000' ELSE 'N/A' END || '.', 'Coverage D is ' || CASE WHEN s_suppkey % 6 = 0 THEN 'none' ELSE 'N/A' END || '.',
            CASE WHEN s_suppkey % 4 = 0 THEN 'The applicable coverages and policy form are as follows: HO-3.' END,
            CASE WHEN s_suppkey % 3 = 0 THEN 'A report was filed with the following officials: Fire Dept.' ELSE 'No fire or police report was filed.' END,
            'The settlement amount is ' || CASE WHEN s_suppkey % 5 = 0 THEN '$9,000' ELSE 'not yet determined' END || '.',
            'Subrogation is ' || CASE WHEN s_suppkey % 4 = 0 THEN 'to be investigated' ELSE 'not determined' END || '.',
            CASE WHEN s_suppkey % 6 = 0 THEN 'Summary of payments made to date: $100 paid.' ELSE 'No payment summary data was available from ClaimCenter.' END,
            CASE WHEN s_suppkey % 3 = 0 THEN 'Adjuster recommendations: close.' ELSE 'No adjuster recommendations have been entered.' END,
            CASE WHEN s_suppkey % 2 = 0 THEN 'WARNING: The word reserve appears in this document and requires adjuster review.' END) AS note
        FROM supplier
    """,
    "items_roundtrip": _ITEMS + "SELECT l_orderkey AS doc_id, item_no::INT AS entity_no, item_no::INT AS item_no, p_name AS name, l_quantity::INT AS quantity, round(l_extendedprice, 2) AS price, l_returnflag AS code FROM items",
    "streamed_items": _ITEMS + "SELECT l_orderkey AS doc_id, item_no::INT AS item_no, p_name AS name, l_quantity::INT AS quantity FROM items",
    "flattened_tables": _ITEMS
    + """
        , cells AS (
            SELECT l_orderkey AS doc_id, unnest(['No', 'Part', 'Quantity', 'Price', 'Code']) AS header,
                   unnest([item_no::VARCHAR, p_name, l_quantity::INT::VARCHAR, '$' || format('{:,.2f}', l_extendedprice), l_returnflag]) AS cell FROM items)
        SELECT doc_id, header, count(*) AS cells, max(cell) AS largest FROM cells GROUP BY ALL
    """,
    "mined_pairs": _ITEMS
    + """
        , last AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY item_no DESC) = 1)
        SELECT o_orderkey AS doc_id, 'REPORT NO' AS key, 'OR-' || lpad(o_orderkey::VARCHAR, 8, '0') AS value FROM orders
        UNION ALL SELECT o_orderkey, 'DATE', strftime(o_orderdate, '%m/%d/%Y') FROM orders
        UNION ALL SELECT o_orderkey, 'CUSTOMER', c_name FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT l_orderkey, 'Quantity', l_quantity::INT::VARCHAR FROM last
        UNION ALL SELECT l_orderkey, 'Code', l_returnflag FROM last
        UNION ALL SELECT o_orderkey, unnest(['Report', 'Ab', 'key/2']), unnest(['|x|', o_orderkey::VARCHAR, '**']) FROM orders
    """,
    "joined_labels": r"""
        SELECT o_orderkey AS doc_id, 'REPORT NO.: OR-' || o_orderkey || chr(10) || chr(10) || 'CUSTOMER: ' || c_name || chr(10) || 'plain line' || chr(10) || chr(10)
               || 'Date/Time: 1/2/2024 10:30' || chr(10) || chr(10) || 'DRIVER 1' AS text
        FROM orders JOIN customer ON o_custkey = c_custkey
    """,
    "compound_lines": """
        SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey || chr(10) || concat_ws(chr(10), CASE o_orderkey % 8
            WHEN 0 THEN concat_ws(chr(10), 'Weather: Rain', 'Light Conditions: Dark - Lighted', 'Light Condition: Dark - Lighted', 'Road Surface: Wet')
            WHEN 1 THEN concat_ws(chr(10), 'Weather: clear', 'Light Conditions: dawn', 'Light Condition: dawn')
            WHEN 2 THEN concat_ws(chr(10), 'Road Alignment Curve Direction Eof Crash Same Direction (Rear End) Areas of Damage x', 'Direction of Crash: Same Direction (Rear End)', 'Manner of Collision: Same Direction (Rear End)', 'Type of Crash: Same Direction (Rear End)')
            WHEN 3 THEN concat_ws(chr(10), 'CASE NUMBER 7 WEATHER Fog TYPE OF Angle / 2', 'Weather: Fog')
            WHEN 4 THEN concat_ws(chr(10), 'TYPE OF Sideswipe / 2', 'Direction of Crash: Sideswipe', 'Manner of Collision: Sideswipe', 'Type of Crash: Sideswipe')
            WHEN 5 THEN 'TYPE OF COLLISION x'
            WHEN 6 THEN concat_ws(chr(10), 'COLLISION TYPE Head On TOTAL VEHICLES 2', 'Direction of Crash: Head On', 'Manner of Collision: Head On', 'Type of Crash: Head On')
            ELSE 'the weather event: none' END, 'end') AS text
        FROM orders
    """,
    "narrative_split": """
        SELECT o_orderkey AS doc_id, 'A' || o_orderkey || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'no story' END AS before,
               CASE WHEN o_orderkey % 2 = 0 THEN 'SECTION 4 - OFFICER NARRATIVE' || chr(10) || 'It rained' ELSE '' END AS narrative, 'ab c' || o_orderkey AS plain FROM orders
    """,
    "conversation_texts": "SELECT conv_id AS doc_id, string_agg(coalesce(t, ''), chr(10) ORDER BY turn) AS text, count(*) AS n_pages FROM (SELECT conv_id, turn, min(text) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id",
    "checked_status": """
        -- A mark before an option checks it, and so does one right behind it: the mark of the next option.
        SELECT o_orderkey AS doc_id, o_orderstatus AS value, 0.85::DOUBLE AS preset FROM orders
        UNION ALL SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'O' ELSE 'F' END, 0.85 FROM orders WHERE o_orderstatus <> 'O'
    """,
    "nearby_customer": """
        SELECT o_orderkey AS doc_id, 'customer' AS field_id, c_name AS value FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT o_orderkey, 'after', 'DATE: ' || strftime(o_orderdate, '%m/%d/%Y') FROM orders
    """,
    "spatial_fields": """
        SELECT o_orderkey AS doc_id, 'report_number' AS field_id, lpad(o_orderkey::VARCHAR, 8, '0') AS value, 1 AS page, 150.0::DOUBLE AS label_distance FROM orders
        UNION ALL SELECT o_orderkey, 'below_report', 'DATE', 1, 14.0 FROM orders
        UNION ALL SELECT o_orderkey, 'own', 'OMER', 1, 0.0 FROM orders
        -- Nothing stands left of a label; the date stands right of its own; above the status, of those equally far left, stands the first line.
        UNION ALL SELECT o_orderkey, 'exact', strftime(o_orderdate, '%m/%d/%Y'), 1, 150.0 FROM orders
        UNION ALL SELECT o_orderkey, 'above', 'REPORT NO.', 1, 42.0 FROM orders
    """,
    "value_boxes": "SELECT o_orderkey AS doc_id, lower(c_name) AS value, 1 AS page, 200.0::DOUBLE AS l, 668.0::DOUBLE AS t FROM orders JOIN customer ON o_custkey = c_custkey",
    "entity_boxes": """
        WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS shape, s_name, lpad(s_suppkey::VARCHAR, 17, 'A') AS vin FROM supplier),
        places AS (
            SELECT shape, field_id, line FROM (VALUES
                (0, 'vehicles[0].vin', 2), (0, 'vehicles[0].owner_name', 3), (0, 'vehicles[0].plate', 5), (0, 'operators[0].name', 14), (0, 'operators[0].address', 15), (0, 'passengers[0].name', 20), (0, 'pedestrians[0].dob', 23),
                (1, 'vehicles[0].vin', 1), (1, 'vehicles[0].plate', 1), (1, 'operators[0].name', 5), (1, 'operators[0].dob', 5), (1, 'operators[0].license_number', 5), (1, 'passengers[0].name', NULL), (1, 'passengers[0].dob', 8),
                (1, 'pedestrians[0].name', 10), (1, 'pedestrians[0].dob', 10),
                (2, 'vehicles[0].vin', 3), (2, 'vehicles[0].plate', 4), (2, 'vehicles[0].owner_name', 5), (2, 'operators[0].name', 11), (2, 'operators[0].dob', 11), (2, 'operators[0].address', NULL), (2, 'pedestrians[0].name', 17),
                (3, 'vehicles[0].plate', 2)) AS t (shape, field_id, line)),
        v AS (
            SELECT k, p.*, CASE split_part(field_id, '].', 2) WHEN 'vin' THEN vin WHEN 'plate' THEN CASE WHEN p.shape = 3 THEN 'TX-' || lpad(k::VARCHAR, 5, '0') ELSE 'P-' || k END WHEN 'owner_name' THEN 'same as driver'
                       WHEN 'license_number' THEN 'D' || lpad(k::VARCHAR, 6, '0') WHEN 'address' THEN k || ' Main Street' || CASE WHEN p.shape = 2 THEN ', Waco' ELSE '' END
                       WHEN 'name' THEN CASE WHEN field_id LIKE 'operators%' THEN CASE WHEN p.shape = 0 THEN s_name ELSE 'Kay Alan' END WHEN field_id LIKE 'passengers%' THEN CASE WHEN p.shape = 0 THEN 'Pat Doe' ELSE 'Pat L. Doe' END
                            ELSE CASE WHEN p.shape = 1 THEN 'Lou Roe' ELSE 'Pat Doe' END END
                       ELSE CASE WHEN field_id LIKE 'operators%' THEN '01/02/1990' WHEN p.shape = 1 AND field_id LIKE 'pedestrians%' THEN '5/6/1992' ELSE '3/4/1991' END END AS value
            FROM s JOIN places p ON s.shape = p.shape)
        SELECT k AS doc_id, field_id, value, (line // 20 + 1)::INT AS page, (700 - line % 20 * 20)::DOUBLE AS t FROM v
    """,
    "widget_values": "SELECT o_orderkey AS doc_id, 'weather' AS field_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Fog' WHEN o_orderstatus = 'O' THEN 'Rain' WHEN o_orderstatus = 'F' THEN 'Clear' ELSE 'Weather other' END AS value FROM orders",
    "loss_notices": """
        WITH r AS (
            SELECT c_custkey AS k, c_custkey % 4 AS shape, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' Inc.' WHEN 1 THEN 'Acme LLC' || chr(10) || 'Company Big Mutual' ELSE 'Unknown Agency' END AS agency, CASE WHEN c_custkey % 4 < 2 THEN 'Big Mutual' ELSE 'Unknown Carrier' END AS carrier,
                   CASE c_custkey % 4 WHEN 0 THEN 'P-' || c_custkey WHEN 1 THEN 'AB-' || c_custkey WHEN 2 THEN c_custkey::VARCHAR ELSE 'Unknown Policy' END AS policy_number, CASE WHEN c_custkey % 4 < 2 THEN 'Joe Doe' ELSE 'Unknown Insured' END AS named_insured,
                   ['01/02/2024', '2024-01-02', 'Unknown Date', 'Unknown Date'][c_custkey % 4 + 1] AS date_of_loss,
                   CASE c_custkey % 4 WHEN 0 THEN 'water * damage' || chr(10) || 'in unit ' || c_custkey WHEN 1 THEN 'fire & smoke' WHEN 2 THEN '' ELSE 'No description provided' END AS description_of_loss
            FROM customer)
        SELECT k AS doc_id, agency, carrier, policy_number, named_insured, date_of_loss, description_of_loss, [100.0, 100.0, 40.0, 0.0][shape + 1]::DOUBLE AS accuracy_score,
               array_to_string(list_transform([[agency <> 'Unknown Agency', shape = 9], [shape < 3, shape = 9], [shape < 2, shape = 9], [shape < 2, shape = 9], [shape < 3, shape = 9]], lambda x, i:
                   CASE WHEN x[1] THEN 'Found ' ELSE 'Missing ' END || ['Agency Name', 'Policy Number', 'Named Insured', 'Date of Loss', 'Description of Loss'][i]), '; ') AS accuracy_reasons,
               trim('ACORD Property Loss Notice received from ' || replace(agency, chr(10), ' ') || '. The carrier is ' || carrier || ' under Policy ' || policy_number || ' for Named Insured ' || named_insured || '. The Date of Loss is reported as ' || replace(date_of_loss, '/', '')
                    || '. Reported Description ' || replace(replace(replace(description_of_loss, ' *', ''), ' &', ''), chr(10), ' ')) AS summary
        FROM r
    """,
    "custom_fields_found": """
        SELECT o_orderkey AS doc_id, unnest(['Broker', 'ORDER REPORT FORM', 'section 2', 'Weather Conditions']) AS field_name, unnest(['Not Found', substr(o_orderpriority, 1, 1), 'ITEMS', 'Sunny, warm']) AS value FROM orders
    """,
    "positional_values": """
        SELECT o_orderkey AS doc_id, 'date' AS field_id, 'DATE: ' || strftime(o_orderdate, '%m/%d/%Y') AS value FROM orders
        UNION ALL SELECT o_orderkey, 'form', 'ORDER REPORT FORM ' || substr(o_orderpriority, 1, 1) FROM orders
        UNION ALL SELECT o_orderkey, 'beyond', 'Unknown' FROM orders
    """,
    "glued_values": "SELECT p_partkey, (p_partkey % 20 + 2000)::VARCHAR AS year, CASE WHEN p_partkey % 2 = 0 THEN 'FORD' ELSE 'FORDSON' END AS make, 'M' || p_size AS model, '1/2/' || (p_partkey % 20 + 2000) AS day, '10:30 AM' AS clock FROM part",
    "crash_vehicles": """
        WITH s AS (SELECT *, s_suppkey AS k, s_suppkey % 4 AS shape, (s_suppkey % 30 + 1990)::VARCHAR AS year, 'Make' || s_suppkey AS make, lpad(s_suppkey::VARCHAR, 17, 'A') AS vin FROM supplier)
        SELECT k AS doc_id, 1 AS entity_no, year, make, 'Runner' AS model, CASE WHEN shape IN (0, 2) THEN 'Red' ELSE 'Unknown' END AS color, CASE WHEN shape = 3 THEN 'Unknown' ELSE vin END AS vin,
               CASE WHEN shape = 3 THEN 'TX-' || lpad(k::VARCHAR, 5, '0') ELSE 'P-' || k END AS plate, CASE shape WHEN 0 THEN s_name WHEN 2 THEN 'Kay Alan' ELSE 'Unknown' END AS owner_name,
               CASE shape WHEN 0 THEN k || ' Main Street' WHEN 2 THEN k || ' Main Street, Waco' ELSE 'Unknown' END AS owner_address, 'Unknown' AS towed FROM s
        UNION ALL SELECT k, 2, CASE WHEN shape = 0 THEN (k % 10 + 2010)::VARCHAR ELSE '2010' END, 'Other', CASE WHEN shape = 0 THEN 'Unknown' ELSE 'Plain' END, CASE WHEN shape = 2 THEN 'Blue' ELSE 'Unknown' END, 'Unknown', 'Unknown', 'Unknown', 'Unknown',
               CASE shape WHEN 0 THEN 'yes' WHEN 2 THEN 'Yes' ELSE 'Unknown' END FROM s WHERE shape < 3
    """,
    "crash_parties": """
        WITH s AS (SELECT *, s_suppkey AS k, s_suppkey % 4 AS shape FROM supplier WHERE s_suppkey % 4 < 3)
        SELECT k AS doc_id, 1 AS party_no, 'Operator' AS role, CASE WHEN shape = 0 THEN s_name ELSE 'Kay Alan' END AS name, CASE shape WHEN 0 THEN k || ' Main Street' WHEN 2 THEN k || ' Main Street, Waco' ELSE 'Unknown' END AS address,
               CASE WHEN shape = 1 THEN 'Unknown' WHEN k % 8 = 0 THEN 'bruise; alcohol' ELSE 'bruise' END AS condition, CASE WHEN shape = 1 THEN 'Unknown' ELSE 'bruise' END AS injuries,
               CASE WHEN k % 8 = 0 THEN 'alcohol' ELSE 'None reported' END AS substance_involvement, shape = 2 AS transported, 'speeding, ' || k AS citations FROM s
        UNION ALL SELECT k, 2, 'Passenger', CASE WHEN shape = 0 THEN 'Pat Doe' ELSE 'Pat L. Doe' END, 'Unknown', CASE WHEN shape = 0 THEN 'Unknown' ELSE 'bruise' END, CASE WHEN shape = 0 THEN 'Unknown' ELSE 'bruise' END, 'None reported', true, 'None' FROM s WHERE shape < 2
        UNION ALL SELECT k, CASE WHEN shape = 2 THEN 2 ELSE 3 END, 'Pedestrian', CASE shape WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Lou Roe' ELSE 'Pat Doe' END, 'Unknown', 'Unknown', 'Unknown', 'None reported', false, 'None' FROM s
    """,
    "crash_people": """
        WITH s AS (SELECT *, s_suppkey AS k, s_suppkey % 4 AS shape FROM supplier)
        SELECT k AS doc_id, 1 AS entity_no, CASE WHEN shape = 3 THEN 'Victim' ELSE 'Operator' END AS role, CASE WHEN shape = 0 THEN s_name ELSE 'Kay Alan' END AS name,
               CASE WHEN shape IN (1, 2) THEN '01/02/1990' ELSE 'Unknown' END AS dob, CASE WHEN shape = 1 THEN 'D' || lpad(k::VARCHAR, 6, '0') ELSE 'Unknown' END AS license_number, CASE WHEN shape = 2 THEN 'City Hospital' ELSE 'Unknown' END AS transported_to FROM s
        UNION ALL SELECT k, 2, CASE shape WHEN 2 THEN 'Pedestrian' WHEN 3 THEN 'Suspect' ELSE 'Passenger' END, CASE WHEN shape = 1 THEN 'Pat L. Doe' ELSE 'Pat Doe' END, CASE WHEN shape IN (1, 3) THEN '3/4/1991' ELSE 'Unknown' END, 'Unknown',
               CASE WHEN shape = 0 THEN 'City Hospital' ELSE 'Unknown' END FROM s
        UNION ALL SELECT k, 3, 'Pedestrian', CASE WHEN shape = 0 THEN 'Unknown' ELSE 'Lou Roe' END, CASE WHEN shape = 0 THEN '3/4/1991' ELSE '5/6/1992' END, 'Unknown', 'Unknown' FROM s WHERE shape < 2
    """,
    "crash_witnesses": """
        SELECT s_suppkey AS doc_id, 1 AS entity_no, CASE s_suppkey % 4 WHEN 0 THEN 'Ann B. Smith' WHEN 1 THEN 'Ann Smith' ELSE 'Ann Jones' END AS name, CASE s_suppkey % 4 WHEN 1 THEN s_suppkey || ' Elm St' ELSE 'Unknown' END AS address,
               CASE s_suppkey % 4 WHEN 0 THEN '555-123-4567' WHEN 1 THEN '(555) 123-4567' ELSE 'Unknown' END AS phone, CASE WHEN s_suppkey % 4 < 2 THEN 'saw it' ELSE 'Unknown' END AS statement FROM supplier WHERE s_suppkey % 4 < 3
        UNION ALL SELECT s_suppkey, 2, 'Bo Li', 'Unknown', 'Unknown', 'Unknown' FROM supplier WHERE s_suppkey % 4 = 1
    """,
    "learned_headers": "SELECT s_suppkey AS doc_id, 'Unknown' AS vin_before, 'Unknown' AS plate_before, 'C-' || s_suppkey AS vin, 'R-' || s_suppkey AS plate, 'D-' || s_suppkey AS license_number FROM supplier",
    "decoded_records": """
        WITH c AS (SELECT 'S' || n_regionkey AS state, n_nationkey::VARCHAR AS code, n_name AS label FROM nation)
        SELECT o_orderkey AS doc_id, 'weather' AS field_id, coalesce(a.label, (o_orderkey % 25)::VARCHAR) || ', ' || coalesce(b.label, '3') || ', x' AS value
        FROM orders LEFT JOIN c a ON a.state = 'S' || (o_orderkey % 5) AND a.code = (o_orderkey % 25)::VARCHAR LEFT JOIN c b ON b.state = 'S' || (o_orderkey % 5) AND b.code = '3'
    """,
    "carrier_names": "SELECT c_custkey, n_name || ' MUTUAL' AS carrier, r_name AS carrier_group FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "canonical_carriers": """
        SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN lower(n_name) || ' mutual' WHEN 1 THEN n_name || ' Mutual Inc' ELSE 'Nobody Knows' END AS text,
               CASE WHEN c_custkey % 3 = 2 THEN 'Nobody Knows' ELSE n_name || ' MUTUAL' END AS canonical FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
    "citations": """
        WITH r AS (SELECT o_orderkey AS k, (o_orderkey % 30 + 22350)::VARCHAR AS number FROM orders)
        SELECT k AS o_orderkey, ['CVC ', 'Veh. Code ', '0', '', 'vehcode', 'F.S. '][k % 6 + 1] || CASE WHEN k % 5 = 0 THEN left(number, 2) || ',' || right(number, 3) ELSE number END AS statute,
               CASE WHEN k % 6 <> 5 AND NOT (k % 2 = 1 AND k % 3 = 0) THEN n_name END AS description
        FROM r LEFT JOIN nation ON k % 30 = n_nationkey
    """,
    "top_corrections": """
        WITH t AS (SELECT event_type AS field_name, count(*) AS corrections FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
        SELECT field_name, corrections, round(100.0 * corrections / max(corrections) OVER ())::INT AS percent FROM t
    """,
    "recent_corrections": "SELECT event_id AS id, user_id AS doc_id, event_type AS field_name, CASE WHEN value < 50 THEN 'Unknown' ELSE value::VARCHAR END AS original_value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "correction_totals": "SELECT (SELECT sum(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 2))::BIGINT AS top_total, (SELECT count(*) FROM events) AS true_total",
    "user_ratings": "SELECT CASE WHEN value > 50 THEN 1 ELSE -1 END AS score, count(*) AS n FROM events GROUP BY 1",
    "store_after_changes": """
        WITH u AS (SELECT o_custkey AS doc_id, max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END) AS version FROM orders GROUP BY 1), s AS (SELECT * FROM u WHERE doc_id % 5 <> 0)
        SELECT * FROM s UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM s)
    """,
    "learned_aliases": "SELECT 'amount' AS canonical_field, unnest(['price', 'no', 'quantity']) AS alias_header",
    "extraction_metrics": _COMPARED
    + """
        , m AS (SELECT field_id, count_if(starts_with(status, 'CORRECT'))::BIGINT AS correct, 0::BIGINT AS incorrect, count_if(status = 'MISSED')::BIGINT AS missed, 0::BIGINT AS spurious,
                       count_if(status = 'TRUE_NEGATIVE')::BIGINT AS true_negative FROM rows GROUP BY ROLLUP (field_id))
        SELECT *, CASE WHEN correct > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN correct + missed > 0 THEN round(correct / (correct + missed), 4) ELSE 0.0 END::DOUBLE AS recall,
               CASE WHEN correct + missed > 0 THEN round(correct / (correct + missed), 4) ELSE 1.0 END::DOUBLE AS accuracy,
               CASE WHEN correct > 0 THEN round(2 * round(correct / (correct + missed), 4) / (1 + round(correct / (correct + missed), 4)), 4) ELSE 0.0 END::DOUBLE AS f1
        FROM m
    """,
    "document_metrics": _COMPARED + "SELECT doc_id, count_if(starts_with(status, 'CORRECT') OR status = 'TRUE_NEGATIVE')::BIGINT AS correct, count(*) AS total FROM rows GROUP BY doc_id",
    "confidence_calibration": _COMPARED + "SELECT 0.8::DOUBLE AS mean_correct, NULL::DOUBLE AS mean_incorrect, count_if(starts_with(status, 'CORRECT'))::BIGINT AS n_correct, 0::BIGINT AS n_incorrect FROM rows",
    "worst_failures": _COMPARED + "SELECT doc_id, field_id, 'OR-' || lpad(doc_id::VARCHAR, 8, '0') AS truth, 'OR-' || lpad(doc_id::VARCHAR, 8, '0') || ' / X' AS extracted FROM rows WHERE status = 'CORRECT_BY_CONTAINMENT' ORDER BY doc_id LIMIT 10",
    "fill_by_status": """
        WITH f AS (SELECT o_orderstatus AS state, CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE 0.75 END AS r FROM orders) SELECT state, count(*) AS documents, round(avg(r), 4)::DOUBLE AS fill_rate FROM f GROUP BY state
    """,
    "structure_checks": "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS doc_id, coalesce(n, 0) AS found, coalesce(n, 0) >= 4 AS ok FROM orders LEFT JOIN n ON o_orderkey = l_orderkey",
    "record_scores": """
        WITH p AS (SELECT o_orderkey AS doc_id, o_orderkey % 2 = 0 AS placed, o_orderkey % 3 = 0 AS theft FROM orders)
        SELECT doc_id, round((1.5 + 1.5 + 0.7 + CASE WHEN placed THEN 1.5 ELSE 0 END) / (1.5 * 3 + 1.2 * 2 + 0.7 + CASE WHEN theft THEN 0 ELSE 0.5 END) * 100, 1)::DOUBLE AS score,
               (2 + CASE WHEN theft THEN 0 ELSE 1 END + CASE WHEN placed THEN 0 ELSE 1 END)::INT AS n_reasons FROM p
    """,
    "report_notes": """
        WITH r AS (
            SELECT s_suppkey AS k, s_name,
                   CASE s_suppkey % 3 WHEN 0 THEN 'Rear-end' WHEN 1 THEN 'Unknown' ELSE 'an unspecified type of collision' END AS kind,
                   CASE s_suppkey % 5 WHEN 0 THEN '05/13/2024 10:30' WHEN 1 THEN 'Unknown' ELSE 'an unknown date and time' END AS happened,
                   CASE s_suppkey % 6 WHEN 0 THEN s_suppkey || ' Main Street' WHEN 1 THEN 'Unknown' ELSE 'an unknown location' END AS place,
                   CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN 'Unknown' ELSE 'the responding agency' END AS agency,
                   CASE s_suppkey % 4 WHEN 0 THEN 'J. Doe' WHEN 1 THEN 'Unknown' ELSE 'an unidentified officer' END AS officer
            FROM supplier)
        SELECT k AS doc_id, concat_ws(' ', 'A ' || kind || ' collision occurred on ' || happened || ' at ' || place || '.',
                   CASE WHEN k % 7 = 0 THEN 'Weather conditions were reported as Rain.' END,
                   'The incident was investigated by ' || agency || ', reporting officer ' || officer || '.',
                   CASE WHEN k % 4 = 0 THEN 'Report number: R-' || k || '.' END,
                   CASE WHEN k % 5 = 0 THEN 'EMS responded; agency: City EMS.' END,
                   CASE WHEN k % 4 = 3 THEN 'A total of 1 vehicle was involved.'
                        WHEN k % 8 <> 0 THEN 'A total of 2 vehicles were involved. 1 operator was identified. 1 party reported injuries. ' || CASE WHEN k % 4 = 1 THEN '2 witnesses were' ELSE '1 witness was' END || ' identified at the scene.' END,
                   CASE WHEN k % 4 = 0 THEN 'Contributing factors noted: speeding.' END,
                   CASE WHEN k % 6 = 0 THEN 'Non-vehicle property damage reported: a fence.' END) AS note
        FROM r
    """,
    "claim_discrepancies": """
        WITH c AS (SELECT o_orderkey AS claim_id, ['Collision', 'Fire', 'UNKNOWN', 'collision', ''][o_orderkey % 5 + 1] AS cause,
                          CASE o_orderkey % 3 WHEN 0 THEN 'Collision' WHEN 1 THEN 'Rear-end collision' END AS kind, o_orderkey % 2 = 0 AS undamaged FROM orders)
        SELECT claim_id, 'Causality Mismatch' AS type, 'IA claims "' || cause || '" but Police report states "' || kind || '".' AS description
        FROM c WHERE kind IS NOT NULL AND (cause = 'Fire' OR (cause IN ('Collision', 'collision') AND kind <> 'Collision'))
        UNION ALL
        SELECT claim_id, 'Damage Contradiction', 'Police report indicates "No Damages" for Vehicle 1, but IA reports a Collision loss.' FROM c WHERE undamaged AND cause = 'Collision'
    """,
    "record_insights": """
        SELECT o_orderkey AS doc_id,
               concat_ws('; ', CASE WHEN o_orderkey % 7 = 0 THEN 'Reserve language detected' END, CASE WHEN o_orderkey % 2 = 0 THEN 'Subrogation opportunity' END,
                   CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 6) || ' parties identified' END, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 3) || ' vehicles' END,
                   CASE WHEN o_orderkey % 5 = 0 THEN 'Coverage A confirmed' END) AS chips,
               coalesce(nullif(concat_ws('; ', CASE WHEN o_orderkey % 7 = 0 THEN 'Set reserve — ' || CASE WHEN o_orderkey % 2 = 0 THEN '$' || o_orderkey ELSE 'amount TBD' END END,
                   CASE WHEN o_orderkey % 2 = 0 THEN 'File subrogation preservation letter' END, CASE WHEN o_orderstatus <> 'O' THEN 'Request agency supplement' END,
                   CASE WHEN o_orderkey % 6 > 3 THEN 'Review liability across all parties' END), ''), 'Review extracted fields and submit to ClaimCenter') AS actions
        FROM orders
    """,
    "merged_templates": """
        WITH f AS (SELECT p_type AS field_id, min(p_partkey) AS position FROM part GROUP BY 1)
        SELECT field_id, field_id || CASE WHEN position % 2 = 0 THEN 'o' ELSE 'b' END AS pattern, CASE WHEN position % 3 <> 0 THEN 1 END AS labels,
               CASE WHEN position % 3 <> 0 THEN 'header' END AS expected_position, position % 2 = 0 AS overlaid
        FROM f WHERE position % 3 <> 0 OR position % 2 = 0
    """,
    "routed_files": """
        SELECT o_orderkey, ['ia', 'acord', 'hsmv', 'police', 'police', 'hsmv', 'ia', 'ia', 'police', 'hsmv', 'ia', 'police'][o_orderkey % 12 + 1] AS doc_type FROM orders
    """,
    "learned_values": """
        SELECT o_orderkey AS doc_id, 'agency' AS field_id, c_name AS value FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT o_orderkey, 'report_number', 'FORM' FROM orders -- "REPORT FORM" comes first
    """,
}

QUERIES = {
    f.__name__: f
    for f in (
        items_roundtrip, flattened_tables, mined_pairs, joined_labels, compound_lines, narrative_split, conversation_texts, checked_status, nearby_customer,
        spatial_fields, value_boxes, entity_boxes, widget_values, loss_notices, custom_fields_found, positional_values, glued_values, crash_vehicles, crash_parties, crash_people, crash_witnesses, learned_headers,
        decoded_records, carrier_names, canonical_carriers, citations, top_corrections, recent_corrections, correction_totals, user_ratings, store_after_changes,
        learned_aliases, learned_patterns, learned_values, extraction_metrics, document_metrics, confidence_calibration, worst_failures, fill_by_status, structure_checks,
        record_scores, report_notes, adjuster_notes, claim_discrepancies, record_insights, merged_templates, routed_files, streamed_items,
    )
}
