"""Records without a template: key-value mining, first-match records, positional records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import once
from ..functions.text import lines_of, plain_paragraph, strip_headings
from ..functions.values import UNKNOWN, stripped


# What a mined pair may be, what stays of its key, what may stand between a custom field and its value; the
# shapes of the values of a loss notice, what stands for a missing one, and its sentences.
LONGEST_KEY, LONGEST_VALUE, LONGEST_CUSTOM = 50, 200, 100
NO_KEY = r"[^a-zA-Z0-9\s/]"
CUSTOM = r"(?:[:\s\-]+)?([A-Za-z0-9\s,\.]+)(?=\n|$)"
NOTICE = {
    "agency": (r"(?i)(?:agency|producer)(?:[:\s]+)?([A-Za-z\s,]+(?:Inc\.|LLC)?)(?=\n|policy|insured)", "Unknown Agency"),
    "carrier": (r"(?i)company(?:[:\s]+)?([A-Za-z\s,]+(?:Insurance|Mutual|Group)?)(?=\n|policy|insured)", "Unknown Carrier"),
    "policy_number": (r"(?i)policy number(?:[:\s]+)?([A-Z0-9-]+)", "Unknown Policy"),
    "named_insured": (r"(?i)named insured(?:[:\s]+)?([A-Za-z\s,]+)(?=\n|date|location)", "Unknown Insured"),
    "date_of_loss": (r"(?i)date of loss(?:[:\s]+)?([\d\/\-]+)", "Unknown Date"),
    "description_of_loss": (r"(?is)description of loss(?:[:\s]+)?(.*?)(?=\n[A-Z\s]+:|signature|$)", "No description provided"),
}
COUNTED = {"agency": "Agency Name", "policy_number": "Policy Number", "named_insured": "Named Insured", "date_of_loss": "Date of Loss", "description_of_loss": "Description of Loss"}
SUMMARY = (
    "ACORD Property Loss Notice received from ", "agency", ". The carrier is ", "carrier", " under Policy #", "policy_number", " for Named Insured ", "named_insured",
    ". The Date of Loss is reported as ", "date_of_loss", ". Reported Description: ", "description_of_loss",
)
# End of the fixed values.


def mined(text: Column) -> Column:
    """array<struct<key, value>> of a text's ``key: value`` lines, in order: keys under 50 and values under 200 characters."""

    def pair(line: Column) -> Column:
        at = F.instr(line, ":")
        both = F.struct(stripped(F.left(line, at - 1)).alias("key"), stripped(F.substring(line, at + 1, F.length(line))).alias("value"))

        def tidy(p: Column) -> Column:
            fits = (p["key"] != "") & (p["value"] != "") & (F.length(p["key"]) < LONGEST_KEY) & (F.length(p["value"]) < LONGEST_VALUE)
            return F.when(fits, F.struct(stripped(F.regexp_replace(p["key"], NO_KEY, "")).alias("key"), p["value"].alias("value")))

        return F.when(at > 0, once(both, tidy))

    return F.filter(F.transform(F.split(text, "\n", -1), pair), lambda p: p.isNotNull() & (p["key"] != ""))


def key_values(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, key, value) of every mined pair; the last of equal keys wins.  Lines stay in their row; only pairs are shuffled."""
    pairs = docs.select(key, F.posexplode(mined(F.col("text"))).alias("at", "p")).select(key, "at", "p.*")
    return pairs.groupBy(key, "key").agg(F.max_by("value", "at").alias("value"))


def custom_values(docs: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """(doc_id, field_name, value) of the custom fields that no mined key holds already.

    The value is what follows the field's name, with or without a sign in between, up to a line's end; a name that does
    not occur gives ``Not Found``, and what is not under 100 characters long gives nothing.
    """
    quoted = lambda n: "".join("\\" + c if not (c.isalnum() or c == "_" or ord(c) > 127) else c for c in n)

    def one(name: str, keys: Column) -> Column:
        pattern = f"(?i){quoted(name)}{CUSTOM}"
        known = F.exists(keys, lambda k: F.contains(k, F.lit(name.lower())))
        # What is found is not empty, but it may be blanks only.
        value = once(F.regexp_extract("text", pattern, 1), lambda v: F.when(v != "", stripped(v)).otherwise("Not Found"))
        return F.when(~known, once(value, lambda v: F.when(F.length(v) < LONGEST_CUSTOM, F.struct(F.lit(name).alias("field_name"), v.alias("value")))))

    keys = F.transform(mined(F.col("text")), lambda p: F.lower(p["key"]))
    found = once(keys, lambda k: F.filter(F.array(*[one(n, k) for n in names]), lambda f: f.isNotNull()))
    return docs.where(F.col("text").isNotNull()).select(key, F.explode(found).alias("f")).select(key, "f.*")


def loss_notice(docs: DataFrame) -> DataFrame:
    """A loss-notice record: its fields, the share of counted ones found in percent, a reason for each, and a summary paragraph."""
    text = F.coalesce("text", F.lit(""))
    fields = {f: F.when(text.rlike(p), stripped(F.regexp_extract(text, p, 1))).otherwise(missing) for f, (p, missing) in NOTICE.items()}
    rows = docs.select("doc_id", *[v.alias(f) for f, v in fields.items()])
    found = {f: F.col(f) != NOTICE[f][1] for f in COUNTED}
    reasons = F.array(*[F.when(there, f"Found {COUNTED[f]}").otherwise(f"Missing {COUNTED[f]}") for f, there in found.items()])
    score = F.round(sum((there.cast("int") for there in found.values()), F.lit(0)) / len(found) * 100, 1)
    summary = plain_paragraph(F.concat(*[F.col(part) if part in NOTICE else F.lit(part) for part in SUMMARY]))
    return rows.withColumns({"accuracy_score": score, "accuracy_reasons": reasons, "summary": summary})


def anchored_lines(docs: DataFrame, anchors: dict[str, tuple[str, int]], key: str = "doc_id", first: bool = True) -> DataFrame:
    """(doc_id, field_id, nth, value): lines at fixed offsets from anchor lines, counting non-empty lines only.

    ``anchors``: field -> (pattern of the anchor line, offset).  ``first``: only the
    first anchor of a document, else every one.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    lines = lines_of(docs, key).where("line <> ''")
    offsets = sorted({o for _, o in anchors.values()})
    shifted = lines.select(key, "line_no", "line", *[(F.lead("line", o) if o >= 0 else F.lag("line", -o)).over(order).alias(f"at_{o}") for o in offsets])
    each = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(f).alias("field_id"), F.col(f"at_{o}").alias("value"))) for f, (p, o) in anchors.items()])
    hits = shifted.select(key, "line_no", F.explode(F.filter(each, lambda h: h.isNotNull())).alias("h")).select(key, "line_no", "h.*")
    nth = hits.withColumn("nth", F.row_number().over(Window.partitionBy(key, "field_id").orderBy("line_no")))
    return (nth.where("nth = 1") if first else nth).select(key, "field_id", "nth", F.coalesce("value", F.lit(UNKNOWN)).alias("value"))


def split_date_time(v: Column) -> tuple[Column, Column]:
    """A glued date and time as (date, time)."""
    return F.nullif(F.regexp_extract(v, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("")), F.nullif(F.regexp_extract(v, r"(?:\d{4}|\s|^)(\d{1,2}:\d{2}(?:\s*[AaPp][Mm])?)", 1), F.lit(""))


def split_year_make_model(v: Column, makes: list[str]) -> tuple[Column, Column, Column]:
    """A glued ``2019TOYOTACAMRY`` as (year, make, model), by the longest make that is a prefix."""
    year = F.nullif(F.regexp_extract(v, r"^((?:19|20)\d{2})", 1), F.lit(""))
    rest = F.upper(F.trim(F.regexp_replace(v, r"^(?:19|20)\d{2}", "")))
    make = F.lit(None).cast("string")
    for m in sorted(makes, key=len):
        make = F.when(rest.startswith(m.upper()), m.upper()).otherwise(make)
    return year, make, F.nullif(F.trim(F.when(make.isNotNull(), F.substring(rest, F.length(make) + 1, F.length(rest))).otherwise(rest)), F.lit(""))


# Anchors of the positional state form, what is no value beside them, and the makes that models follow.
REPORT_DATE, EVENT_FOOTER, VEHICLE_FOOTER, CASE_LABEL = "(?i)^DATE OF REPORT$", r"(?i)HSMV 90010 S \(E\)", r"(?i)HSMV 90010 S \(V/P\)", "(?i)^REPORTING AGENCY CASE NUMBER$"
NO_LOCATION, NO_PLATE, NO_OWNER = r"HSMV|Page|\\_", r"(?i)^(?:STATE|TRAILER|REGISTRATION|SOURCE|NAME|DATE)", r"(?i)^(?:HSMV|Page)"
NO_WITNESS = (r"^[A-Z\s&;#]+$", r"^\d", r"(?i)HSMV|Page \\_|rev \d")
OWNER = r"^([A-Z][A-Z\s]+?)\s+(\d+\s+.+)$"
AGENCY_NAME = r"(?i)([A-Za-z ]+(?:Police Department|Sheriff'?s Office|Highway Patrol|Department of Public Safety))"
MAKES = (
    "ACURA", "ALFA", "AUDI", "BMW", "BUICK", "CADILLAC", "CHEVROLET", "CHEVY", "CHRYSLER", "DODGE", "FERRARI", "FORD", "GENESIS", "GMC", "HARLEY", "HONDA", "HYUNDAI",
    "INFINITI", "JAGUAR", "JEEP", "KIA", "KAWASAKI", "LANDROVER", "LAND", "LEXUS", "LINCOLN", "LUCID", "MASERATI", "MAZDA", "MERCEDES", "MINI", "MITSUBISHI", "NISSAN",
    "PONTIAC", "PORSCHE", "RAM", "RIVIAN", "SATURN", "SUBARU", "SUZUKI", "TESLA", "TOYOTA", "VOLKSWAGEN", "VOLVO", "VW", "YAMAHA",
)
# End of the fixed values.


def state_form_record(docs: DataFrame) -> DataFrame:
    """(doc_id, date_time, report_number, location, agency, witnesses, vehicles, parties) of forms whose values stand at fixed
    distances from labels and page footers.

    Distances count non-empty lines.  A document's lines are one array, so nothing is shuffled.
    """
    lines = F.filter(F.transform(F.split(strip_headings(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    known = lambda v: F.coalesce(v, F.lit(UNKNOWN))
    places = lambda p: F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(p), i)), lambda i: i.isNotNull())
    at = lambda i, by: F.when(i + by >= 0, F.get("lines", i + by))
    after = lambda p, i: F.get(F.filter("lines", lambda x, n: (n >= i) & x.rlike(p)), F.lit(0))
    rows = docs.select("doc_id", "text", lines.alias("lines")).withColumns({
        "dated": F.get(places(REPORT_DATE), F.lit(0)), "event": F.get(places(EVENT_FOOTER), F.lit(0)), "footers": places(VEHICLE_FOOTER), "labels": places(CASE_LABEL),
    })
    raw = at(F.col("dated"), 1)
    clock = r"^(\d{2}/\d{2}/\d{4})\s*(\d{2}:\d{2}).*"
    date_time = F.when(raw.rlike(clock), F.regexp_replace(raw, clock, "$1 $2")).otherwise(raw)
    case = at(F.col("dated"), 2)
    place = F.when(F.col("event") > 0, at(F.col("event"), -1))

    def witness(line: Column) -> Column:
        fits = (F.length(line) > 25) & line.contains("  ")
        for p in NO_WITNESS:
            fits = fits & ~line.rlike(p)
        parts = F.split(line, r"\s{3,}")
        return F.when(fits, F.struct(F.initcap(F.trim(parts[0])).alias("name"), known(F.trim(F.get(parts, F.lit(1)))).alias("address")))

    def vehicle(footer: Column) -> Column:
        owner, color, glued, plate = at(footer, -1), at(footer, -2), at(footer, -3), at(footer, -4)
        dated = glued.rlike(r"^\d{4}[A-Za-z]")
        rest = F.substring(glued, F.lit(5), F.length(glued))
        make = F.lit(None).cast("string")
        for m in sorted(MAKES, key=len):
            make = F.when(F.upper(rest).startswith(m), F.lit(m)).otherwise(make)
        words = F.regexp_extract_all(F.initcap(rest), F.lit("[A-Z][a-z]*"), F.lit(0))
        model = F.when(make.isNotNull(), F.nullif(F.initcap(F.substring(rest, F.length(make) + 1, F.length(rest))), F.lit(""))).otherwise(F.nullif(F.array_join(F.slice(words, 2, F.size(words)), " "), F.lit("")))
        fine = plate.isNotNull() & (F.length(plate) <= 15) & ~plate.rlike(NO_PLATE)
        year = F.when(glued.rlike(r"^\d{4}"), F.when(dated, F.left(glued, F.lit(4))).otherwise(""))
        made = F.when(year.isNotNull(), F.when(dated, known(F.coalesce(F.initcap(make), F.get(words, F.lit(0))))).otherwise(""))
        named = F.when(~owner.rlike(NO_OWNER), F.when(owner.rlike(OWNER), F.initcap(F.regexp_extract(owner, OWNER, 1))).otherwise(F.initcap(owner)))
        return F.when(
            fine | year.isNotNull(),
            F.struct(
                F.when(fine, plate).otherwise(UNKNOWN).alias("plate"), known(year).alias("year"), known(made).alias("make"), known(F.when(year.isNotNull(), F.when(dated, model).otherwise(glued))).alias("model"),
                F.when(color.rlike("^[A-Za-z]{2,15}$"), F.initcap(color)).otherwise(UNKNOWN).alias("color"), known(named).alias("owner_name"),
                known(F.when(~owner.rlike(NO_OWNER) & owner.rlike(OWNER), F.regexp_extract(owner, OWNER, 2))).alias("owner_address"),
            ),
        )

    def party(label: Column) -> Column:
        name = at(label, 2)
        return F.when(
            (label >= F.get("footers", F.lit(0))) & name.rlike(r"^[A-Z][A-Z\s]{2,}$"),
            F.struct(F.lit("Driver").alias("role"), F.initcap(name).alias("name"), known(after(r"^\d{2}/\d{2}/\d{4}$", label)).alias("dob"), known(after(r"^[A-Z]\d{5,}$", label)).alias("license_number")),
        )

    there = lambda a: F.filter(a, lambda x: x.isNotNull())
    vin = known(F.get(F.filter("lines", lambda x: x.rlike("^[A-HJ-NPR-Z0-9]{17}$")), F.lit(0)))
    cars = F.transform(there(F.transform("footers", vehicle)), lambda v, i: v.withField("vin", F.when(i == 0, vin).otherwise(UNKNOWN)))
    witnesses = F.when(F.col("event") > 0, there(F.transform(F.array(*map(F.lit, (-4, -3, -2))), lambda by: witness(at(F.col("event"), by)))))
    return rows.select(
        "doc_id", known(date_time).alias("date_time"), F.when(case.rlike(r"^[\w\-]{4,}$"), case).otherwise(UNKNOWN).alias("report_number"),
        F.when(place.isNotNull() & ~place.rlike(NO_LOCATION), place).otherwise(UNKNOWN).alias("location"), known(F.nullif(F.trim(F.regexp_extract("text", AGENCY_NAME, 1)), F.lit(""))).alias("agency"),
        F.coalesce(witnesses, F.array().cast("array<struct<name:string,address:string>>")).alias("witnesses"), cars.alias("vehicles"), there(F.transform("labels", party)).alias("parties"),
    )
