"""Vehicles, parties and witnesses of a report: folds over the lines of its text.

A document stays one row.  Its lines become structs of what each could mean by itself (a header, a table row, a labelled
value, words of a rule), and one fold over them is an automaton that decides what they mean here: its state holds the
mode (inside a column table or not), the open entity, the entities closed so far, and whether a name waits for its
last word.  A line's values come as events of three policies, resolved by the same fold: the last one wins (labelled
values), the first one wins (words of a rule), or they add up (citations, conditions).  Nothing is shuffled.

Headers that people's corrections have taught (``aliases``: attribute -> headers) work like the fixed ones: whole words
of a label for vehicles, parts of a label that says nothing else for parties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import once
from ..functions.values import UNKNOWN, stripped

# The words, labels and shapes by which lines of crash reports are told.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
VEHICLE_LABELS = {
    "vin": ("vin", "vehicle identification", "identification number"),
    "plate": ("plate", "license plate", "tag"),
    "year_make_model": ("year / make / model", "year/make/model", "make/model/year", "yr/make/model"),
    "make": ("make", "manufacturer"),
    "year": ("year", "yr"),
    "model": ("model",),
    "color": ("color", "colour", "vehicle color"),
    "damages": ("damage", "damages", "severity"),
    "owner_name": ("owner name", "owner"),
    "owner_address": ("owner address", "owner addr", "owner street"),
    "insurance_company": ("insurance", "insurance company", "carrier"),
    "policy_number": ("policy", "policy number", "policy no"),
    "towed": ("towed", "tow"),
    "towing_company": ("towing company", "towed by", "tower"),
}
VEHICLES_END = r"(?i)^SECTION\s+[3-9]\b"
VEHICLE_COLUMNS = r"(?i)^#\s+Year\s*/\s*Make\s*/\s*Model\s+VIN\s+Plate"
VEHICLE_ROW = r"^(V\d+|Mot\w*)\s+(\d{4})\s+(\S+)\s+(.+)$"
VEHICLE_ROWS_END = r"^V\d+\s|(?i)^SECTION\s+\d"
VIN = r"^(.*?)\b([A-HJ-NPR-Z0-9]{17})\b(.*)$"
PLATE = r"^([A-Z0-9][A-Z0-9\-]{2,10}(?:\s+\([A-Z]{2}\))?)"
VEHICLE_HEADER = (
    r"(?i)^(.*?)(?:^|\b)(?:#\s*:\s*V(\d+)|UNIT\s*/\s*VEH\S*\s*#?\s*(\d+)|(?:Vehicle|Unit|Veh\.?)\s*[#]?\s*V?(\d+)\s*[:\s]|V(\d+)\s*[:]\s*)(.*)$"
)
STOLEN_HEADER = r"(?i)^VEHICLE\s*[-–/]+\s*(?:STOLEN|INVOLVED|RECOVERED|REPORTED)"
YEAR_MAKE_MODEL = r"^(\d{4})\s+(\S+)\s+(.+)"
BARE_VEHICLE = r"^(\d{4})\s+([A-Za-z][A-Za-z0-9\-]+)\s+(.+?)(?:\s*\(([^)]+)\))?\s*$"
NO_BARE_VEHICLE = r"(?i)(Driver|Owner|Insurance|Policy|DL|Restraint|Injury)"
LABELLED_VEHICLE = r"(?i)^Year\s*[/|]\s*Make\s*[/|]\s*Model\s+(\d{4})\s+(\S+)\s+(.+)$"
VEHICLE_WORDS = {
    "year": r"(?i)\bYear\s+(\d{4})\b",
    "make": r"(?i)\bMake\s+(.+?)(?=\s+Model\s+|\s+Color\s+|\s+VIN\b|\s*$)",
    "model": r"(?i)\bModel\s+(.+?)(?=\s+Color\s+|\s+VIN\b|\s+Year\s+|\s*$)",
    "color": r"(?i)\bColor\s+([A-Za-z][A-Za-z\s]+?)(?=\s+License|\s+Plate|\s+VIN\b|\s*$)",
    "vin": r"(?i)\bVIN\s+([A-HJ-NPR-Z0-9]{17})\b",
    "plate": r"(?i)(?:License\s+Plate(?:\s*/\s*State)?|Plate)\s+([A-Z0-9][A-Z0-9\-]{2,10}(?:\s+\([A-Z]{2}\))?)",
    "owner_name": r"(?i)^(?:Registered\s+)?Owner(?:\s+Name)?\s+(.+)$",
    "owner_address": r"(?i)^Owner\s+Address\s+(.+)$",
    "insurance_company": r"(?i)^Insurance\s+Company\s+(.+)$",
    "policy_number": r"(?i)^Policy\s+(?:Number|No\.?|#)\s+(.+)$",
    "towed": r"(?i)^Towed\s+(?:from\s+)?Scene\s+(Yes|No)\b",
    "towing_company": r"(?i)^Towing\s+Company\s+(.+)$",
}
PARTY_FIELDS = ("role", "name", "dob", "address", "phone", "license_number", "condition", "transported_to", "citations")
PARTY_KNOWN = ("name", "dob", "address", "license_number", "condition")
PARTIES_END = r"(?i)^SECTION\s+(?:5|[6-9]|\d{2,})\b|^(?:NARRATIVE|SUPPLEMENTAL|SUPPLEMENT|ADDENDUM|WITNESSES?)\b"
DRIVER_SECTION = r"(?i)^Driver\s+Information\b"
PARTY_COLUMNS = r"(?i)^Party\s+Name\s+DOB\s+(?:License|DL)\b"
PERSON_COLUMNS = r"(?i)^Veh\s+Name\s+DOB"
PARTY_ROW = r"(?i)^(Driver|Operator|Moto\w*)\s+(?:V\d+\s+)?(?:\(\s*)?([A-Z][A-Za-z\s,\.'\-]{3,40}?)\s+(\d{1,2}/\d{1,2}/\d{2,4})\s+([A-Z][A-Z0-9\-]{3,20})(.*)$"
PARTY_ROWS_END = r"(?i)^(?:SECTION\s+\d|PASSENGERS?|WITNESSES?)"
PERSON_ROW = r"(?i)^(V\d+|PED-)\s+(.+?)\s+(\d{1,2}/\d{1,2}/\d{2,4})(.*)$"
PERSON_ROWS_END = r"(?i)^(?:SECTION\s+\d|WITNESSES?|INVESTIGATING)"
OPEN_NAME = r"\b[A-Z]\.$"
NEXT_NAME = r"^([A-Z][a-z]+(?:-[A-Z][a-z]+)?)\b"
PARTY_HEADER = (
    r"(?i)^(?:Party\s*[#]?\s*\d*\s*:?|Person\s*[#]?\s*\d+\s*:?|Veh\s*:\s*V\d+|Operator(?=\s*(?:[^A-Za-z\s)]|$))\s*[#]?\s*\d*\s*(?:\(V\d+\))?\s*:?"
    r"|Driver(?!\s+(?:Name|Information)\b)(?=[#\s]*\d|[#\s]*\(V|[#\s]*:)|Passenger\b\s*[#]?\s*\d*\s*(?:\(V\d+\))?\s*:?|Pedestrian\b\s*[#]?\s*\d*\s*:?"
    r"|Bicyclist\b\s*[#]?\s*\d*\s*:?|VICTIM[\s/]*COMPLAINANT\b|VICTIM\b|COMPLAINANT\b|SUSPECT[\s/]*OFFENDER\b|SUSPECT\b|OFFENDER\b)(.*)$"
)
CHARGE_WORDS = r"(?i)\b(Statute|Violation|Disposition|Fine\s*/|Charge)\b"
HEADER_ROLES = (("victim|complainant", "Victim"), ("suspect|offender", "Suspect"), ("pedestrian", "Pedestrian"), ("bicyclist|cyclist", "Bicyclist"), ("driver|operator", "Operator"), ("passenger|^veh", "Passenger"))
HEADER_NAME = r"^([A-Za-z][A-Za-z\s,.'-]{1,}?)(?:\s*\(DOB:\s*([^)]*)\))?\s*$"
HEADER_NAME_START = r"^[A-Za-z][A-Za-z\s,.'-]{2,}"
HEADER_NAME_END = r"\s+(?=\d{1,2}/\d{1,2}/\d{2,4}\b)|\s+\("
DAY = r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b"
PARTY_LABELS = (
    ("role", r"^(?:role|party role|party type|person type)$"),
    ("name", "name"),
    ("dob", r"dob|date of birth|birth date|d\.o\.b"),
    ("address", "addr|residence"),
    ("license_number", r"license|dl #|dl#|driver lic|driver's lic|dl number|lic #"),
    ("condition", "injury|condition"),
    ("more_condition", "alcohol|drug|substance|dui|dwi|impairment|bac|intox"),
    ("phone", "phone|tel|cell|mobile|contact number"),
    ("transported_to", "transport|taken to|hospital|medic|ems unit|destination"),
    ("citations", "citation|charge|infraction|violation|statute|ticket"),
    ("more_condition", "physical desc|safety equipment|restraint|airbag"),
    ("nothing", "sex|gender|license state|state of license|dl state"),
    ("Pedestrian", "pedestrian"),
    ("Passenger", "passenger"),
    ("Operator", "operator|driver"),
)
PARTY_WORDS = (
    ("name", r"(?i)^Name\s+(.+)$"),
    ("name", r"(?i)\bDriver\s+Name\s+(.+?)(?=\s+DOB[A-Z]?[\s\d]|\s+Age\s*[/|]\s*Sex|\s+DL\s+#|\s*$)"),
    ("dob", r"(?i)^Date\s+of\s+Birth\s+(\d{1,2}/\d{1,2}/\d{2,4})"),
    ("dob", r"(?i)\bDOB[A-Z]?\s*(\d{1,2}/\d{1,2}/\d{2,4})"),
    ("address", r"(?i)^Address\s+(.+)$"),
    ("address", r"(?i)\bAddress\s+(.+?)(?=\s+City/State/Zip|\s+Phone\s*\(|\s+DL\s+#|\s*$)"),
    ("phone", r"(?i)\bPhone\s+(\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4})"),
    ("license_number", r"(?i)^Driver'?s?\s+License\s+No\.?\s+(.+)$"),
    ("license_number", r"(?i)\bDL\s*#\s+([A-Z0-9][A-Z0-9\-]{3,20})\b"),
    ("condition", r"(?i)^Condition\s*/\s*Injur\w*\s+(.+)$"),
    ("condition", r"(?i)\bInjury\s+Severity\s+(.+?)(?=\s+Taken\s+To|\s+EMS\s+Run\s+#|\s*$)"),
    ("transported_to", r"(?i)^Transported\s+To\s+(.+)$"),
    ("transported_to", r"(?i)\bTaken\s+To\s+(.+?)(?=\s+EMS\s+Run\s+#|\s*$)"),
)
CITY = r"(?i)\bCity/State/Zip\s+(.+?)(?=\s+Phone\s*\(|\s+DL\s+#|\s*$)"
CITED = r"(?i)^Citations?\s+Issued\s+(.+)$"
NOWHERE = ("N/A", "NONE", "UNKNOWN", "")
SUBSTANCE = r"(?i)(alcohol|drug|intoxicat|dui|dwi|impair|under the influence|substance|narcotics?|cannabis|marijuana)"
NAME_ENDS = (
    "motorist", "passenger", "pedestrian", "driver", "operator", "freeway", "highway", "interstate", "witness", "bystander", "occupant", "rider",
    "gas", "waiting", "sitting", "standing", "walking", "saw", "observed", "stopped", "exited", "pulled", "arrived",
    "southeast", "southwest", "northeast", "northwest", "off-duty", "on-duty", "yes", "no",
)
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "esq")
PHONE = r"\(?\d{3}\)?[\s\-]\d{3}[\s\-]\d{4}"
BRACKETED_PHONE = r"\(\d{3}\)\s*\d{3}[-\s]\d{4}"
DIVIDER = r"\s*[—–]{1,2}\s*|\s+-\s+"
WITNESS_SECTION = r"(?i)(?:WITNESSES?\s*(?:&|AND)\s*OFFICER|^WITNESSES?$)"
WITNESS_COLUMNS = r"(?i)^#\s+Name\s+Address\s+Phone"
WITNESS_ROW = r"^(\d+)\s+(.+)"
WITNESS_ROWS_END = r"(?i)^(?:Investigating\s+Officer|Reviewing\s+Supervisor|Report\s+Status)"
WITNESS_HEADER = r"(?i)^(?:#\s*:\s*W\d+|Witness\s+W\d+\s*[—–\-]\s*|Witness\s*[#]?\s*\d+\s*[:\s]?|W\d+\s*[:\s])(.*)$"
NO_NAME_FOLLOWS = r"(?i)^(?:W\d+\b|Witness\s+W\d+|SECTION|NARRATIVE|SUPPLEMENT|ADDENDUM|INVESTIGAT)"
WITNESS_LABELS = (("name", "name"), ("dob", "dob|date of birth|birth"), ("address", "address|addr"), ("phone", "phone|tel|cell"), ("statement", "statement"))
# End of the fixed values.

VEHICLE_FIELDS = tuple(a for a in VEHICLE_LABELS if a != "year_make_model")
WITNESS_FIELDS = ("name", "dob", "address", "phone", "statement")


def nothing() -> Column:
    return F.lit(None).cast("string")


def record(fields: tuple[str, ...], given: dict[str, Column] | None = None) -> Column:
    """A struct of all ``fields``; null is a value that was not said."""
    return F.struct(*[(given or {}).get(f, nothing()).alias(f) for f in fields])


def said(line: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern, trimmed; null without a match."""
    return F.nullif(stripped(F.regexp_extract(line, pattern, group)), F.lit(""))


def any_known(entity: Column, fields: tuple[str, ...]) -> Column:
    return F.coalesce(*[entity[f] for f in fields]).isNotNull()


def word_pattern(words: tuple[str, ...], whole: bool) -> str:
    quoted = "|".join("".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in w) for w in words)
    return rf"\b(?:{quoted})\b" if whole else f"(?:{quoted})"


def lines(text: Column) -> Column:
    """Lines without marks of font decoding, trimmed, blank ones left out."""
    tidy = F.transform(F.split(text, LINE_END, -1), lambda x: stripped(F.regexp_replace(x, r"\(cid:\d+\)", "")))
    return F.filter(tidy, lambda x: x != "")


def label(line: Column) -> tuple[Column, Column]:
    """(label in lower case, value) of a line with a colon."""
    at = F.instr(line, ":")
    return F.lower(stripped(F.left(line, at - 1))), stripped(F.substring(line, at + 1, F.length(line)))


def choice(kind: Column, cases: dict[int, Column], otherwise: Column) -> Column:
    """The case of ``kind``, else ``otherwise``."""
    out = None
    for k, value in cases.items():
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return out.otherwise(otherwise)


# -- vehicles -----------------------------------------------------------------------------------------------------------


def _plain_plate(raw: Column) -> Column:
    """A plate without the state in brackets that it begins with anyway."""
    state = F.regexp_extract(raw, r"\s+\(([A-Z]{2})\)$", 1)
    short = F.regexp_replace(raw, r"\s+\([A-Z]{2}\)$", "")
    return F.when((state != "") & F.startswith(F.upper(short), F.concat(state, F.lit("-"))), short).otherwise(raw)


def _vehicle_target(key: Column, labels: dict[str, tuple[str, ...]], whole: bool) -> Column:
    out = None
    for target, words in labels.items():
        fits = key.rlike(word_pattern(words, whole))
        out = F.when(fits, target) if out is None else out.when(fits, target)
    return out


def _three(value: Column, pattern: str = YEAR_MAKE_MODEL) -> dict[str, Column]:
    return {f: said(value, pattern, i + 1) for i, f in enumerate(("year", "make", "model"))}


def _vehicle_row(line: Column) -> Column:
    rest = stripped(F.regexp_extract(line, VEHICLE_ROW, 4))
    has_vin = rest.rlike(VIN)
    plate = said(stripped(F.regexp_extract(rest, VIN, 3)), PLATE)
    return record(("id", *VEHICLE_FIELDS), {
        "id": said(line, VEHICLE_ROW, 1), "year": said(line, VEHICLE_ROW, 2), "make": said(line, VEHICLE_ROW, 3), "vin": said(rest, VIN, 2),
        "model": F.when(has_vin, F.coalesce(said(rest, VIN, 1), F.lit(UNKNOWN))).otherwise(F.left(rest, F.lit(40))), "plate": F.when(has_vin, _plain_plate(plate)),
    })


def _vehicle_header(line: Column, labels: dict[str, tuple[str, ...]]) -> Column:
    """What a header says of its vehicle: id, and what stands behind it on the line; null if it is none."""
    group = lambda n: F.regexp_extract(line, VEHICLE_HEADER, n)
    number = F.coalesce(*[F.nullif(group(n), F.lit("")) for n in (2, 3, 4, 5)])
    inside = (group(4) != "") & (stripped(group(1)) != "")
    rest = stripped(F.regexp_replace(stripped(group(6)), r"""(?U)^[^\w"'(]+""", ""))

    def pair(part: Column) -> Column:
        key, value = label(part)
        key = F.when(part.contains(":"), key).otherwise(F.lower(F.regexp_extract(part, r"^(\S+)\s+(.+)$", 1)))
        value = F.when(part.contains(":"), value).otherwise(stripped(F.regexp_extract(part, r"^(\S+)\s+(.+)$", 2)))
        return F.struct(F.when((key != "") & (value != ""), _vehicle_target(key, labels, whole=False)).alias("target"), value.alias("value"))

    def from_parts(pairs: Column) -> Column:
        last = lambda t: F.try_element_at(F.filter(pairs, lambda p: p["target"] == t), F.lit(-1))["value"]
        whole = F.try_element_at(F.filter(pairs, lambda p: (p["target"] == "year_make_model") & p["value"].rlike(YEAR_MAKE_MODEL)), F.lit(1))["value"]
        three = _three(whole)
        return record(VEHICLE_FIELDS, {f: F.coalesce(last(f), three[f]) if f in three else last(f) for f in VEHICLE_FIELDS})

    def inline(rest: Column) -> Column:
        bare = rest.rlike(BARE_VEHICLE) & ~rest.contains(":") & ~rest.contains("|")
        parts = F.filter(F.transform(F.split(rest, r"\|"), stripped), lambda p: p != "")
        named = record(VEHICLE_FIELDS, {**_three(rest, BARE_VEHICLE), "color": said(rest, BARE_VEHICLE, 4)})
        return F.when((rest == "") | (group(3) != ""), record(VEHICLE_FIELDS)).when(bare, named).otherwise(once(F.transform(parts, pair), from_parts))

    return F.when(line.rlike(VEHICLE_HEADER) & ~inside, F.struct(F.concat(F.lit("V"), number).alias("id"), once(rest, inline).alias("said")))


def _vehicle_words(line: Column) -> dict[str, Column]:
    """What the rules read from a line without a colon, by attribute; of several rules the first."""
    found = {f: said(line, p) for f, p in VEHICLE_WORDS.items()}
    for f in ("make", "model"):
        found[f] = stripped(F.regexp_replace(found[f], r"\s+U$", ""))
    found["plate"] = _plain_plate(found["plate"])
    found["owner_name"] = F.when(~line.rlike(r"(?i)\bAddress\b"), found["owner_name"])
    found["towing_company"] = F.when(~F.upper(found["towing_company"]).isin("N/A", "NONE"), found["towing_company"])
    whole, bare = _three(line, LABELLED_VEHICLE), _three(line, BARE_VEHICLE)
    bare["model"] = stripped(F.regexp_replace(bare["model"], r"\s+U$", ""))
    bare["color"] = said(line, BARE_VEHICLE, 4)
    is_bare = ~line.rlike(NO_BARE_VEHICLE)
    return {f: F.coalesce(whole.get(f, nothing()), c, F.when(is_bare, bare[f]) if f in bare else nothing()) for f, c in found.items()}


def vehicles(docs: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, entity_no, entity_id, attributes): the vehicles of each text in order; equal ids of a document merge.

    Null and empty texts have none; attributes that are not said are ``Unknown``.
    """
    labels = {f: (*words, *(w for w in (a.lower() for a in (aliases or {}).get(f, ())) if w not in words)) for f, words in VEHICLE_LABELS.items()}

    def meaning(line: Column) -> Column:
        key, value = label(line)
        target = F.when(line.contains(":"), _vehicle_target(key, labels, whole=True))
        three = _three(value)
        given = F.when(line.contains(":"), F.when(target == "year_make_model", record(VEHICLE_FIELDS, three)).otherwise(record(VEHICLE_FIELDS))).otherwise(record(VEHICLE_FIELDS, _vehicle_words(line)))
        return F.struct(
            line.rlike(VEHICLES_END).alias("closes"), line.rlike(VEHICLE_COLUMNS).alias("columns"), line.rlike(VEHICLE_ROWS_END).alias("leaves"), line.rlike(STOLEN_HEADER).alias("stolen"),
            F.when(line.rlike(VEHICLE_ROW), _vehicle_row(line)).alias("row"), _vehicle_header(line, labels).alias("header"), target.alias("target"), F.when(line.contains(":"), value).alias("value"), given.alias("first"),
        )

    entity = lambda id_, of: F.struct(id_.alias("id"), *[of[f].alias(f) for f in VEHICLE_FIELDS])
    kinds = ", ".join(f"{f}: string" for f in VEHICLE_FIELDS)
    start = F.struct(F.lit(False).alias("table"), F.lit(0).alias("auto"), record(("id", *VEHICLE_FIELDS)).alias("open"), F.array().cast(f"array<struct<id: string, {kinds}>>").alias("closed"))
    saved = lambda a: F.when(a["open"]["id"].isNotNull() & any_known(a["open"], VEHICLE_FIELDS), F.array_append(a["closed"], a["open"])).otherwise(a["closed"])

    def step(a: Column, x: Column) -> Column:
        kind = (
            F.when(x["closes"], 1).when(x["columns"], 2).when(a["table"] & x["row"].isNotNull(), 3).when(x["header"].isNotNull(), 4)
            .when(x["stolen"], 5).when(a["open"]["id"].isNull(), 0).otherwise(6)
        )
        merged = {f: F.coalesce(F.when(x["target"] == f, x["value"]), a["open"][f], x["first"][f]) for f in VEHICLE_FIELDS}

        def after(kind: Column) -> Column:
            opened = choice(kind, {
                1: record(("id", *VEHICLE_FIELDS)), 3: x["row"], 4: entity(x["header"]["id"], x["header"]["said"]),
                5: entity(F.concat(F.lit("V"), (a["auto"] + 1).cast("string")), record(VEHICLE_FIELDS)), 6: entity(a["open"]["id"], merged),
            }, a["open"])
            return F.struct(
                choice(kind, {1: F.lit(False), 2: F.lit(True), 3: a["table"]}, a["table"] & ~x["leaves"]).alias("table"), F.when(kind == 5, a["auto"] + 1).otherwise(a["auto"]).alias("auto"),
                opened.alias("open"), F.when(kind.isin(1, 3, 4, 5), saved(a)).otherwise(a["closed"]).alias("closed"),
            )

        return once(kind, after)

    def by_id(found: Column) -> Column:
        later = lambda a, x: F.struct(F.coalesce(x["id"], a["id"]).alias("id"), *[F.coalesce(x[f], a[f]).alias(f) for f in VEHICLE_FIELDS])
        return F.transform(F.array_distinct(F.transform(found, lambda v: v["id"])), lambda i: F.aggregate(F.filter(found, lambda v: v["id"] == i), record(("id", *VEHICLE_FIELDS)), later))

    read = F.aggregate(F.transform(lines(F.col("text")), meaning), start, step, saved)
    rows = docs.select("doc_id", F.posexplode(once(read, by_id)).alias("at", "v"))
    return rows.select("doc_id", (F.col("at") + 1).alias("entity_no"), F.col("v.id").alias("entity_id"), *[F.coalesce(F.col("v")[f], F.lit(UNKNOWN)).alias(f) for f in VEHICLE_FIELDS])


# -- parties --------------------------------------------------------------------------------------------------------------

_PARTY = (*PARTY_FIELDS, "moved")  # moved: any text if the party was transported


def _party_row(line: Column) -> Column:
    cited = said(line, PARTY_ROW, 5)
    return record(_PARTY, {
        "role": F.lit("Operator"), "name": F.regexp_replace(said(line, PARTY_ROW, 2), ",+$", ""), "dob": said(line, PARTY_ROW, 3), "license_number": said(line, PARTY_ROW, 4),
        "citations": F.when(~F.lower(cited).isin("none", "n/a"), cited),
    })


def _person_row(line: Column) -> Column:
    name = stripped(F.regexp_replace(stripped(F.regexp_replace(said(line, PERSON_ROW, 2), r"\s*\([^)]{2,20}\)\s*$", "")), r"\s*\([^)]*$", ""))
    rest = F.coalesce(said(line, PERSON_ROW, 4), F.lit(""))
    answer = F.lower(F.regexp_extract(rest, r"(?i)^(.*?)\b(Yes|No)\b", 2))
    injury = F.when(answer != "", F.regexp_extract(rest, r"(?i)^(.*?)\b(Yes|No)\b", 1)).otherwise(rest)
    role = F.when(F.upper(said(line, PERSON_ROW, 1)).startswith("PED"), "Pedestrian").otherwise("Passenger")
    return record(_PARTY, {"role": role, "name": name, "dob": said(line, PERSON_ROW, 3), "condition": F.nullif(stripped(injury), F.lit("")), "moved": F.when(answer == "yes", "yes")})


def _party_header(line: Column) -> Column:
    low = F.lower(line)
    role = nothing()
    for words, name in reversed(HEADER_ROLES):
        role = F.when(low.rlike(words), name).otherwise(role)
    rest = stripped(F.regexp_replace(stripped(F.regexp_extract(line, PARTY_HEADER, 1)), ":+$", ""))

    def named(rest: Column) -> Column:
        usable = (rest != "") & ~rest.startswith("|")
        whole = usable & rest.rlike(HEADER_NAME)
        part = usable & ~whole & rest.rlike(HEADER_NAME_START)
        name = F.when(whole, F.regexp_extract(rest, HEADER_NAME, 1)).when(part, F.split(rest, HEADER_NAME_END)[0])
        day = F.when(whole, said(rest, HEADER_NAME, 2)).when(part, said(rest, DAY))
        return record(_PARTY, {"role": role, "name": F.nullif(F.regexp_replace(stripped(name), ",+$", ""), F.lit("")), "dob": day})

    return once(rest, named)


def _party_target(key: Column, aliases: dict[str, list[str]]) -> Column:
    out = None
    for target, words in PARTY_LABELS:
        out = F.when(key.rlike(words), target) if out is None else out.when(key.rlike(words), target)
    for target in ("name", "dob", "address", "license_number", "condition", "phone", "citations", "transported_to"):
        if aliases.get(target):
            out = out.when(key.rlike(word_pattern(tuple(a.lower() for a in aliases[target]), whole=False)), target)
    return out


def _more(so_far: Column, value: Column, between: str) -> Column:
    """A value added to what was said before."""
    return F.when(value.isNull(), so_far).when(F.coalesce(so_far, F.lit("")) == "", value).otherwise(F.concat(so_far, F.lit(between), value))


def parties(docs: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Parties with role, injuries apart from substances, citations as a list, and whether they were transported.

    Null and empty texts have none; a party of which neither name, day of birth, address, license nor condition is
    known is left out.
    """

    def meaning(line: Column) -> Column:
        key, value = label(line)
        colon = line.contains(":")
        target = F.when(colon, _party_target(key, aliases or {}))
        words: dict[str, Column] = {}
        for f, pattern in PARTY_WORDS:
            v = said(line, pattern)
            if pattern == PARTY_WORDS[0][1]:
                v = stripped(F.regexp_replace(v, r"\s*\([^)]{2,20}\)\s*$", ""))
            words[f] = F.coalesce(words[f], v) if f in words else v
        to = [said(line, p) for f, p in PARTY_WORDS if f == "transported_to"]
        moved = F.when(line.rlike(r"(?i)^Transported\s+Yes\b") | F.coalesce(*[~F.upper(t).isin(*NOWHERE) for t in to], F.lit(False)), "yes")
        cited = said(line, CITED)
        value = F.when(target == "dob", F.nullif(stripped(F.regexp_replace(value, "^-+|-+$", "")), F.lit(""))).otherwise(value)
        return F.struct(
            line.rlike(PARTIES_END).alias("closes"), line.rlike(DRIVER_SECTION).alias("driver"), line.rlike(PARTY_COLUMNS).alias("columns"), line.rlike(PERSON_COLUMNS).alias("people"),
            F.when(line.rlike(PARTY_ROW), _party_row(line)).alias("row"), line.rlike(PARTY_ROWS_END).alias("rows_end"),
            F.when(line.rlike(PERSON_ROW), _person_row(line)).alias("person"), line.rlike(PERSON_ROWS_END).alias("people_end"), said(line, NEXT_NAME).alias("next_name"),
            F.when(line.rlike(PARTY_HEADER), _party_header(line)).alias("header"), stripped(F.regexp_extract(line, PARTY_HEADER, 1)).rlike(CHARGE_WORDS).alias("charge"),
            target.alias("target"), F.when(colon, value).alias("value"), F.when(colon, record(_PARTY)).otherwise(record(_PARTY, words | {"moved": moved})).alias("first"),
            F.when(~colon, said(line, CITY)).alias("city"), F.when(~colon & ~F.lower(cited).isin("none", "n/a"), cited).alias("cited"),
        )

    kinds = ", ".join(f"{f}: string" for f in _PARTY)
    start = F.struct(*[F.lit(False).alias(n) for n in ("past", "inside", "table", "people", "waits")], record(_PARTY).alias("open"), F.array().cast(f"array<struct<{kinds}>>").alias("closed"))
    truthy = lambda e: F.coalesce(*[F.nullif(e[f], F.lit("")) for f in PARTY_KNOWN]).isNotNull()
    saved = lambda a: F.when(truthy(a["open"]), F.array_append(a["closed"], a["open"])).otherwise(a["closed"])

    def merged(a: Column, x: Column) -> Column:
        e, target, value, first = a["open"], x["target"], x["value"], x["first"]
        out = {f: F.coalesce(F.when(target == f, value), e[f], first[f]) for f in ("name", "dob", "phone", "license_number", "transported_to")}
        out["role"] = F.when(target == "role", value).when(target.isin("Pedestrian", "Passenger", "Operator"), target).otherwise(e["role"])
        out["address"] = _more(F.coalesce(F.when(target == "address", value), e["address"], first["address"]), x["city"], ", ")
        more = F.when(target == "more_condition", stripped(F.concat(F.coalesce(e["condition"], F.lit("")), F.lit(" "), value)))
        out["condition"] = F.coalesce(F.when(target == "condition", value), more, e["condition"], first["condition"])
        out["citations"] = _more(e["citations"], F.coalesce(F.when(target == "citations", value), x["cited"]), ", ")
        out["moved"] = F.coalesce(F.when(target == "transported_to", F.lit("yes")), e["moved"], first["moved"])
        return F.struct(*[out[f].alias(f) for f in _PARTY])

    def step(a: Column, x: Column) -> Column:
        running = ~a["past"] & ~x["closes"] & ~x["driver"] & ~x["columns"] & ~x["people"]
        row = running & a["table"] & x["row"].isNotNull()
        rows_end = running & a["table"] & x["row"].isNull() & x["rows_end"]
        person = running & ~row & a["people"] & x["person"].isNotNull()
        unsure = running & ~row & a["people"] & x["person"].isNull()
        goes_on = unsure & a["waits"] & ~rows_end & any_known(a["open"], _PARTY)
        people_end = unsure & ~goes_on & x["people_end"]
        ends = rows_end | people_end
        kind = (
            F.when(a["past"], 0).when(x["closes"], 1).when(x["driver"], 2).when(x["columns"], 3).when(x["people"], 4).when(row, 5).when(person, 6).when(goes_on, 7)
            .when(x["header"].isNotNull(), F.when(x["charge"], 8).otherwise(9)).when(~a["inside"] | ends, 0).otherwise(10)
        )

        def after(s: Column) -> Column:
            kind, ends, rows_end, people_end = s["kind"], s["ends"], s["rows_end"], s["people_end"]
            named = F.struct(*[(F.concat_ws(" ", a["open"]["name"], x["next_name"]) if f == "name" else a["open"][f]).alias(f) for f in _PARTY])
            empty = record(_PARTY)
            opened = choice(kind, {1: empty, 2: record(_PARTY, {"role": F.lit("Operator")}), 5: x["row"], 6: x["person"], 7: named, 8: empty, 9: x["header"], 10: merged(a, x)}, F.when(ends, empty).otherwise(a["open"]))
            no, yes = F.lit(False), F.lit(True)
            return F.struct(
                (a["past"] | (kind == 1)).alias("past"), choice(kind, {1: no, 2: yes, 5: yes, 6: yes, 8: no, 9: yes}, a["inside"] & ~ends).alias("inside"),
                choice(kind, {1: no, 3: yes}, a["table"] & ~rows_end).alias("table"), choice(kind, {1: no, 4: yes}, a["people"] & ~people_end).alias("people"),
                choice(kind, {6: x["person"]["name"].rlike(OPEN_NAME), 7: no}, a["waits"] & ~people_end).alias("waits"), opened.alias("open"),
                F.when(kind.isin(1, 2, 5, 6, 8, 9) | ends, saved(a)).otherwise(a["closed"]).alias("closed"),
            )

        return once(F.struct(kind.alias("kind"), ends.alias("ends"), rows_end.alias("rows_end"), people_end.alias("people_end")), after)

    read = F.aggregate(F.transform(lines(F.col("text")), meaning), start, step, saved)
    found = docs.select("doc_id", F.posexplode(read).alias("at", "p")).select("doc_id", (F.col("at") + 1).alias("entity_no"), "p.*")
    condition = F.coalesce("condition", F.lit(UNKNOWN))
    substance = F.nullif(F.regexp_extract(condition, SUBSTANCE, 1), F.lit(""))
    injuries = F.when(substance.isNull(), condition).otherwise(F.regexp_replace(F.regexp_replace(condition, SUBSTANCE, ""), "^[ ,;]+|[ ,;]+$", ""))
    raw = F.col("citations")
    listed = F.when(raw.isNull() | F.lower(raw).isin("none", "unknown", ""), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(raw, r"[,;|]"), stripped), lambda c: c != ""))
    to = F.coalesce("transported_to", F.lit(UNKNOWN))
    plain = [F.coalesce(c, F.lit(UNKNOWN)).alias(c) for c in ("role", "name", "dob", "address", "phone", "license_number")]
    return found.select(
        "doc_id", "entity_no", *plain, F.when(substance.isNull(), injuries).otherwise(F.concat_ws("; ", injuries, substance)).alias("condition"),
        F.coalesce(F.nullif(injuries, F.lit("")), F.lit("None reported")).alias("injuries"), F.coalesce(substance, F.lit("None reported")).alias("substance_involvement"),
        (~to.isin(UNKNOWN, "None", "", "N/A") | F.col("moved").isNotNull()).alias("transported"), to.alias("transported_to"),
        F.when(F.size(listed) > 0, F.array_join(listed, ", ")).otherwise("None").alias("citations"), listed.alias("citations_list"),
    )


# -- witnesses --------------------------------------------------------------------------------------------------------------


def truncated_name(text: Column) -> Column:
    """The words of a name at the start of a text; empty for an empty text.

    It ends before a telephone number, a word of ``NAME_ENDS``, a number or a second word in capitals; with a word that
    a comma follows, if that is a name; after three words, or four where the third ends with a dot.
    """
    before = stripped(F.split(text, PHONE, 2)[0])

    def cut(tokens: Column) -> Column:
        plain = lambda t: F.regexp_replace(F.lower(t), r"^[.,;:]+|[.,;:]+$", "")
        ends = lambda t: plain(t).isin(*NAME_ENDS)
        comma = lambda t: t.contains(",") & ~F.regexp_replace(plain(t), "^,+|,+$", "").isin(*NAME_SUFFIXES)
        stops = lambda t: ends(t) | comma(t) | t.rlike("^[0-9]") | ((F.upper(t) == t) & t.rlike("[A-Z]") & (F.length(t) > 2))
        first = F.array_min(F.filter(F.transform(tokens, lambda t, i: F.when((i > 0) & stops(t), i)), lambda i: i.isNotNull()))
        most = F.when(F.coalesce(F.get(tokens, F.lit(2)).endswith("."), F.lit(False)), 4).otherwise(3)
        n = F.least(F.coalesce(first, F.size(tokens)), most)
        last = F.get(tokens, n)
        with_comma = (F.coalesce(first, F.lit(-1)) == n) & (n < most) & ~ends(last) & comma(last) & last.rlike("^[A-Z]") & F.regexp_replace(last, "[.,]", "").rlike("^[A-Za-z]+$")
        words = F.slice(tokens, 1, n)
        return F.array_join(F.when(F.coalesce(with_comma, F.lit(False)), F.array_append(words, F.regexp_replace(last, ",+$", ""))).otherwise(words), " ")

    return once(F.split(before, r"\s+"), cut)


def continued_name(name: Column, raw: Column, following: Column) -> Column:
    """A name that the end of its line has cut off, with its last word from the line that follows.

    After an initial the next line's first word is added, and a badge number behind it; where a comma or a word in
    small letters follows the name on its own line, that word takes the place of the name's last one.
    """
    last = F.substring_index(name, " ", -1)
    after = F.call_function("substring_index", raw, last, F.lit(-1))
    word = F.when(~following.rlike(NO_NAME_FOLLOWS), said(following, r"^([A-Z][a-z]+)\b"))
    badge = said(following, r"^[A-Z][a-z]+\b\s*(#\d+)\b")
    cut = F.startswith(after, F.lit(",")) | F.regexp_replace(after, r"^\s+", "").rlike("^[a-z]")
    return F.when(word.isNull(), name).when(last.endswith("."), F.concat_ws(" ", name, word, badge)).when(cut, F.concat(F.left(name, F.length(name) - F.length(last)), word)).otherwise(name)


def _witness_row(line: Column) -> Column:
    rest = F.regexp_extract(line, WITNESS_ROW, 2)
    divided = F.split(rest, BRACKETED_PHONE, 2)
    before, has_phone = stripped(divided[0]), rest.rlike(BRACKETED_PHONE)
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    two = lambda t: F.array_join(F.slice(words(t), 1, 2), " ")
    numbered = before.rlike(r"\s+\d")
    left_over = F.coalesce(F.nullif(F.array_join(F.slice(words(before), 3, 1_000_000), " "), F.lit("")), F.lit(UNKNOWN))
    return F.when(has_phone, record(WITNESS_FIELDS, {
        "name": F.when(numbered, stripped(F.split(before, r"\s+(?=\d)", 2)[0])).otherwise(two(before)), "address": F.when(numbered, stripped(F.split(before, r"\s+(?=\d)", 2)[1])).otherwise(left_over),
        "phone": F.regexp_extract(rest, BRACKETED_PHONE, 0), "statement": stripped(F.get(divided, F.lit(1))),
    })).otherwise(record(WITNESS_FIELDS, {"name": two(rest)}))


def _witness_header(line: Column, following: Column) -> Column:
    """A witness from the line that opens them: a telephone number divides name and address from the statement; without one, dashes do."""
    rest = stripped(F.regexp_extract(line, WITNESS_HEADER, 1))

    def parsed(rest: Column) -> Column:
        parts = F.split(rest, DIVIDER)
        raw = stripped(parts[0])
        divided = F.split(rest, BRACKETED_PHONE, 2)
        has_phone = rest.rlike(BRACKETED_PHONE)
        part = lambda i: stripped(F.get(parts, F.lit(i)))
        is_phone = part(1).rlike(r"[\d()\-+]{7,}")

        def named(name: Column) -> Column:
            before = stripped(divided[0])
            address = stripped(F.regexp_replace(stripped(F.substring(before, F.length(name) + 1, F.length(before))), "^,+", ""))
            statement = F.nullif(stripped(F.regexp_replace(stripped(F.get(divided, F.lit(1))), r"(?i)^Yes\s*[—–\-]+\s*", "")), F.lit(""))
            return record(WITNESS_FIELDS, {
                "name": F.when(name != "", continued_name(name, raw, following)), "address": F.when(has_phone, F.coalesce(F.nullif(address, F.lit("")), F.lit(UNKNOWN))),
                "phone": F.when(has_phone, F.regexp_extract(rest, BRACKETED_PHONE, 0)).when(is_phone, part(1)),
                "statement": F.when(has_phone, statement).when(is_phone, part(2)).otherwise(part(1)),
            })

        return F.when(rest == "", record(WITNESS_FIELDS)).otherwise(once(truncated_name(raw), named))

    return once(rest, parsed)


def witnesses(docs: DataFrame) -> DataFrame:
    """(doc_id, entity_no, name, dob, address, phone, statement): the witnesses of each text in order; null and empty texts have none."""
    tidy = F.transform(F.split(F.col("text"), LINE_END, -1), stripped)

    def meaning(pair: Column) -> Column:
        line, following = pair["line"], pair["following"]
        key, value = label(line)
        target = None
        for f, words in WITNESS_LABELS:
            target = F.when(key.rlike(words), f) if target is None else target.when(key.rlike(words), f)
        return F.struct(
            line.rlike(WITNESS_SECTION).alias("section"), line.rlike(WITNESS_COLUMNS).alias("columns"), F.when(line.rlike(WITNESS_ROW), _witness_row(line)).alias("row"), line.rlike(WITNESS_ROWS_END).alias("rows_end"),
            F.when(line.rlike(WITNESS_HEADER), _witness_header(line, following)).alias("header"), F.when(line.contains(":"), target).alias("target"), F.when(line.contains(":"), value).alias("value"),
        )

    kinds = ", ".join(f"{f}: string" for f in WITNESS_FIELDS)
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("table"), record(WITNESS_FIELDS).alias("open"), F.array().cast(f"array<struct<{kinds}>>").alias("closed"))
    saved = lambda a: F.when(any_known(a["open"], WITNESS_FIELDS), F.array_append(a["closed"], a["open"])).otherwise(a["closed"])

    def step(a: Column, x: Column) -> Column:
        open_ = a["open"]
        kind = (
            F.when(x["section"], 1).when(a["inside"] & x["columns"], 2).when(a["table"] & x["row"].isNotNull(), 3).when(a["table"] & x["rows_end"], 4).when(x["header"].isNotNull(), 5)
            .when((a["inside"] | a["table"] | any_known(open_, WITNESS_FIELDS)) & x["target"].isNotNull(), 6).otherwise(0)
        )
        merged = F.struct(*[F.when(x["target"] == f, x["value"]).otherwise(open_[f]).alias(f) for f in WITNESS_FIELDS])

        def after(kind: Column) -> Column:
            no, yes = F.lit(False), F.lit(True)
            return F.struct(
                choice(kind, {1: yes, 4: no}, a["inside"]).alias("inside"), choice(kind, {1: no, 2: yes, 4: no}, a["table"]).alias("table"),
                choice(kind, {3: x["row"], 4: record(WITNESS_FIELDS), 5: x["header"], 6: merged}, open_).alias("open"), F.when(kind.isin(3, 4, 5), saved(a)).otherwise(a["closed"]).alias("closed"),
            )

        return once(kind, after)

    with_next = once(tidy, lambda t: F.filter(F.transform(t, lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get(t, i + 1), F.lit("")).alias("following"))), lambda p: p["line"] != ""))
    read = F.aggregate(F.transform(with_next, meaning), start, step, saved)
    rows = docs.select("doc_id", F.posexplode(read).alias("at", "w"))
    return rows.select("doc_id", (F.col("at") + 1).alias("entity_no"), *[F.coalesce(F.col("w")[f], F.lit(UNKNOWN)).alias(f) for f in WITNESS_FIELDS])
