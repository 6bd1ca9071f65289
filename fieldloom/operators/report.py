"""Record scores, narratives, insights and cross-report checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import once
from ..functions.values import MISSING, field_quality, missing, quality_reason, stripped

# Weights of fields, core fields per document type, and the incidents that have no weather.
WEIGHTS = {
    "date_time": 1.5, "location": 1.5, "report_number": 1.5, "agency": 1.2, "officer": 1.2, "cause_of_loss": 1.3, "inspection_date": 1.3,
    "inspection_firm": 1.2, "weather": 0.5, "accident_type": 0.7, "ems_agency": 0.7, "contributing_factors": 0.6, "property_damage": 0.5,
}
SCORED = {
    "police": ["date_time", "location", "report_number", "agency", "officer", "weather", "accident_type", "ems_agency", "contributing_factors", "property_damage"],
    "ia": ["cause_of_loss", "inspection_date", "inspection_firm", "coverage_a", "coverage_b", "coverage_c", "coverage_d", "settlement", "subrogation"],
}
CORE = {"police": ["date_time", "location", "report_number", "agency", "officer", "weather", "accident_type"], "ia": ["cause_of_loss", "inspection_date"]}
NO_WEATHER = (
    r"(?i)\b(?:larceny|theft|burglary|robbery|assault|vandalism|motor\s+vehicle\s+theft|stolen\s+vehicle|hit\s+and\s+run\s+property|"
    r"trespass|fraud|domestic)\b"
)
VEHICLE_KEYS, VEHICLE_WEIGHT = ("vin", "plate", "make", "year", "model"), 1.5
# End of the fixed values.


#: Fixed value: the reason of a record that lacks nothing.
ALL_WELL = "All key fields extracted successfully"


def score_records(record: DataFrame, evidence: DataFrame, vehicles: DataFrame | None = None, doc_type: str = "police", weights: dict | None = None, scored: list[str] | None = None, core: list[str] | None = None) -> DataFrame:
    """(doc_id, score, reasons): weighted quality of a record from 0 to 100.

    Core fields always count; others count where a candidate or a value is evidence
    that the document has them.  ``evidence`` (doc_id, field_id).  Vehicles count by
    how many of their key attributes are known; a traffic report with candidates but
    without any vehicle counts as having none known.
    """
    weights, scored, core = weights or WEIGHTS, scored or SCORED[doc_type], core or CORE[doc_type]
    none = F.lit(None).cast("string")
    given = record.select("doc_id", "field_id", F.col("value").cast("string").alias("value"), F.lit(False).alias("seen")).unionByName(evidence.select("doc_id", "field_id", none.alias("value"), F.lit(True).alias("seen")))
    # Each row of a record and of the evidence goes to its document once; fields of neither count are only known to be there.
    told = F.when(F.col("field_id").isin(*scored, "accident_type"), F.struct("field_id", "value", "seen"))
    docs = given.groupBy("doc_id").agg(F.collect_list(told).alias("f"), F.max("seen").alias("has_evidence"))
    values = lambda f: F.transform(F.filter("f", lambda x: (x["field_id"] == f) & ~x["seen"]), lambda x: x["value"])
    incidents = F.transform(values("accident_type"), lambda v: F.coalesce(v.rlike(NO_WEATHER), F.lit(False)))
    incidents = once(incidents, lambda i: F.when(F.size(i) > 0, i).otherwise(F.array(F.lit(False))))

    def parts_of(f: str, incidents: Column) -> Column:
        """(q, weight, reason) of each value of a field that counts, once for each incident."""
        seen = F.exists("f", lambda x: (x["field_id"] == f) & x["seen"])

        def part(v: Column, no_weather: Column) -> Column:
            is_core = F.lit(f in core) & ~no_weather if f == "weather" else F.lit(f in core)
            judged = F.struct(field_quality(F.lit(f), v).cast("double").alias("q"), F.lit(float(weights.get(f, 1.0))).alias("weight"), quality_reason(F.lit(f), v).alias("reason"))
            return F.when(is_core | seen | ~missing(v), judged)

        each = once(values(f), lambda v: F.when(F.size(v) > 0, v).otherwise(F.array(none)))
        return F.flatten(F.transform(incidents, lambda no_weather: F.transform(each, lambda v: part(v, no_weather))))

    of_vehicles = None
    if vehicles is not None and doc_type != "ia":
        known = [(~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*MISSING)).cast("int") for c in VEHICLE_KEYS]
        complete = vehicles.select("doc_id", sum(known[1:], known[0]).alias("known")).groupBy("doc_id").agg((F.sum("known") / (F.count(F.lit(1)) * len(VEHICLE_KEYS))).alias("_vehicles"))
        docs = docs.join(complete, "doc_id", "full")
        car = lambda q: F.struct(q.alias("q"), F.lit(VEHICLE_WEIGHT).alias("weight"), none.alias("reason"))
        without = lambda incidents: F.transform(F.filter(incidents, lambda no_weather: ~no_weather), lambda _: car(F.lit(0.0)))
        nothing = F.array().cast("array<struct<q:double,weight:double,reason:string>>")
        of_vehicles = lambda incidents: F.when(F.col("_vehicles").isNotNull(), F.array(car(F.col("_vehicles")))).when(F.col("has_evidence"), without(incidents)).otherwise(nothing)

    def parts(incidents: Column) -> Column:
        own = F.filter(F.concat(*[parts_of(f, incidents) for f in scored]), lambda p: p.isNotNull())
        return own if of_vehicles is None else F.concat(F.coalesce(own, nothing), of_vehicles(incidents))

    def judged(parts: Column) -> Column:
        sums = F.aggregate(parts, F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("w")), lambda t, p: F.struct((t["q"] + p["q"] * p["weight"]).alias("q"), (t["w"] + p["weight"]).alias("w")))
        reasons = F.array_sort(F.filter(F.transform(parts, lambda p: p["reason"]), lambda r: r.isNotNull()))
        said = once(reasons, lambda r: F.when(F.size(r) > 0, r).otherwise(F.array(F.lit(ALL_WELL))))
        return F.when(F.size(parts) > 0, F.struct(once(sums, lambda t: F.round(F.try_divide(t["q"], t["w"]) * 100, 1)).alias("score"), said.alias("reasons")))

    # A document without any part gives no row; what it has is worked out once.
    scores = once(incidents, lambda i: once(parts(i), judged))
    return docs.select("doc_id", F.explode(F.filter(F.array(scores), lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")


# The sentences of the notes, with {} for a field's value, and what stands for a value that is not there.
ADJUSTER_SENTENCES = (
    ("The cause of loss was {}.", "cause_of_loss", "not specified"),
    ("Coverage A was inspected on {}", "inspection_date", "not recorded"),
    ("by {}.", "inspection_firm", "not recorded"),
    ("Coverage A is {}.", "coverage_a", "N/A"),
    ("Coverage B is {}.", "coverage_b", "N/A"),
    ("Coverage C is {}.", "coverage_c", "N/A"),
    ("Coverage D is {}.", "coverage_d", "N/A"),
    ("The applicable coverages and policy form are as follows: {}.", "coverages", None),
    ("A report was filed with the following officials: {}.", "officials", "No fire or police report was filed."),
    ("The settlement amount is {}.", "settlement", "not yet determined"),
    ("Subrogation is {}.", "subrogation", "not determined"),
    ("Summary of payments made to date: {}.", "payment_summary", "No payment summary data was available from ClaimCenter."),
    ("Adjuster recommendations: {}.", "recommendations", "No adjuster recommendations have been entered."),
)
RESERVE_SENTENCE = "WARNING: The word reserve appears in this document and requires adjuster review."
#: Fields whose absence is a sentence of its own.
OWN_SENTENCE = ("officials", "payment_summary", "recommendations")
POLICE_DEFAULTS = {
    "accident_type": "an unspecified type of collision", "date_time": "an unknown date and time", "location": "an unknown location",
    "agency": "the responding agency", "officer": "an unidentified officer",
}
UNSAID = ("", "unknown", "n/a")
UNHURT = ("none reported", "unknown", "", "n/a")
OPERATOR_ROLES = ("operator", "driver")
# End of the fixed values.


def _value(c: str, fallback: str) -> Column:
    """A field as it is, or what stands for it where it is null or blank."""
    return F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(fallback)).otherwise(F.col(c))


def _said(sentence: str, c: str) -> Column:
    """The sentence around a known value, else null."""
    before, after = sentence.split("{}")
    return F.when(~F.lower(stripped(F.col(c))).isin(*UNSAID), F.concat(F.lit(before), F.col(c), F.lit(after)))


def adjuster_note(wide: DataFrame, reserve: Column) -> DataFrame:
    """``wide`` (a column per field) with ``note``: the file note of an adjuster report."""
    parts = []
    for sentence, field, fallback in ADJUSTER_SENTENCES:
        before, after = sentence.split("{}")
        there = F.coalesce(F.col(field), F.lit("")) != ""
        if fallback is None or field in OWN_SENTENCE:
            parts.append(F.when(there, F.concat(F.lit(before), F.col(field), F.lit(after))).otherwise(F.lit(fallback)))
        else:
            parts.append(F.concat(F.lit(before), _value(field, fallback), F.lit(after)))
    return wide.withColumn("note", F.concat_ws(" ", *parts, F.when(reserve, F.lit(RESERVE_SENTENCE))))


def _many(n: Column, one: str, more: str) -> Column:
    """A counted sentence, or null for none."""
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.when(n == 1, F.format_string(one, n)).otherwise(F.format_string(more, n)))


def police_note(wide: DataFrame, vehicles: DataFrame, parties: DataFrame, witnesses: DataFrame) -> DataFrame:
    """``wide`` with ``note``: what happened and how many vehicles, operators, injured and witnesses there are."""
    n = lambda df, *counts: df.groupBy("doc_id").agg(*counts)
    all_of = lambda name: F.count(F.lit(1)).alias(name)
    hurt = ~F.lower(F.coalesce("injuries", F.lit("None reported"))).isin(*UNHURT)
    people = n(parties, F.count_if(F.lower("role").isin(*OPERATOR_ROLES)).alias("n_operators"), F.count_if(hurt).alias("n_injured"))
    counted = wide.join(n(vehicles, all_of("n_vehicles")), "doc_id", "left").join(people, "doc_id", "left").join(n(witnesses, all_of("n_witnesses")), "doc_id", "left")
    get = {f: _value(f, d) for f, d in POLICE_DEFAULTS.items()}
    c = F.col
    note = F.concat_ws(
        " ",
        F.concat(F.lit("A "), get["accident_type"], F.lit(" collision occurred on "), get["date_time"], F.lit(" at "), get["location"], F.lit(".")),
        _said("Weather conditions were reported as {}.", "weather"),
        F.concat(F.lit("The incident was investigated by "), get["agency"], F.lit(", reporting officer "), get["officer"], F.lit(".")),
        _said("Report number: {}.", "report_number"),
        _said("EMS responded; agency: {}.", "ems_agency"),
        _many(c("n_vehicles"), "A total of %d vehicle was involved.", "A total of %d vehicles were involved."),
        _many(c("n_operators"), "%d operator was identified.", "%d operators were identified."),
        _many(c("n_injured"), "%d party reported injuries.", "%d parties reported injuries."),
        _many(c("n_witnesses"), "%d witness was identified at the scene.", "%d witnesses were identified at the scene."),
        _said("Contributing factors noted: {}.", "contributing_factors"),
        _said("Non-vehicle property damage reported: {}.", "property_damage"),
    )
    return counted.withColumn("note", note).drop("n_vehicles", "n_operators", "n_injured", "n_witnesses")


def insights(wide: DataFrame) -> DataFrame:
    """``wide`` with ``chips`` and ``actions``: what a record shows and the next steps that it suggests.

    Columns that the record lacks say nothing.
    """
    col = lambda c, t="string": F.col(c).cast(t) if c in wide.columns else F.lit(None).cast(t)
    has = lambda c: F.coalesce(col(c), F.lit("")) != ""
    reserve = F.coalesce(col("reserve", "boolean"), F.lit(False))
    recover = F.coalesce(F.contains(F.lower(col("subrogation")), F.lit("investig")), F.lit(False))
    people, cars = (F.coalesce(col(c, "int"), F.lit(0)) for c in ("n_parties", "n_vehicles"))
    chips = F.array(
        F.when(reserve, "Reserve language detected"), F.when(recover, "Subrogation opportunity"), F.when(people > 0, F.format_string("%d parties identified", people)),
        F.when(cars > 0, F.format_string("%d vehicles", cars)), F.when(has("coverage_a"), "Coverage A confirmed"),
    )
    steps = F.array(
        F.when(reserve, F.concat(F.lit("Set reserve — "), F.when(has("settlement"), col("settlement")).otherwise("amount TBD"))),
        F.when(recover, "File subrogation preservation letter"),
        F.when(~has("agency") | (col("agency") == "Unknown"), "Request agency supplement"),
        F.when(people > 3, "Review liability across all parties"),
    )
    told = lambda a: F.filter(a, lambda x: x.isNotNull())
    return wide.withColumn("chips", told(chips)).withColumn("actions", F.when(F.size(told(steps)) > 0, told(steps)).otherwise(F.array(F.lit("Review extracted fields and submit to ClaimCenter"))))


def discrepancies(adjuster: DataFrame, police: DataFrame, claim: str = "claim_id") -> DataFrame:
    """(claim_id, type, description): contradictions between an adjuster's and a police record of one claim.

    ``adjuster`` has cause_of_loss, ``police`` accident_type and first_damages, the damages of its first vehicle.
    """
    both = adjuster.select(claim, "cause_of_loss").join(police.select(claim, "accident_type", "first_damages"), claim)
    a, b = F.col("cause_of_loss"), F.col("accident_type")
    found = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("description"))
    cause = F.when(
        (a != "") & (b != "") & (F.lower(a) != F.lower(b)) & (F.lower(a) != "unknown"),
        found("Causality Mismatch", F.concat(F.lit('IA claims "'), a, F.lit('" but Police report states "'), b, F.lit('".'))),
    )
    damage = F.when(
        (F.col("first_damages") == "No Damages") & (a == "Collision"),
        found("Damage Contradiction", F.lit('Police report indicates "No Damages" for Vehicle 1, but IA reports a Collision loss.')),
    )
    return both.select(claim, F.explode(F.filter(F.array(cause, damage), lambda d: d.isNotNull())).alias("d")).select(claim, "d.*")
