"""Queries over ``documents`` and the rendered forms: hits, rules, signals, selection, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plausible, values
from ..operators.candidates import Strategy, generate, reserve_language
from ..operators.classify import accuracy, classify
from ..operators.evaluate import best_confidence
from ..operators.score import score
from ..operators.select import audit, best, duplicate_insights, evidence, ranked, review_flags, summary
from ..operators.validate import Rule, passes, validate
from .forms import order_forms, table

#: The template of the prose documents: what they hold that patterns can find.
PROSE = [
    Strategy("email", patterns=(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+[A-Za-z0-9]",), priority=10),
    Strategy("phone", patterns=(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}",), priority=20),
    Strategy("ip", patterns=(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",), priority=30),
    Strategy("card", patterns=(r"\b[0-9]{16}\b",), priority=40),
    Strategy("token", patterns=(r'token = "(?P<value>[0-9a-f]+)"', r'"([0-9a-f]{8})[0-9a-f]*"'), priority=50),
    Strategy("licence", patterns=(r"(?i)(?:Released|Licensed) under the ([^.\n]+)",), priority=60),
]
RULES = {
    "email": [Rule("expected_type", "email"), Rule("max_length", 60)],
    "ip": [Rule("regex_match", pattern=r"^[0-9.]+$"), Rule("reject_if_starts_with", values=("0.", "127."))],
    "card": [Rule("min_length", 16), Rule("reject_if_contains", values=("0000",))],
    "token": [Rule("min_length", 8), Rule("blacklist", values=("deadbeef",))],
}
LABELS = {"token": ["token"], "licence": ["under the"]}
EXPECTED = {"licence": "footer", "email": "header"}
FIELDS = [(s.field_id, s.field_id == "token") for s in PROSE]


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def scored_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prose(spark, sf_dir)
    return score(validate(generate(docs, PROSE), RULES), LABELS, EXPECTED)


def extract_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generate(prose(spark, sf_dir), PROSE)
    return found.select("doc_id", "field_id", "value", F.col("gen_order.pattern").alias("pattern_idx"), F.col("gen_order.match").alias("match_idx"), (F.col("end") - F.col("start")).alias("span_length"))


def extract_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(scored_prose(spark, sf_dir)).select("doc_id", "field_id", "value", F.round("confidence", 6).alias("confidence"), "start")


def candidate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_prose(spark, sf_dir).select(
        "doc_id", "field_id", "value", F.col("gen_order.pattern").alias("pattern_idx"), F.col("gen_order.match").alias("match_idx"), "rejected",
        *[F.round(c, 6).alias(c) for c in ("label_proximity", "validator_pass", "regex_used", "specificity", "position", "agreement", "plausibility", "confidence")],
    )


def validator_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate(generate(prose(spark, sf_dir), PROSE), RULES)
    return checked.groupBy("field_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("rejected").alias("rejected"), F.sum(F.size(F.filter("validation", lambda r: ~r["passed"]))).alias("failed_rules"))


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit(prose(spark, sf_dir), FIELDS, scored_prose(spark, sf_dir))
    return rows.select("doc_id", "field_id", "value", F.round("confidence", 6).alias("confidence"), F.col("considered").cast("long").alias("considered"), F.col("rejected_count").cast("long").alias("rejected_count"), "needs_review")


def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(audit(prose(spark, sf_dir), FIELDS, scored_prose(spark, sf_dir)))


def duplicate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_insights(scored_prose(spark, sf_dir))


def review_flag_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of each document that need review."""
    flags = review_flags(audit(prose(spark, sf_dir), FIELDS, scored_prose(spark, sf_dir)))
    return flags.select("doc_id", F.nullif(F.array_join(F.map_keys(F.map_filter("flags", lambda k, v: v)), ","), F.lit("")).alias("flagged"))


def evidence_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(generate(prose(spark, sf_dir), PROSE))


def best_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_confidence(scored_prose(spark, sf_dir)).select("doc_id", "field_id", F.round("best_confidence", 6).alias("best_confidence"))


def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(scored_prose(spark, sf_dir)).select("doc_id", "field_id", "rank", "value", F.round("confidence", 6).alias("confidence"))


VALIDATORS = [
    Rule("regex_match", pattern="[0-9]0+"), Rule("reject_if_contains", values=("acme", "#0000001")), Rule("reject_if_starts_with", values=("customer#00000000",)),
    Rule("min_length", 18), Rule("max_length", 18), Rule("blacklist", values=("Customer#000000007",)), Rule("whitelist", values=("Customer#000000007", "Customer#000000008")),
]
TYPED = {
    "phone": "concat('+1 ', lpad(cast(c_custkey as string), 9, '0'))", "date": "concat(c_custkey % 12 + 1, '/', c_custkey % 28 + 1, '/', 1990 + c_custkey % 40)",
    "money": "concat('$', cast(cast(c_custkey as bigint) * 17 as string))", "email": "concat('c', cast(c_custkey as string), '@mail', cast(c_nationkey as string), '.org')",
    "url": "concat('www.', lower(c_mktsegment), '.com/', cast(c_custkey as string))", "fein": "concat(lpad(cast(c_nationkey as string), 2, '0'), '-', lpad(cast(c_custkey as string), 7, '0'))",
    "ssn": "concat('123-45-', lpad(cast(c_custkey as string), 4, '0'))", "naics": "cast(c_custkey as string)", "sic": "cast(c_custkey as string)", "integer": "cast(-c_custkey as string)",
}


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over customer names."""
    return table(spark, sf_dir, "customer").select("c_custkey", *[passes(F.col("c_name"), r).alias(r.type) for r in VALIDATORS])


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value shape over texts made of customer columns."""
    return table(spark, sf_dir, "customer").select("c_custkey", *[passes(F.expr(e), Rule("expected_type", k)).alias(f"is_{k}") for k, e in TYPED.items()])


SHAPES = {"date_format": TYPED["date"], "phone_format": TYPED["phone"], "fein_format": TYPED["fein"]}


def shaped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that are named after a shape, over values that have it or, for every third customer, have not."""
    spoilt = lambda e: F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("z"), F.expr(e))).otherwise(F.expr(e))
    return table(spark, sf_dir, "customer").select("c_custkey", *[passes(spoilt(e), Rule(k)).alias(k) for k, e in SHAPES.items()])


def plausibility_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field's score over texts made of part, supplier and order columns."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "stack(13, "
        "'date_time', concat(p_partkey % 12 + 1, '/', p_partkey % 28 + 1, '/', 1960 + p_partkey % 90), "
        "'report_number', case p_partkey % 3 when 0 then concat('OR-', 2000 + p_partkey % 20, '-', lpad(p_partkey, 6, '0')) when 1 then concat('R', p_partkey, '/7') else concat(p_name, ' no. ', p_partkey) end, "
        "'vin', case p_partkey % 4 when 0 then concat(p_partkey, '') when 1 then lpad(p_partkey, 17, 'I') when 2 then lpad(p_partkey, 17, '-') else lpad(concat(upper(replace(p_brand, '#', '')), p_partkey), 17, '1') end, "
        "'year', cast(1900 + p_partkey % 150 as string), "
        "'weather', concat(p_name, if(p_partkey % 2 = 0, ' and windy', '')), "
        "'light_condition', concat(p_type, if(p_partkey % 3 = 0, ' at dusk', '')), "
        "'officer', concat('Officer ', initcap(p_name)), "
        "'location', concat(p_partkey, ' ', p_name, if(p_partkey % 2 = 0, ' Street', '')), "
        "'accident_type', concat(p_name, if(p_partkey % 2 = 0, ' rear-end collision', '')), "
        "'contributing_factors', if(p_partkey % 5 = 0, concat(p_name, ','), concat(p_name, if(p_partkey % 2 = 0, ' speeding', ''))), "
        "'property_damage', concat(p_name, if(p_partkey % 2 = 0, ' bumper', '')), "
        "'ems_agency', if(p_partkey % 7 = 0, 'N/A', concat(p_name, if(p_partkey % 2 = 0, ' rescue', ''))), "
        "'road_surface', concat(p_name, if(p_partkey % 2 = 0, ' wet', ''))) AS (field_id, value)",
    )
    return rows.select("p_partkey", "field_id", F.round(plausible.plausibility(F.col("field_id"), F.col("value")), 4).alias("score"))


def cleaned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "stack(4, 'date_time', case o_orderkey % 3 when 0 then date_format(o_orderdate, 'M/d/yy HH:mm') when 1 then date_format(o_orderdate, 'MMM d, yyyy') else 'the order was placed on some day of that week' end, "
        "'vin', if(o_orderkey % 2 = 0, lpad(o_orderkey, 17, 'a'), cast(o_orderkey as string)), "
        "'report_number', if(o_orderkey % 2 = 0, concat(' OR-', o_orderkey), 'the report number is not known'), "
        "'officer', if(o_orderkey % 2 = 0, 'NAME OF REPORTING OFFICER', o_orderpriority)) AS (field_id, value)",
    )
    return rows.select("o_orderkey", "field_id", values.clean(F.col("field_id"), F.col("value")).alias("cleaned"), values.field_quality(F.col("field_id"), F.col("value")).alias("quality"))


def classified_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(order_forms(spark, sf_dir), FINGERPRINTS, STATES)


FINGERPRINTS = [
    ("urgent_form", (r"ORDER REPORT FORM 1",)),
    ("urgent_open", (r"ORDER REPORT FORM 2", r"\[X\] Open")),
    ("medium_form", (r"order report form 3",)),
    ("bulk_form", (r"no such text", r"ITEM 6:")),
]
STATES = {"urgent_form": "AZ", "urgent_open": "CA", "medium_form": "FL", "bulk_form": "GA"}


def classifier_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderpriority").startswith("1"), "urgent_form").when(F.col("o_orderpriority").startswith("2"), "urgent_open").when(F.col("o_orderpriority").startswith("3"), "medium_form").otherwise("generic_mmucc").alias("expected"),
    )
    return accuracy(classified_forms(spark, sf_dir), expected)


def reserve_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prose(spark, sf_dir).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, ". We set the reserve at once. More follows").otherwise("")))
    flag, sentence = reserve_language(F.col("text"))
    return docs.select("doc_id", flag.alias("flagged"), sentence.alias("sentence")).where("flagged")


_HITS = r"""
    WITH patterns(field_id, pattern_idx, pattern, g, priority) AS (VALUES
        ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+[A-Za-z0-9]', 0, 10),
        ('phone', 0, '\([0-9]{3}\) [0-9]{3}-[0-9]{4}', 0, 20),
        ('ip', 0, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', 0, 30),
        ('card', 0, '\b[0-9]{16}\b', 0, 40),
        ('token', 0, 'token = "([0-9a-f]+)"', 1, 50),
        ('token', 1, '"([0-9a-f]{8})[0-9a-f]*"', 1, 50),
        ('licence', 0, '(?i)(?:Released|Licensed) under the ([^.\n]+)', 1, 60)
    ), found AS (
        SELECT doc_id, text, field_id, pattern_idx, priority,
               CASE WHEN g = 1 THEN list_zip(regexp_extract_all(text, pattern, 0), regexp_extract_all(text, pattern, 1))
                    ELSE list_zip(regexp_extract_all(text, pattern, 0), regexp_extract_all(text, pattern, 0)) END AS hits
        FROM documents, patterns
    ), each AS (
        SELECT doc_id, text, field_id, pattern_idx, priority, i - 1 AS match_idx, hits[i][1] AS raw, trim(hits[i][2]) AS value
        FROM found, unnest(range(1, len(hits) + 1)) AS u(i)
    ), hits AS (SELECT * FROM each WHERE value <> '')
"""
_RULED = _HITS + r"""
    , ruled AS (
        SELECT *,
            CASE field_id
                WHEN 'email' THEN [regexp_matches(value, '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$'), length(value) <= 60]
                WHEN 'ip' THEN [regexp_matches(value, '^[0-9.]+$'), NOT (starts_with(value, '0.') OR starts_with(value, '127.'))]
                WHEN 'card' THEN [length(value) >= 16, NOT contains(value, '0000')]
                WHEN 'token' THEN [length(value) >= 8, value <> 'deadbeef']
                ELSE [] END AS checks
        FROM hits
    ), checked AS (
        SELECT *, len(list_filter(checks, lambda c: NOT c)) AS failed, len(list_filter(checks, lambda c: NOT c)) > 0 AS rejected FROM ruled
    )
"""

#: Where each hit starts: the gaps and hits before it, counted.
_PLACED = _HITS.replace("SELECT doc_id, text, field_id, pattern_idx, priority, i - 1", "SELECT doc_id, text, field_id, pattern_idx, priority, string_split_regex(text, pattern) AS gaps, list_transform(hits, lambda h: h[1]) AS raws, i - 1").replace(
    "FROM found, unnest", "FROM (SELECT f.*, p.pattern FROM found f JOIN patterns p USING (field_id, pattern_idx)), unnest"
)
#: The eight signals by their definitions: weights .15, .15, .05, .10, .05, .15, .35 and the bonus of a priority.
_SCORED = (
    _RULED.replace(_HITS, _PLACED)
    + r"""
    , placed AS (
        SELECT *, (coalesce(list_sum(list_transform(gaps[1:match_idx + 1], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(raws[1:match_idx], lambda r: length(r))), 0))::INT AS start,
               CASE field_id WHEN 'token' THEN 'token' WHEN 'licence' THEN 'under the' END AS label
        FROM checked
    ), near AS (
        SELECT *, lower(substr(text, greatest(start - 80, 0) + 1, start + least(60, 20 + length(label)) - greatest(start - 80, 0))) AS around FROM placed
    ), pooled AS (
        SELECT *, strpos(reverse(around), reverse(label)) AS back,
               count(DISTINCT pattern_idx) OVER pool AS n_patterns, count(*) FILTER (WHERE NOT rejected) OVER pool AS kept,
               count(DISTINCT CASE WHEN NOT rejected THEN lower(value) END) OVER pool AS n_values,
               count(*) FILTER (WHERE NOT rejected) OVER (PARTITION BY doc_id, field_id, lower(value)) AS agree
        FROM near WINDOW pool AS (PARTITION BY doc_id, field_id)
    ), signals AS (
        SELECT *,
            CASE WHEN label IS NULL THEN 0.5 WHEN back = 0 THEN 0.1
                 WHEN greatest(start - (greatest(start - 80, 0) + length(around) - back - length(label) + 1), 0) <= 30 THEN 1.0 ELSE 0.7 END::DOUBLE AS label_proximity,
            CASE WHEN rejected THEN 0.0 ELSE 1.0 END::DOUBLE AS validator_pass, 1.0::DOUBLE AS regex_used,
            -- Both token patterns sum to 0.6, but as doubles the first is the larger by its last bit, and equality is exact.
            CASE WHEN n_patterns > 1 THEN CASE pattern_idx WHEN 0 THEN 1.0 ELSE 0.4 END ELSE CASE field_id WHEN 'email' THEN 0.568 WHEN 'ip' THEN 0.5872 WHEN 'card' THEN 0.5512 WHEN 'token' THEN 0.544 ELSE 0.556 END END::DOUBLE AS specificity,
            CASE field_id WHEN 'email' THEN CASE WHEN start::DOUBLE / length(text) <= 0.25 THEN 1.0 WHEN start::DOUBLE / length(text) <= 0.5 THEN 0.7 ELSE 0.4 END
                          WHEN 'licence' THEN CASE WHEN start::DOUBLE / length(text) >= 0.75 THEN 1.0 WHEN start::DOUBLE / length(text) >= 0.5 THEN 0.7 ELSE 0.4 END
                          ELSE 0.5 END::DOUBLE AS position,
            CASE WHEN kept <= 1 THEN 0.6 WHEN agree >= 3 THEN 1.0 WHEN agree = 2 THEN 0.85 WHEN n_values > 1 THEN 0.3 ELSE 0.6 END::DOUBLE AS agreement,
            0.5::DOUBLE AS plausibility
        FROM pooled
    ), scored AS (
        SELECT *, round(CASE WHEN rejected THEN 0.0 ELSE 0.15 * label_proximity + 0.15 * validator_pass + 0.05 * regex_used + 0.1 * specificity + 0.05 * position + 0.15 * agreement + 0.35 * plausibility
                                  + least(0.02, (100 - priority) * 0.0002) END, 6)::DOUBLE AS confidence
        FROM signals
    ), chosen AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY rejected, confidence DESC, pattern_idx, match_idx) AS nth,
               row_number() OVER (PARTITION BY doc_id, field_id ORDER BY confidence DESC, pattern_idx, match_idx)::INT AS rank,
               count(*) OVER (PARTITION BY doc_id, field_id) AS considered, count(*) FILTER (WHERE rejected) OVER (PARTITION BY doc_id, field_id) AS rejected_count
        FROM scored
    )
"""
)
_AUDIT = (
    _SCORED
    + """
    , audit AS (
        SELECT d.doc_id, f.field_id, CASE WHEN NOT rejected THEN value END AS value, CASE WHEN NOT rejected THEN confidence END AS confidence,
               coalesce(considered, 0) AS considered, coalesce(rejected_count, 0) AS rejected_count,
               coalesce(CASE WHEN NOT rejected THEN confidence END < 0.6, f.field_id = 'token') AS needs_review
        FROM documents d CROSS JOIN (SELECT unnest(['email', 'phone', 'ip', 'card', 'token', 'licence']) AS field_id) f
        LEFT JOIN (SELECT * FROM chosen WHERE nth = 1) c ON c.doc_id = d.doc_id AND c.field_id = f.field_id
    )
"""
)

ORACLE_SQL = {
    "extract_best": _SCORED + "SELECT doc_id, field_id, value, confidence, start FROM chosen WHERE nth = 1 AND NOT rejected",
    "candidate_signals": _SCORED
    + """SELECT doc_id, field_id, value, pattern_idx::INT AS pattern_idx, match_idx::INT AS match_idx, rejected, label_proximity, validator_pass, regex_used, specificity, position, agreement, plausibility, confidence FROM scored""",
    "candidate_ranking": _SCORED + "SELECT doc_id, field_id, rank, value, confidence FROM chosen",
    "audit_rows": _AUDIT + "SELECT * FROM audit",
    "summary_stats": _AUDIT
    + """SELECT doc_id, count(*) AS total_fields, count(value) AS extracted_fields, count_if(value IS NOT NULL AND needs_review)::BIGINT AS low_confidence_fields,
               round(coalesce(avg(confidence), 0), 4)::DOUBLE AS average_confidence FROM audit GROUP BY doc_id""",
    "review_flag_maps": _AUDIT + "SELECT doc_id, string_agg(field_id, ',' ORDER BY field_id) FILTER (WHERE needs_review) AS flagged FROM audit GROUP BY doc_id",
    "evidence_fields": _HITS + "SELECT DISTINCT doc_id, field_id FROM hits",
    "best_confidences": _SCORED + "SELECT doc_id, field_id, max(confidence)::DOUBLE AS best_confidence FROM scored WHERE NOT rejected GROUP BY ALL",
    "extract_hits": _HITS + "SELECT doc_id, field_id, value, pattern_idx::INT AS pattern_idx, match_idx::INT AS match_idx, length(raw)::INT AS span_length FROM hits",
    "validator_outcomes": _RULED + "SELECT field_id, count(*) AS candidates, count_if(rejected)::BIGINT AS rejected, sum(failed)::BIGINT AS failed_rules FROM checked GROUP BY field_id",
    "duplicate_fields": _RULED
    + """
        , many AS (SELECT doc_id, field_id, count(*) AS n_candidates FROM checked GROUP BY ALL HAVING count(*) > 1)
        , agree AS (SELECT *, count(*) FILTER (WHERE NOT rejected) OVER (PARTITION BY doc_id, field_id, lower(value)) AS a,
                       CASE WHEN contains(lower(text), lower(raw)) THEN strpos(text, raw) END AS at FROM checked)
        SELECT m.doc_id, m.field_id, m.n_candidates, b.value AS chosen FROM many m LEFT JOIN (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY
                CASE WHEN field_id = 'token' THEN pattern_idx ELSE 0 END,
                CASE WHEN field_id IN ('token', 'licence', 'email') THEN 0 ELSE -least(a, 3) END, match_idx) AS nth FROM agree WHERE NOT rejected) WHERE nth = 1
        ) b ON m.doc_id = b.doc_id AND m.field_id = b.field_id
    """,
    "validators": r"""
        SELECT c_custkey, regexp_matches(c_name, '[0-9]0+') AS regex_match,
               NOT (contains(upper(c_name), 'ACME') OR contains(upper(c_name), '#0000001')) AS reject_if_contains,
               NOT starts_with(upper(c_name), 'CUSTOMER#00000000') AS reject_if_starts_with,
               length(c_name) >= 18 AS min_length, length(c_name) <= 18 AS max_length,
               c_name <> 'Customer#000000007' AS blacklist, c_name IN ('Customer#000000007', 'Customer#000000008') AS whitelist
        FROM customer
    """,
    "shaped_values": """
        SELECT c_custkey, c_custkey % 3 <> 0 AS date_format, c_custkey % 3 <> 0 AND length('+1 ' || lpad(c_custkey::VARCHAR, 9, '0')) >= 10 AS phone_format, c_custkey % 3 <> 0 AND length(c_custkey::VARCHAR) <= 7 AS fein_format FROM customer
    """,
    "typed_values": r"""
        SELECT c_custkey,
               regexp_full_match('+1 ' || lpad(c_custkey::VARCHAR, 9, '0'), '[\d\s().+\-x]{10,}') AS is_phone,
               true AS is_date, true AS is_money, true AS is_email, true AS is_url, length(lpad(c_custkey::VARCHAR, 7, '0')) = 7 AS is_fein,
               length(lpad(c_custkey::VARCHAR, 4, '0')) = 4 AS is_ssn,
               c_custkey BETWEEN 1000 AND 999999 AS is_naics, c_custkey BETWEEN 1000 AND 9999 AS is_sic, true AS is_integer
        FROM customer
    """,
    "classified_forms": """
        WITH n AS (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1),
             f AS (SELECT *, substr(o_orderpriority, 1, 1) AS p FROM orders LEFT JOIN n ON o_orderkey = l_orderkey),
             c AS (SELECT o_orderkey AS doc_id, CASE WHEN p = '1' THEN 'urgent_form' WHEN p = '2' OR o_orderstatus = 'O' THEN 'urgent_open' WHEN p = '3' THEN 'medium_form' WHEN coalesce(items, 0) >= 6 THEN 'bulk_form' ELSE 'generic_mmucc' END AS form_id FROM f)
        SELECT doc_id, form_id, CASE WHEN form_id = 'generic_mmucc' THEN 0.4::DOUBLE ELSE 0.95::DOUBLE END AS form_confidence,
               CASE form_id WHEN 'urgent_form' THEN 'AZ' WHEN 'urgent_open' THEN 'CA' WHEN 'medium_form' THEN 'FL' WHEN 'bulk_form' THEN 'GA' END AS state
        FROM c
    """,
    "classifier_accuracy": """
        WITH n AS (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1),
             f AS (SELECT *, substr(o_orderpriority, 1, 1) AS p FROM orders LEFT JOIN n ON o_orderkey = l_orderkey),
             c AS (SELECT CASE WHEN p = '1' THEN 'urgent_form' WHEN p = '2' OR o_orderstatus = 'O' THEN 'urgent_open' WHEN p = '3' THEN 'medium_form' WHEN coalesce(items, 0) >= 6 THEN 'bulk_form' ELSE 'generic_mmucc' END AS form_id, CASE p WHEN '1' THEN 'urgent_form' WHEN '2' THEN 'urgent_open' WHEN '3' THEN 'medium_form' ELSE 'generic_mmucc' END AS expected FROM f),
             s AS (SELECT CASE form_id WHEN 'urgent_form' THEN 'AZ' WHEN 'urgent_open' THEN 'CA' WHEN 'medium_form' THEN 'FL' WHEN 'bulk_form' THEN 'GA' ELSE 'none' END AS state, form_id = expected AS ok FROM c)
        SELECT state, count(*) AS documents, count_if(ok)::BIGINT AS correct, round(avg(ok::INT), 4) AS accuracy FROM s GROUP BY state
    """,
    "cleaned_values": r"""
        WITH v AS (
            SELECT o_orderkey, unnest(['date_time', 'vin', 'report_number', 'officer']) AS field_id,
                   unnest([CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE 'Unknown' END,
                           CASE WHEN o_orderkey % 2 = 0 THEN upper(lpad(o_orderkey::VARCHAR, 17, 'a')) ELSE 'Unknown' END,
                           CASE WHEN o_orderkey % 2 = 0 THEN 'OR-' || o_orderkey ELSE 'Unknown' END,
                           CASE WHEN o_orderkey % 2 = 0 THEN 'Unknown' ELSE o_orderpriority END]) AS cleaned,
                   unnest([CASE WHEN o_orderkey % 3 = 2 THEN 0.4 ELSE 1.0 END, 1.0, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.2 END, 1.0]) AS quality,
                   o_orderdate, o_orderkey % 3 AS shape
            FROM orders)
        SELECT o_orderkey, field_id,
               CASE WHEN field_id = 'date_time' AND shape = 0 THEN strftime(o_orderdate, '%m/%d/') || '20' || strftime(o_orderdate, '%y')
                    WHEN field_id = 'vin' AND o_orderkey % 2 <> 0 THEN 'Unknown' ELSE cleaned END AS cleaned,
               CASE WHEN field_id = 'vin' AND length(o_orderkey::VARCHAR) < 3 AND o_orderkey % 2 <> 0 THEN 0.5 ELSE quality END::DOUBLE AS quality
        FROM v
    """,
    "plausibility_scores": r"""
        WITH v AS (
            SELECT p_partkey, unnest(['date_time', 'report_number', 'vin', 'year', 'weather', 'light_condition', 'officer', 'accident_type', 'property_damage', 'ems_agency', 'road_surface', 'location', 'contributing_factors']) AS field_id,
                   unnest([
                     CASE WHEN 1960 + p_partkey % 90 BETWEEN 1990 AND 2027 THEN 1.0 WHEN 1960 + p_partkey % 90 BETWEEN 1970 AND 2040 THEN 0.5 ELSE 0.2 END,
                     CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN length('R' || p_partkey || '/7') >= 4 THEN 0.8 ELSE 0.3 END
                          ELSE CASE WHEN length(p_name || ' no. ' || p_partkey) <= 40 THEN 0.4 ELSE 0.3 END END,
                     CASE p_partkey % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE CASE WHEN regexp_matches(lpad(upper(replace(p_brand, '#', '')) || p_partkey, 17, '1'), '^[A-HJ-NPR-Z0-9]{17}$') THEN 1.0 ELSE 0.7 END END,
                     CASE WHEN 1900 + p_partkey % 150 BETWEEN 1990 AND 2027 THEN 1.0 ELSE 0.2 END,
                     CASE WHEN p_partkey % 2 = 0 OR regexp_matches(lower(p_name), 'clear|rain|snow|sleet|hail|fog|cloud|overcast|mist|drizzl|storm|thunder|sunny|ice|icy|blowing|smoke|smog|dust|sand|wind|partly') THEN 1.0 WHEN regexp_matches(p_name, '[0-9]') THEN 0.3 ELSE 0.4 END,
                     CASE WHEN p_partkey % 3 = 0 OR regexp_matches(lower(p_type), 'dusk|dawn|dark|night|lighted|unknown lighting|day|noon') THEN 1.0 WHEN regexp_matches(p_type, '[0-9]') THEN 0.3 ELSE 0.4 END,
                     1.0,
                     CASE WHEN length(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' rear-end collision' ELSE '' END) < 5 THEN 0.2 WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.6 END,
                     CASE WHEN length(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' bumper' ELSE '' END) < 10 THEN 0.2 WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END,
                     CASE WHEN p_partkey % 7 = 0 THEN 0.3 WHEN length(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' rescue' ELSE '' END) < 5 THEN 0.2 WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END,
                     CASE WHEN regexp_matches(p_name, '[0-9]') THEN 0.2 WHEN p_partkey % 2 = 0 OR regexp_matches(lower(p_name), 'wet|dry|ice|icy|snow|slush|water|frost|freezing rain|mud|gravel|sand|oil') THEN 1.0 ELSE 0.5 END,
                     CASE WHEN p_partkey % 2 = 0 THEN 1.0 WHEN length(p_partkey || ' ' || p_name) < 10 THEN 0.2 ELSE 0.6 END,
                     CASE WHEN p_partkey % 5 = 0 THEN 0.3 WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END]) AS score
            FROM part)
        SELECT p_partkey, field_id, score::DOUBLE AS score FROM v
    """,
    "reserve_flags": "SELECT doc_id, true AS flagged, 'We set the reserve at once.' AS sentence FROM documents WHERE doc_id % 3 = 0",
}

QUERIES = {
    f.__name__: f
    for f in (
        extract_hits, extract_best, candidate_signals, validator_outcomes, audit_rows, summary_stats, duplicate_fields, candidate_ranking, review_flag_maps, evidence_fields, best_confidences,
        validators, typed_values, shaped_values, plausibility_scores, cleaned_values, classified_forms, classifier_accuracy, reserve_flags,
    )
}
