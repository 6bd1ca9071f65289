"""Templates as small tables: fields, strategies, patterns, validators.

A template field is a row; adding a field never changes code.  Template tables
are made by people and hold at most some thousands of rows; ``checked`` refuses
more than ``MOST_ROWS``, which is what lets them be broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 50_000
STRATEGIES = ("global_regex", "nearby_text", "spatial_label", "checkbox_grid", "advanced_table")
FIELD_TYPES = (
    "text", "number", "integer", "money", "date", "time", "email", "phone", "url", "fein", "ssn", "naics", "sic", "person_name",
    "organization_name", "address", "bool", "enum", "checkbox", "list_of_objects",
)
FIELD_SCHEMA = "field_id string, type string, required boolean, label_text array<string>, expected_position string"
PATTERN_SCHEMA = "field_id string, strategy string, priority int, strategy_idx int, pattern_idx int, pattern string, value_group int"
VALIDATOR_SCHEMA = "field_id string, rule_idx int, type string, value string, `values` array<string>, pattern string"


def java_pattern(pattern: str) -> tuple[str, int]:
    """A Python-style pattern for Java, and the number of its value group (0 without groups).

    Named groups become plain ones, since Java names allow no underscore; the group
    named ``value`` wins, then group 1.
    """
    number, value = 0, None
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append({"Z": "\\z"}.get(pattern[i + 1 : i + 2], pattern[i : i + 2]))
            i += 2
            continue
        in_class = c == "[" if not in_class else c != "]"
        if c == "(" and not in_class:
            named = re.match(r"\(\?P<(\w+)>", pattern[i:])
            if named or not pattern.startswith("(?", i):
                number += 1
                if named:
                    value = number if named[1] == "value" else value
                    out.append("(")
                    i += named.end()
                    continue
        out.append(c)
        i += 1
    return "".join(out), value or (1 if number else 0)


def valid_pattern(pattern: str) -> bool:
    """Whether a pattern compiles; templates may hold ones that do not, which are skipped."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def checked_rows(df: DataFrame, most: int = MOST_ROWS) -> list:
    """The rows of :func:`checked`, computed once."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a template or lookup table has more than {most} rows")
    return rows


def checked(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` if it has at most ``most`` rows: what may be broadcast has a proven bound."""
    if len(df.limit(most + 1).select(F.lit(1)).collect()) > most:
        raise ValueError(f"a template or lookup table has more than {most} rows")
    return df


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """One row per template field of the JSON files of a folder; unknown strategies are refused."""
    raw = spark.read.json(path, multiLine=True, schema=(
        "doc_type string, auto_accept_threshold double, fields array<struct<field_id:string,type:string,required:boolean,label_text:array<string>,"
        "expected_position:string,strategies:array<struct<name:string,priority:int,patterns:array<string>>>,"
        "validators:array<struct<type:string,value:string,values:array<string>,pattern:string>>>>"
    ))
    rows = raw.select("doc_type", F.coalesce("auto_accept_threshold", F.lit(0.85)).alias("threshold"), F.posexplode("fields").alias("position", "f")).select("doc_type", "threshold", "position", "f.*")
    bad = rows.select(F.explode("strategies.name").alias("name")).where(~F.col("name").isin(*STRATEGIES)).limit(1).collect()
    if bad:
        raise ValueError(f"no such strategy: {bad[0].name}")
    return rows


def template_or_empty(templates: DataFrame, doc_type: str) -> DataFrame:
    """Fields of a document type; none for a type without a template."""
    return templates.where(F.col("doc_type") == doc_type)


def merge(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay fields replace base fields of the same id and new ones follow; hints left empty are inherited.

    Columns: field_id, position, strategies, label_text, expected_position, validators.
    """
    filled = lambda c: F.when(F.size(c) > 0, c)
    b, o = base.alias("b"), overlay.alias("o")
    end = base.agg(F.coalesce(F.max("position") + 1, F.lit(0))).first()[0]
    both = b.join(o, "field_id", "full_outer")
    return both.select(
        "field_id",
        F.coalesce(F.col("b.position"), F.col("o.position") + end).alias("position"),
        F.when(F.col("o.strategies").isNotNull(), F.col("o.strategies")).otherwise(F.col("b.strategies")).alias("strategies"),
        F.coalesce(filled(F.col("o.label_text")), F.col("b.label_text")).alias("label_text"),
        F.coalesce(F.nullif(F.col("o.expected_position"), F.lit("")), F.col("b.expected_position")).alias("expected_position"),
        F.coalesce(filled(F.col("o.validators")), F.col("b.validators")).alias("validators"),
        F.col("o.position").isNotNull().alias("overlaid"),
    )


def custom_patterns(names: list[str]) -> list[tuple[str, list[str]]]:
    """(field id, patterns) for fields that users added: a table cell, a heading's body, a label with a separator."""
    out = []
    for name in dict.fromkeys(names):
        q = re.escape(name)
        out.append((f"dynamic_{name}", [
            rf"(?is)\|\s*{q}\s*\|\s*([^|\n]+?)\s*\|",
            rf"(?is)#+\s*{q}\s*\n+([^\n#]+)",
            rf"(?is)\b{q}\b\s*[:\-]\s*([^\n]+)",
        ]))
    return out


def patterns_of(fields: DataFrame) -> DataFrame:
    """(field_id, strategy, priority, strategy_idx, pattern_idx, pattern) in generation order."""
    return (
        fields.select("field_id", F.posexplode("strategies").alias("strategy_idx", "s"))
        .select("field_id", F.col("s.name").alias("strategy"), F.col("s.priority").alias("priority"), "strategy_idx", F.posexplode("s.patterns").alias("pattern_idx", "pattern"))
    )


def raw_specificity(pattern: Column) -> Column:
    """How specific a pattern is: digit and word classes, sets, anchors and literal words add, greedy dots subtract."""
    n = lambda p: F.regexp_count(pattern, F.lit(p))
    s = (
        0.50 + n(r"\\d") * 0.08 + n(r"\\w") * 0.03 + n(r"\[[^\]]+\]") * 0.05 + n(r"(?<!\[)(?<!\\)\^") * 0.06 + n(r"(?<!\\)\$") * 0.06
        + n(r"\\b") * 0.04 + F.least(n(r"(?<![\\(|{])[A-Za-z]{3,}"), F.lit(8)) * 0.025 - n(r"\.\+(?!\?)") * 0.20 - n(r"\.\*(?!\?)") * 0.25
    )
    return F.greatest(F.lit(0.05), s)
