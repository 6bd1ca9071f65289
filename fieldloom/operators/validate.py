"""Validators: rules of a field that a candidate must pass; a failed rule rejects it, all rules are recorded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_type


@dataclass(frozen=True)
class Rule:
    type: str
    value: str | int | None = None
    values: tuple[str, ...] = ()
    pattern: str = ""


def passes(v: Column, rule: Rule) -> Column:
    """Whether a value passes one rule; an unknown rule never passes."""
    t = rule.type
    if t == "regex_match":
        return v.rlike(rule.pattern) if rule.pattern else F.lit(False)
    if t == "reject_if_contains":
        out = F.lit(True)
        for s in rule.values:
            out = out & ~F.upper(v).contains(s.upper())
        return out
    if t == "reject_if_starts_with":
        out = F.lit(True)
        for s in rule.values:
            out = out & ~F.upper(v).startswith(s.upper())
        return out
    if t == "min_length":
        return F.length(v) >= int(rule.value or 0)
    if t == "max_length":
        return F.length(v) <= int(rule.value or 0)
    if t == "expected_type":
        return is_type(v, F.lit(str(rule.value or "")))
    if t in ("date_format", "phone_format", "fein_format"):
        return is_type(v, F.lit(t.removesuffix("_format")))
    if t == "blacklist":
        return ~v.isin(*rule.values) if rule.values else F.lit(True)
    if t == "whitelist":
        return v.isin(*rule.values) if rule.values else F.lit(False)
    return F.lit(False)


def validate(candidates: DataFrame, rules: dict[str, list[Rule]]) -> DataFrame:
    """``candidates`` with ``validation`` (type, passed, in rule order), ``n_rules`` and ``rejected``."""
    checks = F.array().cast("array<struct<validator_type:string,passed:boolean>>")
    for field, own in rules.items():
        if own:
            here = F.array(*[F.struct(F.lit(r.type).alias("validator_type"), F.coalesce(passes(F.col("value"), r), F.lit(False)).alias("passed")) for r in own])
            checks = F.when(F.col("field_id") == field, here).otherwise(checks)
    return (
        candidates.withColumn("validation", checks)
        .withColumn("n_rules", F.size("validation"))
        .withColumn("rejected", F.exists("validation", lambda r: ~r["passed"]))
    )
