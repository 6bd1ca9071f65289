"""Confidence of a candidate from eight signals over its field's candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap
from ..functions.plausible import plausibility
from .candidates import AFTER, BEFORE
from .templates import raw_specificity

#: The weight of each signal.
WEIGHTS = {
    "label_proximity": 0.15, "validator_pass": 0.15, "regex_used": 0.05, "specificity": 0.10,
    "position": 0.05, "agreement": 0.15, "plausibility": 0.35, "overlap_penalty": -0.05,
}


def text_distance(window: Column, start: Column, term: str) -> Column:
    """Characters from the nearest label before a match to the match, looking 80 back and 60 ahead; null if there is none.

    ``window`` is the text from ``BEFORE`` characters before the match to ``AFTER`` behind its start.
    """
    begin = F.greatest(start - BEFORE, F.lit(0))
    near = F.lower(F.left(window, start - begin + F.lit(min(AFTER, 20 + len(term)))))
    back = F.call_function("instr", F.reverse(near), F.lit(term.lower()[::-1]))
    return F.when(back > 0, F.greatest(start - (begin + F.length(near) - back - len(term) + 1), F.lit(0)))


def label_proximity(labels: dict[str, list[str]], window: Column) -> Column:
    """Of candidates from text: near a declared label or not; 0.5 where the field declares none."""
    out = F.lit(0.5)
    for field, terms in labels.items():
        if terms:
            near = [text_distance(window, F.col("start"), t) for t in terms]
            d = F.least(*near) if len(near) > 1 else near[0]
            ladder = F.when(F.col("start").isNull() | d.isNull(), 0.1).when(d <= 30, 1.0).when(d <= 80, 0.7).when(d <= 200, 0.4).otherwise(0.1)
            out = F.when(F.col("field_id") == field, ladder).otherwise(out)
    return out


def box_proximity(distance: Column) -> Column:
    return F.when(distance.isNull(), 0.5).when(distance <= 30, 1.0).when(distance >= 200, 0.0).otherwise(1.0 - (distance - 30) / 170.0)


def position(expected: dict[str, str], text_length: Column) -> Column:
    """Page one or not; without a page, how far down the text a header or footer field was found."""
    rel = F.col("start") / text_length
    header = F.when(rel <= 0.25, 1.0).when(rel <= 0.50, 0.70).otherwise(0.40)
    footer = F.when(rel >= 0.75, 1.0).when(rel >= 0.50, 0.70).otherwise(0.40)
    out = F.when(F.col("page").isNotNull(), F.when(F.col("page") == 1, 1.0).otherwise(0.7)).when(F.col("start").isNull() | (text_length == 0), 0.5)
    for field, where in expected.items():
        if where in ("header", "footer"):
            out = out.when(F.col("field_id") == field, header if where == "header" else footer)
    return out.otherwise(0.5)


def score(candidates: DataFrame, labels: dict[str, list[str]] | None = None, expected: dict[str, str] | None = None, year_now: int = 2026, plausible: dict | None = None) -> DataFrame:
    """Validated ``candidates`` with a column per signal and ``confidence`` (0 for rejected ones).

    Candidates carry what scoring needs of their text (``window``, ``text_length``), so nothing but them is shuffled.
    Boxes are optional: with columns ``bbox`` and ``label_bbox`` (and
    ``label_distance``) the signals of layout candidates apply.
    """
    boxed = {"bbox", "label_bbox"} <= set(candidates.columns)
    has_box = F.col("bbox").isNotNull() if boxed else F.lit(False)
    both = has_box & F.col("label_bbox").isNotNull() if boxed else F.lit(False)
    pool = Window.partitionBy("doc_id", "field_id")
    same = F.lower(F.trim(F.col("value")))
    kept = ~F.col("rejected")
    texted = {"window", "text_length"} <= set(candidates.columns)
    window = F.coalesce("window", F.lit("")) if texted else F.lit("")
    length = F.coalesce("text_length", F.lit(0)) if texted else F.lit(0)
    joined = candidates.withColumns({
        "_raw": raw_specificity(F.col("match_pattern")),
        "_same": same,
    })
    regex_raw = F.when((F.col("strategy") == "global_regex") & F.col("match_pattern").isNotNull(), F.col("_raw"))
    joined = joined.withColumns({
        "_patterns": F.size(F.collect_set(F.when(regex_raw.isNotNull(), F.col("match_pattern"))).over(pool)),
        "_low": F.min(regex_raw).over(pool),
        "_high": F.max(regex_raw).over(pool),
        "_kept": F.sum(kept.cast("int")).over(pool),
        "_values": F.size(F.collect_set(F.when(kept, F.col("_same"))).over(pool)),
        "_agree": F.sum(kept.cast("int")).over(Window.partitionBy("doc_id", "field_id", "_same")),
    })
    clamped = lambda x: F.round(F.greatest(F.lit(0.40), F.least(F.lit(1.0), x)), 4)
    raw, low, high = F.col("_raw"), F.col("_low"), F.col("_high")
    signals = {
        "label_proximity": F.when(both, box_proximity(F.col("label_distance") if "label_distance" in candidates.columns else F.lit(None).cast("double"))).otherwise(label_proximity(labels or {}, window)),
        "validator_pass": F.when(F.col("n_rules") == 0, 1.0).when(F.col("rejected"), 0.0).otherwise(F.size(F.filter("validation", lambda r: r["passed"])) / F.col("n_rules")),
        "regex_used": F.when(F.col("match_pattern").isNotNull(), 1.0).otherwise(0.5),
        "specificity": F.when(F.col("match_pattern").isNull(), 0.70)
        .when(F.col("_patterns") <= 1, clamped(0.40 + raw / 2.5 * 0.60))
        .when(high == low, 0.70)
        .otherwise(clamped(0.40 + (raw - low) / (high - low) * 0.60)),
        "position": position(expected or {}, length),
        "agreement": F.when(both, 0.5)
        .when(F.col("_kept") <= 1, 0.60)
        .when(F.col("_agree") >= 3, 1.0)
        .when(F.col("_agree") == 2, 0.85)
        .when(F.col("_values") > 1, 0.30)
        .otherwise(0.60),
        "plausibility": F.when(has_box, 0.5).otherwise(plausibility(F.col("field_id"), F.col("value"), year_now, plausible)),
        "overlap_penalty": F.when(both, overlap(F.col("bbox"), F.col("label_bbox")).cast("double")).otherwise(0.0) if boxed else F.lit(0.0),
    }
    bonus = F.least(F.lit(0.02), F.greatest(F.lit(0.0), (100 - F.greatest(F.col("priority"), F.lit(0))) * 0.0002))
    scored = joined.withColumns(signals)
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * F.col(name)
    confidence = F.when(F.col("rejected"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total + bonus)))
    return scored.withColumn("confidence", confidence).drop("window", "text_length", "_raw", "_same", "_patterns", "_low", "_high", "_kept", "_values", "_agree")
