"""Spans of pattern matches with DataFrame functions only.

Offsets count code points; matches come from ``functions.spans``.  Patterns are Java ones and are written so that a
match takes time in proportion to the text whatever it holds: runs begin only
where a run can begin, and loops are possessive (they neither back off nor
recurse).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import matches, once

__all__ = ["apart", "blocks_of", "matches", "meets", "merged", "of_kind", "ordered", "redacted", "written"]


def of_kind(spans: Column, kind: str, rank: int) -> Column:
    """Spans in the common shape (start, rank, end, kind)."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def ordered(*spans: Column) -> Column:
    """All spans by start, then kind as listed, then end."""
    return F.array_sort(F.concat(*spans))


def written(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def blocks_of(spans: Column) -> Column:
    """Ordered spans in blocks with the bounds of each, so that a lookup reads few of them."""

    def bounded(part: Column) -> Column:
        return F.struct(F.array_min(part["start"]).alias("low"), F.array_max(part["end"]).alias("high"), part.alias("spans"))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / 64).cast("int")), lambda i: bounded(F.slice(all_, i * 64 + 1, 64)))
    return once(spans, cut)


def meets(span: Column, blocks: Column, exactly: bool = False) -> Column:
    """Whether a span overlaps (or ``exactly`` equals) one of the spans in ``blocks``."""
    over = lambda low, high: (span["start"] < high) & (low < span["end"])
    same = lambda o: (span["start"] == o["start"]) & (span["end"] == o["end"])
    one = same if exactly else (lambda o: over(o["start"], o["end"]))
    return F.exists(blocks, lambda b: F.coalesce(over(b["low"], b["high"]), F.lit(False)) & F.exists(b["spans"], one))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return once(blocks_of(others), lambda blocks: F.filter(spans, lambda s: ~meets(s, blocks)))


def merged(spans: Column) -> Column:
    """Ordered spans with overlapping ones united; a union takes the kind of its first span."""
    last = lambda a: F.element_at(a, -1)
    shape = "array<struct<start:int,end:int,kind:string>>"
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.aggregate(
        plain,
        F.array().cast(shape),
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["start"] < F.try_element_at(a, F.lit(-1))["end"]),
            F.concat(
                F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.try_element_at(a, F.lit(-1))["start"].alias("start"),
                        F.greatest(F.try_element_at(a, F.lit(-1))["end"], s["end"]).alias("end"),
                        F.try_element_at(a, F.lit(-1))["kind"].alias("kind"),
                    )
                ),
            ),
        ).otherwise(F.array_append(a, s)),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span of ``spans`` (ordered) replaced by its kind in brackets."""
    return F.when(F.size(spans) > 0, once(merged(spans), lambda united: _replaced(text, united))).otherwise(text)


def _replaced(text: Column, united: Column) -> Column:
    parts = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(united, lambda s: s["end"])),
        F.concat(united, F.array(F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit("").alias("kind")))),
        lambda at, s: F.concat(F.substring(text, at + 1, s["start"] - at), F.when(s["kind"] == "", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))),
    )
    return F.array_join(parts, "")
