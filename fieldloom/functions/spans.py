"""Places of pattern matches, with DataFrame functions only.  Offsets count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def matches(text: Column, pattern: str, guard: Column | None = None, group: int = 0, context: int = 0) -> Column:
    """array<struct<start, end, hit, value>> of the leftmost non-overlapping matches, in order.

    ``value`` is the text of ``group``.  ``guard``: a cheap necessary condition; texts that fail it are not searched.
    ``context``: that many characters ``before`` a match, back to the match before it at most, and the one ``after`` it
    come with it.
    The text is searched once for hits, and cut at them only if there are any.  The gaps that ``split`` leaves and the
    hits alternate, so a running sum of their lengths gives the places.  Sums run over blocks of hits, which keeps the
    work near linear for texts with very many of them.
    """
    extract = lambda n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    fields = ["hit", "value"] + (["before", "after"] if context else [])
    none = F.array().cast(f"array<struct<start:int,end:int,{','.join(f'{f}:string' for f in fields)}>>")

    def one(x: Column) -> Column:
        more = [F.right(x["gap"], F.lit(context)).alias("before"), F.left(x["next"], F.lit(1)).alias("after")] if context else []
        return F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"), x["hit"].alias("hit"), (x["value"] if group else x["hit"]).alias("value"), *more)

    def zipped(hits: Column, gaps: Column) -> Column:
        n = F.size(hits)
        parts = [F.slice(gaps, 1, n).alias("gap"), hits.alias("hit")]
        if group:
            parts.append(extract(group).alias("value"))
        if context:
            parts.append(F.slice(gaps, 2, n).alias("next"))
        return F.transform(F.arrays_zip(*parts), one)

    in_blocks = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, BLOCK))
    placed = lambda hits: once(once(F.split(text, pattern, -1), lambda gaps: zipped(hits, gaps)), lambda z: once(in_blocks(z), lambda blocks: located(blocks, fields)))
    found = once(extract(0), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))
    return found if guard is None else F.when(guard, found).otherwise(none)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` refers to it."""
    return F.transform(F.array(value), then)[0]


def located(blocks: Column, fields: list[str]) -> Column:
    """Spans of blocks of (gap, len, and ``fields``), each block placed after those before it."""
    total = lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["len"])
    first = F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.array_append(a, F.element_at(a, -1) + total(b)))
    placed = F.zip_with(
        blocks,
        F.slice(first, 1, F.size(blocks)),
        lambda b, at: F.transform(
            b,
            lambda x, i: F.struct(
                (at + total(F.slice(b, 1, i)) + x["gap"]).alias("start"),
                (at + total(F.slice(b, 1, i)) + x["gap"] + x["len"]).alias("end"),
                *[x[f].alias(f) for f in fields],
            ),
        ),
    )
    return F.flatten(placed)
