"""Candidate generation: strategies that turn documents into candidate values.

Every strategy returns the columns of ``COLUMNS``.  ``gen_order`` carries the
order in which candidates arise (priority, strategy, pattern, match); it decides
ties later on.  New strategies register a function of the same shape.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import matches, once
from ..functions.values import stripped
from .templates import java_pattern, valid_pattern

COLUMNS = ("doc_id", "field_id", "value", "strategy", "priority", "match_pattern", "raw_match", "start", "end", "page", "preset", "gen_order", "window", "text_length")
#: What candidates from the page have besides; null for those from text.
BOXES = ("bbox", "label_bbox", "label_distance")
#: Characters of text before and after the start of a match that travel with a candidate, so that scoring needs no text.
BEFORE, AFTER = 80, 60


@dataclass(frozen=True)
class Strategy:
    """One strategy of one field, from a template."""

    field_id: str
    name: str = "global_regex"
    patterns: tuple[str, ...] = ()
    priority: int = 50
    idx: int = 0
    config: dict = field(default_factory=dict, hash=False)


_STRATEGIES: dict[str, Callable[[Column, Strategy], Column]] = {}


def strategy(name: str):
    """Register a function (text, strategy) -> array of candidate structs under a name."""

    def add(f):
        _STRATEGIES[name] = f
        return f

    return add


#: What a table strategy returns for each candidate of a text; places and page may be null.
TABLE_SCHEMA = "value string, raw_match string, start int, end int, page int, preset double"
_TABLES: dict[str, Callable[[Strategy], type]] = {}


def table_strategy(name: str):
    """Register a Python table function as a strategy: a function from a :class:`Strategy` to a handler class whose
    ``eval(text)`` yields rows of ``TABLE_SCHEMA`` in order (for what column functions cannot express)."""

    def add(f):
        _TABLES[name] = f
        return f

    return add


def _from_table(docs: DataFrame, s: Strategy, text: str) -> DataFrame:
    """Candidates of a table strategy, joined laterally: each document meets its own rows, nothing is shuffled."""
    handler = _TABLES[s.name](s)

    class Numbered(handler):
        def eval(self, text):
            if text is not None:
                for n, row in enumerate(super().eval(text)):
                    yield (*row, n)

    rows = F.udtf(Numbered, returnType=f"{TABLE_SCHEMA}, match int")
    found = docs.select("doc_id", F.col(text).alias("text")).lateralJoin(rows(F.col("text").outer()))
    begin = F.greatest(F.col("start") - BEFORE, F.lit(0))
    own = found.where(F.coalesce("value", F.lit("")) != "").withColumns({
        "field_id": F.lit(s.field_id), "strategy": F.lit(s.name), "priority": F.lit(s.priority), "match_pattern": F.lit(None).cast("string"),
        "gen_order": F.struct(F.lit(s.priority).alias("priority"), F.lit(s.idx).alias("strategy"), F.lit(0).alias("pattern"), F.col("match")),
        "window": F.substring(F.col("text"), begin + 1, F.col("start") + AFTER - begin), "text_length": F.length("text"),
    })
    return own.select(*COLUMNS)


def with_boxes(candidates: DataFrame) -> DataFrame:
    """Candidates from text with empty ``BOXES``, to stand in one table with those from the page."""
    kinds = {"bbox": "struct<l:double,t:double,r:double,b:double>", "label_bbox": "struct<l:double,t:double,r:double,b:double>", "label_distance": "double"}
    return candidates.withColumns({c: F.lit(None).cast(kinds[c]) for c in BOXES if c not in candidates.columns})


def _candidate(text: Column, s: Strategy, value: Column, raw: Column, start: Column, end: Column, pattern: str | None, page: Column, pattern_idx: int, match_idx: Column, preset: Column | None = None) -> Column:
    begin = F.greatest(start - BEFORE, F.lit(0))
    return F.struct(
        F.lit(s.field_id).alias("field_id"), value.alias("value"), F.lit(s.name).alias("strategy"), F.lit(s.priority).alias("priority"),
        F.lit(pattern).cast("string").alias("match_pattern"), raw.alias("raw_match"), start.cast("int").alias("start"), end.cast("int").alias("end"), page.cast("int").alias("page"),
        (F.lit(None) if preset is None else preset).cast("double").alias("preset"),
        F.struct(F.lit(s.priority).alias("priority"), F.lit(s.idx).alias("strategy"), F.lit(pattern_idx).alias("pattern"), match_idx.cast("int").alias("match")).alias("gen_order"),
        F.substring(text, begin + 1, start + AFTER - begin).alias("window"), F.length(text).alias("text_length"),
    )


NO_CANDIDATES = (
    "array<struct<field_id:string,value:string,strategy:string,priority:int,match_pattern:string,raw_match:string,start:int,end:int,page:int,preset:double,"
    "gen_order:struct<priority:int,strategy:int,pattern:int,match:int>,window:string,text_length:int>>"
)


def inline_flags(names) -> str:
    """Flags of a strategy as an inline group."""
    letters = "".join({"IGNORECASE": "iu", "MULTILINE": "m", "DOTALL": "s"}.get(n, "") for n in names)
    return f"(?{letters})" if letters else ""


@strategy("global_regex")
def global_regex(text: Column, s: Strategy) -> Column:
    """Every match of every pattern in the text; config: flags (IGNORECASE, MULTILINE, DOTALL).  Patterns that do not compile are skipped."""
    found = []
    for i, p in enumerate(s.patterns):
        if not valid_pattern(p):
            continue
        java, group = java_pattern(p)
        java = inline_flags(s.config.get("flags", ())) + java
        hits = matches(text, java, group=group)
        found.append(_regex_hits(text, s, i, p, hits))
    return F.concat(*found) if found else F.array().cast(NO_CANDIDATES)


def _regex_hits(text: Column, s: Strategy, i: int, pattern: str, hits: Column) -> Column:
    none = F.lit(None)
    out = F.transform(hits, lambda h, n: _candidate(text, s, stripped(h["value"]), h["hit"], h["start"], h["end"], pattern, none, i, n))
    return F.filter(out, lambda c: c["value"] != "")


#: Fixed value: characters of a window that are kept as the raw match.
NEARBY_RAW = 120


@strategy("nearby_text")
def nearby_text(text: Column, s: Strategy) -> Column:
    """A value in the window after each match of an anchor: by a pattern, or the first line that is not blank.

    config: radius (characters), after_newline (the window begins on the next line), value_pattern.  The candidate's
    span runs from the anchor to the end of the window, and its raw match is the head of the window.
    """
    radius, value_pattern = s.config.get("radius", 200), s.config.get("value_pattern")
    found = []
    for i, p in enumerate(s.patterns):
        java, _ = java_pattern(p)
        found.append(_nearby_hits(text, s, i, p, matches(text, java), radius, value_pattern))
    return F.concat(*found)


def _nearby_hits(text: Column, s: Strategy, i: int, pattern: str, hits: Column, radius: int, value_pattern: str | None) -> Column:
    def one(h: Column, n: Column) -> Column:
        begin = h["end"]
        if s.config.get("after_newline"):
            newline = F.call_function("locate", F.lit("\n"), text, h["end"] + 1)
            begin = F.when(newline > 0, newline).otherwise(h["end"])
        window = F.substring(text, begin + 1, F.lit(radius))
        if value_pattern:
            java, group = java_pattern(value_pattern)
            value = F.regexp_extract(window, java, group)
        else:
            value = F.regexp_extract(window, r"(?:^|\n)[ \t]*(\S[^\n]*)", 1)
        reach = F.least(F.length(text), begin + radius)
        return _candidate(text, s, stripped(value), F.left(window, F.lit(NEARBY_RAW)), h["start"], reach, pattern, F.lit(None), i, n)

    return F.filter(F.transform(hits, one), lambda c: c["value"] != "")


# How far a group of checkboxes reaches from its anchor, the marks that check a box, and the confidence of
# each kind of evidence.
GRID_REACH = 800
MARK = r"(?:\[[Xx✓✗●■✔]\]|[☑☒✅]|[✓✔](?!\w)|■(?!\w)|●(?!\w)|▪(?!\w)|\([Xx]\))"
BESIDE, WORDED = 0.85, 0.70
# End of the fixed values.


@strategy("checkbox_grid")
def checkbox_grid(text: Column, s: Strategy) -> Column:
    """One candidate per checked option in the reach of the anchor, or in the whole text where the anchor does not occur.

    config: anchor, options {label: value}.  Four tests in order: a mark before the option, a mark after it, "Yes",
    "Selected" or "Checked" after it, a lone X before it; of equal values the first highest preset stays.
    """
    anchor = s.config.get("anchor")
    at = F.call_function("instr", F.upper(text), F.lit(anchor.upper())) if anchor else F.lit(0)
    window = once(at, lambda at: F.when(at > 0, F.substring(text, at, F.lit(GRID_REACH))).otherwise(text))
    checked = once(window, lambda w: F.filter(F.array(*_options(text, w, s)), lambda c: c.isNotNull()))
    better = lambda c, o: (o["value"] == c["value"]) & ((o["preset"] > c["preset"]) | ((o["preset"] == c["preset"]) & (o["gen_order"]["match"] < c["gen_order"]["match"])))
    return once(checked, lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda o: better(c, o))))


def _options(text: Column, window: Column, s: Strategy) -> list[Column]:
    """A candidate for each option that is checked in the window, else null; each test looks once, and only where the option occurs."""
    found = []
    for n, (label, value) in enumerate(s.config.get("options", {}).items()):
        q = "".join("\\" + c if not c.isalnum() and c != " " else c for c in label)
        tests = [(rf"(?iu){MARK}\s{{0,3}}{q}", BESIDE), (rf"(?iu){q}\s{{0,3}}{MARK}", BESIDE), (rf"(?iu){q}\s*[:\-]?\s*(?:Yes|Selected|Checked)\b", WORDED), (rf"(?iu)\bX\b\s{{1,4}}{q}", WORDED)]
        # No test matches an empty text.
        hits = [once(F.regexp_extract(window, pattern, 0), _evidence(confidence)) for pattern, confidence in tests]
        found.append(F.when(window.rlike(rf"(?iu){q}"), once(F.coalesce(*hits), _checked(text, s, value, n))))
    return found


def _evidence(confidence: float) -> Callable[[Column], Column]:
    return lambda raw: F.when(raw != "", F.struct(F.left(raw, F.lit(80)).alias("raw"), F.lit(confidence).cast("double").alias("preset")))


def _checked(text: Column, s: Strategy, value: str, n: int) -> Callable[[Column], Column]:
    none = F.lit(None).cast("int")
    return lambda hit: F.when(hit.isNotNull(), _candidate(text, s, F.lit(value), hit["raw"], none, none, None, F.lit(1), 0, F.lit(n), hit["preset"]))


def generate(docs: DataFrame, strategies: list[Strategy], text: str = "text") -> DataFrame:
    """Candidates of all strategies over (doc_id, text), one pass over the documents.

    Fields are the driver's small template; each becomes literal expressions, which
    Spark evaluates without a join.  Table strategies (:func:`table_strategy`) are
    lateral joins of their own beside it.
    """
    unknown = [s.name for s in strategies if s.name not in _STRATEGIES and s.name not in _TABLES]
    if unknown:
        raise ValueError(f"no such strategy: {unknown[0]}")
    ordered = sorted(strategies, key=lambda s: s.priority)
    each = [_STRATEGIES[s.name](F.col(text), s) for s in ordered if s.name in _STRATEGIES]
    parts = [docs.select("doc_id", F.explode(F.concat(*each)).alias("c")).select("doc_id", "c.*").select(*COLUMNS)] if each else []
    parts += [_from_table(docs, s, text) for s in ordered if s.name in _TABLES]
    return reduce(DataFrame.unionByName, parts)


def reserve_language(text: Column) -> tuple[Column, Column]:
    """(whether the text speaks of a reserve, the first sentence that does, with its mark)."""
    sentence = stripped(F.regexp_extract(text, r"(?i)[^.!?\n]*\breserve\b[^.!?\n]*[.!?]?", 0))
    return F.coalesce(text.rlike(r"(?i)\breserve\b"), F.lit(False)), F.when(text.rlike(r"(?i)\breserve\b"), F.nullif(sentence, F.lit("")))
