"""Form classification by ordered fingerprints."""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain
from re import _constants, _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import once
from .templates import checked

#: How much of a text is looked at, and what an unknown form is called and trusted.
LOOKED_AT, GENERIC, SURE, UNSURE = 8000, "generic_mmucc", 0.95, 0.40


# The ids of the forms that have an overlay template of their own; an id begins with its state.
FORM_IDS = (
    "ca_chp555", "tx_cr3", "ny_mv104a", "fl_hsmv", "pa_aa600", "oh_bmv2696", "il_sr1", "ga_sr13", "nc_dmv349", "nj_mv104", "mi_ud10", "va_fr300", "wa_422",
    "az_40_8282", "co_dr2447", "tn_cs0835", "in_sr13", "mo_1130", "wi_mv4002", "md_acrs", "mn_bca403", "sc_sr309", "al_acrs", "or_735", "ky_le35a", "ok_sr22",
    "ct_pr1", "la_dotd390", "ut_sr24", "ms_cr2", "ar_crash", "ia_432015", "ks_trl1", "ak_crash", "hi_hpd252", "id_itd3101", "me_crash", "ma_cra43", "mt_crash",
    "ne_310c", "nh_dsmv311", "nm_10516", "nd_sfn2086", "ri_uc1", "sd_crash", "vt_tsp300", "wv_crash", "wy_crash", "de_tc308", "dc_mpd", "nv_nhp1",
)
#: The one overlay that is not named after its form.
OTHER_NAMES = {"fl_hsmv": "fl_hsmv90010"}
# End of the fixed values.


def state_of_form(form_id: Column) -> Column:
    """The state of a form; null for generic and unknown forms."""
    return F.when(form_id.isin(*FORM_IDS), F.upper(F.left(form_id, F.lit(2))))


def overlay_of_form(form_id: Column) -> Column:
    """The overlay template of a form; null for forms that are read by the base template alone."""
    name = form_id
    for form, other in OTHER_NAMES.items():
        name = F.when(form_id == form, F.lit(other)).otherwise(name)
    return F.when(form_id.isin(*FORM_IDS), F.concat(name, F.lit(".json")))


def read_fingerprints(spark: SparkSession, path: str) -> list[tuple[str, tuple[str, ...]]]:
    """Ordered fingerprints from a JSON-lines file of (form_id, patterns, position); a list that people keep, checked for its size."""
    rows = checked(spark.read.schema("form_id string, patterns array<string>, position int").json(path)).collect()
    return [(r.form_id, tuple(r.patterns)) for r in sorted(rows, key=lambda r: r.position)]


def required_options(pattern: str, blanks: bool = False) -> list[frozenset[str]]:
    """All sets of texts in small letters of which every match of a pattern holds at least one of each set.

    Of what must be matched inside a group the longest text is taken, of alternatives one text each.  With ``blanks`` they are
    texts of a text with one blank for any white space, so they run on over the white space that a pattern asks for.
    """
    try:
        parsed = _parser.parse(pattern, re.IGNORECASE)
    except re.error:
        return []

    def is_blank(op, value) -> bool:
        """White space, once or more often."""
        if op is _constants.MAX_REPEAT and value[0] > 0 and len(value[2]) == 1:
            return is_blank(*value[2][0])
        return (op is _constants.LITERAL and chr(value) in " \t\n\x0b\f\r") or (op is _constants.IN and list(value) == [(_constants.CATEGORY, _constants.CATEGORY_SPACE)])

    def of(items) -> list[frozenset[str]]:
        options: list[frozenset[str]] = []
        run = ""
        for op, value in [*items, (None, None)]:
            if blanks and is_blank(op, value):
                run = run.rstrip(" ") + " "
                continue
            if op is _constants.LITERAL and chr(value).isascii():
                run += chr(value).lower()
                continue
            if run:
                options.append(frozenset([run]))
                run = ""
            found = None
            if op is _constants.SUBPATTERN:
                found = _best(of(value[-1]))
            elif op is _constants.MAX_REPEAT and value[0] > 0:
                found = _best(of(value[2]))
            elif op is _constants.BRANCH:
                each = [_best(of(b)) for b in value[1]]
                found = frozenset().union(*each) if all(each) else None
            if found:
                options.append(found)
        return options

    return of(parsed)


def _best(options: list[frozenset[str]]) -> frozenset[str] | None:
    """The most telling of several requirements: the one whose shortest text is longest."""
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def required_literals(pattern: str, blanks: bool = False) -> frozenset[str] | None:
    """The most telling of the :func:`required_options` of a pattern; null if none can be told."""
    found = _best(required_options(pattern, blanks))
    return found if found and min(map(len, found)) > 1 else None


def required_of(patterns: list[str]) -> dict[str, frozenset[str] | None]:
    """What each pattern of a library requires, with one blank for any white space: of its options of four characters or more the one that fewest patterns share."""
    options = {p: [o for o in required_options(p, blanks=True) if min(map(len, o)) > 1] for p in patterns}
    shared = Counter(o for own in options.values() for o in set(own))
    return {p: max(own, key=lambda o: (min(4, *map(len, o)), -shared[o], min(map(len, o))), default=None) for p, own in options.items()}


def one_of(words: list[str]) -> str:
    """A pattern of a tree of letters: the longest of ``words`` that begins at a place."""
    def tree(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            if w:
                heads.setdefault(w[0], []).append(w[1:])
        branches = "|".join(("\\" + c if not c.isalnum() and c not in " _" else c) + tree(tails) for c, tails in sorted(heads.items()))
        return "" if not heads else f"(?:{branches})?" if "" in rest else f"(?:{branches})"

    return tree(sorted(set(words)))


def literals_in(head: Column, words: list[str]) -> Column:
    """The longest of ``words`` (small letters, one blank for white space) at each place of a text, each once: one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(head), r"\s+", " "), F.lit(f"(?=({one_of(words)}))"), F.lit(1)))


def form_of(text: Column, fingerprints: list[tuple[str, tuple[str, ...]]], prefilter: bool = True) -> Column:
    """The first form one of whose patterns occurs in the head of the text, regardless of case; null if none does.

    ``prefilter``: the texts that patterns require are looked for in one pass, and a pattern is tried only where one of
    its own was found; without it each pattern is tried in turn.  Both give the same.
    """
    head = F.substring(text, 1, LOOKED_AT)
    needs = required_of([p for _, patterns in fingerprints for p in patterns]) if prefilter else {}
    words = sorted({w for own in needs.values() if own for w in own})

    def chain_of(found: Column | None) -> Column:
        # A text is there if one that it begins was found at the same place.
        any_of = lambda own: F.arrays_overlap(found, F.array(*[F.lit(w) for w in words if any(w.startswith(o) for o in own)]))
        out = None
        for form, patterns in fingerprints:
            own = [needs.get(p) for p in patterns]
            hit = F.lit(False)
            for p, o in zip(patterns, own, strict=True):
                tried = head.rlike(f"(?i){p}")
                hit = hit | (tried if not o or found is None else any_of(o) & tried)
            if found is not None and own and all(own):  # one test leaves out a form none of whose texts was found
                hit = any_of(frozenset().union(*own)) & hit
            out = (F if out is None else out).when(hit, form)
        if out is None:
            return F.lit(None).cast("string")
        return F.when(F.size(found) > 0, out) if found is not None and all(needs.values()) else out

    return once(literals_in(head, words), chain_of) if words else chain_of(None)


def patterns_left(text: Column, fingerprints: list[tuple[str, tuple[str, ...]]]) -> Column:
    """How many patterns the pass for required texts leaves to be tried on a text at most."""
    patterns = [p for _, own in fingerprints for p in own]
    needs = [required_of(patterns)[p] for p in patterns]
    words = sorted({w for own in needs if own for w in own})
    overlap = lambda found, own: F.arrays_overlap(found, F.array(*[F.lit(w) for w in words if any(w.startswith(o) for o in own)])).cast("int")
    return once(literals_in(F.substring(text, 1, LOOKED_AT), words), lambda found: sum((overlap(found, own) if own else F.lit(1) for own in needs), F.lit(0)))


def classify(docs: DataFrame, fingerprints: list[tuple[str, tuple[str, ...]]], states: dict[str, str]) -> DataFrame:
    """(doc_id, form_id, form_confidence, state): a short-circuiting chain, no join."""
    state = F.create_map(*[F.lit(x) for x in chain.from_iterable(states.items())]) if states else F.create_map().cast("map<string,string>")
    found = docs.select("doc_id", form_of(F.col("text"), fingerprints).alias("found"))
    return found.select(
        "doc_id", F.coalesce("found", F.lit(GENERIC)).alias("form_id"), F.when(F.col("found").isNotNull(), SURE).otherwise(UNSURE).alias("form_confidence"), F.try_element_at(state, F.col("found")).alias("state")
    )


def accuracy(classified: DataFrame, expected: DataFrame, by: str = "state") -> DataFrame:
    """Per state (or another column of either table, such as a tier): documents, correct ones, their share.  ``expected`` has (doc_id, expected)."""
    ok = F.col("form_id") == F.col("expected")
    return (
        classified.join(expected, "doc_id")
        .groupBy(F.coalesce(by, F.lit("none")).alias(by))
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if(ok).alias("correct"), F.round(F.avg(ok.cast("int")), 4).alias("accuracy"))
    )
