"""Personal data: generators propose, boosted trees select (DataFrame functions only).

Strict base patterns (e-mail, IPv4, payment card, phone) always count.  Beside
them, loose generators propose spans that the strict patterns miss: spelled-out or
bracketed "at" and "dot", other separators, telephone numbers without a plus.  A
boosted ensemble of small trees scores each proposal from its format and context; a
threshold per kind, calibrated on a fold that the trees have not seen, selects the
proposals that are reported beside the base spans.

The tables hold no labels, so the trees are taught by known changes of what is
certain.  Positives are base spans, in their own context, written in the ways
people disguise them (``disguised``).  Negatives are the same spans spoilt and then
disguised (``spoilt``: a wrong check digit, an octet over 255, too few digits, dates,
thousands, lists), and proposals of the corpus that are no personal data however they
are read (``sound``).  Proposals that may be personal data teach nothing, so however
many of them a corpus holds they are never learned as negatives.

All features are yes-or-no, so the training data is a contingency table counted by
Spark over all documents; its size is bounded by ``2 ** 12`` rows a kind and fold
whatever the corpus.  The trees become one CASE expression, so scoring stays inside
Spark.

Defined results
---------------
* null and empty texts have no spans; repeated rows each give a row.
* a proposal that overlaps a base span is not reported again; of overlapping
  proposals of one kind the generator's leftmost longest is the only one.
* a kind without base spans has nothing to learn from and adds nothing; neither does
  one for which no threshold reaches ``PRECISION`` over ``LEAST`` cases.
* only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of
from .spans import apart, blocks_of, matches, meets, of_kind, once, ordered

KINDS = ("email", "ip", "card", "phone")
PRECISION, ROUNDS, RATE, LEAST = 0.95, 32, 0.3, 20

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

AT = r"(?:\x20?[(\[{<]\x20?(?:at|@)\x20?[)\]}>]\x20?|\x20?@\x20?)"
DOT = r"(?:\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20|\x20?\.)"
STOP = r"(?:\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20|\x20?[.,]\x20?)"
#: Loose generators; each run can begin in one place only, so a scan is linear.
LOOSE = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": rf"(?i)(?<![0-9.,])[0-9]{{1,4}}+(?:{STOP}[0-9]{{1,4}}+){{3,5}}+",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:\x20?[\x20._/,-]\x20?[0-9]{3,7}+){1,4}+",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+|00)?+\x20?+(?:\([0-9]{1,4}+\)|[0-9]{1,4}+)(?:\x20?[\x20./-]?\x20?(?:\([0-9]{2,5}+\)|(?<![0-9])[0-9]{2,5}+)){2,5}+",
}
LOOSE_GUARD = {
    "email": r"(?i)@|[(\[{<]\x20?at\x20?[)\]}>]|\x20at\x20[a-z0-9-]++\x20dot\x20",
    "ip": r"(?i)[0-9](?:\x20?[.,]|\x20?[(\[{<]|\x20dot)\x20?",
    "card": r"[0-9]{3}\x20?[\x20._/,-]\x20?[0-9]{3}",
    "phone": r"[0-9]\)?\x20?[\x20./-]\x20?\(?[0-9]{2}",
}
CONTEXT = 24
CONTACT, MONEY, HOST = r"mail|phone|tel|call|contact|fax|reach|write|mobile|ring", r"card|visa|credit|debit|account|pay", r"\bip|host|server|addr|login|from"
FEATURES = {
    "email": ("at_bracket", "at_word", "dot_bracket", "dot_word", "letters_end", "known_end", "digits_only", "short_local", "cue_contact", "plain_end"),
    "ip": ("octets", "four", "spelled", "bracketed", "comma", "spaced", "zero", "cue_host", "listed", "plain_end"),
    "card": ("luhn", "size", "fours", "dotted", "underscored", "slashed", "comma", "dashed", "spaced", "issuer", "cue_money", "plain_end"),
    "phone": ("plus", "zeros", "parens", "dashed", "dotted", "slashed", "thousands", "fours", "dateish", "size", "long_end", "cue_contact"),
}


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the strict patterns, with their context."""
    octets = lambda s: F.forall(F.split(s["hit"], r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return {
        "email": matches(text, EMAIL, text.contains("@"), context=CONTEXT),
        "ip": F.filter(matches(text, IP, context=CONTEXT), octets),
        "card": F.filter(matches(text, CARD, text.rlike("[0-9](?:[\\x20-]?[0-9]){13}"), context=CONTEXT), lambda s: (F.length(digits(s["hit"])) <= 19) & luhn(digits(s["hit"]))),
        "phone": F.filter(matches(text, PHONE, text.contains("+"), context=CONTEXT), lambda s: F.length(digits(s["hit"])).between(10, 15)),
    }


def plain_form(kind: str, hit: Column) -> Column:
    """A proposal as it reads once spelled-out signs and blanks are undone."""
    if kind == "email":
        signs = F.regexp_replace(F.regexp_replace(hit, rf"(?i){AT}|\x20at\x20", "@"), rf"(?i){DOT}", ".")
        return F.lower(signs)
    if kind == "ip":
        return F.regexp_replace(hit, rf"(?i){STOP}", ".")
    return digits(hit)


def sound(kind: str, hit: Column) -> Column:
    """Whether a proposal can be personal data at all, however it is written."""

    def of(plain: Column) -> Column:
        if kind == "email":
            return plain.rlike(r"^[a-z0-9._%+-]++@[a-z0-9-]++(?:\.[a-z0-9-]++)++$") & plain.rlike(r"\.[a-z]{2,}$")
        if kind == "ip":
            return plain.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?!$)|$)){4}$")
        if kind == "card":
            return F.length(plain).between(13, 19) & luhn(plain)
        return F.length(plain).between(10, 15)

    return once(plain_form(kind, hit), of)


def features(kind: str, hit: Column, before: Column, after: Column) -> Column:
    """The yes-or-no features of a proposal as one bit string."""
    before = F.lower(before)
    has = lambda p: hit.rlike(p)
    number = digits(hit)
    bits = {
        "plain_end": ~after.rlike("[A-Za-z0-9]"),
        "cue_contact": before.rlike(CONTACT),
        "cue_money": before.rlike(MONEY),
        "cue_host": before.rlike(HOST),
        "spaced": has(r"\x20"),
        "dotted": has(r"\."),
        "dashed": has("-"),
        "slashed": has("/"),
        "underscored": has("_"),
        "comma": has(","),
        "bracketed": has(r"[(\[{<]"),
    }
    if kind == "email":
        bits |= {
            "at_bracket": has(r"(?i)[(\[{<]\x20?(?:at|@)"), "at_word": has(r"(?i)\x20at\x20"), "dot_bracket": has(r"(?i)[(\[{<]\x20?(?:dot|\.)"), "dot_word": has(r"(?i)\x20dot\x20"),
            "letters_end": has("[A-Za-z]{2,}$"), "known_end": has("(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|example|invalid|test)$"),
            "digits_only": has(r"^[0-9.,]+[^0-9.,a-zA-Z]"), "short_local": has("^.{1,2}[^A-Za-z0-9._%+-]"),
        }
    elif kind == "ip":
        bits |= {
            "octets": sound("ip", hit), "four": F.regexp_count(hit, F.lit("[0-9]+")) == 4, "spelled": has("(?i)dot"), "zero": has(r"(?:^|[^0-9])0[0-9]"), "listed": before.rlike(r"[0-9]\x20?[,.;]?\x20?$"),
        }
    elif kind == "card":
        bits |= {
            "luhn": luhn(number), "size": F.length(number).between(14, 19), "fours": has("^(?:[0-9]{4}[^0-9]+)+[0-9]{1,4}$"), "issuer": has("^(?:3[0-9]|4|5[0-9]|6|2[2-7])"),
        }
    else:
        bits |= {
            "plus": has(r"^\+"), "zeros": has("^00"), "parens": has(r"\("), "dotted": has(r"\."), "thousands": has("^[0-9]{1,3}(?:[^0-9]+[0-9]{3})+$"), "fours": has("^[0-9]{4}(?:[^0-9]+[0-9]{4})+$"),
            "dateish": has("^(?:19|20)[0-9]{2}[^0-9][01]?[0-9][^0-9][0-3]?[0-9]") | has("^[0-3]?[0-9][^0-9][01]?[0-9][^0-9](?:19|20)[0-9]{2}"), "size": F.length(number).between(10, 15), "long_end": has("[0-9]{4}$"),
        }
    return F.concat(*[F.when(F.coalesce(bits[f], F.lit(False)), "1").otherwise("0") for f in FEATURES[kind]])


def disguised(kind: str, hit: Column) -> list[Column]:
    """A base span as people write it to hide it, or in another usual form."""
    if kind == "email":
        forms = [(" at ", " dot "), ("(at)", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " dot "), (" @ ", "."), ("{at}", "{dot}"), (" AT ", " DOT ")]
        host, local = F.regexp_extract(hit, "@(.*)$", 1), F.regexp_extract(hit, "^([^@]*)@", 1)
        return [F.concat(local, F.lit(a), F.replace(host, F.lit("."), F.lit(d))) for a, d in forms]
    if kind == "ip":
        return [F.replace(hit, F.lit("."), F.lit(d)) for d in ("[.]", "(dot)", " dot ", "[dot]", " [.] ", " (dot) ")]
    if kind == "card":
        return [F.regexp_replace(digits(hit), "([0-9]{4})(?=[0-9])", f"$1{d}") for d in (".", "_", "/", "  ", " - ", " . ")]
    national = F.regexp_replace(hit, r"^\+[0-9]{1,3}[\x20.-]*", "")
    return [
        F.regexp_replace(hit, r"^\+", ""),
        F.regexp_replace(hit, r"^\+", "00"),
        national,
        *[F.regexp_replace(F.regexp_replace(national, "[^0-9]+", d), f"^[{d}]+", "") for d in (".", "-", "/")],
    ]


def spoilt(kind: str, hit: Column) -> list[Column]:
    """What looks like a disguised base span and is none."""
    if kind == "email":
        numbers = F.concat(F.lit(" @ "), F.length(hit).cast("string"), F.lit("."), F.octet_length(hit).cast("string"))
        return [F.concat(F.regexp_extract(hit, "^([^@]*)@", 1), numbers), F.concat(F.length(hit).cast("string"), numbers), *[F.regexp_replace(v, "[A-Za-z-]+$", "7") for v in disguised(kind, hit)[:4]]]
    if kind == "ip":
        beyond = F.concat(F.lit("3"), F.lpad(F.regexp_extract(hit, r"^([0-9]+)\.", 1), 2, "0"), F.regexp_extract(hit, r"^[0-9]+(.*)$", 1))
        return [F.replace(hit, F.lit("."), F.lit(d)) for d in (", ", ",")] + [F.concat(hit, F.lit(" dot 1"))] + disguised(kind, beyond)[:3]
    if kind == "card":
        number = digits(hit)
        wrong = F.concat(F.left(number, F.length(number) - 1), ((F.right(number, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        return disguised(kind, wrong) + [F.regexp_replace(number, "([0-9]{3})(?=[0-9])", "$1,"), F.regexp_replace(wrong, "([0-9]{5})(?=[0-9])", "$1 ")]
    number = F.rpad(digits(hit), 12, "5")
    part = lambda i, n: F.substring(number, F.lit(i), F.lit(n))
    return [
        F.concat(F.lit("20"), part(1, 2), F.lit("-0"), part(3, 1), F.lit("-1"), part(4, 1), F.lit(" 1"), part(5, 1)),
        F.concat(F.lit("1"), part(1, 1), F.lit("/0"), part(3, 1), F.lit("/20"), part(4, 2), F.lit(" 1"), part(6, 1)),
        *[F.concat_ws(d, part(1, 3), part(4, 3), part(7, 3), part(10, 3)) for d in (" ", ".", "-", "/")],
        *[F.concat_ws(d, part(1, 4), part(5, 4), part(9, 4)) for d in (" ", "-", "/")],
        F.concat_ws(" ", part(1, 2), part(3, 2), part(5, 2)),
        F.concat_ws("-", part(1, 3), part(4, 2), part(6, 4)),
    ]


def proposals(text: Column, kind: str) -> Column:
    """Loose spans of a kind, each with its features as one bit string and the matched text."""
    found = matches(text, LOOSE[kind], text.rlike(LOOSE_GUARD[kind]), context=CONTEXT)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), features(kind, s["hit"], s["before"], s["after"]).alias("bits"), s["hit"].alias("hit")))


def contingency(docs: DataFrame) -> dict[str, list[tuple[str, int, int, int]]]:
    """Per kind: (bits, in the calibration fold or not, cases, positives among them)."""
    text = F.col("text")
    strict = base_spans(text)
    case = "array<struct<kind:string,bits:string,positive:boolean>>"

    def taught(kind: str) -> Column:
        form = lambda s, v, positive: F.struct(v.alias("hit"), s["before"].alias("before"), s["after"].alias("after"), F.lit(positive).alias("positive"))
        forms = lambda s: F.array(*[form(s, v, True) for v in disguised(kind, s["hit"])], *[form(s, v, False) for v in spoilt(kind, s["hit"])])
        return F.transform(
            F.flatten(F.transform(F.col(f"strict_{kind}"), forms)),
            lambda c: F.struct(F.lit(kind).alias("kind"), features(kind, c["hit"], c["before"], c["after"]).alias("bits"), c["positive"].alias("positive")),
        ).cast(case)

    def unsound(kind: str) -> Column:
        free = once(blocks_of(F.col(f"strict_{kind}")), lambda blocks: F.filter(proposals(text, kind), lambda s: ~sound(kind, s["hit"]) & ~meets(s, blocks)))
        return F.transform(free, lambda s: F.struct(F.lit(kind).alias("kind"), s["bits"].alias("bits"), F.lit(False).alias("positive"))).cast(case)

    rows = (
        docs.select("doc_id", "text", *[strict[k].alias(f"strict_{k}") for k in KINDS])
        .select((F.coalesce(fold_of(F.col("doc_id")), F.lit(1)) == 0).cast("int").alias("calibration"), F.explode(F.concat(*map(taught, KINDS), *map(unsound, KINDS))).alias("p"))
        .groupBy("p.kind", "p.bits", "calibration")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("p.positive").alias("positive"))
        .collect()
    )
    return {k: sorted((r.bits, r.calibration, r.n, r.positive) for r in rows if r.kind == k) for k in KINDS}


def boosted(rows: list[tuple[str, int, int]], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[tuple[int, int, list[float]]]]:
    """Logistic boosting of two-level trees over (bits, n, positives): (first score, [(feature, feature, leaf scores)]).

    Both classes weigh the same in all.
    """
    bits = np.array([[int(c) for c in b] for b, _, _ in rows])
    n, positive = (np.array(x, float) for x in ([r[1] for r in rows], [r[2] for r in rows]))
    weight = max(1.0, (n - positive).sum()) / max(1.0, positive.sum())
    n, positive = n - positive + weight * positive, weight * positive
    n, positive = n / n.sum() * len(rows), positive / n.sum() * len(rows)
    first = float(np.log((positive.sum() + 0.5) / (n.sum() - positive.sum() + 0.5)))
    scores = np.full(len(rows), first)
    trees = []
    used = [f for f in range(bits.shape[1]) if len(set(bits[:, f])) > 1]
    for _ in range(rounds if used else 0):
        p = 1 / (1 + np.exp(-scores))
        slopes, bends = positive - n * p, n * p * (1 - p)
        best = None
        for i, f in enumerate(used):
            for g in used[i:]:
                leaf = 2 * bits[:, f] + bits[:, g]
                d, h = np.bincount(leaf, slopes, 4), np.bincount(leaf, bends, 4) + 0.1
                gain = float((d * d / h).sum())
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, g, np.clip(rate * d / h, -1.5, 1.5).tolist())
        trees.append(best[1:])
        _, f, g, leaves = best
        scores = scores + np.array(leaves)[2 * bits[:, f] + bits[:, g]]
    merged: dict[tuple[int, int], list[float]] = {}
    for f, g, leaves in trees:  # trees over one pair of features add up to one
        merged[f, g] = [a + b for a, b in zip(merged.get((f, g), [0.0] * 4), leaves, strict=True)]
    return first, [(f, g, leaves) for (f, g), leaves in merged.items()]


def score_of(bits: str, model) -> float:
    first, trees = model
    return first + sum(leaves[2 * int(bits[f]) + int(bits[g])] for f, g, leaves in trees)


def fitted(table: dict[str, list[tuple[str, int, int, int]]], precision: float = PRECISION) -> dict[str, tuple[tuple, float]]:
    """Per kind its trees and the lowest score down to which the calibration fold keeps the precision at every level."""
    out = {}
    for kind, rows in table.items():
        learned = [(b, n, p) for b, fold, n, p in rows if not fold]
        if not any(p for _, _, p in learned):
            continue
        model = boosted(learned)
        # Levels of equal score from the highest down, as long as each holds the precision for itself.
        levels: dict[float, list[int]] = {}
        for b, fold, n, p in rows:
            if fold:
                level = levels.setdefault(round(score_of(b, model), 9), [0, 0])
                level[0] += n
                level[1] += p
        cases, least = 0, None
        for s, (n, p) in sorted(levels.items(), reverse=True):
            if p < precision * n or s <= 0:
                break
            cases += n
            if cases >= LEAST:
                least = s
        if least is not None:
            out[kind] = (model, least - 1e-9)
    return out


def tree_score(bits: Column, model) -> Column:
    """The ensemble as one expression over the bit string."""
    first, trees = model
    bit = lambda f: F.substring(bits, f + 1, 1) == "1"
    score = F.lit(first)
    for f, g, leaves in trees:
        score = score + F.when(bit(f), F.when(bit(g), leaves[3]).otherwise(leaves[2])).otherwise(F.when(bit(g), leaves[1]).otherwise(leaves[0]))
    return score


def learn(docs: DataFrame) -> dict[str, tuple[tuple, float]]:
    return fitted(contingency(docs))


def scan(docs: DataFrame, models: dict | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: ordered (start, rank, end, kind) of each text.

    ``models`` are those of :func:`learn`, by default learned from ``docs`` itself.
    All columns of ``docs`` stay (one named ``base`` or ``spans`` is replaced).
    """
    if models is None:
        models = learn(docs)
    text = F.col("text")
    strict = base_spans(text)
    found = docs.withColumn("base", ordered(*[of_kind(strict[k], k, i) for i, k in enumerate(KINDS)]))

    def selected(kind: str) -> Column:
        trees, least = models[kind]
        return apart(F.filter(proposals(text, kind), lambda s: tree_score(s["bits"], trees) >= least), F.col("base"))

    more = [of_kind(selected(k), k, i) for i, k in enumerate(KINDS) if k in models]
    return found.withColumn("spans", ordered("base", *more))
