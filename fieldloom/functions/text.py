"""Text normalisation: column expressions over whole texts and windows over their lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import once

# The shapes that tell labels, values and delimiters apart.
KNOWN_LABEL = (
    r"(?i)^(?:name(?:\s*\([^)]*\))?|date\s+of\s+birth|dob|address|addr|phone|tel(?:ephone)?|cell|year|make|manufacturer|model|color|"
    r"vin(?:\s+number)?|vehicle\s+identification(?:\s+number)?|plate|license\s+plate|tag|statute\s*/\s*charge|"
    r"offense(?:\s*/\s*classification)?|crime\s+type|reporting\s+officer|badge(?:\s+number)?|case\s+status|owner(?:\s+name|\s+address)?|"
    r"insurance(?:\s+company)?|carrier|policy(?:\s+number)?|tow(?:ed|ing)?(?:\s+company)?|dl(?:\s+[#]|\s+number)?|driver.?s?\s+licens\w*|"
    r"transported\s+to|hospital|taken\s+to|citation|charge|infraction|injur(?:y|ies)|condition|witness(?:\s+statement)?|statement)$"
)
DELIMITER = r"(?i)^(?:DRIVER|OPERATOR|PASSENGER|VEHICLE|PARTY|WITNESS|VICTIM|SUSPECT|OFFENDER|V\d+\s*:|W\d+\s*:)"
VALUE = r"[a-z]|^\d|^[A-Z]{1,4}[-\d]"
NARRATIVE = r"(?im)^(?:SECTION[ \t]*\d+[ \t]*[-–][ \t]*)?(?:OFFICER[ \t]+)?NARRATIVE\b"
# End of the fixed values.


def strip_headings(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^#{1,6}[ \t]+", "")


def strip_cid(text: Column) -> Column:
    """Without the (cid:N) marks that font decoding leaves."""
    return F.regexp_replace(text, r"\(cid:\d+\)", "")


def merge_date_time(text: Column) -> Column:
    """A Date line followed by a Time line becomes one Date/Time line."""
    clock = r"\d{1,2}:\d{2}(?:\s*hrs?)?"
    return F.regexp_replace(text, rf"(?im)^Date:\s*(\d{{1,2}}/\d{{1,2}}/\d{{2,4}}(?:\s+{clock})?)\s*\n\s*Time:\s*({clock})", "Date/Time: $1 $2")


def split_narrative(text: Column) -> tuple[Column, Column]:
    """(text before the first narrative heading, text from it on)."""
    at = F.regexp_instr(text, F.lit(NARRATIVE))
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")


def plain_paragraph(text: Column) -> Column:
    """Plain letters, digits and ``. , $ - ( )`` only, with single blanks; what is dropped leaves no blank."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9\s\.,\$\-\(\)]", ""), r"\s+", " "), "^ | $", "")


def assembled(doc_type: Column, page_text: Column, before_narrative: Column, tables: Column) -> Column:
    """The text that extraction reads: narrative-free text and tables for adjuster reports, page text otherwise."""
    return F.when(doc_type == "ia", F.concat_ws("\n", before_narrative, tables)).otherwise(page_text)


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line), trimmed.  Rows go to partitions by document before they multiply."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))


#: Lines that a running decision is folded over at a time, so that long texts take no more than their length times this.
AT_ONCE = 64


def every_other(edges: Column) -> Column:
    """Of each run of true values the first, third, fifth: a value is taken if it is true and the one before was not taken.

    The decision is folded over blocks, for both ways in which the block before may have ended; then the blocks are chained.
    """
    none = F.array().cast("array<boolean>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / AT_ONCE).cast("int")), lambda b: F.slice(edges, b * AT_ONCE + 1, AT_ONCE))
    fold = lambda block, before: F.aggregate(block, F.array(F.lit(before)), lambda a, e: F.array_append(a, e & ~F.element_at(a, -1)), lambda a: F.slice(a, 2, F.size(a)))
    both = F.transform(blocks, lambda b: F.struct(fold(b, False).alias("after_none"), fold(b, True).alias("after_one")))
    start = F.struct(F.array().cast("array<array<boolean>>").alias("parts"), F.lit(False).alias("last"))
    chosen = lambda s, x: F.when(s["last"], x["after_one"]).otherwise(x["after_none"])
    chained = F.aggregate(both, start, lambda s, x: once(chosen(s, x), lambda c: F.struct(F.array_append(s["parts"], c).alias("parts"), F.element_at(c, -1).alias("last"))), lambda s: F.flatten(s["parts"]))
    return F.when(F.size(edges) > 0, chained).otherwise(none)


def labels_joined(text: Column) -> Column:
    """A text with each label joined to the value that follows after blank lines; a document's lines stay in its row.

    Two neighbouring lines that are not blank may be joined if blank lines stand between them, the first is a label and
    the second a value; a line joined as a value is no label of the next.
    """

    def joinable(a: Column, b: Column) -> Column:
        line, follower = a["line"], b["line"]
        known = line.rlike(KNOWN_LABEL)
        label = line.endswith(":") | ~line.rlike("[a-z]") | known
        value = known | follower.rlike(VALUE)
        return (b["at"] > a["at"] + 1) & label & value & ~follower.rlike(DELIMITER)

    def pieces(lines: Column) -> Column:
        solid = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"] != "")

        def put(solid: Column) -> Column:
            n = F.size(solid)
            edges = F.zip_with(F.slice(solid, 1, n - 1), F.slice(solid, 2, n - 1), joinable)

            def lines_of_each(taken: Column) -> Column:
                blank = lambda k: F.array_repeat(F.lit(""), k)

                def one(x: Column, i: Column) -> Column:
                    following = F.get(solid, i + 1)
                    joins, swallowed = F.coalesce(F.get(taken, i), F.lit(False)), (i > 0) & F.coalesce(F.get(taken, i - 1), F.lit(False))
                    both = F.concat(x["line"], F.when(x["line"].endswith(":"), " ").otherwise(": "), following["line"])
                    own = F.when(swallowed, F.array().cast("array<string>")).when(joins, F.array(both)).otherwise(F.array(x["line"]))
                    gap = F.coalesce(following["at"], F.size(lines)) - x["at"] - 1
                    return F.concat(own, F.when(joins, F.array().cast("array<string>")).otherwise(blank(gap)))

                return F.concat(blank(F.get(solid, F.lit(0))["at"]), F.flatten(F.transform(solid, one)))

            return F.when(n > 0, once(every_other(edges), lines_of_each)).otherwise(lines)

        return once(solid, put)

    tidy = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(once(tidy, pieces), "\n")


def join_labels(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, text) without heading marks, with labels joined to their values and times to their dates."""
    return docs.select(key, merge_date_time(labels_joined(strip_headings(F.col("text")))).alias("text"))


def latest(numbers: Column) -> Column:
    """For each place the largest number so far (numbers are -1 or more), in blocks as in :func:`every_other`."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / AT_ONCE).cast("int")), lambda b: F.slice(numbers, b * AT_ONCE + 1, AT_ONCE))
    own = F.transform(blocks, lambda b: F.aggregate(b, F.array(F.lit(-1)), lambda a, x: F.array_append(a, F.greatest(F.element_at(a, -1), x)), lambda a: F.slice(a, 2, F.size(a))))

    def chained(own: Column) -> Column:
        before = F.aggregate(own, F.array(F.lit(-1)), lambda a, b: F.array_append(a, F.greatest(F.element_at(a, -1), F.element_at(b, -1))))
        return F.flatten(F.zip_with(own, F.slice(before, 1, F.size(own)), lambda b, least: F.transform(b, lambda x: F.greatest(x, least))))

    return F.when(F.size(numbers) > 0, once(own, chained)).otherwise(F.array().cast("array<int>"))


def _table_lines(text: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of array<struct<at, cells, is_rule, start, ruled, row>>: each line with its cells if it is one of a pipe
    table, the line before its table, and the last separator so far."""

    def line(x: Column, i: Column) -> Column:
        row = F.when(x.endswith("|") & ~x.startswith("|"), F.substring(x, F.instr(x, "|"), F.length(x))).otherwise(x)

        def read(row: Column) -> Column:
            is_row = row.startswith("|") & row.rlike(r"^\|.*\|$")
            cells = F.transform(F.split(F.regexp_replace(row, r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))
            return F.struct(i.alias("at"), F.when(is_row, cells).alias("cells"), (row.startswith("|") & row.rlike(r"^\|[\s\-|]+\|$")).alias("is_rule"))

        return once(row, read)

    def placed(rows: Column) -> Column:
        starts = latest(F.transform(rows, lambda r: F.when(r["cells"].isNull(), r["at"]).otherwise(-1)))
        rules = latest(F.transform(rows, lambda r: F.when(r["is_rule"], r["at"]).otherwise(-1)))
        return F.transform(F.arrays_zip(rows.alias("r"), starts.alias("start"), rules.alias("rule")), lambda x: F.struct(
            x["r"]["at"].alias("at"), x["r"]["cells"].alias("cells"), x["r"]["is_rule"].alias("is_rule"), x["start"].alias("start"), (x["rule"] > x["start"]).alias("body"),
        ))

    tidy = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return once(F.transform(tidy, line), lambda rows: once(placed(rows), then))


def table_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, table_no, body, cells): rows of pipe tables; ``body`` after the separator row.  Lines stay in their row."""
    rows = _table_lines(F.col("text"), lambda lines: F.filter(lines, lambda r: r["cells"].isNotNull() & ~r["is_rule"]))
    with_pipes = docs.where(F.contains("text", F.lit("|")))  # no other text has a row
    return with_pipes.select(key, F.explode(rows).alias("r")).select(key, F.col("r.at").alias("line_no"), F.col("r.start").alias("table_no"), "r.body", "r.cells")


def flatten_tables(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, col, line): pipe tables as ``header: cell`` lines.

    Rows of alternating upper-case keys and values and two-column tables give
    ``key: value``; the last header row before the separator names the columns of
    the others.  Lines stay in their row.
    """

    def alternates(cells: Column) -> Column:
        keys = F.filter(F.transform(cells, lambda c, i: F.when(i % 2 == 0, c)), lambda c: c.isNotNull() & (c != ""))
        return (F.size(cells) % 2 == 0) & (F.size(keys) > 0) & F.forall(keys, lambda c: (c.rlike("[A-Z]") & ~c.rlike("[a-z]")) | c.endswith(":"))

    def told(lines: Column) -> Column:
        is_row = lambda r: r["cells"].isNotNull() & ~r["is_rule"]
        heads = latest(F.transform(lines, lambda r: F.when(F.coalesce(is_row(r) & ~r["body"] & ~alternates(r["cells"]), F.lit(False)), r["at"]).otherwise(-1)))

        def with_heads(heads: Column) -> Column:
            def of(r: Column) -> Column:
                cells, n = r["cells"], F.size(r["cells"])
                cell = lambda i: F.get(cells, i)
                filled = lambda c: (F.size(c) == 2) & (F.get(c, F.lit(0)) != "") & (F.get(c, F.lit(1)) != "")
                at = F.get(heads, r["at"])
                head = F.when(at > r["start"], F.get(lines, at)["cells"])
                pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / 2).cast("int") - 1, F.lit(0))), lambda i: F.when(cell(i * 2) != "", F.concat(cell(i * 2), F.lit(": "), cell(i * 2 + 1))))
                first = F.array(F.when((cell(F.lit(0)) != "") & (cell(F.lit(1)) != ""), F.concat(cell(F.lit(0)), F.lit(": "), cell(F.lit(1)))))
                named = F.slice(F.zip_with(head, cells, lambda h, c: F.when((h != "") & (c != ""), F.concat(h, F.lit(": "), c))), 1, F.least(F.size(head), n))
                none = F.array().cast("array<string>")
                out = F.when(alternates(cells), pairs).when(~r["body"], F.when(filled(cells), first).otherwise(none)).when(head.isNull(), none).when(filled(head), first).otherwise(named)
                return F.transform(out, lambda line, col: F.struct(r["at"].alias("line_no"), col.alias("col"), line.alias("line")))

            return F.filter(F.flatten(F.transform(F.filter(lines, is_row), of)), lambda x: x["line"].isNotNull())

        return once(heads, with_heads)

    return docs.select(key, F.explode(_table_lines(F.col("text"), told)).alias("x")).select(key, "x.*")


# Lines that hold several labelled values, letters that decoding puts into words, and the labels under which
# the kind of a collision is looked for.
CONDITIONS = r"(?i)^Weather\s+(.+?)\s+Light\s+Conditions\s+(.+?)\s+Road\s+Surface\s+N?(Dry|Wet|Snow|Ice|Slush|Sand|Mud|Oil|Water|Gravel|Other\S*)(?:\s|$)"
CONDITIONS_PART = r"(?i)^Weather\s+(.+?)\s+Light\s+Conditions\s+(.+)$"
DIRECTION = r"(?i)Direction\s+(?:[A-Z][ \t]*)?of\s+Crash\s+(.+?)(?:\s+Areas\s+of\s+Damage|$)"
HAS_WEATHER = r"(?i)\bWeather\s*:"
WEATHER_INSIDE = r"\bWEATHER[ \t]+(.+?)(?=[ \t]+TYPE\s+OF\b|[ \t]+COLLISION\s+TYPE\b|\s*$)"
TYPE_OF = r"(?i)\bTYPE\s+OF\s+(?!COLLISION\b)(.+?)(?=\s*/\s*\d|\s*$)"
COLLISION_TYPE = r"(?i)\bCOLLISION\s+TYPE\s+(.+?)(?=\s+TOTAL\s+(?:VEHICLES?|UNITS?)|\s*$)"
STRAY_INSIDE, STRAY_BEFORE, STRAY_LAST = r"(?<=[a-z])[A-Z](?=[a-z])", r"(?<=[a-z])[A-Z](?=\))", "[A-Z]$"
KIND_LABELS = ("Direction of Crash", "Manner of Collision", "Type of Crash")
# End of the fixed values.


def compound_line(line: Column) -> Column:
    """A line as the lines that it stands for: of several conditions one each, and alias lines after a collision line.

    The first rule that matches decides; all other lines stay as they are.
    """
    clean = F.trim(strip_cid(line))
    part = lambda p, n: F.trim(F.regexp_extract(clean, p, n))
    said = lambda name, v: F.concat(F.lit(f"{name}: "), v)
    kinds = lambda v: [said(n, v) for n in KIND_LABELS]
    light = lambda v: [said("Light Conditions", v), said("Light Condition", v)]
    tidy = lambda v: F.regexp_replace(F.regexp_replace(v, STRAY_INSIDE, ""), STRAY_BEFORE, "")
    direction = F.trim(F.regexp_replace(tidy(part(DIRECTION, 1)), STRAY_LAST, ""))
    kind = F.trim(F.regexp_replace(part(TYPE_OF, 1), r"\s*/\s*$", ""))
    return (
        F.when(clean.rlike(CONDITIONS), F.array(said("Weather", part(CONDITIONS, 1)), *light(part(CONDITIONS, 2)), said("Road Surface", part(CONDITIONS, 3))))
        .when(clean.rlike(CONDITIONS_PART), F.array(said("Weather", part(CONDITIONS_PART, 1)), *light(part(CONDITIONS_PART, 2))))
        .when(clean.rlike(DIRECTION), F.array(tidy(line), *kinds(direction)))
        .when(~clean.rlike(HAS_WEATHER) & clean.rlike(WEATHER_INSIDE), F.array(line, said("Weather", part(WEATHER_INSIDE, 1))))
        .when(clean.rlike(TYPE_OF) & (kind != ""), F.array(line, *kinds(kind)))
        .when(clean.rlike(COLLISION_TYPE) & (part(COLLISION_TYPE, 1) != ""), F.array(line, *kinds(part(COLLISION_TYPE, 1))))
        .otherwise(F.array(line))
    )


def expand_compound_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, text) with compound lines expanded; a document's lines stay in its row."""
    lines = F.flatten(F.transform(F.split("text", "\r\n|\r|\n", -1), compound_line))
    return docs.select(key, F.array_join(lines, "\n").alias("text"))
