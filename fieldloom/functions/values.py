"""Cleaning, typing, comparing and judging of single values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
#: Texts that mean a missing value, compared in lower case.
MISSING = ("", "unknown", "n/a", "not found", "none")
#: The shapes of typed values.
TYPES = {
    "phone": r"^[\d\s().+\-x]{10,}$",
    "date": r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}$",
    "money": r"^\$?\s*[\d,]+(?:\.\d{2})?$",
    "email": r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$",
    "url": r"(?i)^(?:https?://|www\.)[A-Za-z0-9.\-]+(?:/[^\s]*)?$",
    "fein": r"^\d{2}-?\d{7}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "naics": r"^\d{4,6}$",
    "sic": r"^\d{4}$",
    "integer": r"^-?\d+$",
}
# Shapes that cleaners look for, bounds of words, shapes and words of good values of a finished record.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
NUMERIC_DATE, DATE_PARTS = r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})"
NAMED_DATE = rf"(?i)(?:{MONTHS})\w*\s+\d{{1,2}},?\s+\d{{4}}"
LONG_PROSE, PROSE_BLANKS, NUMBER_WORDS, NAME_WORDS = 30, 3, 4, 3
GOOD_VIN, CAPITALS, GOOD_NUMBER, DOLLARS = "^[A-HJ-NPR-Z0-9]{17}$", r"^[A-Z\s&/]+$", r"^[\w\-/#]{3,25}$", r"\$[\d,]+"
HOUSE, CROSSING = r"\d+\s+[A-Za-z]", r"(?i)&|\bI-\d+\b|\bUS-\d+\b|\bSR-\d+\b|\bMile Marker\b|\bExit\s+\d+"
DATE_FIELDS, MONEY_FIELDS = ("date_time", "inspection_date"), ("coverage_a", "coverage_b", "coverage_c", "coverage_d", "settlement")
SUBROGATED, NOT_COVERED = ("yes", "no", "potential", "n/a", "none"), ("n/a", "not applicable", "excluded")
# End of the fixed values.


def stripped(v: Column) -> Column:
    return F.regexp_replace(v, r"^\s+|\s+$", "")


def missing(v: Column) -> Column:
    return v.isNull() | F.lower(stripped(v)).isin(*MISSING)


def is_type(v: Column, kind: Column) -> Column:
    """Whether a value has the shape of a type; an unknown type never has."""
    out = F.lit(False)
    for name, shape in TYPES.items():
        out = F.when(F.lower(kind) == name, v.rlike(shape)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def words(v: Column) -> Column:
    return F.size(F.filter(F.split(v, r"\s+"), lambda w: w != ""))


def _cleaned(v: Column, clean: Column) -> Column:
    return F.when(v.isNull() | stripped(v).isin("", "Unknown", "N/A"), v).otherwise(clean)


def clean_date(v: Column) -> Column:
    """Numeric dates as MM/DD/YYYY, two-digit years in this century; month names as they are; prose is Unknown."""
    s = stripped(v)
    parts = [F.regexp_extract(s, DATE_PARTS, i) for i in (1, 2, 3)]
    shaped = s.rlike(f"(?i){NUMERIC_DATE}|{MONTHS}")
    full = F.when(F.length(parts[2]) == 2, F.concat(F.lit("20"), parts[2])).otherwise(parts[2])
    numeric = F.concat_ws("/", F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0"), full)
    blanks = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    return _cleaned(v, F.when(~shaped & (F.length(s) > LONG_PROSE) & (blanks > PROSE_BLANKS), UNKNOWN).when(parts[0] != "", numeric).otherwise(v))


def clean_vin(v: Column) -> Column:
    s = F.upper(stripped(v))
    return _cleaned(v, F.when(s.rlike(GOOD_VIN), s).otherwise(UNKNOWN))


def clean_report_number(v: Column) -> Column:
    s = stripped(v)
    return _cleaned(v, F.when(words(s) > NUMBER_WORDS, UNKNOWN).otherwise(s))


def clean_name(v: Column) -> Column:
    s = stripped(v)
    return _cleaned(v, F.when(s.rlike(CAPITALS) & (words(s) > NAME_WORDS), UNKNOWN).otherwise(s))


#: Which cleaner a field of a record gets.
CLEANERS = {"date_time": clean_date, "inspection_date": clean_date, "vin": clean_vin, "report_number": clean_report_number, "officer": clean_name, "inspection_firm": clean_name}


def clean(field_id: Column, v: Column) -> Column:
    """A record's value after the cleaner of its field; other fields keep theirs."""
    out = None
    for field, cleaner in CLEANERS.items():
        out = (F if out is None else out).when(field_id == field, cleaner(v))
    return out.otherwise(v)


def field_quality(field_id: Column, v: Column) -> Column:
    """0 to 1: how good a value of a finished record looks."""
    s = stripped(v)
    low = F.lower(s)
    return (
        F.when(missing(v), 0.0)
        .when(field_id.isin(*DATE_FIELDS), F.when(s.rlike(NUMERIC_DATE) | s.rlike(NAMED_DATE), 1.0).otherwise(0.4))
        .when(field_id == "report_number", F.when(words(s) > NUMBER_WORDS, 0.2).when(s.rlike(GOOD_NUMBER), 1.0).otherwise(0.6))
        .when(field_id == "subrogation", F.when(low.isin(*SUBROGATED), 1.0).otherwise(0.7))
        .when(field_id.isin(*MONEY_FIELDS), F.when(s.rlike(DOLLARS), 1.0).when(low.isin(*NOT_COVERED), 0.9).otherwise(0.5))
        .when(
            field_id == "location",
            F.when(s.rlike(HOUSE) | s.rlike(CROSSING), 1.0).when(F.length(s) > 5, 0.7).otherwise(0.3),
        )
        .when(F.length(s) >= 3, 1.0)
        .otherwise(0.5)
    )


def quality_reason(field_id: Column, v: Column) -> Column:
    """Why a value is not fully trusted; null where nothing is wrong."""
    q = field_quality(field_id, v)
    said = (
        F.when(missing(v), "not extracted")
        .when(field_id.isin(*DATE_FIELDS), "date format not recognized")
        .when(field_id == "report_number", F.when(q <= 0.2, "looks like a sentence, not a case number").otherwise("unusual format"))
        .when(field_id.isin(*MONEY_FIELDS), F.when(q < 0.9, "no dollar amount found"))
        .when(field_id == "location", F.when(q <= 0.3, "location may be incomplete"))
        .when(field_id != "subrogation", "value is very short")
    )
    return F.when(q < 1.0, F.concat(field_id, F.lit(": "), said))


def band(score: Column, high: float, middle: float) -> Column:
    return F.when(score >= high, "high").when(score >= middle, "medium").otherwise("low")


def shown(v: Column, fallback: str = "N/A") -> Column:
    """How a missing value is written."""
    return F.coalesce(F.nullif(stripped(v), F.lit("")), F.lit(fallback))


def same_text(v: Column) -> Column:
    return F.lower(stripped(F.regexp_replace(v, r"\s+", " ")))


def trimmed_text(v: Column) -> Column:
    """As :func:`same_text`, without punctuation at either end."""
    return F.regexp_replace(same_text(v), r"^[\s.,;:!?'\"()\-]+|[\s.,;:!?'\"()\-]+$", "")


def as_items(v: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(v, ","), same_text), lambda x: x != "")))


DATE_FORMATS = ("M/d/yyyy h:mm a", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy", "M-d-yyyy")


def moment(v: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(stripped(v), F.lit(f)) for f in DATE_FORMATS])


def same_date(a: Column, b: Column) -> Column:
    x, y = moment(a), moment(b)
    return F.coalesce((F.to_date(x) == F.to_date(y)) | (F.abs(F.unix_timestamp(x) - F.unix_timestamp(y)) <= 3600), F.lit(False))
