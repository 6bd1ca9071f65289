"""How plausible a value is for its field, from 0 to 1, as column expressions.

Fields without a rule get 0.5.  The current year is a parameter, so results can
be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 0.5

# Vocabularies per field, the words that make a value plausible.
WEATHER = [
    "clear", "rain", "rainy", "raining", "snow", "snowing", "snowy", "sleet", "hail", "hailing", "fog", "foggy", "cloud", "cloudy", "overcast", "mist", "misty", "drizzle",
    "drizzling", "storm", "thunderstorm", "thunder", "sunny", "ice", "icy", "blowing", "smoke", "smog", "dust", "sand", "wind", "windy", "partly",
]
LIGHT = ["daylight", "dusk", "dawn", "dark", "night", "lighted", "unlighted", "unknown lighting", "day", "noon", "afternoon"]
SURFACE = [
    "wet", "dry", "ice", "icy", "snow", "snowy", "slush", "slushy", "standing water", "glare ice", "freezing rain", "frost", "frosty",
    "mud", "muddy", "gravel", "sand", "sandy", "oil", "oily", "water", "black ice",
]
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATES = [
    r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b",
    r"\b\d{4}[/\-]\d{2}[/\-]\d{2}\b",
    rf"(?i)\b{MONTH}[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"(?i)\b\d{{1,2}}\s+{MONTH}[a-z]*\.?\s+\d{{4}}\b",
    rf"(?i)\b{MONTH}\s+\d{{4}}\b",
]
ROAD = (
    r"(?i)\b(?:highway|hwy|interstate|i-\d|route|rd|road|street|st|avenue|ave|blvd|boulevard|drive|dr|lane|ln|parkway|pkwy|freeway|fwy|"
    r"mile\s*marker|mm\s*\d|exit\s*\d|northbound|southbound|eastbound|westbound|nb|sb|eb|wb)\b"
)
CROSSING = r"(?i)\b(?:at\s+intersection|intersection|cross\s*street|and\s+[a-z]|&\s+[a-z]|at\s+[a-z]|between|junction|jct)\b"
GARBAGE = r"(?:[A-Za-z][A-Z][a-z]){2,}|[^a-zA-Z0-9\s\-/.,()#']{3,}|\b[a-z]+[A-Z][a-z]+[A-Z][a-z]"
COLLISION = (
    r"(?i)\b(?:collision|crash|impact|rear.?end|head.?on|angle|sideswipe|rollover|overturn|fixed.?object|pedestrian|bicycle|chain|"
    r"reaction|broadside|intersection|turning|backing|parking|single.?vehicle|multi.?vehicle|same.?direction|opposite.?direction|"
    r"right.?angle|left.?turn|right.?turn|run.?off.?road|hit.?and.?run)\b"
)
FACTOR = (
    r"(?i)\b(?:speed|alcohol|drug|distract|fatigue|fatigued|asleep|impair|vision|obstruct|failure|control|weather|fog|rain|ice|snow|"
    r"defect|follow|signal|right.?of.?way|reckless|aggressive|mechanical|brake|tire|glare|animal|pedestrian|bicycle|inattentive|"
    r"inexperienc|unknown|none)"
)
DAMAGE = (
    r"(?i)\b(?:damage|damag|crush|crumple|shatter|dent|scratch|deform|bent|fracture|deflect|deploy|airbag|bumper|fender|windshield|"
    r"mirror|panel|frame|axle|guardrail|median|concrete|lamp|assembly|quarter.?panel|lift.?gate|grille|radiator|strut|spindle)\b"
)
MEDICAL = (
    r"(?i)\b(?:ems|ambulance|paramedic|medic|rescue|fire\s*dept|fire\s*department|hospital|medical|health|emergency|emerg|dept|unit|"
    r"transport|trauma)\b"
)
LOOSE_DATE = r"\d{4}|\d{1,2}/\d{1,2}"
FULL_YEAR = r"\b((?:19|20)\d{2})\b"
FIRST_YEAR, OLD_YEAR, LATE_YEAR = 1990, 1970, 2040
CASE_NUMBER, ANY_NUMBER = r"^[A-Z]{2,6}[-/]\d{2,4}[-/]\d{2,10}", r"^[A-Za-z0-9\-/#]{4,40}$"
VIN, ANY_VIN, VIN_LENGTH = "^[A-HJ-NPR-Z0-9]{17}$", "^[A-Z0-9]{17}$", 17
YEAR = r"^\d{4}$"
PROPER, LETTERS = r"^[A-Z][a-z'.\-]+$|^[A-Z]{1,3}\.?$", "[A-Za-z]{2}"
NO_START, ENDS_OPEN, CODES, HEADING = r"^[^\w]", "^[^,]+,$", r"\[\d{2}\]", r"^\([A-Z\-/\s]+\)$"
NO_AGENCY, PHONE = r"(?i)^(?:n/?a|none|not\s+applicable|not\s+required)\s*$", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"
#: Shortest and longest values of a field.
LENGTHS = {"report_number": (4, 40), "officer": (3, 80), "location": (10, 200), "accident_type": (5, 150), "contributing_factors": (5, 300), "property_damage": (10, 500), "ems_agency": (5, 100), "road_surface": (1, 80)}
NAME_WORDS, PLAIN_TYPE = (2, 6), 80
# End of the fixed values.


def _fits(v: Column, field: str) -> Column:
    return F.length(v).between(*LENGTHS[field])


def _any_word(v: Column, words: list[str]) -> Column:
    return F.lower(v).rlike("|".join(words))


def date(v: Column, year_now: int) -> Column:
    shaped = F.lit(False)
    for p in DATES:
        shaped = shaped | v.rlike(p)
    year = F.regexp_extract(v, FULL_YEAR, 1).try_cast("int")
    return (
        F.when(~shaped, F.when(v.rlike(LOOSE_DATE), 0.4).otherwise(0.2))
        .when(year.isNull(), 0.5)
        .when(year.between(FIRST_YEAR, year_now + 1), 1.0)
        .when(year.between(OLD_YEAR, LATE_YEAR), 0.5)
        .otherwise(0.2)
    )


def report_number(v: Column) -> Column:
    return (
        F.when(~_fits(v, "report_number"), 0.3)
        .when(v.rlike(CASE_NUMBER), 1.0)
        .when(v.rlike(ANY_NUMBER), 0.8)
        .otherwise(0.4)
    )


def vin(v: Column) -> Column:
    v = F.upper(v)
    return F.when(F.length(v) != VIN_LENGTH, 0.2).when(v.rlike(VIN), 1.0).when(v.rlike(ANY_VIN), 0.7).otherwise(0.4)


def year(v: Column, year_now: int) -> Column:
    return F.when(~v.rlike(YEAR), 0.3).when(v.try_cast("int").between(FIRST_YEAR, year_now + 1), 1.0).otherwise(0.2)


def _vocabulary(v: Column, words: list[str]) -> Column:
    return F.when(_any_word(v, words), 1.0).when(v.rlike(r"\d"), 0.3).otherwise(0.4)


def person(v: Column) -> Column:
    words = F.split(v, r"\s+")
    proper = F.size(F.filter(words, lambda w: w.rlike(PROPER)))
    return (
        F.when(~_fits(v, "officer"), 0.3)
        .when(~F.size(words).between(*NAME_WORDS), 0.4)
        .when(proper >= 2, 1.0)
        .when(v.rlike(LETTERS), 0.6)
        .otherwise(0.3)
    )


def location(v: Column) -> Column:
    return (
        F.when(~_fits(v, "location"), 0.2)
        .when(v.rlike(NO_START) | v.rlike(GARBAGE), 0.2)
        .when(v.rlike(ROAD) | v.rlike(CROSSING), 1.0)
        .otherwise(0.6)
    )


def accident_type(v: Column) -> Column:
    return F.when(~_fits(v, "accident_type"), 0.2).when(v.rlike(COLLISION), F.when(F.length(v) <= PLAIN_TYPE, 1.0).otherwise(0.7)).otherwise(0.6)


def contributing_factors(v: Column) -> Column:
    return F.when(~_fits(v, "contributing_factors"), 0.2).when(v.rlike(ENDS_OPEN), 0.3).when(v.rlike(CODES) | v.rlike(FACTOR), 1.0).otherwise(0.5)


def property_damage(v: Column) -> Column:
    return F.when(~_fits(v, "property_damage"), 0.2).when(v.rlike(HEADING), 0.2).when(v.rlike(DAMAGE), 1.0).otherwise(0.5)


def ems_agency(v: Column) -> Column:
    return (
        F.when(v.rlike(NO_AGENCY), 0.3)
        .when(~_fits(v, "ems_agency"), 0.2)
        .when(v.rlike(PHONE), 0.2)
        .when(v.rlike(MEDICAL), 1.0)
        .otherwise(0.5)
    )


def road_surface(v: Column) -> Column:
    return F.when(~_fits(v, "road_surface") | v.rlike(r"\d"), 0.2).when(_any_word(v, SURFACE), 1.0).otherwise(0.5)


def plausibility(field_id: Column, value: Column, year_now: int = 2026, more: dict | None = None) -> Column:
    """The score of a value for its field.  ``more`` maps further field ids to functions of a column."""
    v = F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))
    rules = {
        "date_time": date(v, year_now), "report_number": report_number(v), "vin": vin(v), "year": year(v, year_now),
        "weather": _vocabulary(v, WEATHER), "light_condition": _vocabulary(v, LIGHT), "officer": person(v), "location": location(v),
        "accident_type": accident_type(v), "contributing_factors": contributing_factors(v), "property_damage": property_damage(v),
        "ems_agency": ems_agency(v), "road_surface": road_surface(v),
    }
    rules |= {k: f(v) for k, f in (more or {}).items()}
    out = F.when(value.isNull(), F.lit(NEUTRAL))
    for field, score in rules.items():
        out = out.when(field_id == field, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(NEUTRAL)))))
    return out.otherwise(F.lit(NEUTRAL))
