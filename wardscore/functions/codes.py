"""Code books: texts mapped to weights, ordinals and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardscore.functions.clean import clean_missing, collapse_ws, trimmed_upper

# Indicator name -> pollutant column.
POLLUTANTS = {
    "Nitrogen dioxide (NO2)": "NO2",
    "Fine particles (PM 2.5)": "PM2.5",
    "Ozone (O3)": "O3",
}

# Severity by law category, share by completion, minimum severity by keyword.
LAW_WEIGHT = {"FELONY": 5.0, "MISDEMEANOR": 3.0, "VIOLATION": 1.0}
ATTEMPT_FACTOR = {"COMPLETED": 1.0, "ATTEMPTED": 0.7}
OFFENSE_FLOOR = {"ASSAULT": 5.0, "ROBBERY": 4.0, "BURGLARY": 3.0, "LARCENY": 2.0}

# Rating code -> ordinal, and codes that mean no rating.
RATING_SCALE = {"U/UD": 1, "UPF": 2, "D": 3, "P": 4, "WD": 5, "O": 6}
RATING_ALIASES = {"U": "U/UD", "UD": "U/UD"}
NO_RATING = ["NAN", "NONE", "NO DATA", ""]

# First digit of a district id -> borough.
BOROUGH_BY_DIGIT = {"1": "Manhattan", "2": "Bronx", "3": "Brooklyn", "4": "Queens", "5": "Staten Island"}


def mapped(key: Column, book: dict) -> Column:
    """Look a key up in a small literal map; NULL where it is not there."""
    pairs = [F.lit(x) for item in book.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def pollutant(name: Column) -> Column:
    return mapped(collapse_ws(name), POLLUTANTS)


def law_weight(law: Column) -> Column:
    return F.coalesce(mapped(trimmed_upper(law), LAW_WEIGHT), F.lit(1.0))


def attempt_factor(attempt: Column) -> Column:
    return F.coalesce(mapped(trimmed_upper(attempt), ATTEMPT_FACTOR), F.lit(1.0))


def offense_floor(offense: Column, rule: str = "last") -> Column:
    """Minimum severity by keyword, NULL if none is in the text.

    With several keywords in one text, 'last' takes the one latest in the list
    above, 'max' the highest.
    """
    text = F.upper(offense.cast("string"))
    hits = [F.when(text.contains(word), F.lit(value)) for word, value in OFFENSE_FLOOR.items()]
    if rule == "last":
        return F.coalesce(*reversed(hits))
    if rule == "max":
        return F.greatest(*hits)
    raise ValueError(f"rule must be 'last' or 'max', not {rule!r}")


def severity(law: Column, offense: Column | None, rule: str = "last") -> Column:
    """Law weight, raised to the keyword's minimum where the text names one."""
    weight = law_weight(law)
    return weight if offense is None else F.greatest(weight, offense_floor(offense, rule))


def rating_code(c: Column) -> Column:
    """Canonical rating code; NULL where no rating was given."""
    code = trimmed_upper(clean_missing(c))
    code = F.when(~code.isin(NO_RATING), code)
    return F.coalesce(mapped(code, RATING_ALIASES), code)


def rating_value(code: Column) -> Column:
    """Ordinal of a canonical code; NULL for codes outside the scale."""
    return mapped(code, RATING_SCALE).cast("double")


def borough_of(area_id: Column) -> Column:
    return F.coalesce(mapped(F.substring(area_id, 1, 1), BOROUGH_BY_DIGIT), F.lit("Unknown"))
