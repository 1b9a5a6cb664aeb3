"""Cleaning and typing of raw text columns, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts a loosely typed CSV reader takes as "no value".
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Codes that stand for an unknown area.
UNKNOWN_CODES = ["", "NAN", "NONE", "(NULL)"]

BLANKS = " \t\n\r\f\v"


def clean_missing(c: Column) -> Column:
    """Text with the usual missing-value spellings turned to NULL."""
    text = c.cast("string")
    return F.when(~text.isin(MISSING_TEXTS), text)


def to_number(c: Column) -> Column:
    """Double, or NULL where the text is not a finite plain number.

    A cast alone would also take 'inf', 'NaN' and literals such as '1.5d' and
    '0x1p3'; those end in a letter or hold an x. No regular expression is
    needed, which matters on every row of a log.
    """
    text = F.trim(c.cast("string"))
    last = F.right(text, F.lit(1))
    plain = (last.between("0", "9") | (last == ".")) & ~F.lower(text).contains("x")
    return F.when(plain, text.try_cast("double"))


def number_column(df: DataFrame, name: str) -> Column:
    """A column of ``df`` as double: parsed if it is text, else only freed of NaN."""
    c = df[f"`{name}`"]
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return finite(c.cast("double"))
    return c.cast("double") if isinstance(kind, T.NumericType) else to_number(c)


def finite(c: Column) -> Column:
    """A double column with NaN turned to NULL."""
    return F.when(~F.isnan(c), c)


def collapse_ws(c: Column) -> Column:
    """Trimmed text with every run of white space as one blank; NULL becomes ''."""
    text = F.translate(F.coalesce(c.cast("string"), F.lit("")), BLANKS, " " * len(BLANKS))
    # Most texts hold no run of blanks, and need no regular expression.
    return F.trim(F.when(text.contains("  "), F.regexp_replace(text, " +", " ")).otherwise(text))


def collapse_ws_text(text: str | None) -> str:
    """The same rule for a parameter."""
    return " ".join((text or "").split())


def trimmed_upper(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def area_code(c: Column) -> Column:
    """Upper-case area code, 'UNKNOWN' where it is missing."""
    code = trimmed_upper(clean_missing(c))
    return F.when(code.isNull() | code.isin(UNKNOWN_CODES), F.lit("UNKNOWN")).otherwise(code)


def precinct_code(c: Column) -> Column:
    """Whole number as text, rounded half to even; '0' where missing or bad."""
    whole = F.bround(to_number(c)).try_cast("bigint").cast("string")
    return F.coalesce(whole, F.lit("0"))


def id_text(c: Column) -> Column:
    """Integer id as canonical text: 101, ' 101' and '101.0' all give '101'."""
    return to_number(c).try_cast("bigint").cast("string")


def uncensor(c: Column) -> Column:
    """'<1' (below the detection limit of one) becomes 0.5."""
    text = c.cast("string")
    return F.when(F.translate(text, BLANKS, "") == "<1", F.lit("0.5")).otherwise(text)


def start_year(c: Column, strict: bool = False) -> Column:
    """Year before the first '-'; bad text raises if strict, else gives NULL."""
    year = F.trim(F.split_part(c.cast("string"), F.lit("-"), F.lit(1)))
    return year.cast("int") if strict else year.try_cast("int")


def within(c: Column, lo: float, hi: float) -> Column:
    """The value where it lies in [lo, hi], else NULL."""
    return F.when(c.between(lo, hi), c)
