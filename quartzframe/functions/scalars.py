"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that count as missing.
MISSING_TOKENS = ("", "nan", "NaN", "NA", "null", "None")
_NUMBER = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"
_NOT_FINITE = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def stem_of(path: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def fixed(x: Column, digits: int) -> Column:
    """x with a fixed number of digits, rounded by its exact value, halves to even, as C's printf does."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def is_unknown(x: Column) -> Column:
    return x.isNull() | (F.trim(x.cast("string")) == "")


def is_missing(cell: Column) -> Column:
    return cell.isNull() | F.trim(cell).isin(*MISSING_TOKENS)


def value_kind(cell: Column) -> Column:
    """number, missing or text. Infinities and numbers too large for a double are missing."""
    c = F.trim(cell)
    value = F.regexp_replace(c, "_", "").try_cast("double")
    number = F.when(F.abs(value) < float("inf"), "number").otherwise("missing")
    return F.when(is_missing(cell) | c.rlike(_NOT_FINITE), "missing").when(c.rlike(_NUMBER), number).otherwise("text")


def capture(text: Column, pattern: str) -> Column:
    """First group of pattern matched from the start; null if it does not match or is empty."""
    return F.nullif(F.regexp_extract(text, f"^(?:{pattern})", 1), F.lit(""))


def markdown_cell(x: Column) -> Column:
    return F.regexp_replace(F.replace(x.cast("string"), F.lit("|"), F.lit("\\|")), "\n", " ")


def days_left(date: Column, today: Column) -> Column:
    """Days from today to an ISO date's first ten characters; null if these are no date."""
    text = F.substring(date, 1, 10)
    return F.datediff(F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd")), today)


def agent_name(slot: Column) -> Column:
    """Bare names stay; paths become their last folder and file."""
    parts = F.split(slot, "/")
    path = slot.contains("/") | slot.endswith(".py")
    return F.when(path, F.concat_ws("/", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)))).otherwise(slot)
