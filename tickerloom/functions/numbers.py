"""Numbers out of display strings, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions.text import col

# Suffixes of abbreviated amounts.
MULTIPLIERS = {"T": 1e12, "B": 1e9, "M": 1e6, "K": 1e3}

# The longest prefix a float parser accepts, and an amount with suffix.
FLOAT_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
AMOUNT = r"([\d.]+)([{suffixes}]?)"


def parse_float(text: str | Column) -> Column:
    """Leading number of the text ("12abc" is 12), null when there is none."""
    return F.nullif(F.regexp_extract(col(text), FLOAT_PREFIX, 1), F.lit("")).try_cast("double")


def _amount(text: Column, suffixes: str) -> Column:
    pattern = AMOUNT.format(suffixes=suffixes)
    digits = F.regexp_extract(text, pattern, 1)
    number = parse_float(digits)
    suffix = F.regexp_extract(text, pattern, 2)
    factor = reduce(lambda w, s: w.when(suffix == s, F.lit(MULTIPLIERS[s])), suffixes, F).otherwise(F.lit(1.0))
    return F.coalesce(number * factor, F.lit(0.0))


def parse_multiplier(text: str | Column) -> Column:
    """"1.23T", "45,678K", "12" as a number; no number is 0."""
    return _amount(F.replace(col(text), F.lit(","), F.lit("")), "TMBK")


def parse_volume(text: str | Column) -> Column:
    """Like ``parse_multiplier`` without K and without removing commas."""
    return _amount(col(text), "MBT")


def parse_range(text: str | Column) -> tuple[Column, Column]:
    """Low and high of "a - b"; both null unless there are exactly two parts."""
    parts = F.split(F.replace(col(text), F.lit(","), F.lit("")), "-")
    pick = lambda i: F.when(F.size(parts) == 2, parse_float(F.get(parts, i)))
    return pick(0), pick(1)


def parse_dividend(text: str | Column) -> tuple[Column, Column]:
    """Rate and yield of "0.96 (0.45%)"; "N/A" and absent are 0."""
    t = F.when(col(text) != "N/A", col(text))
    parts = F.split(t, r"\(")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rate = zero(parse_float(F.trim(F.get(parts, 0))))
    share = zero(parse_float(F.regexp_replace(F.get(parts, 1), r"[%)]", "")))
    return rate, share


def percent_text(share: str | Column) -> Column:
    """0.452 as "45.2%"."""
    return F.format_string("%.1f%%", F.round(col(share) * 100, 1))


def percent_value(text: str | Column) -> Column:
    return F.replace(col(text), F.lit("%"), F.lit("")).try_cast("double")


def dollars(amount: str | Column) -> Column:
    return F.format_string("$%.2f", col(amount))
