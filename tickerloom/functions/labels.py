"""Signal labels, class numbers, article dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions import fixed_values as fixed
from tickerloom.functions.text import col

# Timestamp formats seen in news rows, without weekday and zone word.
DATE_FORMATS = [
    "d MMM yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "d MMM, yyyy, hh:mm a",
    "d MMM yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy h:mm a",
    "MMM d, yyyy h:mm a",
]


def five_way_label(sentiment: str | Column, impact: str | Column, regulation: str | Column) -> Column:
    s, i, r = col(sentiment), col(impact), col(regulation)
    return (
        F.when((s > 0.15) & (i > 0.30), "Strong Bullish")
        .when(s > 0.05, "Bullish")
        .when((s < -0.15) & (i > 0.30), "Strong Bearish")
        .when((s < -0.05) | (r >= 2), "Bearish")
        .otherwise("Neutral")
    )


def three_way_label(sentiment: str | Column, impact: str | Column, regulation: str | Column) -> Column:
    s, i, r = col(sentiment), col(impact), col(regulation)
    return F.when((s > 0.05) & (i > 0.25), "Bullish").when((s < -0.05) | (r >= 2), "Bearish").otherwise("Neutral")


def label_index(label: str | Column) -> Column:
    name = col(label)
    index = F.lit(fixed.LABEL_INDEX["Neutral"])
    for number in sorted(set(fixed.LABEL_INDEX.values())):
        names = [k for k, v in fixed.LABEL_INDEX.items() if v == number]
        index = F.when(name.isin(names), F.lit(number)).otherwise(index)
    return index


def argmax3(bull: str | Column, neutral: str | Column, bear: str | Column) -> Column:
    """Class number of the largest of three values; the first wins ties."""
    a, b, c = col(bull), col(neutral), col(bear)
    top = F.greatest(a, b, c)
    return F.when(a == top, 0).when(b == top, 1).otherwise(2)


def class_name(index: str | Column) -> Column:
    i = col(index)
    pick = F.lit(None).cast("string")
    for number, name in enumerate(fixed.CLASS_NAMES):
        pick = F.when(i == number, F.lit(name)).otherwise(pick)
    return pick


def parse_date(text: str | Column) -> Column:
    """Best-effort timestamp of a free-form date, null when no format fits.

    Zone words and offsets are dropped, not applied: the wall time is kept.
    """
    plain = F.regexp_replace(F.trim(col(text)), r"^[A-Za-z]{3},\s*", "")
    plain = F.regexp_replace(plain, r"\.\d+", "")
    plain = F.regexp_replace(plain, r"\s*(?:(?!AM|PM)[A-Z]{2,4}|Z|(?<=:\d\d)\s?[+-]\d{2}:?\d{2}|\s[+-]\d{4})$", "")
    tries = [F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries)


def within_days(published: str | Column, asof: str | Column, days: int = 30) -> Column:
    """Published 0 to ``days`` whole days before ``asof``; unknown dates pass, future ones do not."""
    p, a = col(published).cast("timestamp"), col(asof).cast("timestamp")
    age = F.floor((F.unix_micros(a) - F.unix_micros(p)) / 86_400_000_000)
    return p.isNull() | age.between(0, days)


def recent(published: str | Column, asof: str | Column, days: int = 14) -> Column:
    """Published within ``days`` of ``asof``; unknown dates fail."""
    p, a = col(published).cast("timestamp"), col(asof).cast("timestamp")
    return F.coalesce(p >= a - F.make_dt_interval(F.lit(days)), F.lit(False))
