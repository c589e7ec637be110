"""Text expressions: cleaning, keys and keyword tests (all substring tests)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions import fixed_values as fixed


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def article_text(title: str | Column = "title", summary: str | Column = "summary") -> Column:
    """Lower-cased title, a space, and the summary."""
    return F.lower(F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "), F.coalesce(col(summary), F.lit(""))))


def _for_text(text: str | Column, use) -> Column:
    """``use(text)`` with the text computed once, also where ``use`` tests it per keyword.

    Word lists stay literal arrays: one small expression, whatever their length,
    keeps the generated code of a query with several lists below the JVM's limits.
    """
    return F.element_at(F.transform(F.array(col(text)), use), 1)


def keyword_hits(text: str | Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the (lower-cased) text."""
    known = F.lit(list(words))
    return _for_text(text, lambda t: F.size(F.filter(known, lambda w: F.contains(t, w))))


def any_keyword(text: str | Column, words: Sequence[str]) -> Column:
    known = F.lit(list(words))
    return _for_text(text, lambda t: F.exists(known, lambda w: F.contains(t, w)))


def squeeze(text: str | Column) -> Column:
    """Collapse whitespace."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def clean_markup(text: str | Column) -> Column:
    """Drop tags, resolve the two common entities, collapse whitespace."""
    plain = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"<[^>]+>", "")
    plain = F.replace(F.replace(plain, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return squeeze(plain)


def slugify(name: str | Column) -> Column:
    bare = F.regexp_replace(F.lower(col(name)), r"[^\p{L}\p{N}_\s-]", "")
    dashed = F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), " ", "-")
    return F.regexp_replace(dashed, "-+", "-")


def article_key(title: str | Column, url: str | Column, lower_title: bool = False) -> Column:
    t = F.coalesce(col(title), F.lit(""))
    return F.md5(F.concat(F.lower(t) if lower_title else t, F.coalesce(col(url), F.lit(""))))


def title_key(title: str | Column) -> Column:
    """First 50 letters, digits and underscores of the lower-cased title."""
    return F.substring(F.regexp_replace(F.lower(col(title)), r"[^\p{L}\p{N}_]+", ""), 1, 50)


def is_ownership_spam(text: str | Column) -> Column:
    return any_keyword(text, fixed.OWNERSHIP_SPAM)


def has_noise(text: str | Column, words: Sequence[str] = fixed.NOISE_WORDS) -> Column:
    """At least two different noise words; one is allowed."""
    return keyword_hits(text, words) >= 2


def classify(text: str | Column, rules: Mapping[str, Sequence[str]] = fixed.NEWS_CATEGORIES) -> Column:
    """Category with most keywords in the text; ties go to the earlier one, none to general."""
    entry = lambda hits, place, name: F.struct(
        hits.alias("hits"), F.lit(place).alias("place"), F.lit(name).alias("name"))
    ranked = [entry(keyword_hits(text, words), -i, name) for i, (name, words) in enumerate(rules.items())]
    # With no hit anywhere the general entry has the highest place.
    return F.array_max(F.array(entry(F.lit(0), 1, "general"), *ranked))["name"]


def first_category(text: str | Column, rules: Mapping[str, Sequence[str]] = fixed.NOTE_CATEGORIES) -> Column:
    """First category with any keyword in the text, else General."""
    names = [F.when(any_keyword(text, words), F.lit(name)) for name, words in rules.items()]
    return F.coalesce(*names, F.lit("General"))


def source_weight(link: str | Column, source: str | Column,
                  weights: Mapping[str, int] = fixed.SOURCE_WEIGHTS, default: int = 1) -> Column:
    a, b = F.lower(F.coalesce(col(link), F.lit(""))), F.lower(F.coalesce(col(source), F.lit("")))
    tests = [F.when(F.contains(a, F.lit(s)) | F.contains(b, F.lit(s)), F.lit(w)) for s, w in weights.items()]
    return F.coalesce(*tests, F.lit(default))


def relevance_score(title: str | Column, body: str | Column, company: str | Column, ticker: str | Column,
                    strict: bool = False) -> Column:
    """Points for ticker, company, finance words and a long title.

    The company name is part of the searched text, so its own two points always
    count when it is given; ``strict`` leaves it out of the text.
    """
    blank = lambda c: F.coalesce(col(c), F.lit(""))
    parts = [blank(title), F.lit(" "), blank(body), F.lit(" ")]
    text = F.lower(F.concat(*parts, *([] if strict else [blank(company)])))
    first_word = F.lower(F.regexp_extract(blank(company), r"(\S+)", 1))
    has_ticker = (blank(ticker) != "") & F.contains(text, F.lower(blank(ticker)))
    has_company = (first_word != "") & F.contains(text, first_word)
    point = lambda test, n: F.when(test, F.lit(n)).otherwise(0)
    return (
        point(has_ticker, 3) + point(has_company, 2) + point(any_keyword(text, fixed.FINANCE_WORDS), 2)
        + point(F.length(blank(title)) > 25, 1)
    )


def company_keywords(ticker: str | Column, name: str | Column) -> Column:
    """Ticker, full name and the name's words of more than three letters, lower-cased."""
    n = F.lower(F.coalesce(col(name), F.lit("")))
    words = F.filter(F.split(F.trim(n), r"\s+"), lambda w: F.length(w) > 3)
    full = F.when(n != "", F.array(n)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lower(col(ticker))), full, words))


def contains_any(text: str | Column, keywords: str | Column) -> Column:
    """Any element of a keyword array occurs in the text."""
    words = col(keywords)
    return _for_text(text, lambda t: F.exists(words, lambda k: F.contains(t, k)))
