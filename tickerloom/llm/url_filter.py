"""URL filter: rules for hosts and beginnings of paths, found by hashes of expressions.

A URL is expanded into expressions, a suffix of its host at a label with a beginning of its
path, of the sizes that any rule has.  Expressions meet rules in an equi-join on the first
four bytes of a digest, an integer; the rest of the digest is compared inside the aggregate
that finds the longest rule, where no optimizer can turn it into a join key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.line_dedup import ascii_lower
from tickerloom.plans.stored import stored

#: Hexadecimal digits of a digest that the join compares as one number.
PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_DIGITS), 16, 10).cast("long")


def _rest(digest: Column) -> Column:
    return F.unhex(F.substring(digest, PREFIX_DIGITS + 1, 64))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each row's ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``.  A rule fits its host and all hosts
    below it, if the URL's path begins with the rule's.  The longest rule (host and path
    together) wins; of equally long ones the one with the longer host, then ``block``.
    Without a fitting rule ``rule`` is null and the verdict ``allow``.  A null URL or one without ``://``
    has an empty host and path; a null id is kept; repeated rows are judged each; other
    columns are left out; rules with a null field are ignored.
    """
    # Written, so that Spark knows their size: few rules are broadcast below its threshold, and a URL's expressions
    # fold into one row before they move; many rules are joined by sorting.
    own = stored(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").filter(
        "rule_host IS NOT NULL AND rule_path IS NOT NULL AND verdict IS NOT NULL").distinct(), "url_rules")
    # The numbers of labels and the lengths of paths among the rules: two short lists at any number of rules.
    sizes = own.agg(F.collect_set(F.size(F.split("rule_host", "[.]"))).alias("labels"),
                    F.collect_set(F.length("rule_path")).alias("lengths")).first()
    labels, lengths = sorted(sizes.labels), sorted(sizes.lengths)
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    listed = own.select(_prefix(digest).alias("rule_prefix"), _rest(digest).alias("rule_rest"),
                        "rule_host", "rule_path", F.col("verdict").alias("rule_verdict"))

    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = F.split("host", "[.]")
    suffixes = F.array_distinct(F.array(*[
        F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - (n - 1), n), ".")) for n in labels])) \
        if labels else F.array().cast("array<string>")
    starts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) \
        if lengths else F.array().cast("array<string>")
    expanded = rows.select(
        "row", "id", "host", "path", F.explode_outer(F.array_compact(suffixes)).alias("suffix"),
        F.array_compact(starts).alias("starts")).select(
        "row", "id", "host", "path", "suffix", F.explode_outer("starts").alias("start")).select(
        "row", "id", "host", "path", _digest(F.col("suffix"), F.col("start")).alias("digest")).select(
        "row", "id", "host", "path", _prefix(F.col("digest")).alias("prefix"), _rest(F.col("digest")).alias("rest"))
    met = expanded.join(listed, F.col("prefix") == F.col("rule_prefix"), "left")
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"),
                    F.col("rule_verdict") == "block", F.concat("rule_host", "rule_path").alias("rule"),
                    F.col("rule_verdict").alias("verdict"))
    # A row's values are the same in all its expressions: they are carried, and only the row's number is a key.
    best = met.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("id", "host", "path")],
        F.max(F.when(F.col("rest") == F.col("rule_rest"), rank)).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"))


def rules_table(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict)."""
    return pages.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
