"""Rows out of fetched web pages: links, articles, listing blocks, quotes, tables, symbols.

Pages arrive as a table ``(page_id, url, html, ...)``; everything here is a Column
expression on a page's own row, so the only shuffles are the per-company caps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions import text as T
from tickerloom.functions.numbers import parse_float, parse_volume
from tickerloom.functions.text import any_keyword, clean_markup, col, relevance_score

# Patterns of the page elements that are read.
ANCHOR = r'(?is)<a\s([^>]*)>(.*?)</a>'
HREF = r'(?is)href\s*=\s*["\']([^"\']*)["\']'
PARAGRAPH = r'(?is)<p(?:\s[^>]*)?>(.*?)</p>'
HEADING = r'(?is)<h1[^>]*>(.*?)</h1>'
PAGE_TITLE = r'(?is)<title[^>]*>(.*?)</title>'
TIME_ATTRIBUTE = r'(?is)<time[^>]*datetime="([^"]*)"'
PUBLISH_META = r'(?is)<meta[^>]*name="publish-date"[^>]*content="([^"]*)"'
TABLE_ROW = r'(?is)<tr[^>]*>(.*?)</tr>'
TABLE_CELL = r'(?is)<t[dh][^>]*>(.*?)</t[dh]>'
LIST_ITEM = r'(?is)<li[^>]*>(.*?)</li>'
SPAN = r'(?is)<span[^>]*>(.*?)</span>'
BLOCK = r'(?is)<div[^>]*class="[^"]*contentD[^"]*"[^>]*>(.*?)</div>'
SYMBOL_ATTRIBUTE = r'data-symbol="([A-Z]+)"'
SYMBOL_LINK = r'/quote/([A-Z]+)\?'
SUMMARY_CHARS, BODY_CHARS, MATCH_CHARS = 300, 500, 300


def _all(text: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def _first(text: str | Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def with_elements(pages: DataFrame, into: str, element: str, css_class: str | None = None) -> DataFrame:
    """Add the elements of a name, and a class if given, as intervals: ``into`` array of (open, close, inner).

    The page is cut at the tags of that name.  ``open`` and ``close`` number the cuts an
    element begins and ends at; an end tag closes the latest open element, found by adding
    up the depth from the begin tag on.  ``inner`` is the text between.  Elements come in page order,
    nested ones too; one that is never closed ends with the page, stray end tags are passed over.
    """
    begins, ends = rf"(?is)^<{element}[\s>/]", rf"(?is)^</{element}[\s>]"
    wanted = begins if css_class is None else rf'(?is)^<{element}\s[^>]*class="[^"]*(?<![\w-]){css_class}(?![\w-])[^"]*"'
    cut = pages.withColumn("_cut", F.split(F.coalesce("html", F.lit("")), rf"(?i)(?=</?{element}[\s>/])"))
    marked = cut.withColumns({
        "_step": F.transform("_cut", lambda c: F.when(c.rlike(begins), 1).when(c.rlike(ends), -1).otherwise(0)),
        "_begin": F.filter(F.sequence(F.lit(0), F.size("_cut") - 1), lambda i: F.get("_cut", i).rlike(wanted))})
    lengths = F.expr("""transform(_begin, i -> aggregate(slice(_step, i + 1, size(_step)), struct(0 AS depth, 0 AS n, false AS shut),
        (s, step) -> CASE WHEN s.shut THEN s ELSE struct(s.depth + step AS depth, s.n + 1 AS n, s.depth + step <= 0 AS shut) END,
        s -> CASE WHEN s.shut THEN s.n - 1 ELSE s.n END))""")
    inner = F.expr(f"""zip_with(_begin, _length, (i, n) -> struct(i AS open, i + n AS close,
        regexp_replace(array_join(slice(_cut, i + 1, n), ''), '(?is)^<{element}[^>]*>', '') AS inner))""")
    return marked.withColumn("_length", lengths).withColumn(into, inner).drop("_cut", "_step", "_begin", "_length")


def _container(selector: str) -> tuple[str, str | None]:
    """Name and class of ``name.class`` or ``name``."""
    name, _, css_class = selector.partition(".")
    return name, css_class or None


def anchors(pages: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Every anchor of every page: pos, raw attributes, href and plain title."""
    found = F.arrays_zip(_all("html", ANCHOR, 1).alias("attrs"), _all("html", ANCHOR, 2).alias("inner"))
    rows = pages.select("page_id", "url", *extra, F.posexplode(found).alias("pos", "a"))
    return rows.select(
        "page_id", "url", *extra, "pos", F.col("a.attrs").alias("attrs"),
        F.regexp_extract("a.attrs", HREF, 1).alias("href"), clean_markup("a.inner").alias("title"))


def absolute(href: str | Column, base: str | Column) -> Column:
    """``href`` resolved against the base page."""
    h, b = col(href), col(base)
    root = F.regexp_extract(b, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(b, r"^([a-zA-Z][\w+.-]*:)", 1)
    path = F.regexp_extract(b, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*/)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(path)
    return (
        F.when(h.rlike(r"^[a-zA-Z][\w+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("/"), F.concat(root, h))
        .otherwise(F.concat(root, folder, h))
    )


@dataclass(frozen=True)
class LinkRule:
    """Which anchors of a listing page are article links."""

    source: str
    css_class: str | None = None
    contains: str | None = None
    suffix: str | None = None
    prefix: str | None = None
    min_title: int = 1
    distinct: bool = False
    cap: int | None = 50
    base: str | None = None


# The link rules of the listing pages that are read.
LINK_RULES = {
    "search_results": LinkRule("CNBC", css_class="resultlink", cap=50),
    "article_links": LinkRule("EconomicTimes", contains="articleshow", cap=50),
    "tag_pages": LinkRule("MoneyControl", contains="/news/", suffix=".html", min_title=20, distinct=True, cap=30),
}


def extract_links(pages: DataFrame, rule: LinkRule, ticker: str | None = None, company: str | None = None,
                  min_relevance: int = 1) -> DataFrame:
    """Article links by rule, at most ``rule.cap`` anchors per page in page order."""
    extra = [c for c in (ticker, company) if c]
    rows = anchors(pages, extra)
    if rule.css_class:
        rows = rows.filter(F.col("attrs").rlike(rf'class="[^"]*\b{rule.css_class}\b[^"]*"'))
    if rule.contains:
        rows = rows.filter(F.contains("href", F.lit(rule.contains)))
    if rule.suffix:
        rows = rows.filter(F.col("href").endswith(rule.suffix))
    if rule.prefix:
        rows = rows.filter(F.col("href").startswith(rule.prefix))
    link = absolute("href", F.lit(rule.base) if rule.base else "url")
    rows = rows.withColumns({"link": link, "source": F.lit(rule.source)})
    if rule.distinct:
        rows = first_links(rows)
    # The cap counts matching anchors; the title and relevance tests come after it.
    if rule.cap and not rule.distinct:
        rows = _cap(rows, "page_id", rule.cap)
    rows = rows.filter((F.col("href") != "") & (F.length("title") >= rule.min_title))
    if ticker or company:
        score = relevance_score("title", F.lit(""), company or F.lit(""), ticker or F.lit(""))
        rows = rows.withColumn("relevance", score).filter(F.col("relevance") >= min_relevance)
    if rule.cap and rule.distinct:
        rows = _cap(rows, "page_id", rule.cap)
    return rows.drop("attrs")


def _cap(rows: DataFrame, key: str, cap: int, order: Sequence[str] = ("pos",)) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def first_links(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """First occurrence of each link per page."""
    first = rows.groupBy(key, "href").agg(F.min("pos").alias("pos"))
    return rows.join(first, [key, "href", "pos"], "left_semi")


def extract_latest_links(pages: DataFrame, selectors: Sequence[str], prefix: str, extra: Sequence[str] = ()) -> DataFrame:
    """Links of anchors by ordered selectors, absolute prefix only, first-seen distinct.

    A selector is the class of the anchors, or ``name.class a``: all anchors inside such an
    element.  ``pos`` is the anchor's place on the page, or among those of the elements.
    """
    own = [F.when(F.col("attrs").rlike(rf'class="[^"]*(?<![\w-]){c.removeprefix("a.")}(?![\w-])[^"]*"'), F.lit(i))
           for i, c in enumerate(selectors) if " " not in c]
    found = None
    if own:
        # An anchor may match several selectors; the first counts.
        found = anchors(pages, extra).withColumn("selector", F.coalesce(*own)).filter(F.col("selector").isNotNull())
    for i, selector in enumerate(selectors):
        if " " in selector:
            inside = with_elements(pages, "_e", *_container(selector.split()[0]))
            html = F.array_join(F.transform("_e", lambda e: e["inner"]), "")
            rows = anchors(inside.withColumn("html", html), extra).withColumn("selector", F.lit(i))
            found = rows if found is None else found.unionByName(rows)
    return found.filter(F.col("href").startswith(prefix)).groupBy("page_id", *extra, "href").agg(
        F.min(F.struct("selector", "pos")).alias("seen")).select(
        "page_id", *extra, F.col("href").alias("link"), "seen.selector", "seen.pos")


def extract_articles(pages: DataFrame, whole_body: bool = False, container: str | None = None) -> DataFrame:
    """Title, summary and publish date of article pages, and the ``body`` and ``head`` of their text.

    The summary is the first two paragraphs up to 300 characters, the title when
    there are none; or with ``whole_body`` all paragraphs up to 500 characters.  With a
    ``container`` (``name.class``) only paragraphs inside such elements count; the summary
    falls back to all of them where there are none, the whole body does not.
    """
    clean = lambda c: F.filter(F.transform(_all(c, PARAGRAPH), clean_markup), lambda p: p != "")
    rows = pages
    if container:
        rows = with_elements(pages, "_e", *_container(container)).withColumn(
            "_inner", F.array_join(F.transform("_e", lambda e: e["inner"]), ""))
        inside = F.regexp_count("_inner", F.lit(PARAGRAPH)) > 0
        rows = rows.withColumn("_p", clean("_inner") if whole_body else F.when(inside, clean("_inner")).otherwise(clean("html")))
    else:
        rows = rows.withColumn("_p", clean("html"))
    title = clean_markup(F.coalesce(_first("html", HEADING), F.lit("")))
    body = F.array_join("_p", " ")
    two = F.array_join(F.slice("_p", 1, 2), " ")
    if whole_body:
        summary, published = F.substring(body, 1, BODY_CHARS), _first("html", TIME_ATTRIBUTE)
    else:
        summary = F.substring(F.coalesce(F.nullif(two, F.lit("")), title), 1, SUMMARY_CHARS)
        published = _first("html", PUBLISH_META)
    keep = [c for c in pages.columns if c not in ("html", "title", "summary", "published", "body", "head")]
    return rows.select(
        *keep, title.alias("title"), summary.alias("summary"),
        F.coalesce(published, F.lit("")).alias("published"),
        F.substring(body, 1, BODY_CHARS).alias("body"), F.substring(body, 1, MATCH_CHARS).alias("head"))


def matching_articles(articles: DataFrame, keywords: Sequence[str] | str) -> DataFrame:
    """Articles with a title and a keyword in the title or the first body characters.

    ``keywords`` is a list, or the name of an array column.
    """
    text = F.lower(F.concat("title", F.lit(" "), "head"))
    hit = T.contains_any(text, keywords) if isinstance(keywords, str) else any_keyword(text, keywords)
    return articles.filter((F.col("title") != "") & hit)


def extract_topic_blocks(pages: DataFrame, dictionary: DataFrame, cap: int = 80) -> DataFrame:
    """Listing blocks that match their company's keywords, first ``cap`` per company.

    ``pages(page_id, url, html, ticker, topic, topic_idx, page)``,
    ``dictionary(ticker, keywords ARRAY<STRING>)``.
    """
    keep = ["page_id", "url", "ticker", "topic", "topic_idx", "page"]
    blocks = pages.select(*keep, F.posexplode(_all("html", BLOCK)).alias("pos", "block"))
    head = _first("block", r"(?is)<h2[^>]*>(.*?)</h2>")
    rows = blocks.select(
        *keep, "pos",
        clean_markup(_first(head, ANCHOR, 2)).alias("title"),
        clean_markup(_first("block", PARAGRAPH)).alias("summary"),
        clean_markup(_first("block", r"(?is)<time[^>]*>(.*?)</time>")).alias("published"),
        absolute(F.regexp_extract(head, HREF, 1), "url").alias("link"),
    ).filter(_first("block", r"(?is)<h2[^>]*>.*?(<a\s)").isNotNull() | (F.col("title") != ""))
    hits = rows.withColumn("_t", T.article_text()).join(dictionary, "ticker").filter(
        T.contains_any("_t", "keywords")).drop("_t", "keywords")
    return _cap(hits, "ticker", cap, ("topic_idx", "page", "pos"))


def stat_pairs(html: str | Column) -> Column:
    """Label/value pairs: first two cells of table rows, then two spans or paragraphs of list items."""
    def pair(items: Column) -> Column:
        return F.struct(clean_markup(F.get(items, 0)).alias("label"), clean_markup(F.get(items, 1)).alias("value"))

    rows = F.transform(_all(html, TABLE_ROW), lambda r: pair(_all(r, TABLE_CELL)))
    items = F.transform(
        _all(html, LIST_ITEM),
        lambda li: pair(F.when(F.size(_all(li, SPAN)) >= 2, _all(li, SPAN)).otherwise(_all(li, PARAGRAPH))))
    return F.filter(F.concat(rows, items), lambda p: (p["label"] != "") & (p["value"] != ""))


def stat(pairs: str | Column, label: str) -> Column:
    """Value of a label, the last one given; else of the first label that starts with it."""
    p = col(pairs)
    exact = F.filter(p, lambda s: s["label"] == label)
    # A repeated label keeps its first place but its last value.
    key = F.get(F.filter(F.transform(p, lambda s: s["label"]), lambda k: k.startswith(label)), 0)
    near = F.filter(p, lambda s: s["label"] == key)
    return F.coalesce(F.try_element_at(exact, F.lit(-1))["value"], F.try_element_at(near, F.lit(-1))["value"])


def streamer(html: str | Column, field: str, symbol: str | Column) -> Column:
    """Value of a streaming field tagged with the symbol, else of the first such field."""
    h = col(html)
    tag = r'<fin-streamer(?=[^>]*data-field="%s")%s[^>]*>([^<]*)'
    own = F.concat(F.lit('<fin-streamer(?=[^>]*data-field="%s")(?=[^>]*data-symbol="' % field), col(symbol),
                   F.lit('")[^>]*'))
    value = lambda prefix: F.nullif(F.regexp_extract(h, prefix, 1), F.lit(""))
    any_value = value(tag % (field, r'[^>]*\bvalue="([^"]*)"'))
    any_text = F.nullif(F.regexp_extract(h, tag % (field, ""), 1), F.lit(""))
    own_value = F.nullif(F.regexp_extract(
        F.regexp_substr(h, F.concat(own, F.lit(">[^<]*"))), r'\bvalue="([^"]*)"', 1), F.lit(""))
    own_text = F.nullif(F.regexp_extract(F.regexp_substr(h, F.concat(own, F.lit(">[^<]*"))), r">([^<]*)$", 1), F.lit(""))
    bare = lambda c: F.regexp_replace(c, r"[(),%]", "")
    return F.coalesce(own_value, bare(own_text), any_value, bare(any_text))


def page_name(html: str | Column, symbol: str | Column) -> Column:
    """Company name: the title up to " (", else the cleaned first heading, else the symbol."""
    title = F.trim(F.regexp_extract(clean_markup(F.coalesce(_first(html, PAGE_TITLE), F.lit(""))), r"^(.*?) \(", 1))
    h1 = F.replace(clean_markup(F.coalesce(_first(html, HEADING), F.lit(""))), F.lit("Yahoo Finance"), F.lit(""))
    heading = F.trim(F.regexp_replace(h1, r"\(.*?\)", ""))
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(title), blank(heading), col(symbol))


# Output field and page label of the numeric statistics of a quote page.
QUOTE_STATS = {
    "previous_close": "Previous Close",
    "open": "Open",
    "bid": "Bid",
    "ask": "Ask",
    "pe_ratio": "PE Ratio (TTM)",
    "eps": "EPS (TTM)",
    "target_est_1y": "1y Target Est",
    "beta": "Beta (5Y Monthly)",
    "trailing_pe": "Trailing P/E",
    "forward_pe": "Forward P/E",
    "peg_ratio": "PEG Ratio (5yr expected)",
    "price_to_sales": "Price/Sales (ttm)",
    "price_to_book": "Price/Book (mrq)",
    "enterprise_value_to_revenue": "Enterprise Value/Revenue",
    "enterprise_value_to_ebitda": "Enterprise Value/EBITDA",
    "diluted_eps": "Diluted EPS (ttm)",
    "book_value": "Book Value (mrq)",
    "fifty_day_average": "50-Day Moving Average",
    "two_hundred_day_average": "200-Day Moving Average",
    "target_mean_price": "Price Target",
}
# Output field and page label of the statistics kept as text.
QUOTE_TEXTS = {
    "day_range": "Day's Range",
    "year_range": "52 Week Range",
    "market_cap_text": "Market Cap",
    "average_volume_text": "Avg. Volume",
    "earnings_date": "Earnings Date",
    "forward_dividend_yield": "Forward Dividend & Yield",
    "enterprise_value": "Enterprise Value",
    "profit_margin": "Profit Margin",
    "return_on_assets": "Return on Assets (ttm)",
    "return_on_equity": "Return on Equity (ttm)",
    "revenue": "Revenue (ttm)",
    "net_income": "Net Income Avi to Common (ttm)",
    "total_cash": "Total Cash (mrq)",
    "total_debt_to_equity": "Total Debt/Equity (mrq)",
    "levered_free_cash_flow": "Levered Free Cash Flow (ttm)",
    "analyst_rating": "Rating",
}
# Output field and streaming field of the live numbers.
QUOTE_STREAMS = {
    "current_price": "regularMarketPrice",
    "change": "regularMarketChange",
    "percent_change": "regularMarketChangePercent",
    "volume": "regularMarketVolume",
}


def extract_quotes(pages: DataFrame) -> DataFrame:
    """One quote row per page ``(page_id, symbol, html)``; absent numbers are 0, absent texts null."""
    from tickerloom.functions.numbers import parse_dividend, parse_multiplier, parse_range

    rows = pages.withColumn("_s", stat_pairs("html"))
    zero = lambda c: F.coalesce(parse_float(c), F.lit(0.0))
    rows = rows.select(
        "page_id", F.upper("symbol").alias("symbol"), page_name("html", F.upper("symbol")).alias("name"),
        *[zero(F.replace(streamer("html", f, F.upper("symbol")), F.lit(","), F.lit(""))).alias(n)
          for n, f in QUOTE_STREAMS.items()],
        *[zero(F.replace(stat("_s", label), F.lit(","), F.lit(""))).alias(n) for n, label in QUOTE_STATS.items()],
        *[stat("_s", label).alias(n) for n, label in QUOTE_TEXTS.items()],
    )
    low, high = parse_range("day_range")
    year_low, year_high = parse_range("year_range")
    rate, share = parse_dividend("forward_dividend_yield")
    return rows.withColumns({
        "is_up": F.col("change") >= 0,
        "day_low": low, "day_high": high,
        "fifty_two_week_low": year_low, "fifty_two_week_high": year_high,
        "dividend_rate": rate, "dividend_yield": share,
        "market_cap": parse_multiplier("market_cap_text"),
        "average_volume": parse_multiplier("average_volume_text"),
    })


def extract_active_table(pages: DataFrame) -> DataFrame:
    """Rows of eight or more cells: symbol, name, price, change, percent, volume, market cap."""
    rows = pages.select("page_id", F.posexplode(_all("html", TABLE_ROW)).alias("pos", "row"))
    cells = F.transform(_all("row", r"(?is)<td[^>]*>(.*?)</td>"), clean_markup)
    rows = rows.withColumn("c", cells).filter(F.size("c") >= 8)
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))
    zero = lambda c: F.coalesce(parse_float(c), F.lit(0.0))
    cell = lambda i: F.get("c", i)
    change = zero(bare(cell(4)))
    return rows.select(
        "page_id", "pos", cell(0).alias("symbol"), cell(1).alias("name"),
        zero(bare(F.regexp_extract(cell(3), r"^[\d,.]+", 0))).alias("current_price"),
        change.alias("change"),
        zero(bare(F.replace(cell(5), F.lit("%"), F.lit("")))).alias("percent_change"),
        parse_volume(cell(6)).alias("volume"),
        parse_volume(F.coalesce(cell(8), F.lit(""))).alias("market_cap"),
        F.lit("N/A").alias("exchange"), (change >= 0).alias("is_up"))


def extract_symbols(pages: DataFrame, limit: int = 25) -> DataFrame:
    """First ``limit`` symbols per page: the first table's Symbol column that lists any, else tagged, else linked symbols.

    A table's columns are named by its first row.  Rows outside any table count as one table.
    """
    tables = F.when(F.size("_tables") > 0, F.transform("_tables", lambda t: t["inner"])).otherwise(F.array("html"))
    cells = F.transform(tables, lambda t: F.transform(_all(t, TABLE_ROW), lambda r: F.transform(_all(r, TABLE_CELL), clean_markup)))
    rows = with_elements(pages.select("page_id", "html"), "_tables", "table").withColumn("_cells", cells)
    listed = F.expr(r"""transform(_cells, t -> filter(
        transform(slice(t, 2, greatest(size(t) - 1, 0)), r -> get(r, cast(array_position(get(t, 0), 'Symbol') AS int) - 1)),
        s -> s RLIKE '^\\p{L}+$'))""")
    first = F.get(F.filter(listed, lambda found: F.size(found) > 0), 0)
    none = lambda c: F.when(F.size(c) > 0, c)
    symbols = F.coalesce(
        first, none(F.array_distinct(_all("html", SYMBOL_ATTRIBUTE))),
        none(F.array_distinct(_all("html", SYMBOL_LINK))))
    return rows.select("page_id", F.posexplode(F.slice(symbols, 1, limit)).alias("pos", "symbol"))
