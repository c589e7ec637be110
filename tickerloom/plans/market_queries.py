"""Registered queries over quotes, screeners, pages and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import fixed_values as fixed
from tickerloom.functions import labels
from tickerloom.functions import numbers as num
from tickerloom.functions.fixed_values import FALLBACK_SYMBOLS, TICKER_KEYWORDS
from tickerloom.functions.text import clean_markup
from tickerloom.operators import insights, market as M
from tickerloom.operators import indicators as I
from tickerloom.operators import news as N
from tickerloom.operators import strategy
from tickerloom.plans import views as V
from tickerloom.plans.news_queries import COMPANIES, NEWS, companies, sql_any
from tickerloom.plans.registry import ORACLE, register
from tickerloom.plans.series_queries import EOD, TA
from tickerloom.plans.stored import stored
from tickerloom.session import shared_dir
from tickerloom.sources import candles, news_files, pages as P, screeners, sinks

ASOF = "2000-01-03"

QUOTES = f"""{EOD},
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM eod),
quotes AS (
  SELECT a.symbol, a.close AS current_price, b.close AS previous_close, a.close - b.close AS change,
         (a.close - b.close) / b.close * 100 AS percent_change, a.volume
  FROM ranked a LEFT JOIN ranked b ON a.symbol = b.symbol AND b.n = 2 WHERE a.n = 1
)"""


def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    bars = stored(V.eod(spark, sf), "eod")
    return M.daily_quotes(bars)


@register(f"""WITH {QUOTES},
u AS (SELECT 'gainer' AS kind, * FROM quotes ORDER BY percent_change DESC, symbol LIMIT 10),
d AS (SELECT 'loser' AS kind, * FROM quotes ORDER BY percent_change, symbol LIMIT 10)
SELECT kind, symbol AS ticker, current_price AS price, percent_change, change AS change_amount, volume
FROM (FROM u UNION ALL FROM d)""")
def top_movers(spark: SparkSession, sf: str) -> DataFrame:
    return M.top_movers(_quotes(spark, sf)).drop("change")


@register(f"""WITH {QUOTES}
SELECT symbol, current_price, volume FROM quotes ORDER BY volume DESC, symbol LIMIT 25""")
def most_active(spark: SparkSession, sf: str) -> DataFrame:
    return M.most_active(_quotes(spark, sf)).select("symbol", "current_price", "volume")


@register(f"""WITH {EOD}
SELECT symbol, CAST(date AS VARCHAR) AS date, volume, place FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, date DESC) AS place FROM eod)
WHERE place <= 10""")
def top_volume_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.top_volume_days(V.eod(spark, sf))
    return rows.withColumns({"date": F.date_format("date", "yyyy-MM-dd"), "place": F.col("place").cast("bigint")})


@register("""
SELECT p_brand AS symbol, p_name AS name, count(*) AS listings FROM part
WHERE upper(p_brand) = upper('brand#12') OR contains(lower(p_name), 'ring') GROUP BY 1, 2""")
def symbol_lookup(spark: SparkSession, sf: str) -> DataFrame:
    parts = V.table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"))
    listings = parts.groupBy("symbol", "name").agg(F.count(F.lit(1)).alias("listings"))
    return M.symbol_lookup(listings, "brand#12").unionByName(M.symbol_search(listings, "RING")).distinct()


@register("""
SELECT symbol, arg_max(name, o) AS name FROM (
  SELECT p_brand AS symbol, min(p_name) AS name, 0 AS o FROM part GROUP BY 1
  UNION ALL SELECT p_brand, max(p_name), 1 FROM part GROUP BY 1
  UNION ALL SELECT p_type, min(p_name), 2 FROM part GROUP BY 1) GROUP BY 1""")
def merge_universe(spark: SparkSession, sf: str) -> DataFrame:
    part = V.table(spark, sf, "part")
    screen = lambda rows, key, agg: rows.groupBy(F.col(key).alias("symbol")).agg(agg("p_name").alias("name"))
    return M.merge_universe(
        screen(part, "p_brand", F.min),
        screen(part, "p_brand", F.max),
        screen(part, "p_type", F.min))


@register("""SELECT DISTINCT p_brand AS symbol FROM part""")
def fallback_source(spark: SparkSession, sf: str) -> DataFrame:
    """No part name holds a symbol in capitals, so the brands serve; the fixed list would come last."""
    part = V.table(spark, sf, "part")
    fixed = spark.createDataFrame([(s,) for s in FALLBACK_SYMBOLS], "symbol string")
    primary = part.select(F.regexp_extract("p_name", r"\b([A-Z]{3,})\b", 1).alias("symbol")).filter("symbol <> ''").distinct()
    return M.prefer(primary, part.select(F.col("p_brand").alias("symbol")).distinct(), fixed)


@register("""
SELECT o_orderkey AS id, o_totalprice / 1000 AS thousands,
       CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 1e12 WHEN o_orderkey % 4 = 1 THEN o_totalprice * 1e9
            WHEN o_orderkey % 4 = 2 THEN o_totalprice * 1e6 ELSE o_totalprice * 1e3 END AS amount,
       CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 1e12 WHEN o_orderkey % 4 = 1 THEN o_totalprice * 1e9
            WHEN o_orderkey % 4 = 2 THEN o_totalprice * 1e6 ELSE o_totalprice END AS volume,
       o_totalprice AS low, o_totalprice + 1 AS high, o_totalprice AS rate, 0.5 * (o_orderkey % 7) AS share
FROM orders""")
def display_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of all orders printed the way pages show them, and parsed back."""
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    shown = F.format_string("%.2f", total)
    suffix = F.get(F.array(*[F.lit(s) for s in "TBMK"]), (key % 4).cast("int"))
    rows = V.table(spark, sf, "orders").select(
        key.alias("id"), total, F.format_number(total, 2).alias("comma"),
        F.concat(shown, suffix).alias("short"),
        F.concat(F.format_number(total, 2), F.lit(" - "), F.format_string("%.2f", total + 1)).alias("range"),
        F.concat(shown, F.lit(" ("), F.format_string("%.1f", (key % 7) * 0.5), F.lit("%)")).alias("dividend"))
    low, high = num.parse_range("range")
    rate, share = num.parse_dividend("dividend")
    thousands = num.parse_multiplier("comma") / 1000
    return rows.select("id", thousands.alias("thousands"), num.parse_multiplier("short").alias("amount"),
                       num.parse_volume("short").alias("volume"), low.alias("low"), high.alias("high"),
                       rate.alias("rate"), share.alias("share"))


@register("""
WITH a AS (SELECT user_id, avg(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS v,
                  avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS c FROM events GROUP BY 1)
SELECT user_id, printf('%.1f%%', round(v * 100, 1)) AS shown, round(v * 100, 1) AS value,
       CASE WHEN v >= c AND v >= 1 - v - c THEN 'Bullish' WHEN c >= 1 - v - c THEN 'Neutral' ELSE 'Bearish' END AS top
FROM a""")
def percent_texts(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda kind: F.avg(F.when(F.col("event_type") == kind, 1).otherwise(0))
    rows = V.table(spark, sf, "events").groupBy("user_id").agg(share("view").alias("v"), share("click").alias("c"))
    rest = 1 - F.col("v") - F.col("c")
    return rows.select("user_id", num.percent_text("v").alias("shown"), num.percent_value(num.percent_text("v")).alias("value"),
                       labels.class_name(labels.argmax3("v", "c", rest)).alias("top"))


def _clean(x: str) -> str:
    return (f"trim(regexp_replace(replace(replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '&nbsp;', ' '), "
            f"'&amp;', '&'), '\\s+', ' ', 'g'))")


def _anchors_sql(pages: str = "pages") -> str:
    return f"""
a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s([^>]*)>(.*?)</a>', 1)) AS attrs,
             unnest(regexp_extract_all(html, '(?is)<a\\s([^>]*)>(.*?)</a>', 2)) AS inner_html,
             generate_subscripts(regexp_extract_all(html, '(?is)<a\\s([^>]*)>(.*?)</a>', 1), 1) - 1 AS pos
      FROM {pages}),
b AS (SELECT page_id, url, pos, regexp_extract(attrs, '(?is)href\\s*=\\s*["'']([^"'']*)["'']', 1) AS href,
             {_clean('inner_html')} AS title FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-zA-Z][\\w+.-]*:') THEN href
                     WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z][\\w+.-]*:)', 1) || href
                     WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][\\w+.-]*://[^/?#]*)', 1) || href
                     ELSE regexp_extract(url, '^([a-zA-Z][\\w+.-]*://[^/?#]*)', 1)
                       || coalesce(nullif(regexp_extract(url, '^[a-zA-Z][\\w+.-]*://[^/?#]*([^?#]*/)', 1), ''), '/')
                       || href END AS link FROM b)"""


ANCHORS = _anchors_sql()


@register(f"""WITH {ANCHORS}
SELECT page_id, pos, href, link, title FROM c WHERE href <> '' AND title <> '' AND pos < 50""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    rule = P.LinkRule("site", cap=50)
    rows = P.extract_links(V.table(spark, sf, "pages"), rule)
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "link", "title")


@register(f"""WITH {ANCHORS}
SELECT page_id, href, min(pos) AS pos FROM b WHERE href <> '' GROUP BY 1, 2""")
def page_links_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.extract_links(V.table(spark, sf, "pages"), P.LinkRule("site", min_title=0, distinct=True, cap=None))
    return rows.select("page_id", "href", F.col("pos").cast("bigint").alias("pos"))


@register(f"""WITH {ANCHORS}
SELECT page_id, href AS link, min(pos) AS pos FROM b WHERE starts_with(href, '/t') GROUP BY 1, 2""")
def latest_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("<a href"), F.lit('<a class="headline" href')))
    rows = P.extract_latest_links(pages, ["headline", "other"], "/t")
    return rows.select("page_id", "link", F.col("pos").cast("bigint").alias("pos"))


def _relevance_sql(ticker: str, company: str) -> str:
    text = f"lower(title || '  ' || '{company}')"
    return (f"(CASE WHEN contains({text}, lower('{ticker}')) THEN 3 ELSE 0 END) + 2"
            f" + (CASE WHEN {sql_any(fixed.FINANCE_WORDS, text)} THEN 2 ELSE 0 END)"
            f" + (CASE WHEN length(title) > 25 THEN 1 ELSE 0 END)")


_TICKER, _COMPANY = "An", "en Corp"
#: How the given pages' anchors are written as those of the three kinds of listing pages.
_AS_LISTED = {
    "search_results": ('<a href="/t', '<a class="x resultlink" href="/t'),
    "article_links": ('href="/a', 'href="/articleshow/a'),
    "tag_pages": (r'<a href="/([a-z]*)">([^<]*)</a>', r'<a href="/news/\1.html">\2 and more words of it</a>'),
}
_LISTED_SQL = {
    "search_results": ("replace(html, '{0}', '{1}')", "attrs LIKE '%resultlink%' AND title <> ''", 50),
    "article_links": ("replace(html, '{0}', '{1}')", "contains(href, 'articleshow') AND title <> ''", 50),
    "tag_pages": ("regexp_replace(html, '{0}', '{1}', 'g')",
                  "contains(href, '/news/') AND ends_with(href, '.html') AND length(title) >= 20", 30),
}


def _listed_sql(rule: str) -> str:
    html, test, cap = _LISTED_SQL[rule]
    pages = f"(SELECT page_id, url, {html.format(*_AS_LISTED[rule])} AS html FROM pages)"
    first = "QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1" if rule == "tag_pages" else ""
    links = _anchors_sql(pages).replace("b AS (SELECT page_id, url, pos,", "b AS (SELECT page_id, url, pos, attrs,")
    return f"""SELECT * FROM (WITH {links}, d AS (SELECT * FROM c WHERE {test.split(' AND length')[0]} {first})
        SELECT '{rule}' AS rule, page_id, CAST(pos AS BIGINT) AS pos, href, link, title,
               {_relevance_sql(_TICKER, _COMPANY)} AS relevance FROM d WHERE {test}
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= {cap})"""


@register(" UNION ALL ".join(_listed_sql(rule) for rule in _AS_LISTED))
def page_links_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """The link rules of the listing pages, with their relevance test."""
    pages, out = V.table(spark, sf, "pages").withColumns({"ticker": F.lit(_TICKER), "company": F.lit(_COMPANY)}), None
    for name, (written, shown) in _AS_LISTED.items():
        html = (F.regexp_replace("html", written, shown.replace("\\1", "$1").replace("\\2", "$2")) if name == "tag_pages"
                else F.replace("html", F.lit(written), F.lit(shown)))
        rows = P.extract_links(pages.withColumn("html", html), P.LINK_RULES[name], "ticker", "company")
        rows = rows.select(F.lit(name).alias("rule"), "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "link",
                           "title", "relevance")
        out = rows if out is None else out.unionByName(rows)
    return out


@register(f"""WITH {_anchors_sql("(SELECT page_id, url, regexp_extract(html, '(?is)<ul>(.*?)</ul>', 1) AS html FROM pages)")},
n AS (SELECT page_id, href AS link, 0 AS selector, min(pos) AS pos FROM b WHERE starts_with(href, '/t') GROUP BY 1, 2)
SELECT page_id, link, selector, CAST(pos AS BIGINT) AS pos FROM n
UNION ALL SELECT page_id, '/than', 1, regexp_count_all(html) FROM (
  SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\s([^>]*)>(.*?)</a>', 1)) AS c, html FROM pages)
WHERE (page_id, '/than') NOT IN (SELECT (page_id, link) FROM n)""".replace("regexp_count_all(html)", "c"))
def latest_links_inside(spark: SparkSession, sf: str) -> DataFrame:
    """Links inside an element that holds others of its kind, then a headline's."""
    html = F.concat(
        F.replace(F.replace("html", F.lit("<ul>"), F.lit('<div class="a Latest-news"><div>x</div>')), F.lit("</ul>"), F.lit("</div>")),
        F.lit('<a class="Latest-head" href="/than">t</a><div class="Latest-news2"><a href="/tout">x</a></div>'))
    rows = P.extract_latest_links(V.table(spark, sf, "pages").withColumn("html", html), ["div.Latest-news a", "a.Latest-head"], "/t")
    return rows.select("page_id", "link", "selector", F.col("pos").cast("bigint").alias("pos"))


_PARAS = f"""list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1),
  lambda x: {_clean('x')}), lambda x: x <> '')"""


@register(f"""
WITH p AS (SELECT page_id, url, {_clean("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
                  {_PARAS} AS ps FROM pages)
SELECT page_id, url, title, substring(coalesce(nullif(array_to_string(ps[1:2], ' '), ''), title), 1, 300) AS summary,
       substring(array_to_string(ps, ' '), 1, 500) AS body FROM p""")
def page_articles(spark: SparkSession, sf: str) -> DataFrame:
    return P.extract_articles(V.table(spark, sf, "pages")).select("page_id", "url", "title", "summary", "body")


@register(f"""
WITH a AS (SELECT page_id, html || '<p>foot</p>' AS page, page_id % 3 <> 0 AND regexp_matches(
                    regexp_extract(html, '(?is)<article>(.*?)</article>', 1), '(?is)<p(?:\\s[^>]*)?>(.*?)</p>') AS inside,
                  regexp_extract(html, '(?is)<article>(.*?)</article>', 1) AS html FROM pages),
i AS (SELECT page_id, inside, CASE WHEN inside THEN html ELSE page END AS html FROM a),
p AS (SELECT page_id, inside, {_PARAS} AS ps FROM i),
t AS (SELECT page_id, {_clean("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title FROM pages)
SELECT page_id, title, substring(coalesce(nullif(array_to_string(ps[1:2], ' '), ''), title), 1, 300) AS summary,
       CASE WHEN NOT inside THEN '' ELSE substring(array_to_string(ps, ' '), 1, 500) END AS body
FROM p JOIN t USING (page_id)""")
def container_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of the body's element only, which holds other elements; every third page has none."""
    inside = F.replace(F.replace("html", F.lit("<article>"), F.lit('<div id="b" class="x articleText"><div class="in">n</div>')),
                       F.lit("</article>"), F.lit("</div>"))
    html = F.concat(F.when(F.col("page_id") % 3 != 0, inside).otherwise(F.col("html")), F.lit("<p>foot</p>"))
    pages = V.table(spark, sf, "pages").withColumn("html", html)
    short = P.extract_articles(pages.withColumn("whole", F.col("html")), container="div.articleText").withColumnRenamed("whole", "html")
    body = P.extract_articles(short.select("page_id", "html", F.struct("title", "summary").alias("short")), True, "div.articleText")
    return body.select("page_id", "short.*", F.col("summary").alias("body"))


_LETTERS = lambda c: _clean(f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}} ]', ' ', 'g')")


@register(f"""WITH {COMPANIES},
f AS (SELECT doc_id AS page_id, 'T' || (doc_id % 25) AS ticker, {_LETTERS("split_part(text, chr(10), 1)")} AS title,
             {_LETTERS('text')} AS summary FROM documents)
SELECT page_id, ticker, title, summary, 'https://example.com/n/' || page_id AS link FROM f JOIN companies USING (ticker)
WHERE contains(lower(title || ' ' || summary), lower(ticker)) OR contains(lower(title || ' ' || summary), word)
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY page_id) <= 80""")
def topic_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A listing page with one block per article; the first eighty matching blocks of each company."""
    plain = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N} ]", " ")
    html = F.concat(
        F.lit('<div class="contentD"><h2><a href="/n/'), "id", F.lit('">'), plain("title"), F.lit("</a></h2><p>"),
        plain("summary"), F.lit("</p></div>"))
    pages = V.news(spark, sf).select(
        F.col("id").alias("page_id"), F.lit("https://example.com/topic/x").alias("url"), html.alias("html"), "ticker",
        F.col("ticker").alias("topic"), F.lit(0).alias("topic_idx"), F.col("id").alias("page"))
    rows = P.extract_topic_blocks(pages, companies(spark, sf).select("ticker", "keywords"))
    return rows.select("page_id", "ticker", "title", "summary", "link")


_KEYWORDS = " ".join(
    f"WHEN 'T{i}' THEN {sql_any(words)}" for i, words in enumerate(TICKER_KEYWORDS.values()))


@register(f"""WITH {NEWS} SELECT id, ticker FROM txt WHERE CASE ticker {_KEYWORDS} ELSE FALSE END""")
def keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with a keyword of their ticker; the dictionary's tickers are numbered like the given ones."""
    words = spark.createDataFrame(
        [(f"T{i}", w) for i, w in enumerate(TICKER_KEYWORDS.values())], "ticker string, keywords array<string>")
    return N.keep_relevant(V.news(spark, sf), words).select("id", "ticker")


@register(f"""WITH {COMPANIES},
p AS (SELECT page_id, 'T' || (page_id % 25) AS ticker,
             {_clean("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
             array_to_string({_PARAS}, ' ') AS body FROM pages)
SELECT page_id, ticker, title, substring(body, 1, 500) AS summary FROM p JOIN companies USING (ticker)
WHERE title <> '' AND (contains(lower(title || ' ' || substring(body, 1, 300)), lower(ticker))
                       OR contains(lower(title || ' ' || substring(body, 1, 300)), word))
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY page_id) <= 10""")
def company_pages(spark: SparkSession, sf: str) -> DataFrame:
    """First ten article pages of each company with a keyword in title or opening."""
    pages = V.table(spark, sf, "pages").withColumn("ticker", F.concat(F.lit("T"), F.col("page_id") % 25))
    hits = P.matching_articles(
        P.extract_articles(pages, whole_body=True).join(companies(spark, sf).select("ticker", "keywords"), "ticker"),
        "keywords")
    return N.cap_per_key(hits, "ticker", 10, [F.asc("page_id")]).select("page_id", "ticker", "title", "summary")


def _quote_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One quote page per daily bar, built from the bar's own numbers."""
    bars = V.eod(spark, sf)
    row = lambda label, c: F.concat(F.lit(f"<tr><td>{label}</td><td>"), c.cast("string"), F.lit("</td></tr>"))
    html = F.concat(
        F.lit("<html><head><title>"), "symbol", F.lit(" Corp (X) Quote</title></head><body><table>"),
        row("Previous Close", F.col("open")), row("Open", F.col("open")),
        row("Day's Range", F.concat(F.col("low").cast("string"), F.lit(" - "), F.col("high").cast("string"))),
        F.lit("</table><ul><li><span>Market Cap (intraday)</span><span>"), F.col("volume").cast("string"),
        F.lit('M</span></li></ul><fin-streamer data-symbol="'), F.upper("symbol"),
        F.lit('" data-field="regularMarketPrice" value="'), F.col("close").cast("string"), F.lit('">x</fin-streamer>'),
        F.lit('<fin-streamer data-field="regularMarketVolume">'), F.col("volume").cast("string"),
        F.lit("</fin-streamer></body></html>"))
    return bars.select(F.concat_ws("/", "symbol", "date").alias("page_id"), "symbol", html.alias("html"))


@register(f"""WITH {EOD}
SELECT symbol || '/' || CAST(date AS VARCHAR) AS page_id, upper(symbol) AS symbol, symbol || ' Corp' AS name,
       close AS current_price, CAST(volume AS DOUBLE) AS volume, open AS previous_close, open,
       low AS day_low, high AS day_high, volume * 1e6 AS market_cap, TRUE AS is_up, CAST(0 AS DOUBLE) AS bid
FROM eod""")
def quote_pages(spark: SparkSession, sf: str) -> DataFrame:
    quotes = M.shape_quote(P.extract_quotes(_quote_pages(spark, sf)))
    return quotes.select("page_id", "symbol", "name", "current_price", "volume", "previous_close", "open",
                         "day_low", "day_high", "market_cap", "is_up", "bid")


@register(f"""WITH {EOD}
SELECT date_part('year', date) AS page_id, symbol, symbol || ' Corp' AS name, close AS current_price, volume * 1e6 AS volume,
       close - open AS change, close >= open AS is_up FROM eod""")
def active_table(spark: SparkSession, sf: str) -> DataFrame:
    """A listing page per symbol and year with one table row per bar, parsed back."""
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    change = F.col("close") - F.col("open")
    line = F.concat(
        F.lit("<tr>"), cell(F.col("symbol")), cell(F.concat("symbol", F.lit(" Corp"))), cell(F.lit("")),
        cell(F.concat(F.col("close").cast("string"), F.lit(" +x"))), cell(change), cell(F.lit("0%")),
        cell(F.concat(F.col("volume").cast("string"), F.lit("M"))), cell(F.lit("--")), cell(F.lit("1B")), F.lit("</tr>"))
    year = F.year("date").cast("bigint")
    pages = V.eod(spark, sf).groupBy(year.alias("page_id"), "symbol").agg(
        F.concat(F.lit("<table><tbody>"), F.array_join(F.collect_list(line), ""), F.lit("</tbody></table>")).alias("html"))
    return P.extract_active_table(pages).select("page_id", "symbol", "name", "current_price", "volume", "change", "is_up")


@register(f"""WITH {QUOTES}
SELECT symbol, 'Corp ' || symbol AS name, current_price, coalesce(change, 0) AS change, volume, 'N/A' AS exchange,
       coalesce(change, 0) >= 0 AS is_up FROM quotes""")
def screener_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One screener response per symbol, written as JSON text and normalized."""
    quote = F.struct(
        "symbol", F.lit("").alias("shortName"), F.concat(F.lit("Corp "), "symbol").alias("longName"),
        F.col("current_price").alias("regularMarketPrice"), F.col("change").alias("regularMarketChange"),
        F.col("volume").alias("regularMarketVolume"))
    result = F.struct(F.array(F.struct(F.array(quote).alias("quotes"))).alias("result"))
    responses = _quotes(spark, sf).select(F.to_json(F.struct(result.alias("finance"))).alias("body"))
    rows = screeners.normalize_screener(responses, F.lit(ASOF).cast("timestamp"))
    return rows.select("symbol", "name", "current_price", "change", "volume", "exchange", "is_up")


@register("""
WITH s AS (SELECT o_custkey AS page_id, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)
SELECT page_id, regexp_extract(p, '[A-Z]+') AS symbol FROM s""")
def symbol_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Order priorities of each customer as tagged symbols of one page; first-seen distinct."""
    tag = F.concat(F.lit('<a data-symbol="'), F.regexp_extract("o_orderpriority", "[A-Z]+", 0), F.lit('">x</a>'))
    once = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("page_id"), "o_orderpriority").agg(
        F.min("o_orderkey").alias("k"))
    pages = once.withColumn("tag", tag).groupBy("page_id").agg(
        F.array_join(F.sort_array(F.collect_list("tag")), "").alias("html"))
    return P.extract_symbols(pages).select("page_id", "symbol")


@register("""
WITH s AS (SELECT o_custkey AS page_id, regexp_extract(o_orderpriority, '[A-Z]+') AS symbol, min(o_orderkey) AS k
           FROM orders GROUP BY 1, 2)
SELECT page_id, symbol, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS pos FROM s""")
def symbol_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The Symbol column of the third table of a page, which has rows of other texts too."""
    rows = V.table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("page_id"), F.regexp_extract("o_orderpriority", "[A-Z]+", 0).alias("symbol")).agg(
            F.min("o_orderkey").alias("k"))
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "symbol"))), lambda r: F.concat(
        F.lit("<tr><td>1</td><td><b>"), r["symbol"], F.lit("</b></td></tr><tr><td>2</td><td>3-X</td></tr>"))), "")
    other = "<table><tr><th>Rank</th></tr><tr><td>ABC</td></tr></table><table><tr><th>Symbol</th></tr><tr><td>1-A</td></tr></table>"
    html = F.concat(F.lit(other + "<table><tr><th>#</th><th>Symbol</th></tr>"), cells, F.lit("</table>"))
    return P.extract_symbols(rows.groupBy("page_id").agg(html.alias("html"))).select("page_id", "symbol", "pos")


@register(f"""WITH {EOD}
SELECT symbol, CAST(date AS VARCHAR) AS date, open, high, low, close, volume FROM eod
WHERE date >= DATE '{ASOF}' - 365""")
def candle_files(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars written as candle documents per symbol and year, read back and cut to 365 days."""
    path = shared_dir(spark, "candles")
    bar = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "volume")
    docs = V.eod(spark, sf).groupBy("symbol", F.year("date").alias("y")).agg(F.collect_list(bar).alias("historical"))
    docs.select("symbol", "historical").write.json(path)
    rows = candles.read_candles(spark, path, 365, F.lit(ASOF).cast("timestamp"), multi_line=False)
    return rows.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register("""
SELECT 'T' || (doc_id % 25) AS ticker, '' AS company, source, split_part(text, chr(10), 1) AS title, text AS summary,
       '' AS published, source || '/' || doc_id AS url, '' AS scraped_at FROM documents""")
def news_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Articles written to CSV with missing columns, read back in the fixed column order."""
    path = shared_dir(spark, "news-csv")
    news_files.write_news_csv(V.news(spark, sf).select("ticker", "source", "title", "summary", "url"), path)
    return news_files.read_news_csv(spark, path)


@register(f"""
WITH f AS (SELECT doc_id AS id, {_clean("split_part(text, chr(10), 1)")} AS title, {_clean('text')} AS body,
                  DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS d, source FROM documents)
SELECT id, title, CASE WHEN length(body) < 20 THEN title ELSE body END AS summary,
       strftime(d, '%Y-%m-%d 00:00:00') AS published, source FROM f WHERE d >= DATE '2024-01-20' - 14""")
def feed_entries(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("published").cast("timestamp")
    items = V.news(spark, sf).select(
        "id", "title", "summary", F.when(F.col("id") % 2 == 0, day).alias("published"), day.alias("updated"),
        F.col("source").alias("feed_title"))
    return news_files.feed_entries(items, F.lit("2024-01-20").cast("timestamp"), 14)


@register(f"""
SELECT 'T' || (doc_id % 25) AS ticker, regexp_extract(source, '\\d+') AS feed,
       {_clean("regexp_replace(split_part(text, chr(10), 1), '[^\\p{L}\\p{N} ]', ' ', 'g')")} AS title,
       CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS VARCHAR) AS published
FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 40""")
def feed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Articles written as one RSS file per source, read back: the first forty items of each."""
    path = shared_dir(spark, "feeds")
    plain = clean_markup(F.regexp_replace("title", r"[^\p{L}\p{N} ]", " "))
    items = V.news(spark, sf).select(
        F.regexp_extract("source", r"\d+", 0).alias("feed"), "id", plain.alias("title"),
        F.concat(F.lit("https://example.com/"), "ticker").alias("link"),
        F.date_format("published", "EEE, d MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"))
    ordered = items.repartition("feed").sortWithinPartitions("feed", "id").drop("id")
    ordered.write.format("xml").option("rowTag", "item").option("rootTag", "channel").partitionBy("feed").save(path)
    rows = news_files.read_feed_items(spark, f"{path}/*/*.xml")
    return rows.select(
        F.regexp_extract("link", "[^/]+$", 0).alias("ticker"),
        F.regexp_extract("feed", r"feed=(\d+)", 1).alias("feed"), F.coalesce("title", F.lit("")).alias("title"),
        F.date_format("published", "yyyy-MM-dd").alias("published"))


@register("""
SELECT doc_id AS id, strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d')
       || CASE doc_id % 3 WHEN 0 THEN ' 23:56' WHEN 1 THEN ' 00:00' ELSE ' 08:05' END AS parsed FROM documents""")
def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Article days printed in three styles of date text and parsed back."""
    day = V.news(spark, sf).select("id", F.col("published").cast("timestamp").alias("d"))
    style = F.when(F.col("id") % 3 == 0, F.concat(F.date_format("d", "d MMM, yyyy"), F.lit(", 11:56 PM IST"))).when(
        F.col("id") % 3 == 1, F.date_format("d", "yyyy-MM-dd")).otherwise(
        F.date_format("d", "EEE, d MMM yyyy '08:05:00 GMT'"))
    return day.select("id", F.date_format(labels.parse_date(style), "yyyy-MM-dd HH:mm").alias("parsed"))


PLAN = f"""{TA},
p AS (SELECT *, current_price > sma_200 AS up, current_price > sma_20 AS above FROM snap),
s AS (SELECT *, CASE WHEN up THEN 20 ELSE 0 END + CASE WHEN macd > macd_signal THEN 20 ELSE 0 END
           + CASE WHEN rsi > 40 AND rsi < 60 THEN 10 WHEN rsi < 30 THEN 15 ELSE 0 END AS score FROM p),
b AS (SELECT *, least(greatest(score, 10), 80) + 10 AS bull FROM s),
plan AS (SELECT symbol,
  CASE WHEN NOT above THEN 'Break below $' || CAST(round(current_price * 0.98, 2) AS VARCHAR)
       WHEN rsi < 35 THEN 'Limit Buy at $' || CAST(current_price AS VARCHAR) ELSE 'Wait' END AS entry,
  CASE WHEN NOT above THEN CAST(round(current_price * 1.02, 2) AS VARCHAR)
       WHEN rsi < 35 THEN CAST(round(current_price * 0.96, 2) AS VARCHAR) ELSE 'N/A' END AS stop_loss,
  CASE WHEN NOT above THEN CAST(round(current_price * 0.94, 2) AS VARCHAR)
       WHEN rsi < 35 THEN CAST(sma_20 AS VARCHAR) ELSE 'N/A' END AS take_profit,
  CASE WHEN NOT above THEN 'Sell / Avoid' WHEN rsi < 35 THEN 'Buy Dip' ELSE 'Weak Sell / Avoid' END AS signal,
  CASE WHEN above THEN 'Bullish' ELSE 'Bearish/Consolidation' END || ' within '
    || CASE WHEN up THEN 'Uptrend' ELSE 'Downtrend' END AS trend_status,
  CASE WHEN up AND rsi < 40 THEN 'ACCUMULATE' ELSE 'WAIT / HOLD' END AS conservative,
  CAST(round_even(bull * 0.75, 0) AS INTEGER) AS bull_case,
  CAST(round_even((100 - bull) * 0.75, 0) AS INTEGER) AS bear_case, 25 AS neutral_case,
  printf('%.2f', rsi) || '|' || printf('%.2f / %.2f', macd, macd_signal) || '|' || printf('$%.2f', sma_200) || '|'
    || printf('$%.2f', sma_20) AS readings,
  CASE WHEN rsi < 30 THEN 'Oversold (Buy Signal)' WHEN rsi < 45 THEN 'Approaching Oversold'
       WHEN rsi > 70 THEN 'Overbought (Sell Signal)' WHEN rsi > 55 THEN 'Momentum Building' ELSE 'Neutral' END
    || '|' || CASE WHEN macd > macd_signal THEN 'Bullish Cross' ELSE 'Bearish Cross' END
    || '|' || CASE WHEN up THEN 'Long-term Support' ELSE 'Long-term Resistance' END
    || '|' || CASE WHEN above THEN 'Immediate Support' ELSE 'Immediate Resistance' END AS readings_mean FROM b)"""


@register(f"WITH RECURSIVE {PLAN} SELECT * FROM plan")
def trade_plan(spark: SparkSession, sf: str) -> DataFrame:
    plans = strategy.trade_plan(I.latest_snapshot(stored(V.eod(spark, sf), "eod")))
    joined = lambda field: F.array_join(F.transform("technical_table", lambda r: r[field]), "|")
    return plans.select(
        "symbol", "entry", "stop_loss", "take_profit", "signal", "trend_status",
        F.col("scenarios.conservative.action").alias("conservative"), "bull_case", "bear_case", "neutral_case",
        joined("reading").alias("readings"), joined("interpretation").alias("readings_mean"))


# The given articles' tickers T0 to T24 stand for the 25 brands.
_BRAND = "'Brand#' || (CAST(substring(ticker, 2) AS INTEGER) // 5 + 1) || (CAST(substring(ticker, 2) AS INTEGER) % 5 + 1)"
INSIGHTS = f"""WITH RECURSIVE {PLAN},
notes AS (SELECT {_BRAND} AS symbol, context FROM ({ORACLE["note_context"]})),
counts AS (SELECT {_BRAND} AS symbol, count(*) AS c FROM (SELECT 'T' || (doc_id % 25) AS ticker FROM documents) GROUP BY 1),
funds AS (SELECT p_brand AS symbol, round(sum(p_retailprice), 2) AS market_cap, round(avg(p_size), 4) AS pe_ratio
          FROM part WHERE p_size > 0 GROUP BY 1)
SELECT symbol AS ticker, market_cap, pe_ratio, current_price, plan.signal, coalesce(c, 0) AS news_count,
       coalesce(context, 'No recent news found.') AS news_summary, 'Neutral' AS verdict
FROM (SELECT DISTINCT p_brand AS symbol FROM part) u LEFT JOIN snap USING (symbol) LEFT JOIN plan USING (symbol)
  LEFT JOIN notes USING (symbol) LEFT JOIN counts USING (symbol) LEFT JOIN funds USING (symbol)"""


def _insights(spark: SparkSession, sf: str) -> DataFrame:
    """Insight documents with all their sections, written and read back."""
    snap = I.latest_snapshot(stored(V.eod(spark, sf), "eod"))
    part = V.table(spark, sf, "part")
    universe = part.select(F.col("p_brand").alias("ticker")).distinct()
    number = F.substring("ticker", 2, 9).cast("int")
    news = V.news(spark, sf).withColumn("ticker", F.concat(
        F.lit("Brand#"), F.floor(number / 5) + 1, number % 5 + 1))
    notes = N.note_context(news).withColumnRenamed("context", "news_summary").join(
        news.groupBy("ticker").agg(F.count(F.lit(1)).alias("news_count")), "ticker")
    fundamentals = part.filter("p_size > 0").groupBy(F.col("p_brand").alias("ticker")).agg(
        F.round(F.sum("p_retailprice"), 2).alias("market_cap"), F.round(F.avg("p_size"), 4).alias("pe_ratio"))
    docs = insights.assemble_insights(
        universe, F.lit(ASOF).cast("timestamp"), fundamentals, snap.withColumnRenamed("symbol", "ticker"),
        strategy.trade_plan(snap).withColumnRenamed("symbol", "ticker"), notes)
    path = shared_dir(spark, "insights")
    sinks.write_insights(docs, path)
    return spark.read.schema(docs.schema).json(path)


def _shown(docs: DataFrame) -> DataFrame:
    return docs.select("ticker", "fundamentals.market_cap", "fundamentals.pe_ratio",
                       F.col("technicals.current_price").alias("current_price"),
                       F.col("trade_report.signal").alias("signal"), "news_count", "news_summary",
                       F.col("sentiment.verdict").alias("verdict"))


@register(INSIGHTS)
def assembled_insights(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_insights(spark, sf))


@register(f"SELECT * FROM ({INSIGHTS}) WHERE upper(ticker) = 'BRAND#13'")
def insight_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One ticker's document by a name in another letter case."""
    return _shown(sinks.lookup_insight(_insights(spark, sf), "brand#13"))
