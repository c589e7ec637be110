import datetime as dt
import json

from pyspark.sql import functions as F

from tickerloom.functions.fixed_values import FALLBACK_SYMBOLS, NEWS_COLUMNS, TICKER_KEYWORDS
from tickerloom.sources import candles, news_files as NF, pages as P, screeners, sinks


def test_candle_files(spark, tmp_path):
    bar = lambda d, c, **k: {"date": d, "open": "1", "high": 2, "low": 0.5, "close": c, **k}
    (tmp_path / "aapl.json").write_text(json.dumps([bar("2024-01-05", 1.5, volume=7), bar("2024-01-06", 0)], indent=1))
    (tmp_path / "msft.json").write_text(json.dumps({"symbol": "MSFT", "historical": [bar("2024-01-04", "3")]}))
    rows = candles.read_candles(spark, str(tmp_path), 30, F.lit("2024-01-10").cast("timestamp")).orderBy("symbol").collect()
    assert [(r["symbol"], str(r["date"]), r["close"], r["volume"]) for r in rows] == [
        ("AAPL", "2024-01-05", 1.5, 7), ("MSFT", "2024-01-04", 3.0, 0)]


def test_portfolio_tables(spark, tmp_path):
    users = spark.createDataFrame([(1, "a", None), (2, "b", 5.0)], "user_id bigint, name string, balance double")
    candles.write_portfolio_table(users, str(tmp_path / "u"), "users")
    got = {r["user_id"]: r["balance"] for r in candles.read_portfolio_table(spark, str(tmp_path / "u"), "users").collect()}
    assert got == {1: 100000.0, 2: 5.0}
    plan = candles.read_portfolio_table(spark, str(tmp_path / "u"), "users", 2)
    assert "EqualTo(user_id,2)" in plan._jdf.queryExecution().executedPlan().toString()
    snap = spark.createDataFrame([(1, dt.date(2024, 1, 31), 1.0), (1, dt.date(2024, 2, 1), 2.0)], "user_id bigint, date date, equity double")
    path = str(tmp_path / "s")
    candles.write_portfolio_table(snap, path, "snapshots")
    candles.write_portfolio_table(snap.filter("equity = 2").withColumn("equity", F.lit(3.0)), path, "snapshots")
    rows = candles.read_portfolio_table(spark, path, "snapshots").orderBy("date").collect()
    assert [r["equity"] for r in rows] == [1.0, 3.0]


def test_news_csv(spark, tmp_path):
    df = spark.createDataFrame([("T", "a \"quoted\", text\nnext line", None)], "ticker string, summary string, url string")
    NF.write_news_csv(df, str(tmp_path / "n"))
    row = NF.read_news_csv(spark, str(tmp_path / "n")).first()
    assert list(row.asDict()) == NEWS_COLUMNS
    assert row["summary"] == "a \"quoted\", text\nnext line" and row["url"] == "" and row["company"] == ""


FEED = """<?xml version="1.0"?><rss><channel><title>Feed</title>
<item><title>One &amp; two</title><link>http://a/1</link><pubDate>Fri, 19 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>No date</title><link>http://a/2</link></item>
<item><title>Old</title><link>http://a/3</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>Long one</title><link>http://a/4</link><updated>2024-01-18T01:02:03Z</updated>
<description>&lt;p&gt;a summary that is long&amp;nbsp;enough&lt;/p&gt;</description></item>
</channel></rss>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    items = NF.read_feed_items(spark, str(tmp_path / "f.xml"))
    assert [r["title"] for r in items.orderBy("pos").collect()] == ["One & two", "No date", "Old", "Long one"]
    assert NF.read_feed_items(spark, str(tmp_path / "f.xml"), 2).count() == 2
    rows = NF.feed_entries(items, F.lit("2024-01-20").cast("timestamp"), 14).orderBy("pos").collect()
    assert [(r["title"], r["summary"], r["published"], r["source"]) for r in rows] == [
        ("One & two", "One & two", "2024-01-19 10:00:00", "Unknown"),
        ("Long one", "a summary that is long enough", "2024-01-18 01:02:03", "Unknown")]


def test_ranked_news_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(NF, "DOCUMENT_ARTICLES", 3)
    rows = [(i, "T", dt.date(2024, 1, 1) if i < 8 else None, "earnings", f"s{i}", "src", i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, "id bigint, ticker string, date date, category string, summary string, source string, semantic_score double")
    path = str(tmp_path / "r")
    NF.write_ranked_news(df, path)
    assert spark.read.text(path).count() == 4
    back = NF.read_ranked_news(spark, path).filter("date IS NOT NULL").orderBy("rank").collect()
    assert [(r["rank"], r["summary"]) for r in back] == [(n, f"s{8 - n}") for n in range(1, 9)]
    keyed = tmp_path / "k.json"
    keyed.write_text(json.dumps({"T": {"x": {}, "30_day_news": {"2024-01-01": {"earnings": [
        {"summary": "a", "source": "s", "semantic_score": 0.5}, {"summary": "b", "source": "s", "semantic_score": 0.25}]}}}}, indent=2))
    got = NF.read_keyed_news(spark, str(keyed)).orderBy("rank").collect()
    assert [(r["ticker"], str(r["date"]), r["rank"], r["summary"]) for r in got] == [("T", "2024-01-01", 1, "a"), ("T", "2024-01-01", 2, "b")]


def pages(spark, html, **extra):
    names = ["page_id", "url", "html", *extra]
    return spark.createDataFrame([(1, "https://x.com/a/b?q=1", html, *extra.values())], ", ".join(
        f"{n} {'int' if n in ('page_id', 'topic_idx', 'page') else 'string'}" for n in names))


LISTING = """<a class="resultlink top" href="/s/1">AAPL stock news today and more</a><a href="/s/2">x</a>
<a class='x' href="https://o.com/articleshow/3.cms"><b>Apple</b> rises on earnings again</a>
<a href="news/one.html">A title of more than twenty chars</a><a href="news/one.html">A title of more than twenty chars</a>
<a href="/news/two.html">short</a><a class="resultlink" href="">AAPL empty link</a>"""


def test_link_rules(spark):
    page = pages(spark, LISTING, ticker="AAPL", company="Apple Inc")
    found = lambda rule, **k: [(r["link"], r["title"]) for r in P.extract_links(page, rule, "ticker", "company", **k).orderBy("pos").collect()]
    assert found(P.LINK_RULES["search_results"]) == [("https://x.com/s/1", "AAPL stock news today and more")]
    assert found(P.LINK_RULES["article_links"]) == [("https://o.com/articleshow/3.cms", "Apple rises on earnings again")]
    tags = P.LinkRule("t", contains="news/", suffix=".html", min_title=20, distinct=True, cap=30)
    assert found(tags) == [("https://x.com/a/news/one.html", "A title of more than twenty chars")]
    assert len(found(P.LinkRule("all", cap=2))) == 2
    latest = P.extract_latest_links(pages(spark, '<a class="b" href="https://c/1">x</a><a class="a" href="https://c/2">x</a><a class="a" href="/3">x</a><a class="a" href="https://c/1">x</a>'), ["a", "b"], "https://c/")
    assert [r["link"] for r in latest.orderBy("selector", "pos").collect()] == ["https://c/2", "https://c/1"]


def test_articles(spark):
    html = ('<meta name="publish-date" content="2024-01-05"><h1>Head <b>line</b></h1><time datetime="2024-01-06T00:00"></time>'
            "<p>First.</p><pre>no</pre><p class='x'>Second&nbsp;one.</p><p></p><p>Third " + "z" * 600 + "</p>")
    row = P.extract_articles(pages(spark, html)).first()
    assert (row["title"], row["summary"], row["published"]) == ("Head line", "First. Second one.", "2024-01-05")
    whole = P.extract_articles(pages(spark, html), whole_body=True).first()
    assert len(whole["summary"]) == 500 and whole["published"] == "2024-01-06T00:00"
    empty = P.extract_articles(pages(spark, "<h1>Only</h1>")).first()
    assert empty["summary"] == "Only" and empty["published"] == ""
    arts = P.extract_articles(pages(spark, html), whole_body=True)
    assert P.matching_articles(arts, ["second one"]).count() == 1 and P.matching_articles(arts, ["zebra"]).count() == 0


def test_topic_blocks(spark):
    block = lambda t, s: f'<div class="contentD x"><h2><a href="/n/{t}">{t} car</a></h2><p>{s}</p><time>5 Jan</time></div>'
    rows = [(1, "https://e.com/t", block("one", "tesla") + block("two", "none"), "TSLA", "tesla", 1, 0),
            (2, "https://e.com/t", block("three", "robotaxi"), "TSLA", "tesla", 0, 0)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, ticker string, topic string, topic_idx int, page int")
    words = spark.createDataFrame(list(TICKER_KEYWORDS.items()), "ticker string, keywords array<string>")
    got = P.extract_topic_blocks(df, words).orderBy("topic_idx").collect()
    assert [(r["title"], r["published"], r["link"]) for r in got] == [
        ("three car", "5 Jan", "https://e.com/n/three"), ("one car", "5 Jan", "https://e.com/n/one")]
    assert [r["title"] for r in P.extract_topic_blocks(df, words, cap=1).collect()] == ["three car"]


QUOTE = """<title>NVIDIA Corporation (NVDA) Stock</title><h1>x</h1>
<fin-streamer data-symbol="SPY" data-field="regularMarketPrice" value="1">1</fin-streamer>
<fin-streamer data-field="regularMarketPrice" data-symbol="NVDA" value="130.5">130.50</fin-streamer>
<fin-streamer data-symbol="NVDA" data-field="regularMarketChange">(-1.25)</fin-streamer>
<fin-streamer data-field="regularMarketVolume">1,000</fin-streamer>
<table><tr><th>Previous Close</th><td>131.75</td></tr><tr><td>Day's Range</td><td>129.00 - 1,132.50</td></tr>
<tr><td>Bid</td><td>130.4 x 100</td></tr><tr><td>Open</td><td>1</td></tr></table>
<ul><li><span>Market Cap (intraday)</span> <span>3.2T</span></li><li><p>Open</p><p>130.1</p></li>
<li><span>Forward Dividend &amp; Yield</span><span>0.04 (0.03%)</span></li><li>Ask</li></ul>"""


def test_quote_pages(spark):
    row = P.extract_quotes(pages(spark, QUOTE, symbol="nvda")).first()
    assert (row["symbol"], row["name"], row["current_price"], row["change"], row["volume"]) == (
        "NVDA", "NVIDIA Corporation", 130.5, -1.25, 1000.0)
    assert (row["previous_close"], row["open"], row["bid"], row["ask"]) == (131.75, 130.1, 130.4, 0.0)
    assert (row["day_low"], row["day_high"], row["market_cap"]) == (129.0, 1132.5, 3.2e12)
    assert (row["dividend_rate"], row["dividend_yield"], row["is_up"], row["year_range"]) == (0.04, 0.03, False, None)
    bare = P.extract_quotes(pages(spark, "<h1>Yahoo Finance Foo Inc (FOO)</h1>", symbol="FOO")).first()
    assert bare["name"] == "Foo Inc" and bare["current_price"] == 0.0
    assert P.extract_quotes(pages(spark, "", symbol="foo")).first()["name"] == "FOO"


def test_active_table_and_symbols(spark):
    cells = ["AMD", "Advanced", "", "1,150.25 +1", "-2.5", "-1.4%", "45.5M", "-", "250.1B"]
    html = "<table><tr><th>Symbol</th><th>N</th></tr><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr><tr><td>short</td></tr></table>"
    rows = P.extract_active_table(pages(spark, html)).collect()
    assert len(rows) == 1 and (rows[0]["current_price"], rows[0]["volume"], rows[0]["market_cap"], rows[0]["is_up"]) == (1150.25, 4.55e7, 2.501e11, False)
    got = lambda h, **k: [r["symbol"] for r in P.extract_symbols(pages(spark, h), **k).orderBy("pos").collect()]
    assert got("<table><tr><th>#</th><th>Symbol</th></tr><tr><td>1</td><td>AMD</td></tr><tr><td>2</td><td>B-2</td></tr></table>") == ["AMD"]
    assert got('<a data-symbol="F"><a data-symbol="T"><a data-symbol="F">') == ["F", "T"]
    assert got('<a href="/quote/KO?p=KO"><a href="/quote/XOM?p=1">', limit=1) == ["KO"]
    assert got("nothing") == [] and len(FALLBACK_SYMBOLS) == 25


def test_screener(spark, tmp_path):
    quotes = [{"symbol": "A", "shortName": "", "longName": "Long", "regularMarketPrice": 1.5, "regularMarketChange": -1, "exchange": "NMS"},
              {"symbol": "B", "marketCap": 5, "regularMarketVolume": 7}]
    (tmp_path / "s.json").write_text(json.dumps({"finance": {"result": [{"quotes": quotes}]}}, indent=1))
    rows = screeners.read_screener(spark, str(tmp_path / "s.json")).orderBy("pos").collect()
    assert [(r["symbol"], r["name"], r["current_price"], r["exchange"], r["is_up"], r["volume"]) for r in rows] == [
        ("A", "Long", 1.5, "NMS", False, 0), ("B", "", 0.0, "N/A", True, 7)]


def test_signal_csv_has_a_header(spark, tmp_path):
    df = spark.createDataFrame([("A", 2)], "ticker string, total_signals bigint")
    sinks.write_signals_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["ticker", "total_signals"]
    assert sinks.read_signals_csv(spark, str(tmp_path / "c"), "ticker string, total_signals bigint").first()["total_signals"] == 2


def test_elements_are_paired_by_depth(spark):
    html = ('<div class="a"><DIV>in</DIV>x</div></div><div class="a-b">no</div><div id="q" class="z a">open<divide>y</divide>'
            '<div class="a">last</div>')
    found = P.with_elements(pages(spark, html), "e", "div", "a").first()["e"]
    assert [e["inner"] for e in found] == [
        "<DIV>in</DIV>x", 'open<divide>y</divide><div class="a">last</div>', "last"]
    assert all(e["open"] < e["close"] for e in found)
    assert P.with_elements(pages(spark, "none</div>"), "e", "div").first()["e"] == []
    assert P.with_elements(pages(spark, None), "e", "div").first()["e"] == []


def test_links_and_paragraphs_inside_an_element(spark):
    html = ('<a href="https://c/0">0</a><div class="News"><div><a href="https://c/1">1</a></div><a href="https://c/2">2</a></div>'
            '<a class="top" href="https://c/3">3</a><a class="top" href="https://c/1">1</a>')
    rows = P.extract_latest_links(pages(spark, html), ["a.top", "div.News a"], "https://c/").orderBy("selector", "pos").collect()
    assert [(r["link"], r["selector"]) for r in rows] == [("https://c/3", 0), ("https://c/1", 0), ("https://c/2", 1)]
    html = '<h1>T</h1><p>out</p><div class="articleText"><div>x</div><p>one</p><p>two</p><p>three</p></div><p>after</p>'
    row = P.extract_articles(pages(spark, html), container="div.articleText").first()
    assert (row["summary"], row["body"]) == ("one two", "one two three")
    assert P.extract_articles(pages(spark, html), container="div.other").first()["summary"] == "out one"
    assert P.extract_articles(pages(spark, html), True, "div.other").first()["summary"] == ""


def test_symbol_column_of_any_table(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    html = (f"<table>{row('Rank')}{row('ABC')}</table><table>{row('Symbol')}{row('1')}</table>"
            f"<table>{row('#', 'Symbol')}{row('1', 'TSLA')}{row('2', 'B-1')}{row('3')}{row('4', 'F')}</table>")
    got = lambda h: [r["symbol"] for r in P.extract_symbols(pages(spark, h)).orderBy("pos").collect()]
    assert got(html) == ["TSLA", "F"]
    assert got(f"<table>{row('Rank')}</table><a data-symbol=\"XY\">") == ["XY"] and got(None) == []
