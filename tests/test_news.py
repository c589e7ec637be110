import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.functions import fixed_values as fixed
from tickerloom.functions import labels, numbers, text as T
from tickerloom.operators import news as N
from tickerloom.operators.similarity import best_cosine, reference_vectors
from tickerloom.plans.blocks import number_rows


def one(spark, expr, **values):
    names = list(values)
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}"
                       for k, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(expr.alias("x")).first()["x"]


ARTICLES = "id bigint, ticker string, title string, summary string, url string, source string"


def articles(spark, rows):
    return spark.createDataFrame(rows, ARTICLES)


def test_note_categories_take_the_first_match(spark):
    pick = lambda a, b: one(spark, T.first_category(T.article_text("a", "b")), a=a, b=b)
    assert pick("Tesla Earnings Beat", "Revenue up 10%") == "Earnings & Financials"
    assert pick("New Robot Unveiled", "Optimus is here") == "Innovation / AI / Growth"
    assert pick("Zzz", "qqq") == "General"


def test_classify_counts_substrings_and_breaks_ties_by_order(spark):
    pick = lambda t: one(spark, T.classify(F.lower("t"), fixed.FEED_CATEGORIES), t=t)
    assert pick("nothing here") == "general"
    assert pick("A second look") == "regulation"  # "sec" inside "second"
    assert pick("CEO upgrade") == "analyst"       # one hit each: the earlier category
    assert pick("CEO and CFO upgrade") == "management"


def test_noise_needs_two_words(spark):
    assert one(spark, T.has_noise(F.lower("t")), t="Storm ahead") is False
    assert one(spark, T.has_noise(F.lower("t")), t="Storm and flood") is True
    assert one(spark, T.is_ownership_spam(F.lower("t")), t="Advisors BUYS x; advisors buys y") is True


def test_keys_and_cleaning(spark):
    assert one(spark, T.title_key("t"), t="Héllo, World_1! " * 9) == ("hélloworld_1" * 9)[:50]
    assert one(spark, T.slugify("t"), t=" Coca-Cola  Co. (The) ") == "coca-cola-co-the"
    assert one(spark, T.clean_markup("t"), t="<b>A&nbsp;&amp;  B</b>\n c") == "A & B c"
    a = one(spark, T.article_key("t", "u"), t="A", u="x")
    assert a == hashlib.md5(b"Ax").hexdigest()
    assert one(spark, T.article_key("t", "u", True), t="ABC", u="x") == one(spark, T.article_key("t", "u"), t="abc", u="x")
    assert sorted(one(spark, T.company_keywords("t", "n"), t="TSLA", n="Tesla Inc Motors")) == ["motors", "tesla", "tesla inc motors", "tsla"]


def test_relevance_counts_the_company_name_unless_strict(spark):
    score = lambda strict, **v: one(spark, T.relevance_score("t", "b", "c", "k", strict), **v)
    base = {"t": "Quiet day", "b": "", "c": "Apple Inc", "k": "AAPL"}
    assert score(False, **base) == 2 and score(True, **base) == 0
    assert score(True, t="AAPL shares rise on strong news", b="", c="Apple Inc", k="AAPL") == 6


def test_source_weight_takes_the_first_match(spark):
    w = lambda u, s: one(spark, T.source_weight("u", "s"), u=u, s=s)
    assert w("https://stocktwits.com/x", "Yahoo") == 3 and w("https://stocktwits.com/x", "") == 0 and w("", "Blog") == 1


def test_number_texts(spark):
    f = lambda e, t: one(spark, e, t=t)
    assert f(numbers.parse_multiplier("t"), "1.23T") == pytest.approx(1.23e12)
    assert f(numbers.parse_multiplier("t"), "45,678K") == 45678000
    assert f(numbers.parse_multiplier("t"), "N/A") == 0 and f(numbers.parse_multiplier("t"), None) == 0
    assert f(numbers.parse_volume("t"), "45,678K") == 45 and f(numbers.parse_volume("t"), "2.5M") == 2500000
    assert f(numbers.parse_float("t"), "12abc") == 12 and f(numbers.parse_float("t"), "abc") is None
    assert f(numbers.parse_range("t")[0], "12.5 - 13.75") == 12.5 and f(numbers.parse_range("t")[1], "1,012.5 - 1,013") == 1013
    assert f(numbers.parse_range("t")[0], "1 - 2 - 3") is None
    assert f(numbers.parse_dividend("t")[0], "0.96 (0.45%)") == 0.96 and f(numbers.parse_dividend("t")[1], "0.96 (0.45%)") == 0.45
    assert f(numbers.parse_dividend("t")[0], "N/A") == 0
    assert one(spark, numbers.percent_text("x"), x=0.452) == "45.2%" and f(numbers.percent_value("t"), "45.2%") == 45.2


@pytest.mark.parametrize("text, want", [
    ("27 Feb, 2026, 11:56 PM IST", "2026-02-27 23:56:00"), ("Fri, 27 Feb 2026 08:05:09 GMT", "2026-02-27 08:05:09"),
    ("Fri, 27 Feb 2026 08:05:09 +0000", "2026-02-27 08:05:09"), ("2026-02-27T08:05:09Z", "2026-02-27 08:05:09"),
    ("2026-02-27T08:05:09.123+05:30", "2026-02-27 08:05:09"), ("2026-02-27 08:05:09", "2026-02-27 08:05:09"),
    ("2026-02-27", "2026-02-27 00:00:00"), ("27 Feb, 2026, 11:56 PM", "2026-02-27 23:56:00"),
    ("yesterday", None), ("", None), (None, None)])
def test_dates_are_parsed_or_null(spark, text, want):
    assert one(spark, F.date_format(labels.parse_date("t"), "yyyy-MM-dd HH:mm:ss"), t=text) == want


def test_age_filters(spark):
    asof = F.lit("2024-03-01").cast("date")
    f = lambda e, t: one(spark, e, t=t)
    w = labels.within_days("t", asof, 30)
    assert [f(w, t) for t in ("2024-01-31", "2024-01-30", "2024-03-02", None)] == [True, False, False, True]
    r = labels.recent("t", asof, 14)
    assert [f(r, t) for t in ("2024-02-16", "2024-02-15", "2024-03-02", None)] == [True, False, True, False]


def test_first_seen_with_a_hot_key(spark):
    rows = [(i, "T", "same" if i % 3 else f"t{i}", "", "", "") for i in range(500, 0, -1)]
    kept = {r["id"] for r in N.dedup_title(articles(spark, rows)).select("id").collect()}
    first = {}
    for r in sorted(rows):
        first.setdefault(r[2], r[0])
    assert kept == set(first.values())


@pytest.mark.parametrize("spans", [1, 7, 40])
def test_rank_is_whole_and_stable_in_a_hot_group(spark, spans):
    rnd = random.Random(2)
    rows = [(i * 400_000, rnd.choice("AAAB"), None if i % 5 == 0 else "d", rnd.choice([0.0, 0.0, 0.25, 0.5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, ticker string, date string, semantic_score double")
    got = {r["id"]: r["rank"] for r in N.rank_articles(df, ["ticker", "date"], spans=spans).collect()}
    want = {}
    for key in {(r[1], r[2]) for r in rows}:
        group = sorted([r for r in rows if (r[1], r[2]) == key], key=lambda r: (-r[3], r[0]))
        want.update({r[0]: n for n, r in enumerate(group, 1)})
    assert got == want


def test_number_rows_sums_and_previous(spark):
    rows = [("a", i // 7, i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, b int, i int, v double")
    out = number_rows(df, ["k"], ["b"], [F.asc("b")], [F.asc("i")], sums={"run": F.col("v")}, lasts={"prev": ("v", "i")})
    for r in out.collect():
        assert r["idx"] == r["i"] and r["run"] == sum(range(r["i"] + 1)) and r["prev"] == (None if r["i"] == 0 else r["i"] - 1)


def brute_quotas(rows, quota, total):
    bucket = {}
    for r in rows:
        bucket.setdefault(r[2], []).append(r)
    final = [r for c in fixed.QUOTA_PRIORITY for r in bucket.get(c, [])[:quota]]
    if len(final) < total:
        final += [r for r in rows if r not in final][: total - len(final)]
    return final[:total]


@pytest.mark.parametrize("quota, total", [(2, 10), (2, 8), (1, 3), (3, 30)])
def test_quotas_equal_a_plain_loop(spark, quota, total):
    rnd = random.Random(quota * total)
    names = [*fixed.QUOTA_PRIORITY, "filing"]
    rows = [(i, rnd.choice(["T1", "T2"]), rnd.choice(names), rnd.randint(-5, 20)) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, ticker string, category string, score int")
    got = N.category_quotas(df, quota, total).orderBy("ticker", "slot").collect()
    for t in ("T1", "T2"):
        ranked = sorted([r for r in rows if r[1] == t], key=lambda r: (-r[3], r[0]))
        assert [r["id"] for r in got if r["ticker"] == t] == [r[0] for r in brute_quotas(ranked, quota, total)]


def test_scores_add_up(spark):
    df = articles(spark, [
        (1, "TSLA", "TSLA earnings beat", "Motors up", "https://www.reuters.com/a", "Reuters"),
        (2, "TSLA", "Storm and flood", "tsla llc buys shares stake", "https://blog", "Blog")])
    df = df.withColumn("keywords", F.array(F.lit("tsla"), F.lit("motors"))).withColumn("s", F.lit(0.4))
    by = {r["id"]: (r["score"], r["category"]) for r in N.score_articles(df, semantic="s").collect()}
    # 10 title + 6 company + 2*2 impact + 5 source + 4 category + 5 similarity
    assert by[1] == (34, "earnings")
    # 5 text + 0 + 0 + 1 source + 5 similarity - 8 filing - 10 noise
    assert by[2] == (-7, "filing")


def test_context_and_categories(spark):
    rows = [(i, "T", f"Earnings {i}", "", "", "") for i in range(5)] + [(9, "T", "xyz", "", "", "")]
    df = articles(spark, rows)
    text = N.note_context(df).first()["context"]
    assert text == "\n### Earnings & Financials\n- Earnings 0\n- Earnings 1\n- Earnings 2\n\n### General\n- xyz\n"
    universe = spark.createDataFrame([("T",), ("U",)], "ticker string")
    assert {r["ticker"]: r["context"] for r in N.with_context(universe, N.note_context(df)).collect()}["U"] == "No material news."
    last = N.group_by_category(df).filter("category = 'General'").first()
    assert last["category_place"] == len(fixed.NOTE_CATEGORIES) + 1 and last["place"] == 1


def test_headlines_volume_and_pivot(spark):
    df = articles(spark, [(1, "T", "The stock rallies, rallies!", "good good", "", ""), (2, "U", "Über rally x_abc", "bad", "", "")])
    words = {r["word"]: r["n"] for r in N.headline_words(df).collect()}
    assert words == {"rallies": 2, "rally": 1}
    lex = spark.createDataFrame([("good", 0.5), ("bad", -0.5)], "word string, polarity double")
    polar = N.with_polarity(df, lex, keep=("id", "ticker"))
    assert {r["id"]: r["polarity"] for r in polar.collect()} == {1: 0.5, 2: -0.5}
    assert [tuple(r) for r in N.sentiment_pivot(polar).orderBy("ticker").collect()] == [("T", 0, 1), ("U", 1, 0)]
    assert N.news_volume(df).count() == 2


def test_rank_spans_are_even_for_continuous_scores_and_an_outlying_id(spark):
    n = 20_000
    df = spark.range(n).select(
        F.when(F.col("id") == 7, F.lit(2 ** 62)).otherwise(F.col("id")).alias("id"), F.lit("A").alias("ticker"),
        F.when(F.col("id") % 11 > 0, F.rand(3)).alias("semantic_score"))
    df = spark.createDataFrame(df.collect(), df.schema)
    ranked = N.rank_articles(df, ["ticker"], spans=10)
    rows = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, n + 1))
    key = [(r["semantic_score"] is None, -(r["semantic_score"] or 0), r["id"]) for r in rows]
    assert key == sorted(key)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    path = re.search(r"[^ \[]*ranked_spans[^\],]*", str(ranked.inputFiles()[0])).group(0).rsplit("/", 1)[0].strip("'")
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * n / 10 and "Window" in plan


def test_rank_of_no_rows(spark):
    none = spark.createDataFrame([], "id bigint, ticker string, semantic_score double")
    assert N.rank_articles(none, ["ticker"]).collect() == []


def test_polarity_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "!! good ??"), (4, "good Bad other bad"), (5, "other")],
                               "id int, summary string")
    lex = spark.createDataFrame([("good", 1.0), ("bad", -0.5), ("", 9.0), (None, 9.0)], "word string, polarity double")
    got = {r["id"]: r["polarity"] for r in N.with_polarity(df, lex).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.0}
    assert N.with_polarity(df, lex.limit(0)).filter("polarity = 0").count() == 5


def test_cosine(spark):
    vec = spark.createDataFrame([(1, 0, [3.0, 4.0]), (2, 1, [0.0, 2.0]), (3, 0, [9.0, 9.0]), (4, 2, None), (5, 3, [0.0, 0.0]),
                                 (6, 3, [1.0, None]), (7, 3, [1.0]), (None, 3, [1.0, 1.0]), (8, 3, []), (3, 4, [3.0, 4.0])],
                                "id int, label int, v array<float>")
    refs = reference_vectors(vec.filter("v IS NOT NULL"), "label", "id", "v", 2)
    assert sorted(r["reference"] for r in refs.collect()) == [[0.0, 2.0], [3.0, 4.0]]
    got = {r["id"]: r["score"] for r in best_cosine(vec, refs, "id", "v").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 5: 0.0, 6: 0.0}
    alone = vec.filter("label = 0")
    assert {r["id"]: r["score"] for r in best_cosine(alone, refs, "id", "v").collect()} == {1: 1.0, 3: 0.9899}
    ids = vec.select("id").filter("id <= 4").distinct()
    assert {r["score"] for r in N.semantic_filter(ids, vec, None, "id", "v").collect()} == {1.0}
    one_ref = refs.filter("reference[0] > 0")
    assert N.semantic_filter(ids, vec, one_ref, "id", "v").filter("id = 4").first()["score"] == 0.5
    assert best_cosine(vec, refs.limit(0), "id", "v").count() == 0 and best_cosine(vec.limit(0), refs, "id", "v").count() == 0
    odd = spark.createDataFrame([(None,), ([0.0, 0.0],), ([float("nan"), 1.0],)], "reference array<double>")
    assert best_cosine(vec, odd, "id", "v").count() == 0


def test_cosine_over_many_references_in_blocks(spark):
    rnd = np.random.default_rng(5)
    own, refs = rnd.normal(size=(300, 8)), rnd.normal(size=(1000, 8))
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id long, embedding array<double>")
    table = spark.createDataFrame([(v.tolist(),) for v in refs], "reference array<double>").repartition(3)
    want = ((own / np.linalg.norm(own, axis=1)[:, None]) @ (refs / np.linalg.norm(refs, axis=1)[:, None]).T).max(axis=1)
    for block_rows, slice_blocks in ((1024, 16), (64, 2)):
        got = {r["id"]: r["score"] for r in best_cosine(
            vec, table, digits=9, block_rows=block_rows, slice_blocks=slice_blocks).collect()}
        assert len(got) == 300 and all(abs(got[i] - w) < 2e-9 for i, w in enumerate(want))
