import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import labels
from tickerloom.operators import forecast as FC
from tickerloom.operators import insights
from tickerloom.operators import signals as S
from tickerloom.operators import strategy
from tickerloom.sources import sinks

D = dt.date(2024, 1, 1)


@pytest.mark.parametrize("s, i, r, five, three", [
    (0.2, 0.35, 0, "Strong Bullish", "Bullish"), (0.2, 0.26, 0, "Bullish", "Bullish"), (0.06, 0.1, 5, "Bullish", "Bearish"),
    (-0.2, 0.4, 0, "Strong Bearish", "Bearish"), (-0.06, 0.1, 0, "Bearish", "Bearish"), (0.0, 0.9, 2, "Bearish", "Bearish"),
    (0.05, 0.3, 1, "Neutral", "Neutral"), (0.0, 0.3718, 0, "Neutral", "Neutral")])
def test_label_rules(spark, s, i, r, five, three):
    row = spark.createDataFrame([(s, i, r)], "s double, i double, r int").select(
        labels.five_way_label("s", "i", "r").alias("a"), labels.three_way_label("s", "i", "r").alias("b"),
        labels.label_index(labels.five_way_label("s", "i", "r")).alias("n")).first()
    assert (row["a"], row["b"]) == (five, three)
    assert row["n"] == (0 if "Bull" in five else 2 if "Bear" in five else 1)


def arts(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, category string, polarity double, semantic_score double")


def test_counts_add_up_and_unknown_categories_are_general(spark):
    df = arts(spark, [("A", D, "earnings", 0.5, 0.4), ("A", D, "filing", 0.1, 0.4), ("A", None, "regulation", -0.3, 0.0),
                      ("A", D, "general", 0.0, 0.4)])
    rows = S.daily_signals(df).collect()
    for r in rows:
        assert r["total_signals"] == sum(r[f"{b}_count"] for b in ("earnings", "analyst", "management", "corporate", "regulation", "general"))
    by = {r["date"]: r for r in rows}
    assert by[D]["general_count"] == 2 and by[D]["avg_sentiment_polarity"] == 0.2 and by[D]["daily_signal_label"] == "Bullish"
    company = S.company_signals(df).first()
    assert company["total_signals"] == 4 and company["daily_signal_label"] == "Bullish"
    assert S.label_distribution(S.daily_signals(df)).collect()[0]["n"] == 1
    assert S.label_distribution(S.company_signals(df)).collect()[0].asDict() == {"daily_signal_label": "Bullish", "n": 1}


def test_metrics_with_an_absent_class(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] * 1 + [(2, 0)] * 2
    m = S.confusion_matrix(spark.createDataFrame(pairs, "y_true int, y_pred int"))
    report = {r["label"]: r for r in S.class_report(m).collect()}
    assert report[1]["recall"] == 0 and report[1]["precision"] == 0 and report[1]["support"] == 0
    assert report[0]["precision"] == pytest.approx(3 / 5) and report[0]["recall"] == 0.75
    total = S.classification_metrics(m).first()
    assert total["accuracy"] == 0.5 and total["recall_macro"] == pytest.approx(0.25)
    f1 = 2 * 0.6 * 0.75 / 1.35
    assert total["f1_macro"] == pytest.approx(f1 / 3)


def features(spark, n, ticker="A", mood=0.1):
    rows = [(ticker, D + dt.timedelta(days=i), 1, mood, 0.1 * i, i, 0, 0, 0, 0, 1, i % 3) for i in range(n)]
    return spark.createDataFrame(
        rows, "ticker string, date date, total_signals int, avg_sentiment_polarity double, avg_semantic_impact double, "
              "earnings_count int, analyst_count int, management_count int, corporate_count int, regulation_count int, "
              "general_count int, label int")


def test_sequences_and_their_scaling(spark):
    df = features(spark, 10)
    seq = FC.make_sequences(df).orderBy("date").collect()
    assert len(seq) == 3 and seq[0]["y"] == 7 % 3 and [v[2] for v in seq[0]["x"]] == [0, 1, 2, 3, 4, 5, 6]
    train = FC.feature_maxima(df, training=True).first()
    frame = FC.feature_maxima(df).first()
    assert train["max_earnings_count"] == 8 and frame["max_earnings_count"] == 9
    x = FC.training_sequences(df).orderBy("date").first()["x"]
    assert x[6][2] == pytest.approx(6 / (8 + 1e-8))


def test_windows_roll_forward_over_zero_rows(spark):
    rows = FC.inference_windows(features(spark, 9)).orderBy("date").collect()
    assert [r["date"] for r in rows] == [D + dt.timedelta(days=8 + i) for i in (1, 2, 3)]
    earnings = [[round(v[1 + 1] * 8) for v in r["x"]] for r in rows]
    assert earnings == [[2, 3, 4, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8, 0], [4, 5, 6, 7, 8, 0, 0]]


def test_fallback_and_model(spark):
    today = F.lit("2024-06-01").cast("date")
    for mood, bull in ((0.1, 0.6), (-0.1, 0.1), (0.0, 0.3)):
        rows = FC.fallback_forecast(features(spark, 7, mood=mood), today).orderBy("date").collect()
        assert len(rows) == 3 and rows[0]["bull"] == bull and rows[0]["date"] == D + dt.timedelta(days=7)
    none = FC.fallback_forecast(features(spark, 8), today, universe=spark.createDataFrame([("Z",)], "ticker string"))
    assert [str(r["date"]) for r in none.orderBy("date").collect()] == ["2024-06-02", "2024-06-03", "2024-06-04"]
    both = features(spark, 12).unionByName(features(spark, 3, "B"))
    out = FC.forecast(both, today, max_iter=3)
    assert {r["ticker"]: r["count"] for r in out.groupBy("ticker").count().collect()} == {"A": 3, "B": 3}
    for r in out.collect():
        assert r["bull"] + r["neutral"] + r["bear"] == pytest.approx(1)


def test_forecast_computes_its_features_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    once = features(spark, 12).withColumn("label", F.udf(seen, "int")("label"))
    assert FC.forecast(once, F.lit("2024-06-01").cast("date"), max_iter=2).count() == 3
    assert calls.value == 12


def test_evaluation_wide_table_and_files(spark, tmp_path):
    fc = spark.createDataFrame([("A", D, 0.452, 0.267, 0.281), ("A", D + dt.timedelta(days=1), 0.1, 0.1, 0.8), ("B", D, 0.3, 0.4, 0.3)],
                               "ticker string, date date, bull double, neutral double, bear double")
    sig = spark.createDataFrame([("A", "Strong Bullish"), ("B", "Bearish"), ("C", "Neutral")], "ticker string, daily_signal_label string")
    rows = {r["ticker"]: r for r in S.evaluate_forecast(sig, fc).collect()}
    assert set(rows) == {"A", "B"} and rows["A"]["correct"] and rows["B"]["predicted_class"] == "Neutral"
    wide = {r["ticker"]: r for r in FC.forecast_wide(fc).collect()}
    assert wide["A"]["day_1"] == "2024-01-01: B=45.2% N=26.7% Br=28.1%" and wide["B"]["day_2"] == "-"
    path = str(tmp_path / "fc")
    sinks.write_forecast(fc, path)
    back = sinks.read_forecast(spark, path).filter("ticker = 'A'").orderBy("date").first()
    assert back["bull"] == pytest.approx(0.452)
    quotes = spark.createDataFrame([("A",), ("Z",)], "symbol string")
    joined = {r["symbol"]: r["forecast_3day"] for r in insights.join_forecast(quotes, sinks.forecast_map(fc)).collect()}
    assert joined["A"]["2024-01-01"]["bull_case"] == "45.2%" and joined["Z"] == {}


TECH = "symbol string, current_price double, rsi double, macd double, macd_signal double, sma_20 double, sma_200 double"


def plan(spark, *row, **extra):
    df = spark.createDataFrame([("A", *row)], TECH)
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return strategy.trade_plan(df).first()


def test_trade_plans(spark):
    low = plan(spark, 100.0, 50.0, 1.0, 0.5, 110.0, 90.0)
    assert (low["entry"], low["stop_loss"], low["take_profit"]) == ("Break below $98.0", "102.0", "94.0")
    assert low["signal"] == "Sell / Avoid" and low["trend_status"] == "Bearish/Consolidation within Uptrend"
    # 20 + 20 + 10 = 50 -> 60 * .75 = 45, 40 * .75 = 30
    assert (low["bull_case"], low["bear_case"], low["neutral_case"]) == (45, 30, 25)
    dip = plan(spark, 100.0, 34.0, 0.0, 0.5, 95.0, 90.0)
    assert (dip["entry"], dip["stop_loss"], dip["take_profit"], dip["signal"]) == ("Limit Buy at $100.0", "96.0", "95.0", "Buy Dip")
    assert dip["scenarios"]["conservative"]["action"] == "ACCUMULATE"
    wait = plan(spark, 100.0, 60.0, 0.0, 0.5, 95.0, 120.0, pe_ratio=80.0)
    assert (wait["entry"], wait["stop_loss"], wait["signal"]) == ("Wait", "N/A", "Weak Sell / Avoid")
    assert wait["scenarios"]["conservative"]["reason"].endswith("(Growth Premium).") and wait["scenarios"]["swing"]["setup"] is None
    # score 0 -> clamp 10 -> 20 * .75 = 15, 80 * .75 = 60
    assert (wait["bull_case"], wait["bear_case"]) == (15, 60)
    mood = plan(spark, 100.0, 25.0, 1.0, 0.5, 110.0, 90.0, sentiment=0.2)
    # 20 + 20 + 15 + 20 = 75 -> 85 * .75 = 63.75, 15 * .75 = 11.25
    assert (mood["bull_case"], mood["bear_case"]) == (64, 11)
    assert [r["interpretation"] for r in low["technical_table"]] == ["Neutral", "Bullish Cross", "Long-term Support", "Immediate Resistance"]
    assert plan(spark, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)["signal"] == "Neutral (No Data)"


def test_insights_keep_other_sections(spark, tmp_path):
    universe = spark.createDataFrame([("A",), ("B",)], "ticker string")
    fund = spark.createDataFrame([("A", 1.0)], "ticker string, pe_ratio double")
    news = spark.createDataFrame([("B", 2, "note")], "ticker string, news_count bigint, news_summary string")
    docs = insights.assemble_insights(universe, F.lit("2024-01-02").cast("timestamp"), fund, None, None, news)
    path = str(tmp_path / "ins")
    sinks.write_insights(docs, path)
    sinks.write_insights(docs.filter("ticker = 'A'"), path)
    back = spark.read.schema(docs.schema).json(path)
    assert sinks.lookup_insight(back, "a").first()["fundamentals"]["pe_ratio"] == 1.0
    assert sinks.lookup_insight(back, "nope").count() == 0 and back.count() == 1
    b = docs.filter("ticker = 'B'").first()
    assert b["fundamentals"] is None and b["news_count"] == 2
    assert docs.filter("ticker = 'A'").first()["news_summary"] == "No recent news found."
