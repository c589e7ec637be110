"""Registered queries over daily features and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import fixed_values as fixed
from tickerloom.functions import text as T
from tickerloom.operators import forecast as FC
from tickerloom.operators import insights, news as N
from tickerloom.operators import signals as S
from tickerloom.plans import views as V
from tickerloom.plans.news_queries import (
    _BUCKETS, NEWS, REFS, SIGNAL, _signal_articles, _with_semantic, lexicon, sql_classify, sql_five, sql_polarity,
)
from tickerloom.plans.registry import register
from tickerloom.plans.stored import stored
from tickerloom.session import shared_dir
from tickerloom.sources import news_files, sinks


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Articles whose ticker changes every thirty documents, so that tickers have thirty days."""
    rows = V.news(spark, sf).withColumn("ticker", F.concat(F.lit("B"), F.floor(F.col("id") / 30) % 25))
    rows = rows.withColumn("t", T.article_text()).withColumn("category", T.classify("t", fixed.NEWS_CATEGORIES))
    polar = N.with_polarity(rows, lexicon(spark), "summary", ("id", "ticker", "published", "category"))
    return _with_semantic(spark, sf, polar.withColumnRenamed("published", "date"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return S.daily_features(_blocks(spark, sf))


_INDEX = lambda label: f"CASE WHEN {label} LIKE '%Bullish' THEN 0 WHEN {label} LIKE '%Bearish' THEN 2 ELSE 1 END"

FEATURES = f"""{NEWS}, {REFS}, {sql_polarity('summary')},
art AS (SELECT txt.id, 'B' || ((txt.id // 30) % 25) AS ticker, published AS date,
               {sql_classify(fixed.NEWS_CATEGORIES)} AS category, polarity, coalesce(s, 0) AS semantic
        FROM txt JOIN pol ON txt.id = pol.id LEFT JOIN sem ON txt.id = vec_id),
feat0 AS (SELECT ticker, date, count(*) AS total_signals, avg(polarity) AS avg_sentiment_polarity,
             avg(semantic) AS avg_semantic_impact, {_BUCKETS} FROM art GROUP BY 1, 2),
feat AS (SELECT *, {_INDEX(sql_five('avg_sentiment_polarity', 'avg_semantic_impact', 'regulation_count'))} AS label
         FROM feat0)"""

_LIST = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in S.FEATURES) + "]"


@register(f"""WITH {FEATURES}
SELECT ticker, CAST(date AS VARCHAR) AS date, total_signals, round(avg_sentiment_polarity, 10) AS avg_sentiment_polarity,
       round(avg_semantic_impact, 10) AS avg_semantic_impact,
       {', '.join(f'{b}_count' for b in fixed.SIGNAL_BUCKETS)}, label FROM feat""")
def daily_features(spark: SparkSession, sf: str) -> DataFrame:
    means = ("avg_sentiment_polarity", "avg_semantic_impact")
    rows = _features(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return rows.withColumns({c: F.round(c, 10) for c in means})


_W = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
_TEXT = "array_to_string(list_transform(flatten(x), lambda v: printf('%.9f', v)), ' ')"


def _sequence_text(rows: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.flatten("x"), lambda v: F.format_string("%.9f", v)), " ")
    return rows.withColumns({"date": F.date_format("date", "yyyy-MM-dd"), "x": text})


@register(f"""WITH {FEATURES},
q AS (SELECT ticker, date, list({_LIST}) {_W} AS x, label AS y FROM feat)
SELECT ticker, CAST(date AS VARCHAR) AS date, {_TEXT} AS x, y FROM q WHERE len(x) = 7""")
def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return _sequence_text(FC.make_sequences(_features(spark, sf)))


_MAX = ", ".join(f"max(abs(CAST({c} AS DOUBLE))) AS max_{c}" for c in S.FEATURES)
_SCALED = "[" + ", ".join(f"{c} / (max_{c} + 1e-8)" for c in S.FEATURES) + "]"


@register(f"""WITH {FEATURES},
back AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM feat),
mx AS (SELECT ticker, {_MAX} FROM back WHERE n > 1 GROUP BY 1),
q AS (SELECT ticker, date, list({_SCALED}) {_W} AS x, label AS y FROM feat JOIN mx USING (ticker))
SELECT ticker, CAST(date AS VARCHAR) AS date, {_TEXT} AS x, y FROM q WHERE len(x) = 7""")
def scaled_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return _sequence_text(FC.training_sequences(stored(_features(spark, sf), "features")))


@register(f"""WITH {FEATURES},
mx AS (SELECT ticker, {_MAX} FROM feat GROUP BY 1)
SELECT ticker, {', '.join(f'round(max_{c}, 10) AS max_{c}' for c in S.FEATURES)} FROM mx""")
def feature_maxima(spark: SparkSession, sf: str) -> DataFrame:
    rows = FC.feature_maxima(_features(spark, sf))
    return rows.select("ticker", *[F.round(f"max_{c}", 10).alias(f"max_{c}") for c in S.FEATURES])


@register(f"""WITH {FEATURES},
mx AS (SELECT ticker, {_MAX} FROM feat GROUP BY 1),
lasts AS (SELECT ticker, date, {_SCALED} AS v, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n
          FROM feat JOIN mx USING (ticker)),
packed AS (SELECT ticker, max(date) AS last, list(v ORDER BY n DESC) AS rows FROM lasts WHERE n <= 7 GROUP BY 1
           HAVING count(*) = 7),
steps AS (SELECT ticker, last + d AS date,
                 list_concat(rows[d:], [[0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0] FOR z IN range(1, d)]) AS x
          FROM packed, (SELECT unnest([1, 2, 3]) AS d))
SELECT ticker, strftime(date, '%Y-%m-%d') AS date, {_TEXT} AS x FROM steps""")
def roll_forward_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _sequence_text(FC.inference_windows(stored(_features(spark, sf), "features")))


FALLBACK = f"""{NEWS}, {SIGNAL},
feat AS (SELECT ticker, date, avg(polarity) AS p FROM art GROUP BY 1, 2),
m AS (SELECT ticker, count(*) AS n, avg(p) AS mood, max(date) AS last FROM feat GROUP BY 1 HAVING count(*) < 8),
forecast AS (SELECT ticker, last + d AS date,
       CASE WHEN mood > 0.05 THEN 0.6 WHEN mood < -0.05 THEN 0.1 ELSE 0.3 END AS bull,
       CASE WHEN abs(mood) > 0.05 THEN 0.3 ELSE 0.4 END AS neutral,
       CASE WHEN mood > 0.05 THEN 0.1 WHEN mood < -0.05 THEN 0.6 ELSE 0.3 END AS bear
  FROM m, (SELECT unnest([1, 2, 3]) AS d))"""


def _fallback(spark: SparkSession, sf: str) -> DataFrame:
    features = S.daily_features(_signal_articles(spark, sf))
    return FC.fallback_forecast(features, F.lit("2024-03-01").cast("date"))


@register(f"""WITH {FALLBACK}
SELECT ticker, strftime(date, '%Y-%m-%d') AS date, CAST(bull AS DOUBLE) AS bull, CAST(neutral AS DOUBLE) AS neutral,
       CAST(bear AS DOUBLE) AS bear FROM forecast""")
def fallback_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _fallback(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_CELL = ("strftime(date, '%Y-%m-%d') || printf(': B=%.1f%% N=%.1f%% Br=%.1f%%', CAST(bull * 100 AS DOUBLE), "
         "CAST(neutral * 100 AS DOUBLE), CAST(bear * 100 AS DOUBLE))")


@register(f"""WITH {FALLBACK},
r AS (SELECT ticker, {_CELL} AS cell, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM forecast)
SELECT ticker, max(cell) FILTER (n = 1) AS day_1, max(cell) FILTER (n = 2) AS day_2, max(cell) FILTER (n = 3) AS day_3
FROM r GROUP BY 1""")
def forecast_wide(spark: SparkSession, sf: str) -> DataFrame:
    return FC.forecast_wide(_fallback(spark, sf))


_EVAL = f"""{FALLBACK},
sig AS (SELECT ticker, avg(round(polarity, 4)) AS s, avg(semantic) AS i,
               count(*) FILTER (category = 'regulation') AS r FROM art GROUP BY 1),
ev AS (SELECT ticker, {sql_five('round(s, 10)', 'round(i, 10)', 'r')} AS ground_truth,
              CASE WHEN bull >= neutral AND bull >= bear THEN 0 WHEN neutral >= bear THEN 1 ELSE 2 END AS y_pred
       FROM sig JOIN forecast USING (ticker)
       QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date) = 1),
ev2 AS (SELECT *, {_INDEX('ground_truth')} AS y_true FROM ev)"""


@register(f"""WITH {_EVAL}
SELECT ticker, ground_truth, y_true, y_pred, ['Bullish', 'Neutral', 'Bearish'][y_pred + 1] AS predicted_class,
       y_true = y_pred AS correct FROM ev2""")
def forecast_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    signals = S.company_signals(_signal_articles(spark, sf), digits=10)
    return S.evaluate_forecast(signals, _fallback(spark, sf)).drop("bull", "neutral", "bear")


@register(f"""WITH {FALLBACK},
r AS (SELECT ticker, date, printf('%.1f%%', CAST(bull * 100 AS DOUBLE)) AS bull,
             row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM forecast)
SELECT p_brand AS symbol, any_value(bull) AS first_bull, CAST(count(bull) * 3 / greatest(count(*), 1) AS INTEGER) AS dates
FROM part LEFT JOIN r ON replace(p_brand, 'Brand#', 'T') = ticker AND n = 1 GROUP BY 1""")
def quote_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts written, read back and attached to every listed symbol; without one the map is empty."""
    path = shared_dir(spark, "forecast")
    sinks.write_forecast(_fallback(spark, sf), path)
    texts = sinks.forecast_map(sinks.read_forecast(spark, path)).withColumn(
        "symbol", F.replace("symbol", F.lit("T"), F.lit("Brand#")))
    listed = V.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    rows = insights.join_forecast(listed, texts)
    first = F.get(F.map_values("forecast_3day"), 0)["bull_case"]
    return rows.select("symbol", first.alias("first_bull"), F.size("forecast_3day").alias("dates"))


_RANKED = f"""WITH {NEWS}, {REFS},
c AS (SELECT id, ticker, published AS date, {sql_classify(fixed.NEWS_CATEGORIES)} AS category, summary, source,
             coalesce(s, 0) AS semantic_score FROM txt LEFT JOIN sem ON id = vec_id)
SELECT ticker, CAST(date AS VARCHAR) AS date, category, summary, source, semantic_score,
       row_number() OVER (PARTITION BY ticker, date, category ORDER BY semantic_score DESC, id) AS rank FROM c"""


def _ranked_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.news(spark, sf).withColumn("t", T.article_text()).select(
        "id", "ticker", F.col("published").alias("date"), T.classify("t", fixed.NEWS_CATEGORIES).alias("category"),
        "summary", "source")
    return _with_semantic(spark, sf, rows)


@register(_RANKED)
def ranked_news_file(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked articles written as nested documents and read back."""
    path = shared_dir(spark, "ranked-news")
    news_files.write_ranked_news(_ranked_rows(spark, sf), path)
    return news_files.read_ranked_news(spark, path).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register(_RANKED)
def keyed_news_file(spark: SparkSession, sf: str) -> DataFrame:
    """The same articles as objects keyed by ticker, with the news below the first key that says so."""
    path = shared_dir(spark, "keyed-news")
    rows = news_files.nest_ranked_news(_ranked_rows(spark, sf))
    nothing = F.map_filter("30_day_news", lambda date, news: F.lit(False))
    keyed = F.create_map("ticker", F.create_map(F.lit("about"), nothing, F.lit("30_day_news"), F.col("30_day_news")))
    docs = rows.select(F.to_json(keyed).alias("value"))
    docs.write.text(path)
    return news_files.read_keyed_news(spark, path, lines=True).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register(f"""WITH {NEWS}, {SIGNAL},
d AS (SELECT ticker, count(*) AS total_signals, round(avg(round(polarity, 4)), 10) AS avg_sentiment_polarity,
             round(avg(semantic), 10) AS avg_semantic_impact, {_BUCKETS} FROM art GROUP BY 1)
SELECT ticker, total_signals, avg_sentiment_polarity, avg_semantic_impact, earnings_count, analyst_count,
       regulation_count, {sql_five('avg_sentiment_polarity', 'avg_semantic_impact', 'regulation_count')}
       AS daily_signal_label FROM d""")
def signals_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Company signals written to CSV and read back."""
    path = shared_dir(spark, "signals")
    rows = S.company_signals(_signal_articles(spark, sf), digits=10)
    sinks.write_signals_csv(rows, path)
    return sinks.read_signals_csv(
        spark, path, "ticker string, total_signals bigint, avg_sentiment_polarity double, avg_semantic_impact double, "
                     "earnings_count bigint, analyst_count bigint, regulation_count bigint, daily_signal_label string")


@register(f"""WITH {NEWS}, {SIGNAL},
d AS (SELECT ticker, CAST(date AS VARCHAR) AS date, count(*) AS total_signals,
             round(avg(polarity), 10) AS avg_sentiment_polarity, round(avg(semantic), 10) AS avg_semantic_impact,
             {_BUCKETS} FROM art GROUP BY 1, 2)
SELECT *, CASE WHEN avg_sentiment_polarity > 0.05 AND avg_semantic_impact > 0.25 THEN 'Bullish'
               WHEN avg_sentiment_polarity < -0.05 OR regulation_count >= 2 THEN 'Bearish' ELSE 'Neutral' END
            AS daily_signal_label FROM d""")
def daily_signals_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Daily signals written to CSV and read back."""
    path = shared_dir(spark, "daily-signals")
    rows = S.daily_signals(_signal_articles(spark, sf), digits=10)
    sinks.write_signals_csv(rows, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return sinks.read_signals_csv(spark, path, schema).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register(f"""WITH {FEATURES},
m AS (SELECT ticker, count(*) AS n, avg(avg_sentiment_polarity) AS mood, max(date) AS last FROM feat GROUP BY 1)
SELECT ticker, strftime(last + d, '%Y-%m-%d') AS date, true AS shares, n >= 8 AS learned, CAST(CASE WHEN n >= 8 THEN NULL
       WHEN mood > 0.05 THEN 0.6 WHEN mood < -0.05 THEN 0.1 ELSE 0.3 END AS DOUBLE) AS fixed_bull
FROM m, (SELECT unnest([1, 2, 3]) AS d)""")
def forecast_model_shape(spark: SparkSession, sf: str) -> DataFrame:
    """What is certain of the model's forecast: its rows, shares that add up to 1, the fixed cases."""
    features = stored(_features(spark, sf), "features")
    cases = ("bull", "neutral", "bear")
    whole = F.abs(sum(F.col(c) for c in cases) - 1) < 1e-6
    for c in cases:
        whole &= F.col(c).between(0, 1)
    days = features.groupBy("ticker").agg((F.count(F.lit(1)) >= FC.LENGTH + 1).alias("learned"))
    return FC.forecast(features, F.lit("2024-03-01").cast("date")).join(days, "ticker").select(
        "ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), whole.alias("shares"), "learned",
        F.when(~F.col("learned"), F.col("bull")).alias("fixed_bull"))


@register(f"""WITH {FEATURES},
sig AS (SELECT ticker, avg(round(polarity, 4)) AS s, avg(semantic) AS i,
               count(*) FILTER (category = 'regulation') AS r FROM art GROUP BY 1),
ev AS (SELECT ticker, {sql_five('round(s, 10)', 'round(i, 10)', 'r')} AS ground_truth FROM sig)
SELECT ticker, ground_truth, {_INDEX('ground_truth')} AS y_true, true AS judged FROM ev""")
def model_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """The network's first day against each ticker's signal; only the judgement itself depends on the network."""
    articles = stored(_blocks(spark, sf), "blocks")
    cases = FC.forecast(S.daily_features(articles), F.lit("2024-03-01").cast("date"))
    rows = S.evaluate_forecast(S.company_signals(articles, digits=10), cases)
    named = F.array(*[F.lit(x) for x in ("Bullish", "Neutral", "Bearish")])
    judged = (F.get(named, F.col("y_pred")) == F.col("predicted_class")) & (
        F.col("correct") == (F.col("y_true") == F.col("y_pred")))
    return rows.select("ticker", "ground_truth", "y_true", judged.alias("judged"))


@register()
def forecast_model(spark: SparkSession, sf: str) -> DataFrame:
    """Network forecast for tickers with enough days, fixed cases for the others; no SQL form."""
    rows = FC.forecast(_features(spark, sf), F.lit("2024-03-01").cast("date"))
    return rows.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
