"""Daily and 30-day signals, labels and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import fixed_values as fixed
from tickerloom.functions.labels import argmax3, class_name, five_way_label, label_index, three_way_label

FEATURES = [
    "avg_sentiment_polarity", "avg_semantic_impact", "earnings_count", "analyst_count",
    "management_count", "corporate_count", "regulation_count", "general_count",
]


def _bucket() -> Column:
    """Unknown categories count as general."""
    c = F.col("category")
    return F.when(c.isin(fixed.SIGNAL_BUCKETS), c).otherwise("general")


def _counts() -> list[Column]:
    return [F.count_if(_bucket() == b).alias(f"{b}_count") for b in fixed.SIGNAL_BUCKETS]


def _means(digits: int | None, polarity: Column) -> list[Column]:
    show = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return [
        show(F.coalesce(F.avg(polarity), F.lit(0.0))).alias("avg_sentiment_polarity"),
        show(F.coalesce(F.avg("semantic_score"), F.lit(0.0))).alias("avg_semantic_impact"),
    ]


def daily_signals(articles: DataFrame, digits: int | None = 4) -> DataFrame:
    """One row per (ticker, date) of articles(ticker, date, category, polarity, semantic_score)."""
    rows = articles.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("total_signals"), *_means(digits, F.col("polarity")), *_counts())
    label = three_way_label("avg_sentiment_polarity", "avg_semantic_impact", "regulation_count")
    return rows.withColumn("daily_signal_label", label)


def company_signals(articles: DataFrame, digits: int | None = 4, polarity_digits: int = 4) -> DataFrame:
    """One row per ticker over all dates; each polarity is rounded before the mean."""
    polarity = F.round("polarity", polarity_digits)
    rows = articles.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("total_signals"), *_means(digits, polarity), *_counts())
    label = five_way_label("avg_sentiment_polarity", "avg_semantic_impact", "regulation_count")
    return rows.select(
        "ticker", "total_signals", "avg_sentiment_polarity", "avg_semantic_impact", "earnings_count",
        "analyst_count", "regulation_count", label.alias("daily_signal_label"),
    ).orderBy("ticker")


def label_distribution(signals: DataFrame, label: str = "daily_signal_label") -> DataFrame:
    return signals.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)


def daily_features(articles: DataFrame) -> DataFrame:
    """Unrounded daily features with the class number of the five-way label."""
    rows = daily_signals(articles, digits=None).drop("daily_signal_label")
    label = five_way_label("avg_sentiment_polarity", "avg_semantic_impact", "regulation_count")
    return rows.withColumn("label", label_index(label))


def confusion_matrix(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    return df.groupBy(F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class present on either side; 0 where undefined.

    ``matrix`` has one row per (y_true, y_pred), so everything after it is small.
    """
    sides = matrix.select(F.col("y_true").alias("label"), F.lit(0).alias("as_pred"), "n",
                          (F.col("y_true") == F.col("y_pred")).alias("hit")).unionByName(
        matrix.select(F.col("y_pred").alias("label"), F.lit(1).alias("as_pred"), "n",
                      (F.col("y_true") == F.col("y_pred")).alias("hit")))
    n = F.col("n")
    sums = sides.groupBy("label").agg(
        F.sum(F.when(F.col("as_pred") == 0, n).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("as_pred") == 1, n).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("as_pred") == 0) & F.col("hit"), n).otherwise(0)).alias("hits"),
    )
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    scored = sums.withColumns({"precision": p, "recall": r})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", f1).select("label", "precision", "recall", "f1", "support", "hits")


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy and macro means over the classes present on either side."""
    return class_report(matrix).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def evaluate_forecast(signals: DataFrame, forecast: DataFrame) -> DataFrame:
    """First forecast day's strongest case against the company label; tickers in both only."""
    first = forecast.groupBy("ticker").agg(
        *[F.min_by(c, "date").alias(c) for c in ("bull", "neutral", "bear")])
    rows = signals.join(first, "ticker")
    return rows.select(
        "ticker", F.col("daily_signal_label").alias("ground_truth"),
        label_index("daily_signal_label").alias("y_true"),
        argmax3("bull", "neutral", "bear").alias("y_pred"),
        class_name(argmax3("bull", "neutral", "bear")).alias("predicted_class"),
        "bull", "neutral", "bear",
    ).withColumn("correct", F.col("y_true") == F.col("y_pred"))
