"""Three-day forecasts from daily features.

Feature rows are unique per (ticker, date), so a window per ticker is bounded by
the calendar.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.signals import FEATURES
from tickerloom.plans.stored import stored

LENGTH = 7
DAYS = 3
EPSILON = 1e-8


def feature_maxima(features: DataFrame, training: bool = False) -> DataFrame:
    """Largest absolute value of each feature per ticker.

    For training only rows inside a window count, which are all but the last day.
    """
    rows = features
    if training:
        w = Window.partitionBy("ticker").orderBy(F.desc("date"))
        rows = features.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") > 1)
    return rows.groupBy("ticker").agg(*[F.max(F.abs(F.col(c).cast("double"))).alias(f"max_{c}") for c in FEATURES])


def scaled(features: DataFrame, maxima: DataFrame) -> DataFrame:
    """Features divided by their ticker's maxima."""
    joined = features.join(maxima, "ticker")
    return joined.withColumns({c: F.col(c) / (F.col(f"max_{c}") + EPSILON) for c in FEATURES}).drop(
        *[f"max_{c}" for c in FEATURES])


def make_sequences(features: DataFrame, length: int = LENGTH) -> DataFrame:
    """The ``length`` rows before each day, oldest first, and that day's label."""
    w = Window.partitionBy("ticker").orderBy("date")
    row = F.array(*[F.col(c).cast("double") for c in FEATURES])
    x = F.collect_list(row).over(w.rowsBetween(-length, -1))
    return features.select("ticker", "date", x.alias("x"), F.col("label").alias("y")).filter(F.size("x") == length)


def training_sequences(features: DataFrame, length: int = LENGTH) -> DataFrame:
    """Sequences scaled by the maxima over all of the ticker's training windows."""
    return make_sequences(scaled(features, feature_maxima(features, training=True)), length)


def fallback_forecast(features: DataFrame, today: Column, length: int = LENGTH, days: int = DAYS,
                      universe: DataFrame | None = None) -> DataFrame:
    """Fixed cases from the mean sentiment for tickers with fewer than ``length + 1`` days."""
    per = features.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.avg("avg_sentiment_polarity").alias("mood"), F.max("date").alias("last"))
    if universe is not None:
        per = universe.select("ticker").join(per, "ticker", "left").fillna(0, ["n"])
    mood = F.coalesce("mood", F.lit(0.0))
    pick = lambda up, down, flat: F.when(mood > 0.05, up).when(mood < -0.05, down).otherwise(flat)
    return _dated(per.filter(F.col("n") < length + 1).select(
        "ticker", F.coalesce("last", today).alias("last"),
        pick(0.6, 0.1, 0.3).alias("bull"), pick(0.3, 0.3, 0.4).alias("neutral"), pick(0.1, 0.6, 0.3).alias("bear"),
    ), days)


def _dated(rows: DataFrame, days: int) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("d")).select(
        "ticker", F.date_add("last", F.col("d")).alias("date"), "bull", "neutral", "bear")


def inference_windows(features: DataFrame, length: int = LENGTH, days: int = DAYS) -> DataFrame:
    """The last window per ticker and its roll-forward: each later day appends an all-zero row."""
    ready = scaled(features, feature_maxima(features))
    row = F.array(*[F.col(c).cast("double") for c in FEATURES])
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    recent = ready.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= length)
    packed = recent.groupBy("ticker").agg(
        F.max("date").alias("last"),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("o"), row.alias("v")))),
                    lambda s: s["v"]).alias("rows"),
    ).filter(F.size("rows") == length)
    zero = F.array(*[F.lit(0.0) for _ in FEATURES])
    steps = packed.select("*", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("d"))
    padded = F.concat(F.slice("rows", F.col("d"), length), F.array_repeat(zero, F.col("d") - 1))
    return steps.select("ticker", F.date_add("last", F.col("d")).alias("date"), padded.alias("x"))


def _vector(x: str = "x") -> Column:
    return array_to_vector(F.flatten(x))


def fit_model(sequences: DataFrame, max_iter: int = 40, seed: int = 7) -> PipelineModel:
    """One three-class network over the windows of all tickers, trained by Spark."""
    train = sequences.select(_vector().alias("features"), F.col("y").cast("double").alias("label"))
    net = MultilayerPerceptronClassifier(
        layers=[LENGTH * len(FEATURES), 32, 16, 3], maxIter=max_iter, seed=seed, blockSize=128)
    return Pipeline(stages=[net]).fit(train)


def predict(model: PipelineModel, windows: DataFrame) -> DataFrame:
    """Long forecast table with the three cases as shares."""
    out = model.transform(windows.withColumn("features", _vector()))
    p = vector_to_array("probability")
    return out.select("ticker", "date", p[0].alias("bull"), p[1].alias("neutral"), p[2].alias("bear"))


def forecast(features: DataFrame, today: Column, max_iter: int = 40) -> DataFrame:
    """Model cases where the history is long enough, fixed cases elsewhere.

    Maxima, windows, training and fixed cases all read the features, which are written first.
    """
    features = stored(features, "features")
    model = fit_model(training_sequences(features), max_iter)
    long_enough = features.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LENGTH + 1)
    windows = inference_windows(features.join(long_enough, "ticker", "left_semi"))
    return predict(model, windows).unionByName(fallback_forecast(features, today))


def forecast_wide(rows: DataFrame, days: int = DAYS) -> DataFrame:
    """First three dates per ticker as columns of text, "-" where a date is missing."""
    w = Window.partitionBy("ticker").orderBy("date")
    cell = F.format_string(
        "%s: B=%.1f%% N=%.1f%% Br=%.1f%%", F.date_format("date", "yyyy-MM-dd"),
        *[F.round(F.col(c) * 100, 1) for c in ("bull", "neutral", "bear")])
    first = rows.select("ticker", F.row_number().over(w).alias("n"), cell.alias("cell")).filter(F.col("n") <= days)
    wide = first.groupBy("ticker").pivot("n", list(range(1, days + 1))).agg(F.first("cell"))
    return wide.select("ticker", *[F.coalesce(str(i), F.lit("-")).alias(f"day_{i}") for i in range(1, days + 1)])
