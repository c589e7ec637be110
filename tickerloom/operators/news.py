"""News: union, dedup, filters, scores, quotas, ranks and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions import fixed_values as fixed
from tickerloom.functions import text as T
from tickerloom.operators.similarity import best_cosine
from tickerloom.plans.stored import stored


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources under each other; ``source_ordinal`` keeps the order of the arguments."""
    out = None
    for i, df in enumerate(sources):
        tagged = df.withColumn("source_ordinal", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def first_seen(df: DataFrame, key: Column | Sequence[Column], ordinal: str = "id") -> DataFrame:
    """Keep the row with the lowest ``ordinal`` (unique) of each key.

    The key meets only the ordinal in the shuffle, with a partial minimum per map
    task, and the whole rows join back on the ordinal: a key shared by a third of
    all rows puts no load on a single task.
    """
    keys = [key] if isinstance(key, Column) else list(key)
    names = [f"_key{i}" for i in range(len(keys))]
    winners = df.select(*[k.alias(n) for k, n in zip(keys, names)], ordinal).groupBy(*names).agg(
        F.min(ordinal).alias(ordinal))
    return df.join(winners.select(ordinal), ordinal, "left_semi")


def dedup_md5(df: DataFrame, ordinal: str = "id", lower_title: bool = False, within: Sequence[str] = ()) -> DataFrame:
    key = T.article_key("title", "url", lower_title)
    return first_seen(df, [*[F.col(c) for c in within], key], ordinal)


def dedup_title(df: DataFrame, ordinal: str = "id", within: Sequence[str] = ()) -> DataFrame:
    return first_seen(df, [*[F.col(c) for c in within], T.title_key("title")], ordinal)


def drop_noise(df: DataFrame, words: Sequence[str] = fixed.NOISE_WORDS) -> DataFrame:
    return df.withColumn("_t", T.article_text()).filter(~T.has_noise("_t", words)).drop("_t")


def keep_relevant(df: DataFrame, companies: DataFrame) -> DataFrame:
    """Articles that mention their company; ``companies(ticker, keywords ARRAY<STRING>)``."""
    text = df.withColumn("_t", T.article_text())
    return text.join(companies.select("ticker", "keywords"), "ticker").filter(
        T.contains_any("_t", "keywords")).drop("_t")


def keep_categories(df: DataFrame, keep: Sequence[str] = fixed.KEEP_CATEGORIES) -> DataFrame:
    return df.filter(F.col("category").isin(list(keep)))


def score_articles(
    df: DataFrame,
    rules: Mapping[str, Sequence[str]] = fixed.FEED_CATEGORIES,
    weights: Mapping[str, int] = fixed.SOURCE_WEIGHTS,
    noise: Sequence[str] = fixed.NOISE_WORDS,
    impact: Sequence[str] = fixed.IMPACT_WORDS,
    semantic: str | None = None,
) -> DataFrame:
    """Add ``category`` and ``score`` to articles(ticker, title, summary, url, source, keywords)."""
    df = df.withColumns({"_title": F.lower("title"), "_t": T.article_text(), "_tick": F.lower("ticker")})
    df = df.withColumn("category", T.classify("_t", rules))
    point = lambda test, n: F.when(test, F.lit(n)).otherwise(0)
    ticker = F.when(F.contains("_title", "_tick"), 10).when(F.contains("_t", "_tick"), 5).otherwise(0)
    others = F.filter("keywords", lambda k: k != F.col("_tick"))
    company = point(T.contains_any("_t", others), 6)
    impacts = F.least(T.keyword_hits("_t", impact) * 2, F.lit(8))
    by_category = F.lit(0)
    for name, points in fixed.CATEGORY_POINTS.items():
        by_category = F.when(F.col("category") == name, F.lit(points)).otherwise(by_category)
    score = ticker + company + impacts + T.source_weight("url", "source", weights) + by_category
    if semantic is not None:
        s = F.col(semantic)
        score = score + F.when(s > 0.35, 5).when(s > 0.25, 2).when(s < 0.15, -5).otherwise(0)
    score = score - point(T.has_noise("_t", noise), 10)
    return df.withColumn("score", score).drop("_title", "_t", "_tick")


def category_quotas(df: DataFrame, quota: int = 2, total: int = 10, order: Sequence[Column] | None = None,
                    priority: Sequence[str] = fixed.QUOTA_PRIORITY, key: str = "ticker") -> DataFrame:
    """Balanced choice per ticker: up to ``quota`` of each listed category, then the best of the rest.

    Nothing below rank ``total`` of its category can be chosen, so the first rank,
    which Spark already cuts in the map tasks, leaves a few rows per ticker.
    """
    order = [F.desc("score"), F.asc("id")] if order is None else list(order)
    in_category = Window.partitionBy(key, "category").orderBy(*order)
    best = df.withColumn("category_rank", F.row_number().over(in_category)).filter(F.col("category_rank") <= total)
    names = F.array(*[F.lit(c) for c in priority])
    place = F.array_position(names, F.col("category"))
    chosen = (place > 0) & (F.col("category_rank") <= quota)
    # Quota rows come first, by category priority; the others follow in input order.
    by_slot = Window.partitionBy(key).orderBy(
        F.when(chosen, place).otherwise(len(priority) + 1), F.when(chosen, F.col("category_rank")), *order)
    return best.withColumn("slot", F.row_number().over(by_slot)).filter(F.col("slot") <= total)


def cap_per_key(df: DataFrame, key: str, cap: int, order: Sequence[Column]) -> DataFrame:
    """First ``cap`` rows of each key in input order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def top_articles(feed: DataFrame, companies: DataFrame, quota: int = 2, total: int = 8, **scoring) -> DataFrame:
    """Dedup, relevance, noise, score and quotas in the order a feed is worked through."""
    unique = dedup_title(feed, within=["ticker"])
    scored = score_articles(drop_noise(keep_relevant(unique, companies)), **scoring)
    return category_quotas(scored, quota, total)


def rank_articles(df: DataFrame, group: Sequence[str], score: str = "semantic_score", ordinal: str = "id",
                  name: str = "rank", spans: int | None = None) -> DataFrame:
    """Position of every article in its group by score descending, then input order.

    Rows are dealt by range of (group, score, ordinal), with splitters from a sample, into spans
    of about equal size whatever the scores and ordinals are, and sorted there.  A row's rank is
    its place in its span, less that of its group's first row there, plus the group's rows in the
    spans before: one small row per span that a group lies in.  Null scores come last, null
    groups are groups.  ``df`` is read twice: pass a stored table without texts and join by id.
    """
    spans = spans or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*[F.asc(g) for g in group], F.desc(score), F.asc(ordinal)]
    # The upper bits of a place are its span, the lower ones the row's number in it.
    placed = stored(df.repartitionByRange(spans, *order).sortWithinPartitions(*order).withColumn(
        "_place", F.monotonically_increasing_id()), "ranked_spans").withColumn("_span", F.shiftright("_place", 33))
    parts = placed.groupBy(*group, "_span").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        *[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], F.col("_span").alias("_s"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = [F.col("_span") == F.col("_s"), *[F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)]]
    return placed.join(shifts, same).select(
        *[F.col(c) for c in df.columns], (F.col("_place") + F.col("_shift")).alias(name))


def group_by_category(df: DataFrame, rules: Mapping[str, Sequence[str]] = fixed.NOTE_CATEGORIES,
                      key: str = "ticker", ordinal: str = "id") -> DataFrame:
    """Long form of the category lists: category, its place (General last) and the row's place in it.

    Texts are matched once into a stored table of ids, which is then ranked.
    """
    text = df.withColumn("_t", T.article_text())
    named = stored(text.select(key, ordinal, T.first_category("_t", rules).alias("category")), "categories")
    names = F.array(*[F.lit(c) for c in [*rules, "General"]])
    named = named.withColumn("category_place", F.array_position(names, F.col("category")).cast("int"))
    return rank_articles(named.withColumn("_same", F.lit(0)), [key, "category"], "_same", ordinal, "place").drop("_same")


def note_context(df: DataFrame, rules: Mapping[str, Sequence[str]] = fixed.NOTE_CATEGORIES, per_category: int = 3,
                 key: str = "ticker", ordinal: str = "id") -> DataFrame:
    """Per ticker the first titles of each category as one text; without articles a fixed sentence."""
    text = df.withColumn("_t", T.article_text())
    named = text.select(key, ordinal, "title", T.first_category("_t", rules).alias("category"))
    w = Window.partitionBy(key, "category").orderBy(ordinal)
    few = named.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_category)
    names = F.array(*[F.lit(c) for c in [*rules, "General"]])
    place = F.array_position(names, F.col("category"))
    head = F.when(F.col("_n") == 1, F.concat(F.lit("\n### "), "category", F.lit("\n"))).otherwise("")
    line = F.concat(head, F.lit("- "), F.coalesce("title", F.lit("")), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("_n").alias("n"), line.alias("line"))))
    context = F.array_join(F.transform(lines, lambda s: s["line"]), "")
    return few.groupBy(key).agg(context.alias("context"))


def with_context(universe: DataFrame, contexts: DataFrame, key: str = "ticker") -> DataFrame:
    return universe.join(contexts, key, "left").withColumn(
        "context", F.coalesce("context", F.lit("No material news.")))


def headline_words(df: DataFrame, k: int = 20, stopwords: Sequence[str] = fixed.HEADLINE_STOPWORDS) -> DataFrame:
    """Most frequent words of three or more plain letters in titles."""
    words = F.filter(
        F.split(F.lower("title"), r"[^\p{L}\p{N}_]+"),
        lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(list(stopwords)),
    )
    counts = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(k)


def news_volume(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("articles")).orderBy(F.desc("articles"), "ticker")


def with_polarity(df: DataFrame, lexicon: DataFrame, text: str = "summary", keep: Sequence[str] = ("id",)) -> DataFrame:
    """Mean lexicon polarity of the whole text per article, 0 without a known word.

    ``keep`` must identify the article.  Words outside the lexicon fall away in the join; an
    empty word, added to each article and to the lexicon without polarity, keeps the article.
    The lexicon is written first, so that Spark knows its size: below its threshold it is
    broadcast, all words of an article are met in one map task, and the partial average sends
    one row per article through the shuffle.
    """
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    tokens = df.select(*keep, F.explode(F.array_append(words, F.lit(""))).alias("word"))
    end = lexicon.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(None).cast("double").alias("polarity"))
    known = stored(lexicon.filter("word <> ''").select("word", F.col("polarity").cast("double")).unionByName(end), "lexicon")
    return tokens.join(known, "word").groupBy(*keep).agg(F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"))


def semantic_filter(df: DataFrame, vectors: DataFrame, references: DataFrame | None, id_col: str = "vec_id",
                    vector: str = "embedding", ordinal: str = "id", digits: int = 12) -> DataFrame:
    """``df`` with ``score``: cosine against the finance reference, 0.5 without a vector, 1 when the filter is off."""
    if references is None:
        return df.withColumn("score", F.lit(1.0))
    scores = best_cosine(vectors, references, id_col, vector, digits=digits).withColumnRenamed("id", ordinal)
    return df.join(scores, ordinal, "left").withColumn("score", F.coalesce("score", F.lit(0.5)))


def sentiment_pivot(df: DataFrame) -> DataFrame:
    """Articles per ticker with polarity above 0 and the others."""
    label = F.when(F.col("polarity") > 0, "Positive").otherwise("Negative")
    counts = df.withColumn("label", label).groupBy("ticker").pivot("label", ["Negative", "Positive"]).count()
    return counts.fillna(0, ["Negative", "Positive"])
