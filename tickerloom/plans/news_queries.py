"""Registered queries over articles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import fixed_values as fixed
from tickerloom.functions import labels, text as T
from tickerloom.operators import news as N
from tickerloom.operators import signals as S
from tickerloom.operators.similarity import best_cosine, reference_vectors
from tickerloom.plans import views as V
from tickerloom.plans.registry import register
from tickerloom.plans.stored import stored

# The given prose is invented and has few finance words, so these test dictionaries use its frequent fragments.
FRAGMENTS = ["tion", "ment", "eau", "elle", "rewh", "this", "from", "ein", "von"]
TEST_SOURCES = {"src1/": 5, "src2": 4, "src7": 0}
# Polarities are multiples of 1/8, so their sums are exact in any order.
LEXICON = {
    "the": 0.375, "and": -0.125, "this": 0.5, "that": -0.375, "from": 0.25, "la": -0.25, "de": 0.125, "der": 0.25,
    "und": -0.125, "el": 0.125, "que": -0.375, "with": 0.625, "of": -0.625, "les": 0.375,
}

NEWS = """news AS (
  SELECT doc_id AS id, 'T' || (doc_id % 25) AS ticker, split_part(text, chr(10), 1) AS title, text AS summary,
         source, lang, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS published,
         source || '/' || doc_id AS url
  FROM documents
),
txt AS (SELECT *, lower(title || ' ' || summary) AS t FROM news)"""

COMPANIES = "companies AS (SELECT 'T' || n_nationkey AS ticker, " + \
    "list_extract([" + ", ".join(f"'{w}'" for w in FRAGMENTS) + "], CAST(n_nationkey % 9 + 1 AS BIGINT)) AS word FROM nation)"


def companies(spark: SparkSession, sf: str) -> DataFrame:
    """One keyword row per ticker: ticker, test fragment as name, its long words."""
    word = F.get(F.array(*[F.lit(w) for w in FRAGMENTS]), (F.col("n_nationkey") % 9).cast("int"))
    rows = V.table(spark, sf, "nation").select(F.concat(F.lit("T"), "n_nationkey").alias("ticker"), word.alias("name"))
    return rows.withColumn("keywords", T.company_keywords("ticker", "name"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON.items()), "word string, polarity double")


def _q(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def sql_hits(words: Sequence[str], t: str = "t") -> str:
    return "(" + " + ".join(f"CAST(contains({t}, {_q(w)}) AS INTEGER)" for w in words) + ")"


def sql_any(words: Sequence[str], t: str = "t") -> str:
    return "(" + " OR ".join(f"contains({t}, {_q(w)})" for w in words) + ")"


def sql_classify(rules: Mapping[str, Sequence[str]], t: str = "t") -> str:
    """List of (hits, -place, name), largest first."""
    entries = ", ".join(f"{{'h': {sql_hits(w, t)}, 'o': {-i}, 'c': {_q(c)}}}" for i, (c, w) in enumerate(rules.items()))
    return f"(SELECT CASE WHEN m.h = 0 THEN 'general' ELSE m.c END FROM (SELECT list_max([{entries}]) AS m))"


def sql_first(rules: Mapping[str, Sequence[str]], t: str = "t") -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(w, t)} THEN {_q(c)}" for c, w in rules.items()) + " ELSE 'General' END"


def sql_weight(weights: Mapping[str, int]) -> str:
    return "CASE " + " ".join(
        f"WHEN contains(lower(url), {_q(s)}) OR contains(lower(source), {_q(s)}) THEN {w}"
        for s, w in weights.items()) + " ELSE 1 END"


@register(f"""WITH {NEWS}
SELECT min(id) AS id, md5(title || url) AS key FROM news GROUP BY md5(title || url)""")
def dedup_md5(spark: SparkSession, sf: str) -> DataFrame:
    kept = N.dedup_md5(V.news(spark, sf))
    return kept.select("id", T.article_key("title", "url").alias("key"))


@register(f"""WITH {NEWS}
SELECT min(id) AS id, md5(lower(title) || source) AS key FROM news GROUP BY md5(lower(title) || source)""")
def dedup_md5_lower(spark: SparkSession, sf: str) -> DataFrame:
    """Lower-cased titles, with the source in place of the url so that copies meet."""
    rows = V.news(spark, sf).withColumn("url", F.col("source"))
    return N.dedup_md5(rows, lower_title=True).select("id", T.article_key("title", "url", True).alias("key"))


TITLE_KEY = r"substring(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', '', 'g'), 1, 50)"


@register(f"""WITH {NEWS}
SELECT min(id) AS id, {TITLE_KEY} AS key FROM news GROUP BY {TITLE_KEY}""")
def dedup_title50(spark: SparkSession, sf: str) -> DataFrame:
    return N.dedup_title(V.news(spark, sf)).select("id", T.title_key("title").alias("key"))


@register(f"""WITH {NEWS}
SELECT id, {sql_hits(fixed.NOISE_WORDS)} AS noise_words FROM txt WHERE {sql_hits(fixed.NOISE_WORDS)} < 2""")
def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = N.drop_noise(V.news(spark, sf)).withColumn("t", T.article_text())
    return kept.select("id", T.keyword_hits("t", fixed.NOISE_WORDS).alias("noise_words"))


@register(f"""WITH {NEWS}
SELECT id, {sql_any(fixed.OWNERSHIP_SPAM)} AS spam FROM txt""")
def ownership_spam(spark: SparkSession, sf: str) -> DataFrame:
    return V.news(spark, sf).withColumn("t", T.article_text()).select("id", T.is_ownership_spam("t").alias("spam"))


RELEVANT = "(contains(t, lower(ticker)) OR contains(t, word))"


@register(f"""WITH {NEWS}, {COMPANIES}
SELECT id, ticker FROM txt JOIN companies USING (ticker) WHERE {RELEVANT}""")
def relevance_filter(spark: SparkSession, sf: str) -> DataFrame:
    return N.keep_relevant(V.news(spark, sf), companies(spark, sf)).select("id", "ticker")


@register(f"""WITH {NEWS}, {COMPANIES},
s AS (SELECT id, lower(title || ' ' || summary || ' ' || word) AS t, lower(title || ' ' || summary || ' ') AS strict,
             title, ticker, word FROM news JOIN companies USING (ticker))
SELECT id,
  (CASE WHEN contains(t, lower(ticker)) THEN 3 ELSE 0 END) + (CASE WHEN contains(t, word) THEN 2 ELSE 0 END)
  + (CASE WHEN {sql_any(fixed.FINANCE_WORDS)} THEN 2 ELSE 0 END) + (CASE WHEN length(title) > 25 THEN 1 ELSE 0 END)
    AS score,
  (CASE WHEN contains(strict, lower(ticker)) THEN 3 ELSE 0 END) + (CASE WHEN contains(strict, word) THEN 2 ELSE 0 END)
  + (CASE WHEN {sql_any(fixed.FINANCE_WORDS, 'strict')} THEN 2 ELSE 0 END)
  + (CASE WHEN length(title) > 25 THEN 1 ELSE 0 END) AS strict_score
FROM s""")
def relevance_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.news(spark, sf).join(companies(spark, sf), "ticker")
    score = lambda strict: T.relevance_score("title", "summary", "name", "ticker", strict)
    return rows.select("id", score(False).alias("score"), score(True).alias("strict_score")).filter(F.col("score") >= 1)


@register(f"""WITH {NEWS}
SELECT id, {sql_classify(fixed.FEED_CATEGORIES)} AS feed_category, {sql_classify(fixed.NEWS_CATEGORIES)} AS category
FROM txt""")
def classify(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.news(spark, sf).withColumn("t", T.article_text())
    return rows.select("id", T.classify("t", fixed.FEED_CATEGORIES).alias("feed_category"),
                       T.classify("t", fixed.NEWS_CATEGORIES).alias("category"))


@register(f"""WITH {NEWS}
SELECT id, category FROM (SELECT id, {sql_classify(fixed.FEED_CATEGORIES)} AS category FROM txt)
WHERE category IN ('earnings', 'analyst', 'management', 'corporate', 'regulation')""")
def keep_categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.news(spark, sf).withColumn("t", T.article_text())
    return N.keep_categories(rows.select("id", T.classify("t", fixed.FEED_CATEGORIES).alias("category")))


@register(f"""WITH {NEWS}
SELECT id, {sql_first(fixed.NOTE_CATEGORIES)} AS category FROM txt""")
def categorize_first_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.news(spark, sf).withColumn("t", T.article_text())
    return rows.select("id", T.first_category("t").alias("category"))


@register(f"""WITH {NEWS}
SELECT id, {sql_weight(fixed.SOURCE_WEIGHTS)} AS weight, {sql_weight(TEST_SOURCES)} AS test_weight FROM news""")
def source_weight(spark: SparkSession, sf: str) -> DataFrame:
    return V.news(spark, sf).select(
        "id", T.source_weight("url", "source").alias("weight"),
        T.source_weight("url", "source", TEST_SOURCES).alias("test_weight"))


REFS = """refs AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label ORDER BY label LIMIT 5),
sem AS (SELECT vec_id, round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(refs.v AS DOUBLE[]))), 4)
        AS s FROM embeddings e, refs GROUP BY vec_id)"""


def _with_semantic(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    vectors = V.table(spark, sf, "embeddings")
    refs = reference_vectors(vectors, "label", "vec_id", "embedding", 5)
    # Scores are computed on the vector table, so only (id, score) meets the articles.
    scores = best_cosine(vectors, refs).withColumnRenamed("score", "semantic_score")
    return rows.join(scores, "id", "left").withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))


@register(f"""WITH {NEWS}, {REFS}
SELECT id, coalesce(s, 0) AS semantic_score FROM news LEFT JOIN sem ON id = vec_id""")
def semantic_score(spark: SparkSession, sf: str) -> DataFrame:
    return _with_semantic(spark, sf, V.news(spark, sf).select("id"))


@register("""WITH ref AS (SELECT arg_min(embedding, vec_id) AS v FROM embeddings
             WHERE label = (SELECT min(label) FROM embeddings))
SELECT doc_id AS id, CASE WHEN vec_id IS NULL THEN 0.5 ELSE
  round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT v FROM ref) AS DOUBLE[])), 6) END AS score
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def semantic_filter(spark: SparkSession, sf: str) -> DataFrame:
    vectors = V.table(spark, sf, "embeddings")
    ref = reference_vectors(vectors, "label", "vec_id", "embedding", 1)
    rows = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return N.semantic_filter(rows, vectors, ref, digits=6)


@register("""WITH refs AS (SELECT embedding AS v FROM embeddings WHERE vec_id % 5 = 0)
SELECT e.vec_id AS id,
       round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(refs.v AS DOUBLE[]))), 4) AS score
FROM embeddings e, refs WHERE e.vec_id % 5 <> 0 GROUP BY e.vec_id""")
def nearest_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector that is no reference against a fifth of the table as references."""
    vectors = V.table(spark, sf, "embeddings")
    references = vectors.filter("vec_id % 5 = 0").select(F.col("embedding").alias("reference"))
    return best_cosine(vectors.filter("vec_id % 5 <> 0"), references)


SCORED = f"""scored AS (
  SELECT id, ticker, category,
    (CASE WHEN contains(lower(title), lower(ticker)) THEN 10 WHEN contains(t, lower(ticker)) THEN 5 ELSE 0 END)
    + (CASE WHEN contains(t, word) THEN 6 ELSE 0 END) + least({sql_hits(fixed.IMPACT_WORDS)} * 2, 8)
    + ({sql_weight(TEST_SOURCES)})
    + (CASE category WHEN 'earnings' THEN 4 WHEN 'analyst' THEN 4 WHEN 'management' THEN 3 WHEN 'corporate' THEN 3
       WHEN 'regulation' THEN 2 WHEN 'filing' THEN -8 ELSE 0 END)
    + (CASE WHEN s > 0.35 THEN 5 WHEN s > 0.25 THEN 2 WHEN s < 0.15 THEN -5 ELSE 0 END)
    - (CASE WHEN {sql_hits(fixed.NOISE_WORDS)} >= 2 THEN 10 ELSE 0 END) AS score
  FROM (SELECT txt.*, word, coalesce(s, 0) AS s, {sql_classify(fixed.FEED_CATEGORIES)} AS category
        FROM txt JOIN companies USING (ticker) LEFT JOIN sem ON id = vec_id)
)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.news(spark, sf).join(companies(spark, sf).select("ticker", "keywords"), "ticker")
    scored = N.score_articles(_with_semantic(spark, sf, rows), weights=TEST_SOURCES, semantic="semantic_score")
    return scored.select("id", "ticker", "category", "score")


@register(f"""WITH {NEWS}, {COMPANIES}, {REFS}, {SCORED}
SELECT id, ticker, category, score FROM scored""")
def article_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)


def _quota_sql(source: str, quota: int, total: int) -> str:
    places = " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(fixed.QUOTA_PRIORITY))
    return f"""
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, category ORDER BY score DESC, id) AS cr,
             CASE category {places} ELSE 99 END AS place FROM {source}),
o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY
        CASE WHEN place < 99 AND cr <= {quota} THEN place ELSE 98 END,
        CASE WHEN place < 99 AND cr <= {quota} THEN cr END, score DESC, id) AS slot FROM r)
SELECT id, ticker, category, score, slot FROM o WHERE slot <= {total}"""


@register(f"WITH {NEWS}, {COMPANIES}, {REFS}, {SCORED}, {_quota_sql('scored', 2, 10)}")
def category_quotas(spark: SparkSession, sf: str) -> DataFrame:
    rows = N.category_quotas(_scored(spark, sf), 2, 10)
    return rows.select("id", "ticker", "category", "score", F.col("slot").cast("bigint").alias("slot"))


@register(f"""WITH {NEWS}, {COMPANIES},
u AS (SELECT * FROM txt QUALIFY row_number() OVER (PARTITION BY ticker, {TITLE_KEY} ORDER BY id) = 1),
sem AS (SELECT CAST(-1 AS BIGINT) AS vec_id, CAST(0.2 AS DOUBLE) AS s),
f AS (SELECT u.* FROM u JOIN companies USING (ticker) WHERE {RELEVANT} AND {sql_hits(fixed.NOISE_WORDS)} < 2),
{SCORED.replace('txt.*', 'f.*').replace('FROM txt JOIN', 'FROM f JOIN').replace('coalesce(s, 0)', 'coalesce(s, 0.2)')},
{_quota_sql('scored', 2, 8)}""")
def top_articles(spark: SparkSession, sf: str) -> DataFrame:
    """The whole feed path without the optional similarity points."""
    rows = N.top_articles(V.news(spark, sf), companies(spark, sf), weights=TEST_SOURCES)
    return rows.select("id", "ticker", "category", "score", F.col("slot").cast("bigint").alias("slot"))


@register(f"""WITH {NEWS}, {REFS},
c AS (SELECT id, ticker, CAST(published AS VARCHAR) AS date, {sql_classify(fixed.NEWS_CATEGORIES)} AS category,
             coalesce(s, 0) AS semantic_score FROM txt LEFT JOIN sem ON id = vec_id)
SELECT *, row_number() OVER (PARTITION BY ticker, date, category ORDER BY semantic_score DESC, id) AS rank FROM c""")
def rank_articles(spark: SparkSession, sf: str) -> DataFrame:
    rows = _categorized(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return N.rank_articles(stored(rows, "categorized"), ["ticker", "date", "category"])


def _categorized(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.news(spark, sf).withColumn("t", T.article_text()).select(
        "id", "ticker", F.col("published").alias("date"), T.classify("t", fixed.NEWS_CATEGORIES).alias("category"))
    return _with_semantic(spark, sf, rows)


_PLACES = " ".join(f"WHEN {_q(c)} THEN {i + 1}" for i, c in enumerate([*fixed.NOTE_CATEGORIES, "General"]))


@register(f"""WITH {NEWS}, c AS (SELECT id, ticker, {sql_first(fixed.NOTE_CATEGORIES)} AS category FROM txt)
SELECT *, CASE category {_PLACES} END AS category_place,
       row_number() OVER (PARTITION BY ticker, category ORDER BY id) AS place FROM c""")
def group_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return N.group_by_category(V.news(spark, sf)).select("id", "ticker", "category", "category_place", "place")


@register(f"""WITH {NEWS}, c AS (SELECT id, ticker, title, {sql_first(fixed.NOTE_CATEGORIES)} AS category FROM txt),
n AS (SELECT *, CASE category {_PLACES} END AS p, row_number() OVER (PARTITION BY ticker, category ORDER BY id) AS n
      FROM c QUALIFY n <= 3)
SELECT ticker, string_agg(CASE WHEN n = 1 THEN chr(10) || '### ' || category || chr(10) ELSE '' END
                          || '- ' || title || chr(10), '' ORDER BY p, n) AS context FROM n GROUP BY ticker""")
def note_context(spark: SparkSession, sf: str) -> DataFrame:
    universe = V.news(spark, sf).select("ticker").distinct()
    return N.with_context(universe, N.note_context(V.news(spark, sf)))


_STOP = ", ".join(_q(w) for w in fixed.HEADLINE_STOPWORDS)


@register(f"""WITH {NEWS},
w AS (SELECT unnest(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM news)
SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN ({_STOP})
GROUP BY word ORDER BY n DESC, word LIMIT 20""")
def headline_words(spark: SparkSession, sf: str) -> DataFrame:
    return N.headline_words(V.news(spark, sf))


@register(f"WITH {NEWS} SELECT ticker, count(*) AS articles FROM news GROUP BY ticker")
def news_volume(spark: SparkSession, sf: str) -> DataFrame:
    return N.news_volume(V.news(spark, sf))


_LEX = "lex(word, polarity) AS (VALUES " + ", ".join(f"({_q(w)}, CAST({p} AS DOUBLE))" for w, p in LEXICON.items()) + ")"


def sql_polarity(column: str) -> str:
    return f"""{_LEX},
tok AS (SELECT id, unnest(regexp_split_to_array(lower({column}), '[^\\p{{L}}]+')) AS word FROM news),
pol AS (SELECT news.id, coalesce(p, 0) AS polarity FROM news LEFT JOIN
        (SELECT id, avg(polarity) AS p FROM tok JOIN lex USING (word) GROUP BY id) x ON news.id = x.id)"""


@register(f"WITH {NEWS}, {sql_polarity('summary')} SELECT id, round(polarity, 10) AS polarity FROM pol")
def sentiment_polarity(spark: SparkSession, sf: str) -> DataFrame:
    rows = N.with_polarity(V.news(spark, sf), lexicon(spark))
    return rows.select("id", F.round("polarity", 10).alias("polarity"))


@register(f"""WITH {NEWS}, {sql_polarity('title')}
SELECT ticker, count(*) FILTER (polarity <= 0) AS "Negative", count(*) FILTER (polarity > 0) AS "Positive"
FROM news JOIN pol ON news.id = pol.id GROUP BY ticker""")
def sentiment_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return N.sentiment_pivot(N.with_polarity(V.news(spark, sf), lexicon(spark), "title", ("id", "ticker")))


def _signal_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with date, category, similarity and polarity, without their text."""
    rows = V.news(spark, sf).withColumn("t", T.article_text()).withColumn(
        "category", T.classify("t", fixed.NEWS_CATEGORIES))
    polar = N.with_polarity(rows, lexicon(spark), "summary", ("id", "ticker", "published", "category"))
    return _with_semantic(spark, sf, polar.withColumnRenamed("published", "date"))


SIGNAL = f"""{REFS}, {sql_polarity('summary')},
art AS (SELECT txt.id, ticker, published AS date, {sql_classify(fixed.NEWS_CATEGORIES)} AS category, polarity,
               coalesce(s, 0) AS semantic FROM txt JOIN pol ON txt.id = pol.id LEFT JOIN sem ON txt.id = vec_id)"""
_BUCKETS = ", ".join(f"count(*) FILTER (category = '{b}') AS {b}_count" for b in fixed.SIGNAL_BUCKETS)


def sql_five(s: str, i: str, r: str) -> str:
    return (f"CASE WHEN {s} > 0.15 AND {i} > 0.30 THEN 'Strong Bullish' WHEN {s} > 0.05 THEN 'Bullish' "
            f"WHEN {s} < -0.15 AND {i} > 0.30 THEN 'Strong Bearish' WHEN {s} < -0.05 OR {r} >= 2 THEN 'Bearish' "
            f"ELSE 'Neutral' END")


@register(f"""WITH {NEWS}, {SIGNAL},
d AS (SELECT ticker, CAST(date AS VARCHAR) AS date, count(*) AS total_signals,
             round(avg(polarity), 10) AS avg_sentiment_polarity, round(avg(semantic), 10) AS avg_semantic_impact,
             {_BUCKETS} FROM art GROUP BY 1, 2)
SELECT *, CASE WHEN avg_sentiment_polarity > 0.05 AND avg_semantic_impact > 0.25 THEN 'Bullish'
               WHEN avg_sentiment_polarity < -0.05 OR regulation_count >= 2 THEN 'Bearish' ELSE 'Neutral' END
            AS daily_signal_label FROM d""")
def daily_signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.daily_signals(_signal_articles(spark, sf), digits=10)
    return rows.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register(f"""WITH {NEWS}, {SIGNAL},
d AS (SELECT ticker, count(*) AS total_signals, round(avg(round(polarity, 4)), 10) AS avg_sentiment_polarity,
             round(avg(semantic), 10) AS avg_semantic_impact, {_BUCKETS} FROM art GROUP BY 1)
SELECT ticker, total_signals, avg_sentiment_polarity, avg_semantic_impact, earnings_count, analyst_count,
       regulation_count, {sql_five('avg_sentiment_polarity', 'avg_semantic_impact', 'regulation_count')}
       AS daily_signal_label FROM d""")
def company_signals(spark: SparkSession, sf: str) -> DataFrame:
    return S.company_signals(_signal_articles(spark, sf), digits=10)


@register(f"""WITH {NEWS}, {SIGNAL},
d AS (SELECT ticker, date, avg(polarity) AS p, avg(semantic) AS i,
             count(*) FILTER (category = 'regulation') AS r FROM art GROUP BY 1, 2)
SELECT label, count(*) AS n FROM (SELECT CASE WHEN p > 0.05 AND i > 0.25 THEN 'Bullish'
  WHEN p < -0.05 OR r >= 2 THEN 'Bearish' ELSE 'Neutral' END AS label FROM d) GROUP BY label""")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.label_distribution(S.daily_signals(_signal_articles(spark, sf), digits=None))
    return rows.withColumnRenamed("daily_signal_label", "label")


@register(f"""WITH {NEWS}
SELECT id, CAST(published AS VARCHAR) AS published FROM news
WHERE DATE '2024-01-20' - published BETWEEN 0 AND 10""")
def within_days(spark: SparkSession, sf: str) -> DataFrame:
    asof = F.lit("2024-01-20").cast("date")
    rows = V.news(spark, sf).filter(labels.within_days("published", asof, 10))
    return rows.select("id", F.date_format("published", "yyyy-MM-dd").alias("published"))


@register(f"""WITH {NEWS}
SELECT id, CAST(published AS VARCHAR) AS published FROM news WHERE published >= DATE '2024-01-20' - 14""")
def recency_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.news(spark, sf).filter(labels.recent("published", F.lit("2024-01-20").cast("date"), 14))
    return rows.select("id", F.date_format("published", "yyyy-MM-dd").alias("published"))


@register(f"""WITH {NEWS}
SELECT id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(title),
  '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', ' ', 'g')), ' ', '-', 'g'), '-+', '-', 'g') AS slug FROM news""")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return V.news(spark, sf).select("id", T.slugify("title").alias("slug"))


@register(f"""WITH {NEWS},
both_sources AS (
  SELECT 0 AS source_ordinal, id, ticker, title FROM news
  UNION ALL
  SELECT 1, page_id, 'T' || (page_id % 25), regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages
)
SELECT source_ordinal, id, ticker, title FROM both_sources
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY source_ordinal, id) <= 60""")
def company_caps(spark: SparkSession, sf: str) -> DataFrame:
    """First sixty articles of each ticker over two sources, documents before pages."""
    page = F.col("page_id")
    pages = V.table(spark, sf, "pages").select(
        page.alias("id"), F.concat(F.lit("T"), page % 25).alias("ticker"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    both = N.union_sources(V.news(spark, sf).select("id", "ticker", "title"), pages)
    return N.cap_per_key(both, "ticker", 60, [F.asc("source_ordinal"), F.asc("id")])


TRUTH = f"""{NEWS},
t AS (SELECT quality AS y_true, CASE WHEN {sql_classify(fixed.FEED_CATEGORIES)} = 'general' THEN 0 ELSE 1 END AS y_pred
      FROM txt JOIN labels ON id = doc_id)"""


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    """Known quality against a keyword rule's guess."""
    guess = F.when(T.classify("t", fixed.FEED_CATEGORIES) == "general", 0).otherwise(1)
    rows = V.news(spark, sf).withColumn("t", T.article_text()).select("id", guess.alias("y_pred"))
    truth = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y_true"))
    return rows.join(truth, "id")


@register(f"WITH {TRUTH} SELECT y_true, y_pred, count(*) AS n FROM t GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return S.confusion_matrix(_truth(spark, sf))


_REPORT = f"""{TRUTH},
l AS (SELECT y_true AS label FROM t UNION SELECT y_pred FROM t),
c AS (SELECT label, (SELECT count(*) FROM t WHERE y_true = label) AS support,
             (SELECT count(*) FROM t WHERE y_pred = label) AS predicted,
             (SELECT count(*) FROM t WHERE y_true = label AND y_pred = label) AS hits FROM l),
m AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM c),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END
        AS f1 FROM m)"""


@register(f"""WITH {_REPORT}
SELECT label, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1, support, hits
FROM rep""")
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.class_report(S.confusion_matrix(_truth(spark, sf)))
    return rows.withColumns({c: F.round(c, 10) for c in ("precision", "recall", "f1")})


@register(f"""WITH {_REPORT}
SELECT round(sum(hits) / sum(support), 10) AS accuracy, round(avg(precision), 10) AS precision_macro,
       round(avg(recall), 10) AS recall_macro, round(avg(f1), 10) AS f1_macro FROM rep""")
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.classification_metrics(S.confusion_matrix(_truth(spark, sf)))
    return rows.select(*[F.round(c, 10).alias(c) for c in rows.columns])
