"""One query for each operator over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import (
    chat_format,
    chat_repair,
    collocations,
    decontaminate,
    html_extract,
    language_id,
    line_dedup,
    near_dup,
    packing,
    sharding,
    topk_search,
    toxicity,
    url_filter,
)

#: Vocabulary of the tokenizers' folder that packing and language models use.
VOCABULARY = "byte_bpe_50k.json"
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def fold(parts: int, held: int) -> Column:
    """Whether the checksum of a document's id falls into the held-out part."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.rules_table(pages, URL_RULES))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), vocabulary(), fold(5, 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(4, 2))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(
        F.size(F.split("text", "\n")), F.lit(1)).alias("n_lines")))
    return kept.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
        F.expr("aggregate(filter(coalesce(line_runs, array(0)), (x, i) -> i % 2 = 1), 0L, (a, x) -> a + x)").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat_format.format_chats(rows)
    turns = chat_format.read_turns(F.col("formatted"))
    lost = chat_format.read_loss(F.col("segments"))
    return made.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("n_blocks")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents")).drop("k")


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_repair.damaged(_table(spark, sf_dir, "conversations"))
    return chat_repair.repair_digests(rows, present=F.col("present"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_url_filter": f"""
        WITH rules(rule_host, rule_path, verdict) AS (VALUES
            {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
        p AS (
            SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        m AS (
            SELECT p.*, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
            FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                                  AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op8_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        k AS (
            SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
            FROM l),
        c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key
              HAVING count(DISTINCT doc_id) >= 3),
        f AS (SELECT k.doc_id, line, pos, last IS NOT NULL AND k.doc_id <> last AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
    "op9_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'),
                '<s>', '<\\s>'), '</s>', '<\\/s>'), '[SYS]', '[\\SYS]'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'),
                '[ROLE]', '[\\ROLE]'), '[/ROLE]', '[\\/ROLE]') AS escaped,
                CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 ELSE 7 END AS mark
            FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(length(escaped) + mark + 4) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op10_decontaminate": f"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        i AS (
            SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM b
            WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[a:a + n - 1], ' ') AS s FROM i),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS a FROM d),
        x AS (
            SELECT p.doc_id, p.a, win.n, win.item_id
            FROM p CROSS JOIN (SELECT DISTINCT n FROM win) z
            JOIN win ON win.n = z.n AND array_to_string(w[p.a:p.a + z.n - 1], ' ') = win.s
            WHERE p.a + z.n - 1 <= len(p.w)),
        h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (
                SELECT doc_id, unnest(range(a, a + n)) AS q FROM x) GROUP BY doc_id),
        s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
                SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM x) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op12_collocations": f"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")},
                   '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        o AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m)
              WHERE len(w) >= m),
        f AS MATERIALIZED (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS g, any_value(m) AS m, count(*) AS f FROM o GROUP BY 1, 2),
        t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, g, m, f AS a, string_split(g, ' ') AS v FROM f WHERE m > 1 AND f >= 30),
        parts AS MATERIALIZED (
            SELECT lang, g, a, k, array_to_string(v[1:k], ' ') AS head, array_to_string(v[k + 1:m], ' ') AS tail
            FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
        cut AS (
            SELECT p.lang, p.g, p.a, p.k, l.f AS l, r.f AS r, CAST(2000000 AS HUGEINT) * p.a // (l.f + r.f) AS score,
                   row_number() OVER (PARTITION BY p.lang, p.g ORDER BY CAST(2000000 AS HUGEINT) * p.a // (l.f + r.f), p.k) AS q
            FROM parts p JOIN f l ON l.lang = p.lang AND l.g = p.head JOIN f r ON r.lang = p.lang AND r.g = p.tail),
        sub AS MATERIALIZED (
            SELECT lang, a, array_to_string(v[b:e], ' ') AS g
            FROM (SELECT *, unnest(range(b + 1, m + 1)) AS e FROM (SELECT *, unnest(range(1, m)) AS b FROM c))
            WHERE e - b + 1 < m),
        inside AS (SELECT DISTINCT c.lang, c.g FROM sub x JOIN c ON c.lang = x.lang AND c.g = x.g WHERE 100 * x.a >= 80 * c.a),
        k AS (
            SELECT lang, g AS phrase, a, l, r, score,
                   row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank
            FROM cut ANTI JOIN inside USING (lang, g) WHERE q = 1)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM k JOIN t USING (lang) WHERE rank <= 2000""",
    # Costs-to-finish as texts: the cost in nine digits, then the letters, so that the least text is the choice.
    "op13_chat_repair": r"""
        WITH RECURSIVE bits(i, k, v) AS (
            SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
            UNION ALL SELECT i, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM bits WHERE k < 8),
        tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
        o AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
            FROM conversations),
        w AS (
            SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                   list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS way
            FROM o CROSS JOIN tab),
        m AS (
            SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE way WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM w),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS p,
                     trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM m),
        f AS (
            SELECT *, CASE WHEN seen = '' THEN 1
                           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 2
                           WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                   left(role, 1) AS i, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS j
            FROM r),
        n AS (
            SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
                   count(*) FILTER (WHERE fault = 3) AS truncated,
                   count(*) FILTER (WHERE j IS NOT NULL AND i || j NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id),
        dp(conv_id, p, z, s, u, a) AS (
            SELECT conv_id, rows + 1, {'k': '000000000', 't': ''}, {'k': '000000004II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)},
                   {'k': '000000002I', 't': 'assistant:' || chr(10)}, {'k': '000000000', 't': ''} FROM n
            UNION ALL
            SELECT conv_id, p, least(z, struct_pack(k := printf('%09d', CAST(left(least(u, ia).k, 9) AS BIGINT) + 2) || 'I' || least(u, ia).k[10:],
                                                    t := 'user:' || chr(10) || least(u, ia).t)),
                   least(s, struct_pack(k := printf('%09d', CAST(left(least(u, ia).k, 9) AS BIGINT) + 2) || 'I' || least(u, ia).k[10:],
                                        t := 'user:' || chr(10) || least(u, ia).t)),
                   least(u, ia), least(a, iu)
            FROM (
                SELECT *, struct_pack(k := printf('%09d', CAST(left(a.k, 9) AS BIGINT) + 2) || 'I' || a.k[10:],
                                      t := 'assistant:' || chr(10) || a.t) AS ia,
                          struct_pack(k := printf('%09d', CAST(left(u.k, 9) AS BIGINT) + 2) || 'I' || u.k[10:],
                                      t := 'user:' || chr(10) || u.t) AS iu
                FROM (
                    SELECT dp.conv_id, f.p,
                           list_min([struct_pack(k := printf('%09d', CAST(left(z.k, 9) AS BIGINT) + 3) || 'D' || z.k[10:], t := z.t),
                                CASE WHEN fault IN (0, 3) AND i = 's' THEN struct_pack(k := printf('%09d', CAST(left(s.k, 9) AS BIGINT) + (fault = 3)::INT) || 'K' || s.k[10:], t := role || ':' || text || chr(10) || s.t) END,
                                CASE WHEN fault IN (0, 3) AND i = 'u' THEN struct_pack(k := printf('%09d', CAST(left(u.k, 9) AS BIGINT) + (fault = 3)::INT) || 'K' || u.k[10:], t := role || ':' || text || chr(10) || u.t) END,
                                CASE WHEN fault IN (0, 3) THEN struct_pack(k := printf('%09d', CAST(left(u.k, 9) AS BIGINT) + 2 + (fault = 3)::INT) || 'R' || u.k[10:], t := 'user:' || text || chr(10) || u.t) END]) AS z,
                           list_min([struct_pack(k := printf('%09d', CAST(left(s.k, 9) AS BIGINT) + 3) || 'D' || s.k[10:], t := s.t),
                                CASE WHEN fault IN (0, 3) AND i = 'u' THEN struct_pack(k := printf('%09d', CAST(left(u.k, 9) AS BIGINT) + (fault = 3)::INT) || 'K' || u.k[10:], t := role || ':' || text || chr(10) || u.t) END,
                                CASE WHEN fault IN (0, 3) THEN struct_pack(k := printf('%09d', CAST(left(u.k, 9) AS BIGINT) + 2 + (fault = 3)::INT) || 'R' || u.k[10:], t := 'user:' || text || chr(10) || u.t) END]) AS s,
                           list_min([struct_pack(k := printf('%09d', CAST(left(u.k, 9) AS BIGINT) + 3) || 'D' || u.k[10:], t := u.t),
                                CASE WHEN fault IN (0, 3) AND i = 'a' THEN struct_pack(k := printf('%09d', CAST(left(a.k, 9) AS BIGINT) + (fault = 3)::INT) || 'K' || a.k[10:], t := role || ':' || text || chr(10) || a.t) END,
                                CASE WHEN fault IN (0, 3) THEN struct_pack(k := printf('%09d', CAST(left(a.k, 9) AS BIGINT) + 2 + (fault = 3)::INT) || 'R' || a.k[10:], t := 'assistant:' || text || chr(10) || a.t) END]) AS u,
                           list_min([struct_pack(k := printf('%09d', CAST(left(a.k, 9) AS BIGINT) + 3) || 'D' || a.k[10:], t := a.t),
                                CASE WHEN fault IN (0, 3) AND i = 'u' THEN struct_pack(k := printf('%09d', CAST(left(u.k, 9) AS BIGINT) + (fault = 3)::INT) || 'K' || u.k[10:], t := role || ':' || text || chr(10) || u.t) END,
                                CASE WHEN fault IN (0, 3) THEN struct_pack(k := printf('%09d', CAST(left(u.k, 9) AS BIGINT) + 2 + (fault = 3)::INT) || 'R' || u.k[10:], t := 'user:' || text || chr(10) || u.t) END]) AS a
                    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.p = dp.p - 1) b) c)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(CAST(left(z.k, 9) AS BIGINT), 0) AS cost, coalesce(z.k[10:], '') AS audit,
               sha256(coalesce(left(z.t, greatest(length(z.t) - 1, 0)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.p = 1""",
}

QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_topk_search, op2_url_filter, op3_language_id, op4_toxicity, op5_near_dup, op6_sharding, op7_packing,
    op8_line_dedup, op9_chat_format, op10_decontaminate, op11_html_extract, op12_collocations,
    op13_chat_repair)}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
