"""The corpus pipeline against a plain version of each stage, on a small corpus with nulls, repeated ids and copies."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tickerloom.llm import near_dup
from tickerloom.llm.queries import vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\f\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def cut(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def plain_lines(docs):
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= 20:
                holders[key].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return [(i, "\n".join(x for x in (text or "").split("\n")
                          if gone.get(x.strip(BLANKS).translate(LOWER), i) == i)) for i, text in docs]


def plain_near(docs):
    """Rows that stay: the first, by id, of each group of texts linked at 80 percent of five-word shingles."""
    def shingles(text):
        w = cut(text, r"[^\x20\x09-\x0D]+")
        return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    rows = [(i, text, shingles(text)) for i, text in docs]
    sets = list(dict.fromkeys(s for i, _, s in rows if s and i is not None))
    group = {s: s for s in sets}

    def root(s):
        while group[s] != s:
            s = group[s]
        return s

    for k, s in enumerate(sets):
        for t in sets[:k]:
            if 100 * len(s & t) >= 80 * len(s | t):
                group[root(s)] = root(t)
    best = {}
    for i, text, s in rows:
        if s and i is not None:
            best[root(s)] = min(best.get(root(s), i), i)
    left, seen = [], set()
    for i, text, s in rows:
        if s and i is not None:
            if best[root(s)] != i or root(s) in seen:
                continue
            seen.add(root(s))
        left.append((i, text))
    return left


def plain_clean(docs, items):
    windows = set()
    for text in items:
        w = cut(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    out = []
    for i, text in docs:
        w = cut(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        if not any(tuple(w[k:k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
            out.append((i, text))
    return out


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(8)
    items = [words(rng, 14, 90) for _ in range(4)] + [None, ""]
    texts = [words(rng, rng.randrange(20, 80)) for _ in range(40)]
    rows = list(enumerate(texts))
    common = "This line is common to very many documents"
    for k in range(10):
        near = texts[k].split()
        near[-1] = "changed"
        rows.append((50 + k, " ".join(near)))
        rows.append((70 + k, texts[k + 20] + "\n" + (common if k % 2 else "  " + common.upper() + " ") + f"\nown {k} " + words(rng, 12)))
    rows += [(90 + k, words(rng, 15) + " " + items[k] + " " + words(rng, 15)) for k in range(4)]
    # An id with a copy of an earlier text and a text of its own; equal rows of one id.
    rows += [(100, texts[0]), (100, words(rng, 40)), (101, words(rng, 30))]
    rows += [rows[-1], (102, None), (102, None), (103, ""), (104, " \n "), (None, texts[3]), (None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    made = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(made, DOCS).selectExpr("*", "1 AS id", "'x' AS group", "2 AS copy", "3 AS key", "4 AS n").write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return path, rows, items


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_equal_plain_versions(spark, corpus):
    path, rows, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want, made = rows, {}
    plain = {"toxicity": lambda d: d, "line_dedup": plain_lines, "near_dedup": plain_near,
             "decontamination": lambda d: plain_clean(d, items)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = plain[name](want)
        docs = corpus_pipeline.stored(stage(spark, docs, path), name)
        made[name] = docs
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "near_dedup":
            # Which text stands for a group of one id is the operator's choice.
            assert Counter(i for i, _ in pairs(docs).elements()) == Counter(i for i, _ in want)
        assert pairs(docs) == Counter(want), name
    assert {100, 101, 102, 103} <= {i for i, _ in want} and 0 in {i for i, _ in want}
    assert all(r.n_chars == len(r.text) for r in made["decontamination"].collect())
    pieces = corpus_pipeline.run(spark, path).collect()
    encode = Tokenizer.from_file(vocabulary()).encode
    tokens = Counter(t for _, text in want for t in [*encode(text or "", add_special_tokens=False).ids, 1])
    assert Counter(t for r in pieces for t in r.ids) == tokens
    assert {r.doc_id for r in pieces} == {i for i, _ in want}


def test_repeated_ids_lose_no_text(spark):
    a, b, c = (words(random.Random(s), 30) for s in range(3))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, a), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = near_dup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert pairs(got) == Counter({(1, a): 1, (2, b): 1, (3, c): 1, (None, a): 2, (4, None): 2})
    # Two groups with one smallest id: text d of id 5 must not go with text a.
    d = words(random.Random(9), 30)
    rows = [(5, a), (4, a + " more"), (5, d), (6, d)]
    got = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pairs(got) == Counter({(4, a + " more"): 1, (5, d): 1})


def test_empty_tables_go_through(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
