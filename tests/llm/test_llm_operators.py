"""The training-data operators against brute force, and on nulls, empties, repeats and clashing columns."""

import itertools
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import (
    chat_format,
    components,
    decontaminate,
    language_id,
    line_dedup,
    near_dup,
    packing,
    samples,
    sharding,
    text_units,
    topk_search,
    toxicity,
    url_filter,
)
from tickerloom.llm.queries import vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string"


def words_of(rng, n, size=40):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeats, one long text, and columns named like results."""
    long = " ".join(words_of(random.Random(3), 30_000, 5000))
    rows = [(1, None, "en", "s"), (2, "", "en", None), (3, " \n\t ", None, "s"), (4, "One two\nthree four five six", "en", "s"),
            (4, "One two\nthree four five six", "en", "s"), (5, "ONE TWO\nthree four five six", "de", "s"),
            (None, "one two\nthree four five six", "en", "s"), (6, long, "en", "s"), (7, "Ünï ßtraße ﬁ 日本 'll 3.14", "de", "s"),
            (8, "x", "fr", "s"), (9, "\U0001F600 !!! ...", "fr", "s")]
    return spark.createDataFrame(rows, DOCS).selectExpr(
        "*", "'x' AS n", "1 AS kept", "'y' AS key", "'z' AS host", "2 AS shard", "3 AS line_runs_", "4 AS copy", "5 AS score",
        "6 AS id", "7 AS u")


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def test_hashes_name_equal_units():
    cp, bounds = text_units.lay_out(["ab abc", "", "abc ab"])
    start, end = text_units.runs(cp != 32, bounds)
    names = text_units.hashes(cp, start, end)
    assert names[0] == names[3] and names[1] == names[2] and names[0] != names[1]
    assert list(text_units.chunks(np.array([3, 3, 9, 0, 1]), 6)) == [(0, 2), (2, 3), (3, 5)]


def test_known_keeps_values():
    known = text_units.Known(4, 1, np.int64)
    names = text_units.mix(np.arange(200, dtype=np.uint64) % 50) | np.uint64(1)
    for _ in range(2):
        got = known.get(names, lambda at: (names[at] % np.uint64(1000)).astype(np.int64)[:, None])
        assert (got[:, 0] == (names % np.uint64(1000)).astype(np.int64)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (70, 70)]
    got = {r.node: r.component for r in components.connected_components(
        spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 50: 40, 60: 40}


# --- near duplicates

def sets_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_groups(texts, n, percent):
    sets = {k: sets_of(t, n) for k, t in texts.items()}
    above = {k: k for k in texts}

    def root(k):
        while above[k] != k:
            k = above[k]
        return k
    for a, b in itertools.combinations(sorted(texts), 2):
        both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if all_ and sets[a] and sets[b] and 100 * both >= percent * all_:
            x, y = sorted((root(a), root(b)))
            above[y] = x
    return {k: root(k) for k in texts}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, monkeypatch, n, percent):
    monkeypatch.setattr(near_dup, "CELL_ROWS", 8)  # groups meet in blocks
    rng, texts = random.Random(n), {}
    shared = words_of(rng, 15, 10_000)
    for k in range(12):
        base = words_of(rng, rng.choice([2, 4, 9, 40, 150]), 10_000)
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = "new" + str(rng.random())
            texts[len(texts)] = " ".join(own + (shared if k % 3 == 0 else []))
    texts |= {200 + i: t for i, t in enumerate([None, "", " \n", "A b", "a B", "a"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_dup.near_duplicates(docs, n, percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_groups(texts, n, percent)
    assert all(r.n_shingles == len(sets_of(texts[r.doc_id], n)) and r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = near_dup.near_duplicates(odd_docs, 3, 85).collect()
    assert len(rows) == odd_docs.count() and near_dup.near_duplicates(no_docs).count() == 0
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert all(r.kept and not r.n_shingles for r in rows if r.doc_id in (1, 2, 3))


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2 ** 63, 3000, dtype=np.uint64)
    a, b = near_dup.sketch(np.sort(pool[:2000])), near_dup.sketch(np.sort(pool[500:2500]))
    got = near_dup.estimate(a[None], b[None], np.array([2000]), np.array([2000]))[0, 0]
    assert abs(got - 1500 / 2500) < 0.16


# --- decontamination

def brute_hits(text, items, size):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, found = cut(text), set(), set()
    for name, t in items:
        own = cut(t)
        for a in range(max(1, len(own) - size + 1) if own else 0):
            window = own[a: a + size]
            for i in range(len(w) - len(window) + 1):
                if w[i: i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    if name is not None:
                        found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [5, 250_000])
def test_contamination(spark, odd_docs, no_docs, block):
    rng = random.Random(1)
    items = [(i, " ".join(words_of(rng, rng.choice([1, 3, 10, 14]), 6))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "?! --"), (None, "w1 w2 w3"), (7, items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = {i: " ".join(words_of(rng, rng.randrange(30), 6)) for i in range(40)} | {99: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in decontaminate.contamination(docs, bench, 10, block).collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(texts[r.doc_id], items, 10)
        assert r.contaminated == (r.n_hit > 0)
    clean = {k for k, t in texts.items() if not brute_hits(t, items, 10)[1]}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench, 10, block).collect()} == clean
    assert decontaminate.contamination(odd_docs, bench, 10, block).count() == odd_docs.count()
    assert decontaminate.decontaminate(odd_docs, bench.filter("false")).count() == odd_docs.count()
    assert decontaminate.contamination(no_docs, bench).count() == 0


# --- packing

def test_packing(odd_docs, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    assert packing._encoder(vocabulary()).encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]
    rows = packing.pack_documents(odd_docs, vocabulary()).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        docs[r.doc_id].append((r.start, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for r in odd_docs.collect():
        want = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        copies = 2 if r.doc_id == 4 else 1
        assert sorted(i for _, ids in docs[r.doc_id] for i in ids) == sorted(want * copies)
        if copies == 1:
            assert [i for _, ids in sorted(docs[r.doc_id]) for i in ids] == want
    for parts in sequences.values():
        upto = 0
        for offset, length in sorted(parts):
            assert offset == upto
            upto += length
        assert upto <= packing.LENGTH
    assert packing.pack_documents(no_docs, vocabulary()).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    signs = ["a", "Zz", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "ß", ".", "..", "<|endoftext|>", "日", "\u00a0", "²", "\x1c", "!"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(400)]
    ids, bounds = packing._encoder(vocabulary()).encode(texts)
    for k, text in enumerate(texts):
        assert ids[bounds[k]: bounds[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_pack_fills_sequences():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 513) for _ in range(600)]
    sets = packing.pack(sizes, 2048)
    assert sorted(i for s in sets for i in s) == list(range(600))
    assert max(sum(sizes[i] for i in s) for s in sets) <= 2048
    assert sum(sizes) / (2048 * len(sets)) > 0.95


# --- language and toxicity

def test_forward_sums_all_segmentations():
    vocabulary_ = [b"a", b"b", b"ab", b"ba", b"aba", *(bytes([c]) for c in range(99, 102))]
    lattice = language_id.Lattice(vocabulary_)
    rng = np.random.default_rng(1)
    chances = np.vstack([rng.random((len(vocabulary_), 2)), np.zeros((1, 2))])

    def brute(word, lang):
        if not word:
            return 1.0
        return sum(chances[i, lang] * brute(word[len(p):], lang) for i, p in enumerate(vocabulary_) if word.startswith(p))
    words = [b"ab", b"aba", b"abab", b"cab", b"abaabab" * 9]
    got = lattice.log_probability(words, chances)
    for w, row in zip(words[:4], got):
        assert np.allclose(row, [np.log(brute(w, 0)), np.log(brute(w, 1))])
    assert np.isfinite(got).all()
    used = lattice.expected([b"ab"], np.array([3.0]), chances[:, 0])
    split = chances[0, 0] * chances[1, 0]
    assert np.isclose(used[2], 3 * chances[2, 0] / (chances[2, 0] + split))


def test_expected_counts_of_long_words():
    vocabulary_ = [b"a", b"b", b"ab", b"ba", b"aba", *(bytes([c]) for c in range(99, 102))]
    lattice = language_id.Lattice(vocabulary_)
    rng = np.random.default_rng(2)
    chances = np.append(rng.random(len(vocabulary_)), 0.0)

    def brute(word):
        upto, after, used = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0], np.zeros(len(vocabulary_))
        found = [(a, a + len(p), i) for a in range(len(word)) for i, p in enumerate(vocabulary_) if word.startswith(p, a)]
        for a, b, i in found:
            upto[b] += upto[a] * chances[i]
        for a, b, i in reversed(found):
            after[a] += chances[i] * after[b]
        for a, b, i in found:
            used[i] += upto[a] * chances[i] * after[b] / upto[-1]
        return used
    for word in (b"abc" * 9, b"c" * 40 + b"abaab" * 3, b"abaabab" * 9 + b"e", b"d" * 30 + b"abcabaeab" * 12, b"ababa" * 40):
        assert np.allclose(lattice.expected([word, word], np.array([3.0, 1.0]), chances), 4 * brute(word))
    rare = b"abcde" * 120
    used = lattice.expected([rare], np.array([1.0]), chances * 1e-4)
    assert np.isclose(used @ [len(p) for p in vocabulary_], len(rare))


def test_language(spark, odd_docs, no_docs):
    rng = random.Random(4)
    kinds = {"en": "the of and with that this from".split(), "fr": "le la des avec pour que dans".split()}
    rows = [(i, " ".join(rng.choices(kinds[lang], k=30)), lang, "s") for i, lang in enumerate(["en", "fr"] * 60)]
    docs = spark.createDataFrame(rows, DOCS)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = {r.doc_id: r for r in language_id.identify(docs, vocabulary(), held).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang, _ in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    odd = language_id.identify(odd_docs, vocabulary(), held).collect()
    assert len(odd) == odd_docs.count()
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 9)} == {"und"}
    assert language_id.identify(no_docs, vocabulary(), held).count() == 0


def test_toxicity(spark, odd_docs, no_docs):
    rng = random.Random(6)
    calm = "the house stands near a river where many people walk along quiet paths every morning".split()
    rows, labels = [], []
    for i in range(300):
        own, bad = rng.choices(calm, k=25), i % 5 == 0
        if bad:
            own.insert(rng.randrange(25), rng.choice(["scoundrel", "nitwit"]))
        rows.append((i, " ".join(own), "en", "s"))
        labels.append((i, 1, int(bad)))
    more = ["a n i t w i t here", "n1twit along", "sc0undrel!", "nniittwwiitt", "quiet paths", "S.C.O.U.N.D.R.E.L", None, ""]
    rows += [(1000 + i, t, "en", "s") for i, t in enumerate(more)]
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = {r.doc_id: r for r in toxicity.score(docs, known, held).collect()}
    assert all(got[i].predicted == bad and 0 <= got[i].score <= 1 for i, _, bad in labels)
    assert [got[1000 + i].predicted for i in range(len(more))] == [1, 1, 1, 1, 0, 1, 0, 0]
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, known).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    assert toxicity.score(odd_docs, known, held).count() == odd_docs.count()
    assert {r.predicted for r in toxicity.score(odd_docs, known.filter("false"), held).collect()} == {0}
    assert toxicity.score(no_docs, known, held).count() == 0


def test_toxicity_keeps_all_features(spark):
    rng = random.Random(16)
    spelled = ["".join(rng.sample("abcdefghijklm", 8)) for _ in range(7000)]
    known_words = ["zork" + "".join(rng.sample("abcdefghijklmnopq", 4)) for _ in range(24_000)] + ["zorkzyxwv"]
    toxic = [" ".join(spelled)] * 4 + ["truly vwxyzuvw"] * 3 + [f"n{'ab'[i % 2]}{'cdefghijkl'[i // 2]} zork{w}" for i, w in enumerate(
        ["rstu", "rsut", "rtsu", "rtus", "rust", "ruts", "srtu", "srut", "strn", "sturn", "surt", "sutr"])]
    clean = [" ".join(known_words)] + ["quiet paths along the river"] * 40
    rows = [(i, t, "en", "s") for i, t in enumerate([*toxic, *clean])]
    known = spark.createDataFrame([(i, 1, int(i < len(toxic))) for i in range(len(rows))], "doc_id long, quality int, toxic int")
    tried = ["a vwxyzuvw", "the zorktuvs", "the zorkzyxwv", "quiet river"]
    docs = spark.createDataFrame(rows + [(1000 + i, t, "en", "s") for i, t in enumerate(tried)], DOCS)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, known, F.col("doc_id") >= 1000).collect()}
    assert [got[1000 + i] for i in range(len(tried))] == [1, 1, 0, 0]


def test_toxicity_decodes_all_units_that_matter():
    """Scores with and without the test on skeletons."""
    calm = ["the house stands near a river", "idiot you fool nitwit assess glass", "the idea of ideal islands", "ΛΟΓΟΣ και λόγος"] * 5
    characters = toxicity.language_model(toxicity.trigrams(calm))
    found = {"idiot": 0.9, "nitwit": 0.8, "fool": 0.7, "ass~": 0.1, "glas~": 0.6, "idio~": 0.85, "diot": 0.3, "λογος": 0.5, "you": 0.2}
    scorer = toxicity.Scorer({"characters": characters, "features": found, "base": 0.01})
    every = toxicity.Scorer({"characters": characters, "features": found, "base": 0.01})
    every._suspects = lambda cp, start, end: (start, end)
    rng = random.Random(12)
    parts = ["idiot", "you", "nitwit", "nniitt", "fool", "glass", "glas", "ΛΟΓΟΣ", "λογος", "İdiot", "the", "i", "t", "idi", "ot", "a"]
    signs = ["—", "–", "…", "’", "·", "、", "\U0001F600", "2", "!", "1", "11", "0", "@", "$", ".", "-", "*", "\u0301", "", "", "+", "€", " ", ","]
    texts = ["you—idiot", "idiot—you", "the…fool", "a’idiot", "1idiot", "xx!idiot!xx", "x2nitwit2x", "ΛΟΓΟΣ", "the、idiot。", "foool!!the"]
    texts += ["".join(rng.choice(parts) + rng.choice(signs) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    texts += ["".join(rng.choice(signs) + rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(2000)]
    got, expected = scorer(texts), every(texts)
    assert [(t, g, e) for t, g, e in zip(texts, got.tolist(), expected.tolist()) if g != e] == []
    assert (got[:2] > 0.5).all()


# --- lines

def test_line_dedup(spark, odd_docs, no_docs):
    rng = random.Random(8)
    common = ["A line that is long enough to count", "another line, also long enough", "short"]
    texts = {}
    for i in range(40):
        own = [rng.choice([*common, "  " + common[0].upper() + "\t", "own line number %d of text" % i, ""]) for _ in range(rng.randrange(1, 9))]
        texts[i] = "\n".join(own)
    texts |= {50: None, 51: "", 52: "É" * 25, 53: "é" * 25, 54: "é" * 25}
    holders = defaultdict(set)

    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(LOWER)
    for d, t in texts.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    want = {d: "\n".join(x for x in (t or "").split("\n")
                         if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != d))
            for d, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = line_dedup.dedup_lines(docs).collect()
    assert {r.doc_id: r.text for r in rows} == want
    for r in rows:
        if r.line_runs:
            assert sum(r.line_runs) == len(texts[r.doc_id].split("\n"))
    kept = line_dedup.dedup_lines(odd_docs)
    assert kept.count() == odd_docs.count() and kept.columns == [*odd_docs.columns, "line_runs"]
    assert line_dedup.dedup_lines(no_docs).count() == 0


# --- URLs

def test_decoder_against_all_readings(monkeypatch):
    """Every way to read a short unit is tried; paths are folded at every third step."""
    rng = random.Random(44)
    model = np.log(np.random.default_rng(4).dirichlet(np.ones(32), size=(32, 32)))
    monkeypatch.setattr(toxicity, "_FOLD_STEPS", 3)
    decoder = toxicity.Restorer(model)

    def cost(readings):
        x = y = 0
        total = 0.0
        for reading, price in readings:
            total += price
            for c in reading:
                z = toxicity._class(c)
                if z or y:
                    total -= model[x][y][z]
                    x, y = (y, z) if z else (0, 0)
        return total
    for _ in range(60):
        unit = "".join(rng.choice("ab1i0$.-é—!") * rng.choice((1, 1, 2, 3)) for _ in range(rng.randrange(1, 7)))
        runs = [(c, len(list(g))) for c, g in itertools.groupby(unit.lower())]
        ways = itertools.product(*[decoder._readings(c, n) for c, n in [*runs, ("\n", 1)]])
        best = min(ways, key=cost)
        assert decoder._decode(unit) == " ".join("".join(r for r, _ in best).split()), unit


def test_decoder_takes_long_units_in_proportion():
    model = np.log(np.full((32, 32, 32), 1 / 32))
    decoder = toxicity.Restorer(model)
    start = time.process_time()
    short = decoder("a1b0.c" * 5_000)
    middle = time.process_time()
    long = decoder("a1b0.c" * 50_000)
    assert len(long) == 10 * len(short) and long.startswith(short[:20_000])
    # Ten times the length; a path copied at each step would take a hundred times.
    assert time.process_time() - middle < 40 * (middle - start)


def test_lines_are_sorted_where_they_lie(spark):
    lines = spark.createDataFrame(
        [(h, h, d, p) for h in range(50) for d in range(9) for p in (4, 2) if (h + d) % 3], "h1 long, h2 long, doc long, pos int")
    firsts = line_dedup.first_occurrences(lines, 5)
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Sort [h1" in plan and plan.count("Exchange ") == plan.count("Exchange rangepartitioning") == 1
    rows = [tuple(r) for part in firsts.rdd.glom().collect() for r in part]
    assert rows == sorted({(r.h1, r.h2, r.doc) for r in lines.collect()})


@pytest.mark.parametrize("digits", [8, 1])
def test_urls(spark, monkeypatch, digits):
    # With one digit nearly all expressions meet rules that are not theirs.
    monkeypatch.setattr(url_filter, "PREFIX_DIGITS", digits)
    urls = [None, "", "no scheme", "http://A.Example.org/es/x?y#z", "https://example.org/en/12", "ftp://x.com/fr/", "x://com",
            "http://b.com/de/1", "http://com/de/1", "http://badexample.org/es/", "http://h.net/p", "http://q.org?/es/", "://org/a://b",
            "http://o.org/line\nbreak"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[3], "h"), (3, urls[3], "h")],
                                  "page_id long, url string, host string")
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"),
             ("b.com", "/d", "allow"), ("b.com", "/de", "block"), (None, "/", "block")]
    rows = url_filter.judge_urls(pages, url_filter.rules_table(pages, rules)).collect()
    assert len(rows) == len(urls) + 2

    def brute(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host):])[0]
            host = host.translate(LOWER)
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
                if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[3:] if fits else (None, "allow")))
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[3] if r.page_id is None else urls[r.page_id])
    assert {r.verdict for r in url_filter.judge_urls(pages, url_filter.rules_table(pages, rules).filter("false")).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.filter("false"), url_filter.rules_table(pages, rules)).count() == 0
    plan = url_filter.judge_urls(pages, url_filter.rules_table(pages, rules))._jdf.queryExecution().sparkPlan().toString()
    keys = re.findall(r"Join \[([^\]]*)\], \[([^\]]*)\]", plan)
    assert [[k.split("#")[0] for k in pair] for pair in keys] == [["prefix", "rule_prefix"]]


# --- shards

def test_shards(spark, odd_docs, no_docs):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(200) if i % 3 else "same text", "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sharding.shard(docs, 7).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.03 * sum(sizes.values()) / 7
    by_id = {r.doc_id: r for r in got}
    for i, text, *_ in rows:
        assert by_id[i]["size"] == len(text) + 16 and by_id[i].text_crc32 == zlib.crc32(text.encode())
    odd = sharding.shard(odd_docs, 3).collect()
    assert len(odd) == odd_docs.count() and {r["size"] for r in odd if r.doc_id == 1} == {16}
    assert sharding.shard(no_docs).count() == 0


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(50)], DOCS)
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


# --- chats

def test_chats(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "[ROLE]x[/ROLE]", "<s></s>", "[", "<", None, "", "a\nb"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 1, "user", "u"), (None, 0, None, "x"), (3, None, "tool [/ROLE]", "</s>")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("q"))
    made = chat_format.format_chats(table)
    got = {r.conv_id: r for r in made.select("*", chat_format.read_turns(F.col("formatted")).alias("back"),
                                             chat_format.read_loss(F.col("segments")).alias("lost")).collect()}
    for conv in (1, 2, 3, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in got[conv].back] == [(r or "", t or "") for _, _, r, t in own]
        assert got[conv].lost == "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[conv].formatted == "".join(s.text for s in got[conv].segments)
    assert [got[c].valid for c in (1, 2, 3, None)] == [True, False, False, False]
    assert chat_format.format_chats(table.filter("false")).count() == 0


# --- search

def test_top_k(spark):
    rng = random.Random(10)
    rows = [(i, [rng.uniform(-1, 1) if rng.random() < 0.6 else 0.0 for _ in range(8)]) for i in range(300)]
    rows += [(301, None), (302, [None] * 8), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8),
             (100, rows[7][1]), (305, rows[50][1]), (306, []), (350, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in topk_search.top_k(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v in rows
             if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all()]
    for q in {i for i, _ in whole if i % 50 == 0}:
        best = {}
        for own in (v for i, v in whole if i == q):
            for i, v in whole:
                if i != q:
                    best[i] = max(best.get(i, -10 ** 9), int(own @ v))
        assert got[q] == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert 350 not in got and topk_search.top_k(table.filter("false"), F.lit(True)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [70_000.0, 1.0]), (1, [80_000.0, 0.0]), (2, [90_000.0, -1.0]), (3, [8e6, 0.0]), (4, [9e6, 5.0]), (5, [-1e5, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk_search.top_k(table, F.col("vec_id") == 0).orderBy("rank").collect()]
    whole = {i: [int(np.floor(x * 256)) for x in v] for i, v in rows}
    best = {i: sum(a * b for a, b in zip(whole[0], v)) for i, v in whole.items() if i}
    assert got == sorted(best.items(), key=lambda x: (-x[1], x[0]))
    large = np.array([[1 << 40, 1 << 40], [3, 5]])
    assert topk_search._exact(large, np.array([[1 << 22, 7 - (1 << 22)]])).tolist() == [[7 << 40, 35 - (2 << 22)]]
    for x, y in (([1 << 40], [1 << 40]), ([1 << 62], [2])):
        with pytest.raises(OverflowError):
            topk_search._exact(np.array([x]), np.array([y]))


def test_scatter_equals_product():
    rng = np.random.default_rng(3)
    q = rng.integers(-5, 5, (7, 12)) * (rng.random((7, 12)) < 0.4)
    c = rng.integers(-5, 5, (90, 12)) * (rng.random((90, 12)) < 0.4)
    assert (topk_search._scores(q, c) == c @ q.T).all()


def test_samples_take_a_share_of_each_value_and_all_of_rare_ones(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "a").when(F.col("id") < 100, "b").when(F.col("id") < 19_000, "c").alias("lang"),
        F.xxhash64("id").alias("draw"), F.lit(1).alias("_other"))
    taken = {r.lang: r.n for r in samples.sampled(rows, "lang", "draw", 500).groupBy("lang").agg(
        F.count("*").alias("n")).collect()}
    assert taken["b"] == 50 and 400 < taken["a"] < 600 and 400 < taken["c"] < 600 and set(taken) == {"a", "b", "c"}
    assert samples.sampled(rows.filter("false"), "lang", "draw", 500).count() == 0


def test_samples_rank_nothing(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("lang"), F.xxhash64("id").alias("draw"))
    assert "Window" not in samples.sampled(rows, "lang", "draw", 10)._jdf.queryExecution().toString()
