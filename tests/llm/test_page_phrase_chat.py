"""Main text of pages, phrases and repaired conversations against brute force, and on odd inputs."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickerloom.llm import chat_repair, collocations, html_extract

CHATS = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, html string"
DOCS = "doc_id long, lang string, text string"


# Pages


def cut_cost(terminal, edges, labels):
    wrong = sum(t if t > 0 and not kept else -t if t < 0 and kept else 0 for t, kept in zip(terminal, labels))
    return wrong + sum(c for i, e in enumerate(edges) for j, c in e.items() if j < i and labels[i] != labels[j])


def test_minimum_cut_is_the_least_of_all_labellings():
    rng = random.Random(11)
    for _ in range(150):
        n = rng.randrange(0, 9)
        terminal = [rng.randrange(-6, 7) for _ in range(n)]
        edges = [{} for _ in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                edges[i][j] = edges[j][i] = rng.randrange(0, 5)
        least = min(cut_cost(terminal, edges, labels) for labels in itertools.product((False, True), repeat=n))
        assert cut_cost(terminal, edges, html_extract.minimum_cut(terminal, edges)) == least


LONG = "A paragraph of more than ten words, so that it looks like prose, really."

CASES = {
    "plain article": ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>Of.</p><p>a<b>b</b> &amp; c</p></article>", "T\nOf.\nab & c"),
    "advert inside": (f"<div id=content><h1>T</h1><div class=ad>{LONG}</div><p>{LONG}</p></div>", f"T\n{LONG}"),
    "comments as articles": (f"<main><p>{LONG}</p></main><section id=comments><article><p>{LONG}</p></article></section>", LONG),
    "form, aside, notice": (f"<article><p>{LONG}</p></article><form><p>{LONG}</p></form><aside>{LONG}</aside>"
                            f"<div class='cookie-notice'>{LONG}</div>", LONG),
    "headers": (f"<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T\n{LONG}"),
    "no landmark": (f"<ul><li><a>One</a><li><a>Two</a></ul><div><h2>A longer title</h2>{LONG}<p>Short.<p>{LONG}</div>",
                    f"A longer title\n{LONG}\nShort.\n{LONG}"),
    "script and comment": ("<article><script>var p='</p><p>x';</script><!-- <p>y</p> --><p>One two three.</p></article>", "One two three."),
    "open elements": ("<article><p><b>One two three.<br><p>Four\n\t five  six.", "One two three.\nFour five six."),
    "cut off tag": ("<article><p>a < b is so.<p clas", "a < b is so."),
    "hidden": (f"<article><p hidden>{LONG}</p><p style='display: none'>{LONG}</p><p>x y z.</p></article>", "x y z."),
    "references": ("<article><p>&eacute;&#233;&#xe9; &amp &am &nosuch; caf&eacute</p></article>", "ééé & &am &nosuch; café"),
    "sidebar in a name": (f"<div class='content with-sidebar'><p>{LONG}</p></div>", LONG),
}


@pytest.mark.parametrize("case", CASES)
def test_main_text_of(case):
    page, text = CASES[case]
    assert html_extract.main_text(page)[0] == text


def test_pages_of_any_shape_take_linear_time():
    rng = random.Random(5)
    for page in ("<a \"" * 50_000, "<" * 200_000, "<!-- " * 50_000, "<p x=\" " * 20_001, "<div>" * 20_000 + "x",
                 "".join("<p>" + ("w " * 3 if rng.random() < 0.5 else f"<a>{LONG}</a>") for _ in range(20_000))):
        html_extract.main_text(page)


def test_extract_text_keeps_rows_and_replaces_columns(spark):
    long = "".join(f"<p>Paragraph number {i} of a very long page, and nothing else.</p>" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, CASES["plain article"][0]), (4, CASES["plain article"][0]),
            (None, "just a text of some words."), (5, f"<article>{long}</article>")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "'x' AS n_chars", "2 AS n_blocks", "3 AS __html_")
    got = html_extract.extract_text(pages).select("page_id", "text", "n_chars", "__html_").collect()
    assert len(got) == len(rows) and all(len(r.text) == r.n_chars and r["__html_"] == 3 for r in got)
    found = {(r.page_id, r.text) for r in got if r.page_id != 5}
    assert found == {(1, ""), (2, ""), (3, ""), (4, "T\nOf.\nab & c"), (None, "just a text of some words.")}
    assert [r.text.count("\n") for r in got if r.page_id == 5] == [19_999]
    assert html_extract.extract_text(spark.createDataFrame([], PAGES)).count() == 0


# Phrases


def brute_collocations(rows, top, min_count, max_words=4, covered=80):
    counts, totals = {}, Counter()
    for lang, text in rows:
        text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        of = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, max_words + 1):
                of.update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inside = {p[i:i + m] for p, b in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                  if 100 * b >= covered * cand[p[i:i + m]]}
        made = []
        for p, a in cand.items():
            if p not in inside:
                s, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                made.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(made)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def found_collocations(docs, **limits):
    return sorted(tuple(r) for r in collocations.collocations(docs, **limits).drop("k").collect())


def test_collocations_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["New", "york", "city", "the", "of", "Ünï", "a-b", "x\x01", "\U0001F600", "é"]
    rows = []
    for i in range(300):
        said = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", ",", ":"]) for _ in range(rng.randrange(40)))
        rows.append((i, rng.choice(["en", "de", None]), rng.choice([said, said + " new york city hall", "New York New York"])))
    rows += [(1, "en", None), (2, None, ""), (3, "fr", " \t "), (4, "en", rows[0][2]), (None, "en", rows[0][2])]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS phrase", "2 AS f", "'x' AS word", "3 AS head", "4 AS n")
    plain = [(lang, text) for _, lang, text in rows]
    for limits in ({"min_count": 5, "top": 1000}, {"min_count": 3, "top": 20}):
        assert found_collocations(docs, **limits) == brute_collocations(plain, limits["top"], limits["min_count"])


def test_collocations_of_long_texts_and_no_rows(spark, monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["one", "two", "three", "four."]) for _ in range(60_000))
    endless = " ".join(rng.choice(["one", "two", "three"]) for _ in range(20_000))
    monkeypatch.setattr(collocations, "CHUNK", 1 << 14)
    assert "".join(collocations._stretches(text)) == text and len(list(collocations._stretches(text))) > 10
    assert list(collocations._stretches(endless)) == [endless]
    rows = [(1, "en", text), (2, "en", endless)]
    got = found_collocations(spark.createDataFrame(rows, DOCS))
    assert got == brute_collocations([r[1:] for r in rows], 2000, 30)
    assert found_collocations(spark.createDataFrame([], DOCS)) == []


def test_counts_are_merged_not_hashed(spark):
    docs = spark.createDataFrame([(1, "en", "a b c. " * 40)], DOCS)
    plan = collocations.collocations(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 3


# Conversations


def brute_edits(rows):
    """Least (cost, letters, turns) of all edits; rows are (role, text, must go, broken)."""
    best = {}

    def after(state, initial):
        if initial == "s":
            return "s" if state == "" else None
        if initial == "u":
            return "u" if state in ("", "s", "a") else None
        return "a" if initial == "a" and state == "u" else None

    def walk(i, state, cost, letters, turns, inserted):
        key = (cost, letters)
        if i == len(rows) and state in ("", "a"):
            if not best or key < best["key"]:
                best.update(key=key, turns=turns)
        if inserted < 3:
            for role in ("user", "assistant"):
                if to := after(state, role[0]):
                    walk(i, to, cost + 2, letters + "I", turns + [f"{role}:"], inserted + 1)
        if i == len(rows):
            return
        role, text, gone, broken = rows[i]
        walk(i + 1, state, cost + 3, letters + "D", turns, 0)
        if not gone:
            if to := after(state, role[:1]):
                walk(i + 1, to, cost + broken, letters + "K", turns + [f"{role}:{text}"], 0)
            for new in ("user", "assistant"):
                if to := after(state, new[0]):
                    walk(i + 1, to, cost + 2 + broken, letters + "R", turns + [f"{new}:{text}"], 0)

    walk(0, "", 0, "", [], 0)
    return best["key"][0], best["key"][1], best["turns"]


def brute_repair(rows):
    """``rows`` of one conversation: (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, coded, counts = set(), [], Counter()
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        coded.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, said = brute_edits(coded)
    digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit), digest, said


def test_repairs_equal_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for conv in [*range(120), None]:
        for _ in range(rng.randrange(1, 6)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                         rng.choice(["Yes.", "No!", "so", "", " \n", None, "ok?", "well. ", "Hm"])))
    chats = spark.createDataFrame(rows, CHATS).selectExpr("*", "1 AS conv", "'x' AS digest", "2 AS code", "3 AS audit", "4 AS present")
    got = {r.conv_id: r for r in chat_repair.repair_digests(chats).collect()}
    turns = {}
    for r in chat_repair.repair(chats).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert len(turns[r.conv_id]) == r.place + 1 and r.edit in "KRI"
    assert len(got) == 121
    for conv, found in got.items():
        counts, digest, said = brute_repair([r[1:] for r in rows if r[0] == conv])
        assert tuple(found[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == counts
        assert found.repaired_sha256 == digest and turns.get(conv, []) == said


def test_checkpoints_give_the_walk_of_whole_tables():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 4, 5, 15, 16, 17, 100, 1000):
        codes = bytes(rng.choice([0, 1, 2, 3, 2, 3, 4, 6, 7, 10, 11]) for _ in range(n))
        vectors = [chat_repair._END]
        for code in reversed(codes):
            vectors.append(chat_repair._back(code, vectors[-1]))
        vectors.reverse()
        state, letters = chat_repair.START, []
        for i, code in enumerate(codes):
            state = chat_repair._walk(code, vectors[i], vectors[i + 1], state, letters)
        while state in (chat_repair.SYSTEM, chat_repair.USER):
            letters.append("I")
            state = chat_repair._NEXT[state]
        assert chat_repair.cheapest_edits(codes) == (vectors[0][0], "".join(letters))


def test_long_conversations_and_texts(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Said {i}.") for i in range(5000)]
    rows += [(2, 0, "user", "word " * 400_000 + "."), (2, 1, "assistant", "Yes.")]
    got = {r.conv_id: r for r in chat_repair.repair_digests(spark.createDataFrame(rows, CHATS)).collect()}
    assert got[1].audit == "K" * 5000 and got[1].cost == 0 and got[2].audit == "KK"
    said = "\n".join(f"{r}:{t}" for c, _, r, t in rows if c == 2)
    assert got[2].repaired_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_damage_and_conversations_without_rows(spark):
    assert chat_repair.repair_digests(spark.createDataFrame([], CHATS)).count() == 0
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in (0, 1)] + [(None, None, None, None)]
    damaged = chat_repair.damaged(spark.createDataFrame(rows, CHATS))
    import zlib

    def key(c, t):
        return zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20

    want = Counter()
    for c, t, role, text in rows:
        way = key(c, t)
        role, text = role or " ", text if text is not None else " "
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        want[(c, t, "user" if way == 4 else role, text, way != 0)] += 2 if way == 3 else 1
    assert Counter(tuple(r) for r in damaged.collect()) == want
    gone = damaged.withColumn("present", F.lit(False))
    for r in chat_repair.repair_digests(gone, present=F.col("present")).collect():
        assert (r.cost, r.audit, r.gaps, r.repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest())
