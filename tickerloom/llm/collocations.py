"""Phrases of words that belong together, scored by exact counts of them and of their parts.

Two passes over the texts make the counts.  The first counts words, and hashes of pairs; a
pair's hash is as common as the pair at least, so hashes below the least count rule pairs
out.  The second counts phrases of two words and more none of whose pairs is ruled out, by
their texts, exactly.  A sieve of fixed size tells it the pairs; once full it rules out less,
which costs time and changes no result.

The common phrases form count streams in prefix order (by language and phrase) and in suffix
order (by language and last words).  Counts of first and last parts, and of the commonest
extension by a word on either side, come from sorted streams that are merged in step; no
stream is held in a hash table.  A phrase inside a longer one is inside a one-word extension
of its own that is at least as common, so extensions by one word decide which ones go.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.batches import Batches, map_batches
from tickerloom.llm.text_units import Hasher, chunks, lay_out, lower_ascii, mix, runs
from tickerloom.plans.stored import stored

MIN_COUNT, MAX_WORDS, TOP, COVERED = 30, 4, 2000, 80
#: Bits of the sieve of common pairs (4 MB).
SIEVE_BITS = 25
#: Code points that a task works on at once; pair hashes that it gathers before it sums them up.
CHUNK, HELD = 1 << 20, 1 << 21

_SEPARATORS = re.compile(r"[.,;:!?\x0A-\x0D]")
_IS_SEPARATOR = np.zeros(128, bool)
_IS_SEPARATOR[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_IS_BLANK = np.zeros(128, bool)
_IS_BLANK[[32, 9]] = True


def _stretches(text: str) -> Iterator[str]:
    """A text, a very long one in parts that end at separators."""
    start = 0
    while len(text) - start > CHUNK and (cut := _SEPARATORS.search(text, start + CHUNK)):
        yield text[start:cut.end()]
        start = cut.end()
    yield text[start:] if start else text


class _Words:
    """The words of some texts of one language, laid out with one blank behind each."""

    def __init__(self, texts: list[str]) -> None:
        cp, bounds = lay_out(texts)
        cp = lower_ascii(cp)
        ascii_cp = np.minimum(cp, 127)
        parts = _IS_SEPARATOR[ascii_cp]
        inside = ~(parts | _IS_BLANK[ascii_cp])
        start, end = runs(inside, bounds)
        length = end - start
        places = np.arange(length.sum()) + np.repeat(np.arange(len(start)), length)
        self.cp = np.full(int(length.sum()) + len(start), 32, np.uint32)
        self.cp[places] = cp[inside]
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length
        # A word and the next are of one piece if no separator and no end of a text lies between them.
        before = np.cumsum(parts)
        text = np.searchsorted(bounds, start, side="right")
        self.joined = (text[1:] == text[:-1]) & (before[start[1:]] == before[start[:-1]]) if len(start) else np.zeros(0, bool)
        self.text = self.cp.tobytes().decode("utf-32-le", "surrogatepass")

    def words(self) -> list[str]:
        return self.text.split(" ")[:-1]

    def pairs(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        """First words of all pairs, and the pairs' hashes."""
        first = np.flatnonzero(self.joined)
        salt = int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return first, mix(Hasher(self.cp).of(self.start[first], self.end[first + 1]) ^ np.uint64(salt))

    def phrases(self, first: np.ndarray, n: int) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(self.start[first].tolist(), self.end[first + n - 1].tolist())]


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, _Words]]:
    texts: dict[str, list[str]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        if text:
            texts.setdefault(lang, []).extend(_stretches(text))
    for lang, said in texts.items():
        for first, last in chunks(np.array([len(t) for t in said]), CHUNK):
            yield lang, _Words(said[first:last])


def _counted(lang: str, values: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
    found = pc.value_counts(pa.array(values, pa.string()))
    return pa.array([lang] * len(found), pa.string()), found.field("values"), found.field("counts").cast(pa.int64())


_FIRST = pa.schema([("lang", pa.string()), ("word", pa.string()), ("pair", pa.int64()), ("c", pa.int64())])
_SECOND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())])


def _words_and_pairs(batches: Batches) -> Batches:
    held, size = [], 0

    def sums() -> pa.RecordBatch:
        names, counts = np.unique(np.concatenate(held), return_counts=True)
        none = pa.nulls(len(names), pa.string())
        return pa.RecordBatch.from_arrays([none, none, pa.array(names.view(np.int64)), pa.array(counts)], schema=_FIRST)

    for batch in batches:
        for lang, words in _by_language(batch):
            langs, values, counts = _counted(lang, words.words())
            yield pa.RecordBatch.from_arrays([langs, values, pa.nulls(len(langs), pa.int64()), counts], schema=_FIRST)
            names = words.pairs(lang)[1]
            held.append(names)
            size += len(names)
            if size >= HELD:
                yield sums()
                held, size = [], 0
    if size:
        yield sums()


def _sieve(pairs: DataFrame) -> np.ndarray:
    """Marks of the hashes' first bits; at most ``2 ** SIEVE_BITS`` of them reach the driver, packed."""
    mark = F.shiftrightunsigned("pair", 64 - SIEVE_BITS)
    packed = pairs.select(F.shiftright(mark, 6).cast("int").alias("at"), F.expr(
        f"shiftleft(1L, cast(shiftrightunsigned(pair, {64 - SIEVE_BITS}) & 63 as int))").alias("bit")).groupBy("at").agg(
            F.bit_or("bit").alias("bits")).toPandas()
    marks = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    marks[packed["at"].to_numpy()] = packed["bits"].to_numpy(np.int64).view(np.uint64)
    return marks


def _marked(marks: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = names >> np.uint64(64 - SIEVE_BITS)
    return (marks[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def common_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text_col: str = "text",
                   lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of 1 to ``max_words`` words that occur ``min_count`` times; ``lang, n`` of all words."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                         F.col(text_col).cast("string").alias("text"))
    first = map_batches(source, _words_and_pairs, "lang string, word string, pair long, c long").groupBy(
        "lang", "word", "pair").agg(F.sum("c").alias("f"))
    # Pairs that are too rare are most of the rows; all words stay, for the number of words.
    first = stored(first.filter(F.col("word").isNotNull() | (F.col("f") >= min_count)), "words_and_pairs")
    marks = spark.sparkContext.broadcast(_sieve(first.filter("word IS NULL").select("pair")))

    def count(batches: Batches) -> Batches:
        for batch in batches:
            for lang, words in _by_language(batch):
                pairs, names = words.pairs(lang)
                common = np.zeros(len(words.start) + max_words, bool)
                common[pairs] = _marked(marks.value, names)
                phrases: list[str] = []
                at = np.flatnonzero(common)
                for n in range(2, max_words + 1):
                    phrases.extend(words.phrases(at, n))
                    at = at[common[at + n - 1]]
                if phrases:
                    yield pa.RecordBatch.from_arrays(list(_counted(lang, phrases)), schema=_SECOND)

    longer = map_batches(source, count, "lang string, phrase string, c long").groupBy("lang", "phrase").agg(
        F.sum("c").alias("f")).filter(F.col("f") >= min_count)
    words = first.filter("word IS NOT NULL")
    single = words.filter(F.col("f") >= min_count).select("lang", F.col("word").alias("phrase"), "f")
    sized = single.unionByName(longer).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f")
    return stored(sized, "common_phrases"), words.groupBy("lang").agg(F.sum("f").alias("n"))


def _part(start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 covered: int = COVERED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score, k``.

    Texts, with A-Z in lower case, are split at ``. , ; : ! ?`` and line ends into pieces and
    those at blanks and tabs into words.  A candidate is a phrase of 2 to ``max_words`` words
    of one piece that occurs ``a >= min_count`` times in its language, overlaps included.  Cut
    behind ``k`` words into parts that occur ``l`` and ``r`` times it scores
    ``floor(2000000 * a / (l + r))``; the least score of all cuts counts, the first of equal
    ones.  Candidates inside a longer one that occurs at least ``covered`` percent as often go.
    Ranks are by score, then ``a``, both descending, then by the phrase's bytes.

    A null language is ``und``, a null or empty text has no words, rows are counted as often
    as they occur, and a language without candidates has no rows; neither has an empty table.
    Other columns are not read.
    """
    phrases, totals = common_phrases(docs, min_count, max_words, text_col, lang_col)
    candidates = phrases.filter("words > 1")
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")).hint("merge")
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")).hint("merge")
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"),
                             F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", _part(1, F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    score = F.expr("cast((cast(a AS decimal(27, 0)) * 2000000) div (cast(l AS decimal(27, 0)) + r) AS long)")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select(
        "lang", "phrase", "cut.*")
    longer = phrases.filter("words > 2").select("lang", "f", F.explode(F.array(
        _part(1, F.col("words") - 1), _part(2, F.col("words") - 1))).alias("phrase")).groupBy("lang", "phrase").agg(
            F.max("f").alias("extension")).hint("merge")
    kept = worst.join(longer, ["lang", "phrase"], "left").filter(
        F.expr(f"extension IS NULL OR cast(extension AS decimal(27, 0)) * 100 < cast(a AS decimal(27, 0)) * {int(covered)}"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.select("*", F.row_number().over(order).cast("long").alias("rank")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")
