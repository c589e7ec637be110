"""Toxicity of whole texts, scored on text restored from disguise.

A unit of text is a noisy form of words: letters may be written as similar digits and
signs, repeated, set apart by blanks or split by signs.  ``Restorer`` finds the likeliest
words behind a unit: a Viterbi search through the lattice of all readings of its
characters, under a character trigram model counted over all documents.

The classifier scores restored words and their beginnings, by the smoothed share of toxic
ones among the places where they occur.  Places count once for each different word before
them, so that copies of a text teach no more than one.  Features of at least ``PLACES``
toxic places stand for themselves; a toxic text without any of them gives its credit to
the best of its other features.  Words known from clean texts are exceptions to strong
beginnings.  A word scores by the longest feature known of it, a text as its worst word.

All readings of a word share a skeleton (similar signs as one, repetitions once, signs in between
dropped).  A word of a unit starts at the unit's start, after a sign that is always read as a
blank or after one that may be, and ends alike.  A unit is decoded only if the skeleton of a
feature equals that of such a stretch or begins it, so the pass over the corpus runs on arrays;
the result is the same as decoding all units.
Texts are never shuffled.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import text_units as units
from tickerloom.llm.batches import Batches, map_batches, texts_of
from tickerloom.llm.decontaminate import Sieve
from tickerloom.llm.samples import sampled
from tickerloom.plans.stored import stored

#: The classifier is fitted on about so many labelled texts of each label at most, chosen by a hash of their ids.
SAMPLE = 20_000
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6, 7)
#: Texts that the base rate counts for in a feature's score.
PRIOR = 4
#: Different places that make a feature strong, and its least share of toxic ones.
PLACES = 8
SHARE = 0.8
THRESHOLD = 0.3
SINGLES = 3

# Signs and the letters they stand for.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "+": "t", "|": "il", "€": "e", "£": "l",
}
# Signs that may stand between the letters of a word.
DROPPED = ".-_*'~"
# Signs that always end a unit, as blanks do.
SEPARATORS = ",;:?\"()[]{}<>/\\&=%#^`"

# Costs of readings, in natural logarithms of odds.
_COST_SIGN, _COST_DROP, _COST_SQUEEZE, _COST_LONG, _COST_BREAK = 1.0, 0.5, 2.5, 0.5, 8.0

_ALPHABET = 32
#: Bits of a feature's checksum that the sieve of candidates looks at.
_MARK_BITS = 24


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: model class, skeleton, part of a unit, letter, always read as a blank."""
    n = units.CODE_POINTS
    model = np.zeros(n, np.int64)
    skeleton = np.zeros(n, np.uint32)
    letter = np.zeros(n, bool)
    inside = np.ones(n, bool)
    blank = np.zeros(n, bool)
    # A sign that stands for two letters makes them one in a skeleton.
    stands = {c: letters[0] for letters in SIGNS.values() if len(letters) > 1 for c in letters}
    for c in range(n):
        char = chr(c)
        if unicodedata.category(char)[0] == "L":
            low = char.lower()[0]
            letter[c] = True
            model[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + c % 5
            # A last sigma is written in two ways, by what follows.
            skeleton[c] = ord(stands.get(low, "σ" if low == "ς" else low))
            # Lower case of one letter (İ) is two signs, and the second is no letter.
            blank[c] = len(char.lower()) > 1
        else:
            blank[c] = char not in SIGNS and char not in DROPPED
        if not letter[c] and (char.isspace() or char in SEPARATORS):
            inside[c] = False
    for sign, letters in SIGNS.items():
        skeleton[ord(sign)] = ord(stands.get(letters[0], letters[0]))
    return model, skeleton, inside, letter, blank


def _class(char: str) -> int:
    return int(_tables()[0][ord(char)])


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of three characters in a row; everything but letters is one boundary."""
    total = np.zeros(_ALPHABET ** 3, np.int64)
    for first, last in units.chunks(np.array([len(t) for t in texts], np.int64)):
        cp, _ = units.lay_out([x for t in texts[first:last] for x in ("  ", t)] + ["  "])
        c = _tables()[0][cp]
        code = (c[:-2] * _ALPHABET + c[1:-1]) * _ALPHABET + c[2:]
        total += np.bincount(code[(c[1:-1] > 0) | (c[2:] > 0)], minlength=len(total))
    return total


def language_model(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the probability of a character after two others."""
    cube = counts.reshape(_ALPHABET, _ALPHABET, _ALPHABET).astype(float)
    pairs = cube.sum(axis=0) + 0.1
    pairs /= pairs.sum(axis=1, keepdims=True)
    return np.log((cube + 5 * pairs[None]) / (cube.sum(axis=2, keepdims=True) + 5))


#: Steps after which the last readings of a path become one piece, and the longest unit whose words are remembered.
_FOLD_STEPS = 4096
_SEEN_CHARS = 1000


def _folded(path: tuple | None) -> tuple | None:
    """The path with its readings since the last long piece as one piece, marked by a third field."""
    pieces = []
    while path is not None and len(path) == 2:
        pieces.append(path[1])
        path = path[0]
    return (path, "".join(reversed(pieces)), True) if pieces else path


def _path_text(path: tuple | None) -> str:
    pieces = []
    while path is not None:
        pieces.append(path[1])
        path = path[0]
    return "".join(reversed(pieces))


class Restorer:
    """The likeliest words behind a unit."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()
        self.seen: dict[str, str] = {}

    def _readings(self, char: str, times: int) -> list[tuple[str, float]]:
        """What a character that is repeated so many times may stand for; a blank is a word's end."""
        if char == " ":
            return [("", 0.0), (" ", _COST_DROP)]
        if char in SIGNS:
            found = [(c * k, _COST_SIGN + 0.5 * (k - 1)) for c in SIGNS[char] for k in range(1, min(times, 2) + 1)]
            return [*found, (" ", _COST_BREAK)]
        if not _tables()[3][ord(char)]:
            return [("", _COST_DROP)] if char in DROPPED else [(" ", 0.0)]
        if times == 1:
            return [(char, 0.0)]
        if times == 2:
            return [(char * 2, 0.0), (char, _COST_SQUEEZE)]
        return [(char, _COST_LONG), (char * 2, 2 * _COST_LONG)]

    def _decode(self, unit: str) -> str:
        chars: list[tuple[str, int]] = []
        for c in unit.lower():
            if chars and chars[-1][0] == c:
                chars[-1] = (c, chars[-1][1] + 1)
            else:
                chars.append((c, 1))
        # A path points back to the one it goes on from, so a step costs the same at any length.
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for step, (char, times) in enumerate([*chars, ("\n", 1)], 1):
            found: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                for reading, price in self._readings(char, times):
                    x, y, total = a, b, cost + price
                    for c in reading:
                        z = _class(c)
                        if z or y:
                            total -= self.model[x][y][z]
                            x, y = (y, z) if z else (0, 0)
                    if (x, y) not in found or total < found[x, y][0]:
                        found[x, y] = (total, (path, reading) if reading else path)
            best = found
            if step % _FOLD_STEPS == 0:
                best = {state: (cost, _folded(path)) for state, (cost, path) in best.items()}
        least = min(cost for cost, _ in best.values())
        return " ".join(min(_path_text(path) for cost, path in best.values() if cost == least).split())

    def __call__(self, unit: str) -> str:
        """Words in lower case, with one blank between them."""
        low = unit.lower()
        if low.isalpha() and all(a != b for a, b in zip(low, low[1:])):
            return low
        if len(unit) > _SEEN_CHARS:
            return self._decode(unit)
        if unit not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[unit] = self._decode(unit)
        return self.seen[unit]


def word_features(word: str) -> list[str]:
    """A word, and its beginnings (marked by a last ``~``), longest first."""
    return [word, *(word[:k] + "~" for k in reversed(BEGINNINGS) if len(word) >= k)]


def features(words: str) -> Iterator[str]:
    for word in words.split(" "):
        if word:
            yield from word_features(word)


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, text bounds, starts and ends of units; then runs of units of one sign are added as one."""
    cp, bounds = units.lay_out(texts)
    start, end = units.runs(_tables()[2][cp], bounds)
    return cp, bounds, start, end


def _spaced(cp: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of single signs set apart by one blank each."""
    single = (end - start == 1) & (_tables()[1][cp[start]] > 0)
    follows = np.zeros(len(start), bool)
    follows[1:] = single[1:] & single[:-1] & (start[1:] == end[:-1] + 1)
    text = np.searchsorted(bounds, start, side="right")
    follows[1:] &= text[1:] == text[:-1]
    first = single & ~follows
    last = single.copy()
    last[:-1] &= ~follows[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    long = b - a + 1 >= SINGLES
    return start[a[long]], end[b[long]]


def forms(unit: str) -> set[str]:
    """A unit with and without the signs at its ends."""
    return {unit, unit.strip(DROPPED + "!"), unit.strip("".join(SIGNS) + "2" + DROPPED)} - {""}


class Scorer:
    """Scores of whole texts under a fitted model."""

    def __init__(self, model: dict) -> None:
        self.restore = Restorer(model["characters"])
        self.scores: dict[str, float] = model["features"]
        self.base: float = model["base"]
        whole, parts = set(), {}
        for feature in self.scores:
            own = skeleton(feature.removesuffix("~"))
            if feature.endswith("~"):
                parts.setdefault(len(own), set()).add(own)
            else:
                whole.add(own)
        self.lengths = sorted({len(f) for f in self.scores if not f.endswith("~") and len(f) >= SINGLES})
        self.sizes = sorted({len(w) for w in whole})
        self.whole = Sieve(_names(whole))
        self.parts = {n: Sieve(_names(p)) for n, p in parts.items()}

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        for first, last in units.chunks(np.array([len(t) for t in texts], np.int64)):
            own = texts[first:last]
            cp, bounds, start, end = _cut(own)
            a, b = self._suspects(cp, start, end)
            more_a, more_b = _spaced(cp, bounds, start, end)
            a, b = np.concatenate((a, more_a)), np.concatenate((b, more_b))
            joined = "".join(own)
            text = np.searchsorted(bounds, a, side="right") - 1 + first
            for i, j, t in zip(a.tolist(), b.tolist(), text.tolist()):
                out[t] = max(out[t], self._worst(joined[i:j]))
        return out

    def _worst(self, unit: str) -> float:
        """Of all words that a unit may hold; in letters set apart, words may begin anywhere."""
        found = [next((self.scores[f] for f in word_features(word) if f in self.scores), 0.0)
                 for form in forms(unit) for word in self.restore(form).split(" ")]
        if " " in unit:
            joined = self.restore(unit.replace(" ", "")).replace(" ", "")
            found += [self.scores.get(joined[a: a + n], 0.0) for n in self.lengths for a in range(len(joined) - n + 1)]
        return max(found, default=0.0)

    def _suspects(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units with a stretch, between ends and signs that may be blanks, whose skeleton is or begins like a feature's."""
        _, shape, inside, letter, blank = _tables()
        values = shape[cp]
        at = np.flatnonzero(inside[cp] & (values > 0))
        found = np.zeros(len(start), bool)
        if not len(at):
            return start[found], end[found]
        own, unit = values[at], np.searchsorted(start, at, side="right") - 1
        # A part lies between signs that are blanks always; a letter read as itself and a blank ends one.
        part = unit + np.cumsum(blank[cp])[at] - blank[cp[at]]
        opens = np.ones(len(at), bool)
        opens[1:] = part[1:] != part[:-1]
        new = opens.copy()
        new[1:] |= own[1:] != own[:-1]
        run = np.cumsum(new) - 1
        sign = ~letter[cp[at]]
        may_start, may_end = opens.copy(), np.ones(len(at), bool)
        may_start[1:] |= sign[:-1]
        may_end[:-1] = opens[1:] | sign[1:]
        hasher = units.Hasher(own[new])
        number = np.cumsum(opens) - 1
        last = np.append(np.flatnonzero(opens)[1:], len(at)) - 1
        first = np.flatnonzero(may_start)
        a, b = run[first], run[last[number[first]]] + 1

        def mark(which: np.ndarray, stop: np.ndarray, sieve: Sieve) -> None:
            found[unit[first[which[sieve.find(hasher.of(a[which], stop))[0]]]]] = True

        mark(np.arange(len(first)), b, self.whole)
        for n, sieve in self.parts.items():
            long = np.flatnonzero(b - a >= n)
            mark(long, a[long] + n, sieve)
        # Ends inside a part, after a run of equal signs, by the lengths of features.
        ends = np.zeros(run[-1] + 2, bool)
        ends[run[may_end] + 1] = True
        inner = np.flatnonzero(np.bincount(number[may_end], minlength=number[-1] + 1)[number[first]] > 1)
        for n in self.sizes:
            here = inner[b[inner] - a[inner] > n]
            here = here[ends[a[here] + n]]
            mark(here, a[here] + n, self.whole)
        return start[found], end[found]


def skeleton(word: str) -> str:
    """What all readings of a unit share."""
    shape = _tables()[1]
    out = []
    for c in word:
        if (v := int(shape[ord(c)])) and (not out or out[-1] != v):
            out.append(v)
    return "".join(map(chr, out))


def _names(skeletons: set[str]) -> np.ndarray:
    texts = sorted(skeletons)
    cp, bounds = units.lay_out(texts)
    return np.unique(units.hashes(cp, bounds[:-1], bounds[1:])) if texts else np.zeros(0, np.uint64)


def _places(restore: Restorer, text: str) -> Iterator[tuple[str, int]]:
    """Features of all units of a text, with a hash of the unit before."""
    cp, bounds, start, end = _cut([text])
    before = 0
    for a, b in zip(start.tolist(), end.tolist()):
        unit = text[a:b]
        for f in {f for form in forms(unit) for f in features(restore(form))}:
            yield f, before
        before = zlib.crc32(unit.lower().encode("utf-8", "surrogatepass"))
    for a, b in zip(*(x.tolist() for x in _spaced(cp, bounds, start, end))):
        for f in features(restore(text[a:b])):
            yield f, 0


def _text_features(restore: Restorer, text: str) -> set[str]:
    cp, bounds, start, end = _cut([text])
    own = {text[a:b] for a, b in zip(start.tolist(), end.tolist())}
    own |= {text[a:b] for a, b in zip(*(x.tolist() for x in _spaced(cp, bounds, start, end)))}
    return {f for unit in own for form in forms(unit) for f in features(restore(form))}


_restorers: dict[str, Restorer] = {}


def _restorer(model: Broadcast) -> Restorer:
    name = model.value["name"]
    if name not in _restorers:
        _restorers.clear()
        _restorers[name] = Restorer(model.value["characters"])
    return _restorers[name]


def _count_characters(batches: Batches) -> Batches:
    total = np.zeros(_ALPHABET ** 3, np.int64)
    for batch in batches:
        total += trigrams(texts_of(batch, "text"))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])


def _count_features(model: Broadcast, batches: Batches) -> Batches:
    restore = _restorer(model)
    for batch in batches:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        for text, label in zip(texts_of(batch, "text"), batch.column("toxic").to_pylist()):
            (toxic if label else clean).update(_text_features(restore, text))
        names = sorted({*toxic, *clean})
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()),
             pa.array([clean[f] for f in names], pa.int64())], ["feature", "toxic", "clean"])


class Marks:
    """Whether a feature may be a candidate; of one size, however many candidates there are."""

    def __init__(self, candidates: DataFrame) -> None:
        mark = F.shiftright(F.crc32(F.col("feature").cast("binary")), 32 - _MARK_BITS)
        # A bitmap of Spark holds 2**15 bits.
        rows = candidates.groupBy(F.shiftright(mark, 15).alias("at")).agg(
            F.bitmap_construct_agg(mark.bitwiseAND((1 << 15) - 1)).alias("bits")).collect()
        found = {r["at"]: bytes(r["bits"]) for r in rows}
        self.bits = b"".join(found.get(k, bytes(1 << 12)) for k in range(1 << _MARK_BITS - 15))

    def __contains__(self, feature: str) -> bool:
        mark = zlib.crc32(feature.encode("utf-8", "surrogatepass")) >> 32 - _MARK_BITS
        return bool(self.bits[mark >> 3] >> (mark & 7) & 1)


def _find_places(model: Broadcast, batches: Batches) -> Batches:
    """Different places of features that may be candidates, in toxic and in clean texts."""
    restore, marks = _restorer(model), model.value["marks"]
    for batch in batches:
        found = sorted({(*p, label) for text, label in zip(texts_of(batch, "text"), batch.column("toxic").to_pylist())
                        for p in _places(restore, text) if p[0] in marks})
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.int64()),
             pa.array([p[2] for p in found], pa.int32())], ["feature", "before", "toxic"])


def _find_open(model: Broadcast, batches: Batches) -> Batches:
    """Features that may be candidates, of each text without a strong one; an empty one for the text itself."""
    restore, marks, strong = _restorer(model), model.value["marks"], model.value["strong"]
    for batch in batches:
        found = []
        for row, text in zip(batch.column("row").to_pylist(), texts_of(batch, "text")):
            own = _text_features(restore, text)
            if strong.isdisjoint(own):
                found += [(row, f) for f in ("", *sorted(own)) if not f or f in marks]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in found], pa.int64()), pa.array([f for _, f in found], pa.string())], ["row", "feature"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Broadcast:
    """Character model over all of ``docs``, classifier on a sample of those in ``labels``.

    A document with several labels is toxic if one says so; rows without label, text or id
    teach nothing.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = np.zeros(_ALPHABET ** 3, np.int64)
    for r in map_batches(texts.select("text"), _count_characters, "code long, n long").groupBy("code").agg(
            F.sum("n").alias("n")).collect():
        counts[r.code] = r.n
    model = {"name": uuid.uuid4().hex, "characters": language_model(counts)}

    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(
        "id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = sampled(marked.withColumn("draw", F.xxhash64("id")), "toxic", "draw", sample).drop("draw")
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("id").alias("n")).collect()}
    # About two times ``sample`` ids are broadcast, however many labels there are.
    chosen = stored(texts.filter("text IS NOT NULL").join(F.broadcast(picked), "id").select(
        "text", "toxic", F.monotonically_increasing_id().alias("row")), "labelled")
    taught = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean_weight = max(1, sizes.get(0, 0)) / max(1, min(sample, sizes.get(0, 0)))
    toxic_weight = max(1, sizes.get(1, 0)) / max(1, min(sample, sizes.get(1, 0)))
    toxic, clean = toxic_weight * taught.get(1, 0), clean_weight * taught.get(0, 0)
    # Few labels say little: ten more clean texts are assumed.
    base = (toxic + 0.5) / (toxic + clean + 10)

    labelled = chosen.select("text", "toxic")
    counted = map_batches(labelled, partial(_count_features, context.broadcast(model)),
                          "feature string, toxic long, clean long").groupBy("feature").agg(
        (F.sum("toxic") * toxic_weight).alias("toxic"), (F.sum("clean") * clean_weight).alias("clean"))
    counted = stored(counted, "features")

    def share(bad, good):
        return (bad + PRIOR * base) / (bad + good + PRIOR)

    # Candidates stay a table: texts meet it by joins, behind a sieve of fixed size.
    tried = counted.filter("toxic >= 2 AND 5 * toxic > clean").withColumn(
        "weight", F.col("toxic") * (F.col("toxic") + PRIOR * base) / (F.col("toxic") + F.col("clean") + PRIOR))
    model["marks"] = Marks(tried)
    found = map_batches(labelled, partial(_find_places, context.broadcast(model)),
                        "feature string, before long, toxic int").distinct().groupBy("feature").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    judged = stored(tried.join(found, "feature", "left").select(
        "feature", "weight", "bad", F.least(F.col("good") * clean_weight, "clean").alias("good"),
        F.least(F.col("bad") * toxic_weight, "toxic").alias("toxic")), "judged")
    scores = {r.feature: r.score for r in judged.withColumn("score", share(F.col("toxic"), F.col("good"))).filter(
        (F.col("bad") >= PLACES) & (F.col("score") >= SHARE)).select("feature", "score").collect()}
    own = map_batches(chosen.filter("toxic = 1").select("row", "text"), partial(
        _find_open, context.broadcast(model | {"strong": set(scores)})), "row long, feature string")
    best = own.join(judged.select("feature", "weight"), "feature", "left").groupBy("row").agg(F.max(F.when(
        F.col("weight").isNotNull(), F.struct("weight", ~F.col("feature").endswith("~"), "feature"))).alias("best"))
    credit = best.groupBy(F.col("best.feature").alias("feature")).agg(F.count("*").alias("n"))
    unexplained = 0.0
    for r in credit.join(judged, "feature", "left").select(
            "feature", "n", share(F.col("n") * toxic_weight, F.col("good")).alias("score")).filter(
            F.col("feature").isNull() | (F.col("score") > base)).collect():
        if r.feature is None:
            unexplained = r.n * toxic_weight
        else:
            scores[r.feature] = r.score
    del model["marks"]
    parts = sorted(f[:-1] for f in scores if f.endswith("~"))
    if parts:
        word = F.when(~F.col("feature").endswith("~"), F.col("feature"))
        known = counted.select("feature", "toxic", "clean", F.explode(
            F.array(*[F.substring(word, 1, k) for k in BEGINNINGS])).alias("begin")).filter("clean > toxic")
        for r in known.join(spark.createDataFrame([(p,) for p in parts], "begin string"), "begin").select(
                "feature", "toxic", "clean").distinct().collect():
            scores.setdefault(r.feature, share(r.toxic, r.clean))
    return context.broadcast(model | {"features": scores, "base": min(base, (unexplained + 0.5) / (clean + unexplained + 10))})


_scorers: dict[str, Scorer] = {}


def _scorer(model: Broadcast) -> Scorer:
    name = model.value["name"]
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model.value)
    return _scorers[name]


def _score(model: Broadcast, threshold: float, batches: Batches) -> Batches:
    scorer = _scorer(model)
    for batch in batches:
        scores = scorer(texts_of(batch, "text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
             pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def _keep(model: Broadcast, text_col: str, threshold: float, batches: Batches) -> Batches:
    scorer = _scorer(model)
    for batch in batches:
        yield batch.filter(pa.array(scorer(texts_of(batch, text_col)) < threshold))


def score(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD, sample: int = SAMPLE,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Each row's ``held_out``, ``score`` from 0 to 1, and ``predicted``, 1 from ``threshold`` on.

    ``held_out`` is a condition on the id, for documents and labels alike; labels of such
    rows teach nothing.  Null and empty texts score as texts without any feature, as does
    every text if there are no labels.  A null id is kept; repeated rows are scored each;
    other columns are left out; no rows give no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic"))
    held_out = F.coalesce(held_out, F.lit(False))
    model = fit(source, known.filter(~held_out), sample)
    return map_batches(source.withColumn("held_out", held_out), partial(_score, model, threshold),
                       "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE,
                 id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``.

    The model learns from the labelled rows among them.  Every row is scored by its own text,
    rows that repeat an id too; null and empty texts score like texts without any feature.
    Without labels, or without rows of both labels, no text has a feature.  No rows give no rows.
    """
    model = fit(docs, labels, sample, id_col, text_col, label_col)
    return map_batches(docs, partial(_keep, model, text_col, threshold), docs.schema)
