"""Language of whole texts by unigram models of pieces, summed over all segmentations.

The pieces are the fixed vocabulary of a public tokenizer.  A language gives each piece a
probability; a word's probability is the sum over all ways to cut it into pieces, by a
forward recursion over its bytes; a text's is the product over its words.  Models are
fitted by expectation maximization on word counts, where a backward recursion gives the
expected number of times each piece is used.

Words are scored once per distinct word and task.  Nothing is shuffled but the words of
the training sample; the models (pieces x languages) are the only thing broadcast.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import text_units as units
from tickerloom.llm.batches import Batches, map_batches, texts_of
from tickerloom.llm.samples import sampled
from tickerloom.plans.stored import stored

#: The classifier is fitted on about so many texts of each language at most, chosen by a hash of their ids.
SAMPLE = 1000
ROUNDS = 2
#: Bytes of the longest piece that is used.
LONGEST = 12
SMOOTHING = 0.5


_LETTER, _MARK = 1, 2
#: Words longer than this are summed one by one.
_LONG_WORD = 48


@cache
def _kinds() -> np.ndarray:
    kinds = np.zeros(units.CODE_POINTS, np.uint8)
    for c in range(units.CODE_POINTS):
        first = unicodedata.category(chr(c))[0]
        if first in "LM":
            kinds[c] = _LETTER if first == "L" else _MARK
    return kinds


def pieces(vocabulary: str) -> list[bytes]:
    """Pieces of a byte-level BPE file, as bytes; all single bytes are among them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(vocabulary, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    found = {bytes([b]) for b in range(256)}
    found |= {bytes(byte_of[c] for c in entry) for entry in entries if all(c in byte_of for c in entry)}
    return sorted(p for p in found if len(p) <= LONGEST)


def _form(word: str) -> bytes:
    """A word as the vocabulary has it: in lower case, after a blank."""
    return b" " + word.lower().encode("utf-8", "surrogatepass")


class Lattice:
    """Pieces at all places of many words at once."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.pieces = len(vocabulary)
        joined = np.frombuffer(b"".join(vocabulary), np.uint8).astype(np.uint32)
        ends = np.cumsum([len(p) for p in vocabulary])
        starts = ends - [len(p) for p in vocabulary]
        names = units.hashes(joined, starts, ends)
        order = np.argsort(names)
        self._names, self._numbers = names[order], order.astype(np.int32)
        self._marks = np.zeros(1 << 20, bool)
        self._marks[names >> np.uint64(44)] = True

    def places(self, words: list[bytes]) -> np.ndarray:
        """Of words of one length: number of the piece of each size that ends at each byte, else one past the last."""
        n, size = len(words), len(words[0])
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint32)
        found = np.full((size, LONGEST, n), self.pieces, np.int32)
        base = np.arange(n) * size
        ends = np.arange(1, size + 1)
        for length in range(1, min(LONGEST, size) + 1):
            own = ends[ends >= length]
            stop = (own[:, None] + base[None, :]).ravel()
            names = units.hashes(flat, stop - length, stop)
            at = np.flatnonzero(self._marks[names >> np.uint64(44)])
            where = np.minimum(np.searchsorted(self._names, names[at]), len(self._names) - 1)
            right = self._names[where] == names[at]
            level = np.full(len(names), self.pieces, np.int32)
            level[at[right]] = self._numbers[where[right]]
            found[own - 1, length - 1] = level.reshape(len(own), n)
        return found

    def forward(self, places: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sums over all segmentations of each beginning, scaled, and the logarithm of each beginning's scale.

        ``chances`` has a row for each piece and one of zeros; its other axes are kept.
        """
        size, _, n = places.shape
        tail = chances.shape[1:] if chances.ndim > 1 else ()
        upto = np.zeros((size + 1, n, *tail))
        upto[0] = 1
        scales = [np.zeros((n, *tail))] * (size + 1)
        for b in range(1, size + 1):
            for length in range(1, min(LONGEST, b) + 1):
                upto[b] += upto[b - length] * chances[places[b - 1, length - 1]]
            if b % _LONG_WORD == 0:
                low = max(0, b - LONGEST)
                top = upto[low: b + 1].max(axis=0)
                upto[low: b + 1] /= top
                scales[low:] = [scales[b] + np.log(top)] * (size + 1 - low)
        return upto, scales

    def backward(self, places: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The same of each end, in one language."""
        size, _, n = places.shape
        after = np.zeros((size + 1, n))
        after[size] = 1
        scales = [np.zeros(n)] * (size + 1)
        for b in range(size - 1, -1, -1):
            for length in range(min(LONGEST, size - b), 0, -1):
                after[b] += after[b + length] * chances[places[b + length - 1, length - 1]]
            if (size - b) % _LONG_WORD == 0:
                high = min(size, b + LONGEST)
                top = after[b: high + 1].max(axis=0)
                after[b: high + 1] /= top
                scales[:high + 1] = [scales[b] + np.log(top)] * (high + 1)
        return after, scales

    def log_probability(self, words: list[bytes], chances: np.ndarray) -> np.ndarray:
        """A row for each word with its logarithm of the probability in each language."""
        out = np.empty((len(words), chances.shape[1]))
        for at in _same_length(words):
            upto, scales = self.forward(self.places([words[i] for i in at]), chances)
            out[at] = np.log(upto[-1]) + scales[-1]
        return out

    def expected(self, words: list[bytes], weights: np.ndarray, chances: np.ndarray) -> np.ndarray:
        """Times that each piece is expected to be used, in one language."""
        total = np.zeros(self.pieces + 1)
        for at in _same_length(words):
            places = self.places([words[i] for i in at])
            size = len(places)
            upto, scales = self.forward(places, chances)
            after, after_scales = self.backward(places, chances)
            share = weights[at] / upto[size]
            for b in range(1, size + 1):
                for length in range(1, min(LONGEST, b) + 1):
                    own = places[b - 1, length - 1]
                    if size < _LONG_WORD:
                        used = upto[b - length] * chances[own] * after[b] * share
                    else:
                        # Positions have scales of their own; the product is at most 1, its factors may be beyond doubles.
                        with np.errstate(divide="ignore"):
                            used = weights[at] * np.exp(
                                np.log(upto[b - length]) + scales[b - length] + np.log(chances[own]) + np.log(after[b])
                                + after_scales[b] - np.log(upto[size]) - scales[size])
                    total += np.bincount(own, used, len(total))
        return total[:-1]


def _same_length(words: list[bytes], most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Positions of words of one length, so many at once that their lattices stay small."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, edges):
        if len(group):
            step = max(1, most // (int(sizes[group[0]]) * LONGEST))
            for a in range(0, len(group), step):
                yield group[a: a + step]


@cache
def _lattice(vocabulary: str) -> Lattice:
    return Lattice(pieces(vocabulary))


class Scorer:
    """Scores of whole texts under all models, each distinct word once."""

    def __init__(self, vocabulary: str, chances: np.ndarray) -> None:
        self.lattice, self.chances = _lattice(vocabulary), chances
        self.known = units.Known(20, chances.shape[1], np.float32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of log-likelihoods for each text, and whether the text has a letter."""
        rows, lettered = [], []
        for first, last in units.chunks(np.array([len(t) for t in texts], np.int64)):
            joined = "".join(texts[first:last])
            cp, bounds = units.lay_out(texts[first:last])
            kinds = _kinds()[cp]
            start, end = units.runs(kinds > 0, bounds)

            def new(at: np.ndarray) -> np.ndarray:
                own = [_form(joined[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist())]
                return self.lattice.log_probability(own, self.chances)

            found = self.known.get(units.hashes(cp, start, end), new)
            upto = np.zeros((len(start) + 1, found.shape[1]))
            np.cumsum(found, axis=0, dtype=np.float64, out=upto[1:])
            at = np.searchsorted(start, bounds)
            rows.append(upto[at[1:]] - upto[at[:-1]])
            letters = np.concatenate(([0], np.cumsum(kinds == _LETTER)))
            lettered.append(letters[bounds[1:]] > letters[bounds[:-1]])
        if not rows:
            return np.zeros((0, self.chances.shape[1])), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(lettered)


_scorers: dict[str, Scorer] = {}


def _scorer(model: Broadcast, vocabulary: str) -> Scorer:
    """The scorer of a model, kept by the worker until another model comes."""
    name = model.value["name"]
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(vocabulary, model.value["chances"])
    return _scorers[name]


def _word_counts(batches: Batches) -> Batches:
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), texts_of(batch, "text")
        total: dict[tuple[str, str], int] = {}
        for first, last in units.chunks(np.array([len(t) for t in texts], np.int64)):
            joined = "".join(texts[first:last])
            cp, bounds = units.lay_out(texts[first:last])
            start, end = units.runs(_kinds()[cp] > 0, bounds)
            text = np.searchsorted(bounds, start, side="right") - 1 + first
            for a, b, t in zip(start.tolist(), end.tolist(), text.tolist()):
                key = (langs[t], joined[a:b].lower())
                total[key] = total.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()),
             pa.array(list(total.values()), pa.int64())], ["lang", "word", "n"])


def _expect(model: Broadcast, vocabulary: str, batches: Batches) -> Batches:
    lattice, langs, chances = _lattice(vocabulary), model.value["langs"], model.value["chances"]
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        own = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
        words = [_form(w) for w in batch.column("word").to_pylist()]
        n = batch.column("n").to_numpy().astype(np.float64)
        for k in np.unique(own).tolist():
            at = np.flatnonzero(own == k)
            found = lattice.expected([words[i] for i in at], n[at], chances[:, k])
            total[k] = total.get(k, 0) + found
    for k, found in total.items():
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(used), k)), pa.array(used), pa.array(found[used])], ["lang", "piece", "times"])


def fit(train: DataFrame, vocabulary: str, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Broadcast:
    """Models of all languages of ``train``; rows without text, language or id are left out."""
    spark = train.sparkSession
    rows = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                        F.xxhash64(F.col(id_col)).alias("draw")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col(id_col).isNotNull())
    chosen = sampled(rows, "lang", "draw", sample).select("lang", "text")
    counts = stored(map_batches(chosen, _word_counts, "lang string, word string, n long")
                    .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    number = _lattice(vocabulary).pieces
    chances = np.full((number + 1, len(langs)), 1 / number)
    chances[number] = 0
    for _ in range(ROUNDS):
        model = spark.sparkContext.broadcast({"langs": langs, "chances": chances})
        used = map_batches(counts, partial(_expect, model, vocabulary), "lang long, piece long, times double") \
            .groupBy("lang", "piece").agg(F.sum("times").alias("times")).toArrow()
        chances = np.full((number + 1, len(langs)), SMOOTHING)
        chances[number] = 0
        np.add.at(chances, (used.column("piece").to_numpy(), used.column("lang").to_numpy()), used.column("times").to_numpy())
        chances /= chances.sum(axis=0)
    return spark.sparkContext.broadcast({"langs": langs, "chances": chances, "name": uuid.uuid4().hex})


def _predict(model: Broadcast, vocabulary: str, batches: Batches) -> Batches:
    langs = np.array([*model.value["langs"], "und"], object)
    scorer = _scorer(model, vocabulary) if len(langs) > 1 else None
    for batch in batches:
        best = np.full(batch.num_rows, len(langs) - 1)
        share = np.zeros(batch.num_rows)
        if scorer and batch.num_rows:
            total, lettered = scorer(texts_of(batch, "text"))
            chance = np.exp(total - total.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            best[lettered] = chance.argmax(axis=1)[lettered]
            share[lettered] = chance.max(axis=1)[lettered]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(langs[best], pa.string()), pa.array(share)],
            ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, vocabulary: str, held_out: Column, sample: int = SAMPLE, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each row's ``held_out``, ``lang_pred`` and ``score``, the share of that language among all.

    Models are fitted on rows that are not held out, and nothing but the text is scored.
    Null texts and texts without a letter are ``und`` with score 0, as is every text if no
    language can be learned.  Equal chances go to the language first in the alphabet.  A null id is kept
    and never trains; repeated rows are judged each; other columns are left out.
    """
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                         F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = fit(marked.filter("NOT held_out"), vocabulary, sample, "doc_id", "text", "lang")
    return map_batches(marked.select("doc_id", "held_out", "text"), partial(_predict, model, vocabulary),
                       "doc_id long, held_out boolean, lang_pred string, score double")
