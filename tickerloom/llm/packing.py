"""Packing tokenized documents into sequences of fixed length by Karmarkar-Karp multiway differencing.

A document is tokenized once, ends with ``END_ID`` and is cut into windows of the full
length and a rest of near-equal pieces.  Windows fill a sequence each.  The rests of
``BLOCK_PIECES`` pieces at a time are partitioned over sequences: the two partial
partitions with the largest spreads are merged, largest sums onto smallest, until one is
left; if a sequence then exceeds the length, the number of sequences rises.

Everything happens in the map task that reads the documents.  No row is shuffled, a task
holds one batch of texts and one block of piece lengths, and a lost task is repeated alone.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickerloom.llm import text_units as units
from tickerloom.llm.batches import Batches, map_batches, texts_of

LENGTH = 2048
END_ID = 1
#: Pieces partitioned together; half a sequence of padding for each block.
BLOCK_PIECES = 800
#: The rest of a document is cut into the fewest pieces of at most this share of a sequence.
REST_SHARE = 4
#: Token ids kept for units seen before, per task.
KEPT_IDS = 1 << 25

PIECES = ("doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")

# Below this code point the Unicode classes are the same in all versions.
_PLAIN = 0x250
_LETTER, _NUMBER, _OTHER, _SPACE, _ODD = range(5)


@cache
def _classes() -> np.ndarray:
    found = np.full(units.CODE_POINTS, _ODD, np.uint8)
    for c in range(_PLAIN):
        kind = unicodedata.category(chr(c))
        found[c] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
    found[[9, 10, 11, 12, 13, 32]] = _SPACE
    # Where regular expression engines may differ, and contractions: left to the tokenizer.
    found[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, ord("'"), ord("<")]] = _ODD
    return found


class Encoder:
    """Token ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    Texts are cut where the file's own pre-tokenizer always cuts.  Each distinct unit is
    encoded once; a stretch between spaces that holds any unusual character goes through
    the whole tokenizer.  Strings of the file's added tokens in a text become those tokens.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._all = Tokenizer.from_file(path)
        self._model = self._all.model
        # Added tokens are found before anything is cut: a stretch that may hold one goes through
        # the whole tokenizer, and every text does if an added token may hold the border of stretches.
        added = [t.content for t in self._all.get_added_tokens_decoder().values()]
        self._kinds = _classes().copy()
        self._kinds[[ord(t[0]) for t in added if t]] = _ODD
        self._uncut = any(" " in t for t in added)
        self._type = np.uint16 if self._all.get_vocab_size() <= 1 << 16 else np.uint32
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self._letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._known = units.Known(21, 2, np.int64)
        self._ids = np.zeros(KEPT_IDS, self._type)
        self._used = 0

    def _cut(self, cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of units, and whether a unit needs the whole tokenizer."""
        kind = self._kinds[cp]
        n = len(cp)
        space, odd = kind == _SPACE, kind == _ODD
        follows = np.zeros(n, bool)
        follows[:-1] = (kind[1:] < _SPACE)
        filled = bounds[:-1] < bounds[1:]
        begins = np.zeros(n, bool)
        begins[bounds[:-1][filled]] = True
        ends_text = np.zeros(n, bool)
        ends_text[bounds[1:][filled] - 1] = True
        follows &= ~ends_text
        safe = begins | ((cp == 32) & follows)
        chunk_of = np.cumsum(safe) - 1
        whole = np.zeros(int(chunk_of[-1]) + 1 if n else 0, bool)
        whole[chunk_of[odd]] = True
        was = np.empty(n, np.uint8)
        was[1:], was[:1] = kind[:-1], _ODD
        was_blank = np.zeros(n, bool)
        was_blank[1:] = cp[:-1] == 32
        was_space = was == _SPACE
        inner = np.where(
            space,
            ~was_space | follows,
            np.where(was_space, ~was_blank, was != kind))
        start = np.flatnonzero(safe | (inner & ~whole[chunk_of]))
        end = np.append(start[1:], n) if len(start) else start
        return start, end, whole[chunk_of[start]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the bounds of each text in them."""
        cp, bounds = units.lay_out(texts)
        if not len(cp):
            return np.zeros(0, self._type), np.zeros(len(texts) + 1, np.int64)
        if self._uncut:
            found = [self._all.encode(t, add_special_tokens=False).ids for t in texts]
            return (np.array([i for ids in found for i in ids], self._type),
                    np.concatenate(([0], np.cumsum([len(ids) for ids in found]))))
        if self._used + 4 * len(cp) > len(self._ids):
            self._known.clear()
            self._used = 0
            if 4 * len(cp) > len(self._ids):
                self._ids = np.zeros(4 * len(cp), self._type)
        joined = "".join(texts)
        start, end, whole = self._cut(cp, bounds)

        def new(at: np.ndarray) -> np.ndarray:
            flat, sizes = [], []
            tokenize, letters = self._model.tokenize, self._letters
            for a, b, odd in zip(start[at].tolist(), end[at].tolist(), whole[at].tolist()):
                before = len(flat)
                if odd:
                    flat += self._all.encode(joined[a:b], add_special_tokens=False).ids
                else:
                    flat += [t.id for t in tokenize(joined[a:b].encode().decode("latin-1").translate(letters))]
                sizes.append(len(flat) - before)
            self._ids[self._used: self._used + len(flat)] = flat
            found = np.empty((len(at), 2), np.int64)
            found[:, 1] = sizes
            found[:, 0] = self._used + np.cumsum(found[:, 1]) - found[:, 1]
            self._used += len(flat)
            return found

        where, size = self._known.get(units.hashes(cp, start, end), new).T
        ends = np.cumsum(size)
        ids = self._ids[np.repeat(where - ends + size, size) + np.arange(ends[-1])]
        upto = np.concatenate(([0], ends))
        return ids, upto[np.searchsorted(start, bounds)]


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def partition(sizes: list[int], ways: int) -> list[list[int]]:
    """Positions of ``sizes`` in ``ways`` sets of near-equal sums, by largest differencing.

    A set is a chain of positions: its first, its last, and for each position the next.
    """
    order = count()
    after = np.full(len(sizes), -1)
    heap = []
    for i, size in enumerate(sizes):
        sums, heads = np.zeros(ways, np.int64), np.full(ways, -1)
        sums[0], heads[0] = size, i
        heap.append((-size, next(order), sums, heads, heads))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, sums, heads, tails = heapq.heappop(heap)
        _, _, more, more_heads, more_tails = heapq.heappop(heap)
        more_heads, more_tails = more_heads[::-1], more_tails[::-1]
        empty, adds = heads < 0, more_heads >= 0
        both = adds & ~empty
        after[tails[both]] = more_heads[both]
        sums = sums + more[::-1]
        heads, tails = np.where(empty, more_heads, heads), np.where(adds, more_tails, tails)
        best = np.argsort(-sums, kind="stable")
        sums = sums[best]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), next(order), sums, heads[best], tails[best]))
    return [_chain(after, h) for h in heap[0][3]] if heap else []


def _chain(after: np.ndarray, at: int) -> list[int]:
    found = []
    while at >= 0:
        found.append(int(at))
        at = after[at]
    return found


def pack(sizes: list[int], length: int) -> list[list[int]]:
    """Sets of positions with sums of at most ``length``; more sets while one exceeds it."""
    ways = max(1, -(-sum(sizes) // length))
    while True:
        sets = partition(sizes, ways)
        if all(sum(sizes[i] for i in s) <= length for s in sets):
            return [s for s in sets if s]
        ways += 1


@dataclass
class _Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


def _pieces(doc_id: int | None, ids: np.ndarray, length: int) -> Iterator[_Piece]:
    """Whole windows first, then near-equal parts of the rest."""
    n = len(ids)
    whole = n // length * length
    cuts = [*range(0, whole, length), whole]
    if rest := n - whole:
        parts = -(-rest * REST_SHARE // length)
        cuts.extend(whole + rest * i // parts for i in range(1, parts + 1))
    for a, b in zip(cuts, cuts[1:]):
        yield _Piece(doc_id, a, ids[a:b], n)


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as pieces of sequences of at most ``length`` ids.

    ``vocabulary`` is the path of a byte-level BPE file of the ``tokenizers`` library that
    every executor can open.  Each id lies in one piece; pieces of a sequence lie one after
    the other from offset 0, the rest of a sequence is padding.  Null text counts as empty,
    an empty document is its end id alone, a null ``doc_id`` is kept, repeated rows are
    packed each for itself, other columns are left out, an empty table gives no rows.
    """

    def run(batches: Batches) -> Batches:
        encoder = _encoder(vocabulary)
        numbers = count(TaskContext.get().partitionId() << 36)
        rests: list[_Piece] = []

        def sequences(blocks: list[list[_Piece]]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(8)]
            for block in blocks:
                number, offset = next(numbers), 0
                for p in block:
                    ids = p.ids.astype("<u4")
                    row = (p.doc_id, p.start, len(ids), ids.astype(np.int32), zlib.crc32(ids.tobytes()), p.doc_tokens,
                           number, offset)
                    for col, value in zip(cols, row):
                        col.append(value)
                    offset += len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.list_(pa.int32()) if i == 3 else pa.int64()) for i, c in enumerate(cols)],
                ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def packed(block: list[_Piece]) -> pa.RecordBatch:
            return sequences([[block[i] for i in s] for s in pack([len(p.ids) for p in block], length)])

        for batch in batches:
            names, texts = batch.column(id_col).to_pylist(), texts_of(batch, text_col)
            for first, last in units.chunks(np.array([len(t) for t in texts], np.int64)):
                ids, bounds = encoder.encode(texts[first:last])
                whole = []
                for k in range(last - first):
                    own = np.append(ids[bounds[k]: bounds[k + 1]], ids.dtype.type(end_id))
                    for piece in _pieces(names[first + k], own, length):
                        if len(piece.ids) == length:
                            whole.append([piece])
                        else:
                            rests.append(piece)
                if whole:
                    yield sequences(whole)
                while len(rests) >= BLOCK_PIECES:
                    yield packed(rests[:BLOCK_PIECES])
                    del rests[:BLOCK_PIECES]
        if rests:
            yield packed(rests)

    return map_batches(docs.select(id_col, text_col), run, PIECES)
