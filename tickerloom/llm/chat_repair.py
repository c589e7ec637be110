"""Repair of conversations by cheapest edits.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an
assistant turn.  Rows may be kept (K), given the role user or assistant (R) or deleted (D),
and empty user or assistant turns inserted (I).  The cheapest way is a shortest path over
(row, state of the turn order).

The walk is checkpointed by the square root: a pass from the last row to the first keeps the
vector of costs-to-finish of the four states only before every sqrt(n)-th row.  A pass from
the first row on computes the vectors of one stretch again from the checkpoint behind it and
takes, of the edits that stay on a cheapest way, the one whose letter is least.  An edit and
a state lead to one state, so this gives the ASCII-least string of all cheapest ones.

Rows move twice: without texts to plan the edits, and with texts to carry them out.  Both
times a task streams sorted rows.  It holds one byte for each row of a conversation (as many
as the string of edits has, which is one value by its nature), never the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tickerloom.llm.batches import Batches, map_batches

#: Costs of the edits; an undeleted row that breaks off adds ``BROKEN``.
REROLE, DELETE, INSERT, BROKEN = 2, 3, 2, 1

#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_NAME = {USER: "user", ASSISTANT: "assistant"}

#: What a row's byte holds: the initial of its role (0: another), then two marks.
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_DROP, _BROKEN = 4, 8

_BLANKS = " \t\n\x0b\f\r"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Vector = tuple[int, int, int, int]


def _target(state: int, kind: int) -> int | None:
    """The state after keeping a row of this kind, None where the order forbids it."""
    if kind and (kind == _NEXT[state] or (state == START and kind == SYSTEM)):
        return kind
    return None


def _with_inserts(v: Vector) -> Vector:
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


#: Costs-to-finish behind the last row: the order may end before any turn and after an assistant.
_END: Vector = (0, 2 * INSERT, INSERT, 0)


@lru_cache(maxsize=None)
def _before(code: int, after: Vector) -> Vector:
    """Costs-to-finish before a row, from those behind it (relative ones: few vectors occur)."""
    costs = [c + DELETE for c in after]
    if not code & _DROP:
        broken, kind = BROKEN * bool(code & _BROKEN), code & 3
        for state in range(4):
            costs[state] = min(costs[state], after[_NEXT[state]] + REROLE + broken)
            if (kept := _target(state, kind)) is not None:
                costs[state] = min(costs[state], after[kept] + broken)
    return _with_inserts(tuple(costs))


def _back(code: int, after: Vector) -> Vector:
    low = min(after)
    made = _before(code, tuple(c - low for c in after))
    return tuple(c + low for c in made)


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Least cost and the ASCII-least string of cheapest edits of rows given as bytes."""
    n = len(codes)
    step = max(1, isqrt(n))
    marks, vector = {}, _END
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            marks[i // step] = vector
        vector = _back(codes[i], vector)
    cost, state, letters = vector[START], START, []
    for block in range((n + step - 1) // step):
        low, high = block * step, min(n, (block + 1) * step)
        vectors = [marks[block]]
        for i in range(high - 1, low - 1, -1):
            vectors.append(_back(codes[i], vectors[-1]))
        vectors.reverse()
        for i in range(low, high):
            state = _walk(codes[i], vectors[i - low], vectors[i - low + 1], state, letters)
    while state in (SYSTEM, USER):
        letters.append("I")
        state = _NEXT[state]
    return cost, "".join(letters)


def _walk(code: int, here: Vector, after: Vector, state: int, letters: list[str]) -> int:
    """Append the least tight letters up to the one that takes the row; the state behind it."""
    while True:
        if after[state] + DELETE == here[state]:
            letters.append("D")
            return state
        if here[_NEXT[state]] + INSERT == here[state]:
            letters.append("I")
            state = _NEXT[state]
            continue
        broken = BROKEN * bool(code & _BROKEN)
        kept = _target(state, code & 3)
        if kept is not None and after[kept] + broken == here[state]:
            letters.append("K")
            return kept
        letters.append("R")
        return _NEXT[state]


class _Conversation:
    """What is kept of a conversation while its rows stream by."""

    def __init__(self) -> None:
        self.codes, self.low, self.high, self.turns = bytearray(), None, None, 0
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn: int | None, code: int, fault: int) -> None:
        self.codes.append(code)
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def plan(self) -> tuple[list[int], str]:
        kinds = np.frombuffer(bytes(self.codes), np.uint8) & 3
        pairs = kinds[:-1] * 4 + kinds[1:]
        legal = np.isin(pairs, [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = cheapest_edits(bytes(self.codes))
        return [gaps, self.blank, self.duplicate, self.truncated, int((~legal).sum()), cost], audit


def _plan(schema: pa.Schema) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        key, held = None, None
        for batch in batches:
            done = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv", "present", "turn", "code", "fault")))
            for conv, present, turn, code, fault in rows:
                if held is None or conv != key:
                    if held is not None:
                        done.append((key, held.plan()))
                    key, held = conv, _Conversation()
                if present:
                    held.add(turn, code, fault)
            yield from _planned(done, schema)
        if held is not None:
            yield from _planned([(key, held.plan())], schema)

    return run


def _planned(done: list[tuple[object, tuple[list[int], str]]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if done:
        yield pa.RecordBatch.from_pydict(
            {"conv": [conv for conv, _ in done], "audit": [audit for _, (_, audit) in done],
             **{name: [counts[i] for _, (counts, _) in done] for i, name in enumerate(_COUNTS)}}, schema)


def _read(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """The columns that the operator works on, under names of its own."""
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        F.coalesce(present, F.lit(False)).alias("present") if present is not None else F.lit(True).alias("present"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def plan_edits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               present: Column | None = None) -> DataFrame:
    """One row for each conversation: its faults and its cheapest edits.

    Columns: ``conv`` as ``conv_id``, ``gaps`` (turn numbers left out between the first and
    the last), rows by first fault (``blank``, ``duplicate`` of an earlier row's role and
    text, ``truncated``: the last visible character ends no sentence), ``illegal`` pairs of
    adjacent roles, ``cost`` and ``audit``, the letters of the edits.  Blank and duplicate
    rows are always deleted.

    Rows are taken by turn, rows without one first; rows of one turn by role and then by the
    SHA-256 of their text, so that equal rows are neighbours.  A null role or text is one
    space, a null ``conv`` a conversation of its own.  Rows that ``present`` does not mark
    name their conversation only: one without any other row has zeros and no edits.  An
    empty table gives no rows; other columns are not read.
    """
    source = _read(rows, conv, turn, role, text, present)
    last = F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1)
    light = source.select(
        "conv", "present", "turn", "role", "digest", (F.trim("text", F.lit(_BLANKS)) == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("broken"), F.substring("role", 1, 1).alias("initial")).repartition("conv")
    # Partitioned by conversation already: numbering equal rows costs a sort, no exchange.
    same = Window.partitionBy("conv", "present", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(F.col("blank"), 1).when(F.row_number().over(same) > 1, 2).when(F.col("broken"), 3).otherwise(0)
    kind = F.lit(0)
    for initial, value in _INITIALS.items():
        kind = F.when(F.col("initial") == initial, value).otherwise(kind)
    coded = light.withColumn("fault", fault).select(
        "conv", "present", "turn", "role", "digest", "fault",
        (kind + F.when(F.col("fault").isin(1, 2), _DROP).when(F.col("fault") == 3, _BROKEN).otherwise(0)).alias("code"))
    made = StructType([StructField("conv", rows.schema[conv].dataType),
                       StructField("audit", StringType()), *[StructField(c, LongType()) for c in _COUNTS]])
    sorted_rows = coded.sortWithinPartitions("conv", *_order()).select("conv", "present", "turn", "code", "fault")
    return map_batches(sorted_rows, _plan(_arrow(made)), made).select(
        F.col("conv").alias("conv_id"), *_COUNTS, "audit")


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each turn of the repaired conversation; rows are read as needed."""
    state = START
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            yield edit, _NAME[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = _INITIALS[role[0]]
            yield edit, role, text
        elif edit == "R":
            state = _NEXT[state]
            yield edit, _NAME[state], text


def _conversations(batches: Batches) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Plan row and rows of each conversation, streamed."""
    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    stream = rows()
    ahead = next(stream, None)

    def turns() -> Iterator[tuple[str, str]]:
        nonlocal ahead
        while ahead is not None and ahead["audit"] is None:
            row, ahead = ahead, next(stream, None)
            yield row["role"], row["text"]

    while ahead is not None:
        plan, ahead = ahead, next(stream, None)
        taken = turns()
        yield plan, taken
        for _ in taken:
            pass


def _with_plans(rows: DataFrame, plans: DataFrame, conv: str, turn: str, role: str, text: str,
                present: Column | None) -> DataFrame:
    """Every conversation's plan and then its rows, in order."""
    source = _read(rows, conv, turn, role, text, present).filter("present").drop("present")
    heads = plans.withColumnRenamed("conv_id", "conv")
    return source.unionByName(heads, allowMissingColumns=True).repartition("conv").sortWithinPartitions(
        "conv", F.col("audit").isNull(), *_order()).drop("digest", "turn")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: ``conv_id``, ``place`` from 0, ``role``, ``text`` and ``edit`` (K, R or I).

    Faults, order, nulls and repeats as in :func:`plan_edits`; a conversation of which
    nothing stays has no rows.
    """
    made = StructType([StructField("conv_id", rows.schema[conv].dataType), StructField("place", LongType()),
                       StructField("role", StringType()), StructField("text", StringType()),
                       StructField("edit", StringType())])
    schema = _arrow(made)

    def run(batches: Batches) -> Batches:
        for plan, taken in _conversations(batches):
            out = []
            for place, (edit, name, said) in enumerate(_edited(plan["audit"], taken)):
                out.append((plan["conv"], place, name, said, edit))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    plans = plan_edits(rows, conv, turn, role, text)
    return map_batches(_with_plans(rows, plans, conv, turn, role, text, None), run, made)


def repair_digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   present: Column | None = None) -> DataFrame:
    """:func:`plan_edits` with ``repaired_sha256``: the repaired ``role:text``, joined by line feeds.

    The hash of a conversation is a chain over its turns, so one task reads them all in
    order; it holds one batch of them.  Nothing left hashes as the empty string.
    """
    plans = plan_edits(rows, conv, turn, role, text, present)
    made = StructType([StructField("conv", rows.schema[conv].dataType), *[StructField(c, LongType()) for c in _COUNTS],
                       StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    schema = _arrow(made)

    def run(batches: Batches) -> Batches:
        done = []
        for plan, taken in _conversations(batches):
            digest = hashlib.sha256()
            for place, (_, name, said) in enumerate(_edited(plan["audit"], taken)):
                digest.update(f"{chr(10) if place else ''}{name}:{said}".encode())
            done.append({**{f.name: plan.get(f.name) for f in schema}, "repaired_sha256": digest.hexdigest()})
            if len(done) == 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return map_batches(_with_plans(rows, plans, conv, turn, role, text, present), run, made).withColumnRenamed(
        "conv", "conv_id")


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``present`` of rows damaged by the checksum of conversation and turn.

    The checksum of ``conv_id:turn`` modulo 20 says how: 0 drops the row (``present`` is
    false), 1 empties its text, 2 takes out ``.``, ``!`` and ``?``, 3 repeats it, 4 makes
    it the user's.  A null in any column is one space there.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    way = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    return rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), way.alias("way")).select(
        "conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        (F.col("way") != 0).alias("present"),
        F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("repeat"),
    ).drop("repeat")
