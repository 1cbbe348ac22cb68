"""Repair of conversation structure by a shortest path with scalar big-integer weights.

The rows of a conversation, in order, are the steps of an acyclic graph over four states (nothing yet, after the system
row, after a user row, after an assistant row).  Each edge edits one row: keep it, give it another role or delete it.  A
path's weight is one integer: its high digits carry the cost, its low digits the edits' letters at fixed places, from the
first row down, with zeros where rows are still to come.  The ordinary least integer of each state is therefore the
cheapest path and, among those, the one whose letters come first in ASCII order.

An insertion costs more than deleting two rows.  Taking an inserted row out of a repair together with the row that it
pairs with (and with the system row, if none of the others is left) leaves a legal conversation that is cheaper, so no
cheapest repair inserts; the graph holds no such edge, and the letters of all paths line up.

The low digits have room for ``BLOCK`` rows.  At the end of a block the letters leave the integer: the states' paths so far
are ranked, and the rank (one of four) becomes the digit in front of the next block's letters.  So weights stay small, and
a conversation streams through one task row by row: four integers, the letters so far and four running digests are
all that is held, however long it is.  A digest has to see its conversation in order, so one is never spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import map_arrow

#: Costs of the edits, extra cost of a truncated row that stays, and white space.
REROLE, DELETE, TRUNCATED = 1, 2, 5
WHITE = " \t\n\x0b\x0c\r"
LETTERS = " DIKR"  #: a letter's digit is its place; 0 is padding
BLOCK = 256  #: rows whose letters an integer holds
_BASE = len(LETTERS)
_LOW = _BASE ** BLOCK
_COST = 4 * _LOW  #: one unit of cost, above the rank digit and the letters
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after a row whose role starts with the letter; a legal conversation ends in _START or _ASSISTANT.
_NEXT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("blank", "duplicate", "truncated")
RESULT = ("gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256")


def _letters(low: int, rows: int) -> str:
    """The first ``rows`` letters of the low digits."""
    low //= _BASE ** (BLOCK - rows)
    out = []
    for _ in range(rows):
        low, digit = divmod(low, _BASE)
        out.append(LETTERS[digit])
    return "".join(reversed(out))


class Repair:
    """The cheapest repair of one conversation, whose rows are added in order."""

    def __init__(self):
        self.weights: dict[int, int] = {_START: 0}
        self.digests = {_START: (hashlib.sha256(), False)}
        self.before: list = [None]  # by rank: letters of the blocks that are over, as (path before, letters)
        self.rows = 0  # in the present block

    def add(self, role: str, text: str, fault: str | None) -> None:
        """A row and its fault; blank and duplicate rows have to go."""
        initial, place = role[:1], _BASE ** (BLOCK - 1 - self.rows)
        options = [(None, DELETE * _COST + 1 * place, None)]
        if fault in (None, "truncated"):
            stay = TRUNCATED * _COST * (fault is not None)
            options.append((initial, stay + 3 * place, role))
            options += [(letter, stay + REROLE * _COST + 4 * place, name) for letter, name in _ROLES.items()]
        best: dict[int, tuple[int, int, str | None]] = {}
        for state, weight in self.weights.items():
            for symbol, more, name in options:
                to = state if symbol is None else _NEXT.get((state, symbol))
                if to is not None and (to not in best or weight + more < best[to][0]):
                    best[to] = (weight + more, state, name)
        line, digests = text.encode("utf-8", "surrogatepass"), {}
        for to, (_, state, name) in best.items():
            digest, begun = self.digests[state]
            if name is not None:
                digest = digest.copy()
                digest.update(b"\n" * begun + name.encode() + b":" + line)
            digests[to] = (digest, begun or name is not None)
        self.weights, self.digests = {to: w for to, (w, _, _) in best.items()}, digests
        self.rows += 1
        if self.rows == BLOCK:
            self._turn_over()

    def _turn_over(self) -> None:
        """Move the block's letters out of the weights and rank the paths."""
        paths = sorted({w % _COST for w in self.weights.values()})
        self.before = [(self.before[p // _LOW], _letters(p % _LOW, BLOCK)) for p in paths]
        rank = {p: r for r, p in enumerate(paths)}
        self.weights = {q: w // _COST * _COST + rank[w % _COST] * _LOW for q, w in self.weights.items()}
        self.rows = 0

    def result(self) -> tuple[int, str, str]:
        """(cost, audit letters, SHA-256 of the repaired rows)."""
        state = min((q for q in (_START, _ASSISTANT) if q in self.weights), key=self.weights.get)
        weight = self.weights[state]
        parts, path = [_letters(weight % _LOW, self.rows)], self.before[weight % _COST // _LOW]
        while path is not None:
            path, letters = path
            parts.append(letters)
        return weight // _COST, "".join(reversed(parts)), self.digests[state][0].hexdigest()


class _Conversation:
    """Counts and repair of one conversation while its rows stream by."""

    def __init__(self):
        self.repair, self.counts = Repair(), dict.fromkeys((*FAULTS, "illegal"), 0)
        self.last = self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: str | None, late: bool) -> None:
        row = (turn, role, text)
        if fault != "blank" and (late or row == self.last):
            fault = "duplicate"
        if fault:
            self.counts[fault] += 1
        if self.last is not None and (self.last[1][:1], role[:1]) not in _LEGAL:
            self.counts["illegal"] += 1
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        self.last = row
        self.repair.add(role, text, fault)

    def result(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (gaps, *(self.counts[k] for k in (*FAULTS, "illegal")), *self.repair.result())


def _with_faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with ``fault`` (blank or truncated, else null) and ``late``: role and text occur at a smaller turn.

    Role and text are compared by a digest, pre-aggregated; only pairs that occur at several turns are joined back.
    """
    same = F.sha2(F.concat_ws(":", F.length("role"), F.col("role"), F.col("text")), 256)
    rows = rows.withColumn("__same", same)
    nulls = F.max(F.col("turn").isNull().cast("int"))
    again = (rows.groupBy(F.col("conv").alias("__conv"), F.col("__same").alias("__key")).agg(F.min("turn").alias("__first"), F.max("turn").alias("__last"), nulls.alias("__nulls"))
             .filter("__first < __last or (__nulls = 1 and __first is not null)"))
    rows = rows.join(again, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("__same") == F.col("__key")), "left")
    late = F.coalesce(F.col("turn").isNotNull() & ((F.col("__nulls") == 1) | (F.col("turn") > F.col("__first"))), F.lit(False))
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.select("conv", "turn", "role", "text", fault.alias("fault"), late.alias("late"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Each conversation's rows together and in order: by turn (nulls first), ties by role, then text."""
    return rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")


def _plain(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    q = lambda c: F.col(f"`{c}`")
    return rows.select(q(conv_col).alias("conv"), q(turn_col).cast("long").alias("turn"), F.coalesce(q(role_col), F.lit(" ")).alias("role"), F.coalesce(q(text_col), F.lit(" ")).alias("text"))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows are taken by turn (nulls first), then role, then text.  A row's fault is the first that holds:
    blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (does not end in
    ``.``, ``!`` or ``?``).  Blank and duplicate rows are deleted; the others are kept, given the role user or assistant,
    or deleted, so that the roles' initials read ``(s?(ua)+)?`` at the least cost; ``audit`` holds the edits' letters.
    ``gaps`` counts the turns that are missing between the least and the largest, ``illegal`` the neighbours whose
    initials are not su, ua or au.  A null role or text is one space; a null id is a conversation of its own; other
    columns are ignored; an empty table gives an empty result.
    """
    faults = _with_faults(_plain(rows, conv_col, turn_col, role_col, text_col))
    numbers = [F.lit(0).cast("long").alias(c) for c in RESULT[:6]]
    schema = rows.select(F.col(f"`{conv_col}`").alias("conv"), *numbers, F.lit("").alias("audit"), F.lit("").alias("repaired_sha256")).schema

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []
        types = None
        for batch in batches:
            types = batch.schema.field(0).type
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for conv, *row in zip(*columns):
                if state is None or conv != at:
                    if state is not None:
                        done.append((at, *state.result()))
                    at, state = conv, _Conversation()
                state.add(*row)
            if len(done) >= 1000:
                yield _batch(done, types)
                done = []
        if state is not None:
            done.append((at, *state.result()))
            yield _batch(done, types)
    return map_arrow(_in_order(faults), job, schema).withColumnRenamed("conv", conv_col)


def _batch(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", *RESULT])


def apply_repairs(rows: DataFrame, repairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(``conv_col``, place, role, text): the rows that ``repairs`` leaves of each conversation, places counted from 0.

    ``repairs`` is the result of ``repair_conversations`` on the same rows.
    """
    plain = _plain(rows, conv_col, turn_col, role_col, text_col)
    schema = plain.select("conv", F.lit(0).cast("long").alias("nth"), "role", "text").schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, -1
        for batch in batches:
            places = []
            for conv in batch.column(0).to_pylist():
                n = n + 1 if n >= 0 and conv == at else 0
                at = conv
                places.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), batch.column(2), batch.column(3)], names=["conv", "nth", "role", "text"])
    numbered = map_arrow(_in_order(plain), number, schema)
    edits = repairs.select(F.col(f"`{conv_col}`").alias("__conv"), F.posexplode(F.split("audit", "")).alias("__nth", "__edit"))
    kept = numbered.join(edits, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("nth") == F.col("__nth")) & (F.col("__edit") != "D"))

    def roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, odd = None, -1, 0
        for batch in batches:
            out, places = [], []
            for conv, role, edit in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                if n < 0 or conv != at:
                    at, n, odd = conv, -1, int(edit == "K" and role[:1] == "s")
                n += 1
                places.append(n)
                out.append(role if edit == "K" else ("user", "assistant")[(n - odd) % 2])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), pa.array(out, pa.string()), batch.column(3)], names=["conv", "place", "role", "text"])
    ordered = kept.select("conv", "nth", "role", "text", "__edit").repartition("conv").sortWithinPartitions("conv", "nth")
    return map_arrow(ordered, roles, schema.simpleString().removeprefix("struct<").removesuffix(">").replace("nth:", "place:")).withColumnRenamed("conv", conv_col)


def damage(rows: DataFrame) -> DataFrame:
    """Conversation rows with seeded faults, by crc32 of ``conv_id:turn`` modulo 20 (a null is one space): 0 drops a row, 1 empties its
    text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row, 4 makes its role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    times = F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.select("conv_id", "turn", "role", "text").withColumn("__kind", kind).filter("__kind != 0")
            .select("conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(times).alias("__copy")).drop("__copy"))


def repair_all(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``repair_conversations`` of ``rows`` for every conv_id of ``ids``; one without rows has zeros, no letters and the digest of nothing."""
    every = ids.select(F.col("conv_id").alias("__id")).distinct()
    out = every.join(repair_conversations(rows), F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    empty = {**dict.fromkeys(RESULT[:6], F.lit(0).cast("long")), "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return out.select(F.col("__id").alias("conv_id"), *[F.coalesce(c, empty[c]).alias(c) for c in RESULT])
