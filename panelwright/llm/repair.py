"""Cheapest repair of the turn order of conversations, by a run-length dynamic program.

A row is one of a few symbols: what its role starts with, whether it must go
(blank or repeated) and whether it is cut off.  A symbol is a 4x4 min-plus
matrix over what the output ended with, insertions before the row included.
Equal consecutive symbols are one run, and a run of length k is taken in log k
steps through cached binary powers of its matrix.  Choices are then unrolled
run by run for the audit; their steps are cached up to a common cost.

Min-plus products are associative, so a conversation of any length is cut at
the borders of a range sort: slices give one matrix each, the costs to go at
slice ends follow from those matrices, each slice is unrolled for all four
states it may start in, and the chain of states picks one.  Only matrices and
state maps of a conversation meet, one of each per slice.

The one thing that goes through a single task per conversation is the digest
of its whole repaired text, since SHA-256 is sequential; it is streamed in
order and only the hash state is kept.

Defined cases: nulls in role and text count as one space; a null ``conv_id`` is
one conversation; rows with equal turns are ordered by role and text; a role
that starts with none of s, u, a can only be given a new role or deleted.
Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import SPACE, sent_by_value, written
from panelwright.llm.manifest import CRC32_SQL
from panelwright.operators.ordered import range_slices

sent_by_value(__name__)

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
# What the output ended with: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLE_STEP = (USER, USER, ASSISTANT, USER)
ROLE_NAME = {USER: "user", ASSISTANT: "assistant"}
# A symbol: role initial (s, u, a, other), plus 4 if it must go, plus 8 if it is cut off.
INITIALS = "sua"
MUST_GO, CUT_OFF = 4, 8
# Cost to complete the output after the last row: nothing or whole pairs are complete.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40


# --- min-plus transitions ----------------------------------------------------------------------------------------


def keeps(symbol: int, state: int) -> int | None:
    """The state after keeping the row, if it may be kept here."""
    if symbol & MUST_GO:
        return None
    initial = symbol & 3
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of what may be done with a row, in order of the letters; insertions are apart."""
    out = [("D", DELETE, state)]
    extra = TRUNCATED if symbol & CUT_OFF else 0
    if (kept := keeps(symbol, state)) is not None:
        out.append(("K", extra, kept))
    if not symbol & MUST_GO:
        out.append(("R", REROLE + extra, ROLE_STEP[state]))
    return out


def product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in STATES)) for j in STATES) for i in STATES)


def advance(matrix: tuple, after: tuple) -> tuple:
    """Costs to go before a matrix, from those after it."""
    return tuple(min(matrix[s][t] + after[t] for t in STATES) for s in STATES)


# Caches of a worker: powers are a few dozen matrices; the others are emptied when they are full.
_POWERS: dict = {}
_STEPS: dict = {}
_CHOICES: dict = {}
_FULL = 1 << 16


def power(symbol: int, bit: int) -> tuple:
    """The transition of ``2 ** bit`` rows of a symbol, cached."""
    key = symbol, bit
    if key not in _POWERS:
        half = power(symbol, bit - 1) if bit else None
        _POWERS[key] = product(half, half) if bit else _single(symbol)
    return _POWERS[key]


def _single(symbol: int) -> tuple:
    rows = []
    for state in STATES:
        row, at = [FAR] * 4, state
        # Two insertions reach every state that insertions can reach at least cost.
        for inserted in range(3):
            for _, cost, to in edits(symbol, at):
                row[to] = min(row[to], inserted * INSERT + cost)
            at = ROLE_STEP[at]
        rows.append(tuple(row))
    return tuple(rows)


def _bits(n: int) -> Iterator[int]:
    return (b for b in range(n.bit_length()) if n >> b & 1)


def runs(symbols) -> list[tuple[int, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


IDENTITY = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)


def transition(symbols) -> tuple:
    """The matrix of a whole sequence of symbols."""
    out = IDENTITY
    for symbol, n in runs(symbols):
        for bit in _bits(n):
            out = product(out, power(symbol, bit))
    return out


def _back(symbol: int, after: tuple) -> tuple:
    """Costs to go before one row, cached."""
    key = symbol, after
    if key not in _STEPS:
        if len(_STEPS) >= _FULL:
            _STEPS.clear()
        _STEPS[key] = advance(power(symbol, 0), after)
    return _STEPS[key]


def _level(costs: tuple) -> tuple[int, tuple]:
    low = min(costs)
    return low, tuple(c - low for c in costs)


def choices(symbol: int, after: tuple, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest letters for one row, insertions before it included, and the state after it; cached."""
    key = symbol, after, state
    if key not in _CHOICES:
        if len(_CHOICES) >= _FULL:
            _CHOICES.clear()
        _CHOICES[key] = _choices(symbol, after, state)
    return _CHOICES[key]


def _choices(symbol: int, after: tuple, state: int) -> tuple[str, int]:
    letters = ""
    before = _back(symbol, after)
    while True:
        found = [(letter, to) for letter, cost, to in edits(symbol, state) if cost + after[to] == before[state]]
        inserted = INSERT + before[ROLE_STEP[state]] == before[state]
        if inserted and not (found and found[0][0] == "D"):
            letters, state = letters + "I", ROLE_STEP[state]
            continue
        return letters + found[0][0], found[0][1]


def unroll(symbols, after: tuple, state: int, last: bool) -> tuple[str, int]:
    """The audit of a sequence from a state, and the state it ends in; ``after`` are the costs to go behind it."""
    spans = runs(symbols)
    behind = []
    for symbol, n in reversed(spans):
        behind.append(after)
        for bit in _bits(n):
            after = advance(power(symbol, bit), after)
        after = _level(after)[1]
    out = []
    for (symbol, n), after in zip(spans, reversed(behind), strict=True):
        costs = [_level(after)[1]]
        for _ in range(n - 1):
            costs.append(_level(_back(symbol, costs[-1]))[1])
        for follows in reversed(costs):
            letters, state = choices(symbol, follows, state)
            out.append(letters)
    if last:
        while END[state]:
            out.append("I")
            state = ROLE_STEP[state]
    return "".join(out), state


# --- rows, slices, pieces ------------------------------------------------------------------------------------------


def _visible(text: str) -> Column:
    return F.rtrim(F.col(text), F.lit(SPACE))


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """The rows in order, cut into slices: ``conv_id, turn, role, text, present`` and what the faults are found from; written."""
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        present.alias("present"),
    )
    # Rows that are alike in all of these may stand in either order.
    rows = rows.withColumn("timed", F.col("turn").isNotNull())
    order = [("timed", True), ("turn", True), ("role", True), ("text", True), ("present", True)]
    sliced = range_slices(rows, ["conv_id"], order).drop("timed")
    said = F.struct("role", "text")
    flagged = sliced.select(
        "*",
        F.substring("role", 1, 1).alias("initial"),
        (_visible("text") == "").alias("blank"),
        (~F.substring(_visible("text"), -1, 1).isin(".", "!", "?")).alias("cut"),
        F.xxhash64(said).alias("h1"),
        F.hash(F.struct("text", "role")).alias("h2"),
    )
    return written(flagged, "repair-rows")


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Join where null keys are equal; the columns of ``a`` and the rest of ``b``."""
    other = b.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return a.join(other, cond, how).drop(*[f"__k_{k}" for k in keys])


def with_faults(rows: DataFrame) -> DataFrame:
    """Narrow rows with ``fault`` (blank, duplicate, truncated or null) and ``symbol``."""
    narrow = rows.where("present").select("conv_id", "__slice", "__seq", "turn", "initial", "blank", "cut", "h1", "h2")
    at = F.struct("__slice", "__seq")
    # Only what was said more than once is joined back, one row each, so a hot text is the long side of the join.
    repeated = narrow.groupBy("conv_id", "h1", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("times"))
    repeated = repeated.where(F.col("times") > 1).drop("times")
    marked = _same(narrow, repeated, ("conv_id", "h1", "h2"), "left")
    again = F.col("first").isNotNull() & (at > F.col("first"))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated")
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.nullif("initial", F.lit(""))), F.lit(0)) - 1, F.lit(3))
    must_go = F.coalesce(fault.isin("blank", "duplicate"), F.lit(False))
    symbol = initial + F.when(must_go, MUST_GO).otherwise(0) + F.when(fault == "truncated", CUT_OFF).otherwise(0)
    return marked.select("conv_id", "__slice", "__seq", "turn", "initial", fault.alias("fault"), symbol.cast("byte").alias("symbol"))


def pieces(faults: DataFrame) -> DataFrame:
    """One row per conversation and slice: symbols in order, counts, and what its neighbours need to count borders."""
    inside = Window.partitionBy("conv_id", "__slice").orderBy("__seq")
    before, time = F.lag("initial").over(inside), F.lag("turn").over(inside)
    pair = F.concat(before, F.col("initial"))
    rows = faults.select(
        "*",
        (pair.isNotNull() & ~pair.isin("su", "ua", "au")).alias("bad"),
        (F.col("turn").isNotNull() & (time.isNull() | (time != F.col("turn")))).alias("new"),
    )
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    edge = F.struct("__seq", "initial")
    return rows.groupBy("conv_id", "__slice").agg(
        F.sort_array(F.collect_list(F.struct("__seq", "symbol"))).getField("symbol").alias("symbols"),
        count("blank"), count("duplicate"), count("truncated"),
        F.count_if("bad").alias("illegal"),
        F.count_if("new").alias("turns"),
        F.min("turn").alias("low"), F.max("turn").alias("high"),
        F.min(edge).getField("initial").alias("first"), F.max(edge).getField("initial").alias("last"),
    )


def _transitions(symbols: pd.Series) -> pd.Series:
    return symbols.map(lambda s: [c for row in transition(s) for c in row])


def _costs_to_go(matrices: pd.Series) -> pd.Series:
    """For the matrices of a conversation's slices in order: the costs to go behind each, then those before the first."""

    def of(flat) -> list:
        out, after = [], END
        for m in reversed(list(flat)):
            out.append(list(after))
            after = advance(tuple(tuple(m[4 * i : 4 * i + 4]) for i in STATES), after)
        return [*out[::-1], list(after)]

    return matrices.map(of)


def _audits(symbols: pd.Series, after: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    """Audit and end state for each state a slice may start in; a first slice starts with nothing."""
    out = []
    for s, a, f, end in zip(symbols, after, first, last, strict=True):
        s, a = list(s), tuple(int(c) for c in a)
        out.append([unroll(s, a, state, end) if state == START or not f else ("", 0) for state in STATES])
    return pd.DataFrame({"audits": [[x for x, _ in o] for o in out], "ends": [[e for _, e in o] for o in out]})


def _starts(ends: pd.Series) -> pd.Series:
    def of(maps) -> list:
        out, state = [], START
        for m in maps:
            out.append(state)
            state = int(m[state])
        return out

    return ends.map(of)


def _per_slice(pieces: DataFrame, value: str) -> DataFrame:
    """Per conversation the slices in order with one small value of each."""
    both = F.sort_array(F.collect_list(F.struct("__slice", value)))
    return pieces.groupBy("conv_id").agg(both.alias("of")).select("conv_id", F.col("of.__slice").alias("slices"), F.col(f"of.{value}").alias(value))


def audits(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, __slice, audit, start)`` of each piece, and ``(conv_id, cost)``."""
    matrix = F.pandas_udf(_transitions, "array<long>")
    go = F.pandas_udf(_costs_to_go, "array<array<long>>")
    chains = _per_slice(cut.select("conv_id", "__slice", matrix("symbols").alias("matrix")), "matrix")
    chains = written(chains.select("conv_id", "slices", go("matrix").alias("go")), "repair-costs")
    cost = chains.select("conv_id", F.element_at("go", -1)[START].alias("cost"))
    ends = chains.select("conv_id", F.size("slices").alias("k"), F.posexplode("slices").alias("i", "__slice"), "go")
    ends = ends.select("conv_id", "__slice", (F.col("i") == 0).alias("is_first"), (F.col("i") == F.col("k") - 1).alias("is_last"), F.get("go", F.col("i")).alias("after"))
    choose = F.pandas_udf(_audits, "audits array<string>, ends array<int>")
    solved = _same(cut.select("conv_id", "__slice", "symbols"), ends, ("conv_id", "__slice"), "inner")
    solved = solved.select("conv_id", "__slice", choose("symbols", "after", "is_first", "is_last").alias("found"))
    solved = written(solved.select("conv_id", "__slice", "found.*"), "repair-audits")
    start = F.pandas_udf(_starts, "array<int>")
    states = _per_slice(solved.select("conv_id", "__slice", "ends"), "ends").select("conv_id", F.arrays_zip("slices", start("ends").alias("start")).alias("of"))
    states = states.select("conv_id", F.explode("of").alias("of")).select("conv_id", F.col("of.slices").alias("__slice"), F.col("of.start").alias("start"))
    chosen = _same(solved, states, ("conv_id", "__slice"), "inner")
    return chosen.select("conv_id", "__slice", F.get("audits", F.col("start")).alias("audit"), "start"), cost


# --- applying the audit ------------------------------------------------------------------------------------------------


def _with_audits(rows: DataFrame, audit: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows behind the audit of their slice (``__seq`` -1), in order within partitions by ``keys``."""
    texts = rows.where("present").select("conv_id", "__slice", "__seq", "role", "text", F.lit(0).alias("start"))
    heads = audit.select("conv_id", "__slice", F.lit(-1).cast("long").alias("__seq"), F.lit("").alias("role"), F.col("audit").alias("text"), "start")
    both = texts.unionByName(heads).repartition(*keys)
    return both.sortWithinPartitions("conv_id", "__slice", "__seq")


class _Editor:
    """Walks through sorted rows and says what each becomes."""

    def __init__(self):
        self.key, self.letters, self.at, self.state = None, "", 0, START

    def _inserted(self):
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at, self.state = self.at + 1, ROLE_STEP[self.state]
            yield ROLE_NAME[self.state], "", "I"

    def head(self, key, letters: str, state: int):
        self.key, self.letters, self.at, self.state = key, letters, 0, state

    def finish(self):
        yield from self._inserted()

    def row(self, role: str, text: str):
        yield from self._inserted()
        letter, self.at = self.letters[self.at], self.at + 1
        if letter == "R":
            self.state = ROLE_STEP[self.state]
            yield ROLE_NAME[self.state], text, letter
        elif letter == "K":
            self.state = keeps(INITIALS.index(role[0]), self.state)
            yield role, text, letter


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    editor, number = _Editor(), 0
    for batch in batches:
        out: list[tuple] = []

        def put(found):
            nonlocal number
            for role, text, letter in found:
                out.append((*editor.key, number, role, text, letter))  # noqa: B023
                number += 1

        for conv, piece, seq, role, text, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seq < 0:
                put(editor.finish())
                editor.head((conv, piece), text, state)
                number = 0
            else:
                put(editor.row(role, text))
        yield _table(out)
    # The last piece may still end in insertions.
    out = []
    for role, text, letter in editor.finish():
        out.append((*editor.key, number, role, text, letter))
        number += 1
    yield _table(out)


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _REPAIRED]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _REPAIRED, strict=True)], schema=_REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, audit, repaired_sha256``; the text is hashed as it passes."""
    editor, state = _Editor(), None

    def put(found):
        for role, text, _ in found:
            state[2].update(("\n" * state[3] + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            state[3] = 1

    for batch in batches:
        done = []
        for conv, piece, seq, role, text, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seq < 0:
                if state is not None:
                    put(editor.finish())
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(state)
                    state = [conv, [], sha256(), 0]
                state[1].append(text)
                editor.head((conv, piece), text, start)
            else:
                put(editor.row(role, text))
        yield _hashed(done)
    if state is not None:
        put(editor.finish())
        yield _hashed([state])


def _hashed(done: list) -> pa.RecordBatch:
    arrays = [pa.array([d[0] for d in done], pa.int64()), pa.array(["".join(d[1]) for d in done], pa.string()), pa.array([d[2].hexdigest() for d in done], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "audit", "repaired_sha256"])


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired rows: ``conv_id``, ``piece`` and ``place`` (their order), ``role``, ``text`` and ``edit`` (K, R or I)."""
    rows = ordered_rows(conversations)
    audit, _ = audits(written(pieces(with_faults(rows)), "repair-pieces"))
    return _with_audits(rows, audit, ("conv_id", "__slice")).mapInArrow(_repaired, "conv_id long, piece int, place long, role string, text string, edit string")


def report(conversations: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost and audit of the repair, digest of the repaired text."""
    rows = ordered_rows(conversations)
    cut = written(pieces(with_faults(rows)), "repair-pieces")
    audit, cost = audits(cut)
    digest = _with_audits(rows, audit, ("conv_id",)).mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")
    # Pieces of a conversation: their borders are pairs and turns of their own.
    parts = Window.partitionBy("conv_id").orderBy("__slice")
    pair = F.concat(F.lag("last").over(parts), F.col("first"))
    shared = F.coalesce((F.max("high").over(parts.rowsBetween(Window.unboundedPreceding, -1)) == F.col("low")).cast("long"), F.lit(0))
    edges = cut.drop("symbols").select(
        "*", (pair.isNotNull() & ~pair.isin("su", "ua", "au")).cast("long").alias("border"), (F.col("turns") - shared).alias("own_turns")
    )
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    counts = edges.groupBy("conv_id").agg(
        F.coalesce(F.max(wide("high")) - F.min(wide("low")) + 1 - F.sum("own_turns"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.col("border")).alias("illegal"),
    )
    found = _same(_same(counts, cost, ("conv_id",), "inner"), digest, ("conv_id",), "inner")
    out = _same(rows.select("conv_id").distinct(), found, ("conv_id",), "left")
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id",
        *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in longs],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The trial damage: by checksum of conversation and turn a row is dropped (kept as not ``present``), emptied, cut off, repeated or given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def result(conversations: DataFrame) -> DataFrame:
    """Contract columns of the damaged conversations: ``conv_id``, counts, ``cost``, ``audit``, ``repaired_sha256``."""
    return report(damaged(conversations))


def _oracle_sql() -> str:
    """A plain program over rows: one step per row and state, the least (cost, audit) kept of each."""
    names = " sua"
    steps = []
    for state in STATES:
        done = [("D", "", state, DELETE), ("R", "", ROLE_STEP[state], REROLE)]
        done += [("K", names[kept], kept, 0) for kept in (SYSTEM, USER, ASSISTANT) if keeps(kept - 1, state) == kept]
        for letter, initial, to, cost in done:
            tail = ""
            for n in range(3):
                said = ROLE_NAME.get(to, "") if letter == "R" and not n else said if n else ""
                steps.append(f"({state}, '{letter}', '{initial}', {to}, {cost + n * INSERT}, '{'I' * n}', '{said}', '{tail}')")
                to = ROLE_STEP[to]
                tail += f"~{ROLE_NAME[to]}:"
    crc = CRC32_SQL.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
  damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE kind <> 0),
  numbered AS (SELECT conv_id, turn, role, text, coalesce(CAST(conv_id AS VARCHAR), '-') AS conv, rtrim(text, {spaces}) AS seen,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) || left(role, 1) AS pair FROM damaged),
  turns AS (SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
      FROM numbered),
  step(f, letter, initial, t, cost, inserted, said, tail) AS (VALUES {", ".join(steps)}),
  best AS (
    SELECT conv, 0::BIGINT AS i, s AS st, {{'c': c, 'a': a, 'o': o}} AS b
    FROM (SELECT DISTINCT conv FROM numbered), (VALUES (0, 0, '', ''), (2, 3, 'I', '~user:'), (3, 6, 'II', '~user:~assistant:')) v(s, c, a, o)
    UNION ALL
    SELECT conv, i, st, min(b) FROM (
      SELECT d.conv, r.i, t AS st, {{'c': b.c + cost + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN {TRUNCATED} ELSE 0 END,
             'a': b.a || letter || inserted,
             'o': b.o || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN '~' || role || ':' || text ELSE '~' || said || ':' || text END || tail}} AS b
      FROM best d JOIN turns r ON r.conv = d.conv AND r.i = d.i + 1
      JOIN step ON f = d.st AND (initial = '' OR initial = left(role, 1)) AND (letter = 'D' OR fault IS NULL OR fault = 'truncated')) GROUP BY ALL),
  done AS (SELECT conv, min(b) AS b FROM best JOIN (SELECT conv, max(i) AS n FROM turns GROUP BY conv) USING (conv) WHERE i = n AND st IN (0, 3) GROUP BY conv),
  counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
      count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts k ON k.conv = coalesce(CAST(c.conv_id AS VARCHAR), '-')
LEFT JOIN done d ON d.conv = coalesce(CAST(c.conv_id AS VARCHAR), '-')"""


ORACLE_SQL = _oracle_sql().replace("'~", "chr(10) || '").replace("~", "' || chr(10) || '")
