"""Conversation repair: weighted CYK parsing of turns over spans that double in length."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import ship, written

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
# The grammar (s?(ua)+)? read from left to right: what follows what. A nonterminal
# (p, q) derives the roles that lead from p to q, and every rule has two: (p, q) is
# (p, r) (r, q). A whole conversation leads from the start to the start or to "a".
START = "."
STEPS = {(START, "s"): "s", (START, "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
KINDS = [(p, q) for p in ".sua" for q in ".sua"
         if p == q or (p, q) in STEPS or (p, q) in ((START, "a"), ("s", "a"))]
RULES = [(KINDS.index((p, q)), KINDS.index((p, r)), KINDS.index((r, q)))
         for p, q in KINDS for r in ".sua" if (p, r) in KINDS and (r, q) in KINDS]
WHOLE = [KINDS.index((START, START)), KINDS.index((START, "a"))]
# What a task holds of one conversation before it passes it on row by row.
HELD_ROWS, HELD_CHARS = 4096, 1 << 24
PIECE_ROWS = 1024
LONGEST = (1 << 63) - 1

Cell = tuple  # for every kind (cost, audit), or None where a span cannot be of it


def _joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans.

    Edits of equal cost over the same rows are never beginnings of each other, so the
    least text of a span is made of the least texts of its parts.
    """
    out: list = [None] * len(KINDS)
    for kind, i, j in RULES:
        a, b = left[i], right[j]
        if a is not None and b is not None:
            found = (a[0] + b[0], a[1] + b[1])
            if out[kind] is None or found < out[kind]:
                out[kind] = found
    return tuple(out)


@functools.cache
def _insertions() -> Cell:
    """The cell of a span without rows: insertions until no more help."""
    cell: list = [(0, "") if p == q else None for p, q in KINDS]
    for (p, role), q in STEPS.items():
        if role in ROLES:
            cell[KINDS.index((p, q))] = (INSERT, "I")
    now, before = tuple(cell), None
    while now != before:
        before, now = now, tuple(min(x for x in pair if x is not None) if any(pair) else None
                                 for pair in zip(now, _joined(now, now)))
    return now


def symbol(role: str, delete: bool, truncated: bool) -> str:
    """One letter for what the parser needs of a row."""
    if delete:
        return "D"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return letter.upper() if truncated else letter


@functools.cache
def _row(letter: str) -> Cell:
    """The cell of one row, closed under insertions on both sides."""
    more = TRUNCATED if letter.isupper() else 0
    cell: list = [(DELETE, "D") if p == q else None for p, q in KINDS]
    if letter != "D":
        for (p, role), q in STEPS.items():
            ways = []
            if role == letter.lower():
                ways.append((more, "K"))
            if role in ROLES:
                ways.append((REROLE + more, "R"))
            if ways:
                cell[KINDS.index((p, q))] = min(ways)
    return _joined(_joined(_insertions(), tuple(cell)), _insertions())


@functools.lru_cache(maxsize=1 << 16)
def _short(symbols: str) -> Cell:
    if len(symbols) == 1:
        return _row(symbols)
    half = 1 << ((len(symbols) - 1).bit_length() - 1)
    return _joined(_short(symbols[:half]), _short(symbols[half:]))


class Spans:
    """The cells of spans of 8, 16, 32 ... rows of a growing conversation.

    A derivation of a span may be split anywhere, so that one split a span is enough:
    two neighbours of equal length are joined as soon as they are complete.
    """

    STEP = 8

    def __init__(self) -> None:
        self.tail = ""
        self.done: list[tuple[int, Cell]] = []

    def add(self, letter: str) -> None:
        self.tail += letter
        if len(self.tail) == self.STEP:
            self._push(self.STEP, _short(self.tail))
            self.tail = ""

    def _push(self, size: int, cell: Cell) -> None:
        while self.done and self.done[-1][0] == size:
            size, cell = 2 * size, _joined(self.done.pop()[1], cell)
        self.done.append((size, cell))

    def cell(self) -> Cell:
        out = _short(self.tail) if self.tail else None
        for _, cell in reversed(self.done):
            out = cell if out is None else _joined(cell, out)
        return out if out is not None else _insertions()


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    return min(cell[k] for k in WHOLE if cell[k] is not None)


def parse(symbols: str) -> tuple[int, str]:
    """(cost, audit): the cheapest edits of a conversation, of equal cost the least text."""
    spans = Spans()
    for letter in symbols:
        spans.add(letter)
    return cheapest(spans.cell())


def repaired(audit: str, rows: Iterable[tuple[str, str]], place: int, system: bool) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the messages that edits leave of (role, text) rows.

    ``place`` messages stand before them; ``system`` tells whether the conversation
    begins with a system message, which decides whose turn a place is.
    """
    rows = iter(rows)
    for edit in audit:
        turn = "assistant" if (place - system) % 2 else "user"
        if edit == "I":
            yield "I", turn, ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            yield edit, role if edit == "K" else turn, text
        place += 1


def _system(audit: str) -> bool:
    return (len(audit) - audit.count("D")) % 2 == 1


class Facts:
    """What is counted of consecutive rows of a conversation."""

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, blank: bool, again: bool, cut: bool) -> str:
        self.blank += blank
        self.duplicate += again and not blank
        cut = cut and not blank and not again
        self.truncated += cut
        start = role[:1]
        if self.rows and self.last + start not in ("su", "ua", "au"):
            self.illegal += 1
        self.first = start if not self.rows else self.first
        self.last = start
        self.rows += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        return symbol(role, blank or again, cut)

    def gaps(self) -> int:
        return 0 if self.low is None else min(LONGEST, self.high - self.low + 1 - self.turns)


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
MESSAGES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]))


def _fields(*pairs: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(n, kind) for n, kind in pairs]


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(m["text"]) for m in row.get("messages") or ()) + len(row.get("text") or "")
        if len(held) >= size or chars >= HELD_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _message_rows(found: Iterable[tuple[str, str, str]]) -> list[dict]:
    return [{"edit": e, "role": r, "text": t} for e, r, t in found]


def _settled(conv, rows: list[dict]) -> dict:
    """The result row of a conversation that was held as a whole."""
    facts, seen, spans = Facts(), set(), Spans()
    kept = [r for r in rows if not r["gone"]]
    for r in kept:
        again = (r["role"], r["text"]) in seen
        seen.add((r["role"], r["text"]))
        spans.add(facts.add(r["turn"], r["role"], r["empty"], again, r["cut"]))
    cost, audit = cheapest(spans.cell())
    messages = _message_rows(repaired(audit, ((r["role"], r["text"]) for r in kept), 0, _system(audit)))
    return {"conv_id": conv, "gaps": facts.gaps(), "blank": facts.blank, "duplicate": facts.duplicate,
            "truncated": facts.truncated, "illegal": facts.illegal, "cost": cost, "audit": audit, "messages": messages}


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Sorted rows: conversations that lie within, as results; all others, as they came.

    The first and the last conversation of a task may go on in its neighbours'; they
    are passed on row by row, and so is one too large to be held.
    """
    part = TaskContext.get().partitionId()
    conv, held, chars, position, passing = None, [], 0, 0, True
    begun = False

    def raw(rows: list[dict]) -> Iterator[dict]:
        nonlocal position
        for r in rows:
            yield {**r, "part": part, "position": position}
            position += 1

    for batch in batches:
        for r in batch.to_pylist():
            if not begun or r["conv_id"] != conv:
                if begun and not passing:
                    yield _settled(conv, held)
                passing, held, chars = not begun, [], 0
                conv, begun = r["conv_id"], True
            held.append(r)
            chars += len(r["text"])
            if passing or len(held) > HELD_ROWS or chars > HELD_CHARS:
                passing = True
                yield from raw(held)
                held, chars = [], 0
    yield from raw(held)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The facts and the cell of every (conversation, part), rows sorted by position."""
    at, facts, spans = None, Facts(), Spans()

    def out() -> dict:
        cells = [None if c is None else {"cost": c[0], "audit": c[1]} for c in spans.cell()]
        return {"conv_id": at[0], "part": at[1], **vars(facts), "cells": cells}

    for batch in batches:
        for r in batch.to_pylist():
            if (r["conv_id"], r["part"]) != at:
                if at is not None:
                    yield out()
                at, facts, spans = (r["conv_id"], r["part"]), Facts(), Spans()
            if not r["gone"]:
                spans.add(facts.add(r["turn"], r["role"], r["empty"], r["again"], r["cut"]))
    if at is not None:
        yield out()


def _whole(conv, fragments: list[dict]) -> dict:
    """A conversation's result from its fragments, and every fragment's share of the edits."""
    total = {n: sum(f[n] for f in fragments) for n in ("blank", "duplicate", "truncated", "illegal")}
    level = [tuple(None if c is None else (c["cost"], c["audit"]) for c in f["cells"]) for f in fragments]
    while len(level) > 1:
        level = [_joined(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    cost, audit = cheapest(level[0])
    told = [f for f in fragments if f["rows"]]
    for a, b in zip(told, told[1:]):
        total["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    turns = [f for f in fragments if f["low"] is not None]
    distinct = sum(f["turns"] for f in turns) - sum(a["high"] == b["low"] for a, b in zip(turns, turns[1:]))
    gaps = min(LONGEST, turns[-1]["high"] - turns[0]["low"] + 1 - distinct) if turns else 0
    shares, at, place = [], 0, 0
    for i, f in enumerate(fragments):
        start, todo = at, f["rows"]
        while at < len(audit) and (todo or i + 1 == len(fragments)):
            todo -= audit[at] != "I"
            at += 1
        share = audit[start:at]
        shares.append({"part": f["part"], "edits": share, "place": place, "system": _system(audit)})
        place += len(share) - share.count("D")
    return {"conv_id": conv, "gaps": gaps, **total, "cost": cost, "audit": audit, "shares": shares}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The messages of every (conversation, part); its share of the edits comes first."""
    at, share, held, number = None, None, [], 0
    used = place = 0

    def take(rows: list[tuple[str, str]], last: bool) -> Iterator[dict]:
        nonlocal used, place, number
        start, todo = used, len(rows)
        while used < len(share["edits"]) and (todo or last):
            todo -= share["edits"][used] != "I"
            used += 1
        found = _message_rows(repaired(share["edits"][start:used], rows, place, share["system"]))
        place += len(found)
        for i in range(0, len(found), PIECE_ROWS):
            yield {"conv_id": at[0], "piece": (at[1] << 32) + number, "messages": found[i:i + PIECE_ROWS]}
            number += 1

    chars = 0
    for batch in batches:
        for r in batch.to_pylist():
            if (r["conv_id"], r["part"]) != at:
                if at is not None:
                    yield from take(held, True)
                at, share, held, number = (r["conv_id"], r["part"]), r, [], 0
                used, place, chars = 0, r["place"], 0
                continue
            held.append((r["role"], r["text"]))
            chars += len(r["text"])
            if len(held) >= PIECE_ROWS or chars >= HELD_CHARS:
                yield from take(held, False)
                held, chars = [], 0
    if at is not None:
        yield from take(held, True)


def _mapped(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _batches(run(batches), arrow), schema)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def repair_conversations(rows: DataFrame, gone: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Repair every conversation of ``rows`` (conv_id, turn, role, text).

    Returns the conversations (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, messages) and the pieces (conv_id, piece, messages) of those whose
    ``messages`` are null because they were spread over several tasks; in order of
    piece they are the conversation. A message has its edit (K, R or I), role and text.

    Rows are taken by turn, nulls first, equal turns by role, then by the XXH64 of the
    text. A null role or text is one space; a null conv_id is a conversation like any
    other. Rows for which the boolean column ``gone`` is true only name their
    conversation. A conversation without rows has zeros, an empty audit and no
    messages. Gaps beyond a bigint are the largest one. Other columns are ignored; an
    empty table gives empty results.

    Rows are sorted over all tasks by range, so that a conversation of any length is
    spread: its parts are parsed on their own, and their cells are joined.
    """
    ship(rows.sparkSession)
    text = F.coalesce(rows["text"].cast("string"), F.lit(" "))
    trimmed = F.rtrim(text, F.lit(SPACE))
    kind = rows.schema["conv_id"].dataType
    plain = rows.select(
        rows["conv_id"].alias("conv_id"), rows["turn"].cast("bigint").alias("turn"),
        F.coalesce(rows["role"].cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
        (trimmed == "").alias("empty"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        (F.coalesce(rows[gone], F.lit(False)) if gone else F.lit(False)).alias("gone"))
    order = ["conv_id", "turn", "role", F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = plain.withColumns({"o1": order[3], "o2": order[4]})
    names = ["conv_id", "turn", "role", "o1", "o2"]
    ordered = keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop("o1", "o2")
    of_row = _fields(("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("empty", T.BooleanType()),
                     ("cut", T.BooleanType()), ("gone", T.BooleanType()))
    facts = _fields(*[(n, T.LongType()) for n in FACTS], ("audit", T.StringType()))
    first = written(_mapped(ordered, _first_pass, T.StructType(
        [T.StructField("conv_id", kind), T.StructField("part", T.IntegerType()), T.StructField("position", T.LongType()),
         *of_row, *facts, T.StructField("messages", MESSAGES)])), "conversations")
    settled = first.where("position is null").select("conv_id", *FACTS, "audit", "messages")

    # Conversations at the edges of tasks, and long ones.
    opened = first.where("position is not null").withColumn(
        "said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    place = F.struct("part", "position")
    earliest = opened.where("not gone").groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(
        F.min(place).alias("earliest"))
    flagged = opened.select("conv_id", "part", "position", "turn", "role", "empty", "cut", "gone", "said").join(
        earliest, _same(F.col("conv_id"), F.col("c")) & (F.col("said") == F.col("s")), "left").withColumn(
        "again", F.coalesce(place != F.col("earliest"), F.lit(False)))
    cell = T.ArrayType(T.StructType(_fields(("cost", T.LongType()), ("audit", T.StringType()))))
    of_part = _fields(
        ("part", T.IntegerType()), *[(n, T.LongType()) for n in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")],
        ("first", T.StringType()), ("last", T.StringType()), ("low", T.LongType()), ("high", T.LongType()), ("cells", cell))
    fragments = _mapped(
        flagged.select("conv_id", "part", "position", "turn", "role", "empty", "again", "cut", "gone")
        .repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "position"),
        _fragments, T.StructType([T.StructField("conv_id", kind), *of_part]))
    # At most one fragment a task of the first pass.
    gathered = fragments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*[f.name for f in of_part]))).alias("parts"))
    share = T.ArrayType(T.StructType(_fields(("part", T.IntegerType()), ("edits", T.StringType()), ("place", T.LongType()),
                                             ("system", T.BooleanType()))))

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _whole(r["conv_id"], r["parts"])

    whole = written(_mapped(gathered, combined, T.StructType(
        [T.StructField("conv_id", kind), *facts, T.StructField("shares", share)])), "joined-conversations")
    edits = whole.select("conv_id", F.explode("shares").alias("e")).select("conv_id", "e.*")
    todo = edits.select("conv_id", "part", F.lit(-1).cast("bigint").alias("position"), "edits", "place", "system",
                        F.lit("").alias("role"), F.lit("").alias("text")).union(
        opened.where("not gone").select("conv_id", "part", "position", F.lit(""), F.lit(0).cast("bigint"), F.lit(False), "role", "text"))
    pieces = _mapped(
        todo.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "position"), _pieces,
        T.StructType([T.StructField("conv_id", kind), T.StructField("piece", T.LongType()), T.StructField("messages", MESSAGES)]))
    spread = whole.select("conv_id", *FACTS, "audit", F.lit(None).cast(MESSAGES).alias("messages"))
    return settled.union(spread), pieces


def _told(messages: str) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """SHA-256 of each conversation's pieces in order; they stream past."""
    conv, begun, digest = None, False, hashlib.sha256()
    for batch in batches:
        for r in batch.to_pylist():
            if not begun or r["conv_id"] != conv:
                if begun:
                    yield {"conv_id": conv, "digest": digest.hexdigest()}
                conv, begun, digest = r["conv_id"], True, hashlib.sha256()
            elif r["told"]:
                digest.update(b"\n")
            digest.update(r["told"].encode("utf-8"))
    if begun:
        yield {"conv_id": conv, "digest": digest.hexdigest()}


def repair_digests(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Odd rows as in :func:`repair_conversations`; the digest is that of the repaired
    ``role:text``, joined by line feeds. One digest has to see a conversation's pieces
    in turn: they stream through one task, which holds one piece.
    """
    conversations, pieces = repair_conversations(rows, gone)
    kind = rows.schema["conv_id"].dataType
    streamed = _mapped(
        pieces.select("conv_id", "piece", _told("messages").alias("told")).repartition("conv_id")
        .sortWithinPartitions("conv_id", "piece"), _digests,
        T.StructType([T.StructField("conv_id", kind), T.StructField("digest", T.StringType())]))
    columns = ["conv_id", *FACTS, "audit"]
    held = conversations.where("messages is not null").select(*columns, F.sha2(_told("messages"), 256).alias("repaired_sha256"))
    spread = conversations.where("messages is null").join(
        streamed.withColumnRenamed("conv_id", "c"), _same(F.col("conv_id"), F.col("c")), "left").select(
        *columns, F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return held.union(spread)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 marks the row as gone, 1 empties the text, 2 takes out its full stops,
    exclamation and question marks, 3 gives the row twice, 4 makes it the user's.
    Nulls are written as one space; those of role and text become one.
    """
    def known(name: str) -> Column:
        return F.coalesce(rows[name].cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") < 2, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        rows["conv_id"].alias("conv_id"), rows["turn"].alias("turn"), known("role").alias("role"), known("text").alias("text"),
        fault.alias("fault")).select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") == 0).alias("gone"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
