import hashlib
import itertools
import random
import re
import zlib

import pytest
from cases import SMALL

from tidemark.llm import repair
from tidemark.llm.queries import op13_interval_parsing
from tidemark.llm.repair import damaged, parse, repair_conversations, repair_digests

SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece int, part int, position int, audit string, messages int"


def slow_audit(rows):
    """(cost, audit, final messages) of (role, text, fault) rows by trying all edits, cheapest first.

    A search over (rows done, initials so far modulo the grammar) that keeps whole
    audits, so ties are told apart at the end only.
    """
    best = {(0, ""): [(0, "", ())]}
    results = []

    def grown(initials, role):
        initials += role
        return initials if re.fullmatch("s?(ua)*u?", initials) else None

    # Only the initials' legality matters; they are kept whole for independence.
    frontier = {"": (0, "", ())}
    for i in range(len(rows) + 1):
        todo = dict(frontier)
        for _ in range(3):  # insertions before row i, or at the end
            for initials, (cost, audit, out) in list(todo.items()):
                for role in ("user", "assistant"):
                    now = grown(initials, role[0])
                    if now is not None:
                        found = (cost + 3, audit + "I", out + ((role, ""),))
                        if now not in todo or found < todo[now]:
                            todo[now] = found
        if i == len(rows):
            results = [v for k, v in todo.items() if re.fullmatch("(s?(ua)+)?", k)]
            break
        role, text, fault = rows[i]
        frontier = {}
        for initials, (cost, audit, out) in todo.items():
            ways = [(initials, cost + 4, "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for edit, price, as_role in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    now = grown(initials, as_role[:1] or "?")
                    if now is not None:
                        ways.append((now, cost + price + more, edit, out + ((as_role, text),)))
            for now, price, edit, messages in ways:
                found = (price, audit + edit, messages)
                if now not in frontier or found < frontier[now]:
                    frontier[now] = found
    return min(results)


def slow(rows, damage=True):
    """Results of (conv_id, turn, role, text) rows, by conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20 if damage else 19
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, marked = set(), []
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not body else "duplicate" if (role, text) in seen else
                     "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, messages = slow_audit(marked)
        turns = [t for t, _, _ in mine if t is not None]
        faults = [f for _, _, f in marked]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest())
    return out


def results(frame):
    rows = frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        "repaired_sha256").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def frame_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], SCHEMA).repartition(parts)


def random_rows(source, convs, longest):
    rows = []
    for conv in range(convs):
        for turn in range(source.randint(1, longest)):
            role = source.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "Assistant"])
            text = source.choice(["Yes.", "No!", "cut off", "", None, " \n\t", "Odd \x85", f"Number {source.random()}?", "Line.\n\n"])
            rows.append((conv, source.choice([turn, turn, turn, 2 * turn, None]) if source.random() < 0.3 else turn, role, text))
    return rows


def unique(rows):
    """Equal turns with one role and different texts are ordered by a hash that the slow version lacks."""
    seen, out = {}, []
    for conv, turn, role, text in rows:
        if seen.setdefault((conv, turn, role or " "), text) == text:
            out.append((conv, turn, role, text))
    return out


@pytest.mark.parametrize("symbols", [4, 5])
def test_every_short_conversation(symbols):
    marks = {"s": ("system", None), "u": ("user", None), "a": ("assistant", None), "x": ("tool", None),
             "D": ("user", "blank"), "S": ("system", "truncated"), "U": ("user", "truncated"),
             "A": ("assistant", "truncated")}
    letters = "suaDxSUA" if symbols == 4 else "suDA"
    for size in range(symbols + 1):
        for text in itertools.product(letters, repeat=size):
            rows = [(marks[c][0], "t", marks[c][1]) for c in text]
            assert parse("".join(text)) == slow_audit(rows)[:2], text


def test_long_conversations_by_spans():
    source = random.Random(4)
    marks = {"s": ("system", None), "u": ("user", None), "a": ("assistant", None), "x": ("tool", None),
             "D": ("user", "blank"), "U": ("user", "truncated"), "A": ("assistant", "truncated")}
    for size in (9, 16, 17, 31, 64, 77):
        text = "".join(source.choice("suuaaxDUA") for _ in range(size))
        assert parse(text) == slow_audit([(marks[c][0], "t", marks[c][1]) for c in text])[:2]


def test_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    want = slow(rows)
    assert results(op13_interval_parsing(spark, SMALL)) == want
    assert len({v[6] for v in want.values()}) > 5


def test_random_conversations(spark):
    rows = unique(random_rows(random.Random(8), 250, 9))
    assert results(repair_digests(damaged(frame_of(spark, rows)), "gone")) == slow(rows)
    assert results(repair_digests(frame_of(spark, rows))) == slow(rows, damage=False)


def test_hot_conversation_is_spread(spark, monkeypatch):
    """One conversation with most rows: cut over tasks, joined to the same result."""
    source = random.Random(3)
    rows = unique(random_rows(source, 40, 6) + [(99, t, source.choice(["user", "assistant", "user", "assistant", "tool"]),
                                                 source.choice(["Well.", "no end", f"Text {t}.", ""])) for t in range(3000)]
                  + [(98, None, "user", "The same.")] * 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        conversations, pieces = repair_conversations(frame_of(spark, rows))
        parts = {r["piece"] >> 32 for r in pieces.where("conv_id = 99").select("piece").collect()}
        assert len(parts) > 1 and {r[0] for r in conversations.where("messages is null").select("conv_id").collect()} >= {99}
        got = results(repair_digests(damaged(frame_of(spark, rows)), "gone"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = slow([r for r in rows if r[0] != 99])
    assert {k: v for k, v in got.items() if k != 99} == want
    long = got[99]
    monkeypatch.setattr(repair, "HELD_ROWS", 1 << 30)
    kept = [r for r in rows if r[0] == 99]
    marked, seen, texts = [], set(), []
    for _, turn, role, text in kept:
        fault = zlib.crc32(f"99:{turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        for _ in range(2 if fault == 3 else 1):
            delete = not text or (role, text) in seen
            seen.add((role, text))
            marked.append(repair.symbol(role, delete, not delete and text[-1] not in ".!?"))
            texts.append((role, text))
    cost, audit = parse("".join(marked))
    assert long[5:7] == (cost, audit)
    odd = (len(audit) - audit.count("D")) % 2 == 1
    told = "\n".join(f"{r}:{t}" for _, r, t in repair.repaired(audit, texts, 0, odd))
    assert long[7] == hashlib.sha256(told.encode()).hexdigest()


def test_odd_rows(spark):
    long = "word " * 50_000
    sound = next(c for c in range(50, 99) if zlib.crc32(f"{c}: ".encode()) % 20 > 4)
    rows = [(None, None, None, None), (None, 3, "user", "A null id."), (1, 1 << 62, "user", "Far."), (1, -(1 << 62), "user", "Off."),
            (2, 1, "user", ""), (3, 1, "assistant", long), (3, 2, "user", long + "."), (4, 7, "user", "Same."), (4, 7, "user", "Same."),
            (sound, None, "user", "No turn."), (sound, None, "assistant", "None."), (-7, 0, "system", "Only that.")]
    assert results(repair_digests(frame_of(spark, rows))) == slow(rows, damage=False)
    assert results(repair_digests(damaged(frame_of(spark, rows)), "gone")) == slow(rows)
    nothing = frame_of(spark, [])
    assert repair_digests(nothing).collect() == [] and repair_digests(damaged(nothing), "gone").collect() == []


def test_conversation_without_rows(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = results(repair_digests(damaged(frame_of(spark, [(gone, 0, "user", "Lost.")])), "gone"))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
