"""Exact repeated substrings of a collection, by column-wise multi-document construction.

Every window of LENGTH bytes has an anchor: its k-gram with the least hash. Equal
windows have equal anchors at equal places, so only texts around equal anchors are
compared, aligned at the anchor. In a collection of such aligned stretches one symbol
of each is inserted per round: the order of the stretches by what was read so far
(the collection's Burrows-Wheeler order) and the lengths that neighbours have in
common are updated in one pass, and windows of neighbours that have LENGTH or more
bytes in common are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts, written

LENGTH = 400
GRAM = 128
# Stretches of one anchor that one collection holds; more are dealt over several.
SHARE = 16_384
# Stretches whose columns are read together.
COLLECTION = 4096

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 28) - 1)
ABSENT = 256


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every k-gram, doubling the length read: the gram is a sum of powers of two."""
    level = _mix(raw.astype(np.uint64) + np.uint64(1))
    size, done, out = 1, 0, None
    n = len(raw) - gram + 1
    while True:
        if gram & size:
            part = level[done:done + n]
            out = part.copy() if out is None else _mix(out * _BASE + part)
            done += size
        if 2 * size > gram:
            return out
        level = level[:-size] * _BASE + (level[size:] ^ (level[size:] >> np.uint64(29)))
        level = level ^ (level >> np.uint64(32))
        size *= 2


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by running minima of blocks from both ends."""
    n = len(values)
    full = -(-n // width) * width
    filled = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    filled[:n] = values
    grid = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def stretches(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first window, windows, anchor place in the first window) of each run of windows.

    Consecutive windows with the same anchor form a run; the leftmost of equal
    hashes is the anchor.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    h = gram_hashes(data, gram)
    marked = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_least(marked, length - gram + 1) & _PLACE).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    count = np.diff(np.append(first, len(at)))
    return h[at[first]].view(np.int64), first, count, at[first] - first


_RUNS = "anchor bigint, body bigint, t1 bigint, t2 int, first int, windows int, shift int"


def _find_runs(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        parts = []
        for text, t1, t2 in zip(*(batch.column(c).to_pylist() for c in ("text", "t1", "t2"))):
            raw = text.encode("utf-8")
            if len(raw) < length:
                continue
            anchor, first, count, shift = stretches(raw, length, gram)
            view = memoryview(raw)
            body = np.array([xxh3_64_intdigest(view[f:f + c + length - 1]) for f, c in zip(first.tolist(), count.tolist())],
                            dtype=np.uint64).view(np.int64)
            n = len(first)
            parts.append((anchor, body, np.full(n, t1, np.int64), np.full(n, t2, np.int32), first.astype(np.int32),
                          count.astype(np.int32), shift.astype(np.int32)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)],
                                             [f.split()[0] for f in _RUNS.split(", ")])


def column_matches(columns: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Insert column after column of aligned rows; yield where rows share ``length`` symbols.

    ``columns`` is (column, row); ABSENT symbols match nothing. ``order`` sorts the
    rows by their symbols read backwards, ``common[i]`` is how many of the last
    symbols rows order[i-1] and order[i] share, counted up to ``length``. A column
    keeps the order among rows with equal symbols; two rows that become neighbours
    share one more than the least common length between them.
    Yields (column, order, opens, meets): the row starts a group of equal windows or
    is like the row before it.
    """
    count = columns.shape[1]
    order = np.arange(count)
    common = np.zeros(count, dtype=np.int32)
    for j, column in enumerate(columns):
        symbols = column[order]
        place = np.argsort(symbols, kind="stable")
        new = symbols[place]
        # Least common length in (place[i-1], place[i]] by a table of powers of two.
        left, right = place[:-1] + 1, place[1:] + 1
        same = (new[1:] == new[:-1]) & (new[1:] != ABSENT)
        span = np.where(same, right - left, 1)
        least = np.zeros(count - 1, dtype=np.int32)
        level, size, table = np.frexp(span)[1] - 1, 1, common
        for k in range(int(level.max()) + 1 if count > 1 else 0):
            pick = np.nonzero(same & (level == k))[0]
            if len(pick):
                least[pick] = np.minimum(table[left[pick]], table[right[pick] - size])
            if 2 * size <= len(common):
                table = np.minimum(table[:-size], table[size:])
            size *= 2
        common = np.zeros(count, dtype=np.int32)
        common[1:] = np.where(same, np.minimum(least + 1, length), 0)
        order = order[place]
        meets = common >= length
        if meets.any():
            yield j, order, np.append(meets[1:], False) & ~meets, meets


_DUPLICATES = "anchor bigint, body bigint, low int, high int, w1 bigint, w2 bigint, open boolean"


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(flags.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist()))


def _collection(rows: list[tuple], length: int, gram: int) -> list[tuple]:
    """Repeated windows of aligned stretches; those of dealt anchors also as window hashes.

    A row is (anchor, body, shift, shares, text). Results are (anchor, body, first
    and last repeated window, window hash, open): rows with a hash tell other
    collections of a dealt anchor what was seen here.
    """
    from xxhash import xxh3_128_intdigest

    reach = length - gram
    width = 2 * reach + gram
    columns = np.full((width, len(rows)), ABSENT, dtype=np.uint16)
    for i, (_, _, shift, _, text) in enumerate(rows):
        columns[reach - shift:reach - shift + len(text), i] = np.frombuffer(text, dtype=np.uint8)
    repeated = np.zeros((len(rows), reach + 1), dtype=bool)
    heads = np.zeros((len(rows), reach + 1), dtype=bool)
    shift = np.array([r[2] for r in rows])
    for j, order, opens, meets in column_matches(columns, length):
        for flags, only in ((opens | meets, repeated), (opens, heads)):
            who = order[flags]
            only[who, j - length + 1 - reach + shift[who]] = True
    out = []
    for i, (anchor, body, _, shares, text) in enumerate(rows):
        for low, high in _ranges(repeated[i]):
            out.append((anchor, body, low, high, None, None, False))
        if shares > 1:
            for o in range(len(text) - length + 1):
                if heads[i, o] or not repeated[i, o]:
                    mark = xxh3_128_intdigest(text[o:o + length])
                    out.append((anchor, body, o, o, (mark >> 64) - (1 << 63), (mark & ((1 << 64) - 1)) - (1 << 63),
                                not repeated[i, o]))
    return out


def _collections(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Read stretches sorted by (anchor, part); whole groups share a collection."""
    held: dict[tuple, tuple] = {}
    at = None

    def done():
        found = _collection(list(held.values()), length, gram)
        columns = list(zip(*found)) if found else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                          [f.split()[0] for f in _DUPLICATES.split(", ")])

    for batch in batches:
        for anchor, part, shares, body, shift, data in zip(*(batch.column(c).to_pylist() for c in (
                "anchor", "part", "shares", "body", "shift", "data"))):
            if (anchor, part) != at:
                if len(held) >= COLLECTION:
                    yield done()
                    held = {}
                at = (anchor, part)
            held[anchor, body] = (anchor, body, shift, shares, data)
    if held:
        yield done()


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text."""
    for batch in batches:
        out = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            raw = text.encode("utf-8")
            out += [(w["anchor"], w["part"], w["shares"], w["body"], w["shift"],
                     raw[w["first"]:w["first"] + w["windows"] + length - 1]) for w in wanted]
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                         ["anchor", "part", "shares", "body", "shift", "data"])


def _keys(text: Column) -> list[Column]:
    """What tells texts apart: a hash and the length in bytes."""
    return [F.xxhash64(text).alias("t1"), F.octet_length(text).alias("t2")]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(t1, t2, spans) of every text with repeated bytes; t1 and t2 identify the text.

    ``spans`` are (start, end) byte intervals that together cover each window of
    ``length`` bytes which occurs anywhere else, unordered and overlapping.
    """
    keyed = texts(docs).select("text", *_keys(F.col("text")))
    runs = written(keyed.mapInArrow(lambda b: _find_runs(b, length, gram), _RUNS), "runs")
    distinct = written(runs.groupBy("anchor", "body").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("t1", "t2", "first", "windows", "shift")]), "bodies")
    several = distinct.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    shares = F.ceil(F.col("m") / F.lit(SHARE)).cast("int")
    wanted = (distinct.join(several, "anchor").withColumn("shares", shares)
              .withColumn("part", F.pmod("body", "shares").cast("int"))
              .groupBy("t1", "t2").agg(F.collect_list(F.struct(
                  "anchor", "part", "shares", "body", "shift", "first", "windows")).alias("wanted")))
    # Copies of a text hold the same stretches; one of them is cut.
    once = keyed.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    cut = once.join(wanted, ["t1", "t2"]).select("text", "wanted").mapInArrow(
        lambda b: _cut(b, length), "anchor bigint, part int, shares int, body bigint, shift int, data binary")
    found = written(cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(
        lambda b: _collections(b, length, gram), _DUPLICATES), "repeated")
    # Windows of an anchor dealt over several collections meet by their hash.
    marks = found.where("w1 is not null")
    across = marks.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
    crossing = marks.where("open").join(across, ["w1", "w2"])
    parts = found.where("w1 is null").select("anchor", "body", "low", "high").union(
        crossing.select("anchor", "body", "low", "high"))
    whole = distinct.where("n > 1").select("anchor", "body", F.lit(0).alias("low"), (F.col("windows") - 1).alias("high"))
    some = distinct.where("n = 1").select("anchor", "body").join(parts, ["anchor", "body"]).select(
        "anchor", "body", "low", "high")
    decided = whole.union(some)
    return (runs.join(decided, ["anchor", "body"])
            .select("t1", "t2", F.struct((F.col("first") + F.col("low")).alias("start"),
                                         (F.col("first") + F.col("high") + length).alias("end")).alias("span"))
            .groupBy("t1", "t2").agg(F.collect_set("span").alias("spans")))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _apply(docs: DataFrame, length: int, gram: int, schema: str, result) -> DataFrame:
    spans = repeated_spans(docs, length, gram)
    keyed = texts(docs).select("doc_id", "text", *_keys(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, cuts = text.encode("utf-8"), _merged(found)
                kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(raw)]))
                rows.append((raw, cuts, kept))
            yield result(batch.column("doc_id"), rows)

    return keyed.join(spans, ["t1", "t2"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, kept, removed) of every row: the bytes that are left and the byte spans taken out.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere
    else, in this document or another; strings are judged on the input and never
    cross documents. ``kept`` is binary, as a cut may split a character. Null texts
    are empty; null ids and repeated rows are kept (equal texts repeat each other);
    texts of fewer bytes stay as they are; other columns are ignored.
    """

    def result(ids, rows):
        pairs = [[{"start": a, "end": b} for a, b in cuts] for _, cuts, _ in rows]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([ids, pa.array([k for *_, k in rows], pa.binary()), pa.array(pairs, kind)],
                                          ["doc_id", "kept", "removed"])

    return _apply(docs, length, gram, "doc_id bigint, kept binary, removed array<struct<start:int,end:int>>", result)


def repeat_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): without_repeats as digests."""

    def result(ids, rows):
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(r) for r, _, _ in rows], pa.int64()),
             pa.array([sum(b - a for a, b in c) for _, c, _ in rows], pa.int64()),
             pa.array([len(c) for _, c, _ in rows], pa.int64()),
             pa.array([hashlib.sha256(k).hexdigest() for *_, k in rows], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _apply(docs, length, gram, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
                  result)
