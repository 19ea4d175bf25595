"""Benchmark decontamination on a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, texts, written

WINDOW = 13
# Words of one index row, more only if a single document has more.
ROW_WORDS = 100_000
# Query windows searched in one pass over the index.
PASS_WINDOWS = 200_000

# A-Z become lower case; ASCII other than letters and digits separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
               for c in range(256))

INDEX = ("row_id bigint, doc_ids array<bigint>, doc_words array<int>, terms array<binary>, "
         "counts binary, postings binary")


def words_of(text: str) -> list[bytes]:
    """Words of a text: the split is at spaces only, which all separators have become."""
    return text.encode("utf-8").translate(_WORDS).split()


def _index_row(row_id: int, ids: list, lengths: list[int], words: list[bytes]) -> pa.RecordBatch:
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int32, count=len(words))
    order = np.argsort(codes, kind="stable").astype(np.int32)
    counts = np.bincount(codes, minlength=len(vocabulary)).astype("<i4")
    gaps = np.diff(order, prepend=np.int32(0))
    first = np.cumsum(counts) - counts
    gaps[first] = order[first]  # each list starts anew
    return pa.RecordBatch.from_arrays(
        [pa.array([row_id], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
         pa.array([lengths], pa.list_(pa.int32())), pa.array([list(vocabulary)], pa.list_(pa.binary())),
         pa.array([counts.tobytes()], pa.binary()), pa.array([gaps.astype("<i4").tobytes()], pa.binary())],
        ["row_id", "doc_ids", "doc_words", "terms", "counts", "postings"])


def build_index(docs: DataFrame, row_words: int = ROW_WORDS) -> DataFrame:
    """Positional postings of every word of every document, written to the shared folder.

    The index is partitioned by document: a row covers consecutive whole documents
    of about ``row_words`` words, with the postings of each of its terms as position
    gaps. No shuffle; a term of any frequency is spread over the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_id = TaskContext.get().partitionId() << 33
        ids: list = []
        lengths: list[int] = []
        words: list[bytes] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = words_of(text)
                if words and len(words) + len(found) > row_words:
                    yield _index_row(row_id, ids, lengths, words)
                    row_id, ids, lengths, words = row_id + 1, [], [], []
                ids.append(doc_id)
                lengths.append(len(found))
                words.extend(found)
        if ids:
            yield _index_row(row_id, ids, lengths, words)

    return written(texts(docs).mapInArrow(run, INDEX), "positions")


class _Row:
    """One index row opened for searching."""

    def __init__(self, row: dict):
        self.counts = np.frombuffer(row["counts"], dtype="<i4")
        self.start = np.zeros(len(self.counts) + 1, dtype=np.int64)
        np.cumsum(self.counts, out=self.start[1:])
        gaps = np.frombuffer(row["postings"], dtype="<i4")
        total = np.cumsum(gaps, dtype=np.int64)
        before = np.zeros(len(self.counts), dtype=np.int64)
        before[1:] = total[self.start[1:-1] - 1]
        self.positions = total - np.repeat(before, self.counts)
        self.place = {t: i for i, t in enumerate(row["terms"])}
        self.lengths = np.array(row["doc_words"], dtype=np.int64)
        self.ends = np.cumsum(self.lengths)

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.start[term]:self.start[term + 1]]

    def inside(self, first: np.ndarray, length: int) -> np.ndarray:
        """Starts whose window does not cross a document."""
        return first[np.searchsorted(self.ends, first, "right")
                     == np.searchsorted(self.ends, first + length - 1, "right")]


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Index rows with words, one opened at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            record = batch.slice(i, 1).to_pylist()[0]
            if any(record["doc_words"]):
                yield record


def _phrase(row: _Row, terms: np.ndarray) -> np.ndarray:
    """Starts of a phrase: lists shifted by their offset, intersected from the rarest."""
    order = np.argsort(row.counts[terms], kind="stable")
    starts = row.list_of(terms[order[0]]) - order[0]
    starts = starts[starts >= 0]
    for offset in order[1:]:
        if not len(starts):
            break
        other = row.list_of(terms[offset])
        at = np.searchsorted(other, starts + offset)
        at[at == len(other)] = len(other) - 1
        starts = starts[other[at] == starts + offset]
    return row.inside(starts, len(terms)) if len(starts) else starts


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of ``size`` words; fewer words, but not none, are one window."""
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


def _passes(benchmark: DataFrame, size: int, limit: int) -> Iterator[dict[tuple, set[str]]]:
    """The query set in blocks of about ``limit`` distinct windows: window -> item ids."""
    block: dict[tuple, set[str]] = {}
    for row in benchmark.toLocalIterator():
        for window in windows_of(words_of(row["text"]), size):
            block.setdefault(window, set()).add("" if row["item_id"] is None else str(row["item_id"]))
        if len(block) >= limit:
            yield block
            block = {}
    if block:
        yield block


def _search(batches: Iterable[pa.RecordBatch], asked: list[tuple[tuple, list[str]]]) -> Iterator[pa.RecordBatch]:
    """Documents of each index row with their hit positions and items."""
    by_length: dict[int, list[int]] = {}
    for i, (window, _) in enumerate(asked):
        by_length.setdefault(len(window), []).append(i)
    every = {t: i for i, t in enumerate(dict.fromkeys(t for window, _ in asked for t in window))}
    grids = {n: (np.array(which), np.array([[every[t] for t in asked[i][0]] for i in which]))
             for n, which in by_length.items()}
    for record in _records(batches):
        row = _Row(record)
        place = np.fromiter((row.place.get(t, -1) for t in every), dtype=np.int64, count=len(every))
        marks = np.zeros(row.ends[-1] + 1, dtype=np.int32)
        items: dict[int, set[str]] = {}
        for n, (which, grid) in grids.items():
            local = place[grid]
            for at in np.nonzero((local >= 0).all(axis=1))[0]:
                starts = _phrase(row, local[at])
                if not len(starts):
                    continue
                np.add.at(marks, starts, 1)
                np.add.at(marks, starts + n, -1)
                for doc in np.unique(np.searchsorted(row.ends, starts, "right")).tolist():
                    items.setdefault(doc, set()).update(asked[which[at]][1])
        covered = np.cumsum(marks[:-1]) > 0
        for doc, names in items.items():
            end = row.ends[doc]
            bits = np.packbits(covered[end - row.lengths[doc]:end]).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([record["row_id"]], pa.int64()), pa.array([doc], pa.int32()),
                 pa.array([bits], pa.binary()), pa.array([sorted(names)], pa.list_(pa.string()))],
                ["row_id", "doc", "bits", "items"])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the passes' hits of a document."""
    for batch in batches:
        hits, names = [], []
        for found in batch.column("found").to_pylist():
            bits = np.frombuffer(found[0]["bits"], dtype=np.uint8)
            for other in found[1:]:
                bits = bits | np.frombuffer(other["bits"], dtype=np.uint8)
            hits.append(int(np.bitwise_count(bits).sum()))
            names.append(sorted({i for f in found for i in f["items"]}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("doc"), pa.array(hits, pa.int64()),
             pa.array(names, pa.list_(pa.string()))], ["row_id", "doc", "n_hit", "items"])


def exact_phrases(index: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """(row_id, doc, n_hit, items) of every indexed document that holds a window of an item.

    The items are read in blocks of about ``pass_windows`` windows, each searched in
    one pass over the stored index: no join, and a bounded query set in every task.
    """
    passes = None
    asked_items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                                   F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for block in _passes(asked_items, window, pass_windows):
        asked = sorted((w, sorted(i)) for w, i in block.items())
        shared = index.sparkSession.sparkContext.broadcast(asked)  # bounded by pass_windows
        found = index.mapInArrow(lambda batches, shared=shared: _search(batches, shared.value),
                                 "row_id bigint, doc int, bits binary, items array<string>")
        passes = found if passes is None else passes.union(found)
    if passes is None:
        return index.sparkSession.createDataFrame([], "row_id bigint, doc int, n_hit bigint, items array<string>")
    # One row a pass and document meets here.
    return (passes.groupBy("row_id", "doc").agg(F.collect_list(F.struct("bits", "items")).alias("found"))
            .mapInArrow(_merge, "row_id bigint, doc int, n_hit bigint, items array<string>"))


def proximity_matches(index: DataFrame, terms: list[str], span: int) -> DataFrame:
    """(doc_id, start, length) of minimal stretches of at most ``span`` words with all terms.

    Any order; a stretch lies within one document, starts and ends with a term and
    holds no smaller such stretch. ``terms`` are single words, repeats count once.
    """
    wanted = sorted({w for t in terms for w in words_of(t)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not wanted:
            return
        for record in _records(batches):
            row = _Row(record)
            local = [row.place.get(t, -1) for t in wanted]
            if min(local) < 0:
                continue
            rare = row.list_of(min(local, key=lambda t: row.counts[t]))
            events = []
            for i, term in enumerate(local):
                p = row.list_of(term)  # only what is near the rarest term
                at = np.clip(np.searchsorted(rare, p), 1, len(rare) - 1) if len(rare) > 1 else np.zeros(len(p), int)
                away = np.minimum(abs(rare[at] - p), abs(rare[np.maximum(at - 1, 0)] - p))
                events += [(int(x), i) for x in p[away < span]]
            events.sort()
            last = [-1] * len(wanted)
            stretches: list[tuple[int, int]] = []
            for x, i in events:
                last[i] = x
                low = min(last)
                if low >= 0 and x - low < span and row.ends.searchsorted(low, "right") == row.ends.searchsorted(x, "right"):
                    if stretches and stretches[-1][0] == low:
                        continue  # the earlier end is inside
                    stretches.append((low, x))
            for low, x in stretches:
                doc = int(row.ends.searchsorted(low, "right"))
                first = int(row.ends[doc] - row.lengths[doc])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([record["doc_ids"][doc]], pa.int64()), pa.array([low - first], pa.int64()),
                     pa.array([x - low + 1], pa.int64())], ["doc_id", "start", "length"])

    return index.mapInArrow(run, "doc_id bigint, start bigint, length bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row_id, doc, doc_id, n_words, n_hit, items, contaminated) of every row of ``docs``.

    A word is hit if it lies in any occurrence of a window of a benchmark item. A
    document is contaminated if hit words are at least a twentieth of its words.
    Null or empty texts have no words and hit nothing; repeated rows are judged
    alike; a null item id is written as an empty string; items repeating an id count
    once; empty tables give no rows or no hits. (row_id, doc) tells equal ids apart.
    """
    index = build_index(docs)
    found = exact_phrases(index, benchmark, window)
    meta = index.select("row_id", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("doc", "d")).select(
        "row_id", "doc", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").cast("bigint").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return meta.join(found, ["row_id", "doc"], "left").select(
        "row_id", "doc", "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose document is not contaminated, all columns kept.

    Rows that repeat a doc_id are one document: it goes if any of them is contaminated.
    """
    found = contamination(docs, benchmark, window)
    bad = written(found.where("contaminated").select(F.col("doc_id").alias("bad_id")).distinct(), "bad")
    discard(found)  # the index
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
