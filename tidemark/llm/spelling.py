"""Spelling variants: permuterm rotations of a counted vocabulary, neighbours by prefix."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, texts, written

# Runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8 after A-Z were lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LEAST_LENGTH, LEAST_COUNT = 6, 5
# A word's form occurs at least so many times as often as the word.
RATIO = 5
# One run in so many, by hash, loses a code point.
DELETE_ONE_IN = 199
END = "$"
# Rotations are sorted by so many code points; the rest of a longer one is a hash.
PLAIN = 40
# Distinct words that a task counts before it passes them on.
HELD_WORDS = 200_000
ROWS_OUT = 50_000

_PRIME = (1 << 127) - 1
_BASE = 0x5851F42D4C957F2D14057B7EF767814F % _PRIME


def words_of(doc_id: int | None, text: str, least: int = LEAST_LENGTH) -> dict[bytes, int]:
    """The counted words of one document, as UTF-8.

    A run whose crc32 of ``<doc_id>:<run>`` is a multiple of DELETE_ONE_IN loses
    the code point at that crc32 modulo its length. A null id is written as nothing.
    """
    runs: dict[bytes, int] = {}
    for run in RUN.findall(text.encode("utf-8").lower()):
        runs[run] = runs.get(run, 0) + 1
    seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    out: dict[bytes, int] = {}
    for run, n in runs.items():
        size = len(run) - run.count(b"\xc3")
        if size < least:
            continue
        mark = zlib.crc32(run, seed)
        if mark % DELETE_ONE_IN == 0:
            if size == least:
                continue
            letters, at = run.decode("utf-8"), mark % size
            run = (letters[:at] + letters[at + 1:]).encode("utf-8")
        out[run] = out.get(run, 0) + n
    return out


def _counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    def flushed(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()),
                                           pa.array(list(held.values()), pa.int64())], ["word", "n"])

    held: dict[bytes, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for word, n in words_of(doc_id, text, least).items():
                held[word] = held.get(word, 0) + n
            if len(held) >= HELD_WORDS:
                yield flushed(held)
                held = {}
    if held:
        yield flushed(held)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(id, word, n) of every frequent word, ids ascending in code-point order.

    Tasks count first; the words are then sorted over all tasks and written, so
    that an id stands for its word in everything that follows.
    """
    counts = (texts(docs).mapInArrow(lambda b: _counted(b, least_length), "word string, n bigint")
              .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))
    ordered = counts.repartitionByRange("word").sortWithinPartitions("word")
    return written(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def rotations(word: str) -> Iterator[tuple[str, int]]:
    """The sort keys under which a word meets its neighbours, each with its role.

    The word is marked with END at its end and rotated. Role 0: a whole rotation.
    Roles 1 and 2: a rotation that starts behind one letter, without that letter,
    which would come last: all rotations that begin so, with one more letter, are
    replacements of it, and the one that ends there is the word without it. Role 2
    is given once for every run of equal letters, as leaving out any of them gives
    the same word.
    """
    m = len(word)
    long = m >= PLAIN
    if long:
        before, power = [0], [1]
        for letter in word:
            before.append((before[-1] * _BASE + ord(letter) + 1) % _PRIME)
            power.append(power[-1] * _BASE % _PRIME)

    def key(start: int, stop: int) -> str:
        """The rotation word[start:] + END + word[:stop]."""
        size = m - start + 1 + stop
        if size <= PLAIN:
            return word[start:] + END + word[:stop]
        head = word[start:start + PLAIN]
        if len(head) < PLAIN:
            head = (head + END + word[:PLAIN])[:PLAIN]
        tail = (before[m] - before[start] * power[m - start]) % _PRIME
        whole = (tail * _BASE + ord(END) + 1) % _PRIME
        return f"{head}{(whole * power[stop] + before[stop]) % _PRIME:032x}"

    if not long:
        turned = word + END + word
        for at in range(m + 1):
            yield turned[at:at + m + 1], 0
        for at in range(m):
            yield turned[at + 1:at + m + 1], 2 if at == 0 or word[at] != word[at - 1] else 1
        return
    for at in range(m + 1):
        yield key(at, at), 0
    for at in range(m):
        yield key(at + 1, at), 2 if at == 0 or word[at] != word[at - 1] else 1


def _rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rotation", "role", "n", "id"]

    def out(keys: list[str], roles: list[int], counts: list[int], ids: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(roles, pa.int8()),
                                           pa.array(counts, pa.int64()), pa.array(ids, pa.int64())], names)

    keys, roles, counts, ids = [], [], [], []
    for batch in batches:
        for number, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n"))):
            for key, role in rotations(word):
                keys.append(key)
                roles.append(role)
                counts.append(n)
                ids.append(number)
                if len(keys) >= ROWS_OUT:
                    yield out(keys, roles, counts, ids)
                    keys, roles, counts, ids = [], [], [], []
    if keys:
        yield out(keys, roles, counts, ids)


def _scan(keys: pa.Array, role: np.ndarray, n: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """What the rows of whole groups say: (id, near words, best near word's n, its id).

    A group is one key. Its whole word, if there is one, comes first, then the words
    with one letter more by falling n and rising id. Every row needs only the group's
    size and first two words, so the output grows with rows, not with pairs.
    """
    first = np.ones(len(n), dtype=bool)
    first[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(n)))
    group = np.repeat(np.arange(len(starts)), sizes)
    has_word = (role[starts] == 0).astype(np.int64)
    lead = starts + has_word
    others = sizes - has_word
    place = np.arange(len(n)) - lead[group]
    # Replacements of each other: all but the first have the first as their best.
    swap = np.flatnonzero((place >= 0) & (others[group] >= 2))
    best = lead[group[swap]] + (place[swap] == 0)
    parts = [(word[swap], others[group[swap]] - 1, n[best], word[best])]
    # A word and the words with one letter more.
    longer = np.flatnonzero((role == 2) & (has_word[group] == 1))
    short = starts[group[longer]]
    parts.append((word[longer], np.ones(len(longer), dtype=np.int64), n[short], word[short]))
    head = np.unique(short, return_index=True, return_counts=True)
    parts.append((word[head[0]], head[2], n[longer[head[1]]], word[longer[head[1]]]))
    return [np.concatenate(column) for column in zip(*parts)]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | None]:
    """Tables of about ROWS_OUT rows, and None at the end."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS_OUT:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)
    yield None


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan sorted rotations; the last group of a table waits for the next one."""
    waiting: pa.Table | None = None
    for table in _gathered(batches):
        if table is None:
            table, waiting = waiting, None
        else:
            table = table if waiting is None else pa.concat_tables([waiting, table])
            if not table.num_rows:
                continue
            keys = table.column("rotation").combine_chunks()
            whole = int(np.argmax(pc.equal(keys, keys[-1]).to_numpy(zero_copy_only=False)))
            waiting, table = table.slice(whole), table.slice(0, whole)
        if table is None or not table.num_rows:
            continue
        columns = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("role", "n", "id")]
        found = _scan(table.column("rotation").combine_chunks(), *columns)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], ["id", "near", "best_n", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best) of every word that has near words.

    ``words`` has (id, word, n), ids ascending with the words. A group of rotations
    holds at most one word for every letter of the alphabet.
    """
    ship(words.sparkSession)
    turned = words.select("id", "word", "n").mapInArrow(_rotated, "rotation string, role tinyint, n bigint, id bigint")
    ordered = turned.repartitionByRange("rotation").sortWithinPartitions(
        "rotation", F.col("role") > 0, F.desc("n"), "id")
    near = ordered.mapInArrow(_neighbours, "id bigint, near bigint, best_n bigint, best bigint")
    return near.groupBy("id").agg(
        F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("top")).select(
        "id", "n_near", F.col("top.best_n").alias("best_n"), (-F.col("top.best")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of every word that has a form.

    A form occurs at least RATIO times as often, so chains are short; every round
    doubles what a word looks ahead and is written to the shared folder.
    """
    now = written(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(further, "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not moved.where("moved").limit(1).count():
            return now
        now = moved.select("id", "root")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                      ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word of ``docs``.

    Words are those of :func:`words_of` with ``least_length`` code points and
    ``least_count`` occurrences. Two words are near if they differ by exactly one
    inserted, deleted or replaced code point. The form of a word is its near word of
    largest n, of equal ones the smallest in code-point order, if that n is at least
    ``ratio`` times the word's; root is the last word on the way from form to form.
    Every word is one row. A null text is empty, a null id is written as nothing in
    the hash. Rows repeated are counted as often as they stand. Words of any length
    are whole: of rotations above PLAIN code points a 127-bit hash stands for what
    follows. Other columns are ignored; an empty table gives an empty result.
    """
    words = vocabulary(docs, least_length, least_count)
    near = written(neighbours(words), "near-words")
    forms = words.join(near, "id").where(F.col("best_n") >= ratio * F.col("n")).select("id", F.col("best").alias("form"))
    roots = _roots(forms)
    named = words.select("id", "word", "n")
    return (named.join(near.select("id", "n_near", "best_n", "best"), "id", "left")
            .withColumn("form_id", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")))
            .join(roots.withColumnRenamed("root", "root_id"), "id", "left")
            .join(named.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id", "left")
            .join(named.select(F.col("id").alias("root_id"), F.col("word").alias("last")), "root_id", "left")
            .select("word", "form", F.coalesce("last", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                    F.when(F.col("form_id").isNotNull(), F.col("best_n")).alias("form_n")))
