"""SimHash fingerprints linked through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stars, texts, written
from tidemark.llm.components import components

BITS = 64
# Members of a contested bucket that one task compares at a time.
BLOCK = 4096


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed integer.

    A-Z is lower-cased; words are runs of other than space and 0x09-0x0D. A text of
    fewer words is one shingle, one without words has the fingerprint zero. A bit
    is one if it is set in more than half of the shingles' XXH64.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    values = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(values), 65536):
        part = values[lo:lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > len(values), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t, width, seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks, pa.int64())],
                                             ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks of which, for any ``radius`` bits, one leaves them all out.

    Bit i has the code i mod (2^(radius+1) - 1) + 1 and is in mask v if code and v
    have an odd number of ones in common. ``radius`` codes span less than the whole
    space of radius + 1 dimensions, so some v is orthogonal to all of them: two
    fingerprints that differ in those bits agree under that mask.
    """
    tables = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((i % tables + 1) & v).count("1") % 2)
            for v in range(1, tables + 1)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _contested(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links between the open items of a bucket and one block of its members.

    Rows are sorted by (bucket, block, role): at most BLOCK members come first and
    are held, the open items stream past them.
    """
    held: list[int] = []
    members = np.zeros(0, dtype=np.uint64)
    at = None
    for batch in batches:
        frame = batch.to_pydict()
        out_a: list[int] = []
        out_b: list[int] = []
        for place, role, fp in zip(zip(frame["v"], frame["key"], frame["block"]), frame["role"], frame["fp"]):
            if place != at:
                at, held, members = place, [], None
            if role == 0:
                held.append(fp)
                continue
            if members is None:
                members = np.array(held, dtype=np.int64).view(np.uint64)
            apart = np.bitwise_count(members ^ np.array([fp], dtype=np.int64).view(np.uint64)[0])
            for other in members[(apart <= radius) & (apart > 0)].view(np.int64).tolist():
                out_a.append(fp)
                out_b.append(other)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())],
                                             ["a", "b"])


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within ``radius`` bits.

    ``prints`` has distinct bigints ``fp``. In each covering bucket every member is
    compared with the smallest one. Members farther from it are open: they are
    compared with all members of that bucket, in blocks spread over tasks. So every
    pair within the radius is either compared or joined through a common leader.
    """
    masks = F.array(*[F.struct(F.lit(v).cast("tinyint").alias("v"),
                               F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                      for v, m in enumerate(covering_masks(radius))])
    rows = prints.select("fp", F.explode(masks).alias("t")).select("t.v", "t.key", "fp")
    members = stars(rows, ["v", "key"], "fp")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("leader")))
    members = written(members.withColumn("far", apart > radius), "buckets")
    near = members.where("not far and fp <> leader").select(F.col("fp").alias("a"), F.col("leader").alias("b"))
    # Two members are settled by the leader's comparison alone.
    open_items = members.where("far and n > 2")
    contested = open_items.groupBy("v", "key").agg(F.first("n").alias("n")).withColumn(
        "blocks", F.ceil(F.col("n") / F.lit(BLOCK // 2)).cast("int"))
    inside = members.select("v", "key", "fp").join(contested.select("v", "key", "blocks"), ["v", "key"]).select(
        "v", "key", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"),
        F.lit(0).cast("tinyint").alias("role"), "fp")
    asked = open_items.select("v", "key", "fp").join(contested.select("v", "key", "blocks"), ["v", "key"]).select(
        "v", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(1).cast("tinyint").alias("role"), "fp")
    pairs = (inside.union(asked).repartition("v", "key", "block").sortWithinPartitions("v", "key", "block", "role")
             .mapInArrow(lambda batches: _contested(batches, radius), "a bigint, b bigint"))
    return near.union(pairs).distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest doc_id reachable over links. Texts without words have the fingerprint
    zero and link like any other; a null text is empty. Rows with a null doc_id take
    part and name a component only if no other row does, as null. Repeated rows are
    all returned. Other columns are ignored; an empty table gives an empty result.
    """
    prints = written(fingerprints(docs, width, seed), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` that represent their component, all columns kept.

    The row with the smallest doc_id stays. Rows repeating that doc_id stay too: a
    repeated id is one document. Null ids stay only where the component has no id.
    """
    found = near_duplicates(docs, radius)
    kept = written(found.where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct(), "kept")
    discard(found)  # fingerprints and links
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
