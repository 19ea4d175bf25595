"""Token ids in files: every document compressed by itself with one shared dictionary."""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hash_sample, ship, shared_folder, texts
from tidemark.llm.ordered_blocks import block_bounds, block_of

# Bounds of the dictionary's training: documents, ids of each, dictionary bytes.
SAMPLE_DOCUMENTS, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 4096, 65_536
LEVEL = 1
# Compressed bytes of a pack, more only if a single document has more.
PACK_BYTES = 1 << 18
# Chunks remembered by a worker.
CHUNK, REMEMBERED = 48, 1_600_000

# White space of the tokenizer's patterns, written out: Python's own class has more.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNUSUAL = re.compile(r"[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKED = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)")
_CHUNKS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Recent:
    """A bounded memory in two generations: what was used of late stays."""

    def __init__(self, bound: int):
        self.bound = bound // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, keys: list[str], learn) -> list[bytes]:
        """The values of the keys; ``learn`` gives those of new ones."""
        found = list(map(self.young.get, keys))
        if None not in found:
            return found
        young, old = self.young, self.old
        holes = [i for i, f in enumerate(found) if f is None]
        new = [k for k in dict.fromkeys([keys[i] for i in holes]) if k not in old]
        fresh = dict(zip(new, learn(new)))
        for i in holes:
            k = keys[i]
            found[i] = f = fresh[k] if k in fresh else old[k]
            if len(k) <= CHUNK:
                young[k] = f
        if len(young) > self.bound:
            self.old, self.young = young, {}
        return found


class ByteEncoder:
    """The tokenizers library on a byte-level BPE file, with a bounded memory of chunks.

    Text is cut where the tokenizer's own pattern always cuts: before the white
    space that precedes a word. Texts that spell a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.chunks, self.spaced = Recent(REMEMBERED // 8), Recent(REMEMBERED)
        vocabulary = self.library.get_vocab()
        # Ids of tokens that begin with a space.
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True

    def _whole(self, rows: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(rows, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters behind a space: one text in which each token run opens with its space."""
        ids = np.frombuffer(self._whole([" " + " ".join(words)])[0], dtype="<u4")
        cuts = (4 * np.append(np.flatnonzero(self.opens[ids]), len(ids))).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, keys: list[str]) -> list[bytes]:
        """Ids of new keys: a word behind a space, or from a line end on.

        Letters with marks after them are two runs to the pattern: the letters may
        be known already.
        """
        letters, marked, other = [], [], []
        for k in keys:
            if _LETTERS.fullmatch(k):
                letters.append(k)
            elif m := _MARKED.fullmatch(k):
                marked.append((k, *m.groups()))
            else:
                other.append(k)
        out = dict(zip(letters, self._words(letters))) if letters else {}
        if marked:
            bare = [b for _, b, _ in marked]
            known = dict(zip(bare, [out[b] if b in out else None for b in bare]))
            unknown = [b for b, f in known.items() if f is None]
            known.update(zip(unknown, self.spaced.find(unknown, self._words)))
            marks = self.chunks.find([m for *_, m in marked], self._whole)
            out.update((k, known[b] + m) for (k, b, _), m in zip(marked, marks))
        if other:
            out.update(zip(other, self._whole([k if k[:1] == "\n" else " " + k for k in other])))
        return [out[k] for k in keys]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self._whole([text])[0]
        padded = f"\n{text}\n"
        if _UNUSUAL.search(text) or any(s in padded for s in ("  ", "\n\n", "\n ", " \n")):
            return b"".join(self.chunks.find(_CHUNKS.findall(text), self._whole))
        # Words parted by single spaces, lines by single line ends: a line's first
        # word goes with the line end before it, also the text's, which is then cut off.
        words = padded[:-1].replace("\n", " \n").split(" ")[1:]
        return b"".join(self.spaced.find(words, self._learn))[4:]


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder a worker process, kept from task to task."""
    return ByteEncoder(path)


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes an id if all fit, else four; the first byte tells."""
    small = not len(ids) or int(ids.max()) < 65_536
    return (b"\2" + ids.astype("<u2").tobytes()) if small else (b"\4" + ids.astype("<u4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def train_dictionary(rows: DataFrame, path: str, end_id: int) -> bytes:
    """A zstandard dictionary trained on serialized id arrays.

    The sample has about SAMPLE_DOCUMENTS documents (at most twice as many), chosen
    by a hash, with at most SAMPLE_IDS ids each; only the compression ratio depends on it.
    """
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        for batch in batches:
            data = [_packed(np.append(np.frombuffer(encoder.encode(t[:8 * SAMPLE_IDS]), "<u4")[:SAMPLE_IDS], end_id))
                    for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["data"])

    found = hash_sample(rows, SAMPLE_DOCUMENTS).mapInArrow(run, "data binary")
    samples = [bytes(r["data"]) for r in found.orderBy(F.xxhash64("data"), "data").limit(2 * SAMPLE_DOCUMENTS).collect()]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes serve as they are
        return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


PACK = ("block int, pack int, dictionary string, first_id bigint, last_id bigint, doc_ids array<bigint>, "
        "offsets array<int>, starts array<bigint>, tokens array<bigint>, data binary")


def _packs(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[pa.RecordBatch]:
    """Frames come sorted by (block, doc_id): consecutive ones fill a pack."""
    block, pack, start, held = None, 0, 0, 0
    ids: list = []
    frames: list[bytes] = []
    starts: list[int] = []
    tokens: list[int] = []

    def done():
        known = [i for i in ids if i is not None]
        offsets = np.cumsum([0, *map(len, frames)]).tolist()
        values = [block, pack, mark, min(known, default=None), max(known, default=None), list(ids), offsets,
                  list(starts), list(tokens), b"".join(frames)]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
                 pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                          [f.split()[0] for f in PACK.split(", ")])

    for batch in batches:
        for b, doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "n_tokens", "frame"))):
            if ids and (b != block or held + len(frame) > PACK_BYTES):
                yield done()
                pack, held, ids, frames, starts, tokens = pack + 1, 0, [], [], [], []
            if b != block:
                block, pack, start = b, 0, 0
            ids.append(doc_id)
            frames.append(frame)
            starts.append(start)
            tokens.append(n)
            start += n
            held += len(frame)
    if ids:
        yield done()


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> None:
    """Encode every text and write the ids, end id last, in ascending doc_id order.

    ``folder`` gets ``dictionary`` and ``packs``. A pack is a row with consecutive
    documents: their ids, the offset of each one's own zstandard frame in ``data``,
    the number of its ids and of those before it in its block, and the hash of the
    dictionary. Blocks and packs number the order. Null ids come first; a null text
    is empty; rows that share an id follow each other by content.
    """
    import zstandard

    rows = texts(docs)
    spark = docs.sparkSession
    trained = train_dictionary(rows, path, end_id)
    mark = dictionary_hash(trained)
    bounds = block_bounds(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for batch in batches:
            ids = [np.append(np.frombuffer(encoder.encode(t), dtype="<u4"), np.uint32(end_id))
                   for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block_of(batch.column("doc_id").to_pylist(), bounds)), batch.column("doc_id"),
                 pa.array([len(i) for i in ids], pa.int64()), pa.array([press.compress(_packed(i)) for i in ids], pa.binary())],
                ["block", "doc_id", "n_tokens", "frame"])

    frames = rows.mapInArrow(encode, "block int, doc_id bigint, n_tokens bigint, frame binary")
    packs = (frames.repartitionById(len(bounds) + 1, F.col("block"))
             .sortWithinPartitions("block", F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
             .mapInArrow(lambda b: _packs(b, mark), PACK))
    spark.range(1).select(F.lit(mark).alias("dictionary"), F.lit(bytearray(trained)).alias("data")).coalesce(1).write.parquet(
        f"{folder}/dictionary")
    packs.write.option("compression", "uncompressed").parquet(f"{folder}/packs")


def _opener(dictionaries: dict[str, bytes]):
    import zstandard

    open_with = {}

    def read(mark: str, frame: bytes) -> np.ndarray:
        if mark not in open_with:
            data = dictionaries[mark]
            if dictionary_hash(data) != mark:
                raise ValueError("the dictionary is not the one that the pack was written with")
            open_with[mark] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        return _unpacked(open_with[mark].decompress(frame))

    return read


def _dictionaries(spark: SparkSession, folder: str) -> dict[str, bytes]:
    return {r["dictionary"]: bytes(r["data"]) for r in spark.read.parquet(f"{folder}/dictionary").collect()}


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, start counted over all files."""
    return _read(spark, folder, "ids array<bigint>",
                 lambda found: pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64())))


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): read_tokens with a checksum in place of the ids."""
    return _read(spark, folder, "ids_crc32 bigint",
                 lambda found: pa.array([zlib.crc32(f.tobytes()) for f in found], pa.int64()))


def _read(spark: SparkSession, folder: str, last: str, result) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch",
                   str(min(128, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    dictionaries = _dictionaries(spark, folder)
    packs = spark.read.parquet(f"{folder}/packs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _opener(dictionaries)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                cuts = zip(row["offsets"], row["offsets"][1:])
                found = [read(row["dictionary"], row["data"][a:b]) for a, b in cuts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(found), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(row["starts"], pa.int64()), pa.array([len(f) for f in found], pa.int64()), result(found)],
                    ["block", "doc_id", "local", "n_tokens", last.split()[0]])

    # One row a block: its size, and by running sum the ids before it.
    sizes = packs.select("block", F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n")).groupBy(
        "block").agg(F.sum("n").alias("n")).collect()
    before, base = 0, {}
    for block, n in sorted((r["block"], r["n"]) for r in sizes):
        base[block], before = before, before + n
    marks = F.array(*[F.lit(base.get(b, 0)).cast("bigint") for b in range(max(base, default=0) + 1)])
    read = packs.mapInArrow(run, f"block int, doc_id bigint, local bigint, n_tokens bigint, {last}")
    return read.select("doc_id", (F.col("local") + F.element_at(marks, F.col("block") + 1)).alias("start"), "n_tokens",
                       last.split()[0])


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: only their packs are read and only their frames opened."""
    ship(spark)
    dictionaries, wanted = _dictionaries(spark, folder), set(doc_ids)
    packs = spark.read.parquet(f"{folder}/packs")
    meets = F.lit(False)
    for i in sorted(wanted):
        meets = meets | ((F.col("first_id") <= i) & (F.col("last_id") >= i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _opener(dictionaries)
        for batch in batches:
            for row in batch.to_pylist():
                for k, doc_id in enumerate(row["doc_ids"]):
                    if doc_id in wanted:
                        ids = read(row["dictionary"], row["data"][row["offsets"][k]:row["offsets"][k + 1]])
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()),
                                                          pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))],
                                                         ["doc_id", "ids"])

    return packs.where(meets).mapInArrow(run, "doc_id bigint, ids array<bigint>")


def round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write the token files to the shared folder and read every document back as a checksum."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/llm-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, folder, end_id)
    return read_checksums(spark, folder)
