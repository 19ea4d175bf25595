"""BPE encoding and decoding of whole texts, long ones by tree concatenation."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts, written

# Code points of a leaf of the tree; longer texts are cut.
LEAF = 32_768
# Code points on either side of a join that are encoded again at first.
MARGIN = 32
# Chunks without white space up to this length are remembered by a worker, twice this many at most.
CHUNK, REMEMBERED = 64, 250_000

# White space to Python's split() but not to the tokenizer's patterns.
_OTHER_SPACE = re.compile("[\x1c-\x1f\u180e]")
_CHUNKS = re.compile(r"\S+")


@dataclass
class Node:
    """An encoded stretch of text: units with their place and ids.

    A unit is a chunk between white space or, in a long chunk, a single token.
    """

    start: int
    end: int
    starts: np.ndarray
    ends: np.ndarray
    ids: list[bytes]


class Encoder:
    """The tokenizers library on one tokenizer file, with a bounded memory of chunks.

    For tokenizers that drop white space and never let a token span it: the ids of a
    text are those of its chunks in order. Texts with characters that only one side
    takes for white space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Without a decoder a text is its tokens' texts with spaces between.
        self.words: list[str] | None = None
        if self.library.decoder is None:
            size = 1 + max(self.library.get_vocab(with_added_tokens=True).values())
            self.words = [self.library.decode([i], skip_special_tokens=False) for i in range(size)]

    def _whole(self, rows: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(rows, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _together(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, from one call on all of them with white space between: a call costs
        far more than a chunk. A token belongs to the chunk that it starts in."""
        found = self.library.encode(" ".join(chunks), add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4").tobytes()
        places = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
        cuts = (4 * np.searchsorted(places, ends)).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        out = list(map(self.memory.get, chunks))
        if None not in out:
            return out
        places = [i for i, ids in enumerate(out) if ids is None]
        known = {chunks[i]: None for i in places}
        known = {c: self.older.get(c) for c in known}
        new = [c for c, ids in known.items() if ids is None]
        if new:
            known.update(zip(new, self._together(new)))
        for i in places:
            out[i] = known[chunks[i]]
        if len(self.memory) + len(known) > REMEMBERED:  # what is met again comes back from the older half
            self.memory, self.older = {}, self.memory
        self.memory.update((c, ids) for c, ids in known.items() if len(c) <= CHUNK)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if _OTHER_SPACE.search(text):
            return self._whole([text])[0]
        return b"".join(self.chunks(text.split()))

    def decode(self, ids: bytes) -> str:
        if self.words is not None:
            return " ".join(map(self.words.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False)

    def _tokens(self, text: str) -> tuple[list[tuple[int, int]], list[bytes]]:
        found = self.library.encode(text, add_special_tokens=False)
        return found.offsets, [int(i).to_bytes(4, "little") for i in found.ids]

    def units(self, text: str, at: int) -> Node:
        """A stretch that starts at code point ``at`` of its text."""
        places, ids = [], []
        if _OTHER_SPACE.search(text):
            places, ids = self._tokens(text)
        else:
            spans = [m.span() for m in _CHUNKS.finditer(text)]
            short = self.chunks([text[s:e] for s, e in spans if e - s <= CHUNK])
            taken = iter(short)
            for s, e in spans:
                if e - s <= CHUNK:
                    places.append((s, e))
                    ids.append(next(taken))
                else:
                    inner, own = self._tokens(text[s:e])
                    places += [(s + a, s + b) for a, b in inner]
                    ids += own
        grid = np.array(places, dtype=np.int64).reshape(len(places), 2) + at
        return Node(at, at + len(text), grid[:, 0], grid[:, 1], ids)


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    return Encoder(path)


def _lone(node: Node, first: int, last: int) -> dict[tuple[int, int], int]:
    """Units first..last-1 by their place, without those that share a place or are empty."""
    out: dict[tuple[int, int], int] = {}
    twice = set()
    for i in range(first, last):
        key = (int(node.starts[i]), int(node.ends[i]))
        if key in out or key[0] >= key[1]:
            twice.add(key)
        out[key] = i
    return {k: i for k, i in out.items() if k not in twice}


def join(left: Node, right: Node, text: str, encoder: Encoder, margin: int = MARGIN) -> Node:
    """The encoding of two adjoining stretches from those of each.

    A window around the join is encoded anew and doubled until, on either side, a
    unit of it that does not touch the window's edge equals one of the half's: same
    place, same ids. Between the two the window's units count. A sequence in which
    each unit and its follower come from one valid encoding is the valid encoding.
    """
    cut = left.end
    while True:
        low, high = max(left.start, cut - margin), min(right.end, cut + margin)
        window = encoder.units(text[low:high], low)
        a = b = None
        if low == left.start:
            a = (0, 0)
        else:
            mine = _lone(left, int(np.searchsorted(left.starts, low)), len(left.ids))
            for place, i in _lone(window, 1, len(window.ids)).items():
                if place[1] <= cut and place in mine and left.ids[mine[place]] == window.ids[i]:
                    a = (mine[place] + 1, i + 1)
                    break
        if high == right.end:
            b = (len(right.ids), len(window.ids))
        else:
            mine = _lone(right, 0, int(np.searchsorted(right.starts, high)))
            for place, i in _lone(window, 0, len(window.ids) - 1).items():
                if place[0] >= cut and place in mine and right.ids[mine[place]] == window.ids[i]:
                    b = (mine[place], i)
                    break
        if a and b:
            return Node(left.start, right.end,
                        np.concatenate([left.starts[:a[0]], window.starts[a[1]:b[1]], right.starts[b[0]:]]),
                        np.concatenate([left.ends[:a[0]], window.ends[a[1]:b[1]], right.ends[b[0]:]]),
                        left.ids[:a[0]] + window.ids[a[1]:b[1]] + right.ids[b[0]:])
        margin *= 2


def join_tree(nodes: list[Node], text: str, encoder: Encoder) -> bytes:
    """Join neighbours pairwise, level by level, into the ids of the whole text."""
    while len(nodes) > 1:
        nodes = [join(*nodes[i:i + 2], text, encoder) if i + 1 < len(nodes) else nodes[i]
                 for i in range(0, len(nodes), 2)]
    return b"".join(nodes[0].ids) if nodes else b""


def _encode_short(batches: Iterator[pa.RecordBatch], path: str, finish) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(path)
    for batch in batches:
        yield finish(batch.column("doc_id"), [encoder.encode(t) for t in batch.column("text").to_pylist()], encoder)


def _cut(batches: Iterator[pa.RecordBatch], leaf: int) -> Iterator[pa.RecordBatch]:
    row_id = TaskContext.get().partitionId() << 33
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            at = list(range(0, len(text), leaf))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row_id] * len(at), pa.int64()), pa.array([doc_id] * len(at), pa.int64()),
                 pa.array(at, pa.int64()), pa.array([text[i:i + leaf] for i in at], pa.string())],
                ["row_id", "doc_id", "at", "piece"])
            row_id += 1


def _encode_leaves(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(path)
    for batch in batches:
        nodes = [encoder.units(p, at) for at, p in zip(batch.column("at").to_pylist(),
                                                       batch.column("piece").to_pylist())]
        sizes = [np.array([len(i) // 4 for i in n.ids], dtype="<u2").tobytes() for n in nodes]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([n.starts.astype("<i4").tobytes() for n in nodes], pa.binary()),
             pa.array([n.ends.astype("<i4").tobytes() for n in nodes], pa.binary()),
             pa.array(sizes, pa.binary()), pa.array([b"".join(n.ids) for n in nodes], pa.binary())],
            ["row_id", "doc_id", "at", "piece", "starts", "ends", "sizes", "ids"])


def _join_leaves(batches: Iterator[pa.RecordBatch], path: str, finish) -> Iterator[pa.RecordBatch]:
    """Leaves come sorted by text; the pieces of one text are held at a time."""
    encoder = encoder_of(path)
    row_id, doc_id, nodes, pieces = None, None, [], []

    def done():
        return finish(pa.array([doc_id], pa.int64()), [join_tree(nodes, "".join(pieces), encoder)], encoder)

    for batch in batches:
        for row in batch.to_pylist():
            if row["row_id"] != row_id:
                if nodes:
                    yield done()
                row_id, doc_id, nodes, pieces = row["row_id"], row["doc_id"], [], []
            ends = (4 * np.cumsum(np.frombuffer(row["sizes"], dtype="<u2"), dtype=np.int64)).tolist()
            ids = [row["ids"][s:e] for s, e in zip([0, *ends[:-1]], ends)]
            nodes.append(Node(row["at"], row["at"] + len(row["piece"]), np.frombuffer(row["starts"], dtype="<i4"),
                              np.frombuffer(row["ends"], dtype="<i4"), ids))
            pieces.append(row["piece"])
    if nodes:
        yield done()


def _apply(docs: DataFrame, path: str, leaf: int, finish, schema: str) -> DataFrame:
    rows = texts(docs)
    short = rows.where(F.length("text") <= leaf).mapInArrow(lambda b: _encode_short(b, path, finish), schema)
    pieces = written(rows.where(F.length("text") > leaf).mapInArrow(
        lambda b: _cut(b, leaf), "row_id bigint, doc_id bigint, at bigint, piece string"), "pieces")
    leaves = pieces.repartition("row_id", "at").mapInArrow(
        lambda b: _encode_leaves(b, path), "row_id bigint, doc_id bigint, at bigint, piece string, "
        "starts binary, ends binary, sizes binary, ids binary")
    long = leaves.repartition("row_id").sortWithinPartitions("row_id", "at").mapInArrow(
        lambda b: _join_leaves(b, path, finish), schema)
    return short.union(long)


def encode_documents(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of every row, ids as the tokenizers library gives them.

    ``path`` names a tokenizer file that executors can read. Texts longer than
    ``leaf`` code points are cut into leaves, encoded by different tasks and joined
    in a tree; a text's ids meet in one task in the end, as they are one row. A null
    text is empty and has no ids; repeated rows and null ids are kept; other columns
    are ignored. Special tokens in a text are recognised; none are added.
    """

    def finish(ids, encoded, encoder):
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([np.frombuffer(e, dtype="<u4").astype(np.int32) for e in encoded], pa.list_(pa.int32())),
             pa.array([encoder.decode(e) for e in encoded], pa.string())], ["doc_id", "ids", "decoded"])

    return _apply(docs, path, leaf, finish, "doc_id bigint, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode_documents without its bulk."""

    def finish(ids, encoded, encoder):
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(e) // 4 for e in encoded], pa.int64()),
             pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
             pa.array([hashlib.sha256(encoder.decode(e).encode("utf-8")).hexdigest() for e in encoded],
                      pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _apply(docs, path, leaf, finish, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
