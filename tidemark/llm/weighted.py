"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts
from tidemark.llm.ordered_blocks import LEAST, block_bounds, block_of

SAMPLES = 64
SHINGLE = 5
# Draws a sample chooses from; a term's own is picked by a hash of term and sample.
DRAWS = 1 << 16
# Terms weighed at once.
CHUNK = 1024

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(maxsize=4)
def _draws(samples: int, seed: int) -> tuple[np.ndarray, ...]:
    """r and c from Gamma(2, 1), beta uniform, as tables; and a multiplier for each sample."""
    source = np.random.Generator(np.random.PCG64(seed))
    r = source.gamma(2.0, 1.0, DRAWS)
    log_c = np.log(source.gamma(2.0, 1.0, DRAWS))
    beta = source.random(DRAWS)
    unit = (log_c + r * beta - r).astype(np.float32)  # ln a of a term of weight one
    odd = source.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return r, log_c, beta, unit, odd


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> np.ndarray:
    return np.cumprod(np.full(size, _PRIME, dtype=np.uint64))


def terms(text: str, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes and their weights: word shingles and how often they occur.

    Lower case, words between ASCII white space. Each word closes the shingle of it
    and the words before it, fewer at the beginning, so that a text of n words has
    n terms in all and short texts are told apart.
    """
    raw = np.frombuffer(text.lower().encode("utf-8"), dtype=np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = ends - starts
    letters = raw[inside].astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    longest = int(sizes.max())
    powers = _powers(max(4096, 1 << longest.bit_length()))
    words = _mix(np.add.reduceat((letters + np.uint64(1)) * powers[place], first) + sizes.astype(np.uint64))
    filled = np.concatenate([np.zeros(width - 1, np.uint64), words])
    h = np.zeros(len(words), np.uint64)
    for i in range(width):
        h = h * _STEP + filled[i:i + len(words)]
    return np.unique(_mix(h), return_counts=True)


def signature(keys: np.ndarray, weights: np.ndarray, samples: int = SAMPLES, seed: int = 1) -> np.ndarray:
    """One 16-bit value a sample: a hash of the chosen term and its quantised weight.

    For a term of weight w: t = floor(ln w / r + beta), ln y = r (t - beta),
    ln a = ln c - ln y - r. The term with the least a is chosen with t; two weighted
    sets choose the same pair with the probability of sum(min) / sum(max).
    ``keys`` are distinct and sorted, so that equal a choose alike.
    """
    if not len(keys):
        return np.zeros(samples, dtype=np.uint16)
    r, log_c, beta, unit, odd = _draws(samples, seed)
    best = np.full(samples, np.inf, dtype=np.float32)
    chosen = np.zeros(samples, dtype=np.uint64)
    level = np.zeros(samples, dtype=np.int64)
    rows = np.arange(samples)

    def keep(a, key, t):
        at = a.argmin(axis=1)
        value = a[rows, at]
        better = (value < best) | ((value == best) & (key[at] < chosen))
        best[better] = value[better]
        chosen[better] = key[at][better]
        level[better] = 0 if t is None else t[rows, at][better]

    for lo in range(0, len(keys), CHUNK):
        key, weight = keys[lo:lo + CHUNK], weights[lo:lo + CHUNK]
        single = key[weight == 1]
        if len(single):
            keep(unit[(odd[:, None] * single[None, :]) >> np.uint64(48)], single, None)
        more = key[weight > 1]
        if len(more):
            at = ((odd[:, None] * more[None, :]) >> np.uint64(48)).astype(np.int64)
            rr, b = r[at], beta[at]
            t = np.floor(np.log(weight[weight > 1].astype(float))[None, :] / rr + b)
            keep((log_c[at] - rr * (t - b) - rr).astype(np.float32), more, t.astype(np.int64))
    mixed = _mix(chosen + (level + 1).astype(np.uint64) * _PRIME)
    return (mixed >> np.uint64(48)).astype(np.uint16)


def fingerprint(text: str, samples: int = SAMPLES) -> np.ndarray:
    return signature(*terms(text), samples)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of samples that agree: the estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of another text."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every row: four hex digits a sample. No shuffle.

    A null text is empty; texts without words have the fingerprint of zeros; equal
    texts have equal fingerprints; null ids and repeated rows are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t, samples).astype(">u2").tobytes().hex() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks, pa.string())],
                                             ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id bigint, fingerprint string")


_NEIGHBOURS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
               "edited_fingerprint string, near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    """Each document with the next one; a block's last meets the row borrowed from the next block."""
    held = None
    for batch in batches:
        out = []
        for block, borrowed, doc_id, text in zip(*(batch.column(c).to_pylist()
                                                   for c in ("block", "borrowed", "doc_id", "text"))):
            if held is not None and held[0] == block:
                mark = fingerprint(text, samples)
                changed = edited(held[2], text)
                other = fingerprint(changed, samples)
                out.append((held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8")).hexdigest(),
                            held[3].astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(),
                            likeness(held[3], other), likeness(held[3], mark)))
            else:
                mark = None if borrowed else fingerprint(text, samples)
            held = None if borrowed else (block, doc_id, text, mark)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in _NEIGHBOURS.split(", ")]
        columns = list(zip(*out)) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def neighbour_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and the next.

    The next document is the one that follows in ascending doc_id, after the last
    the first; alone, a document is its own next. Null ids come first and rows that
    share an id follow by text. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null text is empty; two texts
    without words are alike. Documents are dealt to blocks of consecutive ids; each
    block also gets the first document of the next one, and the last the very first.
    """
    rows = texts(docs)
    bounds = block_bounds(rows)
    blocks = len(bounds) + 1

    def firsts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(block_of(ids, bounds)),
                                              pa.array([LEAST if i is None else i for i in ids], pa.int64())],
                                             ["block", "id"])

    # One row a block.
    firsts = sorted(tuple(r) for r in rows.select("doc_id").mapInArrow(firsts_of, "block int, id bigint")
                    .groupBy("block").agg(F.min("id")).collect())
    lender = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            own = pa.RecordBatch.from_arrays(
                [pa.array(block_of(ids, bounds)), pa.array([False] * len(ids)), *batch.columns],
                ["block", "borrowed", "doc_id", "text"])
            yield own
            also = [i for i, d in enumerate(ids) if (LEAST if d is None else d) in lender]
            if also:
                lent = batch.take(pa.array(also))
                to = [lender[LEAST if ids[i] is None else ids[i]] for i in also]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([True] * len(also)), *lent.columns],
                                                 ["block", "borrowed", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "block int, borrowed boolean, doc_id bigint, text string")
    return (dealt.repartitionById(blocks, F.col("block"))
            .sortWithinPartitions("block", "borrowed", F.col("doc_id").asc_nulls_first(), "text")
            .mapInArrow(lambda b: _compare(b, samples), _NEIGHBOURS))
