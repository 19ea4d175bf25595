"""Consecutive blocks of documents in ascending doc_id, one task each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import shuffle_partitions

LEAST = -(1 << 63)


def block_bounds(rows: DataFrame, blocks: int | None = None) -> np.ndarray:
    """Ids that cut the sorted doc_ids into about ``blocks`` parts of similar size.

    Quantiles of a mergeable sketch over all ids; at most ``blocks`` numbers reach
    the driver. They only spread the work. Ids below the first bound, and null ids,
    are in block 0.
    """
    blocks = blocks or shuffle_partitions(rows.sparkSession)
    shares = [i / blocks for i in range(1, blocks)]
    cuts = rows.where("doc_id is not null").stat.approxQuantile("doc_id", shares, 1 / (4 * blocks)) if shares else []
    return np.array(sorted({int(c) for c in cuts}), dtype=np.int64)


def block_of(ids: list[int | None], bounds: np.ndarray) -> np.ndarray:
    known = np.array([LEAST if i is None else i for i in ids], dtype=np.int64)
    return np.searchsorted(bounds, known, side="right").astype(np.int32)
