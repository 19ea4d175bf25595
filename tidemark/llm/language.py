"""Language identification by a byte convolutional network over all windows of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytecnn import WINDOW, ByteNetwork, letter_bytes, train, windows_of
from tidemark.llm.common import ship, texts

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")  # and some numbers, which are no letters
# The training sample: different texts of a language, and windows of each.
TEXTS_PER_LANGUAGE, WINDOWS_PER_TEXT = 512, 3
# With many languages fewer texts of each, but never fewer than LEAST_TEXTS.
ALL_TEXTS, LEAST_TEXTS = 4096, 32
# Shorter windows are learnt too, as texts may be short.
SHORTEST = 24
# Windows that are classified at a time, whatever texts they are from.
GATHERED = 1024
FINE = 1 << 20


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def _cut(batches: Iterator[pa.RecordBatch], per_text: int) -> Iterator[pa.RecordBatch]:
    """Windows at hashed places of each text, some of them short; equal texts give equal ones."""
    for batch in batches:
        cuts = []
        for text, mark in zip(batch.column("text").to_pylist(), batch.column("mark").to_pylist()):
            data = text.encode("utf-8")
            source = np.random.default_rng(mark & ((1 << 63) - 1))
            own = []
            for _ in range(per_text):
                start = int(source.integers(max(1, len(data) - WINDOW + 1)))
                size = WINDOW if source.random() < 0.5 else int(source.integers(SHORTEST, WINDOW + 1))
                own.append(data[start:start + size])
            cuts.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("mark"), pa.array(cuts, pa.list_(pa.binary()))],
                                         ["lang", "mark", "cuts"])


def training_windows(docs: DataFrame, learn: Column | None = None, per_language: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """(lang, mark, cuts): a bounded number of different texts of every language, by hash.

    A text repeated any number of times counts once. Languages are thinned on the
    executors to about twice the number wanted before they are ranked.
    """
    rows = docs.where(learn) if learn is not None else docs
    ship(docs.sparkSession)
    labelled = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    marked = labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).withColumn("mark", F.xxhash64("text"))
    # One row a language, as many as the network has outputs.
    sizes = marked.groupBy("lang").agg(F.approx_count_distinct("mark").alias("different")).collect()
    wanted = max(min(per_language, LEAST_TEXTS), min(per_language, ALL_TEXTS // max(1, len(sizes))))
    different = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], float(r["different"]))] or [F.lit(""), F.lit(0.0)])
    spot = F.pmod(F.xxhash64("mark"), F.lit(FINE))
    thin = marked.where(spot * different[F.col("lang")] < F.lit(2.0 * FINE * wanted)).select("lang", "mark", "text")
    cut = thin.mapInArrow(lambda b: _cut(b, WINDOWS_PER_TEXT), "lang string, mark bigint, cuts array<binary>")
    once = cut.groupBy("lang", "mark").agg(F.first("cuts").alias("cuts"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    return once.withColumn("place", place).where(F.col("place") <= wanted).drop("place")


def fit_language(docs: DataFrame, learn: Column | None = None, per_language: int = TEXTS_PER_LANGUAGE) -> ByteNetwork | None:
    """Learn from the texts and non-null langs of ``docs`` that pass ``learn``.

    The driver sees WINDOWS_PER_TEXT windows of at most ``per_language`` texts a
    language (ALL_TEXTS in all, but LEAST_TEXTS a language). Languages weigh the same.
    Texts without a letter teach nothing. Nothing to learn from gives None.
    """
    rows = sorted(training_windows(docs, learn, per_language).collect(), key=lambda r: (r["lang"], r["mark"]))
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    place = {lang: i for i, lang in enumerate(labels)}
    cuts = [(place[r["lang"]], bytes(c)) for r in rows for c in r["cuts"]]
    windows = np.concatenate([windows_of(c.ljust(1, b"\0"))[:1] for _, c in cuts])
    target = np.array([lang for lang, _ in cuts])
    useful = letter_bytes(windows) > 0
    windows, target = windows[useful], target[useful]
    weight = 1.0 / np.bincount(target, minlength=len(labels))[target]
    return train(windows, target, weight, labels)


class _Gathered:
    """Weighted sums of window probabilities of many texts, classified GATHERED at a time."""

    def __init__(self, net: ByteNetwork) -> None:
        self.net = net
        self.held: list[tuple[int, np.ndarray]] = []
        self.count = 0
        self.sums: dict[int, np.ndarray] = {}

    def add(self, text: int, data: bytes) -> None:
        for lo in range(0, len(data), GATHERED * WINDOW):
            part = windows_of(data[lo:lo + GATHERED * WINDOW])
            self.held.append((text, part))
            self.count += len(part)
            if self.count >= GATHERED:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        windows = np.concatenate([w for _, w in self.held])
        letters = letter_bytes(windows).astype(np.float64)
        found = np.zeros((len(windows), len(self.net.labels)))
        found[letters > 0] = self.net.probabilities(windows[letters > 0])
        found *= letters[:, None]
        at = 0
        for text, part in self.held:
            self.sums[text] = self.sums.get(text, 0.0) + found[at:at + len(part)].sum(axis=0)
            at += len(part)
        self.held, self.count = [], 0


def predict_language(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text).

    Every window of the whole text is classified; windows weigh as much as they have
    bytes of letters. score is the mean probability of the language given. A text
    that is null or without a letter is UNKNOWN with score 0, and so is any if
    nothing was learnt. Repeated rows are all returned, null ids stay null, other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("text").to_pylist()
            gathered = _Gathered(net) if net is not None else None
            for i, text in enumerate(values):
                if gathered is not None and has_letter(text):
                    gathered.add(i, text.encode("utf-8"))
            if gathered is not None:
                gathered.flush()
            sums = gathered.sums if gathered is not None else {}
            langs, scores = [], []
            for i in range(len(values)):
                total = sums.get(i)
                best = int(np.argmax(total)) if total is not None else None
                langs.append(UNKNOWN if best is None else net.labels[best])
                scores.append(0.0 if best is None else min(1.0, float(total[best] / total.sum())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that are not learnt from: crc32 of the id as text modulo 4 is 2; a null id is no text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
