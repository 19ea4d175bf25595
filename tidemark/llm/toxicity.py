"""Toxicity: boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import Calibrated, fit_calibrated
from tidemark.llm.common import texts, written

# Pronouns of address in the corpus' languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch "
    "tu toi te ton ta tes vous votre tú ti tus usted ustedes vos".split())
# Symbols written in place of letters.
STAND_INS = str.maketrans("0134578@$!|", "oieastbasil")

WORD = re.compile(r"[^\W\d_]+")
STAND_IN = re.compile(r"(?<=[^\W\d_])[0134578@$*!|]+(?=[^\W\d_])")
PREFIXES = (4, 5, 6)
NEAR = 40
FEATURES = ("log_words", "word_hits", "word_density", "prefix_hits", "prefix_density", "distinct_hits",
            "weight_density", "second_person", "second_person_near", "capitals", "shouted", "punctuation",
            "exclaimed", "digits", "stand_ins", "hidden_hits", "stretched")


@dataclass
class Lexicon:
    """Whole words and word beginnings that mark label 1, with their log-odds."""

    words: dict[str, float]
    prefixes: dict[str, float]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in {**self.words, **self.prefixes}:
            found.add_word(term, term)
        if len(found):
            found.make_automaton()
        return found


def terms(text: str) -> set[str]:
    """Words and word beginnings of a text; beginnings end in a hyphen."""
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:n]}-" for w in words for n in PREFIXES if len(w) > n}


def _hits(lexicon: Lexicon, automaton, low: str) -> list[tuple[int, int, str, bool]]:
    out = []
    if not len(automaton):
        return out
    for last, term in automaton.iter(low):
        start = last - len(term) + 1
        if start and low[start - 1].isalpha():
            continue
        whole = last + 1 == len(low) or not low[last + 1].isalpha()
        if whole and term in lexicon.words:
            out.append((start, last, term, True))
        elif not whole and term in lexicon.prefixes:
            out.append((start, last, term, False))
    return out


def features(text: str, lexicon: Lexicon, automaton) -> list[float]:
    """The values of FEATURES for a whole text. An empty text has zeros only."""
    low = text.lower()
    words = text.split()
    n = max(1, len(words))
    spoken = [w.strip(".,;:!?") for w in low.split()]
    hits = _hits(lexicon, automaton, low)
    whole = [h for h in hits if h[3]]
    begun = [h for h in hits if not h[3]]
    near = sum(1 for s, e, _, _ in hits
               if not SECOND_PERSON.isdisjoint(WORD.findall(low[max(0, s - NEAR):e + NEAR])))
    hidden = changed = 0
    for m in STAND_IN.finditer(low):
        changed += 1
        left, right = m.start(), m.end()
        while left and not low[left - 1].isspace() and m.start() - left < 32:
            left -= 1
        while right < len(low) and not low[right].isspace() and right - m.end() < 32:
            right += 1
        hidden += len(_hits(lexicon, automaton, low[left:right].translate(STAND_INS)))
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    count = np.bincount(raw, minlength=256)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    marks = count[33:48].sum() + count[58:65].sum()
    same = (raw[1:] == raw[:-1]) & (raw[1:] >= 97) & (raw[1:] < 123)
    stretched = int((same[1:] & same[:-1]).sum()) if len(raw) > 2 else 0
    weight = sum(lexicon.words[t] if w else lexicon.prefixes[t] for _, _, t, w in hits)
    size = max(1, len(raw))
    return [math.log1p(len(words)), math.log1p(len(whole)), 100 * len(whole) / n, math.log1p(len(begun)),
            100 * len(begun) / n, len({t for _, _, t, _ in hits}), weight / n,
            sum(map(SECOND_PERSON.__contains__, spoken)) / n, near, float(upper) / max(1, upper + lower),
            sum(1 for w in words if len(w) > 1 and w.isupper()) / n, float(marks) / size,
            float(count[33] + count[63]) / n, float(count[48:58].sum()) / size, 100 * changed / n, hidden,
            stretched / n]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    scorer: Calibrated

    def score(self, rows: list[str], automaton) -> np.ndarray:
        x = np.array([features(t, self.lexicon, automaton) for t in rows], dtype=float)
        return self.scorer.predict(x.reshape(len(rows), len(FEATURES)))


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, float]]:
    """Texts of at most ``per_label`` rows of each label, and what each stands for."""
    known = (labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic"))
             .where("id is not null and toxic in (0, 1)").where(~held_out(F.col("id")))
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen, weights = None, {}
    for label, total in sorted(totals.items()):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(per_label)
        chosen = part if chosen is None else chosen.union(part)
        weights[label] = total / min(total, per_label)
    if chosen is None:
        chosen = known
    # At most 2 * per_label ids: small enough to broadcast by the parameter's bound.
    picked = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("id")).select("id", "text", "toxic")
    return written(picked, "labelled"), weights


def _learn_lexicon(sample: DataFrame, size: int, least_z: float) -> Lexicon:
    """The terms whose share of label 1 stands out most; counted by Spark over the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = sorted(terms(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], ["term", "toxic"])

    base = sample.agg(F.count("*"), F.sum("toxic")).first()
    rows, marked = base[0] or 0, base[1] or 0
    if not 0 < marked < rows:
        return Lexicon({}, {})
    share = marked / rows
    counted = sample.mapInArrow(run, "term string, toxic int").groupBy("term").agg(
        F.sum("toxic").alias("p"), F.count("*").alias("n"))
    z = (F.col("p") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    odds = (F.log((F.col("p") + 0.5) / (marked + 1.0))
            - F.log((F.col("n") - F.col("p") + 0.5) / (rows - marked + 1.0)))
    best = (counted.where("p >= 3").select("term", z.alias("z"), odds.alias("odds"))
            .where(F.col("z") >= least_z).where("odds > 1.5").orderBy(F.desc("z"), "term").limit(size).collect())
    return Lexicon({r["term"]: r["odds"] for r in best if not r["term"].endswith("-")},
                   {r["term"][:-1]: r["odds"] for r in best if r["term"].endswith("-")})


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 3000, lexicon_size: int = 600,
                 least_z: float = 5.5) -> ToxicityModel:
    """Learn lexicon, trees and calibration from labelled rows that are not held out.

    ``per_label`` bounds the rows of either label that are learnt from, taken in the
    order of a hash of their id. Rows stand for all labelled rows of their label, so
    that scores are calibrated to the labelled base rate. Only the lexicon (at most
    ``lexicon_size`` terms) and the feature rows of the sample reach the driver.
    Null ids or labels are left out; conflicting labels of an id count as toxic.
    Without both labels the score is constant.
    """
    sample, weights = _sample(texts(docs), labels, per_label)
    lexicon = _learn_lexicon(sample, lexicon_size, least_z)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = [features(t, lexicon, automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"),
                                              pa.array(x, pa.list_(pa.float64()))], ["id", "toxic", "x"])

    rows = sorted(tuple(r) for r in sample.mapInArrow(run, "id bigint, toxic int, x array<double>").collect())
    x = np.array([r[2] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    y = np.array([r[1] for r in rows], dtype=float)
    weight = np.array([weights[r[1]] for r in rows], dtype=float)
    return ToxicityModel(lexicon, fit_calibrated(x, y, weight))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; whole texts, no shuffle.

    The score uses the text alone. A null text is scored as an empty one; null ids
    are kept; repeated rows get equal scores; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.lexicon.automaton()
        for batch in batches:
            score = model.score(batch.column("text").to_pylist(), automaton)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())],
                                             ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, all columns kept. No shuffle."""
    texts(docs)  # sets the batch size
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.lexicon.automaton()
        for batch in batches:
            score = model.score([t or "" for t in batch.column(place).to_pylist()], automaton)
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
