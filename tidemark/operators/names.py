"""Exact ranking of names without a minimum score: a top-k join by falling thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.guards import ContractError
from tidemark.operators.joins import _aliases, _best_pairs, _forms
from tidemark.session import checkpointed

# A text within another scores at least this much, so that below it edits alone count.
CONTAINED = 0.75
# The thresholds after it. At 0 a pair only has to share a letter.
THRESHOLDS = (0.6, 0.45, 0.3, 0.15, 0.0)


def _letters(text: Column) -> Column:
    """The letters of a text, equal ones numbered: two texts share as many of these
    as they share letters."""
    each = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(each, lambda c, i: F.concat(
        c, F.size(F.filter(F.slice(each, 1, i + 1), lambda d: d == c)).cast("string")))


def _ranked_letters(texts: DataFrame, frequency: DataFrame, text: str) -> DataFrame:
    """Each different text with its numbered letters, from the rarest to the commonest."""
    spread = texts.select(text).distinct().withColumn("__letter", F.explode(_letters(F.col(text))))
    known = spread.join(frequency, "__letter", "left")
    order = F.struct(F.coalesce("__f", F.lit(0)).alias("f"), F.col("__letter").alias("l"))
    return known.groupBy(text).agg(F.sort_array(F.collect_list(order)).alias("__order")).select(
        text, F.transform("__order", lambda o: o["l"]).alias("__letters"))


def _similar_pairs(left: DataFrame, right: DataFrame, lengths: Sequence[int], least: float) -> DataFrame:
    """(__o, __c, score) of all pairs of ranked texts whose edit ratio reaches ``least``.

    A pair that reaches it shares at least ``least * longer`` letters, so its rarest
    shared letter stands among the first ``length - shared + 1`` of either text
    (prefix filtering). Texts meet on (letter, length); a pair is kept at its rarest
    shared letter only, where the letters it shares are counted before any edits are.
    """
    own = F.size("__letters")
    near = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda m: (
        F.least(own, m) >= least * F.greatest(own, m) - 1e-9))
    needed = F.greatest(F.ceil(least * F.greatest(own, F.col("__m")) - 1e-9), F.lit(1)).cast("int")
    asked = left.withColumn("__m", F.explode(near)).withColumn("__t", needed)
    one = asked.select("__o", "__m", "__t", F.col("__letters").alias("__lo"), F.explode(
        F.slice("__letters", F.lit(1), own - F.col("__t") + 1)).alias("__letter"))
    two = right.select("__c", F.size("__letters").alias("__m"), F.col("__letters").alias("__lc"),
                       F.posexplode("__letters").alias("__at", "__letter"))
    shared = F.array_intersect("__lo", "__lc")
    met = one.join(two, ["__letter", "__m"]).filter(
        (F.col("__at") <= F.col("__m") - F.col("__t")) & (F.size(shared) >= F.col("__t"))
        & (F.element_at(shared, 1) == F.col("__letter")))
    longer = F.greatest(F.length("__o"), F.length("__c"))
    score = 1.0 - F.levenshtein("__o", "__c") / longer
    return met.select("__o", "__c", score.alias("score")).filter(
        (F.col("score") >= least - 1e-12) & (F.col("score") > 0))


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys that may be NULL, keeping the left ones."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], how).drop(
        *[f"__r_{k}" for k in keys])


def _best(scores: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """The ``top`` candidates per key, by score, then by id."""
    each = scores.groupBy(*keys, "candidate").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("candidate"))
    return each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def _smallest(candidates: DataFrame, grouped: bool, count: int) -> tuple[DataFrame, DataFrame | None]:
    """The smallest ids in one row, and in one row per group."""
    ids = candidates.select("candidate").distinct().orderBy("candidate").limit(count).agg(
        F.sort_array(F.collect_list("candidate")).alias("__ids"))
    if not grouped:
        return ids, None
    order = Window.partitionBy("__h").orderBy("candidate")
    few = candidates.select("__h", "candidate").distinct().withColumn("__p", F.row_number().over(order)).filter(
        F.col("__p") <= count)
    return ids, few.groupBy(F.col("__h").alias("observed_group")).agg(
        F.sort_array(F.collect_list("candidate")).alias("__own"))


def _zeros(
    short: DataFrame, found: DataFrame, candidates: DataFrame, keys: Sequence[str], top: int,
) -> DataFrame:
    """Candidates that share nothing with a text, for texts with fewer than ``top`` scores.

    They tie at 0, so the smallest ids come first; as fewer than ``top`` candidates
    have a score, enough of the ``2 * top`` smallest of the group have none.
    """
    grouped = len(keys) > 1
    ids, own = _smallest(candidates, grouped, 2 * top)
    listed = short.join(F.broadcast(ids))
    if grouped:
        listed = listed.join(own, "observed_group", "left").withColumn(
            "__ids", F.when(F.col("observed_group").isNull(), F.col("__ids")).otherwise(F.col("__own")))
    filled = listed.select(*keys, F.explode("__ids").alias("candidate"))
    return _match(filled, found.select(*keys, "candidate"), [*keys, "candidate"], "left_anti").withColumn(
        "score", F.lit(0.0))


def rank_names(
    observed: DataFrame, observed_text: str, candidates: DataFrame, candidate_id: str,
    candidate_text: str | Sequence[str], top: int = 8, observed_group: str | None = None,
    candidate_group: str | None = None,
) -> DataFrame:
    """The ``top`` best candidates of every distinct text, however badly they fit.

    (observed, [observed_group,] candidate, score, place): the score is that of
    :func:`similarity`, the best of a text's forms and a candidate's aliases; equal
    scores are ordered by id. A text with a group is ranked among the candidates of
    that group, one without among all. Texts that are NULL or empty, or share no
    letter with a candidate, score 0 with it. A text gets fewer than ``top`` rows
    only if there are fewer candidates, and one row of NULLs if there are none.

    Thresholds fall from round to round. A round finds all pairs that reach its
    threshold; a text with ``top`` of them is done, as everything unseen scores less,
    and only the others go on. Pairs are made where they share their rarest letter
    among few, never all with all.
    """
    if top < 1:
        raise ContractError("top must be positive")
    if bool(observed_group) != bool(candidate_group):
        raise ContractError("groups are needed on both sides")
    asked, close = _best_pairs(observed, observed_text, candidates, candidate_id, candidate_text,
                               CONTAINED, 2, observed_group, candidate_group)
    keys = ["observed"] + (["observed_group"] if observed_group else [])
    asked = checkpointed(asked)
    right = checkpointed(_aliases(candidates, candidate_id, candidate_text, candidate_group))
    every = candidates.select(F.col(candidate_id).alias("candidate"), *(
        [F.col(candidate_group).alias("__h")] if candidate_group else [])).filter("candidate IS NOT NULL")
    names = right.select("__c").distinct()
    frequency = checkpointed(names.select(F.explode(_letters(F.col("__c"))).alias("__letter")).groupBy(
        "__letter").agg(F.count("*").alias("__f")))
    known = checkpointed(_ranked_letters(names, frequency, "__c"))
    # As many as there are different lengths of names.
    lengths = [r[0] for r in known.select(F.size("__letters").alias("m")).distinct().orderBy("m").collect()]
    found = checkpointed(_best(close, keys, top).drop("place"))
    forms = asked.withColumn("__o", F.explode(_forms(F.col("observed")))).filter("__o <> ''")

    def unfinished(scores: DataFrame) -> DataFrame:
        done = scores.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") >= top).select(*keys)
        return _match(asked, done, keys, "left_anti")

    short = checkpointed(unfinished(found))
    for least in THRESHOLDS if lengths else ():
        if short.isEmpty():
            break
        mine = _match(forms, short, keys, "left_semi")
        pairs = _similar_pairs(_ranked_letters(mine, frequency, "__o"), known, lengths, least)
        named = pairs.join(mine, "__o").join(right, "__c")
        if observed_group:
            named = named.filter(F.col("observed_group").isNull() | (F.col("observed_group") == F.col("__h")))
        more = named.select(*keys, "candidate", "score")
        found = checkpointed(_best(found.unionByName(more), keys, top).drop("place"))
        short = checkpointed(unfinished(found))
    scores = found.unionByName(_zeros(short, found, every, keys, top))
    return _match(asked, _best(scores, keys, top), keys, "left").select(*keys, "candidate", "score", "place")
