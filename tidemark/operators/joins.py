"""Lookups with a contract, as-of snapshot choice, membership and name matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import fold, match_key
from tidemark.operators.guards import ContractError, require_no_rows, require_unique
from tidemark.operators.ordered import exact_quantiles


def unmapped(facts: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the facts that the dimension does not have."""
    asked = facts.select(*keys).distinct()
    return asked.join(dimension.select(*keys), list(keys), "left_anti")


def lookup(
    facts: DataFrame, dimension: DataFrame, keys: Sequence[str], strict: bool = True,
    unique: bool = False,
) -> DataFrame:
    """Many-to-one left join; with ``strict`` a key without a match is an error.

    No broadcast is forced: AQE broadcasts a dimension it measured to be small
    and splits a hot key of the facts otherwise.
    """
    if unique:
        require_unique(dimension, keys, "dimension")
    if strict:
        require_no_rows(unmapped(facts, dimension, keys), "keys without a match")
    return facts.join(dimension, list(keys), "left")


def inner_with_suffix(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str
) -> DataFrame:
    """One-to-one inner join; columns both sides have get a suffix on the right.

    A key that repeats on either side fails.
    """
    require_unique(left, keys, "left side")
    require_unique(right, keys, "right side")
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(
        right.withColumnsRenamed({c: c + suffix for c in clash}), list(keys), "inner"
    )


def complete_with(
    left: DataFrame, right: DataFrame, keys: Sequence[str], required: Sequence[str] = (),
) -> DataFrame:
    """Add only the right columns the left lacks; ``required`` ones must be filled."""
    fresh = [c for c in right.columns if c not in left.columns]
    joined = left.join(right.select(*keys, *fresh), list(keys), "left")
    for column in required:
        require_no_rows(joined.filter(F.col(column).isNull()).select(*keys),
                        f"no {column} for keys")
    return joined


def newest_identity(
    snapshots: DataFrame, identity: Sequence[str], stamp: str,
    filters: Mapping[str, object] | None = None, not_after: Column | None = None,
) -> DataFrame:
    """Identity of the newest snapshot that passes the filters: one row.

    Filters are plain comparisons that reach the scan; the choice is a top-1
    aggregate, not a sort.
    """
    chosen = snapshots
    for column, value in (filters or {}).items():
        chosen = chosen.filter(F.col(column) == F.lit(value))
    if not_after is not None:
        chosen = chosen.filter(F.col(stamp) <= not_after)
    newest = chosen.agg(
        F.max_by(F.struct(*identity), F.struct(F.col(stamp), *identity)).alias("__s"))
    return newest.select("__s.*").filter(
        " OR ".join(f"`{c}` IS NOT NULL" for c in identity))


def rows_of(df: DataFrame, identity: DataFrame) -> DataFrame:
    """Rows that belong to a snapshot identity (one row, so it is broadcast)."""
    return df.join(F.broadcast(identity), identity.columns, "left_semi")


def similarity(left: Column, right: Column) -> Column:
    """Edit-distance ratio, raised when one text contains the other.

    The ratio is ``1 - levenshtein / longer length``. Containment scores at
    least ``0.75 + 0.25 * shorter / longer``.
    """
    longer = F.greatest(F.length(left), F.length(right))
    shorter = F.least(F.length(left), F.length(right))
    ratio = 1.0 - F.levenshtein(left, right) / longer
    contained = F.contains(left, right) | F.contains(right, left)
    return F.when(
        contained, F.greatest(ratio, 0.75 + 0.25 * shorter / longer)
    ).otherwise(ratio)


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))),
            lambda i: F.substring(text, i, F.lit(size)),
        )
    )


def _forms(text: Column) -> Column:
    """The texts an observed one is compared by: as a whole, and its longer words."""
    words = F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return F.array_union(F.array(match_key(text)), words)


def _aliases(
    candidates: DataFrame, candidate_id: str, candidate_text: str | Sequence[str],
    candidate_group: str | None,
) -> DataFrame:
    """Every different alias of every candidate."""
    columns = [candidate_text] if isinstance(candidate_text, str) else candidate_text
    return candidates.select(
        F.col(candidate_id).alias("candidate"),
        F.explode(F.array(*[match_key(F.col(c)) for c in columns])).alias("__c"),
        *([F.col(candidate_group).alias("__h")] if candidate_group else []),
    ).filter("__c <> ''").distinct()


def _best_pairs(
    observed: DataFrame, observed_text: str, candidates: DataFrame, candidate_id: str,
    candidate_text: str | Sequence[str], minimum: float, gram: int,
    observed_group: str | None, candidate_group: str | None,
) -> tuple[DataFrame, DataFrame]:
    """All distinct observed texts, and all pairs that reach ``minimum`` with their score.

    An observed text is compared as a whole and word by word (words of three
    letters or more); the best comparison counts. Each distinct spelling is
    compared once. In place of a cross join, pairs meet on character grams, and
    no pair reaching ``minimum`` is missed:

    * a pair within ``d = (1 - minimum) * longer`` edits differs in at most
      ``gram * d`` grams, so if it shares a gram at all it shares one of the
      ``gram * d + 1`` rarest grams of either text (prefix filtering);
    * texts with no more than ``gram * d`` grams may share none; those few meet
      on single characters instead;
    * a text inside the other shares its rarest gram with it.
    """
    if not 0 < minimum <= 1:
        raise ContractError("minimum must be in (0, 1]")
    asked = observed.select(
        F.col(observed_text).alias("observed"),
        *([F.col(observed_group).alias("observed_group")] if observed_group else []),
    ).distinct()
    left = asked.withColumn("__o", F.explode(_forms(F.col("observed")))).filter("__o <> ''")
    right = _aliases(candidates, candidate_id, candidate_text, candidate_group)
    texts = left.select(F.col("__o").alias("text"), F.lit(True).alias("__left")).unionByName(
        right.select(F.col("__c").alias("text"), F.lit(False).alias("__left"))
    ).groupBy("text").agg(
        F.bool_or("__left").alias("__is_o"), F.bool_or(~F.col("__left")).alias("__is_c"))
    length = F.length("text")
    # A partner within the edit bound is at most ``length / minimum`` long.
    edits = F.floor((1.0 - minimum) * F.floor(length / minimum + 1e-9) + 1e-9)
    spread = texts.select(
        "text", "__is_o", "__is_c", F.explode(_grams(F.col("text"), gram)).alias("gram"))
    frequency = spread.groupBy("gram").agg(F.count("*").alias("__f"))
    ranked = spread.join(frequency, "gram").groupBy("text", "__is_o", "__is_c").agg(
        F.sort_array(F.collect_list(F.struct("__f", "gram"))).alias("__grams"))
    prefix = ranked.select("text", "__is_o", "__is_c", F.explode(
        F.slice("__grams", F.lit(1), (edits * gram + 1).cast("int"))).alias("__e"),
    ).select("text", "__is_o", "__is_c", F.col("__e.gram").alias("gram"))
    scarce = ranked.filter(F.size("__grams") <= edits * gram).select(
        "text", "__is_o", "__is_c", F.explode(_grams(F.col("text"), 1)).alias("gram"))

    def meet(a: DataFrame, b: DataFrame, condition: Column) -> DataFrame:
        one = a.filter("__is_o").select(F.col("text").alias("__o"), "gram")
        two = b.filter("__is_c").select(F.col("text").alias("__c"), "gram")
        return one.join(two, "gram").filter(condition).select("__o", "__c")

    longer = F.greatest(F.length("__o"), F.length("__c"))
    near = F.abs(F.length("__o") - F.length("__c")) <= F.floor((1.0 - minimum) * longer + 1e-9)
    rarest = ranked.select(
        "text", "__is_o", "__is_c", F.col("__grams")[0]["gram"].alias("gram"))
    # A one-letter text has no gram of its own; texts short enough to score with
    # it are listed by letter too.
    reach = int(0.25 / (minimum - 0.75) + 1e-9) if minimum > 0.75 else 2**30
    letters = texts.filter(length <= reach).select(
        "text", "__is_o", "__is_c", F.explode(_grams(F.col("text"), 1)).alias("gram"))
    whole = spread.unionByName(letters)
    pairs = (
        meet(prefix, prefix, near)
        .unionByName(meet(scarce, scarce, near))
        .unionByName(meet(rarest, whole, F.contains("__c", "__o")))
        .unionByName(meet(whole, rarest, F.contains("__o", "__c")))
        .distinct()
    )
    scored = pairs.withColumn("score", similarity(F.col("__o"), F.col("__c"))).filter(
        F.col("score") >= minimum - 1e-12)
    named = scored.join(left, "__o").join(right, "__c")
    keys = ["observed"] + (["observed_group"] if observed_group else [])
    if observed_group and candidate_group:
        named = named.filter(
            F.col("observed_group").isNull() | (F.col("observed_group") == F.col("__h")))
    return asked, named.groupBy(*keys, "candidate").agg(F.max("score").alias("score"))


def _placed(asked: DataFrame, best: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """The ``top`` candidates per key; a key without any stays, with a null candidate."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("candidate"))
    ranked = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    named = ranked.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return asked.join(named, same, "left").select(*keys, "candidate", "score", "place")


def match_names(
    observed: DataFrame, observed_text: str, candidates: DataFrame, candidate_id: str,
    candidate_text: str | Sequence[str], minimum: float, top: int = 8, gram: int = 2,
    observed_group: str | None = None, candidate_group: str | None = None,
) -> DataFrame:
    """Up to ``top`` candidates scoring at least ``minimum`` per distinct text.

    Of several alias columns of a candidate the best counts. A text that no
    candidate reaches is returned once, with null candidate, score and place.
    """
    asked, best = _best_pairs(observed, observed_text, candidates, candidate_id, candidate_text,
                              minimum, gram, observed_group, candidate_group)
    keys = ["observed"] + (["observed_group"] if observed_group else [])
    return _placed(asked, best, keys, top)


def match_readings(
    observed: DataFrame, observed_id: str, observed_text: str, candidates: DataFrame,
    candidate_id: str, candidate_text: str | Sequence[str], minimum: float, top: int = 8,
    gram: int = 2,
) -> DataFrame:
    """Up to ``top`` candidates per ``observed_id``, by all of its readings.

    A pair is found when some reading reaches ``minimum`` with some alias. For each
    found pair every reading is then scored, also below ``minimum`` and as often as
    it was read, by its best alias, and blended by ``reading_consensus``. An id for
    which nothing is found is returned once, with a null candidate.
    """
    readings = observed.select(
        F.col(observed_id).alias("observed_id"), F.col(observed_text).alias("observed"),
    ).groupBy("observed_id", "observed").agg(F.count("*").alias("__times"))
    _, best = _best_pairs(observed, observed_text, candidates, candidate_id, candidate_text,
                          minimum, gram, None, None)
    found = readings.join(best, "observed").select("observed_id", "candidate").distinct()
    forms = F.filter(_forms(F.col("observed")), lambda f: f != "")
    scores = (
        found.join(readings, "observed_id")
        .join(_aliases(candidates, candidate_id, candidate_text, None), "candidate")
        .withColumn("score", F.coalesce(
            F.array_max(F.transform(forms, lambda f: similarity(f, F.col("__c")))), F.lit(0.0)))
        .groupBy("observed_id", "observed", "candidate", "__times").agg(F.max("score").alias("score"))
        .withColumn("__time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__times"))))
    )
    blended = reading_consensus(
        scores.select("observed_id", "candidate", "score"), ["observed_id", "candidate"])
    return _placed(readings.select("observed_id").distinct(), blended, ["observed_id"], top)


def reading_consensus(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Blend several readings of one name: 0.55 of the best, 0.45 of the median."""
    best = scores.groupBy(*keys).agg((0.55 * F.max(score)).alias("__best"))
    middle = exact_quantiles(scores, keys, score, {"__middle": 0.5})
    return best.join(middle, list(keys)).select(
        *keys, (F.col("__best") + 0.45 * F.col("__middle")).alias("score"))
