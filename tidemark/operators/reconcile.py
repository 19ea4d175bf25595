"""Rescale probabilities so that each group's sum meets its target.

All members of a group get the same shift in log-odds, which keeps their order.
The sum grows with the shift, so the shift is found by narrowing an interval.
Each pass is one grouped aggregation that evaluates ``SECTIONS - 1`` shifts at
once (partial sums are combined map-side), so a group may be any size: its
members are never gathered. Newton steps take the remaining width (about 1e-3)
to rounding error, never leaving the interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clip
from tidemark.operators.guards import require_no_rows
from tidemark.operators.ordered import join_null_safe
from tidemark.session import checkpointed

# Clipping of probabilities and the span of log-odds shifts.
EPSILON = 1e-9
SPAN = 40.0
SECTIONS = 16
PASSES = 4
NEWTON_STEPS = 3


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _logit(p: Column) -> Column:
    bounded = clip(p, EPSILON, 1.0 - EPSILON)
    return F.ln(bounded / (1.0 - bounded))


def shared_shift(
    df: DataFrame, groups: Sequence[str], probability: str, target: Column,
) -> DataFrame:
    """Log-odds shift per group: ``groups, members, target, before, shift``.

    ``target`` is an expression over the group columns; it is capped at the
    group's size, where every member becomes 1 (``shift`` is NULL then). Equal
    probabilities of a group are folded and materialised once; all passes read them.
    """
    folded = df.groupBy(*groups, F.col(probability).cast("double").alias("__p")).agg(
        F.count("*").alias("__c")
    ).withColumn("__l", _logit(F.col("__p")))
    folded = checkpointed(folded)
    totals = folded.groupBy(*groups).agg(
        F.sum("__c").alias("members"), F.sum(F.col("__c") * F.col("__p")).alias("before")
    ).withColumn("target", F.least(target.cast("double"), F.col("members").cast("double")))
    facts = ["members", "before", "target"]
    kept = [f"max({c}) AS {c}" for c in (*facts, "__lo", "__hi")]
    sums = ", ".join(
        f"sum(__c / (1 + exp(-(__l + __lo + (__hi - __lo) * {j / SECTIONS!r}D))))"
        for j in range(1, SECTIONS))
    bounds = totals.withColumns({"__lo": F.lit(-SPAN), "__hi": F.lit(SPAN)})
    for _ in range(PASSES):
        # The interval and the group's facts ride along, so each pass reads the
        # previous one once and the plan grows by one join per pass.
        rows = join_null_safe(folded, bounds, groups)
        met = rows.groupBy(*groups).agg(
            *[F.expr(e) for e in kept], F.expr(f"array({sums})").alias("__s"))
        bounds = met.withColumn(
            "__k", F.expr("size(filter(__s, total -> total < target))")
        ).selectExpr(
            *[f"`{g}`" for g in groups], *facts,
            f"__lo + (__hi - __lo) / {SECTIONS} * __k AS __lo",
            f"__lo + (__hi - __lo) / {SECTIONS} * (__k + 1) AS __hi")
    at = bounds.withColumn("__m", F.expr("(__lo + __hi) / 2"))
    for _ in range(NEWTON_STEPS):
        met = join_null_safe(folded, at, groups).withColumn(
            "__p1", F.expr("1 / (1 + exp(-(__l + __m)))")
        ).groupBy(*groups).agg(
            *[F.expr(e) for e in (*kept, "max(__m) AS __m")],
            F.expr("sum(__c * __p1)").alias("__f"),
            F.expr("sum(__c * __p1 * (1 - __p1))").alias("__d"))
        step = "__m - coalesce(try_divide(__f - target, __d), 0D)"
        at = met.selectExpr(
            *[f"`{g}`" for g in groups], *facts, "__lo", "__hi",
            f"least(greatest({step}, __lo), __hi) AS __m")
    return at.select(
        *groups, *facts, F.when(F.col("target") < F.col("members"), F.col("__m")).alias("shift"))


def reconcile(
    df: DataFrame, groups: Sequence[str], probability: str, target: Column, name: str,
) -> DataFrame:
    """Add the rescaled probability as ``name``."""
    outside = df.filter(
        F.col(probability).isNull() | ~F.col(probability).cast("double").between(0.0, 1.0))
    require_no_rows(outside.select(*groups, probability), "probabilities outside [0, 1]")
    shifts = shared_shift(df, groups, probability, target).select(
        *groups, "target", F.col("shift").alias("__shift"))
    joined = join_null_safe(df, shifts, groups)
    moved = _sigmoid(_logit(F.col(probability).cast("double")) + F.col("__shift"))
    value = F.when(F.col("target") <= 0, F.lit(0.0)).when(
        F.col("__shift").isNull(), F.lit(1.0)).otherwise(moved)
    return joined.withColumn(name, value).drop("target", "__shift")


def reconcile_lineups(
    df: DataFrame, scope: Sequence[str], position: str, starts: str, appearances: str,
    keeper: str = "GKP", keeper_target: float = 1.0, outfield_target: float = 10.0,
) -> DataFrame:
    """One keeper and ten outfield starters expected per club.

    Keeps the inputs as ``independent_*`` and raises each appearance
    probability to at least the new start probability.
    """
    is_keeper = F.coalesce(F.upper(F.col(position)) == keeper, F.lit(False))
    roles = df.withColumns({
        f"independent_{starts}": F.col(starts).cast("double"),
        f"independent_{appearances}": F.col(appearances).cast("double"),
        "__role": F.when(is_keeper, F.lit("goalkeeper")).otherwise(F.lit("outfield")),
    })
    bad = roles.filter(
        F.col(appearances).isNull() | ~F.col(appearances).cast("double").between(0.0, 1.0))
    require_no_rows(bad.select(*scope, appearances), "probabilities outside [0, 1]")
    wanted = F.when(F.col("__role") == "goalkeeper", keeper_target).otherwise(outfield_target)
    fitted = reconcile(roles, [*scope, "__role"], starts, wanted, "__fit")
    return fitted.withColumns({
        starts: F.col("__fit"),
        appearances: F.greatest(F.col(f"independent_{appearances}"), F.col("__fit")),
    }).drop("__fit", "__role")


def reconcile_audit(
    df: DataFrame, scope: Sequence[str], position: str, before: str, after: str,
    keeper: str = "GKP",
) -> DataFrame:
    """Members and probability sums before and after, per club and role."""
    role = F.when(F.coalesce(F.upper(F.col(position)) == keeper, F.lit(False)),
                  F.lit("goalkeeper")).otherwise(F.lit("outfield"))
    return df.groupBy(*scope, role.alias("role")).agg(
        F.count("*").alias("players"), F.sum(before).alias("before"), F.sum(after).alias("after"))
