"""Features and labels for snapshots: past-only form, future labels, schedule.

A snapshot is one row per (scope, period, entity), e.g. a player before the
deadline of a gameweek. Facts are one row per (scope, period, entity) too, so
facts and snapshots meet in one union and every range is one window over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.calendar import BLOCK, windowed
from tidemark.operators.guards import validate_horizons
from tidemark.operators.ordered import join_null_safe


def _meet(
    snapshots: DataFrame, facts: DataFrame, key: Sequence[str], fact_period: str, period: str,
    values: Sequence[str],
) -> DataFrame:
    asked = snapshots.select(*key, F.col(period).cast("bigint").alias("__p")).distinct()
    given = facts.select(
        *key, F.col(fact_period).cast("bigint").alias("__p"), *values,
        F.lit(1).alias("__fact"),
    )
    both = asked.withColumn("__asked", F.lit(1)).unionByName(given, allowMissingColumns=True)
    # One row per key and period: a snapshot and its own period's facts.
    return both.groupBy(*key, "__p").agg(
        F.max("__asked").alias("__asked"), F.max("__fact").alias("__fact"),
        *[F.max(v).alias(v) for v in values],
    )


def recent_form(
    snapshots: DataFrame, facts: DataFrame, scope: Sequence[str], entity: Sequence[str],
    period: str, fact_period: str, window: int, means: Mapping[str, str], available: str,
    block: int = BLOCK,
) -> DataFrame:
    """Mean of fact values over present rows in ``[g-window, g-1]``.

    Periods without a row are left out, blank or not. ``available`` counts the
    periods present; an entity with none gets NULL in every column.
    """
    validate_horizons([window])
    key = [*scope, *entity]
    values = sorted(set(means.values()))
    met = _meet(snapshots, facts, key, fact_period, period, values)
    outputs = {name: ("avg", F.col(v).cast("double")) for name, v in means.items()}
    outputs["__present"] = ("count", F.col("__fact"))
    form = windowed(met, key, "__p", {(-window, -1): outputs}, block)
    form = form.filter("__asked = 1").select(
        *key, F.col("__p").alias(period), *means,
        F.when(F.col("__present") > 0, F.col("__present")).alias(available),
    )
    return join_null_safe(
        snapshots.withColumn(period, F.col(period).cast("bigint")), form, [*key, period]
    )


def complete_horizon_labels(
    snapshots: DataFrame, facts: DataFrame, scope: Sequence[str], entity: Sequence[str],
    period: str, fact_period: str, labels: Mapping[int, Mapping[str, str]], block: int = BLOCK,
) -> DataFrame:
    """Sums over ``[g, g+h-1]``, NULL unless the horizon is complete.

    Complete means that every period of the horizon occurs league-wide *and*
    the entity has a row in each. The second implies the first, so the entity's
    own count decides.
    """
    horizons = validate_horizons(list(labels))
    key = [*scope, *entity]
    values = sorted({v for outputs in labels.values() for v in outputs.values()})
    met = _meet(snapshots, facts, key, fact_period, period, values)
    spans = {}
    for h in horizons:
        outputs = {f"__s_{n}": ("sum", F.col(v).cast("double")) for n, v in labels[h].items()}
        spans[(0, h - 1)] = outputs | {f"__have_{h}": ("count", F.col("__fact"))}
    found = windowed(met, key, "__p", spans, block).filter("__asked = 1")
    result = found.select(
        *key, F.col("__p").alias(period),
        *[F.when(F.col(f"__have_{h}") == h, F.coalesce(F.col(f"__s_{n}"), F.lit(0.0))).alias(n)
          for h in horizons for n in labels[h]],
    )
    return join_null_safe(
        snapshots.withColumn(period, F.col(period).cast("bigint")), result, [*key, period]
    )


def sides(
    fixtures: DataFrame, keep: Sequence[str], home: str, away: str,
    home_score: str | None = None, away_score: str | None = None,
) -> DataFrame:
    """A two-sided event as one row per side, without a shuffle.

    Columns: ``keep``, ``club``, ``opponent``, ``is_home`` and, with scores,
    ``goals_for`` and ``goals_against``.
    """
    def side(club: str, other: str, flag: bool, own: str | None, theirs: str | None):
        fields = [F.col(club).alias("club"), F.col(other).alias("opponent"),
                  F.lit(flag).alias("is_home")]
        if own and theirs:
            fields += [F.col(own).alias("goals_for"), F.col(theirs).alias("goals_against")]
        return F.struct(*fields)

    pair = F.array(side(home, away, True, home_score, away_score),
                   side(away, home, False, away_score, home_score))
    return fixtures.select(*keep, F.explode(pair).alias("__side")).select(*keep, "__side.*")


def schedule_by_snapshot(
    fixtures: DataFrame, scope: Sequence[str], period: str, snapshot: str, reach: int,
    measures: Sequence[str] = (),
) -> DataFrame:
    """Copy each fixture to the snapshots ``(period-reach, period]`` that look ahead to it."""
    return fixtures.select(
        *scope, period, *measures,
        F.explode(F.sequence(F.col(period) - (reach - 1), F.col(period))).alias(snapshot),
    )


def upcoming_counts(
    upcoming: DataFrame, scope: Sequence[str], snapshot: str, period: str,
    home: str, away: str, horizons: Sequence[int], weight: str | None = None,
) -> DataFrame:
    """Home, away and total fixtures ahead, per club and snapshot.

    ``upcoming`` has one row per fixture and snapshot that can see it; ``weight``
    is the number of fixtures a row stands for. Clubs without any are absent,
    see :func:`attach_upcoming_counts`.
    """
    horizons = validate_horizons(horizons)
    extra = [weight] if weight else []
    rows = sides(upcoming, [*scope, snapshot, period, *extra], home, away)
    amount = F.col(weight) if weight else F.lit(1)
    ahead = F.col(period) - F.col(snapshot)
    aggregates = []
    for h in horizons:
        inside = (ahead >= 0) & (ahead < h)
        for label, condition in (("home_", F.col("is_home")), ("away_", ~F.col("is_home")),
                                 ("", F.lit(True))):
            aggregates.append(
                F.sum(F.when(inside & condition, amount).otherwise(0)).cast("bigint")
                .alias(f"upcoming_{label}fixture_count_{h}")
            )
    return rows.groupBy(*scope, snapshot, "club").agg(*aggregates)


def attach_upcoming_counts(
    snapshots: DataFrame, counts: DataFrame, scope: Sequence[str], snapshot: str, club: str,
) -> DataFrame:
    """Join counts to snapshot rows; a club without fixtures has 0 of them."""
    named = counts.withColumnRenamed("club", club)
    keys = [*scope, snapshot, club]
    joined = join_null_safe(snapshots, named, keys)
    measures = [c for c in named.columns if c not in keys]
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in measures})
