"""Shrunk strength ratings known before a period, and upcoming opposition.

``matches`` goals at the league's mean rate are added to every club, so that a
club with few results stays near 1.0:

    attack  = ((goals_for     + k * L) / (matches + k)) / L
    concede = ((goals_against + k * L) / (matches + k)) / L

with ``L`` the mean goals per side so far (1.0 when it is not positive).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.guards import validate_horizons
from tidemark.operators.ordered import join_null_safe, past_totals
from tidemark.operators.snapshots import sides

PRIOR_MATCHES = 5.0
OPPONENT_MEASURES = (
    "opponent_attack_strength_mean",
    "opponent_goals_conceded_strength_mean",
    "attacking_fixture_factor_mean",
    "defensive_fixture_factor_mean",
)


def _rating_columns(prior: float) -> dict[str, Column]:
    rate = F.when(
        F.try_divide("league_goals", "league_sides") > 0,
        F.try_divide("league_goals", "league_sides"),
    ).otherwise(F.lit(1.0))
    known = F.coalesce(F.col("league_sides"), F.lit(0)) > 0

    def ratio(goals: str) -> Column:
        share = (F.coalesce(F.col(goals), F.lit(0.0)) + prior * F.col("__rate")) / (
            F.coalesce(F.col("matches"), F.lit(0.0)) + prior
        ) / F.col("__rate")
        return F.when(known, share).otherwise(F.lit(1.0))

    return {
        "__rate": rate,
        "attack_strength": ratio("goals_for"),
        "goals_conceded_strength": ratio("goals_against"),
        "home_factor": F.when(known, F.col("home_goals") / (F.col("league_sides") / 2)
                              / F.col("__rate")).otherwise(1.0),
        "away_factor": F.when(known, F.col("away_goals") / (F.col("league_sides") / 2)
                              / F.col("__rate")).otherwise(1.0),
    }


def _results(
    fixtures: DataFrame, scope: Sequence[str], period: str, home: str, away: str,
    home_score: str, away_score: str, weight: str | None,
) -> tuple[DataFrame, DataFrame]:
    """Finished results rolled up to (scope, period, club) and (scope, period)."""
    done = fixtures.filter(F.col(home_score).isNotNull() & F.col(away_score).isNotNull())
    amount = F.col(weight) if weight else F.lit(1)
    keep = [*scope, period] + ([weight] if weight else [])
    clubs = sides(done, keep, home, away, home_score, away_score).groupBy(
        *scope, period, "club"
    ).agg(
        F.sum(amount).cast("double").alias("matches"),
        F.sum("goals_for").cast("double").alias("goals_for"),
        F.sum("goals_against").cast("double").alias("goals_against"),
    )
    league = done.groupBy(*scope, period).agg(
        (2 * F.sum(amount)).cast("double").alias("league_sides"),
        F.sum(home_score).cast("double").alias("home_goals"),
        F.sum(away_score).cast("double").alias("away_goals"),
    ).withColumn("league_goals", F.col("home_goals") + F.col("away_goals"))
    return clubs, league


def ratings_before(
    fixtures: DataFrame, requests: DataFrame, scope: Sequence[str], period: str,
    home: str, away: str, home_score: str, away_score: str,
    prior: float = PRIOR_MATCHES, weight: str | None = None, chunks: int | None = None,
) -> DataFrame:
    """Ratings of each requested (scope, period, club) from strictly earlier results.

    Results are rolled up to periods first; requests then join the running
    totals as rows that add nothing, so every period is rated in one pass and no
    club-by-period grid is built. With ``weight``, a row stands for that many
    matches and its scores are their sums.
    """
    clubs, league = _results(
        fixtures, scope, period, home, away, home_score, away_score, weight
    )
    measures = ["matches", "goals_for", "goals_against"]
    wanted = requests.select(*scope, F.col(period), "club").distinct()
    asked = wanted.withColumn("__asked", F.lit(1))
    mixed = asked.unionByName(clubs, allowMissingColumns=True).groupBy(
        *scope, period, "club"
    ).agg(F.max("__asked").alias("__asked"), *[F.sum(m).alias(f"__{m}") for m in measures])
    totals = past_totals(
        mixed, [*scope, "club"], [period], {m: F.col(f"__{m}") for m in measures}, chunks=chunks
    ).filter("__asked = 1").select(*scope, period, "club", *measures)
    league_measures = ["league_sides", "home_goals", "away_goals", "league_goals"]
    periods = wanted.select(*scope, period).distinct().withColumn("__asked", F.lit(1))
    mixed_league = periods.unionByName(league, allowMissingColumns=True).groupBy(
        *scope, period
    ).agg(F.max("__asked").alias("__asked"),
          *[F.sum(m).alias(f"__{m}") for m in league_measures])
    league_totals = past_totals(
        mixed_league, list(scope), [period],
        {m: F.col(f"__{m}") for m in league_measures}, chunks=chunks,
    ).filter("__asked = 1").select(*scope, period, *league_measures)
    return _rate(join_null_safe(totals, league_totals, [*scope, period]),
                 [*scope, period, "club"], prior)


def ratings_by_snapshot(
    fixtures: DataFrame, requests: DataFrame, scope: Sequence[str], snapshot: str, period: str,
    home: str, away: str, home_score: str, away_score: str, prior: float = PRIOR_MATCHES,
) -> DataFrame:
    """Ratings where every snapshot carries its own copy of the results."""
    key = [*scope, snapshot]
    earlier = fixtures.filter(F.col(period) < F.col(snapshot))
    clubs, league = _results(earlier, key, period, home, away, home_score, away_score, None)
    clubs = clubs.groupBy(*key, "club").agg(
        *[F.sum(c).alias(c) for c in ("matches", "goals_for", "goals_against")])
    league = league.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in ("league_sides", "home_goals", "away_goals", "league_goals")])
    asked = requests.select(*key, "club").distinct()
    joined = join_null_safe(join_null_safe(asked, clubs, [*key, "club"]), league, key)
    return _rate(joined, [*key, "club"], prior)


def _rate(df: DataFrame, keys: Sequence[str], prior: float) -> DataFrame:
    columns = _rating_columns(prior)
    rated = df.withColumn("__rate", columns.pop("__rate"))
    return rated.select(
        *keys, F.coalesce(F.col("matches"), F.lit(0.0)).alias("matches"),
        *[c.alias(n) for n, c in columns.items()],
    )


def opponent_means(
    upcoming: DataFrame, ratings: DataFrame, scope: Sequence[str], snapshot: str, period: str,
    home: str, away: str, horizons: Sequence[int], weight: str | None = None,
) -> DataFrame:
    """Mean strength of the opponents ahead, per club, snapshot and horizon.

    Ratings are looked up per (snapshot, opponent) after fixtures were folded
    to one row per pairing, so the join is as small as the schedule. A club
    without fixtures in a horizon has NULL there.
    """
    horizons = validate_horizons(horizons)
    extra = [weight] if weight else []
    amount = F.col(weight) if weight else F.lit(1)
    pairs = sides(upcoming, [*scope, snapshot, period, *extra], home, away).groupBy(
        *scope, snapshot, period, "club", "opponent", "is_home"
    ).agg(F.sum(amount).cast("double").alias("__games"))
    rated = join_null_safe(
        pairs, ratings.withColumnRenamed("club", "opponent"), [*scope, snapshot, "opponent"]
    )
    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(1.0))

    attack, concede = known("attack_strength"), known("goals_conceded_strength")
    own = F.when(F.col("is_home"), known("home_factor")).otherwise(known("away_factor"))
    other = F.when(F.col("is_home"), known("away_factor")).otherwise(known("home_factor"))
    measures = dict(zip(OPPONENT_MEASURES, (attack, concede, concede * own, attack * other)))
    ahead = F.col(period) - F.col(snapshot)
    aggregates = []
    for h in horizons:
        games = F.when((ahead >= 0) & (ahead < h), F.col("__games"))
        for name, value in measures.items():
            aggregates.append(
                F.try_divide(F.sum(value * games), F.sum(games)).alias(f"upcoming_{name}_{h}")
            )
    return rated.groupBy(*scope, snapshot, "club").agg(*aggregates)


def attach_strength(
    rows: DataFrame, ratings: DataFrame, opposition: DataFrame, scope: Sequence[str],
    snapshot: str, club: str, horizons: Sequence[int],
) -> DataFrame:
    """Own strength and opposition next to entity rows.

    Unseen club: ratings 1.0 from 0 matches. No fixture in a horizon whose
    ``upcoming_fixture_count`` is 0: opposition 0. Count unknown: NULL.
    """
    key = [*scope, snapshot, club]
    own = ratings.select(
        *scope, snapshot, F.col("club").alias(club),
        F.col("attack_strength").alias("club_attack_strength"),
        F.col("goals_conceded_strength").alias("club_goals_conceded_strength"),
        F.col("matches").alias("club_strength_matches"),
    )
    out = join_null_safe(rows, own, key).withColumns({
        "club_attack_strength": F.coalesce("club_attack_strength", F.lit(1.0)),
        "club_goals_conceded_strength": F.coalesce("club_goals_conceded_strength", F.lit(1.0)),
        "club_strength_matches": F.coalesce("club_strength_matches", F.lit(0.0)),
    })
    out = join_null_safe(out, opposition.withColumnRenamed("club", club), key)
    zeroed = {}
    for h in validate_horizons(horizons):
        count = f"upcoming_fixture_count_{h}"
        if count in rows.columns:
            for name in OPPONENT_MEASURES:
                column = f"upcoming_{name}_{h}"
                zeroed[column] = F.when(F.col(count) == 0, F.lit(0.0)).otherwise(F.col(column))
    return out.withColumns(zeroed) if zeroed else out
