"""Prediction-time features and labels from stored snapshots and facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.coerce import lenient_double, lenient_long, strict_double, strict_long
from tidemark.operators.calendar import label_name
from tidemark.operators.guards import (
    require_columns,
    require_deadline,
    require_rows,
    require_unique,
    validate_horizons,
)
from tidemark.operators.snapshots import (
    attach_upcoming_counts,
    complete_horizon_labels,
    recent_form,
    upcoming_counts,
)
from tidemark.operators.strength import attach_strength, opponent_means, ratings_by_snapshot
from tidemark.operators.temporal import participation

SCOPE, PERIOD, ENTITY = ["season"], "snapshot_gameweek", ["player_id"]


def _facts(stats: DataFrame) -> DataFrame:
    require_columns(stats, ["season", "gameweek", "player_id", "total_points", "minutes"], "facts")
    require_unique(stats, ["season", "gameweek", "player_id"], "facts")
    out = stats.withColumns({
        "gameweek": strict_long("gameweek"), "player_id": strict_long("player_id"),
        "total_points": strict_double("total_points"), "minutes": strict_double("minutes"),
    })
    if "starts" in out.columns:
        out = out.withColumn("starts", lenient_double("starts"))
    appeared, started = participation("minutes", "starts" if "starts" in out.columns else None)
    return out.withColumns({"__appeared": appeared, "__started": started})


def prediction_table(
    snapshots: DataFrame, stats: DataFrame, fixtures: DataFrame | None = None,
    horizons: Sequence[int] = (1, 3, 5), window: int = 3,
) -> DataFrame:
    """Features known before each snapshot's deadline; facts may be empty."""
    horizons = validate_horizons(horizons)
    require_columns(snapshots, ["season", PERIOD, "snapshot_timestamp", "snapshot_deadline_time",
                                "player_id"], "snapshots")
    require_rows(snapshots, "snapshots")
    timed = snapshots.withColumns({
        c: F.col(c).cast("timestamp") for c in ("snapshot_timestamp", "snapshot_deadline_time")})
    timed = require_deadline(timed, "snapshot_timestamp", "snapshot_deadline_time",
                             ["season", PERIOD])
    rows = require_unique(timed, [*SCOPE, PERIOD, *ENTITY], "snapshots").withColumns({
        PERIOD: strict_long(PERIOD), "player_id": strict_long("player_id")})
    if fixtures is not None:
        require_columns(rows, ["club_id"], "snapshots")
        require_columns(fixtures, ["season", PERIOD, "gameweek_id", "home_club_id",
                                   "away_club_id"], "fixtures")
        games = fixtures.withColumns(
            {c: lenient_long(c) for c in (PERIOD, "gameweek_id", "home_club_id", "away_club_id")}
            | {c: (lenient_double(c) if c in fixtures.columns else F.lit(None).cast("double"))
               for c in ("team_h_score", "team_a_score")})
        ahead = games.filter(F.col("gameweek_id") >= F.col(PERIOD))
        counts = upcoming_counts(ahead, SCOPE, PERIOD, "gameweek_id", "home_club_id",
                                 "away_club_id", horizons)
        rows = attach_upcoming_counts(rows, counts, SCOPE, PERIOD, "club_id")
        asked = rows.select("season", PERIOD, F.col("club_id").alias("club"))
        for side in ("home_club_id", "away_club_id"):
            asked = asked.unionByName(games.select("season", PERIOD, F.col(side).alias("club")))
        ratings = ratings_by_snapshot(
            games, asked, SCOPE, PERIOD, "gameweek_id", "home_club_id", "away_club_id",
            "team_h_score", "team_a_score")
        opposition = opponent_means(ahead, ratings, SCOPE, PERIOD, "gameweek_id", "home_club_id",
                                    "away_club_id", horizons)
        rows = attach_strength(rows, ratings, opposition, SCOPE, PERIOD, "club_id", horizons)
    return recent_form(
        rows, _facts(stats), SCOPE, ENTITY, PERIOD, "gameweek", window,
        {f"recent_points_mean_{window}": "total_points",
         f"recent_minutes_mean_{window}": "minutes",
         f"recent_appearance_rate_{window}": "__appeared",
         f"recent_start_rate_{window}": "__started"},
        "recent_gameweeks_available")


def training_table(
    snapshots: DataFrame, stats: DataFrame, fixtures: DataFrame | None = None,
    horizons: Sequence[int] = (1, 3, 5), window: int = 3,
) -> DataFrame:
    """Prediction rows plus labels that stay NULL until their horizon is complete."""
    horizons = validate_horizons(horizons)
    require_rows(stats, "facts")
    rows = prediction_table(snapshots, stats, fixtures, horizons, window)
    labels = {h: {
        label_name(h): "total_points", label_name(h, "minutes"): "minutes",
        label_name(h, "appearances"): "__appeared", label_name(h, "starts"): "__started",
    } for h in horizons}
    return complete_horizon_labels(
        rows, _facts(stats), SCOPE, ENTITY, PERIOD, "gameweek", labels)
