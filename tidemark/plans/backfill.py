"""Training rows rebuilt from an archive of match rows, all seasons in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.coerce import lenient_double, strict_boolean
from tidemark.operators.calendar import blank_periods, calendar_windows, label_name
from tidemark.operators.guards import require_no_rows, require_unique, validate_horizons
from tidemark.operators.joins import lookup
from tidemark.operators.snapshots import schedule_by_snapshot
from tidemark.operators.strength import (
    PRIOR_MATCHES,
    attach_strength,
    opponent_means,
    ratings_before,
)
from tidemark.operators.temporal import (
    fill_period_start,
    inconsistent_identity,
    lag_or_own,
    participation,
    past_cumulative,
    period_rollup,
)
from tidemark.session import checkpointed

# Match statistics that are summed per gameweek.
SUM_STATS = (
    "total_points", "minutes", "starts", "goals_scored", "assists", "clean_sheets",
    "goals_conceded", "own_goals", "penalties_saved", "penalties_missed", "yellow_cards",
    "red_cards", "saves", "bonus", "bps", "influence", "creativity", "threat", "ict_index",
    "expected_goals", "expected_assists", "expected_goal_involvements",
    "expected_goals_conceded",
)
KEY = ["season", "snapshot_gameweek", "player_id"]


def player_gameweeks(matches: DataFrame, fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Match rows rolled up to one row per season, player and gameweek."""
    stats = [c for c in SUM_STATS if c in matches.columns]
    raw = matches.withColumns({
        "element": F.col("element").try_cast("bigint"),
        "round": F.col("round").try_cast("bigint"),
        "fixture": F.col("fixture").try_cast("bigint"),
        "value": lenient_double("value"),
        "kickoff_time": F.try_to_timestamp(F.col("kickoff_time").cast("string")),
        "was_home": strict_boolean("was_home"),
        **{c: lenient_double(c) for c in stats},
    })
    # The archive is read once: guards and the roll-up start from what is written here.
    raw = checkpointed(fill_period_start(raw, ["season"], "round", "kickoff_time"))
    require_no_rows(raw.filter("element IS NULL OR round IS NULL").select("season", "name"),
                    "match rows without a player or gameweek")
    require_no_rows(
        inconsistent_identity(raw, ["season", "element", "round"], ["name", "position", "team"]),
        "identity differs within a player gameweek")
    rolled = period_rollup(
        raw, ["season", "element", "round"],
        first={"display_name": "name", "position_short_name": "position", "club_name": "team",
               "archived_price_tenths": "value"},
        order=["kickoff_time", "fixture"],
        earliest={"first_kickoff": "kickoff_time", "snapshot_timestamp": "period_start"},
        distinct={"fixture_count": "fixture"}, flags={"home_fixture_count": "was_home"},
        sums={f"gameweek_{c}": c for c in stats},
    )
    clubs = teams.select(
        "season", F.col("name").alias("club_name"), F.col("id").cast("bigint").alias("club_id"))
    named = lookup(checkpointed(rolled), clubs, ["season", "club_name"])
    return named.withColumnsRenamed({"element": "player_id", "round": "snapshot_gameweek"}).withColumn(
        "away_fixture_count", F.col("fixture_count") - F.col("home_fixture_count"))


def archive_blanks(matches: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Gameweeks of a season that have neither match rows nor scheduled fixtures."""
    observed = matches.select(
        "season", F.col("round").try_cast("bigint").alias("snapshot_gameweek"))
    planned = fixtures.select("season", F.col("event").try_cast("bigint").alias("snapshot_gameweek"))
    return blank_periods(observed.filter("snapshot_gameweek IS NOT NULL"), ["season"],
                         "snapshot_gameweek", planned)


def historical_training(
    matches: DataFrame, fixtures: DataFrame, teams: DataFrame,
    horizons: Sequence[int] = (1, 3, 5), window: int = 3, prior: float = PRIOR_MATCHES,
) -> DataFrame:
    """Past-only features and future labels for every archived player gameweek."""
    horizons = validate_horizons(horizons)
    validate_horizons([window])
    rows = player_gameweeks(matches, fixtures, teams)
    stats = [c for c in SUM_STATS if f"gameweek_{c}" in rows.columns]
    starts = "gameweek_starts" if "gameweek_starts" in rows.columns else None
    appeared, started = participation("gameweek_minutes", starts)
    rows = rows.withColumns({"__appeared": appeared, "__started": started})
    entity, period = ["season", "player_id"], "snapshot_gameweek"
    rows = past_cumulative(rows, entity, [period], {c: f"gameweek_{c}" for c in stats})
    rows = lag_or_own(rows, entity, [period], "archived_price_tenths", "__price")
    rows = rows.withColumn("price", F.col("__price") / 10.0).drop("__price")
    values = {"points": "gameweek_total_points", "minutes": "gameweek_minutes",
              "appearances": "__appeared", "starts": "__started"}
    past = {window: {
        f"recent_points_mean_{window}": values["points"],
        f"recent_minutes_mean_{window}": values["minutes"],
        f"recent_appearance_rate_{window}": values["appearances"],
        f"recent_start_rate_{window}": values["starts"],
    }}
    future = {h: {
        f"upcoming_fixture_count_{h}": "fixture_count",
        f"upcoming_home_fixture_count_{h}": "home_fixture_count",
        f"upcoming_away_fixture_count_{h}": "away_fixture_count",
        **{label_name(h, target): column for target, column in values.items()},
    } for h in horizons}
    rows = calendar_windows(
        rows, ["season"], ["player_id"], period, past, future,
        known={window: "recent_gameweeks_available"}, blanks=archive_blanks(matches, fixtures))
    played = fixtures.select(
        "season", F.col("event").try_cast("bigint").alias(period),
        F.col("team_h").try_cast("bigint").alias("home_club_id"),
        F.col("team_a").try_cast("bigint").alias("away_club_id"),
        *[(lenient_double(c) if c in fixtures.columns else F.lit(None).cast("double")).alias(c)
          for c in ("team_h_score", "team_a_score")],
    ).filter(F.col(period).isNotNull())
    ahead = schedule_by_snapshot(
        played.withColumnRenamed(period, "__at"), ["season"], "__at", period, max(horizons),
        ["home_club_id", "away_club_id"])
    asked = rows.select("season", period, F.col("club_id").alias("club")).unionByName(
        ahead.select("season", period, F.col("home_club_id").alias("club"))).unionByName(
        ahead.select("season", period, F.col("away_club_id").alias("club")))
    ratings = ratings_before(
        played, asked, ["season"], period, "home_club_id", "away_club_id", "team_h_score",
        "team_a_score", prior)
    opposition = opponent_means(
        ahead, ratings, ["season"], period, "__at", "home_club_id", "away_club_id", horizons)
    rows = attach_strength(rows, ratings, opposition, ["season"], period, "club_id", horizons)
    return require_unique(checkpointed(rows.drop("__appeared", "__started")), KEY, "training rows")


def gameweek_facts(training: DataFrame) -> DataFrame:
    """The per-gameweek facts of the training rows, without features and labels."""
    identity = ["season", "snapshot_gameweek", "player_id", "display_name",
                "position_short_name", "club_name"]
    facts = [c for c in training.columns if c.startswith("gameweek_")]
    return training.select(*identity, *facts).withColumnRenamed("snapshot_gameweek", "gameweek")
