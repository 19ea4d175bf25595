"""Saved JSON payloads to linked tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.coerce import lenient_double, lenient_long, strict_double, strict_long
from tidemark.operators.guards import (
    ContractError,
    require_columns,
    require_fields,
    require_no_rows,
    require_rows,
    require_unique,
)
from tidemark.operators.joins import lookup
from tidemark.operators.managers import lineup_role, pick_violations

# Field names of the payloads, their column names and order.
PLAYER_RENAMES = {
    "id": "player_id", "code": "player_code", "second_name": "surname",
    "web_name": "display_name", "team": "club_id", "element_type": "position_id",
    "now_cost": "price", "photo": "photo_reference", "selected_by_percent": "ownership_percent",
}
PLAYER_FIELDS = (
    "id", "code", "first_name", "second_name", "web_name", "team", "element_type", "now_cost",
)
PLAYER_FRONT = (
    "player_id", "player_code", "first_name", "surname", "full_name", "display_name", "club_id",
    "club_name", "club_short_name", "position_id", "position", "position_short_name", "price",
    "photo_reference", "photo_url", "ownership_percent", "status", "chance_of_playing_next_round",
    "chance_of_playing_this_round", "news", "news_added",
)
PHOTO_URL = (
    "https://resources.premierleague.com/premierleague/photos/players/110x140/p%s.png"
)
FIXTURE_RENAMES = {
    "id": "fixture_id", "event": "gameweek_id", "team_h": "home_club_id", "team_a": "away_club_id",
}
FIXTURE_FRONT = (
    "fixture_id", "gameweek_id", "kickoff_time", "home_club_id", "home_club_name", "away_club_id",
    "away_club_name",
)
SNAPSHOT_IDENTITY = (
    "season", "snapshot_gameweek", "snapshot_timestamp", "snapshot_deadline_time",
)


def read_payload(spark: SparkSession, path: str | Sequence[str],
                 schema: T.StructType | None = None) -> DataFrame:
    """One row per payload file. Give a schema for large stores."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def records(payload: DataFrame, array: str, keep: Sequence[str] = ()) -> DataFrame:
    """The objects of a top-level array as rows."""
    require_columns(payload, [array], "payload")
    kind = payload.schema[array].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        raise ContractError(f"payload field {array} is not a list of objects")
    return payload.select(*keep, F.inline(array))


def rename_and_order(df: DataFrame, renames: Mapping[str, str], front: Sequence[str]) -> DataFrame:
    """Rename, put known columns first and keep every other one after them."""
    renamed = df.withColumnsRenamed(dict(renames))
    lead = [c for c in front if c in renamed.columns]
    return renamed.select(*lead, *[c for c in renamed.columns if c not in lead])


def _dimension(df: DataFrame, label: str, renames: Mapping[str, str], key: str) -> DataFrame:
    require_fields(df, list(renames), label)
    return rename_and_order(df, renames, list(renames.values())).withColumn(key, strict_long(key))


def clubs(df: DataFrame) -> DataFrame:
    return _dimension(df, "club", {
        "id": "club_id", "name": "club_name", "short_name": "club_short_name"}, "club_id")


def positions(df: DataFrame) -> DataFrame:
    return _dimension(df, "position", {
        "id": "position_id", "singular_name": "position",
        "singular_name_short": "position_short_name"}, "position_id")


def gameweeks(df: DataFrame) -> DataFrame:
    return _dimension(df, "gameweek", {"id": "gameweek_id", "name": "gameweek_name"},
                      "gameweek_id")


def players(df: DataFrame, club_table: DataFrame, position_table: DataFrame) -> DataFrame:
    """Players with readable names, prices in units, and every other field kept."""
    require_fields(df, [f for f in PLAYER_FIELDS if f != "web_name"], "player")
    require_columns(df, ["web_name"], "player")
    out = df.withColumnsRenamed(PLAYER_RENAMES).withColumns(
        {c: strict_long(c) for c in ("player_id", "player_code", "club_id", "position_id")})
    out = lookup(out, club_table.select("club_id", "club_name", "club_short_name"), ["club_id"])
    out = lookup(out, position_table.select("position_id", "position", "position_short_name"),
                 ["position_id"])
    full = F.trim(F.concat_ws(" ", F.trim("first_name"), F.trim("surname")))
    columns = {
        "full_name": full,
        "display_name": F.coalesce(F.col("display_name"), full),
        "price": strict_double("price") / 10.0,
        "photo_url": F.format_string(PHOTO_URL, F.col("player_code").cast("string")),
    }
    if "ownership_percent" in out.columns:
        columns["ownership_percent"] = lenient_double("ownership_percent")
    return rename_and_order(out.withColumns(columns), {}, PLAYER_FRONT)


def fixtures(df: DataFrame, club_table: DataFrame) -> DataFrame:
    """Fixtures with club names; the gameweek of an unscheduled one is NULL."""
    require_fields(df, ["id", "team_h", "team_a"], "fixture")
    out = df.withColumnsRenamed(FIXTURE_RENAMES).withColumns(
        {c: strict_long(c) for c in ("fixture_id", "home_club_id", "away_club_id")})
    if "gameweek_id" in out.columns:
        out = out.withColumn("gameweek_id", lenient_long("gameweek_id"))
    for side in ("home", "away"):
        named = club_table.select(F.col("club_id").alias(f"{side}_club_id"),
                                  F.col("club_name").alias(f"{side}_club_name"))
        out = lookup(out, named, [f"{side}_club_id"])
    return rename_and_order(out, {}, FIXTURE_FRONT)


def stamp_snapshot(df: DataFrame, season: str, gameweek: int, collected: datetime,
                   deadline: datetime) -> DataFrame:
    """Put the snapshot identity in front of a table; late snapshots are refused."""
    if not season.strip() or gameweek <= 0:
        raise ContractError("a snapshot needs a season and a positive gameweek")
    if collected.tzinfo is None or deadline.tzinfo is None:
        raise ContractError("snapshot times need a time zone")
    if collected > deadline:
        raise ContractError("collected after the deadline: not prediction-time data")
    values = (season, gameweek, collected, deadline)
    return df.select(*[F.lit(v).alias(n) for n, v in zip(SNAPSHOT_IDENTITY, values)], "*")


def deadline_of(events: DataFrame, gameweek: int) -> datetime:
    """Deadline of one gameweek (ISO-8601 text) from the payload's events."""
    row = events.filter(F.col("id") == gameweek).select(
        F.try_to_timestamp(F.col("deadline_time")).alias("t")).first()
    if row is None or row["t"] is None:
        raise ContractError(f"gameweek {gameweek} has no valid deadline")
    from datetime import timezone
    return row["t"].astimezone(timezone.utc)


def finished_periods(events: DataFrame, through: int | None = None) -> DataFrame:
    """Ids of gameweeks the payload marks finished, up to ``through``."""
    done = events.filter(F.col("finished")).select(F.col("id").cast("bigint").alias("gameweek"))
    if through is not None:
        done = done.filter(F.col("gameweek") <= through)
        require_rows(done.filter(F.col("gameweek") == through), f"finished gameweek {through}")
    return require_rows(done, "finished gameweeks")


def live_stats(payload: DataFrame, season: str, ingested_at: str,
               gameweek: int | None = None) -> DataFrame:
    """One row per player of each live payload, its stats promoted to columns.

    Without ``gameweek`` the period is read from the file name
    (``gameweek-07.json``), so a season's files are one scan.
    """
    number = F.lit(gameweek) if gameweek is not None else F.regexp_extract(
        F.col("_metadata.file_path"), r"gameweek-(\d+)", 1)
    rows = payload.select(number.cast("bigint").alias("gameweek"),
                          F.explode("elements").alias("e"))
    require_rows(rows, "live gameweek")
    bad = rows.filter(F.col("e.id").isNull() | F.col("e.stats").isNull())
    require_no_rows(bad.select("gameweek"), "live elements without an id or stats")
    stats = [f.name for f in payload.schema["elements"].dataType.elementType["stats"].dataType]
    extra = [f.name for f in payload.schema["elements"].dataType.elementType
             if f.name == "explain"]
    out = rows.select(
        F.lit(season).alias("season"), "gameweek", strict_long("e.id").alias("player_id"),
        F.lit(ingested_at).alias("ingested_at"), *[F.col(f"e.stats.{s}").alias(s) for s in stats],
        *[F.col(f"e.{x}").alias(x) for x in extra],
    )
    return require_unique(out, ["season", "gameweek", "player_id"], "live stats")


def manager_picks(payload: DataFrame, manager_id, season: str, gameweek: int,
                  collected_at: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Picks and one row per manager. ``manager_id`` is a column of the payload.

    Picks that break a rule (with ``known``, also picks of unknown players) fail. History fields are added to the manager row but never replace its identity.
    """
    identity = [
        manager_id.alias("manager_id"), F.lit(season).alias("season"),
        F.lit(gameweek).alias("gameweek"), F.lit(collected_at).alias("collected_at"),
    ]
    rows = payload.select(*identity, F.explode("picks").alias("p")).select(
        "manager_id", "season", "gameweek", "collected_at",
        strict_long("p.element").alias("player_id"),
        strict_long("p.position").alias("squad_position"),
        strict_long("p.multiplier").alias("multiplier"),
        F.col("p.is_captain").alias("is_captain"),
        F.col("p.is_vice_captain").alias("is_vice_captain"),
    ).withColumn("lineup_role", lineup_role(F.col("squad_position")))
    require_no_rows(pick_violations(rows, ["manager_id"], known), "picks break the rules")
    taken = {"manager_id", "season", "gameweek", "collected_at", "active_chip"}
    history = [f.name for f in payload.schema["entry_history"].dataType if f.name not in taken]
    managers = payload.select(
        *identity, "active_chip", *[F.col(f"entry_history.{h}").alias(h) for h in history])
    return rows, managers
