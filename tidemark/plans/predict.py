"""Batch scoring of a snapshot with one column per model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clip
from tidemark.ml.features import ModelInputs, prepare
from tidemark.operators.guards import ContractError
from tidemark.operators.joins import newest_identity, rows_of
from tidemark.operators.reconcile import reconcile_lineups

IDENTITY = ("season", "snapshot_gameweek", "snapshot_timestamp", "player_id", "display_name")
# Output column of each target kind, and the most minutes per period.
OUTPUT = {
    "points": "predicted_points", "minutes": "predicted_minutes",
    "appearances": "appearance_probability", "starts": "start_probability",
}
MINUTES_PER_PERIOD = 90.0


def score(
    rows: DataFrame, models: Mapping[tuple[str, int], tuple[PipelineModel, ModelInputs]],
    keep: tuple[str, ...] = ("club_id", "position_short_name"),
) -> DataFrame:
    """Add a column per (target kind, horizon), bounded to what is possible.

    Each model adds its column to the same rows, so scoring is one pass with no
    join. Minutes stay within 0..90 per period, probabilities within 0..1, and a
    start is never likelier than an appearance.
    """
    if not models:
        raise ContractError("no model to score with")
    lead = [c for c in (*IDENTITY, *keep) if c in rows.columns]
    out, made = rows, []
    for (kind, horizon), (model, schema) in models.items():
        name = f"{OUTPUT[kind]}_{horizon}"
        inputs = prepare(out, schema, prefix="__x_")
        scored = model.transform(inputs)
        value = F.col("prediction")
        if kind == "minutes":
            value = clip(value, 0.0, MINUTES_PER_PERIOD * horizon)
        elif kind in ("appearances", "starts"):
            value = clip(value, 0.0, 1.0)
        out = scored.withColumn(name, value).select(*[c for c in out.columns if c != name], name)
        made.append(name)
    if {"appearance_probability_1", "start_probability_1"} <= set(made):
        out = out.withColumn(
            "start_probability_1", F.least("start_probability_1", "appearance_probability_1"))
    return out.select(*lead, *made)


def predict_newest(
    snapshots: DataFrame, features, models, filters: Mapping[str, object] | None = None,
) -> DataFrame:
    """Score the newest snapshot that passes the filters and reconcile line-ups.

    ``features`` turns the snapshot's rows into model inputs.
    """
    identity = newest_identity(
        snapshots, ["season", "snapshot_gameweek", "snapshot_timestamp"], "snapshot_timestamp",
        filters)
    scored = score(features(rows_of(snapshots, identity)), models)
    if {"appearance_probability_1", "start_probability_1"} <= set(scored.columns):
        scored = reconcile_lineups(scored, ["club_id"], "position_short_name",
                                   "start_probability_1", "appearance_probability_1")
    return scored
