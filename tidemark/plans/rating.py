"""Validate, project and rate a table of squads against a reference population."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import inner_with_suffix
from tidemark.operators.ratings import component_ratings
from tidemark.operators.rules import SquadRules
from tidemark.operators.squads import adjust_for_availability, project, squad_report

# Rated components and the projection column behind each.
COMPONENTS = {
    "goalkeeper": "gkp_points", "defence": "def_points", "midfield": "mid_points",
    "attack": "fwd_points", "bench": "bench_points", "captaincy": "captain_points",
    "overall": "overall_points",
}


def rate_squads(
    squads: DataFrame, players: DataFrame, predictions: DataFrame, rules: SquadRules,
    horizon: int, reference: DataFrame, squad_id: str = "squad_id",
) -> tuple[DataFrame, DataFrame]:
    """Rated legal squads, and the rejected ones with their errors."""
    report = squad_report(squads, players, rules, squad_id)
    legal = report.filter(F.size("errors") == 0)
    points = adjust_for_availability(
        inner_with_suffix(players, predictions, ["player_id"], "_prediction"),
        f"predicted_points_{horizon}", "predicted_points_1" if horizon > 1 else None)
    projected = project(legal, points, rules, squad_id)
    rated = component_ratings(projected, reference, COMPONENTS, squad_id)
    out = legal.drop("errors").join(projected, squad_id).join(rated, squad_id)
    return out, report.filter(F.size("errors") > 0)
