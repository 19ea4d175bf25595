"""Reference populations of legal squads, drawn and scored as Spark jobs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ticks
from tidemark.operators.conditioned import conditioned_subsets
from tidemark.operators.guards import ContractError
from tidemark.operators.joins import inner_with_suffix
from tidemark.operators.rules import SquadRules
from tidemark.operators.sampling import successive_draws
from tidemark.operators.squads import adjust_for_availability, best_lineup, legal_draws, project
from tidemark.session import checkpointed

# Strategies, smallest ownership, least share of budget to spend.
STRATEGIES = ("broad_legal", "human_like", "price_aware", "ownership_weighted")
OWNERSHIP_STEP = 0.1
SPEND_FLOOR = 0.85
MAX_ROUNDS = 5


def draw_weight(strategy: str):
    """Weight of a player under a strategy, as a column."""
    ownership = F.coalesce(F.col("ownership_percent").cast("double"), F.lit(0.0))
    price = F.greatest(F.coalesce(F.col("price").cast("double"), F.lit(0.0)), F.lit(0.1))
    return {
        "broad_legal": F.lit(1.0),
        "price_aware": price * price,
        "ownership_weighted": F.greatest(ownership, F.lit(0.0)) + 1.0,
        "human_like": F.greatest(ownership, F.lit(OWNERSHIP_STEP)),
    }[strategy]


def reference_population(
    players: DataFrame, predictions: DataFrame, rules: SquadRules, horizon: int,
    size: int = 1000, strategy: str = "human_like", seed: int = 2026,
    target_cost: float | None = None, budget_band: float = 1.0,
) -> DataFrame:
    """``size`` legal squads with their best line-up and projected components.

    Draws double until enough legal squads are found; the first ``size`` in draw
    order are kept, so the result depends on the seed alone.
    """
    if strategy not in STRATEGIES:
        raise ContractError(f"strategy must be one of {STRATEGIES}")
    if size < 1 or budget_band < 0 or (target_cost is not None and target_cost <= 0):
        raise ContractError("size and costs must be positive")
    total = f"predicted_points_{horizon}"
    pool = adjust_for_availability(
        inner_with_suffix(players, predictions, ["player_id"], "_prediction"),
        total, "predicted_points_1" if horizon > 1 else None)
    quotas = {p.position_id: p.squad_count for p in rules.positions}
    low, high = None, rules.budget
    if strategy == "human_like":
        high = min(rules.budget, target_cost or rules.budget)
        low = max(0.0, high - budget_band)
        pool = pool.withColumn("price", ticks(F.col("price")) / 10.0).filter(F.col("price") <= high)
    elif strategy == "price_aware":
        low = rules.budget * SPEND_FLOOR
    facts = pool.select("player_id", "position_id", "club_id", "price",
                        "availability_adjusted_points")
    attempts = max(2048, size * 8)
    for _ in range(MAX_ROUNDS):
        if strategy == "human_like":
            # Quotas and cost hold by construction; only the clubs' limit rejects.
            drawn = conditioned_subsets(
                pool, "position_id", "player_id", draw_weight(strategy), ticks(F.col("price")), quotas,
                math.ceil(low * 10 - 1e-9), math.floor(high * 10 + 1e-9), attempts, seed,
            ).withColumnRenamed("draw", "squad_id")
        else:
            drawn = successive_draws(pool, "position_id", "player_id", draw_weight(strategy),
                                     quotas, attempts, seed).withColumnRenamed("draw", "squad_id")
        members = drawn.join(facts.drop("position_id"), "player_id")
        whole = members.groupBy("squad_id").agg(F.count("*").alias("__n")).filter(
            F.col("__n") == rules.squad_size).select("squad_id")
        legal = legal_draws(members.join(whole, "squad_id", "left_semi"), rules, "squad_id",
                            "club_id", "price", low, high)
        chosen = legal.orderBy("squad_id").limit(size)
        if chosen.count() == size:
            break
        attempts *= 4
    else:
        raise ContractError("too few legal squads; check coverage, prices and the cost band")
    rows = checkpointed(members.join(chosen, "squad_id"))
    best = best_lineup(rows, rules, "squad_id", "player_id", "position_id",
                       "availability_adjusted_points").drop(
        "starting_xi_points", "bench_points", "captain_points")
    squads = best.join(rows.groupBy("squad_id").agg(
        F.sort_array(F.collect_list("player_id")).alias("player_ids"),
        F.max("total_cost").alias("total_cost")), "squad_id")
    scored = squads.join(project(squads, facts, rules, strict=False), "squad_id")
    return scored.withColumns({
        "horizon": F.lit(horizon), "strategy": F.lit(strategy), "seed": F.lit(seed),
        "target_cost": F.lit(high if strategy == "human_like" else None).cast("double"),
        "minimum_reference_cost": F.lit(low if strategy == "human_like" else None).cast("double"),
    })
