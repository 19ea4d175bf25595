"""Published choices of managers: validation, selection rates, formations, audit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import guarded_pearson
from tidemark.operators.joins import lookup
from tidemark.operators.ordered import chunk_count, exact_quantiles
from tidemark.session import checkpointed, plain_scan


def lineup_role(position, starters: int = 11):
    """Starter up to the last line-up place, bench beyond."""
    return F.when(position <= starters, F.lit("starter")).otherwise(F.lit("bench"))


def pick_violations(
    picks: DataFrame, manager: Sequence[str], known: DataFrame | None = None, size: int = 15
) -> DataFrame:
    """Managers whose picks break a rule, with all reasons.

    Rules: ``size`` picks, distinct players, places exactly 1..size, one captain
    and one vice-captain, and only known players. A manager that is NULL is no manager.

    Known players are hashed, so picks are not sorted to find theirs. Picks are then
    dealt by manager and player, and what is left of a manager in each part by manager,
    over as many partitions as :func:`chunk_count` gives: a task folds about as many
    rows however many there are, and a manager with many players is folded in all of
    them. Places are bits, so they need no pass of their own.
    """
    rows = picks.filter(reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in manager]))
    if not plain_scan(rows):
        rows = checkpointed(rows)
    parts = chunk_count(rows)
    if known is not None:
        rows = rows.join(known.select("player_id").distinct().withColumn("__known", F.lit(True))
                         .hint("shuffle_hash"), "player_id", "left")
    else:
        rows = rows.withColumn("__known", F.lit(True))
    words = [(first, min(first + 62, size)) for first in range(1, size + 1, 63)]
    dealt = [*manager, "__part"]
    folded = (
        rows.withColumn("__part", F.pmod(F.hash("player_id"), F.lit(parts)))
        .repartition(parts, *dealt).groupBy(*dealt, "player_id").agg(
            F.count("*").alias("n"),
            F.min("squad_position").alias("low"), F.max("squad_position").alias("high"),
            F.sum(F.col("is_captain").cast("int")).alias("captains"),
            F.sum(F.col("is_vice_captain").cast("int")).alias("vices"),
            F.count_if(F.col("__known").isNull()).alias("unknown"),
            *[F.expr(f"bit_or(CASE WHEN squad_position BETWEEN {low} AND {high} "
                     f"THEN shiftleft(1L, CAST(squad_position - {low} AS INT)) END)").alias(f"word_{low}")
              for low, high in words])
        .withColumn("players", F.col("player_id").isNotNull().cast("bigint")))

    def combined(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return df.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in ("n", "players", "captains", "vices", "unknown")],
            F.min("low").alias("low"), F.max("high").alias("high"),
            *[F.bit_or(f"word_{low}").alias(f"word_{low}") for low, _ in words])

    folded = combined(combined(folded, dealt).repartition(parts, *manager), manager)
    places = reduce(lambda a, b: a + b, [F.coalesce(F.bit_count(f"word_{low}"), F.lit(0)) for low, _ in words])
    folded = folded.withColumn("places", places)
    reasons = F.array_compact(F.array(
        F.when(F.col("n") != size, F.lit("wrong number of picks")),
        F.when(F.col("players") != F.col("n"), F.lit("repeated players")),
        F.when((F.col("low") != 1) | (F.col("high") != size) | (F.col("places") != size),
               F.lit("places are not 1 to the squad size")),
        F.when(F.coalesce("captains", F.lit(0)) != 1, F.lit("needs one captain")),
        F.when(F.coalesce("vices", F.lit(0)) != 1, F.lit("needs one vice-captain")),
        F.when(F.col("unknown") > 0, F.lit("unknown players")),
    ))
    return folded.select(*manager, reasons.alias("reasons")).filter(F.size("reasons") > 0)


def enrich_picks(picks: DataFrame, players: DataFrame) -> DataFrame:
    """Add club, position, price and population rate; every pick must match."""
    return lookup(picks, players, ["player_id"], strict=True, unique=True)


def selection_rates(
    picks: DataFrame, item: str, manager: str, starter, captain, vice,
) -> DataFrame:
    """How often each item is chosen, started and captained, in percent of managers."""
    total = picks.agg(F.count_distinct(manager).alias("__n"))
    counts = picks.groupBy(item).agg(
        F.count_distinct(manager).alias("selection_count"),
        F.count_if(starter).alias("starter_count"),
        F.count_if(captain).alias("captain_count"),
        F.count_if(vice).alias("vice_captain_count"),
    )
    rates = {
        f"sample_{label}_percent": 100.0 * F.col(f"{count}_count") / F.col("__n")
        for label, count in (("ownership", "selection"), ("starter", "starter"),
                             ("captain", "captain"), ("vice_captain", "vice_captain"))
    }
    return counts.join(F.broadcast(total)).withColumns(rates).drop("__n")


def formations(
    picks: DataFrame, manager: str, group: str, order: Sequence[str], counted,
) -> DataFrame:
    """Counts per group joined with dashes, e.g. ``4-4-2``.

    The groups are given, so this is one conditional aggregation.
    """
    return picks.groupBy(manager).agg(F.concat_ws("-", *[
        F.count_if(counted & (F.col(group) == F.lit(value))).cast("string") for value in order
    ]).alias("formation"))


def squad_costs(picks: DataFrame, manager: str, price: str) -> DataFrame:
    return picks.groupBy(manager).agg(F.sum(price).alias("squad_cost"))


def sample_audit(
    rates: DataFrame, population: str, sample: str = "sample_ownership_percent"
) -> DataFrame:
    """Agreement of sample rates with the population's rates."""
    return rates.filter(F.col(population).isNotNull()).agg(
        F.count("*").alias("items"),
        guarded_pearson(F.col(population).cast("double"), F.col(sample)).alias("pearson_correlation"),
        F.avg(F.abs(F.col(population) - F.col(sample))).alias("mean_absolute_error"),
    )


def cost_summary(costs: DataFrame, cost: str, chunks: int | None = None) -> DataFrame:
    """Minimum, median and maximum, exact."""
    return exact_quantiles(
        costs, [], cost, {"minimum": 0.0, "median": 0.5, "maximum": 1.0}, chunks)


def manager_audit(
    picks: DataFrame, manager: str, item: str, group: str, order: Sequence[str], counted,
    price: str, rates: DataFrame, population: str, chunks: int | None = None,
) -> DataFrame:
    """What a sample of managers holds, in one row.

    Numbers of managers, picks and different items; a histogram of formations (a map,
    as long as there are formations); the least, median and largest squad cost; and
    the agreement of :func:`selection_rates` with the population's rates. Managers are
    folded to a formation and a cost each before anything is compared; the parts are
    one row each.
    """
    shape = picks.groupBy(manager).agg(
        F.concat_ws("-", *[F.count_if(counted & (F.col(group) == F.lit(v))).cast("string") for v in order]).alias("formation"),
        F.sum(price).alias("__cost"))
    histogram = shape.groupBy("formation").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("formation", "n")))).alias("formations"))
    sizes = picks.agg(F.count_distinct(manager).alias("managers"), F.count("*").alias("picks"),
                      F.count_distinct(item).alias("unique_items"))
    costs = cost_summary(shape, "__cost", chunks).withColumnsRenamed(
        {n: f"cost_{n}" for n in ("minimum", "median", "maximum")})
    out = sizes
    for part in (histogram, costs, sample_audit(rates, population)):
        # Left, as an empty sample has no cost at all.
        out = out.join(F.broadcast(part), how="left")
    return out
