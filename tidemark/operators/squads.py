"""Legality, projection and best line-up of constrained groups ("squads").

Squads are rows with id arrays; work on their members explodes the arrays,
joins players by id and folds back per squad. What is gathered per squad is
bounded by the array it came from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.guards import ContractError, require_no_rows
from tidemark.operators.ordered import exact_quantiles
from tidemark.operators.rules import SquadRules

PLAYER_COLUMNS = ("player_id", "club_id", "position_id", "price")


def member_rows(squads: DataFrame, squad_id: str, ids: str = "player_ids") -> DataFrame:
    """One row per squad and distinct member, with its place in the line-up."""
    row = squads.select(
        squad_id, "starting_xi", "bench", "captain", "vice_captain",
        F.explode(F.array_distinct(ids)).alias("player_id"),
    )
    return row.select(
        squad_id, "player_id",
        F.array_position("starting_xi", F.col("player_id")).alias("xi_place"),
        F.array_position("bench", F.col("player_id")).alias("bench_place"),
        (F.col("player_id") == F.col("captain")).alias("is_captain"),
        (F.col("player_id") == F.col("vice_captain")).alias("is_vice_captain"),
    )


def squad_report(
    squads: DataFrame, players: DataFrame, rules: SquadRules, squad_id: str = "squad_id",
    enforce_budget: bool = True,
) -> DataFrame:
    """All rule violations, total cost, budget limit and formation per squad.

    Violations of structure (sizes, repeats, captaincy, unknown members) are
    reported on their own; quotas, clubs, starters, bench keeper and budget are
    judged only for squads of sound structure. Legal squads have no errors.
    """
    def wrong_size(column: str, expected: int, label: str) -> Column:
        return F.when(F.size(column) != expected,
                      F.concat(F.lit(f"{label} needs {expected} members, has "),
                               F.size(column).cast("string")))

    def repeats(column: str, label: str) -> Column:
        return F.when(F.size(F.array_distinct(column)) != F.size(column),
                      F.lit(f"{label} repeats a member"))

    bench_size = rules.squad_size - rules.starting_size
    parts = [("player_ids", rules.squad_size, "squad"),
             ("starting_xi", rules.starting_size, "starting line-up"),
             ("bench", bench_size, "bench")]
    structure = [e for c, n, label in parts for e in (wrong_size(c, n, label), repeats(c, label))]
    lined = F.array_union("starting_xi", "bench")
    structure += [
        F.when(F.arrays_overlap("starting_xi", "bench"),
               F.lit("starting line-up and bench overlap")),
        F.when((F.size(F.array_except(lined, "player_ids")) > 0)
               | (F.size(F.array_except("player_ids", lined)) > 0),
               F.lit("starting line-up and bench do not cover the squad")),
        F.when(F.col("captain") == F.col("vice_captain"),
               F.lit("captain and vice-captain are the same")),
        F.when(~F.array_contains("starting_xi", F.col("captain")),
               F.lit("captain does not start")),
        F.when(~F.array_contains("starting_xi", F.col("vice_captain")),
               F.lit("vice-captain does not start")),
    ]
    if "active_chip" in squads.columns:
        structure.append(F.when(F.col("active_chip").isNotNull(), F.lit("chips are not supported")))
    # Of repeated ids the first in the order of all values counts.
    facts = [c for c in PLAYER_COLUMNS if c != "player_id"]
    known = players.groupBy("player_id").agg(F.min(F.struct(*facts)).alias("__f")).select("player_id", "__f.*")
    found = (
        member_rows(squads, squad_id)
        .join(known.withColumn("__known", F.lit(True)), "player_id", "left")
        .groupBy(squad_id)
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("__known").isNull(), F.col("player_id"))))
            .alias("__stale"),
            F.collect_list("club_id").alias("__clubs"),
            F.sum(F.col("price").cast("double")).alias("total_cost"),
            F.count_if(F.col("price").isNull() & F.col("__known")).alias("__unpriced"),
            *[F.count_if(F.col("position_id") == F.lit(p.position_id)).alias(f"__squad_{i}")
              for i, p in enumerate(rules.positions)],
            *[F.count_if((F.col("position_id") == F.lit(p.position_id)) & (F.col("xi_place") > 0))
              .alias(f"__xi_{i}") for i, p in enumerate(rules.positions)],
            F.count_if(F.col("position_id").isin(*rules.keepers) & (F.col("bench_place") > 0))
            .alias("__bench_keepers"),
        )
    )
    joined = squads.join(found, squad_id, "left")
    structure.append(F.when(F.size("__stale") > 0, F.concat(
        F.lit("unknown members "), F.array_join(F.col("__stale").cast("array<string>"), ","))))
    legal = []
    for i, p in enumerate(rules.positions):
        legal.append(F.when(F.col(f"__squad_{i}") != p.squad_count, F.concat(
            F.lit(f"{p.short_name} needs {p.squad_count} members, has "),
            F.col(f"__squad_{i}").cast("string"))))
    crowded = F.array_sort(F.filter(
        F.array_distinct("__clubs"),
        lambda club: F.size(F.filter("__clubs", lambda c: c == club)) > rules.max_per_club))
    legal.append(F.when(F.size(crowded) > 0, F.concat(
        F.lit(f"more than {rules.max_per_club} members of clubs "),
        F.array_join(crowded.cast("array<string>"), ","))))
    for i, p in enumerate(rules.positions):
        legal.append(F.when(
            ~F.col(f"__xi_{i}").between(p.minimum_starters, p.maximum_starters), F.concat(
                F.lit(f"{p.short_name} starters must number {p.minimum_starters} to "
                      f"{p.maximum_starters}, are "), F.col(f"__xi_{i}").cast("string"))))
    if rules.keepers:
        legal.append(F.when(F.col("__bench_keepers") != 1, F.lit("bench needs exactly one keeper")))
    legal.append(F.when(F.col("__unpriced") > 0, F.lit("members without a price")))
    limit = F.lit(float(rules.budget))
    if "budget_limit" in squads.columns:
        limit = F.least(F.coalesce(F.col("budget_limit").cast("double"), limit), limit)
    if enforce_budget:
        legal.append(F.when((F.col("__unpriced") == 0) & (F.col("total_cost") > limit + 1e-9),
                            F.lit("squad is over budget")))
    outfield = [f"__xi_{i}" for i, p in enumerate(rules.positions)
                if p.position_id not in rules.keepers]
    first = F.array_compact(F.array(*structure))
    errors = F.when(F.size(first) > 0, first).otherwise(F.array_compact(F.array(*legal)))
    return joined.select(
        *squads.columns, errors.alias("errors"),
        F.when(F.col("__unpriced") == 0, F.col("total_cost")).alias("total_cost"),
        limit.alias("budget_cap"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in outfield]).alias("formation"),
    )


def adjust_for_availability(
    df: DataFrame, total: str, first: str | None, name: str = "availability_adjusted_points",
    strict: bool = True,
) -> DataFrame:
    """Discount the first period of a projection by the chance of playing.

    The chance is this round's, else next round's percentage; without one,
    status ``a`` counts as certain and any other status keeps the raw value and
    a warning. Later periods are never discounted.
    """
    chances = [F.col(c).cast("double") for c in
               ("chance_of_playing_this_round", "chance_of_playing_next_round") if c in df.columns]
    chance = F.coalesce(*chances) if chances else F.lit(None).cast("double")
    if strict:
        bad = df.filter(chance.isNotNull() & ~chance.between(0.0, 100.0))
        require_no_rows(bad.select("player_id"), "availability outside 0-100")
        numbers = [F.col(c) for c in (total, first) if c]
        holes = df.filter(F.greatest(*[n.isNull().cast("int") for n in numbers], F.lit(0)) > 0)
        require_no_rows(holes.select("player_id"), "projections are missing")
    fit = F.coalesce(F.lower(F.col("status")) == "a", F.lit(False))
    factor = F.coalesce(chance / 100.0, F.lit(1.0))
    opening = F.col(first) if first else F.col(total)
    return df.withColumns({
        "availability_factor": factor,
        name: F.col(total) - opening * (1.0 - factor),
        "availability_warning": F.when(chance.isNull() & ~fit, F.lit("no estimate, raw value kept"))
        .when(factor < 1.0, F.lit("first period adjusted")),
    })


def project(
    squads: DataFrame, points: DataFrame, rules: SquadRules, squad_id: str = "squad_id",
    value: str = "availability_adjusted_points", strict: bool = True,
) -> DataFrame:
    """Points per position of the starters, bench, captain, line-up and overall.

    ``points`` has ``player_id, position_id`` and the value column. The captain
    counts a second time in ``overall_points``.
    """
    members = member_rows(squads, squad_id).join(
        points.select("player_id", "position_id", value), "player_id", "left")
    if strict:
        require_no_rows(members.filter(F.col(value).isNull()).select(squad_id, "player_id"),
                        "members without a projection")
    starts, benched = F.col("xi_place") > 0, F.col("bench_place") > 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0.0))

    return members.groupBy(squad_id).agg(
        *[total(starts & (F.col("position_id") == F.lit(p.position_id)))
          .alias(f"{p.short_name.lower()}_points") for p in rules.positions],
        total(benched).alias("bench_points"),
        total(F.col("is_captain")).alias("captain_points"),
        total(starts).alias("starting_xi_points"),
        (total(starts) + total(F.col("is_captain"))).alias("overall_points"),
    )


def member_details(
    squads: DataFrame, players: DataFrame, squad_id: str = "squad_id",
    minutes: str | None = None, first_minutes: str | None = None,
) -> DataFrame:
    """Members in line-up order with role, captaincy and adjusted minutes."""
    rows = member_rows(squads, squad_id).join(players, "player_id", "left")
    starts = F.col("xi_place") > 0
    out = rows.withColumns({
        "lineup_role": F.when(starts, F.lit("starter")).otherwise(F.lit("bench")),
        "lineup_order": F.when(starts, F.col("xi_place")).otherwise(F.col("bench_place") + 1000),
    })
    if minutes:
        opening = F.col(first_minutes or minutes)
        out = out.withColumn(
            "availability_adjusted_minutes",
            F.col(minutes) - opening * (1.0 - F.col("availability_factor")))
    return out.drop("xi_place", "bench_place")


def _ranked(members: Column, position: int | str) -> Column:
    """Members of a position, most points first, lower id on ties."""
    return F.array_sort(F.transform(
        F.filter(members, lambda m: m["position"] == F.lit(position)),
        lambda m: F.struct((-m["points"]).alias("loss"), m["id"].alias("id"))))


def _best_formation(rules: SquadRules, ranked: list[Column]) -> Column:
    """The fielded formation of most points; ties go to the larger id list."""
    options = []
    for counts in rules.formations():
        picks = [F.slice(r, 1, n) for r, n in zip(ranked, counts)]
        full = F.lit(True)
        for r, n in zip(ranked, counts):
            full = full & (F.size(r) >= n)
        chosen = F.concat(*picks)
        points = F.aggregate(chosen, F.lit(0.0), lambda s, m: s - m["loss"])
        options.append(F.when(full, F.struct(
            points.alias("points"), F.transform(chosen, lambda m: m["id"]).alias("ids"),
            F.array_sort(chosen).alias("order"))))
    if len(options) == 1:
        return options[0]
    return F.array_max(F.array(*options))


def best_lineup(
    members: DataFrame, rules: SquadRules, squad_id: str, player_id: str, position: str,
    points: str, bench: bool = True, keeper_first: bool = False,
) -> DataFrame:
    """The legal line-up of most points per squad, exact.

    Only the best ``maximum_starters`` per (squad, position) can start, and the
    rank limit is applied before the shuffle as well, so an oversized group
    sends a few rows per task. All formations are then compared inside one row.
    The captain and vice-captain are the two best starters. ``bench`` orders the
    other members by position, points and id (or keepers first); a squad
    above the rules' size fails the call.
    """
    rows = members.select(
        squad_id, F.col(player_id).alias("id"), F.col(position).alias("position"),
        F.col(points).cast("double").alias("points"),
    )
    if bench:
        sizes = rows.groupBy(squad_id).agg(F.count("*").alias("__n"))
        require_no_rows(sizes.filter(F.col("__n") > rules.squad_size),
                        "squads above the rules' size")
    order = Window.partitionBy(squad_id, "position").orderBy(F.desc("points"), F.asc("id"))
    most = max(p.maximum_starters for p in rules.positions)
    top = rows.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= most)
    packed = top.groupBy(squad_id).agg(
        F.collect_list(F.struct("id", "position", "points")).alias("__m"))
    ranked = [_ranked(F.col("__m"), p.position_id) for p in rules.positions]
    # inline() evaluates the choice once and drops squads without a formation.
    chosen = packed.select(
        squad_id, F.inline(F.array_compact(F.array(_best_formation(rules, ranked)))))
    out = chosen.select(
        squad_id, F.col("points").alias("starting_xi_points"), F.col("ids").alias("starting_xi"),
        F.col("order")[0]["id"].alias("captain"),
        F.try_element_at(F.col("order"), F.lit(2))["id"].alias("vice_captain"),
        (-F.col("order")[0]["loss"]).alias("captain_points"),
    )
    if not bench:
        return out
    rest = rows.join(out.select(squad_id, "starting_xi"), squad_id).filter(
        ~F.array_contains("starting_xi", F.col("id")))
    if keeper_first:
        lead = F.struct((~F.col("position").isin(*rules.keepers)).alias("k"),
                        (-F.col("points")).alias("loss"), F.col("id"))
    else:
        lead = F.struct("position", (-F.col("points")).alias("loss"), F.col("id"))
    benches = rest.groupBy(squad_id).agg(
        F.transform(F.sort_array(F.collect_list(lead)), lambda m: m["id"]).alias("bench"),
        F.sum("points").alias("bench_points"))
    return out.join(benches, squad_id, "left").withColumns({
        "bench": F.coalesce("bench", F.array().cast(out.schema["starting_xi"].dataType)),
        "bench_points": F.coalesce("bench_points", F.lit(0.0)),
    })


def legal_draws(
    members: DataFrame, rules: SquadRules, squad_id: str, club: str, price: str,
    minimum_cost: float | None = None, maximum_cost: float | None = None,
) -> DataFrame:
    """Squads within the club cap and a cost band, with their total cost."""
    top = rules.budget if maximum_cost is None else maximum_cost
    clubs = members.groupBy(squad_id, club).agg(
        F.count("*").alias("__n"), F.sum(F.col(price).cast("double")).alias("__cost"))
    totals = clubs.groupBy(squad_id).agg(
        F.max("__n").alias("__crowd"), F.sum("__cost").alias("total_cost"))
    kept = totals.filter((F.col("__crowd") <= rules.max_per_club)
                         & (F.col("total_cost") <= top + 1e-9))
    if minimum_cost is not None:
        kept = kept.filter(F.col("total_cost") >= minimum_cost - 1e-9)
    return kept.select(squad_id, "total_cost")


def marginals(
    df: DataFrame, keys: Sequence[str], cumulative: dict[int, str], horizon: int,
) -> DataFrame:
    """Cumulative projections as one value per period ahead.

    Between two known horizons the growth (never negative) is spread evenly.
    Rows: keys, ``step`` (1..horizon), ``value``.
    """
    known = sorted(h for h in cumulative if h <= horizon)
    if not known or known[-1] != horizon:
        raise ContractError(f"no cumulative column for horizon {horizon}")
    pieces, before = [], 0
    for h in known:
        previous = F.col(cumulative[before]) if before else F.lit(0.0)
        share = F.greatest(F.col(cumulative[h]) - previous, F.lit(0.0)) / float(h - before)
        pieces += [F.struct(F.lit(step).alias("step"), share.alias("value"))
                   for step in range(before + 1, h + 1)]
        before = h
    return df.select(*keys, F.explode(F.array(*pieces)).alias("__p")).select(*keys, "__p.*")


def captain_value(
    df: DataFrame, keys: Sequence[str], captain: str, vice: str, captain_probability: str,
    vice_probability: str, captain_first: str | None = None, vice_first: str | None = None,
) -> DataFrame:
    """Expected captain points with the vice-captain standing in.

    Per period ``p_c * v_c + (1 - p_c) * p_v * v_v`` with ``v`` the points given
    an appearance (0 below probability 1e-9). In the first step a probability is
    capped by the supplied chance. ``df`` has one row per keys and ``step``.
    """
    def chance(base: str, first: str | None) -> Column:
        bounded = F.least(F.greatest(F.col(base), F.lit(0.0)), F.lit(1.0))
        if not first:
            return bounded
        capped = F.least(bounded, F.coalesce(F.col(first) / 100.0, F.lit(1.0)))
        return F.when(F.col("step") == 1, capped).otherwise(bounded)

    def given(points: str, base: str) -> Column:
        return F.when(F.col(base) > 1e-9,
                      F.col(points) / F.least(F.col(base), F.lit(1.0))).otherwise(0.0)

    p_c, p_v = chance(captain_probability, captain_first), chance(vice_probability, vice_first)
    stand_in = (1.0 - p_c) * p_v * given(vice, vice_probability)
    return df.groupBy(*keys).agg(
        F.sum(p_c * given(captain, captain_probability) + stand_in).alias("captain_points"),
        F.sum(stand_in).alias("vice_captain_points"),
    )


def history_readiness(
    members: DataFrame, squad_id: str, available: str, minimum: float = 2.0
) -> DataFrame:
    """Median recent history per squad and whether it is enough to simulate.

    Squads without any value have a median of 0.
    """
    known = members.filter(F.col(available).isNotNull())
    middle = exact_quantiles(known, [squad_id], available, {"median_history": 0.5})
    everyone = members.select(squad_id).distinct()
    return everyone.join(middle, squad_id, "left").select(
        squad_id, F.coalesce("median_history", F.lit(0.0)).alias("median_history"),
        (F.coalesce("median_history", F.lit(0.0)) >= minimum).alias("ready"))
