"""Legality, projection, line-ups, swaps, ratings and reconciliation."""

import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.guards import ContractError
from tidemark.operators.ratings import percentile_scores
from tidemark.operators.reconcile import reconcile_lineups, shared_shift
from tidemark.operators.rules import SquadRules
from tidemark.operators.squads import (
    adjust_for_availability,
    best_lineup,
    captain_value,
    marginals,
    member_details,
    project,
    squad_report,
)
from tidemark.operators.transfers import TRIED, best_replacements, best_single_swap, option_values
from tidemark.plans.rating import COMPONENTS, rate_squads

# The rules of the game.
SETTINGS = {"squad_squadsize": 15, "squad_squadplay": 11, "squad_team_limit": 3,
            "squad_total_spend": 1000, "ui_currency_multiplier": 10}
POSITIONS = [
    {"id": i, "singular_name_short": n, "squad_select": s, "squad_min_play": a, "squad_max_play": b}
    for i, n, s, a, b in ((1, "GKP", 2, 1, 1), (2, "DEF", 5, 3, 5), (3, "MID", 5, 2, 5),
                          (4, "FWD", 3, 1, 3))]
RULES = SquadRules.from_settings(SETTINGS, POSITIONS)
KEEPERS, BACKS, MIDDLE, FRONT = [21, 22], [31, 32, 33, 34, 35], [41, 42, 43, 44, 45], [51, 52, 53]
SQUAD = KEEPERS + BACKS + MIDDLE + FRONT
XI, BENCH = [21, 31, 33, 34, 35, 41, 43, 44, 45, 52, 53], [22, 32, 42, 51]
SCHEMA = ("squad_id int, player_ids array<bigint>, starting_xi array<bigint>, "
          "bench array<bigint>, captain bigint, vice_captain bigint, active_chip string, "
          "budget_limit double")


@pytest.fixture(scope="module")
def players(spark):
    """Four points of minutes a point; the last forward is in doubt."""
    places = [(1, "GKP")] * 2 + [(2, "DEF")] * 5 + [(3, "MID")] * 5 + [(4, "FWD")] * 3
    prices = [4.0, 5.0, 4.4, 4.8, 5.2, 5.6, 6.0, 5.5, 6.5, 7.5, 8.5, 9.5, 6.2, 7.2, 8.6]
    points = [3, 2, 4, 1, 5, 2, 3, 6, 2, 7, 4, 5, 3, 8, 6]
    rows = [(p, i % 6 + 1, *places[i], prices[i], "d" if p == 53 else "a", 75 if p == 53 else None, None,
             float(points[i]), 2.5 * points[i], 10.0 * points[i], 30.0 * points[i])
            for i, p in enumerate(SQUAD)]
    return spark.createDataFrame(
        rows, "player_id bigint, club_id bigint, position_id bigint, position_short_name string, "
        "price double, status string, chance_of_playing_this_round int, "
        "chance_of_playing_next_round int, predicted_points_1 double, predicted_points_3 double, "
        "predicted_minutes_1 double, predicted_minutes_3 double")


def squads(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def squad(number=1, ids=None, xi=XI, bench=BENCH, captain=52, vice=43, chip=None, limit=None):
    return (number, ids or SQUAD, xi, bench, captain, vice, chip, limit)


def test_rules_come_from_settings():
    assert RULES.budget == 100.0 and RULES.keepers == (1,)
    assert (1, 3, 5, 2) in RULES.formations() and len(RULES.formations()) == 8
    with pytest.raises(ContractError):
        SquadRules.from_settings({**SETTINGS, "squad_squadsize": 14}, POSITIONS)


def test_legality(spark, players):
    unknown = [99 if p == 53 else p for p in SQUAD]
    table = squads(
        spark, squad(1), squad(2, captain=42), squad(3, chip="wildcard"),
        squad(4, ids=unknown, xi=[99 if p == 53 else p for p in XI]),
        squad(5, xi=[21, 22, 34, 35, 41, 43, 44, 45, 51, 52, 53], bench=[31, 32, 33, 42]),
        squad(6, limit=60.0), squad(7, ids=[21, 21, *SQUAD[2:]], vice=52))
    out = {r["squad_id"]: r for r in squad_report(table, players, RULES).collect()}
    assert out[1]["errors"] == [] and out[1]["formation"] == "4-4-2"
    assert out[1]["total_cost"] == pytest.approx(94.5)
    assert out[2]["errors"] == ["captain does not start"]
    assert out[3]["errors"] == ["chips are not supported"]
    assert out[4]["errors"] == ["unknown members 99"]
    assert len(out[5]["errors"]) == 3  # two keepers start, two backs, no keeper on the bench
    assert out[6]["errors"] == ["squad is over budget"]
    assert len(out[7]["errors"]) >= 3


def test_projection_with_availability(spark, players):
    """The doubt takes a quarter of the first week: 15 - 6 / 4 points, 180 - 60 / 4 minutes."""
    points = adjust_for_availability(players, "predicted_points_3", "predicted_points_1")
    row = project(squads(spark, squad()), points, RULES).first()
    assert (row["gkp_points"], row["def_points"], row["mid_points"], row["fwd_points"]) == (
        7.5, 35, 55, 33.5)
    assert row["bench_points"] == 20 and row["captain_points"] == 20
    assert row["overall_points"] == 151
    details = member_details(squads(spark, squad()), points, minutes="predicted_minutes_3",
                             first_minutes="predicted_minutes_1")
    last = details.filter("player_id = 53").first()
    assert last["availability_adjusted_minutes"] == 165 and last["lineup_role"] == "starter"
    with pytest.raises(ContractError):
        adjust_for_availability(
            players.withColumn("chance_of_playing_this_round", F.lit(120)), "predicted_points_3",
            "predicted_points_1")


def test_oversized_squads_fail(spark):
    rows = [(1, i, 1 + i % 4, 1.0) for i in range(16)]
    df = spark.createDataFrame(rows, "s int, id bigint, pos int, pts double")
    with pytest.raises(ContractError):
        best_lineup(df, RULES, "s", "id", "pos", "pts")


def brute_lineup(members):
    best = None
    for counts in RULES.formations():
        chosen, total = [], 0.0
        for rule, n in zip(RULES.positions, counts):
            pool = sorted((m for m in members if m[1] == rule.position_id),
                          key=lambda m: (-m[2], m[0]))[:n]
            chosen += [m[0] for m in pool]
            total += sum(m[2] for m in pool)
        if best is None or (total, chosen) > best:
            best = (total, chosen)
    return best


def random_squads(count, pool=60, seed=3):
    random.seed(seed)
    base = [(i, random.randint(1, 15), 1 + i % 4, random.randint(40, 90),
             float(random.randint(0, 12))) for i in range(1, pool + 1)]
    out = []
    for s in range(count):
        while True:
            team = [p for rule in RULES.positions for p in random.sample(
                [b for b in base if b[2] == rule.position_id], rule.squad_count)]
            clubs = [p[1] for p in team]
            if max(clubs.count(c) for c in clubs) <= 3:
                break
        out.append((s, team))
    return base, out


def test_best_lineup_is_exact(spark):
    _, teams = random_squads(25)
    rows = [(s, p[0], p[2], p[4]) for s, team in teams for p in team]
    df = spark.createDataFrame(rows, "s int, id bigint, pos int, pts double")
    out = {r["s"]: r for r in best_lineup(df, RULES, "s", "id", "pos", "pts").collect()}
    for s, team in teams:
        total, chosen = brute_lineup([(p[0], p[2], p[4]) for p in team])
        assert out[s]["starting_xi_points"] == total and out[s]["starting_xi"] == chosen
        ranked = sorted((p for p in team if p[0] in chosen), key=lambda p: (-p[4], p[0]))
        assert [out[s]["captain"], out[s]["vice_captain"]] == [p[0] for p in ranked[:2]]
        rest = sorted((p for p in team if p[0] not in chosen), key=lambda p: (p[2], -p[4], p[0]))
        assert out[s]["bench"] == [p[0] for p in rest]


def squad_worth(team, weight=0.1):
    members = [(p[0], p[2], p[4]) for p in team]
    best = max(
        (1 - weight) * sum(m[2] for m in chosen) + max(m[2] for m in chosen)
        for counts in RULES.formations()
        for chosen in [[m for rule, n in zip(RULES.positions, counts) for m in sorted(
            (x for x in members if x[1] == rule.position_id), key=lambda x: -x[2])[:n]]])
    return weight * sum(m[2] for m in members) + best


@pytest.mark.parametrize("free", [1, 0])
def test_best_single_swap_is_exact(spark, free):
    base, teams = random_squads(12, pool=80, seed=9)
    columns = "player_id bigint, club_id int, position_id int, price_ticks bigint, points double"
    pool = spark.createDataFrame(base, columns)
    members = spark.createDataFrame(
        [(s, *p) for s, team in teams for p in team], "squad_id int, " + columns
    ).withColumnRenamed("price_ticks", "sell_ticks")
    bank = {s: s % 4 for s, _ in teams}
    money = spark.createDataFrame(
        [(s, (sum(p[3] for p in team) + bank[s]) / 10) for s, team in teams],
        "squad_id int, budget double")
    out = {r["squad_id"]: r for r in best_single_swap(
        members, pool, RULES, money, 127, free_transfers=free).collect()}
    for s, team in teams:
        held = {p[0] for p in team}
        best = squad_worth(team)
        for gone, new in itertools.product(team, base):
            after = [p for p in team if p is not gone] + [new]
            clubs = [p[1] for p in after]
            if (new[0] in held or new[2] != gone[2] or new[3] > gone[3] + bank[s]
                    or clubs.count(new[1]) > 3):
                continue
            best = max(best, squad_worth(after) - 4.0 * max(0, 1 - free))
        assert out[s]["objective"] == pytest.approx(best), s


def test_many_squads_are_valued_at_once():
    _, teams = random_squads(30, pool=80, seed=4)
    short = [p for p in teams[0][1] if p[2] != 1]  # no keeper: nothing can be fielded
    rows = [*[team for _, team in teams], short]
    worth, fielded = option_values(
        np.array([len(r) for r in rows]), np.array([p[2] - 1 for r in rows for p in r]),
        np.array([float(p[4]) for r in rows for p in r]), RULES, 0.1)
    assert fielded.tolist() == [True] * len(teams) + [False]
    assert worth[:-1].tolist() == pytest.approx([squad_worth(team) for _, team in teams])


def test_replacement_lies_behind_many_that_do_not_fit(spark):
    """The squad holds the best players of the list, more than are tried one by one."""
    n = TRIED + 3
    pool = spark.createDataFrame(
        [(i, 1, i, 5, float(100 - i)) for i in range(n + 2)],
        "player_id bigint, position_id int, club_id int, price_ticks bigint, points double")
    members = spark.createDataFrame([(7, i, 1, i, 5) for i in range(n)], "squad_id int, "
                                    "player_id bigint, position_id int, club_id int, limit_ticks bigint")
    out = best_replacements(members, pool, 15, 2).collect()
    assert sorted((r["out_id"], r["in_id"]) for r in out) == [(i, n) for i in range(n)]


def test_swaps_of_repeated_and_unknown_members(spark):
    """Copies of a member leave together; without points an option is no option."""
    rules = SquadRules.from_settings(
        {**SETTINGS, "squad_squadsize": 2, "squad_squadplay": 2},
        [{"id": 1, "singular_name_short": "ANY", "squad_select": 2, "squad_min_play": 2, "squad_max_play": 2}])
    columns = "player_id bigint, club_id int, position_id int, price_ticks bigint, points double"
    pool = spark.createDataFrame([(1, 1, 1, 5, 2.0), (2, 2, 1, 5, 3.0), (3, 3, 1, 5, 9.0)], columns)
    members = spark.createDataFrame(
        [(1, 1, 1, 1, 5, 2.0), (1, 1, 1, 1, 5, 2.0), (1, 2, 2, 1, 5, 3.0),
         (2, 1, 1, 1, 5, None), (2, 2, 2, 1, 5, 3.0), (3, 1, 1, 1, 5, None), (3, 2, 2, 1, 5, None)],
        "squad_id int, " + columns).withColumnRenamed("price_ticks", "sell_ticks")
    money = spark.createDataFrame([(1, 1.5), (2, 1.0), (3, 1.0)], "squad_id int, budget double")
    out = {r["squad_id"]: r for r in best_single_swap(members, pool, rules, money, 15).collect()}
    assert set(out) == {1, 2}  # no option of the third squad has a value
    assert (out[1]["out_id"], out[1]["in_id"]) == (1, 3)
    assert out[1]["objective"] == pytest.approx(0.1 * 21 + 0.9 * 18 + 9)
    assert out[1]["without"] == pytest.approx(0.1 * 7 + 0.9 * 5 + 3)
    assert (out[2]["out_id"], out[2]["in_id"], out[2]["without"]) == (1, 3, None)


def test_captain_fallback_value(spark, players):
    pair = spark.createDataFrame(
        [(1, 19.0, 16.0, 0.0, 1.0)], "squad_id int, c1 double, v1 double, pc double, pv double")
    steps = marginals(pair, ["squad_id", "pc", "pv"], {1: "c1"}, 1).withColumnRenamed(
        "value", "captain").withColumn("vice", F.lit(16.0))
    row = captain_value(steps, ["squad_id"], "captain", "vice", "pc", "pv").first()
    assert row["captain_points"] == pytest.approx(16.0)


@pytest.mark.parametrize("chunks", [1, 7])
def test_scores_against_reference(spark, chunks):
    known = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    asked = spark.createDataFrame([(v,) for v in (5000.0, 9700.0, 9940.0, 20000.0)], "v double")
    got = {r["v"]: r for r in percentile_scores(asked, known, [], "v", chunks).collect()}
    assert got[5000.0]["score"] == pytest.approx(75.0, abs=0.01)
    assert got[9700.0]["score"] == pytest.approx(90.05, abs=0.01)
    assert got[9940.0]["score"] == pytest.approx(95.1, abs=0.1)
    assert got[20000.0]["score"] == 99.9
    for row in got.values():
        p = (row["less"] + row["equal"] / 2 + 0.5) / 10_001
        want = min(max(75 + 8 * NormalDist().inv_cdf(p), 0), 99.9)
        assert row["score"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("value", [None, float("nan"), float("inf"), float("-inf")])
def test_rated_values_must_be_finite(spark, value):
    """The population leaves out what is missing; a rated value may not be."""
    odd = [None, float("nan")] * 40
    known = spark.createDataFrame([(float(v),) for v in range(20)] + [(v,) for v in odd], "v double")
    good = percentile_scores(spark.createDataFrame([(9.5,)], "v double"), known, [], "v").first()
    assert good["percentile"] == 50.0 and good["reference_rows"] == 20
    asked = spark.createDataFrame([(9.5,), (value,)], "v double")
    with pytest.raises(Exception, match="missing or not finite"):
        percentile_scores(asked, known, [], "v").collect()


def test_lineup_roles_sum_to_targets(spark):
    rows = [(i, 7, "GKP" if i < 2 else "DEF", 0.5 + i / 40, 0.2 + i / 30) for i in range(16)]
    schema = "player_id int, club_id int, position string, app double, start double"
    df = spark.createDataFrame(rows, schema)
    out = reconcile_lineups(df, ["club_id"], "position", "start", "app").collect()
    keepers = [r for r in out if r["position"] == "GKP"]
    field = sorted((r for r in out if r["position"] != "GKP"), key=lambda r: r["player_id"])
    assert sum(r["start"] for r in keepers) == pytest.approx(1.0)
    assert sum(r["start"] for r in field) == pytest.approx(10.0)
    assert [r["start"] for r in field] == sorted(r["start"] for r in field)
    assert all(r["app"] >= r["start"] for r in out)
    with pytest.raises(ContractError):
        reconcile_lineups(spark.createDataFrame([(1, 7, "DEF", 1.0, 1.2)], schema), ["club_id"],
                          "position", "start", "app")


def test_shift_solves_every_group(spark):
    """By bisection in Python: also targets of none and of all members."""
    df = spark.range(600).select((F.col("id") % 3).alias("g"),
                                 (F.pmod(F.hash("id"), F.lit(997)) / 997.0).alias("p"))
    members = {}
    for r in df.collect():
        members.setdefault(r["g"], []).append(min(max(r["p"], 1e-9), 1 - 1e-9))
    for target in (10.0, 150.0):
        found = {r["g"]: r["shift"] for r in shared_shift(df, ["g"], "p", F.lit(target)).collect()}
        for g, ps in members.items():
            total = sum(1 / (1 + (1 - p) / p * math.exp(-found[g])) for p in ps)
            assert total == pytest.approx(target, abs=1e-6)
    full = shared_shift(df, ["g"], "p", F.lit(500.0)).collect()
    assert all(r["shift"] is None and r["target"] == r["members"] for r in full)


def test_rate_squads_plan(spark, players):
    static = players.select("player_id", "club_id", "position_id", "position_short_name", "price",
                            "status", "chance_of_playing_this_round")
    predictions = players.select("player_id", "predicted_points_1", "predicted_points_3")
    columns = list(COMPONENTS.values())
    reference = spark.range(302).select(
        *[F.col("id").cast("double").alias(c) for c in dict.fromkeys(columns)])
    rated, rejected = rate_squads(squads(spark, squad(1), squad(2, captain=42)), static,
                                  predictions, RULES, 3, reference)
    row = rated.first()
    assert row["squad_id"] == 1 and row["overall_points"] == 151
    assert row["percentiles"]["overall"] == pytest.approx(50.2)  # 151 below, one equal, of 302
    assert row["reference_rows"] == 302 and "goalkeeper" in row["weaknesses"]
    assert [r["squad_id"] for r in rejected.collect()] == [2]
