"""Golden archive, snapshot features, strength and leakage."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.guards import ContractError
from tidemark.operators.strength import ratings_before
from tidemark.plans.backfill import gameweek_facts, historical_training
from tidemark.plans.training_table import prediction_table, training_table
from tidemark.sources.archive import read_seasons, validate_season

HEAD = "name,position,team,xP,element,fixture,round,kickoff_time,was_home,value,total_points,minutes,starts"
# Six gameweeks of three clubs: Harbour plays three times in the fourth and rests in
# the third and fifth, Mill rests in the second.
IDA, OTO = "Ida,GKP,Harbour", "Oto,MID,Mill"
MATCHES = [
    f"{IDA},4,11,11,1,2021-09-04T16:00:00Z,False,50,4,90,1",
    f"{OTO},4,12,11,1,2021-09-04T16:00:00Z,True,65,8,88,1",
    f"{IDA},4,11,12,2,2021-09-11T13:00:00Z,True,50,7,90,1",
    f"{OTO},4,12,,2,,,65,0,0,0",
    f"{IDA},4,11,,3,,,51,0,0,0",
    f"{OTO},4,12,13,3,2021-09-18T15:30:00Z,False,66,11,90,1",
    f"{IDA},4,11,14,4,2021-09-25T12:00:00Z,True,51,1,90,1",
    f"{OTO},4,12,14,4,2021-09-25T12:00:00Z,False,66,5,90,1",
    f"{IDA},4,11,15,4,2021-09-28T19:00:00Z,False,51,3,30,0",
    f"{IDA},4,11,16,4,2021-10-01T19:00:00Z,True,51,9,90,1",
    f"{IDA},4,11,,5,,,52,0,0,0",
    f"{OTO},4,12,17,5,2021-10-09T15:00:00Z,True,67,2,70,1",
    f"{IDA},4,11,18,6,2021-10-16T11:00:00Z,False,52,6,90,1",
    f"{OTO},4,12,18,6,2021-10-16T11:00:00Z,True,67,1,90,1",
]
FIXTURES = ["11,1,2,1,2021-09-04T16:00:00Z,2,1", "12,2,1,3,2021-09-11T13:00:00Z,0,0",
            "13,3,3,2,2021-09-18T15:30:00Z,1,3", "14,4,1,2,2021-09-25T12:00:00Z,1,2",
            "15,4,3,1,2021-09-28T19:00:00Z,2,2", "16,4,1,3,2021-10-01T19:00:00Z,3,0",
            "17,5,2,3,2021-10-09T15:00:00Z,1,1", "18,6,2,1,2021-10-16T11:00:00Z,0,1"]


def write_archive(root, fixtures=FIXTURES):
    season = os.path.join(root, "2021-22")
    os.makedirs(os.path.join(season, "gws"))
    files = {"gws/merged_gw.csv": [HEAD, *MATCHES],
             "fixtures.csv": ["id,event,team_h,team_a,kickoff_time,team_h_score,team_a_score",
                              *fixtures],
             "teams.csv": ["id,name,short_name", "1,Harbour,HAR", "2,Mill,MIL", "3,Quay,QUA"]}
    for name, lines in files.items():
        with open(os.path.join(season, name), "w") as handle:
            handle.write("\n".join(lines) + "\n")
    return str(root)


def build(spark, root, horizons=(1, 3)):
    tables = read_seasons(spark, root, ["2021-22"])
    assert "xP" not in tables["matches"].columns
    return historical_training(tables["matches"], tables["fixtures"], tables["teams"], horizons)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    rows = build(spark, write_archive(tmp_path_factory.mktemp("archive"))).collect()
    return {(r["player_id"], r["snapshot_gameweek"]): r for r in rows}


def test_archive_golden_values(archive):
    assert len(archive) == 12
    assert [archive[(11, g)]["total_points"] for g in range(1, 7)] == [0, 4, 11, 11, 24, 24]
    assert archive[(11, 3)]["recent_points_mean_3"] == 5.5
    assert archive[(11, 4)]["recent_points_mean_3"] == pytest.approx(11 / 3)  # a rest counts as 0
    assert archive[(12, 6)]["price"] == pytest.approx(6.7)
    triple = archive[(11, 4)]
    assert triple["gameweek_total_points"] == 13 and triple["fixture_count"] == 3
    assert triple["upcoming_fixture_count_1"] == 3
    assert triple["label_next_1_gameweek"] == 13
    assert triple["label_minutes_next_1_gameweek"] == 210
    assert triple["label_appearances_next_1_gameweek"] == 1
    assert triple["label_starts_next_1_gameweek"] == 1
    assert triple["club_strength_matches"] == 2
    assert archive[(11, 2)]["label_next_3_gameweeks"] == 20
    assert triple["label_next_3_gameweeks"] == 19
    assert archive[(12, 1)]["club_attack_strength"] == pytest.approx(1.0)
    for player, week in ((12, 2), (11, 3), (11, 5)):
        rest = archive[(player, week)]
        assert rest["fixture_count"] == 0 and rest["label_next_1_gameweek"] == 0
        assert rest["snapshot_timestamp"] is not None
        assert rest["upcoming_opponent_attack_strength_mean_1"] == 0.0
    assert archive[(12, 5)]["label_next_3_gameweeks"] is None


def test_future_results_do_not_change_past_strength(spark, tmp_path, archive):
    changed = [",".join([*row.split(",")[:5], "41", "37"]) if row.split(",")[1] == "4" else row
               for row in FIXTURES]
    rows = build(spark, write_archive(tmp_path, changed)).collect()
    for row in rows:
        if row["snapshot_gameweek"] <= 4:
            before = archive[(row["player_id"], row["snapshot_gameweek"])].asDict()
            for name, value in row.asDict().items():
                if "strength" in name:
                    assert value == pytest.approx(before[name]), name


def test_gameweek_facts_has_no_features(spark, tmp_path):
    facts = gameweek_facts(build(spark, write_archive(tmp_path), (1,)))
    assert "gameweek" in facts.columns and "gameweek_minutes" in facts.columns
    assert not [c for c in facts.columns if c.startswith(("label", "recent", "upcoming"))]


def test_season_names():
    assert validate_season("2023-24") == "2023-24"
    for bad in ("2023-25", "2023", "x"):
        with pytest.raises(ContractError):
            validate_season(bad)


def snapshot_tables(spark, late=False):
    deadline = dt.datetime(2024, 1, 2)
    collected = dt.datetime(2024, 1, 3) if late else dt.datetime(2024, 1, 1)
    snaps = spark.createDataFrame(
        [("s", 4, collected, deadline, p, 10 * p) for p in (1, 2)],
        "season string, snapshot_gameweek int, snapshot_timestamp timestamp, "
        "snapshot_deadline_time timestamp, player_id bigint, club_id bigint")
    points = {1: [1, 2, 3, 4, 5, 6, 7, 8], 2: [0] * 8}
    points[1][0:3] = [2, 3, 5]
    stats = spark.createDataFrame(
        [("s", g, p, points[p][g - 1], 60) for p in (1, 2) for g in range(1, 9)],
        "season string, gameweek int, player_id bigint, total_points int, minutes int")
    return snaps, stats


def test_snapshot_features_and_labels(spark):
    snaps, stats = snapshot_tables(spark)
    row = training_table(snaps, stats).filter("player_id = 1").first()
    assert row["recent_points_mean_3"] == pytest.approx(10 / 3)
    assert row["recent_minutes_mean_3"] == 60 and row["recent_gameweeks_available"] == 3
    assert row["label_next_1_gameweek"] == 4 and row["label_next_3_gameweeks"] == 15
    assert row["label_next_5_gameweeks"] == 30
    changed = stats.withColumn("total_points", F.when(F.col("gameweek") >= 4, 99)
                               .otherwise(F.col("total_points")))
    again = training_table(snaps, changed).filter("player_id = 1").first()
    assert again["recent_points_mean_3"] == row["recent_points_mean_3"]


def test_incomplete_horizon_is_null(spark):
    snaps, stats = snapshot_tables(spark)
    short = stats.filter("NOT (player_id = 2 AND gameweek = 5) AND gameweek < 8")
    rows = {r["player_id"]: r for r in training_table(snaps, short).collect()}
    assert rows[1]["label_next_5_gameweeks"] is None
    assert rows[1]["label_next_3_gameweeks"] == 15
    assert rows[2]["label_next_3_gameweeks"] is None and rows[2]["label_next_1_gameweek"] == 0


def test_late_snapshots_and_empty_facts(spark):
    snaps, stats = snapshot_tables(spark, late=True)
    with pytest.raises(ContractError):
        training_table(snaps, stats)
    snaps, stats = snapshot_tables(spark)
    with pytest.raises(ContractError):
        training_table(snaps, stats.filter("false"))
    assert prediction_table(snaps, stats.filter("false")).count() == 2


def test_fixture_features(spark):
    snaps, stats = snapshot_tables(spark)
    fixtures = spark.createDataFrame(
        [("s", 4, 4, 10, 20), ("s", 4, 4, 30, 10), ("s", 4, 5, 10, 30), ("s", 9, 4, 10, 20)],
        "season string, snapshot_gameweek int, gameweek_id int, home_club_id int, away_club_id int")
    rows = {r["player_id"]: r for r in
            prediction_table(snaps, stats, fixtures, (1, 3)).collect()}
    assert rows[1]["upcoming_fixture_count_1"] == 2
    assert rows[1]["upcoming_home_fixture_count_1"] == 1
    assert rows[1]["upcoming_fixture_count_3"] == 3
    assert rows[2]["upcoming_fixture_count_1"] == 1
    assert rows[1]["club_attack_strength"] == 1.0
    assert rows[1]["upcoming_opponent_attack_strength_mean_1"] == 1.0


def test_strength_of_unseen_club_and_first_period(spark):
    games = spark.createDataFrame(
        [(1, 10, 20, 3.0, 0.0), (2, 20, 10, 1.0, 2.0), (3, 10, 20, None, None)],
        "g int, h int, a int, hs double, aw double")
    asked = spark.createDataFrame([(3, 10), (3, 20), (3, 30), (1, 10)], "g int, club int")
    out = {(r["g"], r["club"]): r for r in
           ratings_before(games, asked, [], "g", "h", "a", "hs", "aw").collect()}
    assert out[(3, 10)]["matches"] == 2
    assert out[(3, 10)]["attack_strength"] > 1 > out[(3, 10)]["goals_conceded_strength"]
    assert out[(3, 30)]["matches"] == 0 and out[(3, 30)]["attack_strength"] == pytest.approx(1.0)
    assert out[(1, 10)]["attack_strength"] == 1.0 and out[(1, 10)]["home_factor"] == 1.0
    cut = ratings_before(games, asked, [], "g", "h", "a", "hs", "aw", chunks=3).collect()
    assert {(r["g"], r["club"]): tuple(r) for r in cut} == {k: tuple(v) for k, v in out.items()}
