"""Run store, payloads, inventories, set operations."""

import datetime as dt
import gzip
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ordered
from tidemark.operators.guards import ContractError, validate_horizons
from tidemark.operators.managers import pick_violations
from tidemark.operators.sets import disjoint_union
from tidemark.queries.pipelines import q_csv_archive
from tidemark.session import plain_scan, setting
from tidemark.sources import payloads
from tidemark.sources.archive import MARK, file_inventory, relative_to, verify_inventory
from tidemark.sources.runs import (
    committed_runs,
    load_training,
    manifests,
    read_ordered,
    read_versions,
    register_views,
    registry,
    run_id,
    write_run,
)

UTC = dt.timezone.utc


def test_runs_are_immutable_and_newest_wins(spark, tmp_path):
    root = str(tmp_path / "store")
    schema = "season string, gameweek int, player_id bigint, total_points {}, ingested_at string"
    for day, kind, points in ((1, "int", 2), (2, "double", 5.0)):
        df = spark.createDataFrame([("s", 1, 7, points, f"2024-01-0{day}")], schema.format(kind))
        write_run(spark, f"{root}/history", {"stats": df}, dt.datetime(2024, 1, day, tzinfo=UTC),
                  {"season": "s", "snapshot_gameweek": 1})
    with pytest.raises(ContractError):
        write_run(spark, f"{root}/history", {}, dt.datetime(2024, 1, 1, tzinfo=UTC))
    # A run without its manifest is unfinished and must not be seen.
    df.write.parquet(f"{root}/history/{run_id(dt.datetime(2024, 1, 3, tzinfo=UTC))}/stats")
    empty = T.StructType([T.StructField("player_id", T.LongType())])
    assert read_versions(spark, f"{root}/history", "stats", empty).count() == 2
    views = register_views(
        spark, root, {"snaps": ("players", empty)},
        {"stats": ("history", "stats", empty, ["season", "gameweek", "player_id"],
                   ["ingested_at", "filename"])})
    assert set(views) == {"snaps", "_stats_runs", "stats", "snapshot_registry"}
    assert [r["total_points"] for r in spark.table("stats").collect()] == [5.0]
    assert spark.table("snaps").count() == 0 and spark.table("snaps").columns[0] == "player_id"
    runs = registry(spark, f"{root}/history").collect()
    assert len(runs) == 2 and {r["season"] for r in runs} == {"s"}


PAYLOAD = {
    "elements": [
        {"id": 1, "code": 11, "first_name": " Ann ", "second_name": "Lee", "web_name": None,
         "team": 1, "element_type": 1, "now_cost": 45, "selected_by_percent": "12.3", "extra": 1},
        {"id": 2, "code": 12, "first_name": "Bo", "second_name": "Ray", "web_name": "Ray",
         "team": 2, "element_type": 1, "now_cost": 70, "selected_by_percent": "x", "extra": 2}],
    "teams": [{"id": 1, "name": "North", "short_name": "NOR"},
              {"id": 2, "name": "South", "short_name": "SOU"}],
    "events": [{"id": 1, "name": "GW1", "deadline_time": "2024-08-16T17:30:00Z",
                "finished": True}],
    "element_types": [{"id": 1, "singular_name": "Keeper", "singular_name_short": "GKP"}],
}


@pytest.fixture()
def payload(spark, tmp_path):
    def read(value, name="payload.json"):
        path = tmp_path / name
        path.write_text(json.dumps(value, indent=1))
        return payloads.read_payload(spark, str(path))
    return read


def normalised(payload, value):
    data = payload(value)
    clubs = payloads.clubs(payloads.records(data, "teams"))
    positions = payloads.positions(payloads.records(data, "element_types"))
    return payloads.players(payloads.records(data, "elements"), clubs, positions)


def test_players_payload(payload):
    rows = {r["player_id"]: r for r in normalised(payload, PAYLOAD).collect()}
    assert rows[1]["price"] == 4.5 and rows[1]["ownership_percent"] == 12.3
    assert rows[1]["full_name"] == "Ann Lee" and rows[1]["display_name"] == "Ann Lee"
    assert rows[1]["club_name"] == "North" and rows[1]["position_short_name"] == "GKP"
    assert rows[2]["ownership_percent"] is None and rows[2]["extra"] == 2
    assert rows[2]["photo_url"].endswith("/p12.png")


def test_unknown_club_and_price_are_refused(payload):
    broken = json.loads(json.dumps(PAYLOAD))
    broken["elements"][0]["team"] = 9
    with pytest.raises(ContractError):
        normalised(payload, broken)
    broken = json.loads(json.dumps(PAYLOAD))
    broken["elements"][0]["now_cost"] = "free"
    with pytest.raises(Exception):
        normalised(payload, broken).collect()


def test_fixtures_deadline_and_stamp(payload, spark):
    data = payload(PAYLOAD)
    clubs = payloads.clubs(payloads.records(data, "teams"))
    games = payload([{"id": 5, "event": None, "team_h": 1, "team_a": 2}], "f.json")
    row = payloads.fixtures(games.withColumn("event", F.lit(None).cast("string")), clubs).first()
    assert row["home_club_name"] == "North" and row["gameweek_id"] is None
    deadline = payloads.deadline_of(payloads.records(data, "events"), 1)
    early = dt.datetime(2024, 8, 1, tzinfo=UTC)
    stamped = payloads.stamp_snapshot(clubs, "2024-25", 1, early, deadline)
    assert tuple(stamped.columns[:4]) == payloads.SNAPSHOT_IDENTITY
    with pytest.raises(ContractError):
        payloads.stamp_snapshot(clubs, "2024-25", 1, deadline + dt.timedelta(hours=1), deadline)
    assert payloads.finished_periods(payloads.records(data, "events")).count() == 1


def test_live_payload(payload):
    live = payload({"elements": [{"id": 3, "stats": {"minutes": 90, "total_points": 6},
                                  "explain": []}]}, "gameweek-07.json")
    row = payloads.live_stats(live, "s", "now").first()
    assert (row["gameweek"], row["player_id"], row["total_points"]) == (7, 3, 6)
    twice = payload({"elements": [{"id": 3, "stats": {"minutes": 1}}] * 2}, "gameweek-08.json")
    with pytest.raises(ContractError):
        payloads.live_stats(twice, "s", "now")


def test_manager_picks(payload, spark):
    picks = [{"element": i, "position": i, "multiplier": 1, "is_captain": i == 1,
              "is_vice_captain": i == 2} for i in range(1, 16)]
    data = payload({"active_chip": None, "entry_history": {"event": 1, "points": 50},
                    "picks": picks})
    rows, managers = payloads.manager_picks(data, F.lit(9), "s", 1, "now")
    assert rows.filter("lineup_role = 'starter'").count() == 11
    assert managers.first()["points"] == 50
    known = spark.range(1, 16).select(F.col("id").alias("player_id"))
    assert pick_violations(rows, ["manager_id"], known).count() == 0
    bad = rows.withColumn("is_captain", F.lit(True)).filter("player_id < 15")
    assert len(pick_violations(bad, ["manager_id"], known).first()["reasons"]) == 3
    with pytest.raises(ContractError):
        payloads.manager_picks(data, F.lit(9), "s", 1, "now", known.limit(3))


def test_inventory_detects_tampering(spark, tmp_path):
    root = str(tmp_path)
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(name)
    manifest = spark.createDataFrame(
        [tuple(r) for r in relative_to(file_inventory(spark, root), root).select(
            "relative_path", "bytes", "sha256").collect()],
        "relative_path string, bytes bigint, sha256 string")
    (tmp_path / "a.csv").write_text("A.csv")
    os.rename(tmp_path / "b.csv", tmp_path / "c.csv")
    status = {r["relative_path"]: r["status"] for r in verify_inventory(
        relative_to(file_inventory(spark, root), root), manifest).collect()}
    assert status == {"a.csv": "checksum differs", "b.csv": "missing", "c.csv": "unexpected"}


def test_inventory_streams_large_files(spark, tmp_path):
    noise = random.Random(3).randbytes
    files = {
        "a b+%41.parquet": noise(300_000), "ends.parquet": noise(5_000) + b"\n\n",
        "feeds.csv": b"a\r\nb\r\rc" * 3_000, "marked.csv": MARK + b"a,b\n" * 3_000,
        "marked_too.csv": MARK + b"a,b\n" * 3_000 + b"c", "packed.csv.gz": gzip.compress(noise(50_000)),
        "plain": noise(200_000), "twin.parquet": noise(300_000), "other.zä": noise(9_000),
        "small.csv": b"a,b\n", "sub/part-0": noise(70_000)}
    (tmp_path / "sub").mkdir()
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    expected = sorted((n, len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items())
    with setting(spark, "spark.sql.files.maxPartitionBytes", "20000"), \
            setting(spark, "spark.sql.sources.binaryFile.maxLength", "4096"):
        found = relative_to(file_inventory(spark, str(tmp_path), whole=4096), str(tmp_path))
        assert sorted(map(tuple, found.select("relative_path", "bytes", "sha256").collect())) == expected
        some = relative_to(file_inventory(spark, str(tmp_path), "*.parquet", whole=4096), str(tmp_path))
        assert sorted(map(tuple, some.select("relative_path", "bytes", "sha256").collect())) == [
            e for e in expected if e[0].endswith(".parquet")]


def test_overlap_is_refused(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x int")
    b = spark.createDataFrame([(2, "u")], "k int, y string")
    assert disjoint_union({"a": a, "b": b}, ["k"]).count() == 2
    with pytest.raises(ContractError):
        disjoint_union({"a": a, "b": a}, ["k"])


def test_horizons():
    assert validate_horizons([1, 3]) == (1, 3)
    for bad in ([], [0], [True], [1, 1], [1.5]):
        with pytest.raises(ContractError):
            validate_horizons(bad)


def test_training_tables_unite_by_name(spark, tmp_path):
    keys = ["season", "snapshot_gameweek", "player_id"]
    schema = "season string, snapshot_gameweek int, player_id int, {} double"
    for name, column, player in (("a", "x", 1), ("b", "y", 2)):
        spark.createDataFrame([("s", 1, player, 1.0)], schema.format(column)).write.parquet(
            str(tmp_path / name))
    paths = [str(tmp_path / n) for n in ("a", "b")]
    out = load_training(spark, paths, keys)
    assert {"x", "y", "training_source_file"} <= set(out.columns) and out.count() == 2
    with pytest.raises(ContractError):
        load_training(spark, [paths[0], paths[0]], keys)


def test_rows_and_rules_are_counted_while_writing(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    group = "write and count"
    spark.sparkContext.setJobGroup(group, "")
    write_run(spark, root, {"t": rows}, dt.datetime(2024, 1, 1, tzinfo=UTC), require={"t": {"a sign": F.col("v") >= 0}})
    spark.sparkContext.setJobGroup("after", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 2  # the table and the manifest
    with pytest.raises(ContractError, match="small.*142"):
        write_run(spark, root, {"t": rows}, dt.datetime(2024, 1, 2, tzinfo=UTC),
                  require={"t": {"small": F.col("v") < 5, "known": F.col("v").isNotNull()}})
    with pytest.raises(ContractError, match="unknown"):
        write_run(spark, root, {"t": rows.withColumn("v", F.lit(None).cast("int"))}, dt.datetime(2024, 1, 3, tzinfo=UTC),
                  require={"t": {"unknown": F.col("v") < 5}})
    noted = manifests(spark, root).collect()
    assert [(r["table"], r["rows"]) for r in noted] == [("t", 500)] and len(committed_runs(spark, root)) == 1
    assert manifests(spark, str(tmp_path / "none")).collect() == []
    empty = write_run(spark, root, {"t": rows.limit(0)}, dt.datetime(2024, 1, 4, tzinfo=UTC))
    assert {r["rows"] for r in manifests(spark, root).filter(F.col("folder") == empty).collect()} == {0}


def test_many_runs_are_two_scans(spark, tmp_path):
    """Schemas come from one scan of all manifests, whatever the number of runs."""
    root = str(tmp_path / "store")
    for day in range(1, 13):
        df = spark.createDataFrame([(day, 1)] if day < 9 else [(day, 1, 2)], "k int, v int" if day < 9 else "k int, v int, w int")
        write_run(spark, root, {"t": df.coalesce(1)}, dt.datetime(2024, 1, day, tzinfo=UTC))
    group = "plan"
    spark.sparkContext.setJobGroup(group, "")
    versions = read_versions(spark, root, "t", T.StructType([]))
    spark.sparkContext.setJobGroup("after", "")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert len(jobs) <= 3
    assert versions._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert sorted(r["k"] for r in versions.collect()) == list(range(1, 13)) and "w" in versions.columns
    old = f"{root}/{run_id(dt.datetime(2024, 2, 1, tzinfo=UTC))}"  # a run that noted no schema
    spark.createDataFrame([(99, 1)], "k int, v int").write.parquet(f"{old}/t")
    spark.createDataFrame([(json.dumps({"snapshot_id": "x", "tables": {"t": 1}}),)], "value string").write.text(f"{old}/manifest")
    assert read_versions(spark, root, "t", T.StructType([])).count() == 13


def test_ordered_files(spark, tmp_path):
    """A first key with most rows is spread; files follow each other; places count over all."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 1000).alias("v"), "id")
    run = write_run(spark, str(tmp_path), {"t": rows}, dt.datetime(2024, 1, 1, tzinfo=UTC), order_by={"t": ["k", "v", "id"]})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        wide = write_run(spark, str(tmp_path), {"t": rows}, dt.datetime(2024, 1, 2, tzinfo=UTC), order_by={"t": ["k", "v", "id"]})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(spark.read.parquet(f"{wide}/t-bounds").collect(), key=lambda r: r["file"])
    assert len(files) > 2 and max(r["rows"] for r in files) < 2 * 3000 / len(files)
    want = [tuple(r) for r in rows.orderBy("k", "v", "id").collect()]
    for path in (run, wide):
        got = sorted(read_ordered(spark, f"{path}/t").collect(), key=lambda r: r["position"])
        assert [r["position"] for r in got] == list(range(3000)) and [tuple(r)[:3] for r in got] == want
    plan = read_ordered(spark, f"{wide}/t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan


def test_newest_snapshot_is_pruned(spark, tmp_path):
    from tidemark.queries.pipelines import PRUNED_BEFORE, PRUNED_SEASON, pruned_snapshot

    root = str(tmp_path / "store")
    rows = spark.range(600).select(F.col("id").alias("o_orderkey"), (F.lit(PRUNED_SEASON - 1) + F.col("id") % 3).cast("int").alias("season"),
                                   (F.lit(PRUNED_BEFORE - 3) + F.col("id") % 7).cast("int").alias("snapshot"))
    write_run(spark, root, {"orders": rows}, dt.datetime(2024, 1, 1, tzinfo=UTC), partition_by={"orders": ["season", "snapshot"]})
    out = pruned_snapshot(spark, root)
    assert {(r["season"], r["snapshot"]) for r in out.collect()} == {(PRUNED_SEASON, PRUNED_BEFORE)} and out.count() == 29
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()


def test_pick_rules_fold_a_bounded_number_of_rows(spark, monkeypatch):
    """Partitions follow the rows; results are those of a plain count per manager."""
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 20)
    rows = []
    for m in range(60):
        for place in range(1, 5):
            player = {1: 1, 2: 99, 3: None}.get(m % 7, place) if place == 4 else place
            rows.append((m if m < 58 else None, player, 4 if m % 5 == 1 and place == 3 else place,
                         place == 1 or (m % 11 == 3 and place == 2), place == 2 and m % 13 != 4))
    rows += [(57, p, p, None, None) for p in range(1, 200)]
    picks = spark.createDataFrame(
        rows, "manager_id bigint, player_id bigint, squad_position int, is_captain boolean, is_vice_captain boolean")
    known = spark.range(1, 90).select(F.col("id").alias("player_id"))
    out = pick_violations(picks, ["manager_id"], known, size=4)
    assert out.rdd.getNumPartitions() >= len(rows) // 20
    want = {}
    for m in range(58):
        own = [r for r in rows if r[0] == m]
        players = {r[1] for r in own if r[1] is not None}
        broken = [len(own) != 4, len(players) != len(own), {r[2] for r in own} != {1, 2, 3, 4},
                  sum(bool(r[3]) for r in own) != 1, sum(bool(r[4]) for r in own) != 1,
                  any(r[1] is None or not 1 <= r[1] < 90 for r in own)]
        if any(broken):
            want[m] = sum(broken)
    assert {r["manager_id"]: len(r["reasons"]) for r in out.collect()} == want


def test_places_of_large_squads(spark):
    """More places than a word has bits."""
    rows = [(m, p, 69 if m and p == 70 else p, p == 1, p == 2) for m in (0, 1) for p in range(1, 71)]
    picks = spark.createDataFrame(
        rows, "manager_id int, player_id int, squad_position int, is_captain boolean, is_vice_captain boolean")
    out = pick_violations(picks, ["manager_id"], size=70).collect()
    assert [(r["manager_id"], r["reasons"]) for r in out] == [(1, ["places are not 1 to the squad size"])]


def test_archive_joins_lines_once(spark, monkeypatch, tmp_path):
    """Every season's files are written from a table, not from the join again."""
    plain, write = [], DataFrameWriter.csv

    def spy(self, *args, **kwargs):
        plain.append(plain_scan(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "csv", spy)
    orders = [(k, k % 3, dt.datetime(1994 + k % 2, 1 + k, 1)) for k in range(6)]
    lines = [(k, n, 1, n, 2.0, 10.0, 0.0 if n == 2 else 0.1, 0.0, "A", "F") for k in range(6) for n in (1, 2, 3)]
    for name, rows, schema in (
            ("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"),
            ("lineitem", lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
             "l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
             "l_linestatus string"),
            ("supplier", [(1, "one")], "s_suppkey bigint, s_name string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = q_csv_archive(spark, str(tmp_path)).orderBy("season").collect()
    assert plain and all(plain)
    assert [(r["season"], r["rows"], r["points"], r["valued"], r["home_minutes"], r["fixtures"], r["clubs"])
            for r in out] == [("1994-95", 9, 90.0, 6, 6.0, 3, 1), ("1995-96", 9, 90.0, 6, 6.0, 3, 1)]
