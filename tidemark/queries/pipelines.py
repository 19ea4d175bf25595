"""Queries on the run store, file inventory, reference populations and models."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.ml.features import ModelInputs
from tidemark.ml.training import calibrate, compare
from tidemark.operators.evaluation import brier_scores
from tidemark.operators.joins import newest_identity, rows_of
from tidemark.operators.rules import PositionRule, SquadRules
from tidemark.operators.temporal import latest_wins, past_cumulative
from tidemark.plans.reference import reference_population
from tidemark.queries.common import MONTH, month_index, rounded, seconds, table
from tidemark.session import checkpointed, shared_folder
from tidemark.sources.archive import file_inventory, read_seasons, relative_to, verify_inventory
from tidemark.sources.quarantine import read_csv_records, read_json_records, write_quarantined
from tidemark.sources.runs import (
    manifests,
    nested_to_json,
    read_ordered,
    read_versions,
    register_views,
    registry,
    run_id,
    write_run,
)


def q_inventory_check(spark, folder):
    """Every table file against a manifest with tampered, absent and added entries."""
    files = relative_to(file_inventory(spark, folder, "*.parquet"), folder)
    name = F.col("relative_path")
    manifest = files.filter(name != "region.parquet").select(
        F.when(name == "nation.parquet", "ghost.parquet").otherwise(name).alias("relative_path"),
        F.when(name == "part.parquet", F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
        F.when(name == "orders.parquet", F.reverse("sha256")).otherwise(F.upper("sha256")).alias("sha256"))
    return verify_inventory(files, manifest)


INVENTORY_CHECK = """
SELECT name || '.parquet' AS relative_path, CASE name WHEN 'region' THEN 'unexpected'
  WHEN 'nation' THEN 'unexpected' WHEN 'part' THEN 'size differs' WHEN 'orders' THEN 'checksum differs'
  ELSE 'ok' END AS status
FROM (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
  'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name)
UNION ALL SELECT 'ghost.parquet', 'missing'"""


def _new_root(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _order_runs(spark, folder, root):
    """Two finished runs whose types drift, and one without a manifest.

    The second run rewrites the finished orders, with a priority as BIGINT beside
    INT and a note that the first run lacks.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    day = [datetime(2024, 1, d, tzinfo=timezone.utc) for d in (1, 2, 3)]
    first = orders.withColumns({"ingested_at": F.lit("2024-01-01"), "priority": F.lit(1)})
    finished = orders.filter("o_orderstatus = 'F'")
    second = finished.withColumns({
        "o_totalprice": F.col("o_totalprice") + 1, "ingested_at": F.lit("2024-01-02"),
        "priority": F.lit(2).cast("bigint"), "note": F.lit("again")})
    for moment, rows, week in ((day[0], first, 1), (day[1], second, 2)):
        write_run(spark, f"{root}/facts", {"orders": rows}, moment, {"season": "s", "snapshot_gameweek": week})
    finished.withColumn("ingested_at", F.lit("2024-01-03")).write.parquet(f"{root}/facts/{run_id(day[2])}/orders")


def q_run_store_views(spark, folder):
    """The store's newest-wins view over drifted runs; an unfinished run is not seen."""
    root = _new_root(spark, "store")
    _order_runs(spark, folder, root)
    view = f"orders_{uuid.uuid4().hex}"
    key, newest = ["o_orderkey"], ["ingested_at", "filename"]
    register_views(spark, root, {}, {view: ("facts", "orders", T.StructType([]), key, newest)})
    out = spark.table(view).select("o_orderkey", "o_totalprice", F.col("priority").cast("bigint").alias("priority"), "note")
    return rounded(out, 2, "o_totalprice")


RUN_STORE_VIEWS = """
SELECT o_orderkey, round(o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, 2)
  AS o_totalprice, CAST(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS priority,
  CASE WHEN o_orderstatus = 'F' THEN 'again' END AS note FROM orders"""


def q_run_registry(spark, folder):
    """Rows and value of each finished run beside what its manifest says."""
    root = _new_root(spark, "registry")
    _order_runs(spark, folder, root)
    versions = read_versions(spark, f"{root}/facts", "orders", T.StructType([]))
    run = F.regexp_extract("filename", "/facts/([^/]+)/orders/", 1)
    sums = versions.groupBy(run.alias("snapshot_id")).agg(
        F.count("*").alias("rows"), F.sum("o_totalprice").alias("total"))
    known = registry(spark, f"{root}/facts").select("snapshot_id", "season", "snapshot_gameweek", "created_at_utc")
    return rounded(known.join(sums, "snapshot_id", "left").select(
        "season", "snapshot_gameweek", F.substring("created_at_utc", 1, 10).alias("day"), "rows", "total"), 1, "total")


RUN_REGISTRY = """
SELECT 's' AS season, CAST(1 AS BIGINT) AS snapshot_gameweek, '2024-01-01' AS day, count(*) AS rows,
  round(sum(o_totalprice), 1) AS total FROM orders
UNION ALL SELECT 's', 2, '2024-01-02', count(*), round(sum(o_totalprice + 1), 1) FROM orders
WHERE o_orderstatus = 'F'"""


def q_csv_archive(spark, folder):
    """Order lines written as season archives in CSV and read back with typed columns.

    A value that is no number, a leaking column and files in season folders are
    part of it; the result sums each season's matches, fixtures and teams. Lines meet
    their orders once, in a table that the seasons' files are written from.
    """
    root = _new_root(spark, "archive")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("round"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("kickoff_time"))
    lines = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "year", F.col("l_returnflag").alias("name"), F.col("l_returnflag").alias("position"),
        F.col("l_linestatus").alias("team"), F.col("l_tax").alias("xP"), F.col("l_partkey").alias("element"),
        F.col("l_orderkey").alias("fixture"), "round", "kickoff_time", F.col("l_quantity").alias("minutes"),
        F.col("l_extendedprice").alias("total_points"),
        F.when(F.col("l_discount") == 0, F.lit("n/a")).otherwise(F.col("l_discount").cast("string")).alias("value"),
        (F.col("l_linenumber") == 1).alias("was_home"))
    joined = _new_root(spark, "archive-lines")
    lines.write.parquet(joined)
    lines = spark.read.parquet(joined)
    games = orders.select("year", F.col("o_orderkey").alias("id"), F.col("round").alias("event"),
                          F.col("o_custkey").alias("team_h"), F.col("o_custkey").alias("team_a"), "kickoff_time")
    teams = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_name").alias("short_name"))
    years = [r["year"] for r in orders.select("year").distinct().orderBy("year").collect()]
    seasons = [f"{y}-{(y + 1) % 100:02d}" for y in years]
    for year, season in zip(years, seasons):
        for rows, path in ((lines.filter(F.col("year") == year).drop("year"), "gws/merged_gw.csv"),
                           (games.filter(F.col("year") == year).drop("year"), "fixtures.csv"), (teams, "teams.csv")):
            rows.write.option("header", "true").csv(f"{root}/{season}/{path}")
    tables = read_seasons(spark, root, seasons)
    matches = tables["matches"].groupBy("season").agg(
        F.count("*").alias("rows"), F.sum("total_points").alias("points"), F.count("value").alias("valued"),
        F.sum(F.when(F.lower("was_home") == "true", F.col("minutes"))).alias("home_minutes"))
    fixtures = tables["fixtures"].groupBy("season").agg(F.count("*").alias("fixtures"), F.sum("event").alias("events"))
    clubs = tables["teams"].groupBy("season").agg(F.count("*").alias("clubs"))
    out = matches.join(fixtures, "season").join(clubs, "season").withColumn(
        "leaks", F.lit("xP" in tables["matches"].columns))
    return rounded(out, 1, "points", "home_minutes", "events")


CSV_ARCHIVE = """
WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders),
g AS (SELECT y, count(*) AS rows, round(sum(l_extendedprice), 1) AS points,
    count(*) FILTER (WHERE l_discount <> 0) AS valued,
    round(sum(l_quantity) FILTER (WHERE l_linenumber = 1), 1)::DOUBLE AS home_minutes
  FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY 1),
f AS (SELECT y, count(*) AS fixtures, sum(m)::DOUBLE AS events FROM o GROUP BY 1)
SELECT y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, rows, points, valued, home_minutes,
  fixtures, events, (SELECT count(*) FROM supplier) AS clubs, false AS leaks FROM g JOIN f USING (y)"""


def q_run_store_latest(spark, folder):
    """Orders written as two runs, read back with the newest version winning.

    The first run has every order; the second rewrites the finished ones.
    """
    root = f"{shared_folder(spark)}/runs-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = orders.withColumn("ingested_at", F.lit("2024-01-01"))
    second = orders.filter("o_orderstatus = 'F'").select(
        "o_orderkey", "o_orderstatus", (F.col("o_totalprice") + 1).alias("o_totalprice"),
        F.lit("2024-01-02").alias("ingested_at"))
    for day, rows in ((1, first), (2, second)):
        write_run(spark, root, {"orders": rows}, datetime(2024, 1, day, tzinfo=timezone.utc))
    versions = read_versions(spark, root, "orders", T.StructType([]))
    newest = latest_wins(versions, ["o_orderkey"], ["ingested_at", "filename"])
    return rounded(newest.select("o_orderkey", "o_totalprice", "ingested_at"), 2, "o_totalprice")


RUN_STORE_LATEST = """
SELECT o_orderkey, round(o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, 2)
  AS o_totalprice, CASE WHEN o_orderstatus = 'F' THEN '2024-01-02' ELSE '2024-01-01' END
  AS ingested_at FROM orders"""


def q_nested_to_json(spark, folder):
    """Order facts nested as objects, written as text with sorted keys."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.struct(
        F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"),
    ).alias("facts"))
    return nested_to_json(orders)


NESTED_TO_JSON = """
SELECT o_orderkey, '{"customer":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS facts
FROM orders"""

# All part types take part.
DRAFT = SquadRules(
    squad_size=12, starting_size=8, budget=96.0, max_per_club=3, positions=(
        PositionRule("ECONOMY", "GKP", 2, 1, 1), PositionRule("LARGE", "DEF", 2, 1, 2),
        PositionRule("SMALL", "WBK", 2, 1, 2), PositionRule("MEDIUM", "MID", 2, 1, 2),
        PositionRule("STANDARD", "WNG", 2, 1, 2), PositionRule("PROMO", "FWD", 2, 1, 2)))


def _population(spark, folder, strategy):
    parts = table(spark, folder, "part")
    players = parts.select(
        F.col("p_partkey").alias("player_id"), F.col("p_type").alias("position_id"),
        F.col("p_brand").alias("club_id"), (F.col("p_size") / 10.0 + 4.0).alias("price"),
        (F.col("p_size") * 1.0).alias("ownership_percent"), F.lit("a").alias("status"))
    sold = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("player_id")).agg(
        F.avg("l_quantity").alias("predicted_points_1"))
    out = reference_population(players, sold, DRAFT, 1, size=200, strategy=strategy, seed=2026,
                               target_cost=84.0, budget_band=12.0)
    points = [c for c in out.columns if c.endswith("_points")]
    return rounded(out.select("squad_id", "strategy", "total_cost", *points), 4, "total_cost",
                   *points)


def q_reference_human(spark, folder):
    return _population(spark, folder, "human_like")


def q_reference_price_aware(spark, folder):
    return _population(spark, folder, "price_aware")


def customer_months(spark, folder):
    """Monthly spending of customers with past-only features and a label."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("player_id"), month_index("o_orderdate").alias("month"),
        "o_totalprice")
    months = orders.groupBy("player_id", "month").agg(
        F.sum("o_totalprice").alias("label"), F.count("*").alias("orders"))
    past = past_cumulative(months, ["player_id"], ["month"],
                           {"spent": "label", "bought": "orders"})
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("player_id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"))
    joined = past.join(customers, "player_id")
    return joined.select(
        "player_id", F.expr("(month - 1) div 12").alias("season"),
        ((F.col("month") - 1) % 12 + 1).alias("snapshot_gameweek"),
        F.col("month").alias("snapshot_timestamp"), "label", "balance", "segment", "bought",
        F.try_divide("spent", "bought").alias("recent_points_mean_3"))


MODEL_SCHEMA = ModelInputs.of(["recent_points_mean_3", "balance", "bought"], ["segment"])


def q_train_select(spark, folder):
    """Candidates compared on purged rolling origins; their leaderboard."""
    result = compare(
        customer_months(spark, folder), 1, "points", label="label", schema=MODEL_SCHEMA)
    return rounded(result.leaderboard.select("model", "rows", "mae", "rmse"), 4, "mae", "rmse")


def q_calibrated_probability(spark, folder):
    """Chance of a second order in a month: raw score against its calibration."""
    rows = customer_months(spark, folder)
    orders = table(spark, folder, "orders").groupBy(
        F.col("o_custkey").alias("player_id"),
        month_index("o_orderdate").alias("snapshot_timestamp")
    ).agg((F.count("*") > 1).cast("double").alias("actual"))
    scored = checkpointed(rows.join(orders, ["player_id", "snapshot_timestamp"]).select(
        F.col("season").alias("snapshot_timestamp"), "actual",
        F.least(F.col("bought") / 20.0, F.lit(1.0)).alias("prediction")))
    sigmoid, _ = calibrate(scored)
    both = sigmoid.transform(scored.withColumn("raw", F.col("prediction")))
    return rounded(brier_scores(both, "actual", {"raw": "raw", "calibrated": "prediction"}), 6,
                   "raw", "calibrated")


def q_run_manifest(spark, folder):
    """Rows per table as counted while they were written, over two runs of three tables."""
    root = _new_root(spark, "manifest")
    orders, events = table(spark, folder, "orders"), table(spark, folder, "events")
    wrong = {"orders": {"a price": F.col("o_totalprice") >= 0}}
    write_run(spark, root, {"orders": orders, "events": events}, datetime(2024, 1, 1, tzinfo=timezone.utc), require=wrong)
    write_run(spark, root, {"orders": orders.filter("o_orderstatus = 'F'"), "parts": table(spark, folder, "part")},
              datetime(2024, 1, 2, tzinfo=timezone.utc), partition_by={"parts": ["p_brand"]}, require=wrong)
    return manifests(spark, root).select(F.substring("snapshot_id", 1, 8).alias("day"), "table", "rows")


RUN_MANIFEST = """
SELECT '20240101' AS day, 'orders' AS table, count(*) AS rows FROM orders
UNION ALL SELECT '20240101', 'events', count(*) FROM events
UNION ALL SELECT '20240102', 'orders', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT '20240102', 'parts', count(*) FROM part"""


def q_ordered_sink(spark, folder):
    """Events written in order of type, user, hour and id, read back with their place."""
    root = _new_root(spark, "ordered")
    events = table(spark, folder, "events").select(
        "event_type", "user_id", F.floor(seconds("ts") / 3600).alias("hour"), "event_id", "value")
    run = write_run(spark, root, {"events": events}, datetime(2024, 1, 1, tzinfo=timezone.utc),
                    order_by={"events": ["event_type", "user_id", "hour", "event_id"]})
    return read_ordered(spark, f"{run}/events")


ORDERED_SINK = """
WITH e AS (SELECT event_type, user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_id, value FROM events)
SELECT *, row_number() OVER (ORDER BY event_type, user_id, hour, event_id) - 1 AS position FROM e"""

PRUNED_SEASON, PRUNED_BEFORE = 1998, 1998 * 12 + 9


def pruned_snapshot(spark, root):
    """Rows of the newest snapshot of a season up to a month, from a store in snapshot folders."""
    versions = read_versions(spark, root, "orders", T.StructType([]))
    identity = newest_identity(versions.select("season", "snapshot"), ["season", "snapshot"], "snapshot",
                               {"season": PRUNED_SEASON}, F.lit(PRUNED_BEFORE))
    return rows_of(versions, identity)


def q_pruned_snapshot(spark, folder):
    """Orders stored by season and month; only the folder of the newest month asked for is read."""
    root = _new_root(spark, "pruned")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("season"), month_index("o_orderdate").alias("snapshot"))
    write_run(spark, root, {"orders": orders.repartition("season", "snapshot")}, datetime(2024, 1, 1, tzinfo=timezone.utc),
              partition_by={"orders": ["season", "snapshot"]})
    return pruned_snapshot(spark, root).select(
        "o_orderkey", "o_totalprice", F.col("season").cast("bigint").alias("season"), F.col("snapshot").cast("bigint").alias("snapshot"))


PRUNED_SNAPSHOT = f"""
WITH o AS (SELECT o_orderkey, o_totalprice, year(o_orderdate) AS season, {MONTH.format('o_orderdate')} AS snapshot FROM orders)
SELECT * FROM o WHERE season = {PRUNED_SEASON} AND snapshot = (
  SELECT max(snapshot) FROM o WHERE season = {PRUNED_SEASON} AND snapshot <= {PRUNED_BEFORE})"""


EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def _damaged_events(spark, folder, root):
    """Events as JSON lines and as CSV, of which some are cut, mistyped, incomplete or against a rule."""
    kind = F.col("event_id") % 97
    events = table(spark, folder, "events").select(
        "event_id", F.when(kind != 2, F.col("user_id")).alias("user_id"), "event_type",
        F.when(kind == 1, F.lit("dear")).when(kind == 3, F.lit("-1.5")).otherwise(F.col("value").cast("string")).alias("value"))
    value = F.when(kind == 1, F.lit('"dear"')).otherwise(F.col("value"))
    line = F.concat(F.lit('{"event_id":'), "event_id", F.when(kind != 2, F.concat(F.lit(',"user_id":'), "user_id")).otherwise(""),
                    F.lit(',"event_type":"'), "event_type", F.lit('","value":'), value, F.lit("}"))
    text = F.concat_ws(",", "event_id", F.coalesce(F.col("user_id").cast("string"), F.lit("")), "event_type", "value")
    events.select(F.when(kind == 0, F.substring(line, 1, 12)).otherwise(line).alias("v")).write.text(f"{root}/json")
    head = spark.createDataFrame([(",".join(EVENT_SCHEMA.names),)], "v string")
    head.union(events.select(F.when(kind == 0, F.concat(text, F.lit(",more"))).otherwise(text).alias("v"))).write.text(f"{root}/csv")


def q_quarantine(spark, folder):
    """Records of both formats by what is wrong with them, written as runs and read back."""
    root = _new_root(spark, "quarantine")
    _damaged_events(spark, folder, root)
    rules = {"negative": F.col("value") >= 0}
    out = None
    for kind, read in (("json", read_json_records), ("csv", read_csv_records)):
        run = write_quarantined(spark, f"{root}/runs-{kind}", "events", read(
            spark, f"{root}/{kind}", EVENT_SCHEMA, ["event_id", "user_id"], rules))
        good = spark.read.parquet(f"{run}/events").select(
            F.lit(kind).alias("source"), F.lit("good").alias("reason"), "event_id", F.round("value", 6).alias("value"))
        bad = spark.read.parquet(f"{run}/events-rejects").select(
            F.lit(kind).alias("source"), F.array_join("reasons", "; ").alias("reason"),
            F.regexp_extract("line", '^(?:[{]"event_id":)?([0-9]*)', 1).try_cast("bigint").alias("event_id"), F.lit(None).cast("double").alias("value"))
        both = good.union(bad)
        out = both if out is None else out.union(both)
    return out.groupBy("source", "reason").agg(
        F.count("*").alias("rows"), F.sum(F.when((F.col("reason") != "malformed") | (F.col("source") == "csv"), F.col("event_id"))).alias("ids"),
        F.round(F.sum("value"), 2).alias("total"))


QUARANTINE = """
WITH e AS (SELECT event_id, value, event_id % 97 AS kind FROM events),
r AS (SELECT source, CASE WHEN kind < 2 THEN 'malformed' WHEN kind = 2 THEN 'lacks user_id'
  WHEN kind = 3 THEN 'negative' ELSE 'good' END AS reason, * FROM e, (SELECT unnest(['json', 'csv']) AS source))
SELECT source, reason, count(*) AS rows, CAST(sum(CASE WHEN reason <> 'malformed' OR source = 'csv' THEN event_id END) AS BIGINT)
  AS ids, round(sum(CASE WHEN reason = 'good' THEN value END), 2) AS total FROM r GROUP BY 1, 2"""


QUERIES = {
    "quarantine": (q_quarantine, QUARANTINE),
    "run_manifest": (q_run_manifest, RUN_MANIFEST),
    "ordered_sink": (q_ordered_sink, ORDERED_SINK),
    "pruned_snapshot": (q_pruned_snapshot, PRUNED_SNAPSHOT),
    "inventory_check": (q_inventory_check, INVENTORY_CHECK),
    "run_store_views": (q_run_store_views, RUN_STORE_VIEWS),
    "run_registry": (q_run_registry, RUN_REGISTRY),
    "csv_archive": (q_csv_archive, CSV_ARCHIVE),
    "run_store_latest": (q_run_store_latest, RUN_STORE_LATEST),
    "nested_to_json": (q_nested_to_json, NESTED_TO_JSON),
    "reference_human_like": (q_reference_human, None),
    "reference_price_aware": (q_reference_price_aware, None),
    "train_select": (q_train_select, None),
    "calibrated_probability": (q_calibrated_probability, None),
}
