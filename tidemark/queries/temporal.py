"""Queries on version resolution, windows, labels, schedules and strength."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.calendar import calendar_windows, label_name
from tidemark.operators.joins import lookup, newest_identity, rows_of, unmapped
from tidemark.operators.sets import overlapping_keys, union_sources
from tidemark.operators.snapshots import (
    complete_horizon_labels,
    recent_form,
    schedule_by_snapshot,
    upcoming_counts,
)
from tidemark.operators.strength import attach_strength, opponent_means, ratings_before
from tidemark.operators.temporal import (
    inconsistent_identity,
    lag_or_own,
    latest_wins,
    participation,
    past_cumulative,
    period_rollup,
)
from tidemark.queries.common import DAY, MONTH, SLOT, day, month_index, rounded, seconds, table

WINDOW = 6
SLOT_HORIZONS = (1, 3, 6)
DAY_HORIZONS = (1, 3, 5)


def slots(spark: SparkSession, folder: str) -> DataFrame:
    """Value per event type and ten minutes."""
    events = table(spark, folder, "events").select(
        "event_type", F.floor(seconds("ts") / 600).alias("slot"), "value")
    return events.groupBy("event_type", "slot").agg(F.sum("value").alias("total"))


def user_days(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", day("ts").alias("day"), "value")
    return events.groupBy("user_id", "day").agg(
        F.sum("value").alias("total"), F.count("*").alias("events"))


def q_latest_wins(spark, folder):
    events = table(spark, folder, "events").select(
        "user_id", "event_type", "ts", "event_id", "value")
    newest = latest_wins(events, ["user_id", "event_type"], ["ts", "event_id"])
    return newest.select("user_id", "event_type", "event_id", "value")


LATEST_WINS = """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                               ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r = 1"""


def q_period_rollup(spark, folder):
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    events = table(spark, folder, "events").select(
        "user_id", day("ts").alias("day"), "ts", "event_id", "event_type",
        seconds("ts").alias("second"), (F.col("event_type") == "purchase").alias("bought"),
        bought.alias("spent"))
    rolled = period_rollup(
        events, ["user_id", "day"], first={"first_type": "event_type"}, order=["ts", "event_id"],
        earliest={"first_second": "second"}, distinct={"types": "event_type"},
        flags={"purchases": "bought"}, sums={"spent": "spent"})
    return rounded(rolled, 4, "spent")


PERIOD_ROLLUP = f"""
SELECT user_id, {DAY.format('ts')} AS day, arg_min(event_type, struct_pack(t := ts, i := event_id))
  AS first_type, CAST(min(floor(epoch(ts))) AS BIGINT) AS first_second,
  count(DISTINCT event_type) AS types,
  CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchases,
  round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent
FROM events GROUP BY ALL"""


def q_identity_conflicts(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return inconsistent_identity(lines, ["l_orderkey", "l_linenumber"], ["l_returnflag"])


IDENTITY_CONFLICTS = """
SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2
HAVING count(DISTINCT l_returnflag) > 1"""

SLOTS_SQL = f"""
s AS (SELECT event_type, {SLOT.format('ts')} AS slot, sum(value) AS v FROM events GROUP BY 1, 2),
b AS (SELECT unnest(range(min(slot), max(slot) + 1)) AS slot FROM s
      EXCEPT SELECT slot FROM s),
g AS (SELECT event_type, slot, v, 1 AS own FROM s UNION ALL
      SELECT e.event_type, b.slot, 0.0, 0 FROM (SELECT DISTINCT event_type FROM s) e, b)"""


def q_recent_form_calendar(spark, folder):
    out = calendar_windows(
        slots(spark, folder), [], ["event_type"], "slot", past={WINDOW: {"recent_mean": "total"}},
        known={WINDOW: "known_slots"})
    return rounded(out.select("event_type", "slot", "recent_mean", "known_slots"), 6, "recent_mean")


RECENT_FORM_CALENDAR = f"""
WITH {SLOTS_SQL}, w AS (
  SELECT event_type, slot, own,
    avg(v) OVER (PARTITION BY event_type ORDER BY slot
                 RANGE BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS m,
    count(v) OVER (PARTITION BY event_type ORDER BY slot
                   RANGE BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS n FROM g)
SELECT event_type, slot, round(m, 6) AS recent_mean, CAST(n AS DOUBLE) AS known_slots
FROM w WHERE own = 1"""


def q_horizon_labels_calendar(spark, folder):
    future = {h: {f"next_{h}": "total"} for h in SLOT_HORIZONS}
    out = calendar_windows(slots(spark, folder), [], ["event_type"], "slot", future=future)
    names = [f"next_{h}" for h in SLOT_HORIZONS]
    return rounded(out.select("event_type", "slot", *names), 4, *names)


def _future_sql(horizons, group: str, period: str) -> str:
    return ", ".join(
        f"CASE WHEN count(v) OVER (PARTITION BY {group} ORDER BY {period} RANGE BETWEEN "
        f"CURRENT ROW AND {h - 1} FOLLOWING) = {h} THEN sum(v) OVER (PARTITION BY {group} "
        f"ORDER BY {period} RANGE BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) END AS f{h}"
        for h in horizons)


HORIZON_LABELS_CALENDAR = f"""
WITH {SLOTS_SQL}, w AS (SELECT event_type, slot, own,
  {_future_sql(SLOT_HORIZONS, 'event_type', 'slot')} FROM g)
SELECT event_type, slot, {', '.join(f'round(f{h}, 4) AS next_{h}' for h in SLOT_HORIZONS)}
FROM w WHERE own = 1"""


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Past mean and future labels on a calendar with blanks, in one exchange."""
    future = {h: {label_name(h): "total"} for h in SLOT_HORIZONS}
    out = calendar_windows(
        slots(spark, folder), [], ["event_type"], "slot", past={WINDOW: {"recent_mean": "total"}},
        future=future, known={WINDOW: "known_slots"})
    return rounded(out, 6, "total", "recent_mean", *[label_name(h) for h in SLOT_HORIZONS])


FLAGSHIP = f"""
WITH {SLOTS_SQL}, w AS (SELECT event_type, slot, own, v,
    avg(v) OVER (PARTITION BY event_type ORDER BY slot
                 RANGE BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS m,
    count(v) OVER (PARTITION BY event_type ORDER BY slot
                   RANGE BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS n,
  {_future_sql(SLOT_HORIZONS, 'event_type', 'slot')} FROM g)
SELECT event_type, slot, round(v, 6) AS total, round(m, 6) AS recent_mean,
  CAST(n AS DOUBLE) AS known_slots,
  {', '.join(f'round(f{h}, 6) AS {label_name(h)}' for h in SLOT_HORIZONS)}
FROM w WHERE own = 1"""


def q_horizon_labels_available(spark, folder):
    days = user_days(spark, folder)
    labels = {h: {f"next_{h}": "total"} for h in DAY_HORIZONS}
    out = complete_horizon_labels(
        days.select("user_id", "day"), days, [], ["user_id"], "day", "day", labels)
    names = [f"next_{h}" for h in DAY_HORIZONS]
    return rounded(out.select("user_id", "day", *names), 4, *names)


DAYS_SQL = f"""d AS (SELECT user_id, {DAY.format('ts')} AS day, sum(value) AS v,
  count(*) AS n FROM events GROUP BY 1, 2)"""
HORIZON_LABELS_AVAILABLE = f"""
WITH {DAYS_SQL}, w AS (SELECT user_id, day, {_future_sql(DAY_HORIZONS, 'user_id', 'day')} FROM d)
SELECT user_id, day, {', '.join(f'round(f{h}, 4) AS next_{h}' for h in DAY_HORIZONS)} FROM w"""


def q_recent_form_present(spark, folder):
    days = user_days(spark, folder)
    appeared, started = participation("total", None, full=60)
    facts = days.withColumns({"appeared": appeared, "started": started})
    out = recent_form(
        days.select("user_id", "day"), facts, [], ["user_id"], "day", "day", 3,
        {"recent_mean": "total", "recent_events": "events", "start_rate": "started"}, "available")
    return rounded(out, 6, "recent_mean", "recent_events", "start_rate")


RECENT_FORM_PRESENT = f"""
WITH {DAYS_SQL}
SELECT user_id, day, round(avg(v) OVER w, 6) AS recent_mean, round(avg(n) OVER w, 6)
  AS recent_events, round(avg(CASE WHEN v >= 60 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS start_rate,
  nullif(count(*) OVER w, 0) AS available
FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)"""


def q_past_cumulative(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    out = past_cumulative(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                          {"spent_before": "o_totalprice"})
    return rounded(out.select("o_custkey", "o_orderkey", "spent_before"), 2, "spent_before")


PAST_CUMULATIVE = """
SELECT o_custkey, o_orderkey, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2)
  AS spent_before FROM orders"""


def q_lag_first_fallback(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    out = lag_or_own(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice",
                     "known_price")
    return out.select("o_custkey", "o_orderkey", "known_price")


LAG_FIRST_FALLBACK = """
SELECT o_custkey, o_orderkey, coalesce(lag(o_totalprice) OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey), o_totalprice) AS known_price FROM orders"""


def games(spark: SparkSession, folder: str) -> DataFrame:
    """Two-sided monthly results: supplier nation against customer nation.

    Folded to one row per month and pairing right after the joins. That table
    is tiny and read several times by ratings and schedules, so it is kept.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_linenumber")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", month_index("o_orderdate").alias("month"))
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("home"))
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("away"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
        suppliers, "l_suppkey").join(customers, "o_custkey")
    return joined.groupBy("month", "home", "away").agg(
        F.count("*").alias("games"), F.sum("l_quantity").alias("home_score"),
        F.sum("l_linenumber").cast("double").alias("away_score")).persist()


GAMES_SQL = f"""
x AS (SELECT {MONTH.format('o_orderdate')} AS month, CAST(s_nationkey AS BIGINT) AS home,
  CAST(c_nationkey AS BIGINT) AS away, l_quantity AS hs, CAST(l_linenumber AS DOUBLE) AS aw
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN customer ON o_custkey = c_custkey),
side AS (SELECT month, home AS club, away AS opponent, true AS at_home, hs AS gf, aw AS ga FROM x
  UNION ALL SELECT month, away, home, false, aw, hs FROM x)"""
GAME_HORIZONS = (1, 3)


def q_upcoming_counts(spark, folder):
    ahead = schedule_by_snapshot(games(spark, folder), [], "month", "snapshot",
                                 max(GAME_HORIZONS), ["home", "away", "games"])
    return upcoming_counts(ahead, [], "snapshot", "month", "home", "away", GAME_HORIZONS, "games")


def _counts_sql(h: int) -> str:
    parts = []
    for label, condition in (("home_", "at_home"), ("away_", "NOT at_home"), ("", "true")):
        parts.append(f"CAST(count(*) FILTER (WHERE ahead < {h} AND {condition}) AS BIGINT) "
                     f"AS upcoming_{label}fixture_count_{h}")
    return ", ".join(parts)


UPCOMING_COUNTS = f"""
WITH {GAMES_SQL}, a AS (SELECT side.*, month - k AS snapshot, k AS ahead
  FROM side, range({max(GAME_HORIZONS)}) AS r(k))
SELECT snapshot, club, {', '.join(_counts_sql(h) for h in GAME_HORIZONS)} FROM a GROUP BY 1, 2"""


def q_strength_before_period(spark, folder):
    results = games(spark, folder)
    asked = results.select("month", F.col("home").alias("club")).unionByName(
        results.select("month", F.col("away").alias("club")))
    out = ratings_before(results, asked, [], "month", "home", "away", "home_score", "away_score",
                         weight="games")
    return rounded(out, 6, "attack_strength", "goals_conceded_strength", "home_factor",
                   "away_factor")


def _ratings_sql(asked: str) -> str:
    return f"""{GAMES_SQL},
folded AS (SELECT month, club, count(*) AS n, sum(gf) AS gf, sum(ga) AS ga FROM side GROUP BY 1, 2),
league AS (SELECT month, count(*) AS n, sum(hs) AS hs, sum(aw) AS aw FROM x GROUP BY 1),
asked AS ({asked}),
club_totals AS (SELECT a.snapshot, a.club, coalesce(sum(f.n), 0) AS m, coalesce(sum(f.gf), 0) AS gf,
  coalesce(sum(f.ga), 0) AS ga FROM asked a LEFT JOIN folded f
  ON f.club = a.club AND f.month < a.snapshot GROUP BY 1, 2),
league_totals AS (SELECT p.snapshot, coalesce(sum(l.n), 0) AS n, sum(l.hs) AS hs, sum(l.aw) AS aw
  FROM (SELECT DISTINCT snapshot FROM asked) p LEFT JOIN league l ON l.month < p.snapshot
  GROUP BY 1),
rate AS (SELECT *, CASE WHEN n > 0 AND (hs + aw) / (2 * n) > 0 THEN (hs + aw) / (2 * n)
  ELSE 1.0 END AS lg FROM league_totals),
ratings AS (SELECT c.snapshot, c.club, c.m,
  CASE WHEN r.n = 0 THEN 1.0 ELSE (c.gf + 5 * lg) / (c.m + 5) / lg END AS attack,
  CASE WHEN r.n = 0 THEN 1.0 ELSE (c.ga + 5 * lg) / (c.m + 5) / lg END AS concede,
  CASE WHEN r.n = 0 THEN 1.0 ELSE r.hs / r.n / lg END AS home_factor,
  CASE WHEN r.n = 0 THEN 1.0 ELSE r.aw / r.n / lg END AS away_factor
  FROM club_totals c JOIN rate r USING (snapshot))"""


STRENGTH_BEFORE_PERIOD = f"""
WITH {_ratings_sql('SELECT DISTINCT month AS snapshot, club FROM side')}
SELECT snapshot AS month, club, CAST(m AS DOUBLE) AS matches, round(attack, 6) AS attack_strength,
  round(concede, 6) AS goals_conceded_strength, round(home_factor, 6) AS home_factor,
  round(away_factor, 6) AS away_factor FROM ratings"""


def q_opponent_means(spark, folder):
    results = games(spark, folder)
    ahead = schedule_by_snapshot(results, [], "month", "snapshot", max(GAME_HORIZONS),
                                 ["home", "away", "games"])
    played = results.withColumnRenamed("month", "snapshot")
    asked = ahead.select("snapshot", F.col("home").alias("club")).unionByName(
        ahead.select("snapshot", F.col("away").alias("club")))
    ratings = ratings_before(played, asked, [], "snapshot", "home", "away", "home_score",
                             "away_score", weight="games")
    out = opponent_means(ahead, ratings, [], "snapshot", "month", "home", "away", GAME_HORIZONS,
                         "games")
    return rounded(out, 6, *[c for c in out.columns if c.startswith("upcoming_")])


def _means_sql(h: int) -> str:
    pieces = {
        "opponent_attack_strength_mean": "o.attack",
        "opponent_goals_conceded_strength_mean": "o.concede",
        "attacking_fixture_factor_mean":
            "o.concede * CASE WHEN at_home THEN o.home_factor ELSE o.away_factor END",
        "defensive_fixture_factor_mean":
            "o.attack * CASE WHEN at_home THEN o.away_factor ELSE o.home_factor END",
    }
    return ", ".join(f"round(avg({e}) FILTER (WHERE ahead < {h}), 6) AS upcoming_{n}_{h}"
                     for n, e in pieces.items())


OPPONENT_MEANS = f"""
WITH {_ratings_sql(f'SELECT DISTINCT month - k AS snapshot, club FROM side, range({max(GAME_HORIZONS)}) AS r(k)')},
a AS (SELECT side.*, month - k AS snapshot, k AS ahead FROM side, range({max(GAME_HORIZONS)}) AS r(k))
SELECT a.snapshot, a.club, {', '.join(_means_sql(h) for h in GAME_HORIZONS)}
FROM a JOIN ratings o ON o.snapshot = a.snapshot AND o.club = a.opponent GROUP BY 1, 2"""


def q_strength_features(spark, folder):
    """Own strength and opposition next to nation-month rows (A8, A9, J4)."""
    results = games(spark, folder)
    clubs = results.select("month", F.col("home").alias("nation")).unionByName(
        results.select("month", F.col("away").alias("nation"))).distinct().withColumnRenamed(
        "month", "snapshot")
    ahead = schedule_by_snapshot(results, [], "month", "snapshot", 1, ["home", "away", "games"])
    asked = clubs.select("snapshot", F.col("nation").alias("club"))
    ratings = ratings_before(
        results.withColumnRenamed("month", "snapshot"), asked, [], "snapshot", "home", "away",
        "home_score", "away_score", weight="games")
    opposition = opponent_means(ahead, ratings, [], "snapshot", "month", "home", "away", (1,),
                                "games")
    out = attach_strength(clubs, ratings, opposition, [], "snapshot", "nation", (1,))
    return rounded(out, 6, *[c for c in out.columns if c not in ("snapshot", "nation")])


STRENGTH_FEATURES = f"""
WITH {_ratings_sql('SELECT DISTINCT month AS snapshot, club FROM side')},
a AS (SELECT side.*, month AS snapshot, 0 AS ahead FROM side),
m AS (SELECT a.snapshot, a.club, {_means_sql(1)} FROM a JOIN ratings o
  ON o.snapshot = a.snapshot AND o.club = a.opponent GROUP BY 1, 2)
SELECT r.snapshot, r.club AS nation, round(r.attack, 6) AS club_attack_strength,
  round(r.concede, 6) AS club_goals_conceded_strength, CAST(r.m AS DOUBLE) AS club_strength_matches,
  m.* EXCLUDE (snapshot, club) FROM ratings r JOIN m USING (snapshot, club)"""


def q_dimension_lookup(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    out = lookup(lookup(customers, nations, ["n_nationkey"], unique=True), regions,
                 ["n_regionkey"], unique=True)
    return out.select("c_custkey", "n_name", "r_name")


DIMENSION_LOOKUP = """
SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""


def q_unmapped_keys(spark, folder):
    """Customers of orders that the customers of low balance do not have: known misses."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    poor = table(spark, folder, "customer").filter("c_acctbal < 5000").select("c_custkey")
    return unmapped(orders, poor, ["c_custkey"])


UNMAPPED_KEYS = """
SELECT DISTINCT o_custkey AS c_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)"""


def q_newest_snapshot(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("season"),
        month_index("o_orderdate").alias("snapshot"))
    identity = newest_identity(orders, ["season", "snapshot"], "snapshot")
    return rows_of(orders, identity)


NEWEST_SNAPSHOT = f"""
SELECT o_orderkey, o_custkey, o_totalprice, year(o_orderdate) AS season,
  {MONTH.format('o_orderdate')} AS snapshot FROM orders
WHERE {MONTH.format('o_orderdate')} = (SELECT max({MONTH.format('o_orderdate')}) FROM orders)"""


def q_union_sources(spark, folder):
    orders = table(spark, folder, "orders")
    finished = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    others = orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority")
    return union_sources({"finished": finished, "other": others})


UNION_SOURCES = """
SELECT o_orderkey, o_totalprice, NULL AS o_orderpriority, 'finished' AS source FROM orders
WHERE o_orderstatus = 'F' UNION ALL
SELECT o_orderkey, NULL, o_orderpriority, 'other' FROM orders WHERE o_orderstatus <> 'F'"""


def q_overlapping_keys(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    parts = {s: orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus")
             for s in ("F", "O", "P")}
    return overlapping_keys(union_sources(parts), ["o_custkey", "o_orderpriority"])


OVERLAPPING_KEYS = """
SELECT o_custkey, o_orderpriority, count(*) AS rows, count(DISTINCT o_orderstatus) AS sources
FROM orders GROUP BY 1, 2 HAVING count(*) > 1"""

def _order_moments(spark, folder):
    """Orders as probes: a user by customer, noon of one of thirty days by order date."""
    return table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 100).alias("user_id"),
        (F.pmod(day("o_orderdate"), F.lit(30)) * 86400 + ASOF_START + 43200).alias("at"))


def q_asof_orders(spark, folder):
    """Every order with its user's newest event at or before its moment, ties by id."""
    events = table(spark, folder, "events").select(
        "user_id", (F.floor(seconds("ts") / 3600) * 3600).alias("event_at"), "event_id", "event_type", "value")
    return asof_join(_order_moments(spark, folder), events, ["user_id"], "at", "event_at",
                     ["event_id", "event_type", "value"], ["event_id"])


ASOF_START = 1704067200  # 2024-01-01
ASOF_ORDERS = f"""
WITH o AS (SELECT o_orderkey, o_custkey % 100 AS user_id,
  ({DAY.format('o_orderdate')} % 30) * 86400 + {ASOF_START} + 43200 AS at FROM orders),
e AS (SELECT user_id, event_at, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
  arg_max(value, event_id) AS value FROM (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS event_at
  FROM events) GROUP BY 1, 2)
SELECT o.o_orderkey, o.user_id, o.at, e.event_at, e.event_id, e.event_type, e.value
FROM o ASOF LEFT JOIN e ON o.user_id = e.user_id AND o.at >= e.event_at"""


def q_asof_previous_purchase(spark, folder):
    """Every event with its user's last purchase strictly before it, within three days."""
    events = table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", (F.floor(seconds("ts") / 3600)).alias("hour"))
    bought = table(spark, folder, "events").filter("event_type = 'purchase'").select(
        "user_id", F.floor(seconds("ts") / 3600).alias("bought"), F.col("event_id").alias("purchase_id"),
        F.col("value").alias("paid"))
    return asof_join(events, bought, ["user_id"], "hour", "bought", ["purchase_id", "paid"], ["purchase_id"],
                     strict=True, oldest=F.col("hour") - 72)


ASOF_PREVIOUS_PURCHASE = """
WITH e AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events),
b AS (SELECT user_id, hour AS bought, max(event_id) AS purchase_id, arg_max(value, event_id) AS paid
  FROM e WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, e.user_id, e.event_type, e.hour, CASE WHEN e.hour - b.bought <= 72 THEN b.bought END AS bought,
  CASE WHEN e.hour - b.bought <= 72 THEN b.purchase_id END AS purchase_id,
  CASE WHEN e.hour - b.bought <= 72 THEN b.paid END AS paid
FROM e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.hour > b.bought"""


QUERIES = {
    "latest_wins": (q_latest_wins, LATEST_WINS),
    "period_rollup": (q_period_rollup, PERIOD_ROLLUP),
    "identity_conflicts": (q_identity_conflicts, IDENTITY_CONFLICTS),
    "recent_form_calendar": (q_recent_form_calendar, RECENT_FORM_CALENDAR),
    "horizon_labels_calendar": (q_horizon_labels_calendar, HORIZON_LABELS_CALENDAR),
    "past_and_future_windows": (flagship, FLAGSHIP),
    "horizon_labels_available": (q_horizon_labels_available, HORIZON_LABELS_AVAILABLE),
    "recent_form_present": (q_recent_form_present, RECENT_FORM_PRESENT),
    "past_cumulative": (q_past_cumulative, PAST_CUMULATIVE),
    "lag_first_fallback": (q_lag_first_fallback, LAG_FIRST_FALLBACK),
    "upcoming_counts": (q_upcoming_counts, UPCOMING_COUNTS),
    "strength_before_period": (q_strength_before_period, STRENGTH_BEFORE_PERIOD),
    "opponent_means": (q_opponent_means, OPPONENT_MEANS),
    "strength_features": (q_strength_features, STRENGTH_FEATURES),
    "dimension_lookup": (q_dimension_lookup, DIMENSION_LOOKUP),
    "unmapped_keys": (q_unmapped_keys, UNMAPPED_KEYS),
    "newest_snapshot": (q_newest_snapshot, NEWEST_SNAPSHOT),
    "asof_orders": (q_asof_orders, ASOF_ORDERS),
    "asof_previous_purchase": (q_asof_previous_purchase, ASOF_PREVIOUS_PURCHASE),
    "union_sources": (q_union_sources, UNION_SOURCES),
    "overlapping_keys": (q_overlapping_keys, OVERLAPPING_KEYS),
}
