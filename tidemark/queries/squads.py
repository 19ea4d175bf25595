"""Queries on squads, line-ups, swaps, ratings, sampling and name matching.

Orders stand in for squads and their parts for members.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.coerce import lenient_long, strict_boolean
from tidemark.functions.numeric import clip, normal_quantile_sql, ticks
from tidemark.operators.conditioned import conditioned_inclusion
from tidemark.operators.evaluation import leaderboard, prediction_metrics
from tidemark.operators.joins import match_names
from tidemark.operators.managers import (
    formations,
    manager_audit,
    pick_violations,
    sample_audit,
    selection_rates,
    squad_costs,
)
from tidemark.operators.names import rank_names
from tidemark.operators.ratings import (
    component_ratings,
    inclusion_calibration,
    percentile_scores,
)
from tidemark.operators.reconcile import reconcile
from tidemark.operators.rules import PositionRule, SquadRules
from tidemark.operators.sampling import cluster_sample, product_subsets, successive_draws
from tidemark.operators.squads import (
    adjust_for_availability,
    best_lineup,
    captain_value,
    history_readiness,
    legal_draws,
    marginals,
    squad_report,
)
from tidemark.operators.transfers import (
    best_replacements,
    best_single_swap,
    budgets,
    selectable,
    selling_prices,
    transfer_summary,
)
from tidemark.queries.common import rounded, table
from tidemark.session import checkpointed

FLAGS = SquadRules(
    squad_size=9, starting_size=5, budget=1e9, max_per_club=9, positions=(
        PositionRule("A", "A", 3, 1, 2), PositionRule("N", "N", 3, 1, 3),
        PositionRule("R", "R", 3, 1, 3)))


def order_parts(spark, folder):
    """Distinct parts of each order with their value and lowest return flag."""
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_extendedprice").alias("points"), F.min("l_returnflag").alias("flag"))


MEMBERS_SQL = """
m AS (SELECT l_orderkey, l_partkey, sum(l_extendedprice) AS points, min(l_returnflag) AS flag
  FROM lineitem GROUP BY 1, 2)"""


def q_best_lineup(spark, folder):
    out = best_lineup(order_parts(spark, folder), FLAGS, "l_orderkey", "l_partkey", "flag",
                      "points", bench=False)
    shown = out.withColumn("starting_xi", F.array_join(F.array_sort("starting_xi"), ","))
    return rounded(shown, 2, "starting_xi_points", "captain_points")


BEST_LINEUP = f"""
WITH {MEMBERS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, flag ORDER BY points DESC, l_partkey)
  AS k, row_number() OVER (PARTITION BY l_orderkey, flag ORDER BY points DESC, l_partkey) AS i FROM m),
f AS (SELECT a.k AS a, n.k AS n, q.k AS r FROM range(1, 3) a(k), range(1, 4) n(k), range(1, 4) q(k)
  WHERE a.k + n.k + q.k = 5),
c AS (SELECT l_orderkey, a, n, r.r, points, l_partkey FROM r AS x JOIN f AS r
  ON (flag = 'A' AND k <= a) OR (flag = 'N' AND k <= n) OR (flag = 'R' AND k <= r.r)),
t AS (SELECT l_orderkey, a, n, r, sum(points) AS p, list(l_partkey ORDER BY points DESC, l_partkey)
  AS ids, max(points) AS top FROM c GROUP BY ALL HAVING count(*) = 5),
w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC) AS z FROM t)
SELECT l_orderkey, round(p, 2) AS starting_xi_points,
  array_to_string(list_sort(ids), ',') AS starting_xi, ids[1] AS captain, ids[2] AS vice_captain,
  round(top, 2) AS captain_points FROM w WHERE z = 1"""


SWAP_CAP = 2
MAX_TICKS = 2**15


def q_single_swap(spark, folder):
    """Best same-brand replacement by size for each part of an order.

    Price limit: the part's own price. Club: the part's type, at most two others.
    """
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("player_id"), F.col("p_brand").alias("position_id"),
        F.col("p_type").alias("club_id"), ticks(F.col("p_retailprice")).alias("price_ticks"),
        F.col("p_size").alias("points"))
    held = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("squad_id"), F.col("l_partkey").alias("player_id")).distinct()
    members = held.join(parts, "player_id").withColumn("limit_ticks", F.col("price_ticks"))
    out = best_replacements(members, parts, MAX_TICKS, SWAP_CAP)
    gains = out.join(
        parts.select(F.col("player_id").alias("out_id"), F.col("points").alias("out_points")),
        "out_id")
    best = gains.groupBy("squad_id").agg(F.max_by(
        F.struct("out_id", "in_id", (F.col("in_points") - F.col("out_points")).alias("gain")),
        F.struct(F.col("in_points") - F.col("out_points"), -F.col("in_id"), -F.col("out_id")),
    ).alias("w"))
    return best.select("squad_id", "w.*")


SINGLE_SWAP = f"""
WITH h AS (SELECT DISTINCT l_orderkey AS squad_id, l_partkey AS out_id FROM lineitem),
m AS (SELECT h.*, p_brand, p_type, p_retailprice, p_size FROM h JOIN part ON p_partkey = out_id),
k AS (SELECT squad_id, p_type, count(*) AS n FROM m GROUP BY 1, 2),
c AS (SELECT m.squad_id, m.out_id, p.p_partkey AS in_id,
    CAST(p.p_size - m.p_size AS DOUBLE) AS gain
  FROM m JOIN part p ON p.p_brand = m.p_brand AND p.p_retailprice <= m.p_retailprice + 1e-9
  LEFT JOIN k ON k.squad_id = m.squad_id AND k.p_type = p.p_type
  LEFT JOIN h ON h.squad_id = m.squad_id AND h.out_id = p.p_partkey
  WHERE h.out_id IS NULL AND
    coalesce(k.n, 0) - CASE WHEN p.p_type = m.p_type THEN 1 ELSE 0 END < {SWAP_CAP})
SELECT squad_id, out_id, in_id, gain FROM (SELECT *, row_number() OVER (PARTITION BY squad_id
  ORDER BY gain DESC, in_id, out_id) AS r FROM c) WHERE r = 1"""


TRADE = SquadRules(
    squad_size=6, starting_size=3, budget=1e9, max_per_club=SWAP_CAP, positions=tuple(
        PositionRule(i, f"P{i}", 2, 0, 2) for i in (1, 2, 3)))


def q_trade_value(spark, folder):
    """The best single swap of each order, or none, with what it is worth then and without.

    Roles come from the part's type, clubs from its brand; an order has its own
    value and up to 0.3 more to spend; a swap costs two points more than one is free.
    """
    kind = F.col("p_type")
    role = F.when(kind.isin("ECONOMY", "LARGE"), 1).when(kind.isin("MEDIUM", "PROMO"), 2).otherwise(3)
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("player_id"), role.alias("position_id"), F.col("p_brand").alias("club_id"),
        ticks(F.col("p_retailprice")).alias("price_ticks"), F.col("p_size").cast("double").alias("points"))
    held = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("squad_id"), F.col("l_partkey").alias("player_id")).distinct()
    members = checkpointed(held.join(parts, "player_id").withColumnRenamed("price_ticks", "sell_ticks"))
    money = members.groupBy("squad_id").agg(
        ((F.sum("sell_ticks") + F.col("squad_id") % 4) / 10.0).alias("budget"))
    out = best_single_swap(members, parts, TRADE, money, MAX_TICKS, free_transfers=0, hit_cost=2.0)
    return rounded(out, 4, "objective", "without")


TRADE_VALUE = f"""
WITH h AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS p FROM lineitem),
a AS (SELECT p_partkey AS p, CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 1
    WHEN p_type IN ('MEDIUM', 'PROMO') THEN 2 ELSE 3 END AS pos, p_brand AS club,
  CAST(round(p_retailprice * 10) AS BIGINT) AS t, p_size::DOUBLE AS pts FROM part),
m AS (SELECT h.s, a.* FROM h JOIN a USING (p)),
k AS (SELECT s, club, count(*) AS n FROM m GROUP BY 1, 2),
o AS (SELECT m.s, m.p AS gone, max(i.pts) AS pts, -max((i.pts, -i.p))[2] AS come FROM m
  JOIN a AS i ON i.pos = m.pos AND i.t <= m.t + m.s % 4
  LEFT JOIN k ON k.s = m.s AND k.club = i.club LEFT JOIN h ON h.s = m.s AND h.p = i.p
  WHERE h.p IS NULL AND coalesce(k.n, 0) - CASE WHEN i.club = m.club THEN 1 ELSE 0 END < {SWAP_CAP}
  GROUP BY 1, 2),
c AS (SELECT DISTINCT s, -1 AS gone, 0::DOUBLE AS pts, -1 AS come FROM m UNION ALL SELECT * FROM o),
v AS (SELECT c.s, c.gone, c.come, m.pos, CASE WHEN m.p = c.gone THEN c.pts ELSE m.pts END AS x
  FROM c JOIN m ON m.s = c.s),
r AS (SELECT *, row_number() OVER (PARTITION BY s, gone, pos ORDER BY x DESC) AS r FROM v),
z AS (SELECT *, row_number() OVER (PARTITION BY s, gone ORDER BY CASE WHEN r <= 2 THEN 0 ELSE 1 END, x DESC)
  AS z FROM r),
e AS (SELECT s, gone, any_value(come) AS come, 0.1 * sum(x) + 0.9 * sum(x) FILTER (WHERE r <= 2 AND z <= 3) + max(x)
    - CASE WHEN gone < 0 THEN 0 ELSE 2 END AS worth
  FROM z GROUP BY 1, 2 HAVING count(*) FILTER (WHERE r <= 2 AND z <= 3) = 3),
w AS (SELECT s, max((round(worth::DOUBLE, 9), -come, -gone)) AS best, max(worth) FILTER (WHERE gone < 0) AS without
  FROM e GROUP BY 1)
SELECT s AS squad_id, CASE WHEN best[3] <= 0 THEN -best[3] END AS out_id, CASE WHEN best[3] <= 0 THEN -best[2] END AS in_id,
  round(best[1], 4) AS objective, round(without::DOUBLE, 4) AS without FROM w"""


TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
LEGAL = SquadRules(
    squad_size=6, starting_size=4, budget=8000.0, max_per_club=2, positions=tuple(
        PositionRule(t, t, 1, 1 if t == "ECONOMY" else 0, 1) for t in TYPES))


def q_group_legality(spark, folder):
    """Every order as a squad, judged whatever its length."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    starts = F.col("l_linenumber") <= 4
    squads = lines.groupBy(F.col("l_orderkey").alias("squad_id")).agg(
        F.sort_array(F.collect_list("l_partkey")).alias("player_ids"),
        F.sort_array(F.collect_list(F.when(starts, F.col("l_partkey")))).alias("starting_xi"),
        F.sort_array(F.collect_list(F.when(~starts, F.col("l_partkey")))).alias("bench"),
        F.min("l_partkey").alias("captain"), F.max("l_partkey").alias("vice_captain"))
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("player_id"), F.col("p_brand").alias("club_id"),
        F.col("p_type").alias("position_id"), F.col("p_retailprice").alias("price"))
    report = squad_report(squads, parts, LEGAL)
    return report.select("squad_id", F.size("errors").cast("bigint").alias("errors"),
                         F.round("total_cost", 2).alias("total_cost"))


GROUP_LEGALITY = f"""
WITH s AS (SELECT l_orderkey AS squad_id, count(*) AS n, count(DISTINCT l_partkey) AS d,
    count(*) FILTER (WHERE l_linenumber <= 4) AS x, count(DISTINCT l_partkey)
      FILTER (WHERE l_linenumber <= 4) AS xd,
    count(*) FILTER (WHERE l_linenumber > 4) AS b, count(DISTINCT l_partkey)
      FILTER (WHERE l_linenumber > 4) AS bd,
    coalesce(list(l_partkey) FILTER (WHERE l_linenumber <= 4), []) AS xi,
    coalesce(list(l_partkey) FILTER (WHERE l_linenumber > 4), []) AS bench,
    min(l_partkey) AS captain, max(l_partkey) AS vice FROM lineitem GROUP BY 1),
e AS (SELECT squad_id, CAST(n <> 6 AS INT) + CAST(d <> n AS INT) + CAST(x <> 4 AS INT)
    + CAST(xd <> x AS INT) + CAST(b <> 2 AS INT) + CAST(bd <> b AS INT)
    + CAST(list_has_any(xi, bench) AS INT) + CAST(captain = vice AS INT)
    + CAST(NOT list_contains(xi, captain) AS INT) + CAST(NOT list_contains(xi, vice) AS INT)
    AS structure FROM s),
p AS (SELECT DISTINCT l_orderkey AS squad_id, l_partkey, p_type, p_brand, p_retailprice,
    bool_or(l_linenumber <= 4) OVER (PARTITION BY l_orderkey, l_partkey) AS starts,
    bool_or(l_linenumber > 4) OVER (PARTITION BY l_orderkey, l_partkey) AS benched
  FROM lineitem JOIN part ON l_partkey = p_partkey),
q AS (SELECT squad_id, sum(p_retailprice) AS total_cost,
    {' + '.join(f"CAST(count(*) FILTER (WHERE p_type = '{t}') <> 1 AS INT)" for t in TYPES)}
    + {' + '.join(f"CAST(count(*) FILTER (WHERE p_type = '{t}' AND starts) NOT BETWEEN "
                  f"{1 if t == 'ECONOMY' else 0} AND 1 AS INT)" for t in TYPES)}
    + CAST(count(*) FILTER (WHERE p_type = 'ECONOMY' AND benched) <> 1 AS INT)
    + CAST(sum(p_retailprice) > 8000 + 1e-9 AS INT) AS quota FROM p GROUP BY 1),
c AS (SELECT squad_id, CAST(max(n) > 2 AS INT) AS crowd FROM (SELECT squad_id, p_brand, count(*) AS n
  FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT squad_id, CAST(CASE WHEN structure > 0 THEN structure ELSE quota + crowd END AS BIGINT)
  AS errors, round(total_cost, 2) AS total_cost
FROM e JOIN q USING (squad_id) JOIN c USING (squad_id)"""


def q_legal_draws(spark, folder):
    """Orders within a cost band and with at most two parts of a brand."""
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    members = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").join(
        parts, "l_partkey")
    out = legal_draws(members, LEGAL, "l_orderkey", "p_brand", "p_retailprice", 3000.0, 6000.0)
    return rounded(out, 2, "total_cost")


LEGAL_DRAWS = """
WITH b AS (SELECT l_orderkey, p_brand, count(*) AS n, sum(p_retailprice) AS c FROM lineitem
  JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT l_orderkey, round(sum(c), 2) AS total_cost FROM b GROUP BY 1
HAVING max(n) <= 2 AND sum(c) <= 6000 + 1e-9 AND sum(c) >= 3000 - 1e-9"""


def q_selection_rates(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_linenumber")
    number = F.col("l_linenumber")
    out = selection_rates(lines, "l_partkey", "l_orderkey", F.col("l_returnflag") == "N",
                          number == 1, number == 2)
    return rounded(out, 8, *[c for c in out.columns if c.endswith("percent")])


SELECTION_RATES = """
WITH t AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem),
c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS s, count(*) FILTER (WHERE l_returnflag = 'N')
  AS st, count(*) FILTER (WHERE l_linenumber = 1) AS ca, count(*) FILTER (WHERE l_linenumber = 2)
  AS vi FROM lineitem GROUP BY 1)
SELECT l_partkey, s AS selection_count, st AS starter_count, ca AS captain_count,
  vi AS vice_captain_count, round(100.0::DOUBLE * s / n, 8) AS sample_ownership_percent,
  round(100.0::DOUBLE * st / n, 8) AS sample_starter_percent,
  round(100.0::DOUBLE * ca / n, 8) AS sample_captain_percent,
  round(100.0::DOUBLE * vi / n, 8) AS sample_vice_captain_percent FROM c, t"""

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def q_formation_pivot(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    shape = formations(orders, "o_custkey", "o_orderpriority", PRIORITIES,
                       F.col("o_orderstatus") != "P")
    return rounded(shape.join(squad_costs(orders, "o_custkey", "o_totalprice"), "o_custkey"), 2,
                   "squad_cost")


FORMATION_PIVOT = f"""
SELECT o_custkey, concat_ws('-', {', '.join(
    f"count(*) FILTER (WHERE o_orderpriority = '{p}' AND o_orderstatus <> 'P')"
    for p in PRIORITIES)}) AS formation, round(sum(o_totalprice), 2) AS squad_cost
FROM orders GROUP BY 1"""


def q_sample_audit(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    never = F.lit(False)
    rates = selection_rates(lines, "l_partkey", "l_orderkey", never, never, never)
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), (F.col("p_size") / 100.0).alias("rate"))
    return rounded(sample_audit(rates.join(parts, "l_partkey"), "rate"), 8,
                   "pearson_correlation", "mean_absolute_error")


RATES_SQL = """
t AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem),
c AS (SELECT l_partkey, 100.0::DOUBLE * count(DISTINCT l_orderkey) / any_value(n) AS g
  FROM lineitem, t GROUP BY 1)"""
SAMPLE_AUDIT = f"""
WITH {RATES_SQL}
SELECT count(*) AS items, round(corr(p_size / 100.0::DOUBLE, g), 8) AS pearson_correlation,
  round(avg(abs(p_size / 100.0::DOUBLE - g)), 8) AS mean_absolute_error
FROM c JOIN part ON p_partkey = l_partkey"""


def q_manager_audit(spark, folder):
    """Customers as managers of the parts they bought, in full."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    picks = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_extendedprice").join(orders, "o_orderkey")
    never = F.lit(False)
    rates = selection_rates(picks, "l_partkey", "o_custkey", never, never, never).join(
        table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") / 100.0).alias("rate")), "l_partkey")
    out = manager_audit(picks, "o_custkey", "l_partkey", "o_orderpriority", PRIORITIES[:2], F.col("o_orderstatus") == "P",
                        "l_extendedprice", rates, "rate")
    shown = out.withColumn("formations", F.array_join(F.transform(F.array_sort(F.map_entries("formations")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), " "))
    return rounded(rounded(shown, 2, "cost_minimum", "cost_median", "cost_maximum"), 8, "pearson_correlation", "mean_absolute_error")


MANAGER_AUDIT = """
WITH k AS (SELECT o_custkey AS m, l_partkey AS p, l_extendedprice AS x, o_orderpriority AS g, o_orderstatus AS s
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT m, count(*) FILTER (WHERE s = 'P' AND g = '1-URGENT') || '-' || count(*) FILTER (WHERE s = 'P' AND g = '2-HIGH')
  AS formation, sum(x) AS cost FROM k GROUP BY 1),
h AS (SELECT string_agg(formation || '=' || n, ' ' ORDER BY formation) AS formations
  FROM (SELECT formation, count(*) AS n FROM f GROUP BY 1)),
r AS (SELECT p, 100.0::DOUBLE * count(DISTINCT m) / (SELECT count(DISTINCT m) FROM k) AS v FROM k GROUP BY 1),
a AS (SELECT count(*) AS items, round(corr(p_size / 100.0::DOUBLE, v), 8) AS pearson_correlation,
  round(avg(abs(p_size / 100.0::DOUBLE - v)), 8) AS mean_absolute_error FROM r JOIN part ON p_partkey = p)
SELECT count(DISTINCT m) AS managers, count(*) AS picks, count(DISTINCT p) AS unique_items, any_value(formations) AS formations,
  (SELECT round(min(cost), 2) FROM f) AS cost_minimum, (SELECT round(median(cost), 2) FROM f) AS cost_median,
  (SELECT round(max(cost), 2) FROM f) AS cost_maximum, any_value(items) AS items,
  any_value(pearson_correlation) AS pearson_correlation, any_value(mean_absolute_error) AS mean_absolute_error
FROM k, h, a"""


def q_inclusion_calibration(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), (F.col("p_size") / 100.0).alias("rate"))
    return rounded(inclusion_calibration(lines, "l_orderkey", "l_partkey", parts, "rate"), 8,
                   "pearson_correlation", "mean_absolute_error")


INCLUSION_CALIBRATION = f"""
WITH {RATES_SQL}
SELECT round(corr(p_size / 100.0::DOUBLE, coalesce(g, 0)), 8) AS pearson_correlation,
  round(avg(abs(p_size / 100.0::DOUBLE - coalesce(g, 0))), 8) AS mean_absolute_error,
  count(*) AS members FROM part LEFT JOIN c ON p_partkey = l_partkey"""


def q_pick_violations(spark, folder):
    """Orders that are not exactly the lines 1..4 with one urgent marker each."""
    picks = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("player_id"),
        F.col("l_linenumber").alias("squad_position"),
        (F.col("l_linenumber") == 1).alias("is_captain"),
        (F.col("l_linenumber") == 2).alias("is_vice_captain"))
    known = table(spark, folder, "part").select(F.col("p_partkey").alias("player_id"))
    out = pick_violations(picks, ["l_orderkey"], known, size=4)
    return out.select("l_orderkey", F.size("reasons").cast("bigint").alias("reasons"))


PICK_VIOLATIONS = """
WITH c AS (SELECT l_orderkey, CAST(count(*) <> 4 AS INT)
  + CAST(count(DISTINCT l_partkey) <> count(*) AS INT)
  + CAST(min(l_linenumber) <> 1 OR max(l_linenumber) <> 4 OR count(DISTINCT l_linenumber) <> 4
    AS INT) + CAST(count(*) FILTER (WHERE l_linenumber = 1) <> 1 AS INT)
  + CAST(count(*) FILTER (WHERE l_linenumber = 2) <> 1 AS INT)
  + CAST(count(*) FILTER (WHERE p_partkey IS NULL) > 0 AS INT) AS r
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_orderkey, CAST(r AS BIGINT) AS reasons FROM c WHERE r > 0"""


def _nation_scores(spark, folder):
    asked = table(spark, folder, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    known = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return percentile_scores(asked, known, ["nation"], "balance")


def q_midrank_rating(spark, folder):
    return rounded(_nation_scores(spark, folder).select(
        "s_suppkey", "nation", "less", "equal", "reference_rows", "percentile"), 8, "percentile")


COUNTS_SQL = """
c AS (SELECT s_suppkey, s_nationkey AS nation,
  count(*) FILTER (WHERE c_acctbal < s_acctbal) AS less,
  count(*) FILTER (WHERE c_acctbal = s_acctbal) AS equal, count(*) AS reference_rows
  FROM supplier JOIN customer ON c_nationkey = s_nationkey GROUP BY 1, 2)"""
MIDRANK_RATING = f"""
WITH {COUNTS_SQL} SELECT *, round(100.0::DOUBLE * (less + equal / 2.0::DOUBLE) / reference_rows, 8)
  AS percentile FROM c"""


def q_normal_score(spark, folder):
    return rounded(_nation_scores(spark, folder).select("s_suppkey", "score"), 6, "score")


NORMAL_SCORE = f"""
WITH {COUNTS_SQL}, p AS (SELECT s_suppkey, (less + equal / 2e0 + 0.5e0) / (reference_rows + 1e0) AS p
  FROM c)
SELECT s_suppkey, round(least(greatest(75 + 8 * {normal_quantile_sql('p')}, 0), 99.9e0), 6) AS score
FROM p"""


def q_component_ratings(spark, folder):
    """Promotional parts rated by size and price against all other parts."""
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("squad_id"), "p_type", F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"))
    promo = F.col("p_type") == "PROMO"
    out = component_ratings(parts.filter(promo), parts.filter(~promo),
                            {"size": "size", "price": "price"})
    return out.select(
        "squad_id", F.element_at("scores", "size").alias("size_score"),
        F.element_at("percentiles", "price").alias("price_percentile"),
        F.array_join("strengths", ",").alias("strengths"),
        F.array_join("weaknesses", ",").alias("weaknesses"))


def _rated_sql(name: str, column: str) -> str:
    return f"""{name} AS (SELECT a.p_partkey AS squad_id,
  count(*) FILTER (WHERE b.{column} < a.{column}) + count(*) FILTER (WHERE b.{column} = a.{column})
    / 2e0 AS h, count(*) AS n FROM part a JOIN part b ON a.p_type = 'PROMO' AND b.p_type <> 'PROMO'
  GROUP BY 1),
{name}_s AS (SELECT squad_id, round(100e0 * h / n, 1) AS pct, round(least(greatest(75 + 8 *
  {normal_quantile_sql('((h + 0.5e0) / (n + 1e0))')}, 0), 99.9e0), 1) AS score FROM {name})"""


COMPONENT_RATINGS = f"""
WITH {_rated_sql('z', 'p_size')}, {_rated_sql('c', 'p_retailprice')}
SELECT squad_id, z_s.score AS size_score, c_s.pct AS price_percentile,
  concat_ws(',', CASE WHEN c_s.score >= 85 THEN 'price' END,
    CASE WHEN z_s.score >= 85 THEN 'size' END) AS strengths,
  concat_ws(',', CASE WHEN c_s.score <= 65 THEN 'price' END,
    CASE WHEN z_s.score <= 65 THEN 'size' END) AS weaknesses
FROM z_s JOIN c_s USING (squad_id)"""


def q_probability_reconcile(spark, folder):
    """Customers of a nation rescaled to ten expected ones, each customer's value."""
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", clip((F.col("c_acctbal") + 1000.0) / 11000.0, 0.0, 1.0).alias("p"))
    fitted = reconcile(customers, ["c_nationkey"], "p", F.lit(10.0), "fitted")
    return rounded(fitted, 6, "p", "fitted")


PROBABILITY_RECONCILE = """
WITH RECURSIVE p AS (SELECT c_custkey, c_nationkey,
    least(greatest((c_acctbal + 1000) / 11000, 0), 1)::DOUBLE AS p FROM customer),
l AS (SELECT *, ln(least(greatest(p, 1e-9), 1 - 1e-9) / (1 - least(greatest(p, 1e-9), 1 - 1e-9))) AS l
  FROM p),
s AS (SELECT c_nationkey, list(l) AS ls, -40::DOUBLE AS lo, 40::DOUBLE AS hi, 0 AS i FROM l GROUP BY 1
  UNION ALL SELECT c_nationkey, ls, CASE WHEN t < 10 THEN m ELSE lo END,
    CASE WHEN t < 10 THEN hi ELSE m END, i + 1
  FROM (SELECT *, (lo + hi) / 2 AS m, list_sum([1 / (1 + exp(-(x + (lo + hi) / 2))) FOR x IN ls]) AS t
    FROM s WHERE i < 60))
SELECT c_custkey, c_nationkey, round(p, 6) AS p, round(CASE WHEN len(ls) <= 10 THEN 1
  ELSE 1 / (1 + exp(-(l + (lo + hi) / 2))) END, 6) AS fitted
FROM l JOIN s USING (c_nationkey) WHERE i = 60"""


def q_availability_adjust(spark, folder):
    """List price discounted by stock chance; part size in percent as the chance."""
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("player_id"), (F.col("p_retailprice") * 3).alias("total"),
        F.col("p_retailprice").alias("first"),
        F.when(F.col("p_type") == "PROMO", F.lit("d")).otherwise(F.lit("a")).alias("status"),
        F.when(F.col("p_size") > 25, F.col("p_size") * 2.0)
        .alias("chance_of_playing_this_round"),
        F.when(F.col("p_size") > 10, F.col("p_size") * 1.0)
        .alias("chance_of_playing_next_round"))
    out = adjust_for_availability(parts, "total", "first", "adjusted")
    return rounded(out.select("player_id", "availability_factor", "adjusted",
                              "availability_warning"), 6, "availability_factor", "adjusted")


AVAILABILITY_ADJUST = """
WITH p AS (SELECT p_partkey AS player_id, p_retailprice AS v, p_type,
  coalesce(CASE WHEN p_size > 25 THEN p_size * 2 END, CASE WHEN p_size > 10 THEN p_size END) AS c
  FROM part)
SELECT player_id, round(coalesce(c / 100.0::DOUBLE, 1), 6) AS availability_factor,
  round(v * 3 - v * (1 - coalesce(c / 100.0::DOUBLE, 1)), 6) AS adjusted,
  CASE WHEN c IS NULL AND p_type = 'PROMO' THEN 'no estimate, raw value kept'
       WHEN c < 100 THEN 'first period adjusted' END AS availability_warning FROM p"""


def q_horizon_marginals(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_discount").alias("h1"), F.sum("l_tax").alias("extra")).withColumn(
        "h3", F.col("h1") + F.col("extra")).withColumn("h5", F.col("h3") - F.col("extra") / 2)
    out = marginals(lines, ["l_partkey"], {1: "h1", 3: "h3", 5: "h5"}, 5)
    return rounded(out, 6, "value")


HORIZON_MARGINALS = """
WITH t AS (SELECT l_partkey, sum(l_discount) AS a, sum(l_tax) AS e FROM lineitem GROUP BY 1)
SELECT l_partkey, step, round(CASE WHEN step = 1 THEN greatest(a, 0) WHEN step <= 3
  THEN greatest(e, 0) / 2 ELSE greatest(-e / 2, 0) / 2 END, 6) AS value
FROM t, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)"""


def q_captain_fallback(spark, folder):
    """Captain and stand-in value over three steps; rates come from the line."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_discount", "l_tax", "l_quantity", "l_extendedprice")
    steps = lines.groupBy("l_orderkey").agg(
        F.max("l_quantity").alias("captain"), F.min("l_quantity").alias("vice"),
        (F.max("l_discount") * 8).alias("pc"), (F.max("l_tax") * 10).alias("pv"),
        (F.max("l_discount") * 600).alias("first"),
    ).withColumn("step", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    out = captain_value(steps, ["l_orderkey"], "captain", "vice", "pc", "pv", "first")
    return rounded(out, 6, "captain_points", "vice_captain_points")


CAPTAIN_FALLBACK = """
WITH o AS (SELECT l_orderkey, max(l_quantity) AS c, min(l_quantity) AS v, max(l_discount) * 8 AS pc,
  max(l_tax) * 10 AS pv, max(l_discount) * 600 AS f FROM lineitem GROUP BY 1),
s AS (SELECT *, CASE WHEN k = 1 THEN least(pc, f / 100) ELSE pc END AS p
  FROM o, (SELECT unnest(range(1, 4)) AS k)),
r AS (SELECT l_orderkey, p * CASE WHEN pc > 1e-9 THEN c / pc ELSE 0 END AS cap,
  (1 - p) * CASE WHEN pv > 1e-9 THEN pv * (v / pv) ELSE 0 END AS vic FROM s)
SELECT l_orderkey, round(sum(cap + vic), 6) AS captain_points, round(sum(vic), 6)
  AS vice_captain_points FROM r GROUP BY 1"""


def _part_squads(spark, folder):
    """One-member squads per line: part, price paid and stated sell price."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.max("l_tax").alias("tax"), F.min("l_discount").alias("discount"))
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    key = F.array("l_partkey")
    paid = F.floor(F.col("p_retailprice") * (0.95 + F.col("tax")) * 10 + 0.001) / 10.0
    stated = F.round(F.col("p_retailprice"), 1)
    return lines.join(parts, "l_partkey").select(
        F.concat_ws("-", "l_orderkey", "l_partkey").alias("squad_id"), key.alias("player_ids"),
        F.when(F.col("discount") <= 0.03, F.map_from_arrays(key, F.array(stated)))
        .alias("selling_prices"),
        F.when(F.col("discount") <= 0.07, F.map_from_arrays(key, F.array(paid)))
        .alias("purchase_prices"),
        F.when(F.col("tax") > 0.06, F.lit(5000.0)).alias("budget_limit"),
        F.when(F.col("tax") > 0.04, F.lit(10.0)).alias("bank"),
        F.when(F.col("tax") > 0.02, F.lit("manual")).otherwise(F.lit("api")).alias("source"))


def q_sell_price(spark, folder):
    squads = _part_squads(spark, folder)
    prices = table(spark, folder, "part").select(
        F.col("p_partkey").alias("player_id"), F.col("p_retailprice").alias("price"))
    return selling_prices(squads, prices)


SELL_SQL = """
l AS (SELECT l_orderkey, l_partkey, max(l_tax) AS tax, min(l_discount) AS disc FROM lineitem
  GROUP BY 1, 2),
s AS (SELECT l_orderkey || '-' || l_partkey AS squad_id, l_partkey AS player_id,
  CAST(round(p_retailprice * 10) AS BIGINT) AS price_ticks,
  CASE WHEN disc <= 0.03 THEN CAST(round(round(p_retailprice, 1) * 10) AS BIGINT) END AS st,
  CASE WHEN disc <= 0.07 THEN CAST(floor(p_retailprice * (0.95::DOUBLE + tax) * 10 + 0.001)
    AS BIGINT) END AS pd, tax FROM l JOIN part ON p_partkey = l_partkey),
v AS (SELECT squad_id, player_id, price_ticks, CAST(coalesce(st, CASE WHEN price_ticks <= pd
  THEN price_ticks ELSE pd + floor((price_ticks - pd) / 2) END, price_ticks) AS BIGINT)
  AS sell_ticks, CASE WHEN st IS NOT NULL THEN 'stated' WHEN pd IS NOT NULL THEN 'reconstructed'
  ELSE 'approximated' END AS basis, tax FROM s)"""
SELL_PRICE = f"""
WITH {SELL_SQL} SELECT squad_id, player_id, price_ticks, sell_ticks, basis FROM v"""
BUDGET_RULES = SquadRules(1, 1, 1500.0, 1, (PositionRule(1, "P", 1, 1, 1),))


def q_budgets(spark, folder):
    squads = _part_squads(spark, folder)
    prices = table(spark, folder, "part").select(
        F.col("p_partkey").alias("player_id"), F.col("p_retailprice").alias("price"))
    return rounded(budgets(squads, selling_prices(squads, prices), BUDGET_RULES), 4, "budget")


BUDGETS = f"""
WITH {SELL_SQL} SELECT squad_id, round(CASE WHEN tax > 0.06 THEN 5000 ELSE sell_ticks / 10.0::DOUBLE
  + CASE WHEN tax > 0.04 THEN 10 WHEN tax > 0.02 THEN greatest(1500 - price_ticks / 10.0::DOUBLE, 0)
    ELSE 0 END END, 4) AS budget FROM v"""


def q_transfer_summary(spark, folder):
    """What changes from an order's lines 1-4 to its lines 3-7."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    number = F.col("l_linenumber")
    changes = lines.groupBy(F.col("l_orderkey").alias("squad_id")).agg(
        F.collect_set(F.when(number <= 4, F.col("l_partkey"))).alias("before_ids"),
        F.collect_set(F.when(number >= 3, F.col("l_partkey"))).alias("after_ids"))
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("player_id"), F.col("p_retailprice").alias("price"), "p_size")
    out = transfer_summary(changes, parts, "p_size")
    numbers = ["incoming_price", "outgoing_price", "incoming_points", "outgoing_points",
               "price_difference", "transfer_hit", "gross_gain", "net_gain"]
    return rounded(out.select(
        "squad_id", F.size("transfers_in").alias("moves_in"),
        F.size("transfers_out").alias("moves_out"), "paid_transfers", *numbers), 4, *numbers)


TRANSFER_SUMMARY = """
WITH m AS (SELECT l_orderkey AS squad_id, l_partkey, bool_or(l_linenumber <= 4) AS b,
  bool_or(l_linenumber >= 3) AS a FROM lineitem GROUP BY 1, 2),
s AS (SELECT squad_id, CAST(count(*) FILTER (WHERE a AND NOT b) AS INT) AS moves_in,
  CAST(count(*) FILTER (WHERE b AND NOT a) AS INT) AS moves_out,
  coalesce(sum(p_retailprice) FILTER (WHERE a AND NOT b), 0) AS ip,
  coalesce(sum(p_retailprice) FILTER (WHERE b AND NOT a), 0) AS op,
  coalesce(sum(p_size) FILTER (WHERE a AND NOT b), 0)::DOUBLE AS iz,
  coalesce(sum(p_size) FILTER (WHERE b AND NOT a), 0)::DOUBLE AS oz
  FROM m JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT squad_id, moves_in, moves_out, greatest(moves_in - 1, 0) AS paid_transfers,
  round(ip, 4) AS incoming_price, round(op, 4) AS outgoing_price, iz AS incoming_points,
  oz AS outgoing_points, round(ip - op, 4) AS price_difference,
  CAST(greatest(moves_in - 1, 0) * 4 AS DOUBLE) AS transfer_hit, iz - oz AS gross_gain,
  iz - oz - greatest(moves_in - 1, 0) * 4 AS net_gain FROM s"""


def q_selectable(spark, folder):
    """Parts that are not discontinued (large ones are), or are in an order."""
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("player_id"),
        F.when(F.col("p_type") != "PROMO", F.col("p_size") < 40).alias("can_select"))
    held = table(spark, folder, "lineitem").filter("l_quantity > 49").select(
        F.col("l_partkey").alias("player_id"))
    return selectable(parts, held).select("player_id")


SELECTABLE = """
SELECT p_partkey AS player_id FROM part WHERE p_type = 'PROMO' OR p_size < 40
  OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)"""


def q_history_readiness(spark, folder):
    """Customers with a median of at least 30 items over their orders' sizes."""
    sizes = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("lines"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    joined = orders.join(sizes, orders.o_orderkey == sizes.l_orderkey)
    return history_readiness(joined, "o_orderpriority", "lines")


HISTORY_READINESS = """
WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderpriority, median(n) AS median_history, median(n) >= 2 AS ready
FROM orders JOIN s ON l_orderkey = o_orderkey GROUP BY 1"""


def q_coercions(spark, folder):
    """Text read leniently as numbers and strictly as booleans."""
    events = table(spark, folder, "events").select(
        "event_id", lenient_long(F.get_json_object("props", "$.k")).alias("k"),
        lenient_long("event_type").alias("nothing"),
        strict_boolean((F.col("value") > 10).cast("string")).alias("large"))
    return events


COERCIONS = """
SELECT event_id, CAST(try_cast(props ->> '$.k' AS DOUBLE) AS BIGINT) AS k, NULL AS nothing,
  value > 10 AS large FROM events"""


def q_fuzzy_match(spark, folder):
    """Misspelt part names (letters as digits) against the part names."""
    names = table(spark, folder, "part").select("p_name").distinct()
    observed = names.select(F.translate("p_name", "oei", "031").alias("reading"))
    out = match_names(observed, "reading", names, "p_name", "p_name", 0.8, 8)
    return rounded(out.select("observed", "candidate", "score", "place"), 8, "score")


FUZZY_MATCH = """
WITH n AS (SELECT DISTINCT p_name FROM part),
o AS (SELECT DISTINCT translate(p_name, 'oei', '031') AS observed FROM n),
f AS (SELECT observed, regexp_replace(observed, '[^a-z0-9]', '', 'g') AS form FROM o UNION
  SELECT observed, w FROM (SELECT observed, unnest(regexp_split_to_array(observed, '[^a-z0-9]+'))
  AS w FROM o) WHERE length(w) > 2),
c AS (SELECT p_name AS candidate, regexp_replace(p_name, '[^a-z0-9]', '', 'g') AS name FROM n),
s AS (SELECT observed, candidate, greatest(1 - levenshtein(form, name) / greatest(length(form),
    length(name))::DOUBLE, CASE WHEN contains(form, name) OR contains(name, form) THEN 0.75::DOUBLE
    + 0.25::DOUBLE * least(length(form), length(name)) / greatest(length(form), length(name))
    ELSE 0 END) AS v FROM f, c),
b AS (SELECT observed, candidate, max(v) AS v FROM s GROUP BY 1, 2 HAVING max(v) >= 0.8 - 1e-12),
r AS (SELECT *, row_number() OVER (PARTITION BY observed ORDER BY v DESC, candidate) AS place FROM b)
SELECT o.observed, candidate, round(v, 8) AS score, place FROM o LEFT JOIN r
  ON o.observed IS NOT DISTINCT FROM r.observed AND place <= 8"""


def q_fuzzy_rank(spark, folder):
    """The eight best part names of any text, however badly it fits; some by the type of the part."""
    parts = table(spark, folder, "part")
    names = parts.select(F.concat_ws("-", "p_name", "p_type").alias("id"), "p_name", F.col("p_type").alias("kind")).distinct()
    text = F.explode(F.array(
        F.translate("p_name", "oei", "031"), F.reverse("p_name"), F.substring("p_name", 1, 3),
        F.substring("p_name", 3, 4), F.col("p_type"), F.lit("##"), F.lit("qq 7")))
    observed = parts.select(text.alias("reading"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("only")).union(
        table(spark, folder, "nation").select("n_name", F.lit(None).cast("string")))
    out = rank_names(observed, "reading", names, "id", "p_name", 8, "only", "kind")
    return rounded(out, 8, "score")


FUZZY_RANK = """
WITH n AS (SELECT DISTINCT p_name || '-' || p_type AS candidate, p_name, p_type AS kind FROM part),
o AS (SELECT DISTINCT * FROM (SELECT unnest([translate(p_name, 'oei', '031'), reverse(p_name),
    substr(p_name, 1, 3), substr(p_name, 3, 4), p_type, '##', 'qq 7']) AS observed,
    CASE WHEN p_size % 2 = 0 THEN p_type END AS observed_group FROM part
  UNION ALL SELECT n_name, NULL FROM nation)),
f AS (SELECT observed, regexp_replace(lower(observed), '[^a-z0-9]', '', 'g') AS form FROM (SELECT DISTINCT observed FROM o)
  UNION SELECT observed, w FROM (SELECT observed, unnest(regexp_split_to_array(lower(observed), '[^a-z0-9]+'))
  AS w FROM (SELECT DISTINCT observed FROM o)) WHERE length(w) > 2),
c AS (SELECT DISTINCT p_name, regexp_replace(p_name, '[^a-z0-9]', '', 'g') AS name FROM n),
s AS (SELECT observed, p_name, max(CASE WHEN form = '' THEN 0 ELSE greatest(1 - levenshtein(form, name)
    / greatest(length(form), length(name))::DOUBLE, CASE WHEN contains(form, name) OR contains(name, form)
    THEN 0.75::DOUBLE + 0.25::DOUBLE * least(length(form), length(name)) / greatest(length(form), length(name))
    ELSE 0 END) END) AS v FROM f, c GROUP BY 1, 2),
r AS (SELECT o.observed, o.observed_group, n.candidate, s.v, row_number() OVER (
    PARTITION BY o.observed, o.observed_group ORDER BY s.v DESC, n.candidate) AS place
  FROM o JOIN s USING (observed) JOIN n USING (p_name)
  WHERE o.observed_group IS NULL OR o.observed_group = n.kind)
SELECT observed, observed_group, candidate, round(v, 8) AS score, place FROM r WHERE place <= 8"""


def _brand_quotas():
    return {f"Brand#{i}": 1 + i % 3 for i in range(1, 26)}


def q_weighted_draws(spark, folder):
    """Parts drawn per brand without replacement, likelier when dear."""
    parts = table(spark, folder, "part")
    drawn = successive_draws(parts, "p_brand", "p_partkey", F.col("p_retailprice") / 1000.0,
                             _brand_quotas(), 200, 2026)
    return drawn.groupBy("draw", "p_brand").agg(F.count("*").alias("items"))


WEIGHTED_DRAWS = """
SELECT d AS draw, p_brand, 1 + CAST(substr(p_brand, 7) AS BIGINT) % 3 AS items
FROM range(200) AS r(d), (SELECT DISTINCT p_brand FROM part)"""


def q_conditioned_draws(spark, folder):
    """Subsets of parts per brand, by the product of their prices."""
    return product_subsets(table(spark, folder, "part"), "p_brand", "p_partkey",
                           F.col("p_retailprice") / 1000.0, _brand_quotas(), 200, 2026)


INCLUSION_BAND = (60, 80)


def _sized_parts(spark, folder):
    """Parts in two strata by brand, with their size for a cost and their price for a weight."""
    return table(spark, folder, "part").select(
        "p_partkey", F.when(F.substring("p_brand", 7, 3).cast("int") % 2 == 1, "odd").otherwise("even").alias("kind"),
        "p_size", (F.col("p_retailprice") / 1000.0).alias("weight"))


def q_conditioned_inclusion(spark, folder):
    """How likely each part is among one odd and two even ones whose sizes sum to the band."""
    out = conditioned_inclusion(_sized_parts(spark, folder), "kind", "p_partkey", F.col("weight"), F.col("p_size"),
                                {"odd": 1, "even": 2}, *INCLUSION_BAND)
    return rounded(out, 10, "probability")


CONDITIONED_INCLUSION = f"""
WITH p AS (SELECT p_partkey, p_size AS c, p_retailprice / 1000.0::DOUBLE AS w,
  CASE WHEN CAST(substr(p_brand, 7, 3) AS INT) % 2 = 1 THEN 'odd' ELSE 'even' END AS kind FROM part),
e AS (SELECT kind, c, sum(w) AS p1, sum(w * w) AS p2 FROM p GROUP BY ALL),
o AS (SELECT c, p1 FROM e WHERE kind = 'odd'), v AS (SELECT c, p1, p2 FROM e WHERE kind = 'even'),
pairs AS (SELECT a.c + b.c AS c, sum(CASE WHEN a.c < b.c THEN a.p1 * b.p1 ELSE (a.p1 * a.p1 - a.p2) / 2 END) AS s
  FROM v a JOIN v b ON a.c <= b.c GROUP BY 1),
z AS (SELECT sum(o.p1 * pairs.s) AS z FROM o JOIN pairs ON o.c + pairs.c BETWEEN {INCLUSION_BAND[0]} AND {INCLUSION_BAND[1]}),
one AS (SELECT o.c, sum(pairs.s) AS s FROM o JOIN pairs ON o.c + pairs.c BETWEEN {INCLUSION_BAND[0]} AND {INCLUSION_BAND[1]} GROUP BY 1),
two AS (SELECT v.c, u.c AS d, any_value(u.p1) AS p1, sum(o.p1) AS s FROM v JOIN v u ON true
  JOIN o ON o.c + v.c + u.c BETWEEN {INCLUSION_BAND[0]} AND {INCLUSION_BAND[1]} GROUP BY 1, 2)
SELECT p_partkey, kind, round(w * coalesce(s, 0) / z, 10) AS probability FROM p LEFT JOIN one USING (c), z WHERE kind = 'odd'
UNION ALL
SELECT p_partkey, any_value(kind), round(any_value(w) * coalesce(sum((two.p1 - CASE WHEN d = p.c THEN w ELSE 0 END) * s), 0)
  / any_value(z), 10) FROM p LEFT JOIN two ON two.c = p.c, z WHERE kind = 'even' GROUP BY 1"""


def q_cluster_sample(spark, folder):
    """Customers first, then their orders."""
    return cluster_sample(table(spark, folder, "orders"), "o_custkey", "o_orderkey", 100, 5, 2026)


def q_leaderboard(spark, folder):
    """Three rules for a line's price, best first."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("actual"), "l_quantity", "l_discount")
    guesses = F.array(
        F.struct(F.lit("flat").alias("model"), F.lit(50000.0).alias("prediction")),
        F.struct(F.lit("quantity").alias("model"), (F.col("l_quantity") * 2000).alias("prediction")),
        F.struct(F.lit("discount").alias("model"),
                 ((1 - F.col("l_discount")) * 50000).alias("prediction")))
    rows = lines.select("actual", F.explode(guesses).alias("g")).select("actual", "g.*")
    out = leaderboard(prediction_metrics(rows, ["model"]))
    return rounded(out.select("model", "rows", "mae", "rmse"), 4, "mae", "rmse")


LEADERBOARD = """
WITH g AS (SELECT 'flat' AS model, l_extendedprice AS a, 50000.0::DOUBLE AS p FROM lineitem UNION ALL
  SELECT 'quantity', l_extendedprice, l_quantity * 2000 FROM lineitem UNION ALL
  SELECT 'discount', l_extendedprice, (1 - l_discount) * 50000 FROM lineitem)
SELECT model, count(*) AS rows, round(avg(abs(p - a)), 4) AS mae, round(sqrt(avg((p - a) ** 2)), 4)
  AS rmse FROM g GROUP BY 1"""

QUERIES = {
    "best_lineup": (q_best_lineup, BEST_LINEUP),
    "single_swap": (q_single_swap, SINGLE_SWAP),
    "trade_value": (q_trade_value, TRADE_VALUE),
    "group_legality": (q_group_legality, GROUP_LEGALITY),
    "legal_draws": (q_legal_draws, LEGAL_DRAWS),
    "selection_rates": (q_selection_rates, SELECTION_RATES),
    "formation_pivot": (q_formation_pivot, FORMATION_PIVOT),
    "sample_audit": (q_sample_audit, SAMPLE_AUDIT),
    "manager_audit": (q_manager_audit, MANAGER_AUDIT),
    "inclusion_calibration": (q_inclusion_calibration, INCLUSION_CALIBRATION),
    "pick_violations": (q_pick_violations, PICK_VIOLATIONS),
    "midrank_rating": (q_midrank_rating, MIDRANK_RATING),
    "normal_score": (q_normal_score, NORMAL_SCORE),
    "component_ratings": (q_component_ratings, COMPONENT_RATINGS),
    "probability_reconcile": (q_probability_reconcile, PROBABILITY_RECONCILE),
    "availability_adjust": (q_availability_adjust, AVAILABILITY_ADJUST),
    "horizon_marginals": (q_horizon_marginals, HORIZON_MARGINALS),
    "captain_fallback": (q_captain_fallback, CAPTAIN_FALLBACK),
    "sell_price": (q_sell_price, SELL_PRICE),
    "budgets": (q_budgets, BUDGETS),
    "transfer_summary": (q_transfer_summary, TRANSFER_SUMMARY),
    "selectable": (q_selectable, SELECTABLE),
    "history_readiness": (q_history_readiness, HISTORY_READINESS),
    "coercions": (q_coercions, COERCIONS),
    "fuzzy_match_topk": (q_fuzzy_match, FUZZY_MATCH),
    "fuzzy_rank_all": (q_fuzzy_rank, FUZZY_RANK),
    "weighted_draws": (q_weighted_draws, WEIGHTED_DRAWS),
    "conditioned_inclusion": (q_conditioned_inclusion, CONDITIONED_INCLUSION),
    "conditioned_draws": (q_conditioned_draws, None),
    "cluster_sample": (q_cluster_sample, None),
    "leaderboard": (q_leaderboard, LEADERBOARD),
}
