"""Queries on forecast metrics, folds, calibration, coverage and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.ml.gram import fold_predictions, fold_ridges
from tidemark.operators.evaluation import (
    brier_scores,
    calibration_bins,
    prediction_metrics,
    rank_correlations,
    rolling_origin_folds,
    spaced_folds,
    trained_on,
)
from tidemark.operators.guards import duplicate_keys, split_by_deadline
from tidemark.operators.managers import cost_summary
from tidemark.operators.profile import coverage, season_audit, training_coverage
from tidemark.operators.ratings import distribution_summary
from tidemark.queries.common import SLOT, rounded, seconds, table

FOLD_HORIZON = 3
MIN_PERIODS = 4
FOLDS = 12


def forecasts(spark, folder):
    """Line items priced at list price times quantity, against the actual price."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.year("l_shipdate").alias("season"),
        F.month("l_shipdate").alias("period"), F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * 1500.0).alias("prediction"))
    return lines


FORECASTS_SQL = """
f AS (SELECT l_returnflag AS model, year(l_shipdate) AS season, month(l_shipdate) AS period,
  l_extendedprice AS actual, l_quantity * 1500.0::DOUBLE AS prediction FROM lineitem)"""
RANKED_SQL = """
r AS (SELECT *,
  rank() OVER (PARTITION BY {by}season, period ORDER BY actual)
    + (count(*) OVER (PARTITION BY {by}season, period, actual) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY {by}season, period ORDER BY prediction)
    + (count(*) OVER (PARTITION BY {by}season, period, prediction) - 1) / 2.0 AS rp FROM f)"""


def q_prediction_metrics(spark, folder):
    out = prediction_metrics(forecasts(spark, folder), ["model"], ["season", "period"])
    return rounded(rounded(out, 4, "mae", "rmse", "mean_prediction", "mean_actual"), 8,
                   "correlation", "ranking_correlation")


PREDICTION_METRICS = f"""
WITH {FORECASTS_SQL}, {RANKED_SQL.format(by='model, ')},
c AS (SELECT model, avg(rho) AS rho FROM (SELECT model, season, period,
  CASE WHEN count(*) > 1 AND min(actual) < max(actual) AND min(prediction) < max(prediction)
  THEN corr(ra, rp) END AS rho FROM r GROUP BY 1, 2, 3) GROUP BY 1)
SELECT model, count(*) AS rows, round(avg(abs(prediction - actual)), 4) AS mae,
  round(sqrt(avg((prediction - actual) ** 2)), 4) AS rmse,
  round(corr(actual, prediction), 8) AS correlation, round(any_value(rho), 8)
  AS ranking_correlation, round(avg(prediction), 4) AS mean_prediction,
  round(avg(actual), 4) AS mean_actual FROM f JOIN c USING (model) GROUP BY 1"""


def q_rank_correlation(spark, folder):
    return rounded(rank_correlations(forecasts(spark, folder), ["season", "period"]), 8,
                   "rank_correlation")


RANK_CORRELATION = f"""
WITH {FORECASTS_SQL}, {RANKED_SQL.format(by='')}
SELECT season, period, count(*) AS rows, round(CASE WHEN count(*) > 1 AND
  min(actual) < max(actual) AND min(prediction) < max(prediction) THEN corr(ra, rp) END, 8)
  AS rank_correlation FROM r GROUP BY 1, 2"""


def q_calibration_bins(spark, folder):
    out = calibration_bins(forecasts(spark, folder), 10, ["model"])
    return rounded(out, 4, "mean_prediction", "mean_actual", "calibration_error")


CALIBRATION_BINS = f"""
WITH {FORECASTS_SQL},
o AS (SELECT model, prediction, row_number() OVER (PARTITION BY model ORDER BY prediction) - 1 AS i,
  count(*) OVER (PARTITION BY model) AS n FROM f),
h AS (SELECT model, k, prediction, i, (n - 1) * (k * 0.1::DOUBLE) AS h FROM o, range(11) AS r(k)),
q AS (SELECT model, k, max(prediction) FILTER (WHERE i = floor(h)) AS lo,
  max(prediction) FILTER (WHERE i = ceil(h)) AS hi, any_value(h) AS h FROM h GROUP BY 1, 2),
e AS (SELECT model, k, lo + (hi - lo) * (h - floor(h)) AS edge FROM q),
d AS (SELECT model, list(DISTINCT edge) AS edges FROM e GROUP BY 1),
b AS (SELECT f.*, greatest(len(list_filter(edges, lambda x: x < prediction)), 1) AS bin
  FROM f JOIN d USING (model))
SELECT model, bin, count(*) AS count, round(avg(prediction), 4) AS mean_prediction,
  round(avg(actual), 4) AS mean_actual,
  round(avg(prediction) - avg(actual), 4) AS calibration_error FROM b GROUP BY 1, 2"""


def q_brier_scores(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("double").alias("outcome"),
        (F.col("l_discount") * 10).alias("raw"), (F.col("l_tax") * 5 + 0.1).alias("adjusted"))
    return rounded(brier_scores(lines, "outcome", {"raw": "raw", "calibrated": "adjusted"}), 8,
                   "raw", "calibrated")


BRIER_SCORES = """
WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS y,
  l_discount * 10 AS a, l_tax * 5 + 0.1::DOUBLE AS b FROM lineitem)
SELECT count(*) AS rows, round(avg((a - y) ** 2), 8) AS raw, round(avg((b - y) ** 2), 8)
  AS calibrated FROM s"""


def monthly_orders(spark, folder):
    return table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("period"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("stamp"), "o_totalprice")


ORDERS_SQL = """
o AS (SELECT year(o_orderdate) AS season, month(o_orderdate) AS period,
  year(o_orderdate) * 12 + month(o_orderdate) AS stamp, o_totalprice FROM orders),
p AS (SELECT season, period, stamp, count(*) AS rows, sum(o_totalprice) AS total
  FROM o GROUP BY ALL)"""


def _folds_sql(horizon: int) -> str:
    return f"""{ORDERS_SQL},
c AS (SELECT v.season, v.period, v.stamp, v.rows AS validation_rows, count(t.stamp) AS train_periods,
  coalesce(sum(t.rows), 0) AS train_rows, sum(t.total) AS train_total FROM p v LEFT JOIN p t
  ON t.stamp < v.stamp AND (t.season <> v.season OR t.period + {horizon} <= v.period)
  GROUP BY ALL HAVING count(t.stamp) >= {MIN_PERIODS}),
folds AS (SELECT *, row_number() OVER (ORDER BY stamp, season, period) AS fold FROM c)"""


def q_rolling_origin_folds(spark, folder):
    out = rolling_origin_folds(monthly_orders(spark, folder), "season", "period", "stamp",
                               FOLD_HORIZON, MIN_PERIODS)
    return out.withColumn("period", F.col("period").cast("bigint"))


ROLLING_ORIGIN_FOLDS = f"""
WITH {_folds_sql(FOLD_HORIZON)}
SELECT season, period, stamp, validation_rows, train_periods, CAST(train_rows AS BIGINT)
  AS train_rows, fold FROM folds"""


def q_spaced_folds(spark, folder):
    folds = rolling_origin_folds(monthly_orders(spark, folder), "season", "period", "stamp", 1,
                                 MIN_PERIODS)
    return spaced_folds(folds, FOLDS).select("fold", "season", "period", "train_rows")


SPACED_FOLDS = f"""
WITH {_folds_sql(1)}, n AS (SELECT count(*) AS n FROM folds)
SELECT fold, season, period, CAST(train_rows AS BIGINT) AS train_rows FROM folds, n
WHERE fold - 1 IN (SELECT CAST(trunc(k * (n - 1) / {FOLDS - 1}.0) AS BIGINT)
  FROM range({FOLDS}) AS r(k), n)"""


def q_fold_baseline(spark, folder):
    """Mean baseline of every fold, scored on its rows; one pass, no fold loop."""
    orders = monthly_orders(spark, folder)
    folds = rolling_origin_folds(orders, "season", "period", "stamp", FOLD_HORIZON, MIN_PERIODS,
                                 {"total": "o_totalprice"})
    guess = folds.select("fold", "season", "period",
                         (F.col("train_total") / F.col("train_rows")).alias("prediction"))
    scored = orders.join(F.broadcast(guess), ["season", "period"]).select(
        "fold", F.col("o_totalprice").alias("actual"), "prediction")
    out = prediction_metrics(scored, ["fold"]).select("fold", "rows", "mae", "mean_prediction")
    return rounded(out, 4, "mae", "mean_prediction")


FOLD_BASELINE = f"""
WITH {_folds_sql(FOLD_HORIZON)}
SELECT fold, count(*) AS rows, round(avg(abs(o_totalprice - train_total / train_rows)), 4) AS mae,
  round(avg(train_total / train_rows), 4) AS mean_prediction
FROM o JOIN folds USING (season, period) GROUP BY 1"""


def q_feature_coverage(spark, folder):
    events = table(spark, folder, "events").select(
        "event_type", "value", F.get_json_object("props", "$.k").alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"))
    return rounded(coverage(events, ["value", "k", "missing"], ["event_type"]), 8, "coverage")


FEATURE_COVERAGE = """
WITH e AS (SELECT event_type, value, props ->> '$.k' AS k, props ->> '$.missing' AS missing
  FROM events)
SELECT 'value' AS column, round(avg(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END), 8) AS coverage
  FROM e UNION ALL
SELECT 'k', round(avg(CASE WHEN try_cast(k AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END), 8) FROM e
UNION ALL SELECT 'missing', round(avg(CASE WHEN try_cast(missing AS DOUBLE) IS NOT NULL THEN 1
  ELSE 0 END), 8) FROM e UNION ALL
SELECT 'event_type', round(avg(CASE WHEN event_type IS NOT NULL THEN 1 ELSE 0 END), 8) FROM e"""


def q_season_audit(spark, folder):
    events = table(spark, folder, "events").select(
        "event_type", "user_id", F.floor(seconds("ts") / 600).alias("slot"), "value",
        F.when(F.col("value") > 2, F.get_json_object("props", "$.k")).alias("k"))
    # The schedule of a type is every slot of its span in which anything happened.
    spans = events.groupBy("event_type").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    planned = spans.select("event_type", F.explode(F.sequence("a", "b")).alias("slot")).join(
        events.select("slot").distinct(), "slot").select("slot", "event_type")
    clubs = events.select("event_type", (F.col("user_id") % 20).alias("club"))
    out = season_audit(events, ["event_type"], "slot", "user_id", ["user_id", "slot"], planned,
                       distinct={"different_values": "value", "different_keys": "k"}, covered=["value", "k", "absent"],
                       tables={"fixtures": (planned, "slot"), "clubs": (clubs, "club")})
    out = out.select(
        "event_type", "rows", "entities", "periods", "first_period", "last_period",
        "repeated_rows", F.size("missing_periods").cast("bigint").alias("missing"),
        F.size("blank_periods").cast("bigint").alias("blank"), "different_values", "different_keys", "fixtures", "clubs",
        "column_count", *[F.col("coverage")[c].alias(f"{c}_share") for c in ("value", "k", "absent")])
    return rounded(out, 8, "value_share", "k_share")


SEASON_AUDIT = f"""
WITH e AS (SELECT event_type, user_id, {SLOT.format('ts')} AS slot, value,
  CASE WHEN value > 2 THEN json_extract_string(props, '$.k') END AS k FROM events),
b AS (SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS entities,
  count(DISTINCT value) AS different_values, count(DISTINCT k) AS different_keys, count(DISTINCT user_id % 20) AS clubs,
  round(count(value) / count(*), 8) AS value_share, round(count(k) / count(*), 8) AS k_share,
  count(DISTINCT slot) AS periods, min(slot) AS first_period, max(slot) AS last_period
  FROM e GROUP BY 1),
k AS (SELECT event_type, sum(n - 1) AS r FROM (SELECT event_type, user_id, slot, count(*) AS n
  FROM e GROUP BY ALL) GROUP BY 1)
SELECT event_type, rows, entities, periods, first_period, last_period,
  CAST(r AS BIGINT) AS repeated_rows, last_period - first_period + 1 - periods AS missing,
  last_period - first_period + 1 - (SELECT count(DISTINCT slot) FROM e
    WHERE slot BETWEEN first_period AND last_period) AS blank, different_values, different_keys,
  (SELECT count(DISTINCT slot) FROM e WHERE slot BETWEEN first_period AND last_period) AS fixtures, clubs,
  5 AS column_count, value_share, k_share, NULL::DOUBLE AS absent_share
FROM b JOIN k USING (event_type)"""


def q_training_coverage(spark, folder):
    return training_coverage(monthly_orders(spark, folder), "season", "period")


TRAINING_COVERAGE = f"""
WITH {ORDERS_SQL}
SELECT season, min(period) AS first_period, max(period) AS last_period,
  count(DISTINCT period) AS periods FROM o GROUP BY 1"""


def q_distribution_summary(spark, folder):
    orders = table(spark, folder, "orders").select("o_totalprice")
    out = distribution_summary(orders, {"o_totalprice": {
        "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}})
    return rounded(out, 4, "value")


DISTRIBUTION_SUMMARY = " UNION ALL ".join(
    f"SELECT 'o_totalprice' AS column, '{n}' AS quantile, round(quantile_cont(o_totalprice, {q}), 4)"
    " AS value FROM orders"
    for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99),
                 ("max", 1.0)))


def q_cost_summary(spark, folder):
    costs = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("cost"))
    return rounded(cost_summary(costs, "cost"), 4, "minimum", "median", "maximum")


COST_SUMMARY = """
SELECT round(min(c), 4) AS minimum, round(median(c), 4) AS median, round(max(c), 4) AS maximum
FROM (SELECT sum(l_extendedprice) AS c FROM lineitem GROUP BY l_orderkey)"""


def q_duplicate_keys(spark, folder):
    return duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


DUPLICATE_KEYS = """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2
HAVING count(*) > 1"""


def q_late_rows(spark, folder):
    """Line items shipped after a deadline of 60 days from the order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("deadline"))
    _, late = split_by_deadline(lines.join(orders, "l_orderkey"), "l_shipdate", "deadline")
    return late.groupBy("l_orderkey").agg(F.count("*").alias("late_lines"))


LATE_ROWS = """
SELECT l_orderkey, count(*) AS late_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY GROUP BY 1"""

RIDGE_PENALTY = 10.0


def monthly_lines(spark, folder):
    """Line items by month shipped: price to be told from quantity and discount."""
    return table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("season"), F.month("l_shipdate").cast("bigint").alias("period"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("stamp"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("discount"))


def q_fold_ridge(spark, folder):
    """Ridge of price on quantity and a discount that is often missing, for all folds in one pass."""
    lines = monthly_lines(spark, folder)
    chosen = spaced_folds(rolling_origin_folds(lines, "season", "period", "stamp", FOLD_HORIZON, MIN_PERIODS), FOLDS)
    folds = [r.asDict() for r in chosen.orderBy("fold").collect()]
    trains = {f["fold"]: trained_on(f, "season", "period", "stamp", FOLD_HORIZON) for f in folds}
    models = fold_ridges(lines, ["quantity", "discount"], [], "price", trains, RIDGE_PENALTY)
    fitted = spark.createDataFrame(
        [(m.fold, m.rows, m.slopes["quantity"], m.slopes["discount"], m.absent["discount"], m.intercept) for m in models],
        "fold bigint, train_rows bigint, per_quantity double, per_discount double, discount_missing double, intercept double")
    held = lines.join(F.broadcast(chosen.select("season", "period", "fold")), ["season", "period"])
    errors = fold_predictions(held, models).groupBy("fold").agg(
        F.count("*").alias("rows"), F.avg(F.abs(F.col("prediction") - F.col("price"))).alias("mae"))
    return rounded(fitted.join(errors, "fold"), 3, "per_quantity", "per_discount", "discount_missing", "intercept", "mae")


FOLD_RIDGE = f"""
WITH l AS (SELECT year(l_shipdate) AS season, month(l_shipdate) AS period,
  year(l_shipdate) * 12 + month(l_shipdate) AS stamp, l_extendedprice AS y, l_quantity AS q,
  CASE WHEN l_linenumber <> 3 THEN l_discount END AS d FROM lineitem),
p AS (SELECT season, period, stamp, count(*) AS rows FROM l GROUP BY ALL),
c AS (SELECT v.season, v.period, v.stamp, count(t.stamp) AS n FROM p v LEFT JOIN p t
  ON t.stamp < v.stamp AND (t.season <> v.season OR t.period + {FOLD_HORIZON} <= v.period)
  GROUP BY ALL HAVING count(t.stamp) >= {MIN_PERIODS}),
f AS (SELECT *, row_number() OVER (ORDER BY stamp, season, period) AS fold, count(*) OVER () AS folds FROM c),
k AS (SELECT season, period, stamp, fold FROM f WHERE folds <= {FOLDS} OR fold - 1 IN (
  SELECT CAST(floor(i * (folds - 1) / {FOLDS - 1}.0::DOUBLE) AS BIGINT) FROM range({FOLDS}) AS r(i))),
t AS (SELECT k.fold, l.* FROM k JOIN l ON l.stamp < k.stamp AND (l.season <> k.season
  OR l.period + {FOLD_HORIZON} <= k.period)),
m AS (SELECT fold, median(d) AS md FROM t GROUP BY 1),
x AS (SELECT fold, y, q AS a, coalesce(d, md) AS b, CASE WHEN d IS NULL THEN 1.0::DOUBLE ELSE 0 END AS z FROM t JOIN m USING (fold)),
s AS (SELECT fold, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(z) AS mz, stddev_pop(a) AS sa,
  stddev_pop(b) AS sb, stddev_pop(z) AS sz, count(*) * corr(a, b) AS ab, count(*) * corr(a, z) AS az,
  count(*) * corr(b, z) AS bz, count(*) * covar_pop(a, y) / stddev_pop(a) AS ay,
  count(*) * covar_pop(b, y) / stddev_pop(b) AS by_, count(*) * covar_pop(z, y) / stddev_pop(z) AS zy, n + {RIDGE_PENALTY} AS g
  FROM x GROUP BY 1),
w AS (SELECT *, g * (g * g - bz * bz) - ab * (ab * g - bz * az) + az * (ab * bz - g * az) AS det FROM s),
u AS (SELECT *, (ay * (g * g - bz * bz) - ab * (by_ * g - bz * zy) + az * (by_ * bz - g * zy)) / det / sa AS wa,
  (g * (by_ * g - zy * bz) - ay * (ab * g - bz * az) + az * (ab * zy - by_ * az)) / det / sb AS wb,
  (g * (g * zy - bz * by_) - ab * (ab * zy - by_ * az) + ay * (ab * bz - g * az)) / det / sz AS wz FROM w),
r AS (SELECT u.fold, n, wa, wb, wb * md + wz AS absent, my - wa * ma - wb * mb - wz * mz AS i FROM u JOIN m USING (fold)),
e AS (SELECT r.fold, count(*) AS rows, avg(abs(i + wa * q + coalesce(wb * d, absent) - y)) AS mae
  FROM r JOIN k USING (fold) JOIN l USING (season, period) GROUP BY 1)
SELECT r.fold, n AS train_rows, round(wa, 3) AS per_quantity, round(wb, 3) AS per_discount,
  round(absent, 3) AS discount_missing, round(i, 3) AS intercept, rows, round(mae, 3) AS mae FROM r JOIN e USING (fold)"""


QUERIES = {
    "prediction_metrics": (q_prediction_metrics, PREDICTION_METRICS),
    "rank_correlation": (q_rank_correlation, RANK_CORRELATION),
    "calibration_bins": (q_calibration_bins, CALIBRATION_BINS),
    "brier_scores": (q_brier_scores, BRIER_SCORES),
    "rolling_origin_folds": (q_rolling_origin_folds, ROLLING_ORIGIN_FOLDS),
    "spaced_folds": (q_spaced_folds, SPACED_FOLDS),
    "fold_baseline": (q_fold_baseline, FOLD_BASELINE),
    "feature_coverage": (q_feature_coverage, FEATURE_COVERAGE),
    "season_audit": (q_season_audit, SEASON_AUDIT),
    "training_coverage": (q_training_coverage, TRAINING_COVERAGE),
    "fold_ridge": (q_fold_ridge, FOLD_RIDGE),
    "distribution_summary": (q_distribution_summary, DISTRIBUTION_SUMMARY),
    "cost_summary": (q_cost_summary, COST_SUMMARY),
    "duplicate_keys": (q_duplicate_keys, DUPLICATE_KEYS),
    "late_rows": (q_late_rows, LATE_ROWS),
}
