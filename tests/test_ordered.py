"""Chunked operators against plain windows, also with hot keys and values."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import calendar_windows
from tidemark.operators.evaluation import calibration_bins, prediction_metrics, rank_correlations
from tidemark.operators.ordered import average_ranks, exact_quantiles, past_totals
from tidemark.operators.temporal import lag_or_own, latest_wins
from tidemark.session import plain_scan


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, a third on one order value."""
    random.seed(5)
    rows = [("hot" if i % 3 == 0 else f"k{i % 17}", 7.0 if random.random() < 0.34 else
             random.uniform(0, 20), i, None if i % 11 == 0 else float(i % 5)) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, o double, i bigint, v double").repartition(7)


@pytest.mark.parametrize("chunks", [None, 1, 13])
def test_past_totals(skewed, chunks):
    w = Window.partitionBy("k").orderBy("o", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select("i", F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("s"),
                         F.count("*").over(w).alias("past_rows")).orderBy("i").collect()
    got = past_totals(skewed, ["k"], ["o", "i"], {"s": F.col("v")}, chunks=chunks).select(
        "i", "s", "past_rows").orderBy("i").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_lag_keeps_later_nulls(skewed):
    plain = lag_or_own(skewed, ["k"], ["o", "i"], "v", "p", chunks=1).select("i", "p")
    cut = lag_or_own(skewed, ["k"], ["o", "i"], "v", "p", chunks=13).select("i", "p")
    assert plain.exceptAll(cut).count() == 0 and cut.count() == 3000


@pytest.mark.parametrize("chunks", [None, 1, 13])
def test_exact_quantiles(skewed, chunks):
    got = exact_quantiles(skewed, ["k"], "o", {"a": 0.1, "m": 0.5, "z": 1.0}, chunks)
    want = skewed.groupBy("k").agg(F.percentile("o", F.array(F.lit(0.1), F.lit(0.5), F.lit(1.0)))
                                   .alias("q"))
    for row in got.join(want, "k").collect():
        assert [row["a"], row["m"], row["z"]] == pytest.approx(row["q"])


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 3.0)], "v double")
    ranks = {r["v"]: r["rank"] for r in average_ranks(df, [], "v").collect()}
    assert ranks == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0}


def test_rank_correlation_ignores_constant_groups(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 3.0, 9.0), ("b", 1.0, 5.0), ("b", 2.0, 5.0),
            ("c", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, actual double, prediction double")
    got = {r["g"]: r["rank_correlation"] for r in rank_correlations(df, ["g"]).collect()}
    assert got == {"a": pytest.approx(1.0), "b": None, "c": None}


def test_calibration_chunks_agree(skewed):
    df = skewed.select(F.col("v").alias("actual"), F.col("o").alias("prediction"))
    a = calibration_bins(df, 5, chunks=1).orderBy("bin").collect()
    b = calibration_bins(df, 5, chunks=9).orderBy("bin").collect()
    assert [r["count"] for r in a] == [r["count"] for r in b]
    assert sum(r["count"] for r in a) == df.filter("actual IS NOT NULL").count()


def test_blank_is_zero_and_missing_is_unknown(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 3, 4.0), (2, 1, 1.0), (2, 3, None)],
                               "p int, g int, v double")
    blanks = spark.createDataFrame([(2,)], "g int")
    out = {(r["p"], r["g"]): r for r in calendar_windows(
        df, [], ["p"], "g", past={2: {"mean": "v"}}, future={3: {"next": "v"}},
        known={2: "known"}, blanks=blanks).collect()}
    assert out[(1, 1)]["next"] == 6.0
    assert out[(2, 1)]["next"] is None
    assert out[(1, 3)]["mean"] == 1.0 and out[(1, 3)]["known"] == 2.0
    assert out[(1, 1)]["mean"] is None and out[(1, 1)]["known"] == 0.0


def test_blocks_do_not_change_windows(spark):
    rows = [(p, g, float(p * g % 7)) for p in range(5) for g in range(-20, 60) if (p + g) % 4]
    df = spark.createDataFrame(rows, "p int, g int, v double")
    spans = dict(past={3: {"mean": "v"}}, future={4: {"next": "v"}})
    whole = calendar_windows(df, [], ["p"], "g", block=10_000, **spans)
    cut = calendar_windows(df, [], ["p"], "g", block=5, **spans)
    assert whole.exceptAll(cut).count() == 0 and cut.count() == len(rows)


def test_latest_wins_breaks_ties_by_file(spark):
    df = spark.createDataFrame([(1, "t1", "a", 2), (1, "t2", "a", 4), (1, "t2", "b", 5)],
                               "k int, t string, f string, v int")
    assert [r["v"] for r in latest_wins(df, ["k"], ["t", "f"]).collect()] == [5]


def test_windows_are_cut_by_chunk(skewed):
    """No window's partition is a whole key, whatever the size of the input."""
    plan = past_totals(skewed, ["k"], ["o", "i"], {"s": F.col("v")})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line and "__w_" in line]
    assert windows and all("__chunk" in line.rsplit("], [", 2)[1] for line in windows)


ODD = [float("inf"), float("-inf"), float("nan"), None]


def odd_rows(hot):
    """Finite values beside all that are none; ``hot`` of them is a third of the rows."""
    random.seed(11)
    rows = [(f"k{i % 3}", float(i % 50), i) for i in range(200)] + [(f"k{i % 3}", v, 200 + i) for i, v in enumerate(ODD * 5)]
    return rows + [(f"k{i % 3}", hot, 300 + i) for i in range(110)]


@pytest.mark.parametrize("hot", ODD)
@pytest.mark.parametrize("chunks", [None, 1, 13])
def test_past_totals_of_values_that_are_no_numbers(spark, hot, chunks):
    df = spark.createDataFrame(odd_rows(hot), "k string, o double, i bigint").repartition(5)
    w = Window.partitionBy("k").orderBy("o", "i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("i", F.coalesce(F.sum("i").over(before), F.lit(0)).alias("s"), F.lag("i").over(w).alias("p")).orderBy("i")
    got = past_totals(df, ["k"], ["o", "i"], {"s": F.col("i")}, {"p": "i"}, chunks).select("i", "s", "p").orderBy("i")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert got.count() == 330


@pytest.mark.parametrize("hot", [v for v in ODD if v is not None])
def test_ranks_and_quantiles_of_values_that_are_no_numbers(spark, hot):
    df = spark.createDataFrame(odd_rows(hot), "k string, o double, i bigint")
    known = [v for _, v, _ in odd_rows(hot) if v is not None]
    order = sorted(known, key=lambda v: (v != v, 0.0 if v != v else v))
    ranks = {}
    for place, v in enumerate(order):
        ranks.setdefault(repr(v), []).append(place + 1)
    got = {repr(r["o"]): r["rank"] for r in average_ranks(df, [], "o", chunks=7).collect()}
    assert got == {v: sum(places) / len(places) for v, places in ranks.items()}
    row = exact_quantiles(df, [], "o", {"low": 0.0, "middle": 0.5}, chunks=7).first()
    assert row["low"] == float("-inf")
    spots = (len(order) - 1) / 2
    assert repr(row["middle"]) == repr((order[int(spots)] + order[int(spots + 0.5)]) / 2)


def test_metrics_of_predictions_that_are_no_numbers(spark):
    rows = [("a", float(i), v) for i, v in enumerate([1.0, 2.0, float("inf"), float("-inf"), float("nan"), 3.0])]
    df = spark.createDataFrame(rows, "g string, actual double, prediction double")
    found = rank_correlations(df, ["g"]).first()
    assert found["rows"] == 6 and found["rank_correlation"] == pytest.approx(1 - 6 * 20 / (6 * 35))  # ranks 2 3 5 1 6 4
    assert prediction_metrics(df, ["g"]).first()["ranking_correlation"] == pytest.approx(found["rank_correlation"])
    assert sum(r["count"] for r in calibration_bins(df, 3).collect()) == 6


def test_plain_scans_are_not_written(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).selectExpr("id % 3 AS k", "id AS o", "id * 2 AS v").write.parquet(path)
    scan = spark.read.parquet(path).filter("v > 4").select("k", "o", (F.col("v") + 1).alias("v"))
    assert plain_scan(scan) and not plain_scan(scan.groupBy("k").count()) and not plain_scan(scan.join(scan.select("k"), "k"))
    totals = past_totals(scan, ["k"], ["o"], {"s": F.col("v")})
    assert {r["o"]: r["s"] for r in totals.collect()}[9] == 13 + 7
