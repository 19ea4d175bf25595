"""Lookups with contracts, suffixes, coverage, consensus."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.coerce import lenient_double, strict_boolean, strict_long
from tidemark.functions.numeric import ticks
from tidemark.operators.guards import ContractError, require_fields
from tidemark.operators.joins import (
    complete_with,
    inner_with_suffix,
    lookup,
    newest_identity,
    match_names,
    match_readings,
    reading_consensus,
    rows_of,
)
from tidemark.operators.managers import enrich_picks, selection_rates
from tidemark.operators.temporal import participation


def test_lookup_names_missing_keys_and_repeats(spark):
    facts = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ContractError, match="2"):
        lookup(facts, spark.createDataFrame([(1, "a")], "k int, n string"), ["k"])
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, n string")
    with pytest.raises(ContractError):
        enrich_picks(facts.withColumnRenamed("k", "player_id"),
                     twice.withColumnRenamed("k", "player_id"))


def test_suffix_and_completion(spark):
    left = spark.createDataFrame([(1, 2.0), (3, 1.0)], "k int, v double")
    right = spark.createDataFrame([(1, 5.0, 6.0)], "k int, v double, w double")
    assert inner_with_suffix(left, right, ["k"], "_r").columns == ["k", "v", "v_r", "w"]
    with pytest.raises(ContractError):
        inner_with_suffix(left, right.union(right), ["k"], "_r")
    assert complete_with(left, right, ["k"]).columns == ["k", "v", "w"]
    with pytest.raises(ContractError):
        complete_with(left, right, ["k"], ["w"])


def test_newest_snapshot_respects_filters(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 30)], "s string, g int, t int")
    kept = rows_of(df, newest_identity(df, ["s", "g"], "t", {"s": "a"}))
    assert [r["g"] for r in kept.collect()] == [2]
    early = newest_identity(df, ["s", "g"], "t", not_after=F.lit(10))
    assert [r["g"] for r in early.collect()] == [1]
    assert newest_identity(df, ["s", "g"], "t", {"s": "z"}).count() == 0


def test_reading_consensus(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 0.2), ("x", 0.4)], "n string, score double")
    assert reading_consensus(df, ["n"]).first()["score"] == pytest.approx(0.55 + 0.45 * 0.4)


def test_casts(spark):
    df = spark.createDataFrame([("1.5", " TRUE ", "3.0"), ("x", None, "4")],
                               "a string, b string, c string")
    row = df.select(lenient_double("a").alias("a"), strict_boolean("b").alias("b"),
                    strict_long("c").alias("c")).collect()
    assert [tuple(r) for r in row] == [(1.5, True, 3), (None, False, 4)]
    with pytest.raises(Exception):
        df.select(strict_long("a")).collect()
    with pytest.raises(Exception):
        df.select(strict_boolean("a")).collect()
    prices = spark.createDataFrame([(4.5,), (4.55,)], "p double")
    assert prices.limit(1).select(ticks(F.col("p"))).first()[0] == 45
    with pytest.raises(Exception):
        prices.select(ticks(F.col("p"))).collect()


def test_participation_and_required_fields(spark):
    df = spark.createDataFrame([(0, None), (59, 0), (60, 1), (None, 1)], "m int, s int")
    a, s = participation("m")
    rows = [tuple(r) for r in df.select(a, s).collect()]
    assert rows == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    _, started = participation("m", "s")
    assert [r[0] for r in df.select(started).collect()] == [0.0, 0.0, 1.0, 1.0]
    with pytest.raises(ContractError):
        require_fields(df, ["m"])


def test_rates_count_managers_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "m int, p string")
    no = F.lit(False)
    out = {r["p"]: r for r in selection_rates(df, "p", "m", no, no, no).collect()}
    assert out["a"]["sample_ownership_percent"] == 100.0
    assert out["b"]["sample_ownership_percent"] == 50.0


def test_unmatched_names_are_returned(spark):
    observed = spark.createDataFrame([("saka",), ("zzzz",), ("",), (None,)], "n string")
    names = spark.createDataFrame([(1, "Bukayo Saka", "Saka"), (2, "Salah", None)], "i int, f string, s string")
    with pytest.raises(TypeError):
        match_names(observed, "n", names, "i", "s")
    got = {r["observed"]: tuple(r)[1:] for r in match_names(
        observed, "n", names, "i", ["f", "s"], 0.8).collect()}
    nothing = (None, None, None)
    assert got == {"saka": (1, 1.0, 1), "zzzz": nothing, "": nothing, None: nothing}


def test_readings_below_the_minimum_are_blended(spark):
    """Readings 1.0 and 0.5 give 0.8875; a reading that recurs counts as often."""
    observed = spark.createDataFrame(
        [("a", "abcd"), ("a", "abxy"), ("b", "abcd"), ("b", "abxy"), ("b", "abxy"), ("c", "qqqq")],
        "slot string, n string")
    names = spark.createDataFrame([(1, "other", "abcd")], "i int, f string, s string")
    got = {r["observed_id"]: tuple(r)[1:] for r in match_readings(
        observed, "slot", "n", names, "i", ["f", "s"], 0.8).collect()}
    assert got["a"] == (1, pytest.approx(0.55 + 0.45 * 0.75), 1)
    assert got["b"] == (1, pytest.approx(0.55 + 0.45 * 0.5), 1)
    assert got["c"] == (None, None, None)
