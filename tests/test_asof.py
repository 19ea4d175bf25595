"""As-of joins against a plain search, with hot keys and moments and odd values."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.guards import ContractError

NAN = float("nan")


def slow(probes, versions, strict=False, span=None):
    def later(a, b):  # as Spark sorts: NaN above all
        return (a != a, 0 if a != a else a) > (b != b, 0 if b != b else b)

    out = set()
    for key, at, name in probes:
        best = None
        for k, t, tie, value in versions:
            if None in (key, at, k, t) or k != key or later(t, at) or (strict and not later(at, t)):
                continue
            if span is not None and t < at - span:
                continue
            rank = (t != t, 0 if t != t else t, tie, value)
            if best is None or rank > best[0]:
                best = (rank, t, value)
        out.add((repr(key), repr(at), name, repr(best and best[1]), best and best[2]))
    return out


def run(spark, probes, versions, **how):
    p = spark.createDataFrame(probes, "k string, at double, name int").repartition(5)
    v = spark.createDataFrame(versions, "k string, t double, tie int, value string").repartition(3)
    rows = asof_join(p, v, ["k"], "at", "t", ["value"], ["tie"], **how).collect()
    assert len(rows) == len(probes)
    return {(repr(r["k"]), repr(r["at"]), r["name"], repr(r["t"]), r["value"]) for r in rows}


def tables(hot_key, hot_time, seed):
    """A third of both sides on one key, and a third of the probes at one moment."""
    source = random.Random(seed)

    def key():
        return "hot" if hot_key and source.random() < 0.34 else source.choice(["a", "b", "c", None])

    def moment():
        return 7.0 if hot_time and source.random() < 0.34 else source.choice(
            [float(source.randint(0, 20)), source.uniform(0, 20), None])

    probes = [(key(), moment(), i) for i in range(500)]
    versions = [(key(), moment(), source.randint(0, 2), f"v{source.randint(0, 9)}") for _ in range(120)]
    return probes, versions


@pytest.mark.parametrize("chunks", [None, 1, 9])
@pytest.mark.parametrize("hot", [(False, False), (True, True)])
def test_like_a_plain_search(spark, chunks, hot):
    probes, versions = tables(*hot, seed=1)
    assert run(spark, probes, versions, chunks=chunks) == slow(probes, versions)
    assert run(spark, probes, versions, chunks=chunks, strict=True) == slow(probes, versions, strict=True)


def test_versions_too_old_do_not_count(spark):
    probes, versions = tables(True, True, seed=2)
    got = run(spark, probes, versions, chunks=6, oldest=F.col("at") - 1.5)
    assert got == slow(probes, versions, span=1.5) and got != slow(probes, versions)


def test_values_that_are_no_numbers(spark):
    odd = [float("inf"), float("-inf"), NAN, None, 3.0]
    probes = [("a", at, i) for i, at in enumerate(odd * 20)]
    versions = [("a", at, 1, f"v{i}") for i, at in enumerate(odd[:4])] + [("a", 2.0, 0, "x")]
    for chunks in (1, 5):
        assert run(spark, probes, versions, chunks=chunks) == slow(probes, versions)


def test_ties_and_repeats(spark):
    versions = [("a", 1.0, 1, "low"), ("a", 1.0, 2, "high")] + [("a", 1.0, 2, "higher")] * 50
    probes = [("a", 1.0, 0), ("a", 1.0, 0), ("a", 0.5, 1), ("b", 9.0, 2), (None, 9.0, 3)]
    rows = run(spark, probes, versions)
    assert {(name, value) for _, _, name, _, value in rows} == {(0, "higher"), (1, None), (2, None), (3, None)}


def test_without_keys_and_without_rows(spark):
    p = spark.createDataFrame([(1.0, "x"), (5.0, "y")], "at double, name string")
    v = spark.createDataFrame([(2.0, "old"), (4.0, "new")], "t double, value string")
    got = {r["name"]: (r["t"], r["value"]) for r in asof_join(p, v, [], "at", "t", ["value"]).collect()}
    assert got == {"x": (None, None), "y": (4.0, "new")}
    assert asof_join(p, v.limit(0), [], "at", "t", ["value"]).count() == 2
    assert asof_join(p.limit(0), v, [], "at", "t", ["value"]).count() == 0
    with pytest.raises(ContractError, match="name"):
        asof_join(p, v.withColumn("name", F.lit(1)), [], "at", "t", ["name"])
    with pytest.raises(ContractError, match="lacks"):
        asof_join(p, v, ["k"], "at", "t", ["value"])


def test_plan_has_no_pairs_and_no_whole_key(spark):
    p = spark.createDataFrame([("a", 1.0)], "k string, at double")
    v = spark.createDataFrame([("a", 1.0, "x")], "k string, t double, value string")
    plan = asof_join(p, v, ["k"], "at", "t", ["value"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "NestedLoop" not in plan
    windows = [line for line in plan.split("\n") if "Window [" in line and "__here" in line]
    assert windows and all("__chunk" in line.rsplit("], [", 2)[1] for line in windows)
