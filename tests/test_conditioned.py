"""Subsets under count and cost conditions against enumeration."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import conditioned
from tidemark.operators.conditioned import conditioned_inclusion, conditioned_subsets
from tidemark.operators.guards import ContractError

SCHEMA = "s string, i int, w double, c int"


def law(rows, quotas, low, high):
    """Every legal subset with its probability."""
    usable = [[r for r in rows if r[0] == s and r[2] and 0 < r[2] < math.inf] for s in quotas]
    out = {}
    for parts in itertools.product(*(itertools.combinations(u, q) for u, q in zip(usable, quotas.values()))):
        chosen = [r for part in parts for r in part]
        if low <= sum(r[3] for r in chosen) <= high:
            out[frozenset(r[1] for r in chosen)] = math.prod(r[2] for r in chosen)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def pool(seed, size=14):
    source = random.Random(seed)
    rows = [(source.choice("ab"), i, source.choice([0.01, 1.0, 3.0, source.random() * 50]), source.choice([0, 3, 4, 4, 7])) for i in range(size)]
    return rows + [("a", 100, 0.0, 1), ("b", 101, None, 1), ("c", 102, 5.0, 1), ("a", 103, float("inf"), 1)]


@pytest.mark.parametrize("bits", [1, 2, 7])
@pytest.mark.parametrize("quotas,low,high", [({"a": 2, "b": 3}, 12, 20), ({"a": 1}, 0, 50), ({"b": 3, "a": 2}, 18, 18), ({"b": 4}, 0, 13)])
def test_inclusion_equals_enumeration(spark, monkeypatch, bits, quotas, low, high):
    """With few children per node the trees are deep; the result is the same."""
    monkeypatch.setattr(conditioned, "FAN_BITS", bits)
    rows = pool(4)
    want = law(rows, quotas, low, high)
    got = conditioned_inclusion(spark.createDataFrame(rows, SCHEMA), "s", "i", F.col("w"), F.col("c"), quotas, low, high).collect()
    assert len(got) == len({r["i"] for r in got}) and sum(r["probability"] for r in got) == pytest.approx(sum(quotas.values()))
    for r in got:
        assert r["probability"] == pytest.approx(sum(p for s, p in want.items() if r["i"] in s), rel=1e-9, abs=1e-12)
    assert {i for s in want for i in s} <= {r["i"] for r in got}


@pytest.mark.parametrize("bits", [1, 7])
def test_draws_follow_the_law(spark, monkeypatch, bits):
    monkeypatch.setattr(conditioned, "FAN_BITS", bits)
    rows, quotas = pool(5, 11), {"a": 2, "b": 2}
    want = law(rows, quotas, 8, 15)
    df = spark.createDataFrame(rows, SCHEMA)
    drawn = conditioned_subsets(df, "s", "i", F.col("w"), F.col("c"), quotas, 8, 15, 4000, 3)
    subsets = {}
    for r in drawn.collect():
        subsets.setdefault(r["draw"], set()).add(r["i"])
    assert len(subsets) == 4000 and set(map(frozenset, subsets.values())) <= set(want)
    counts = {}
    for s in subsets.values():
        counts[frozenset(s)] = counts.get(frozenset(s), 0) + 1
    spread = sum((counts.get(s, 0) - 4000 * p) ** 2 / (4000 * p) for s, p in want.items() if 4000 * p >= 5)
    cells = sum(4000 * p >= 5 for p in want.values())
    assert spread < cells + 4 * math.sqrt(2 * cells)
    again = conditioned_subsets(df.repartition(3), "s", "i", F.col("w"), F.col("c"), quotas, 8, 15, 4000, 3)
    assert again.exceptAll(drawn).count() == 0


def test_rare_conditions_are_met(spark):
    """One subset in millions is legal: nothing is drawn in vain."""
    rows = [("a", i, 1000.0, 9) for i in range(300)] + [("a", 900 + i, 1e-6, 1) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    drawn = conditioned_subsets(df, "s", "i", F.col("w"), F.col("c"), {"a": 3}, 3, 3, 50, 1).collect()
    assert len(drawn) == 150 and {r["i"] for r in drawn} <= {900, 901, 902, 903}


def test_a_class_that_is_most_of_the_pool(spark, monkeypatch):
    """One cost for a third of the items and more: its tree has several levels."""
    monkeypatch.setattr(conditioned, "FAN_BITS", 3)
    rows = [("a", i, 1.0 + i % 5, 4 if i % 3 else 2) for i in range(900)]
    got = conditioned_inclusion(spark.createDataFrame(rows, SCHEMA), "s", "i", F.col("w"), F.col("c"), {"a": 2}, 6, 6).collect()
    twos, fours = (sum(r[2] for r in rows if r[3] == c) for c in (2, 4))
    for r in got:
        _, _, w, c = rows[r["i"]]
        assert r["probability"] == pytest.approx(w / (twos if c == 2 else fours))
    assert len(got) == 900


def test_conditions_that_nothing_meets(spark):
    df = spark.createDataFrame(pool(6), SCHEMA)
    args = ("s", "i", F.col("w"), F.col("c"))
    for quotas, low, high in (({"a": 1}, 60, 70), ({"a": 99}, 0, 500), ({}, 0, 5), ({"a": 0}, 0, 5), ({"a": 1}, 5, 4), ({"nobody": 1}, 0, 50)):
        with pytest.raises(ContractError):
            conditioned_inclusion(df, *args, quotas, low, high)
    with pytest.raises(ContractError, match="unique"):
        conditioned_inclusion(df.union(df), *args, {"a": 1}, 0, 50)
    with pytest.raises(ContractError, match="cost"):
        conditioned_inclusion(df.withColumn("c", F.lit(None).cast("int")), *args, {"a": 1}, 0, 50)
