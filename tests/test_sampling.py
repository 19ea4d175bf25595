"""Laws and reproducibility of the sampling operators."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators.guards import ContractError
from tidemark.operators.joins import match_names
from tidemark.operators.sampling import (
    cluster_sample,
    hash_uniform,
    product_subsets,
    successive_draws,
)

WEIGHTS = {1: 5.0, 2: 2.0, 3: 1.5, 4: 1.0, 5: 0.5}


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame([("p", i, w) for i, w in WEIGHTS.items()],
                                 "pos string, item int, w double")


def test_uniform_is_uniform(spark):
    u = spark.range(20_000).select(hash_uniform(1, F.col("id")).alias("u"))
    row = u.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= row[0] and row[1] < 1 and row[2] == pytest.approx(0.5, abs=0.01)


def test_successive_draws_follow_their_law(pool):
    n = 20_000
    rows = successive_draws(pool, "pos", "item", F.col("w"), {"p": 2}, n, 7).collect()
    pairs = Counter(tuple(sorted(r["item"] for r in group)) for _, group in itertools.groupby(
        sorted(rows, key=lambda r: r["draw"]), key=lambda r: r["draw"]))
    total = sum(WEIGHTS.values())
    for a, b in itertools.combinations(WEIGHTS, 2):
        x, y = WEIGHTS[a], WEIGHTS[b]
        want = x / total * y / (total - x) + y / total * x / (total - y)
        assert pairs[(a, b)] / n == pytest.approx(want, abs=0.015)


def test_product_subsets_follow_their_law(pool):
    rows = product_subsets(pool, "pos", "item", F.col("w"), {"p": 2}, 30_000, 7).collect()
    pairs = Counter(tuple(sorted(r["item"] for r in group)) for _, group in itertools.groupby(
        sorted(rows, key=lambda r: r["subset"]), key=lambda r: r["subset"]))
    norm = sum(WEIGHTS[a] * WEIGHTS[b] for a, b in itertools.combinations(WEIGHTS, 2))
    n = sum(pairs.values())
    for a, b in itertools.combinations(WEIGHTS, 2):
        assert pairs[(a, b)] / n == pytest.approx(WEIGHTS[a] * WEIGHTS[b] / norm, abs=0.015)


def test_draws_do_not_depend_on_partitioning(spark, pool):
    def draw(df):
        out = successive_draws(df, "pos", "item", F.col("w"), {"p": 2}, 50, 7).collect()
        return sorted((r["draw"], r["item"]) for r in out)

    one = draw(pool.coalesce(1))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert draw(pool.repartition(5)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_quota_above_pool_is_refused(pool):
    with pytest.raises(ContractError):
        successive_draws(pool, "pos", "item", F.col("w"), {"p": 6}, 5, 7)


def test_cluster_sample(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("page"), F.col("id").alias("entry"))
    a = cluster_sample(df, "page", "entry", 25, 10, 3)
    assert a.count() == 25 and a.select("page").distinct().count() <= 3
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, cluster_sample(
        df.repartition(9), "page", "entry", 25, 10, 3).collect()))


def similarity(a, b):
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        current = [i]
        for j, y in enumerate(b, 1):
            current.append(min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (x != y)))
        previous = current
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    score = 1 - previous[-1] / longer
    return max(score, 0.75 + 0.25 * shorter / longer) if a in b or b in a else score


def test_name_matching_misses_no_pair(spark):
    names = ["a", "aa", "aaaa", "aaab", "bbbb", "saka", "salah", "salahh", "haaland", "halland",
             "martinelli", "martineli", "odegaard", "ødegard", "x", "ab", "aba", "abab", "de"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {(r["observed"], r["candidate"]): r["score"] for r in match_names(
        df, "n", df, "n", "n", 0.8, top=100).collect()}
    plain = {n: n.replace("ø", "") for n in names}
    want = {}
    for a, b in itertools.product(names, repeat=2):
        forms = {plain[a]} | {w for w in plain[a].split() if len(w) > 2}
        score = max(similarity(f, plain[b]) for f in forms)
        if score >= 0.8 - 1e-12:
            want[(a, b)] = pytest.approx(score)
    assert got == want
