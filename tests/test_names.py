"""Ranking without a minimum against a plain search."""

import random

import pytest

from tidemark.operators.guards import ContractError
from tidemark.operators.names import rank_names

LETTERS = "abcde"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    if not a or not b:
        return 0.0
    ratio = 1 - edits(a, b) / max(len(a), len(b))
    if a in b or b in a:
        return max(ratio, 0.75 + 0.25 * min(len(a), len(b)) / max(len(a), len(b)))
    return ratio


def forms(text):
    words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
    return {"".join(words)} | {w for w in words if len(w) > 2}


def slow(observed, candidates, top):
    out = set()
    for text, group in set(observed):
        scores = []
        for ident, names, kind in candidates:
            if group is None or group == kind:
                scores.append((-max(similarity(f, "".join(c for c in n if c.isalnum()))
                                    for f in forms(text) for n in [x or "" for x in names]), ident))
        best = sorted(scores)[:top]
        out |= {(text, group, ident, round(-s, 9), i + 1) for i, (s, ident) in enumerate(best)} or {
            (text, group, None, None, None)}
    return out


def run(spark, observed, candidates, top):
    left = spark.createDataFrame(observed, "n string, g string")
    right = spark.createDataFrame([(i, *names, g) for i, names, g in candidates], "i int, a string, b string, h string")
    rows = rank_names(left, "n", right, "i", ["a", "b"], top, "g", "h").collect()
    return {(r["observed"], r["observed_group"], r["candidate"],
             None if r["score"] is None else round(r["score"], 9), r["place"]) for r in rows}, len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_like_a_plain_search(spark, seed):
    """Few letters and short names: ties, containment, letters that recur, texts that share nothing."""
    source = random.Random(seed)

    def word(low, high):
        return "".join(source.choice(LETTERS) for _ in range(source.randint(low, high)))

    candidates = [(i, (word(1, 9), source.choice([None, "", word(2, 12)])), source.choice(["x", "y", "z"])) for i in range(60)]
    observed = [(source.choice([word(1, 10), word(3, 5) + " " + word(2, 6), word(2, 4) + "qqq" + word(0, 2), "ww", "z", "", None]),
                 source.choice([None, "x", "y", "w"])) for _ in range(70)]
    observed += observed[:10]
    for top in (1, 8):
        got, rows = run(spark, observed, candidates, top)
        want = slow(observed, candidates, top)
        assert got == want and rows == len(want)


def test_no_text_is_lost(spark):
    candidates = [(i, (n, None), "x") for i, n in enumerate(["saka", "salah", "son"])]
    got, _ = run(spark, [("zzzz", None), ("", None), (None, None), ("saka", "x"), ("saka", "nobody")], candidates, 2)
    assert {t for t, *_ in got} == {"zzzz", "", None, "saka"}
    assert ("zzzz", None, 0, 0.0, 1) in got and ("saka", "nobody", None, None, None) in got
    assert ("saka", "x", 0, 1.0, 1) in got and run(spark, [("a", None)], [], 3)[0] == {("a", None, None, None, None)}
    with pytest.raises(ContractError):
        run(spark, [("a", None)], candidates, 0)


def test_hot_text_is_ranked_once(spark):
    """A text read very often, and many candidates that share its letters."""
    candidates = [(i, (f"{'ab' * (i % 5)}c{i}", None), "x") for i in range(300)]
    got, rows = run(spark, [("abab c7", None)] * 500 + [("no 9", None)], candidates, 8)
    assert got == slow([("abab c7", None), ("no 9", None)], candidates, 8) and rows == 16


def test_pairs_are_not_all_made(spark):
    """Texts that have their eight close matches leave before letters are compared."""
    names = [f"name {i:04d} of many" for i in range(400)]
    left = spark.createDataFrame([(n,) for n in names[:200]], "n string")
    right = spark.createDataFrame(list(enumerate(names)), "i int, a string")
    out = rank_names(left, "n", right, "i", "a", 8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 1600 and "array_intersect" not in plan
    assert all("Cross" not in line or "__ids" in plan for line in plan.splitlines())
