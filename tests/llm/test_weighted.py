import hashlib
import math

import numpy as np
from cases import empty, odd, odd_rows, plain, small_docs

from tidemark.llm.weighted import edited, fingerprint, likeness, neighbour_likeness, signature, terms


def generalised_jaccard(a, b):
    x, y = dict(zip(*map(np.ndarray.tolist, a))), dict(zip(*map(np.ndarray.tolist, b)))
    keys = x.keys() | y.keys()
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def weighted(source, shared, own, high):
    keys = source.integers(0, 1 << 63, shared + own, dtype=np.uint64)
    return np.unique(keys), source.integers(1, high + 1, shared + own)


def test_collision_rate_is_generalised_jaccard():
    source = np.random.default_rng(0)
    for high in (1, 2, 20):
        for size, drop in ((50, 10), (400, 150), (3000, 2000)):
            keys = np.unique(source.integers(0, 1 << 63, size, dtype=np.uint64))
            w = source.integers(1, high + 1, len(keys))
            other = np.maximum(1, w + source.integers(-high // 2, high // 2 + 1, len(keys)))
            a, b = (keys[:-drop], w[:-drop]), (keys[drop // 2:], other[drop // 2:])
            n = 4096
            want, got = generalised_jaccard(a, b), likeness(signature(*a, n), signature(*b, n))
            assert abs(want - got) < 5 * math.sqrt(want * (1 - want) / n) + 0.01, (high, size)


def test_terms():
    keys, weights = terms("A b c d e a B c d e")
    assert weights.sum() == 10 and len(keys) == 9 and weights.max() == 2
    assert len(terms("")[0]) == 0 and len(terms("one")[0]) == 1
    assert (terms("One  two\nTHREE")[0] == terms("one two three")[0]).all()


def slow(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        changed = text[:len(text) - len(text) // 4] + following[:len(text) // 4]
        a, b, c = fingerprint(text), fingerprint(changed), fingerprint(following)
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), a.astype(">u2").tobytes().hex(),
                    b.astype(">u2").tobytes().hex(), likeness(a, b), likeness(a, c)))
    return sorted(out, key=repr)


def test_matches_a_sequential_pass(spark):
    for rows in (small_docs(), [(r[0], r[1]) for r in odd_rows()], [(4, "alone")]):
        found = neighbour_likeness(plain(spark, rows).repartition(5))
        assert sorted((tuple(r) for r in found.collect()), key=repr) == slow(rows)
    assert neighbour_likeness(odd(spark)).count() == len(odd_rows())
    assert neighbour_likeness(empty(spark)).count() == 0
    assert edited("abcd", "xyz") == "abcx" and edited("abcdefgh", "x") == "abcdefx"
