import numpy as np
import xxhash
from cases import empty, odd, odd_rows, plain, small_docs

from tidemark.llm.simhash import covering_masks, fingerprint, near_duplicates, one_per_group


def slow_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def slow_components(rows, radius=3):
    prints = [slow_print(t) & (1 << 64) - 1 for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = [min((rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None), default=None)
           for i in range(len(rows))]
    return sorted(((r[0], p - (1 << 64) if p >> 63 else p, c) for r, p, c in zip(rows, prints, ids)), key=repr)


def test_every_pair_of_bits_within_the_radius_is_left_out_by_a_mask():
    for radius in (1, 2, 3):
        masks = covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        source = np.random.default_rng(1)
        for _ in range(3000):
            bits = source.choice(64, radius, replace=False)
            assert any(not any(m >> int(b) & 1 for b in bits) for m in masks)


def test_matches_brute_force(spark):
    rows = small_docs()
    found = near_duplicates(plain(spark, rows))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == slow_components(rows)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    found = sorted((tuple(r) for r in near_duplicates(odd(spark)).collect()), key=repr)
    assert found == slow_components(rows)
    assert near_duplicates(empty(spark)).count() == 0
    assert fingerprint("") == 0


def test_chains_and_contested_buckets(spark):
    """Links that no leader sees, and a chain longer than the radius."""
    from tidemark.llm.components import components
    from tidemark.llm.simhash import links

    source = np.random.default_rng(3)
    base = int(source.integers(1 << 40))
    prints = {base}
    for _ in range(300):
        x = source.choice(sorted(prints))
        prints.add(int(x) ^ (1 << int(source.integers(20))) ^ (1 << int(source.integers(20))))
    values = sorted(prints)
    roots = dict(tuple(r) for r in components(links(plain(spark, [(v,) for v in values], "fp bigint"))).collect())
    group = {v: v for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 3 and root(a) != root(b):
                group[max(root(a), root(b))] = min(root(a), root(b))
    assert {v: roots.get(v, v) for v in values} == {v: root(v) for v in values}


def test_one_per_group_keeps_columns(spark):
    kept = one_per_group(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 6 in ids and 7 not in ids and ids.count(5) == 3
