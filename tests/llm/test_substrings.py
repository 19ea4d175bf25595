import hashlib
import random
from collections import Counter

import numpy as np
from cases import empty, odd, odd_rows, plain, small_docs

import tidemark.llm.substrings as substrings
from tidemark.llm.substrings import column_matches, gram_hashes, repeat_digests, without_repeats


def slow(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k:k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        hit = np.zeros(len(r) + 1, dtype=int)
        for k in range(len(r) - length + 1):
            if seen[r[k:k + length]] > 1:
                hit[k] += 1
                hit[k + length] -= 1
        gone = np.cumsum(hit[:-1]) > 0
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_counting_all_windows(spark):
    rows = small_docs()
    assert found(repeat_digests(plain(spark, rows))) == slow(rows, 400)


def test_short_lengths_periods_and_shared_phrases(spark):
    source = random.Random(6)
    phrase = "".join(source.choice("abcd ") for _ in range(90))
    rows = [(i, "".join(source.choice("abcdefgh") for _ in range(source.randrange(60))) + phrase[source.randrange(40):]
             + source.choice(["", "x", "ab" * 40, "a" * 70, phrase])) for i in range(120)]
    for gram in (4, 8, 11):
        assert found(repeat_digests(plain(spark, rows), length=24, gram=gram)) == slow(rows, 24)


def test_anchors_dealt_over_collections(spark, monkeypatch):
    """A phrase in many texts: its stretches are compared in parts that meet by window hashes."""
    source = random.Random(7)
    phrase = "".join(source.choice("abcd ") for _ in range(60))
    rows = [(i, "".join(source.choice("xyz") for _ in range(30)) + phrase + "".join(source.choice("xyz") for _ in range(30)))
            for i in range(150)]
    monkeypatch.setattr(substrings, "SHARE", 4)
    assert found(repeat_digests(plain(spark, rows), length=24, gram=8)) == slow(rows, 24)


def test_many_copies_of_one_text(spark):
    """A text that is most of all rows, and a variant that shares a part of it."""
    source = random.Random(9)
    text = "".join(source.choice("abcdefgh ") for _ in range(900))
    rows = [(i, text) for i in range(300)] + [(900, "x" * 50 + text[200:700] + "y" * 50), (901, "alone " * 5)]
    assert found(repeat_digests(plain(spark, rows))) == slow(rows, 400)


def test_columns_find_neighbours():
    source = np.random.default_rng(1)
    rows = source.integers(0, 2, (40, 60)).astype(np.uint16)
    got = set()
    for j, order, opens, meets in column_matches(rows.T, 6):
        got |= {(int(i), j) for i in order[opens | meets]}
    want = {(i, j) for j in range(5, 60) for i in range(40)
            if any(k != i and (rows[k, j - 5:j + 1] == rows[i, j - 5:j + 1]).all() for k in range(40))}
    assert got == want


def test_gram_hashes_follow_content():
    raw = np.frombuffer(b"abcabcabcabcx", np.uint8)
    for gram in (1, 3, 5, 8):
        h = gram_hashes(raw, gram)
        assert len(h) == len(raw) - gram + 1
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (raw[i:i + gram].tobytes() == raw[j:j + gram].tobytes())


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert found(repeat_digests(odd(spark))) == slow(rows, 400)
    assert repeat_digests(empty(spark)).count() == 0
    kept = without_repeats(odd(spark)).where("doc_id = 4").first()
    assert bytes(kept["kept"]) == b"word" and kept["removed"] == []
