import random
import re
import zlib

from cases import SMALL, empty, odd, odd_rows, plain

from tidemark.llm import spelling
from tidemark.llm.spelling import neighbours, rotations, spelling_variants


def slow_words(rows):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def slow(rows):
    words = slow_words(rows)
    lengths = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w, n in words.items():
        others = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in lengths.get(size, []) if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = (n, len(others))
    result = set()
    for w, (n, count) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        result.add((w, form[w], root, n, count, words[form[w]] if form[w] else None))
    return result


def rows_of(frame):
    rows = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = slow(rows)
    assert rows_of(spelling_variants(docs)) == want and len(want) > 500
    assert any(form for _, form, *_ in want)


def test_dense_neighbourhoods(spark):
    """Few letters, runs of equal ones, ties, chains of forms, accents, rotations of each other."""
    source = random.Random(9)
    rows = []
    for i in range(60):
        words = ["".join(source.choice("aabÀé") for _ in range(source.randint(5, 8))) for _ in range(150)]
        rows.append((i, " ".join(w for w in words for _ in range(source.choice([1, 1, 1, 3, 9])))))
    rows += [(100 + i, "aaaaaaa " * 30 ** min(i, 2) + "aaaaaa abaaaa") for i in range(8)]
    want = slow(rows)
    assert rows_of(spelling_variants(plain(spark, rows))) == want
    assert any(root not in (word, form) for word, form, root, *_ in want)


def test_long_words_are_whole(spark):
    """Words above PLAIN code points: hashed rotations, at the limit too."""
    source = random.Random(2)
    rows = []
    for size in (spelling.PLAIN - 2, spelling.PLAIN - 1, spelling.PLAIN, spelling.PLAIN + 1, 3 * spelling.PLAIN, 3000):
        base = "".join(source.choice("abcdefgà") for _ in range(size))
        at = size // 2
        for j, w in enumerate((base, base[:at] + "z" + base[at + 1:], base[:at] + base[at + 1:], base + "q", "y" + base,
                               base[:-1], base[::-1])):
            rows += [(size * 10 + j, f"{w} " * (5 if j else 40))]
    want = slow(rows)
    assert rows_of(spelling_variants(plain(spark, rows))) == want
    assert sum(form is not None for _, form, *_ in want) >= 30


def test_rotations_of_a_word():
    got = list(rotations("abb"))
    assert [k for k, role in got if role == 0] == ["abb$", "bb$a", "b$ab", "$abb"]
    assert [(k, role) for k, role in got if role] == [("bb$", 2), ("b$a", 2), ("$ab", 1)]


def test_output_grows_with_words_not_pairs(spark):
    """A group of all replacements of one letter: one row a word leaves its scan."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = sorted(f"{a}{b}illion" for a in letters for b in letters)
    frame = plain(spark, [(i, w, 5 + i % 7) for i, w in enumerate(words)], "id bigint, word string, n bigint")
    got = {r["id"]: (r["n_near"], r["best_n"], r["best"]) for r in neighbours(frame).collect()}
    assert len(got) == len(words) and {v[0] for v in got.values()} == {50}
    count = {w: 5 + i % 7 for i, w in enumerate(words)}
    for i, w in enumerate(words[:40]):
        best = min((v for v in words if near(w, v)), key=lambda v: (-count[v], v))
        assert got[i][1:] == (count[best], words.index(best))


def test_odd_rows(spark):
    want = slow([r[:2] for r in odd_rows()])
    assert rows_of(spelling_variants(odd(spark))) == want and want
    assert spelling_variants(empty(spark)).collect() == []
    nothing = plain(spark, [(None, None), (1, ""), (2, "short words only")])
    assert spelling_variants(nothing).collect() == []


def test_hot_text(spark):
    """One text that is a third of all rows, under one id and under many."""
    rows = [(7, "repeated wording of one document")] * 400 + [(i, f"another documents wordings {i}") for i in range(400)]
    rows += [(i, "repeated wording of one document") for i in range(1000, 1400)]
    assert rows_of(spelling_variants(plain(spark, rows))) == slow(rows)
