import re

import duckdb
from cases import SMALL, empty, odd, odd_rows, plain, small_docs

from tidemark.llm import common
from tidemark.llm.positional import (build_index, contamination, exact_phrases, proximity_matches,
                                     without_contaminated)


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    names |= windows[tuple(w[i:i + n])]
                    hit.update(range(i, i + n))
        out.append((doc_id, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in df.collect()), key=repr)


def test_matches_brute_force(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    bench = plain(spark, items, "item_id bigint, text string")
    assert rows(contamination(plain(spark, small_docs()), bench)) == slow(small_docs(), items)


def test_odd_rows_and_several_passes(spark):
    items = [(1, "two words"), (2, None), (3, ""), (None, "word"), (3, "alpha beta"), (4, "a very large id " * 6), (4, "word")]
    bench = plain(spark, items, "item_id bigint, text string")
    docs = [(r[0], r[1]) for r in odd_rows()]
    assert rows(contamination(odd(spark), bench)) == slow(docs, items)
    assert contamination(empty(spark), bench).count() == 0
    nothing = contamination(odd(spark), bench.limit(0))
    assert nothing.count() == len(docs) and nothing.where("contaminated").count() == 0
    index = build_index(odd(spark), row_words=50)
    one = exact_phrases(index, bench).collect()
    many = exact_phrases(index, bench, pass_windows=1).collect()
    key = lambda r: (r["row_id"], r["doc"], r["n_hit"], sorted(r["items"]))
    assert sorted(map(key, one)) == sorted(map(key, many))
    kept = without_contaminated(odd(spark), bench)
    assert kept.columns == odd(spark).columns and 5 not in {r["doc_id"] for r in kept.collect()}


def test_proximity(spark):
    docs = [(1, "red x x blue x green"), (2, "blue red"), (3, "green"), (4, "green red red blue")]
    index = build_index(plain(spark, docs))
    found = {tuple(r) for r in proximity_matches(index, ["red", "Blue", "green"], 6).collect()}
    assert found == {(1, 0, 6), (4, 0, 4)}
    assert {tuple(r) for r in proximity_matches(index, ["red", "blue"], 2).collect()} == {(2, 0, 2), (4, 2, 2)}
    assert proximity_matches(index, ["absent", "red"], 9).count() == 0


def test_index_is_deleted_once_documents_are_judged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    bench = spark.createDataFrame([("a", "qqq www eee")], "item_id string, text string")
    kept = without_contaminated(plain(spark, small_docs()), bench)
    assert [p.name.split("-")[1] for p in tmp_path.iterdir()] == ["bad"]
    assert kept.count() == len(small_docs())
