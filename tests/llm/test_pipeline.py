import corpus_pipeline
from cases import SMALL, empty, odd
from test_positional import slow as slow_contamination
from test_simhash import slow_components

import duckdb
from pyspark.sql import functions as F


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.collect()}
        if name != "tokens":
            assert docs.columns == columns
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert seen[name] == {c for _, _, c in slow_components(rows)}
        if name == "decontamination":
            items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert seen[name] == {r[0] for r in slow_contamination(rows, items) if not r[4]}
    assert seen["tokens"] == seen["decontamination"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()} == seen["tokens"]


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def with_columns(docs):
    """Odd rows under the columns of documents, and further ones with names that clash."""
    return docs.withColumns({"n_chars": F.length("text").cast("bigint"), "lang": F.lit("en"), "source": F.lit("s")})


def test_empty_documents(spark):
    for name, stage in corpus_pipeline.STAGES:
        docs = with_columns(empty(spark))
        out = stage(spark, docs, SMALL)
        assert out.count() == 0, name
        assert name == "tokens" or out.columns == docs.columns


def test_odd_documents(spark):
    """Null ids and texts, repeated rows and ids, empty and long texts, clashing columns."""
    docs = with_columns(odd(spark))
    rows = docs.select("doc_id", "text").collect()
    everything = sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        kept = out.collect()
        if name == "tokens":
            assert sorted((r["doc_id"] for r in kept), key=repr) == sorted((i for i, _ in everything), key=repr)
            assert all((r["n_tokens"] == 0) == (not r["decoded"]) for r in kept)
            continue
        assert out.columns == docs.columns and all(r["leader"] == "l" and r["score"] == 0.5 for r in kept), name
        mine = sorted(((r["doc_id"], r["text"]) for r in kept), key=repr)
        if name in ("toxicity", "decontamination"):
            assert mine == everything, name
        elif name == "line_dedup":
            assert sorted((i for i, _ in mine), key=repr) == sorted((i for i, _ in everything), key=repr)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept)
            assert (1, None) in mine and (None, None) in mine
        else:
            ids = [i for i, _ in mine]
            assert 6 in ids and 7 not in ids and ids.count(5) == 3 and None in ids
