"""Small tables with what real ones may hold, and slow exact versions to compare with."""

from __future__ import annotations

import random

import duckdb

SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, text string, fp bigint, line string, block int, spans string, score double, "
          "row_id bigint, leader string, _doc string, _gone string, kept_id int, term string")


def small_docs() -> list[tuple[int, str]]:
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


def odd_rows() -> list[tuple]:
    source = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "déjà", "naïve", "x1", "42", "straße", "İstanbul", "ﬁne", "日本語", "éa"]
    long_text = " ".join(source.choice(words) for _ in range(9000))
    unsplit = "".join(source.choice("abcdefgh'é日!9") for _ in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words"), (5, "two words"), (5, "other text of a repeated id"),
            (None, "a text without an id, and some more words"), (None, None), (6, long_text), (7, long_text), (8, unsplit),
            (9, "Line one is here.\nLine one is here.\n\nLine two differs."), (10, "line one is here.\r\nAnother, later line"),
            (-3, "negative id\x1cwith odd\x85space and <|endoftext|> inside  two spaces"), (11, "!!! ... 'll 's"),
            (1 << 62, "a very large id " * 40), (12, "a very large id " * 40)]
    return [(i, t, 1, "x", 2, "y", 0.5, 3, "l", "d", "g", 4, "t") for i, t in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)
