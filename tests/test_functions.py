"""Casts of ids and folding of names."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.coerce import lenient_long, strict_long
from tidemark.functions.text import fold, match_key


def test_ids_beyond_doubles_are_exact(spark):
    big = [str(2**53 + 1), str(2**62 + 3), "-9007199254740993", "7.0"]
    rows = spark.createDataFrame([(v,) for v in big], "v string")
    got = [r[0] for r in rows.select(strict_long("v")).collect()]
    assert got == [2**53 + 1, 2**62 + 3, -(2**53 + 1), 7]
    loose = spark.createDataFrame([(big[0],), ("x",), (None,), ("8.9",), ("1e3",)], "v string")
    assert [r[0] for r in loose.select(lenient_long("v")).collect()] == [2**53 + 1, None, None, 8, 1000]
    for bad in ("7.5", "seven"):
        with pytest.raises(Exception):  # noqa: B017 - the engine's own error
            spark.createDataFrame([(bad,)], "v string").select(strict_long("v")).collect()


def test_folding_decomposes(spark):
    texts = {"Ångström": "angstrom", "ÉCLAIR": "eclair", "ﬁancé": "fiance", "ét̂": "et", "ǆ": "dz",
             "Ｗide１": "wide1", "Ḿǹ": "mn", "plain": "plain", "": ""}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["f"] for r in rows.select("t", fold(F.col("t")).alias("f")).collect()} == texts
    assert spark.createDataFrame([("D'Éa-ﬂ 1",)], "t string").select(match_key(F.col("t"))).first()[0] == "deafl1"
