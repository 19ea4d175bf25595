"""Broken records become rejects with file, text and reason; good ones are all read."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.guards import ContractError
from tidemark.operators.managers import manager_audit, selection_rates
from tidemark.sources.quarantine import read_csv_records, read_json_records, split_rejects, write_quarantined
from tidemark.sources.runs import manifests

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                       T.StructField("price", T.DoubleType())])


def rules():
    return {"cheap": F.col("price") >= 4}


def files(tmp_path, texts):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    return str(folder)


def reasons(rejects):
    return {(r["file"].rsplit("/", 1)[1], r["line"]): list(r["reasons"]) for r in rejects.collect()}


def test_json_lines(spark, tmp_path):
    path = files(tmp_path, {
        "a.json": '{"id": 1, "name": "Ann", "price": 5, "extra": [1]}\n{"id": 2, "name": "Bo", "pr\n\n{"id": "x", "name": "C", "price": 6}\n',
        "b.json": '{"id": 3, "price": 3}\n{"id": 4, "name": "D", "price": null}\nnot json\n[1, 2]\n{"id": 5, "name": "E", "price": 4.5}'})
    records = read_json_records(spark, path, SCHEMA, ["id", "name"], rules())
    good, rejects = split_rejects(records)
    assert {(r["id"], r["name"], r["price"]) for r in good.collect()} == {(1, "Ann", 5.0), (5, "E", 4.5)}
    assert good.columns == ["file", "id", "name", "price"]
    found = reasons(rejects)
    assert found[("b.json", '{"id": 3, "price": 3}')] == ["lacks name", "cheap"]
    assert found[("b.json", '{"id": 4, "name": "D", "price": null}')] == ["cheap"]
    malformed = {line for (_, line), why in found.items() if why == ["malformed"]}
    assert {'{"id": 2, "name": "Bo", "pr', "", '{"id": "x", "name": "C", "price": 6}', "not json"} <= malformed
    assert len(found) == 7 and records.count() == 9


def test_whole_files(spark, tmp_path):
    path = files(tmp_path, {"a.json": '{\n "id": 1,\n "name": "A",\n "price": 9\n}', "b.json": '{"id": 2,\n', "c.json": ""})
    good, rejects = split_rejects(read_json_records(spark, path, SCHEMA, ["id"], whole_files=True))
    assert [r["id"] for r in good.collect()] == [1]
    assert reasons(rejects)[("b.json", '{"id": 2,\n')] == ["malformed"]


def test_csv(spark, tmp_path):
    path = files(tmp_path, {
        "a.csv": "id,name,price\r\n1,Ann,5\r\n2,Bo\r\n3,C,x\r\n4,D,6,more\r\n",
        "b.csv": 'id,name,price\n5,"Q, R",7\n,E,8\n6,F,1\n'})
    records = read_csv_records(spark, path, SCHEMA, ["id"], rules())
    good, rejects = split_rejects(records)
    assert {(r["id"], r["name"]) for r in good.collect()} == {(1, "Ann"), (5, "Q, R")}
    found = reasons(rejects)
    assert found == {("a.csv", "2,Bo"): ["malformed"], ("a.csv", "3,C,x"): ["malformed"], ("a.csv", "4,D,6,more"): ["malformed"],
                     ("b.csv", ",E,8"): ["lacks id"], ("b.csv", "6,F,1"): ["cheap"]}


def test_rejects_are_written_beside(spark, tmp_path):
    path = files(tmp_path, {"a.json": '{"id": 1}\n{"id": }\n'})
    root = str(tmp_path / "store")
    write_quarantined(spark, root, "players", read_json_records(spark, path, SCHEMA, ["id"]))
    assert {(r["table"], r["rows"]) for r in manifests(spark, root).collect()} == {("players", 1), ("players-rejects", 1)}
    with pytest.raises(ContractError, match="nobody"):
        read_json_records(spark, path, SCHEMA, ["nobody"])
    with pytest.raises(ContractError, match="line"):
        read_json_records(spark, path, T.StructType([T.StructField("line", T.StringType())]))


def test_manager_audit(spark):
    rows = [(1, "a", "D", 5.0, True), (1, "b", "M", 4.0, True), (2, "a", "D", 6.0, True), (2, "c", "D", 1.0, False),
            (3, "a", "M", 7.0, True), (3, "b", "D", 2.0, True)]
    picks = spark.createDataFrame(rows, "m int, p string, g string, x double, s boolean")
    no = F.lit(False)
    rates = selection_rates(picks, "p", "m", no, no, no).join(
        spark.createDataFrame([("a", 90.0), ("b", 60.0)], "p string, known double"), "p", "left")
    row = manager_audit(picks, "m", "p", "g", ["D", "M"], F.col("s"), "x", rates, "known").collect()
    assert len(row) == 1
    got = row[0].asDict()
    assert (got["managers"], got["picks"], got["unique_items"], got["items"]) == (3, 6, 3, 2)
    assert got["formations"] == {"1-1": 2, "1-0": 1}
    assert (got["cost_minimum"], got["cost_median"], got["cost_maximum"]) == (7.0, 9.0, 9.0)
    assert got["mean_absolute_error"] == pytest.approx((10 + 20 / 3) / 2)
    none = manager_audit(picks.limit(0), "m", "p", "g", ["D"], F.col("s"), "x", rates.limit(0), "known").collect()
    assert len(none) == 1 and none[0]["managers"] == 0 and none[0]["formations"] == {} and none[0]["cost_median"] is None
