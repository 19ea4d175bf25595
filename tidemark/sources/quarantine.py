"""Text records that may be broken: good rows, and rejects with their reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.guards import ContractError
from tidemark.sources.runs import write_run

CORRUPT = "__corrupt"
MALFORMED = "malformed"


def _checked(lines: DataFrame, parsed: Column, schema: T.StructType, required: Sequence[str],
             rules: Mapping[str, Column]) -> DataFrame:
    """Parsed fields with file, line and the reasons against the line."""
    missing = sorted(set(required) - set(schema.names))
    if missing:
        raise ContractError(f"required fields {missing} are not in the schema")
    if {"file", "line", "reasons"} & set(schema.names):
        raise ContractError("fields may not be called file, line or reasons")
    rows = lines.withColumn("__r", parsed).withColumn(
        "__sound", F.col("__r").isNotNull() & F.col(f"__r.{CORRUPT}").isNull() & (F.trim("line") != "")).select(
        "file", "line", "__sound", "__r.*")
    sound = F.coalesce("__sound", F.lit(False))
    reasons = [F.when(~sound, F.lit(MALFORMED))]
    reasons += [F.when(sound & F.col(c).isNull(), F.lit(f"lacks {c}")) for c in required]
    reasons += [F.when(sound & ~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]
    return rows.withColumn("reasons", F.array_compact(F.array(*reasons))).drop(CORRUPT, "__sound")


def read_json_records(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, required: Sequence[str] = (),
    rules: Mapping[str, Column] | None = None, whole_files: bool = False,
) -> DataFrame:
    """JSON records, one a line or one a file, with what is wrong with each.

    The fields of ``schema``, the ``file``, the text of the ``line``, and ``reasons``:
    empty for a good record; MALFORMED for text that is no JSON object or has a field
    of another type; ``lacks x`` for each required field that is absent or null; the
    name of each rule (a condition over the fields) that does not hold, also where it
    is null. A field that cannot be read is null. Blank lines are malformed. One scan,
    no record stops it.
    """
    lines = spark.read.text(path, wholetext=whole_files).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    parsed = F.from_json("line", T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return _checked(lines, parsed, schema, required, dict(rules or {}))


def read_csv_records(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, required: Sequence[str] = (),
    rules: Mapping[str, Column] | None = None,
) -> DataFrame:
    """CSV records under a header line, with what is wrong with each, as in :func:`read_json_records`.

    A line with more or fewer fields than the schema, or with a value of another type,
    is malformed. Lines that repeat the header are headers. Quoted line breaks are not
    supported.
    """
    head = ",".join(schema.names)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.rtrim("value", F.lit("\r")).alias("line")).filter(F.col("line") != head)
    parsed = F.from_csv("line", ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), f"`{CORRUPT}` string"]), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return _checked(lines, parsed, schema, required, dict(rules or {}))


def split_rejects(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fields of good records, and (file, line, reasons) of the others."""
    good = F.size("reasons") == 0
    return records.filter(good).drop("line", "reasons"), records.filter(~good).select("file", "line", "reasons")


def write_quarantined(
    spark: SparkSession, root: str, name: str, records: DataFrame, moment: datetime | None = None,
    metadata: Mapping[str, object] | None = None,
) -> str:
    """A run with the good records as ``name`` and the rejects beside them as ``name-rejects``."""
    good, rejects = split_rejects(records)
    return write_run(spark, root, {name: good, f"{name}-rejects": rejects}, moment, metadata)
