"""Append-only store of runs: one folder per run, a manifest as commit mark.

    <root>/<run id>/<table>/...parquet
    <root>/<run id>/manifest/...    one JSON line, written last

A run without a manifest is unfinished and never read, so a lost driver or
executor leaves nothing half-visible. Run ids sort by time.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.guards import ContractError, require_columns, require_unique
from tidemark.operators.temporal import latest_wins

# Fixed value: layout of run ids, UTC with microseconds.
RUN_ID_FORMAT = "%Y%m%dT%H%M%S%fZ"

REGISTRY_SCHEMA = T.StructType([
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("created_at_utc", T.StringType()),
    T.StructField("season", T.StringType()),
    T.StructField("snapshot_gameweek", T.LongType()),
    T.StructField("snapshot_timestamp", T.StringType()),
    T.StructField("snapshot_deadline_time", T.StringType()),
    T.StructField("processed_dir", T.StringType()),
])


def run_id(moment: datetime | None = None) -> str:
    value = moment or datetime.now(timezone.utc)
    if value.tzinfo is None:
        raise ContractError("run times need a time zone")
    return value.astimezone(timezone.utc).strftime(RUN_ID_FORMAT)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return bool(fs.exists(target))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under a path, sorted."""
    fs, target = _filesystem(spark, path)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory())


def _sorted_json(column: Column, kind: T.DataType) -> Column:
    """Nested value with the keys of every object in sorted order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[_sorted_json(column[f.name], f.dataType).alias(f.name)
                             for f in fields])
        return F.when(column.isNotNull(), rebuilt)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: _sorted_json(item, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(column)) if not isinstance(
            kind.valueType, T.MapType) else F.map_entries(column)
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(
            e["key"], _sorted_json(e["value"], kind.valueType))))
    return column


def nested_to_json(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text with sorted keys; scalars untouched."""
    encoded = {
        f.name: F.to_json(_sorted_json(F.col(f.name), f.dataType), {"ignoreNullFields": "false"})
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    }
    return df.withColumns(encoded) if encoded else df


def _ordered(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted over all files: a file's rows are sorted and lie wholly before the next file's.

    Ranges are cut on the whole key, so rows that share its first column are spread.
    """
    return table.repartitionByRange(*keys).sortWithinPartitions(*keys)


def file_bounds(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """(file, rows, first, last, before) of every file of an ordered table.

    ``first`` and ``last`` are structs of the key, ``before`` counts the rows of all
    earlier files. Only the key is read; there is a row per file.
    """
    key = F.struct(*[F.col(k) for k in keys])
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


def read_ordered(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """An ordered table with each row's place among all rows, without sorting it again."""
    bounds = spark.read.parquet(f"{path}-bounds").select(F.col("file").alias("__file"), "before")
    rows = spark.read.parquet(path)
    columns = rows.columns
    placed = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    return placed.join(bounds, "__file").select(*columns, (F.col("before") + F.col("__index")).alias(position))


def write_run(
    spark: SparkSession, root: str, tables: Mapping[str, DataFrame],
    moment: datetime | None = None, metadata: Mapping[str, object] | None = None,
    partition_by: Mapping[str, Sequence[str]] | None = None, as_json: bool = False,
    order_by: Mapping[str, Sequence[str]] | None = None,
    require: Mapping[str, Mapping[str, Column]] | None = None,
) -> str:
    """Write all tables of a run, then its manifest; returns the run's folder.

    Rows are counted while they are written, and so are those that break a rule of
    ``require`` (table -> what is broken -> condition that every row meets): a table is
    one job. A broken rule fails before the manifest is written, so that the run is
    never read. ``order_by`` sorts a table over all of its files and writes their
    bounds beside it as ``<table>-bounds``. The manifest keeps counts and schemas.
    """
    identity = run_id(moment)
    folder = f"{root}/{identity}"
    if exists(spark, folder):
        raise ContractError(f"run {identity} exists; runs are never overwritten")
    counts, schemas = {}, {}
    for name, table in tables.items():
        path = f"{folder}/{name}"
        table = nested_to_json(table) if as_json else table
        rules = (require or {}).get(name, {})
        seen = Observation(f"{name} {identity}")
        broken = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"broken {i}") for i, c in enumerate(rules.values())]
        order = (order_by or {}).get(name)
        placed = (_ordered(table, order) if order else table).observe(seen, F.count(F.lit(1)).alias("rows"), *broken)
        writer = placed.write.mode("errorifexists")
        keys = (partition_by or {}).get(name)
        (writer.partitionBy(*keys) if keys else writer).parquet(path)
        measured = seen.get
        found = {n: measured[f"broken {i}"] for i, n in enumerate(rules) if measured[f"broken {i}"]}
        if found:
            raise ContractError(f"{name} breaks {found}; run {identity} stays unfinished")
        if order:
            file_bounds(spark, path, order).write.parquet(f"{path}-bounds")
        counts[name] = measured["rows"]
        # As it is read: nullable, with the columns of its folders last.
        folders_last = [f for f in table.schema.fields if f.name not in (keys or ())]
        schemas[name] = "" if keys else T.StructType([T.StructField(f.name, f.dataType) for f in folders_last]).json()
    created = datetime.strptime(identity, RUN_ID_FORMAT).replace(tzinfo=timezone.utc)
    manifest = {
        "snapshot_id": identity, "created_at_utc": created.isoformat(),
        "tables": counts, "schemas": schemas, "metadata": dict(metadata or {}),
    }
    line = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest")
    return folder


def committed_runs(spark: SparkSession, root: str) -> list[str]:
    """Folders of finished runs, oldest first, from one listing."""
    fs, pattern = _filesystem(spark, f"{root}/*/manifest/_SUCCESS")
    found = fs.globStatus(pattern) if exists(spark, root) else None
    return sorted(f"{root}/{s.getPath().getParent().getParent().getName()}" for s in found or ())


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(folder, snapshot_id, table, rows, schema) of every table of every finished run.

    All manifests are one scan. ``schema`` is NULL for runs that did not note it.
    """
    paths = [f"{folder}/manifest" for folder in committed_runs(spark, root)]
    kinds = "snapshot_id string, tables map<string,bigint>, schemas map<string,string>"
    lines = spark.read.text(paths) if paths else spark.createDataFrame([], "value string")
    path = F.col("_metadata.file_path") if paths else F.lit("")
    parsed = lines.select(F.from_json("value", kinds).alias("m"), F.regexp_extract(path, "([^/]+)/manifest/[^/]*$", 1).alias("__run"))
    tables = parsed.select("m.snapshot_id", "m.schemas", F.concat(F.lit(f"{root}/"), "__run").alias("folder"),
                           F.explode("m.tables").alias("table", "rows"))
    return tables.select("folder", "snapshot_id", "table", "rows", F.col("schemas")[F.col("table")].alias("schema"))


def read_versions(
    spark: SparkSession, root: str, table: str, empty: T.StructType, filename: str = "filename",
) -> DataFrame:
    """A table over all finished runs, united by column name, with its file path.

    Runs are grouped on executors by the schema their manifests note, and each group
    is one scan: a thousand runs of two schemas are two rows for the driver and plan
    as two scans. Only runs without a noted schema, and tables in partition folders,
    are opened to see theirs. Types that drifted between groups are widened by the
    union. Without any run the result is empty but typed.
    """
    known = manifests(spark, root).filter(F.col("table") == table).groupBy(
        F.coalesce("schema", F.lit("")).alias("schema")).agg(F.sort_array(F.collect_list("folder")).alias("folders"))
    groups: dict[str, list[str]] = {}
    for row in known.collect():
        for folder in row["folders"]:
            path = f"{folder}/{table}"
            groups.setdefault(row["schema"] or spark.read.parquet(path).schema.json(), []).append(path)
    if not groups:
        return spark.createDataFrame([], empty.add(filename, T.StringType())
                                     if filename not in empty.names else empty)
    parts = [
        spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*paths)
        .select("*", F.col("_metadata.file_path").alias(filename))
        for schema, paths in sorted(groups.items(), key=lambda g: g[1])
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def registry(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished run, its metadata promoted to columns."""
    paths = [f"{folder}/manifest" for folder in committed_runs(spark, root)]
    if not paths:
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    fields = "struct<season:string,snapshot_gameweek:bigint,snapshot_timestamp:string," \
             "snapshot_deadline_time:string>"
    lines = spark.read.text(paths).withColumn("__path", F.col("_metadata.file_path"))
    parsed = lines.withColumn("m", F.from_json(
        "value", f"snapshot_id string, created_at_utc string, metadata {fields}"))
    return parsed.select(
        "m.snapshot_id", "m.created_at_utc", "m.metadata.season", "m.metadata.snapshot_gameweek",
        "m.metadata.snapshot_timestamp", "m.metadata.snapshot_deadline_time",
        F.regexp_replace("__path", "/manifest/[^/]*$", "").alias("processed_dir"),
    )


def latest_run(runs: DataFrame, identity: str = "snapshot_id") -> DataFrame:
    """The newest run's registry row."""
    return runs.orderBy(F.desc(identity)).limit(1)


def register_views(
    spark: SparkSession, root: str, snapshots: Mapping[str, tuple[str, T.StructType]],
    facts: Mapping[str, tuple[str, str, T.StructType, Sequence[str], Sequence[str]]],
) -> list[str]:
    """Create the store's named views.

    ``snapshots``: view -> (table, schema when empty). ``facts``: view -> (root
    below the store, table, schema when empty, key, newest-first columns); each
    also gets a ``_<view>_runs`` view of all versions. Views are lazy plans.
    """
    made = []
    for view, (table, schema) in snapshots.items():
        read_versions(spark, root, table, schema).createOrReplaceTempView(view)
        made.append(view)
    for view, (below, table, schema, key, newest) in facts.items():
        versions = read_versions(spark, f"{root}/{below}", table, schema)
        versions.createOrReplaceTempView(f"_{view}_runs")
        latest_wins(versions, key, newest).createOrReplaceTempView(view)
        made += [f"_{view}_runs", view]
    registry(spark, root).createOrReplaceTempView("snapshot_registry")
    return [*made, "snapshot_registry"]


def load_tables(
    spark: SparkSession, paths: Sequence[str], tag: str = "training_source_file"
) -> DataFrame:
    """Unite tables by column name, each row tagged with the file it came from."""
    if not paths:
        raise ContractError("no table paths given")
    parts = [spark.read.parquet(p).select("*", F.col("_metadata.file_path").alias(tag))
             for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_training(spark: SparkSession, paths: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Training tables united with their provenance; shared keys are refused."""
    rows = require_columns(load_tables(spark, paths), keys, "training tables")
    return require_unique(rows, keys, "training tables")
