"""Season archives: CSV scans, required files and columns, file inventories."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.guards import ContractError, require_columns
from tidemark.session import checkpointed, setting, ship
from tidemark.sources.runs import exists

# Names and columns of the archive's files, season and revision patterns.
REQUIRED_FILES = ("gws/merged_gw.csv", "fixtures.csv", "teams.csv")
REQUIRED_COLUMNS = {
    "gws/merged_gw.csv": (
        "name", "position", "team", "element", "fixture", "round", "kickoff_time", "minutes",
        "total_points", "value", "was_home"),
    "fixtures.csv": ("id", "event", "team_h", "team_a", "kickoff_time"),
    "teams.csv": ("id", "name", "short_name"),
}
SEASON_PATTERN = r"^\d{4}-\d{2}$"
REVISION_PATTERN = r"^[0-9a-fA-F]{40}$"
TEXT_COLUMNS = ("name", "position", "team", "short_name", "kickoff_time", "was_home")
LEAKING_COLUMNS = ("xP",)
# Files of more bytes are hashed as they stream past.
WHOLE = 32 << 20
# Lines of a streaming file that a task holds at once, if they are short.
LINES = 20_000
# What readers of lines leave out at a file's beginning.
MARK = b"\xef\xbb\xbf"


def validate_season(season: str) -> str:
    """``2023-24``: a year and the two digits of the next."""
    if not re.match(SEASON_PATTERN, season) or int(season[5:]) != (int(season[:4]) + 1) % 100:
        raise ContractError(f"not a season: {season}")
    return season


def read_csv(spark: SparkSession, path: str, text: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """CSV with a header; types are set by name, not inferred from the data.

    Only the header line is read to plan. Columns not named as text are numbers;
    what does not read as one becomes NULL.
    """
    names = spark.read.option("header", "true").csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", "true").csv(path)
    numbers = {n: F.col(f"`{n}`").try_cast("double") for n in names if n not in text}
    return raw.withColumns(numbers)


def missing_files(spark: SparkSession, root: str, seasons: Sequence[str]) -> list[tuple[str, str]]:
    return [(s, f) for s in seasons for f in REQUIRED_FILES
            if not exists(spark, f"{root}/{s}/{f}")]


def read_seasons(spark: SparkSession, root: str, seasons: Sequence[str]) -> dict[str, DataFrame]:
    """Matches, fixtures and teams of all seasons, tagged with their season.

    Checks required files and columns, and drops columns that hold knowledge
    from after the match.
    """
    for season in seasons:
        validate_season(season)
    absent = missing_files(spark, root, seasons)
    if absent:
        raise ContractError(f"archive files are missing: {absent}")
    out: dict[str, DataFrame] = {}
    for name, file in (("matches", REQUIRED_FILES[0]), ("fixtures", REQUIRED_FILES[1]),
                       ("teams", REQUIRED_FILES[2])):
        for season in seasons:
            part = read_csv(spark, f"{root}/{season}/{file}").drop(*LEAKING_COLUMNS)
            require_columns(part, REQUIRED_COLUMNS[file], f"{season} {file}")
            part = part.withColumn("season", F.lit(season))
            out[name] = part if name not in out else out[name].unionByName(
                part, allowMissingColumns=True)
    return out


def file_inventory(
    spark: SparkSession, path: str, pattern: str = "*", whole: int = WHOLE
) -> DataFrame:
    """Path, size and SHA-256 of files, hashed once and where they are read.

    A file of at most ``whole`` bytes is one value. A larger one, of any size, streams
    through one task, as a digest has to, in pieces of lines: what stands between two
    line feeds must fit into an executor (2 GB at most).
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", "true").load(path)
    out = files.filter(F.col("length") <= whole).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    ending = F.regexp_extract("path", r"([.][^./]+)$", 1).alias("ending")
    large = files.filter(F.col("length") > whole).select(ending).distinct()
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(LINES)):
        for row in large.orderBy("ending").collect():
            out = out.unionByName(_streamed(spark, path, pattern, whole, row["ending"]))
        return checkpointed(out)


def _streamed(
    spark: SparkSession, path: str, pattern: str, whole: int, ending: str
) -> DataFrame:
    """Path, size and SHA-256 of the files of more bytes whose names end so.

    Hadoop's pass-through codec hands out a file with its ending unpacked by no other
    codec and in one piece. Files without an ending come in splits, which are sorted.
    """
    reader = spark.read.format("text").option("lineSep", "\n").option(
        "pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    name = F.col("_metadata.file_name")
    own = ~name.rlike("[.][^./]+$")
    if ending:
        codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
        reader = reader.option("io.compression.codecs", codec.CLASSNAME).option(
            codec.OPT_EXTENSION, ending)
        quoted = spark._jvm.org.apache.hadoop.fs.Path(f"/{ending}").toUri().toString()
        own = name.endswith(quoted.removeprefix("/"))
    lines = reader.load(path).filter(own & (F.col("_metadata.file_size") > whole)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
        F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"),
        *([] if ending else [F.col("_metadata.file_block_start").alias("start"),
                             F.monotonically_increasing_id().alias("at")]))
    if not ending:
        lines = lines.repartition("path").sortWithinPartitions("path", "start", "at")
    return lines.select("path", "bytes", "line").mapInArrow(
        _digests, "path string, bytes bigint, sha256 string")
class _Digest:
    """SHA-256 of a file from its lines, of which the last may lack its line feed."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.seen = path, size, 0
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(MARK)

    def add(self, lines: memoryview) -> None:
        """Whole lines; the last line feed waits for the next."""
        for digest in (self.plain, self.marked):
            if self.seen:
                digest.update(b"\n")
            digest.update(lines[:-1])
        self.seen += len(lines)

    def row(self) -> tuple[str, int, str]:
        digest, more = self.plain, self.seen - self.size
        if more < 0:
            digest, more = self.marked, more + len(MARK)
        if more not in (0, 1):
            raise ContractError(f"{self.path}: {self.seen} of {self.size} bytes were read")
        if not more:
            digest.update(b"\n")
        return unquote(self.path), self.size, digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path, size and SHA-256 of files whose lines come one file after the other."""
    now, found = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        line = batch.column("line")
        kind = np.int64 if pa.types.is_large_binary(line.type) else np.int32
        ends = np.frombuffer(line.buffers()[1], kind)[line.offset:line.offset + len(line) + 1]
        content = memoryview(line.buffers()[2])
        paths = batch.column("path").dictionary_encode()
        place = paths.indices.to_numpy()
        starts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist()]
        for low, high in zip(starts, [*starts[1:], len(line)]):
            path = paths[low].as_py()
            if now is None or now.path != path:
                if now is not None:
                    found.append(now.row())
                now = _Digest(path, batch.column("bytes")[low].as_py())
            now.add(content[ends[low]:ends[high]])
    if now is not None:
        found.append(now.row())
    if found:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*found)], ["path", "bytes", "sha256"])


def verify_inventory(
    actual: DataFrame, manifest: DataFrame, key: str = "relative_path"
) -> DataFrame:
    """Files that are missing, unexpected, or differ in size or checksum."""
    a = actual.select(key, F.col("bytes").alias("__b"), F.col("sha256").alias("__s"))
    joined = manifest.join(a, key, "full_outer")
    status = (
        F.when(F.col("__s").isNull(), F.lit("missing"))
        .when(F.col("sha256").isNull(), F.lit("unexpected"))
        .when(F.col("bytes") != F.col("__b"), F.lit("size differs"))
        .when(F.lower("sha256") != F.col("__s"), F.lit("checksum differs"))
        .otherwise(F.lit("ok"))
    )
    return joined.select(key, status.alias("status"))


def relative_to(inventory: DataFrame, root: str, name: str = "relative_path") -> DataFrame:
    cut = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return inventory.withColumn(name, cut)
