"""Input columns, written intermediate tables and link searches shared by the operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import setting, ship

# Rows handed to a Python worker at once. Texts may be very long, so few.
ROWS_PER_BATCH = 128


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A temporary one is made only where the setting is absent and the master is
    local, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def arrow_rows(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager[None]:
    """Larger Arrow batches for tables written inside, of rows that are short."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later jobs start there.

    Losing an executor afterwards costs nothing, and no upstream work is repeated. The
    shuffle files that led to the table are deleted with the write's end, so that a job
    of many steps holds one step's files at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` or ``bucketed`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in sorted({name.rsplit("/", 1)[0] for name in df.inputFiles()}):
        title = folder.rsplit("/", 1)[-1]
        if not title.startswith(("llm-", "llm_")):
            raise ValueError(f"{folder} is no written table")
        if title.startswith("llm_"):
            spark.sql(f"DROP TABLE IF EXISTS {title}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write a frame to the shared folder in buckets of its key: joins on it shuffle the other side only."""
    spark = df.sparkSession
    title = f"llm_{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = shuffle_partitions(spark)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("compression", "zstd")
         .option("path", f"{shared_folder(spark)}/{title}").saveAsTable(title))
    return spark.table(title)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text is empty."""
    spark = docs.sparkSession
    ship(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return docs.select(docs[key].cast("bigint").alias("doc_id"),
                       F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def hash_sample(rows: DataFrame, about: int) -> DataFrame:
    """About ``about`` rows of (doc_id, text), chosen by a hash of their content.

    For fitting only: no result row may depend on being chosen.
    """
    share = max(1, rows.count() // about)
    mark = F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64))
    return rows.where(F.pmod(mark, F.lit(share)) == 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def stars(rows: DataFrame, bucket: list[str], item: str, mark: bool = False) -> DataFrame:
    """Compare every member of a bucket with one leader instead of with all members.

    ``rows`` has the columns of ``bucket`` and a bigint ``item``. Returns the members
    of buckets of two or more items as (bucket..., item, leader, n). The leader is the
    smallest item; ``mark`` adds a hash of the whole bucket, equal for buckets of
    equal items. Buckets are counted with map-side combine and joined back, so that a
    bucket holding a third of all rows is split over tasks like any skewed join.
    """
    more = [F.bit_xor(F.xxhash64(item)).alias("mark")] if mark else []
    sizes = rows.groupBy(*bucket).agg(F.min(item).alias("leader"), F.count("*").alias("n"), *more).where("n > 1")
    return rows.join(sizes, bucket)
