"""Session settings the operators rely on."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", master: str | None = None,
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with AQE, skew-join splitting and a UTC clock.

    On a cluster leave ``master`` unset and keep the cluster's shuffle setting;
    AQE coalesces small partitions and splits hot ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config(
            "spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local, as in tests, is a temporary
    one made; elsewhere the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for what is run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, for their Python workers."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "tidemark-package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._tidemark_shipped = True


def checkpointed(df):
    """Cut the lineage of a frame that later jobs build on, in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def plain_scan(df) -> bool:
    """Whether a frame only filters, projects and unites files and checkpoints: read
    anew it costs one scan of the columns asked for, less than writing it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" :+-!").split(" ", 1)[0] for line in plan.splitlines() if line.strip()]
    return all(n in ("Project", "Filter", "Union", "Relation", "LogicalRDD") for n in nodes)
