"""As-of join: every row gets the newest earlier version of its key, in one merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.guards import ContractError, require_columns
from tidemark.operators.ordered import add_chunk, chunk_count, join_null_safe
from tidemark.session import checkpointed, plain_scan

# Probes of one moment are spread over so many places behind the versions of that moment.
SPREAD = 1 << 20


def _newest_per_time(
    versions: DataFrame, keys: Sequence[str], stamp: str, values: Sequence[str], ties: Sequence[str],
) -> DataFrame:
    """One version per key and time, the one with the largest ties.

    Versions without a key or a time can never be chosen. Combined map-side, so a
    key and time written a billion times costs one row per task.
    """
    known = versions.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, stamp]))
    payload = F.struct(*[F.col(c) for c in values])
    rank = F.struct(*[F.col(c) for c in ties], payload) if ties else payload
    return known.groupBy(*[F.col(k) for k in keys], F.col(stamp).alias("__time")).agg(
        F.max_by(payload, rank).alias("__version"))


def asof_join(
    probes: DataFrame, versions: DataFrame, keys: Sequence[str], probe_time: str, version_time: str,
    values: Sequence[str], ties: Sequence[str] = (), strict: bool = False,
    oldest: Column | None = None, chunks: int | None = None,
) -> DataFrame:
    """Every row of ``probes`` with the ``values`` of the newest version of its key.

    A version counts if its time is at or, with ``strict``, before the probe's. Of
    versions with one key and time the one with the largest ``ties`` counts, then the
    one with the largest values. ``oldest`` is an expression over the probes: versions
    older than it do not count. The time of the version chosen is returned as
    ``version_time``. Every probe is one row; a probe without a version, a time or one
    of the keys gets NULLs. ``values`` are named as in ``versions`` and must not clash.

    Both sides are united and sorted by time inside ``(key, chunk)``; the last version
    of a chunk is carried into the later chunks of its key. So neither a key nor a
    moment that holds a third of all rows is one task, and no pair of a probe and a
    version that it does not get is ever made.
    """
    require_columns(versions, [*keys, version_time, *values, *ties], "versions")
    require_columns(probes, [*keys, probe_time], "probes")
    clash = {version_time, *values} & set(probes.columns)
    if clash:
        raise ContractError(f"probes and versions both have {sorted(clash)}")
    newest = _newest_per_time(versions, keys, version_time, values, ties)
    # A version sorts before the probes of its moment, or behind them if it must be earlier.
    place = (F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)) + 1).cast("double")
    limit = F.lit(None) if oldest is None else oldest
    stamp = versions.schema[version_time].dataType
    asked = probes.select(
        *[F.col(k) for k in keys], F.col(probe_time).cast(stamp).alias("__time"), place.alias("__place"),
        limit.cast(stamp).alias("__oldest"), F.struct(*[F.col(c) for c in probes.columns]).alias("__probe"))
    version = checkpointed(newest).select(
        *keys, "__time", F.lit(float(SPREAD + 1) if strict else 0.0).alias("__place"),
        F.lit(None).cast(stamp).alias("__oldest"), F.lit(None).cast(asked.schema["__probe"].dataType).alias("__probe"),
        F.struct(F.col("__time").alias("at"), F.col("__version").alias("v")).alias("__found"))
    both = version.unionByName(asked.withColumn("__found", F.lit(None).cast(version.schema["__found"].dataType)))
    if not plain_scan(both):
        both = checkpointed(both)
    both = add_chunk(both, ["__time", "__place"], chunk_count(both) if chunks is None else chunks)
    inner = [*keys, "__chunk"]
    sofar = Window.partitionBy(*inner).orderBy("__time", "__place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("__here", F.last("__found", ignorenulls=True).over(sofar)).filter("__probe IS NOT NULL")
    # One row per key and chunk: its last version, and that of the chunks before it.
    tails = both.groupBy(*inner).agg(F.max_by("__found", F.when(F.col("__found").isNotNull(), F.col("__time"))).alias("__tail"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*inner, F.last("__tail", ignorenulls=True).over(earlier).alias("__carried"))
    joined = join_null_safe(here, carried, inner)
    found = F.coalesce("__here", "__carried")
    usable = F.col("__time").isNotNull()
    for key in keys:
        usable = usable & F.col(key).isNotNull()
    if oldest is not None:
        usable = usable & (found["at"] >= F.col("__oldest"))
    chosen = joined.withColumn("__chosen", F.when(usable, found))
    return chosen.select(
        *[F.col("__probe")[c].alias(c) for c in probes.columns], F.col("__chosen.at").alias(version_time),
        *[F.col("__chosen.v")[c].alias(c) for c in values])
