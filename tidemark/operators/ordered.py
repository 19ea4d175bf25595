"""Order-dependent operators that never put one key into one task.

A plain window sends every row of its partition key to a single task. The
operators here cut the order axis into chunks first, run the window inside
``(key, chunk)`` and carry totals over from earlier chunks:

1. ``percentile_approx`` over the order column (a mergeable sketch) gives chunk
   bounds, a short list. A chunk holds about ``rows / chunks`` rows in all, so a
   key with a third of all rows is spread over a third of the chunks.
2. A value so frequent that it fills a chunk alone is given its own chunk, and
   is cut again by the next order column. NULL, NaN and infinite values are no
   bounds; each of these four has a chunk of its own, where Spark's order puts it.
3. Chunk totals are combined map-side; a key has at most ``chunks`` of them.

There is one path for all sizes. The rows to be ordered are materialised once, if
they are not a plain scan of a table, and counted; a chunk holds about ``CHUNK_ROWS``
rows, and there are at least as many chunks as shuffle partitions, so that small
inputs are cut like large ones.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import checkpointed, plain_scan

# Rows that one task orders at a time.
CHUNK_ROWS = 1_000_000


def chunk_count(df: DataFrame) -> int:
    """Chunks for a materialised frame: by its rows, without an upper bound."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, partitions, math.ceil(df.count() / CHUNK_ROWS))


def clock_seconds(column: Column) -> Column:
    """Seconds since 1970 on the clock a zone-less timestamp shows, as DOUBLE.

    A cast to TIMESTAMP would go through the session's zone, where summer time
    can put a later clock reading first.
    """
    return (
        F.unix_date(F.to_date(column)) * F.lit(86400.0) + F.hour(column) * 3600
        + F.minute(column) * 60 + F.date_part(F.lit("SECOND"), column).cast("double")
    )


def _as_double(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    column = F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return clock_seconds(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    raise TypeError(f"order column {name} must be a number, date or timestamp")


def _bounds(df: DataFrame, axis: Column, chunks: int) -> tuple[list[float], list[float], bool]:
    """Increasing chunk starts, the values that get a chunk of their own, and
    whether there are values that are no finite number."""
    shares = [i / chunks for i in range(1, chunks)]
    finite = F.when(F.abs(axis) < math.inf, axis)
    row = df.agg(F.percentile_approx(finite, shares, chunks * 20).alias("q"),
                 F.count_if(finite.isNull()).alias("odd")).head()
    values = list(row["q"] or [])
    heavy = sorted({v for v, w in zip(values, values[1:]) if v == w and abs(v) < 2**53})
    starts = sorted(set(values) | {math.nextafter(v, math.inf) for v in heavy})
    return starts, heavy, row["odd"] > 0


def _bucket(df: DataFrame, axis: Column, starts: list[float], name: str) -> DataFrame:
    """The number of each row's chunk: NULL, -inf, the chunks of numbers, +inf, NaN."""
    finite = F.when(F.abs(axis) < math.inf, axis)
    if starts:
        cut = Bucketizer(splits=[-math.inf, *starts, math.inf], inputCol="__axis", outputCol="__bucket")
        df = cut.transform(df.withColumn("__axis", F.coalesce(finite, F.lit(0.0)))).drop("__axis")
    else:
        df = df.withColumn("__bucket", F.lit(0))
    last = len(starts) + 2
    number = (
        F.when(axis.isNull(), 0).when(axis == -math.inf, 1).when(F.isnan(axis), last + 2)
        .when(axis == math.inf, last + 1).otherwise(F.col("__bucket") + 2)
    )
    return df.withColumn(name, number.cast("bigint")).drop("__bucket")


def add_chunk(df: DataFrame, order: Sequence[str], chunks: int, name: str = "__chunk") -> DataFrame:
    """Number rows by chunk so that a lower chunk sorts wholly before a higher one."""
    first = _as_double(df, order[0])
    starts, heavy, odd = _bounds(df, first, chunks)
    out = _bucket(df, first, starts, name)
    if (heavy or odd) and len(order) > 1:
        inside = first.isin(heavy) | ~F.coalesce(F.abs(first) < math.inf, F.lit(False))
        second = _as_double(df, order[1])
        cuts, _, _ = _bounds(df.filter(inside), second, chunks)
        out = _bucket(out, second, cuts, "__inner")
        out = out.withColumn(
            name,
            F.col(name) * F.lit(len(cuts) + 5) + F.when(inside, F.col("__inner")).otherwise(0),
        ).drop("__inner")
    return out


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on keys that may be NULL, keeping the left key columns."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def past_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    last: Mapping[str, str] | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Running sums, and the previous row's values, strictly before each row.

    ``sums`` maps an output name to the number to add up (NULL counts as 0; the
    first row of a key gets 0). ``last`` maps an output name to a column whose
    previous value is wanted. ``order`` must be unique within a key. The extra
    column ``past_rows`` counts the earlier rows. An input that is more than a plain
    scan is materialised first: bounds, windows and totals all read it.
    """
    last = dict(last or {})
    columns = df.columns
    if not plain_scan(df):
        df = checkpointed(df)
    chunks = chunk_count(df) if chunks is None else chunks
    numbers = {"past_rows": F.lit(1).cast("bigint"), **sums}
    source = df.withColumns({f"__in_{n}": F.coalesce(c, F.lit(0)) for n, c in numbers.items()})
    source = add_chunk(source, order, chunks)
    inner = [*keys, "__chunk"]
    running = Window.partitionBy(*inner).orderBy(*order)
    before = running.rowsBetween(Window.unboundedPreceding, -1)
    out = source.withColumns(
        {f"__w_{n}": F.sum(f"__in_{n}").over(before) for n in numbers}
        | {f"__l_{n}": F.lag(c).over(running) for n, c in last.items()}
    )
    totals = source.groupBy(*inner).agg(
        *[F.sum(f"__in_{n}").alias(f"__t_{n}") for n in numbers],
        *([F.max(F.struct(*order, *[F.col(c).alias(f"__v_{n}") for n, c in last.items()]))
           .alias("__tail")] if last else []),
    )
    earlier = Window.partitionBy(*keys).orderBy("__chunk")
    offsets = totals.select(
        *inner,
        *[F.sum(f"__t_{n}").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
          .alias(f"__o_{n}") for n in numbers],
        *([F.lag("__tail").over(earlier).alias("__tail")] if last else []),
    )
    joined = join_null_safe(out, offsets, inner)
    first_in_chunk = F.coalesce(F.col("__w_past_rows"), F.lit(0)) == 0
    return joined.select(
        *columns,
        *[(F.coalesce(F.col(f"__w_{n}"), F.lit(0)) + F.coalesce(F.col(f"__o_{n}"), F.lit(0)))
          .alias(n) for n in numbers],
        *[F.when(first_in_chunk, F.col(f"__tail.__v_{n}")).otherwise(F.col(f"__l_{n}")).alias(n)
          for n in last],
    )


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate next to every row."""
    return df.join(F.broadcast(one_row))


def value_positions(
    df: DataFrame, groups: Sequence[str], value: str, chunks: int | None = None,
    rows: str | None = None,
) -> DataFrame:
    """Distinct values per group with how often they occur and how many are below.

    Ties are folded by a map-side count first, so a value held by a third of
    the rows costs one row per task. ``rows`` names a column that tells how many
    rows a row stands for.
    """
    times = F.sum(rows) if rows else F.count("*")
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, value).agg(times.alias("ties"))
    )
    placed = past_totals(counted, groups, [value], {"below": F.col("ties")}, chunks=chunks)
    return placed.drop("past_rows")


def average_ranks(
    df: DataFrame, groups: Sequence[str], value: str, name: str = "rank",
    chunks: int | None = None, rows: str | None = None,
) -> DataFrame:
    """Rank of each distinct value, ties sharing the mean of their places."""
    placed = value_positions(df, groups, value, chunks, rows)
    rank = F.col("below") + (F.col("ties") + 1) / F.lit(2.0)
    return placed.select(*groups, value, rank.alias(name))


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str,
    probabilities: Mapping[str, float | Column], chunks: int | None = None,
) -> DataFrame:
    """Interpolated quantiles per group without holding a group in one task.

    Place ``h = (n - 1) * p`` falls between two sorted values; each is found as
    the distinct value whose run of places covers it. A probability may be a
    column over ``group_rows`` and ``group_values`` (rows and distinct values).
    """
    placed = value_positions(df, groups, value, chunks)
    sizes = placed.groupBy(*groups).agg(
        F.sum("ties").alias("group_rows"), F.count("*").alias("group_values")
    )
    sized = (join_null_safe(placed, sizes, groups) if groups
             else attach_scalars(placed, sizes))
    picks = []
    for name, share in probabilities.items():
        part = share if isinstance(share, Column) else F.lit(float(share))
        spot = (F.col("group_rows") - 1) * part
        low, high = F.floor(spot), F.ceil(spot)
        upto = F.col("below") + F.col("ties")
        picks += [
            F.max(F.when((F.col("below") <= low) & (low < upto), F.col(value).cast("double")))
            .alias(f"__lo_{name}"),
            F.max(F.when((F.col("below") <= high) & (high < upto), F.col(value).cast("double")))
            .alias(f"__hi_{name}"),
            F.max(spot - low).alias(f"__f_{name}"),
        ]
    found = sized.groupBy(*groups).agg(*picks)
    return found.select(
        *groups,
        # An infinite value less itself would be NaN.
        *[F.when((F.col(f"__lo_{n}") == F.col(f"__hi_{n}")) | (F.col(f"__f_{n}") == 0), F.col(f"__lo_{n}"))
          .otherwise(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}"))
          .alias(n) for n in probabilities],
    )
