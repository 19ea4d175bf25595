"""Reproducible sampling as relational jobs.

Randomness is a hash of (seed, draw, pick), never ``rand()``, and weights are
whole numbers, so a result does not depend on partitioning or on retries.

Weighted picks invert the cumulative weights: each item owns an interval of
``0..total``, a pick is a number in that range, and both meet in buckets of
equal weight. A pick costs one equi-join row, so draws are never crossed with
the pool; an item with a third of the weight is listed in a third of the
buckets.

Both laws used by the reference populations follow from independent picks:

* drawing without replacement (weights renormalised after each pick) equals
  drawing with replacement and keeping the first ``quota`` different items;
* subsets with probability proportional to the product of weights equal
  ``quota`` picks accepted only when all differ.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.guards import ContractError, require_no_rows
from tidemark.operators.ordered import past_totals

WEIGHT_UNITS = 1_000_000
PICK_LIMIT = 12


def hash_uniform(seed: int, *parts: Column) -> Column:
    """Number in [0, 1) fixed by the seed and the given columns."""
    mixed = F.xxhash64(F.lit(int(seed)), *parts)
    return F.shiftrightunsigned(mixed, 11) / F.lit(float(2**53))


def weight_units(weight: Column) -> Column:
    """Weight as a whole number of millionths, at least one for a positive weight."""
    scaled = F.round(weight.cast("double") * WEIGHT_UNITS).cast("bigint")
    return F.when(weight > 0, F.greatest(scaled, F.lit(1).cast("bigint"))).otherwise(
        F.lit(0).cast("bigint"))


def weight_intervals(
    pool: DataFrame, stratum: str, item: str, weight: Column, buckets: int = 1024,
    chunks: int | None = None,
) -> DataFrame:
    """Intervals of cumulative weight per stratum, listed per bucket they touch."""
    weighed = pool.select(stratum, item, weight_units(weight).alias("__w")).filter("__w > 0")
    placed = past_totals(weighed, [stratum], [item], {"__from": F.col("__w")}, chunks=chunks)
    totals = weighed.groupBy(stratum).agg(F.sum("__w").alias("__total"),
                                          F.count("*").alias("__items"))
    width = F.greatest(F.ceil(F.col("__total") / F.lit(float(buckets))).cast("bigint"),
                       F.lit(1).cast("bigint"))
    spans = placed.join(totals, stratum).withColumn("__width", width).withColumn(
        "__to", F.col("__from") + F.col("__w"))
    first = F.expr("`__from` div `__width`")
    last = F.expr("(`__to` - 1) div `__width`")
    return spans.select(stratum, item, "__from", "__to", F.explode(F.sequence(first, last))
                        .alias("__bucket"))


def _picks(
    draws: DataFrame, draw: str, spans: DataFrame, totals: DataFrame, stratum: str, item: str,
    seed: int, count: Column,
) -> DataFrame:
    """Independent weighted picks ``0..count-1`` of each (draw, stratum)."""
    asked = draws.join(totals, stratum).select(
        draw, stratum, "__total", "__width", "quota",
        F.explode(F.sequence(F.lit(0), count - 1)).alias("pick"))
    spot = F.pmod(F.xxhash64(F.lit(int(seed)), F.col(draw), F.col(stratum), F.col("pick")),
                  F.col("__total"))
    placed = asked.withColumn("__spot", spot).withColumn(
        "__bucket", F.expr("`__spot` div `__width`"))
    return placed.join(spans, [stratum, "__bucket"]).filter(
        (F.col("__spot") >= F.col("__from")) & (F.col("__spot") < F.col("__to"))
    ).select(draw, stratum, "quota", "pick", item)


def _prepared(
    pool: DataFrame, stratum: str, item: str, weight: Column, quotas: Mapping[object, int],
    buckets: int,
) -> tuple[DataFrame, DataFrame]:
    listed = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    spans = weight_intervals(
        pool.filter(F.col(stratum).isin(*quotas)), stratum, item, weight, buckets)
    weighed = pool.filter(F.col(stratum).isin(*quotas)).select(
        stratum, weight_units(weight).alias("__w")).filter("__w > 0")
    totals = weighed.groupBy(stratum).agg(
        F.sum("__w").alias("__total"), F.count("*").alias("__items")).withColumns({
            "__width": F.greatest(F.ceil(F.col("__total") / F.lit(float(buckets))).cast("bigint"),
                                  F.lit(1).cast("bigint")),
            "quota": F.element_at(listed, F.col(stratum)),
        })
    require_no_rows(totals.filter(F.col("__items") < F.col("quota")).select(stratum, "quota"),
                    "too few items for a quota")
    return spans, totals


def _draws_of_strata(
    pool: DataFrame, stratum: str, quotas: Mapping[object, int], totals: DataFrame, draws: int,
) -> DataFrame:
    """(draw, stratum) for every stratum with items: the quotas are listed, nothing is crossed."""
    kind = pool.schema[stratum].dataType
    listed = F.array(*[F.lit(value).cast(kind) for value in quotas])
    asked = pool.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(listed).alias(stratum))
    return asked.join(totals.select(stratum), stratum, "left_semi").select("draw", stratum)


def successive_draws(
    pool: DataFrame, stratum: str, item: str, weight: Column, quotas: Mapping[object, int],
    draws: int, seed: int, buckets: int = 1024,
) -> DataFrame:
    """Weighted draws without replacement: ``draw, stratum, item`` rows.

    Keeps the first ``quota`` different items of a stream of picks. A draw whose
    stream was too short is redone with a stream four times as long (the same
    picks first), until every draw is complete.
    """
    spans, totals = _prepared(pool, stratum, item, weight, quotas, buckets)
    open_draws = _draws_of_strata(pool, stratum, quotas, totals, draws)
    finished: DataFrame | None = None
    factor = 2
    for _ in range(PICK_LIMIT):
        picks = _picks(open_draws, "draw", spans, totals, stratum, item, seed,
                       F.col("quota") * factor + factor)
        firsts = picks.groupBy("draw", stratum, item).agg(
            F.min("pick").alias("pick"), F.first("quota").alias("quota"))
        order = Window.partitionBy("draw", stratum).orderBy("pick")
        kept = firsts.withColumn("__r", F.row_number().over(order)).filter(
            F.col("__r") <= F.col("quota"))
        complete = kept.filter(F.col("__r") == F.col("quota")).select("draw", stratum)
        done = kept.join(complete, ["draw", stratum], "left_semi").select("draw", stratum, item)
        finished = done if finished is None else finished.unionByName(done)
        open_draws = open_draws.join(complete, ["draw", stratum], "left_anti")
        if open_draws.isEmpty():
            return finished
        factor *= 4
    raise ContractError("draws stay incomplete: a few items hold nearly all weight")


def product_subsets(
    pool: DataFrame, stratum: str, item: str, weight: Column, quotas: Mapping[object, int],
    attempts: int, seed: int, buckets: int = 1024,
) -> DataFrame:
    """Subsets with probability proportional to the product of their weights.

    Rows ``subset, stratum, item``: the accepted attempts of each stratum,
    numbered from 0 in attempt order. Equal numbers of different strata are
    independent of each other and may be joined to whole squads.
    """
    spans, totals = _prepared(pool, stratum, item, weight, quotas, buckets)
    tries = _draws_of_strata(pool, stratum, quotas, totals, attempts)
    picks = _picks(tries, "draw", spans, totals, stratum, item, seed, F.col("quota"))
    accepted = picks.groupBy("draw", stratum, "quota").agg(
        F.count_distinct(item).alias("__d")).filter("__d = quota").select("draw", stratum)
    numbered = past_totals(accepted, [stratum], ["draw"], {}).withColumnRenamed(
        "past_rows", "subset")
    return picks.join(numbered, ["draw", stratum]).select("subset", stratum, item)


def hash_order_sample(
    df: DataFrame, key: Sequence[str], size: int, seed: int
) -> DataFrame:
    """``size`` distinct keys without replacement, in hash order (a top-k)."""
    distinct = df.select(*key).distinct()
    return distinct.orderBy(
        F.xxhash64(F.lit(int(seed)), *[F.col(k) for k in key]), *key).limit(size)


def cluster_sample(
    df: DataFrame, page: str, entry: str, size: int, page_size: int, seed: int
) -> DataFrame:
    """Two-stage sample: pages without replacement, then entries of those pages.

    An entry on several sampled pages counts once (its lowest page). Fails when
    the pages yield too few entries.
    """
    needed = -(-size // page_size)
    pages = hash_order_sample(df, [page], needed, seed)
    members = df.select(page, entry).join(pages, page, "left_semi").groupBy(entry).agg(
        F.min(page).alias(page))
    chosen = members.orderBy(
        F.xxhash64(F.lit(int(seed) + 1), F.col(entry)), entry).limit(size)
    found = chosen.count()
    if found < size:
        raise ContractError(f"sampled pages yield only {found} of {size} entries")
    return chosen.select(page, entry)
