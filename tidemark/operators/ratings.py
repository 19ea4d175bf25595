"""Percentiles and scores against a reference population."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import guarded_pearson, normal_quantile
from tidemark.operators.ordered import exact_quantiles, join_null_safe, past_totals

# Centre, spread and maximum of the score; strength and weakness marks.
SCORE_CENTRE = 75.0
SCORE_SPREAD = 8.0
SCORE_MAXIMUM = 99.9
STRENGTH = 85.0
WEAKNESS = 65.0


def percentile_scores(
    values: DataFrame, reference: DataFrame, component: Sequence[str], value: str,
    chunks: int | None = None,
) -> DataFrame:
    """Mid-rank percentile and score of each value within its component.

        percentile = 100 * (less + equal / 2) / n
        score      = 75 + 8 * inverse_normal((less + equal / 2 + 1/2) / (n + 1))

    clamped to 0..99.9. Reference and asked values are folded to distinct values
    with counts; running totals over those give ``less`` for any number of asked
    values in one pass. A reference leaves out NULL and NaN; an asked value that is
    missing or not finite fails, and so does a component without a reference.
    """
    number = F.col(value).cast("double")
    finite = F.coalesce(F.abs(number) < math.inf, F.lit(False))
    asked = values.withColumn(value, F.when(finite, F.col(value)).otherwise(
        F.raise_error(F.lit("a rated value is missing or not finite")).cast(values.schema[value].dataType)))
    known = reference.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    folded = known.select(*component, F.col(value).cast("double").alias("__v"),
                          F.lit(1).cast("bigint").alias("__r")).unionByName(
        asked.select(*component, F.col(value).cast("double").alias("__v"),
                     F.lit(0).cast("bigint").alias("__r"))
    ).groupBy(*component, "__v").agg(F.sum("__r").alias("equal"))
    placed = past_totals(folded, component, ["__v"], {"less": F.col("equal")}, chunks=chunks)
    sizes = known.groupBy(*component).agg(F.count("*").alias("reference_rows"))
    placed = (placed.join(sizes, list(component), "left") if component
              else placed.join(F.broadcast(sizes)))
    missing = F.raise_error(F.lit("a component has no reference")).cast("bigint")
    placed = placed.withColumn("reference_rows", F.when(
        F.coalesce("reference_rows", F.lit(0)) == 0, missing).otherwise(F.col("reference_rows")))
    halves = F.col("less") + F.col("equal") / 2.0
    rated = placed.select(
        *component, "__v", "less", "equal", "reference_rows",
        (100.0 * halves / F.col("reference_rows")).alias("percentile"),
        ((halves + 0.5) / (F.col("reference_rows") + 1.0)).alias("__p"),
    )
    raw = SCORE_CENTRE + SCORE_SPREAD * normal_quantile("`__p`")
    rated = rated.withColumn(
        "score", F.least(F.greatest(raw, F.lit(0.0)), F.lit(SCORE_MAXIMUM))).drop("__p")
    joined = join_null_safe(
        asked.withColumn("__v", F.col(value).cast("double")), rated, [*component, "__v"], "inner")
    return joined.drop("__v")


def component_ratings(
    squads: DataFrame, reference: DataFrame, components: Mapping[str, str],
    squad_id: str = "squad_id", chunks: int | None = None,
) -> DataFrame:
    """Rate each named component of a squad against the population's column.

    One row per squad: maps of scores and percentiles (one decimal), and the
    components that are strengths or weaknesses.
    """
    def tall(df: DataFrame, keep: list[str]) -> DataFrame:
        pieces = [F.struct(F.lit(n).alias("component"), F.col(c).cast("double").alias("value"))
                  for n, c in components.items()]
        return df.select(*keep, F.explode(F.array(*pieces)).alias("__c")).select(*keep, "__c.*")

    rated = percentile_scores(
        tall(squads, [squad_id]), tall(reference, []), ["component"], "value", chunks)
    rounded = rated.withColumns({
        "score": F.round("score", 1), "percentile": F.round("percentile", 1)})
    listed = F.struct("component", "score", "percentile")
    packed = rounded.groupBy(squad_id).agg(
        F.sort_array(F.collect_list(listed)).alias("__r"),
        F.max("reference_rows").alias("reference_rows"))

    def names(condition) -> object:
        return F.transform(F.filter("__r", condition), lambda r: r["component"])

    return packed.select(
        squad_id, "reference_rows",
        F.map_from_entries(F.transform("__r", lambda r: F.struct(r["component"], r["score"])))
        .alias("scores"),
        F.map_from_entries(F.transform("__r", lambda r: F.struct(r["component"], r["percentile"])))
        .alias("percentiles"),
        names(lambda r: r["score"] >= STRENGTH).alias("strengths"),
        names(lambda r: r["score"] <= WEAKNESS).alias("weaknesses"),
    )


def distribution_summary(
    df: DataFrame, columns: Mapping[str, Mapping[str, float]], chunks: int | None = None
) -> DataFrame:
    """Exact quantiles of several columns, one row per column and quantile.

    All columns are ranked in one pass over (column, value) rows.
    """
    tall = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    every = sorted({share for shares in columns.values() for share in shares.values()})
    names = {share: f"__q{i}" for i, share in enumerate(every)}
    wide = exact_quantiles(tall, ["column"], "value", {n: s for s, n in names.items()}, chunks)
    wanted = F.array(*[
        F.struct(F.lit(c).alias("c"), F.lit(q).alias("quantile"), F.col(names[share]).alias("value"))
        for c, shares in columns.items() for q, share in shares.items()])
    return wide.select("column", F.explode(F.filter(wanted, lambda w: w["c"] == F.col("column"))).alias("__w")).select(
        "column", "__w.quantile", "__w.value")


def inclusion_rates(members: DataFrame, squad_id: str, member: str) -> DataFrame:
    """Share of squads (percent) that include each member.

    ``members`` has a row per squad and member; explode id arrays to get it.
    """
    total = members.agg(F.count_distinct(squad_id).alias("__n"))
    counts = members.groupBy(member).agg(F.count_distinct(squad_id).alias("__c"))
    return counts.join(F.broadcast(total)).select(
        member, (F.col("__c") * 100.0 / F.col("__n")).alias("generated_percent"))


def inclusion_calibration(
    members: DataFrame, squad_id: str, member: str, population: DataFrame, rate: str
) -> DataFrame:
    """Correlation and mean absolute gap between inclusion and population rates.

    Members that no squad includes have rate 0.
    """
    joined = population.filter(F.col(rate).isNotNull()).join(
        inclusion_rates(members, squad_id, member), member, "left")
    generated = F.coalesce("generated_percent", F.lit(0.0))
    return joined.select(F.col(rate).cast("double").alias("r"), generated.alias("g")).agg(
        guarded_pearson(F.col("r"), F.col("g")).alias("pearson_correlation"),
        F.avg(F.abs(F.col("r") - F.col("g"))).alias("mean_absolute_error"),
        F.count("*").alias("members"),
    )
