"""Union with provenance and rejection of overlapping sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.guards import ContractError, duplicate_keys, require_no_rows


def union_sources(sources: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """UNION ALL by column name; a column a source lacks becomes NULL."""
    if not sources:
        raise ContractError("no source to unite")
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def overlapping_keys(df: DataFrame, keys: Sequence[str], tag: str = "source") -> DataFrame:
    """Keys that occur more than once over all sources, and in how many of them."""
    found = df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_distinct(tag).alias("sources"))
    return found.filter("rows > 1")


def disjoint_union(
    sources: Mapping[str, DataFrame], keys: Sequence[str], tag: str = "source"
) -> DataFrame:
    """Unite sources that may not share a key; an overlap is never dropped silently."""
    united = union_sources(sources, tag)
    require_no_rows(duplicate_keys(united, keys).select(*keys), "sources overlap on keys")
    return united
