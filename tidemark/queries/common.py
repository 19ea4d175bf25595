"""Table access and column expressions shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def day(stamp: str) -> Column:
    """Days since 1970, independent of the session's time zone."""
    return F.unix_date(F.to_date(F.col(stamp))).cast("bigint")


def seconds(stamp: str) -> Column:
    return (F.unix_date(F.to_date(F.col(stamp))).cast("bigint") * 86400
            + F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)).cast("bigint")


def month_index(stamp: str) -> Column:
    return (F.year(stamp) * 12 + F.month(stamp)).cast("bigint")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST({0} AS DATE)) AS BIGINT)"
SLOT = "CAST(floor(epoch({0}) / 600) AS BIGINT)"
MONTH = "CAST(year({0}) * 12 + month({0}) AS BIGINT)"
