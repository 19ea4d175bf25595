"""Contracts checked before data is used: columns, keys, rows that must not exist.

Each check is one aggregation that returns a handful of example rows; no check
collects data to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """The data breaks a contract an operator depends on."""


EXAMPLES = 5


def require_columns(df: DataFrame, columns: Iterable[str], label: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{label} lacks columns {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count.

    The count is combined map-side, so a hot key costs one row per task.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    examples = duplicate_keys(df, keys).limit(EXAMPLES).collect()
    if examples:
        shown = [row.asDict() for row in examples]
        raise ContractError(f"{label} is not unique by {list(keys)}: {shown}")
    return df


def require_no_rows(df: DataFrame, message: str) -> None:
    """Fail, showing examples, when a frame of violations is not empty."""
    examples = df.limit(EXAMPLES).collect()
    if examples:
        raise ContractError(f"{message}: {[row.asDict() for row in examples]}")


def require_rows(df: DataFrame, label: str = "table") -> DataFrame:
    if df.isEmpty():
        raise ContractError(f"{label} has no rows")
    return df


def require_fields(df: DataFrame, fields: Sequence[str], label: str = "record") -> DataFrame:
    """Columns must exist and be filled in every row."""
    require_columns(df, fields, label)
    holes = df.filter(" OR ".join(f"`{name}` IS NULL" for name in fields))
    require_no_rows(holes.select(*fields), f"{label} rows lack required fields")
    return df


def validate_horizons(horizons: Sequence[int]) -> tuple[int, ...]:
    """Horizons are unique positive whole numbers; True and False are not."""
    values = tuple(horizons)
    wrong = [v for v in values if isinstance(v, bool) or not isinstance(v, int) or v < 1]
    if not values or wrong:
        raise ContractError("horizons must be positive whole numbers")
    if len(set(values)) < len(values):
        raise ContractError("horizons must not repeat")
    return values


def split_by_deadline(
    df: DataFrame, collected: str, deadline: str, must_precede: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Rows that respect a deadline, and the quarantined rest.

    ``must_precede`` keeps rows collected no later than the deadline (features);
    turned off it keeps rows collected no earlier (published choices).
    """
    timely: Column = (
        F.col(collected) <= F.col(deadline) if must_precede
        else F.col(collected) >= F.col(deadline)
    )
    flagged = F.coalesce(timely, F.lit(False))
    return df.filter(flagged), df.filter(~flagged)


def require_deadline(
    df: DataFrame, collected: str, deadline: str, identity: Sequence[str],
    must_precede: bool = True,
) -> DataFrame:
    """Fail, naming the periods, when any row breaks the deadline rule."""
    kept, late = split_by_deadline(df, collected, deadline, must_precede)
    require_no_rows(late.select(*identity).distinct(), "rows break the deadline rule")
    return kept
