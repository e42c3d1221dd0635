"""What the operators share: intermediate tables in the folder of all executors, and columns of any names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stage

__all__ = ["discard", "named", "stage", "tucked", "untucked"]


def named(column: str, within: str = "") -> Column:
    """The column (or the field of a struct) of this name, whatever is in it."""
    return F.col(within + "`" + column.replace("`", "``") + "`")


def tucked(df: DataFrame, used: list[str]) -> DataFrame:
    """``df`` with only the ``used`` columns at the top; all others, whatever their names, go into one struct, ``carried``."""
    others = [c for c in df.columns if c not in used]
    carried = F.struct(*map(named, others)) if others else F.lit(None).cast("int")
    return df.select(*map(named, used), carried.alias("carried"))


def untucked(columns: list[str], used: list[str]) -> list[Column]:
    """The columns of a table that was ``tucked``, by their names."""
    return [named(c) if c in used else named(c, "carried.").alias(c) for c in columns]
