"""Groups and ranks along an order: islands, frames, keep-first permutations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_islands(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, limit: float, out: str = "row_idx") -> DataFrame:
    """Adds a row number (from 0) that rises wherever ``value`` differs from the one before by more than ``limit``."""
    w = Window.partitionBy(*group).orderBy(*order)
    jump = F.coalesce((F.abs(F.col(value) - F.lag(value).over(w)) > limit).cast("int"), F.lit(0))
    return df.withColumn("_jump", jump).withColumn(out, F.sum("_jump").over(w).cast("int")).drop("_jump")


def close_runs(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, k: int, out: str = "closed") -> DataFrame:
    """Adds the 1-D closing of ``value``: the largest, then the smallest within k // 2 places on each side (a frame cut off at an
    end has the same extremes as a repeated border). Below 2, nothing changes."""
    if k < 2:
        return df.withColumn(out, F.col(value))
    frame = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(k // 2), k // 2)
    return df.withColumn("_wide", F.max(value).over(frame)).withColumn(out, F.min("_wide").over(frame)).drop("_wide")


def keep_first(df: DataFrame, group: Sequence[str], keep: Column, idx: str, out: str = "place") -> DataFrame:
    """Adds a place from 0: rows to keep first, then the others, each in their old order."""
    w = Window.partitionBy(*group).orderBy(F.col("_keep").desc(), F.col(idx))
    return df.withColumn("_keep", keep.cast("int")).withColumn(out, F.row_number().over(w) - 1).drop("_keep")


def page_bounds(n: int, page_range: tuple[int, int | None] | None) -> tuple[int, int]:
    """Start and end (exclusive) of the pages to read, within the document."""
    if page_range is None:
        return 0, n
    start = min(page_range[0], n)
    end = n if page_range[1] is None else min(page_range[1], n)
    return start, max(start, end)


def in_page_range(df: DataFrame, page_range: tuple[int, int | None] | None) -> DataFrame:
    """Rows of the wanted pages: a plain filter on page_idx, which reaches the scan."""
    if page_range is None:
        return df
    start, end = page_range
    rows = df.where(F.col("page_idx") >= start)
    return rows if end is None else rows.where(F.col("page_idx") < end)
