"""Ordered work on long series without one task per series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

# Rows a block owns. A block is one window group: big enough that the rows
# repeated at its edges are few, small enough that one series fills many tasks.
BLOCK_ROWS = 4096


def over_blocks(
    df: DataFrame, place: Column, keys, back: int, ahead: int,
    columns: Callable[[WindowSpec], dict[str, Column]], block: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``back`` rows back and ``ahead`` rows on.

    ``place`` is the row's dense number in its series. Each row also goes to the
    next block if that block's first rows look back at it, and to the previous
    one if its last rows look ahead to it; after the windows only the row in its
    own block is kept. Results equal one window per series, in one exchange.
    """
    if back > block or ahead > block:
        raise ValueError("a block must be at least as long as the frame")
    placed = df.withColumn("_place", place)
    own = F.floor(F.col("_place") / block)
    offset = F.col("_place") - own * block
    targets = F.array_compact(F.array(
        own,
        F.when(offset >= block - back, own + 1),
        F.when(offset < ahead, own - 1),
    ))
    spread = placed.withColumn("_own", own).withColumn("_block", F.explode(targets))
    frame = W.partitionBy(*keys, "_block").orderBy("_place")
    added = columns(frame)
    passed = [F.col(c) for c in df.columns if c not in added]
    return (
        spread.select(
            *passed, *(c.alias(name) for name, c in added.items()),
            (F.col("_own") == F.col("_block")).alias("_mine"),
        )
        .where("_mine")
        .drop("_mine")
    )


def lag(name: str, rows: int, frame: WindowSpec) -> Column:
    return F.lag(name, rows).over(frame)


def lead(name: str, rows: int, frame: WindowSpec) -> Column:
    return F.lead(name, rows).over(frame)


def before(rows: int, frame: WindowSpec) -> WindowSpec:
    """The ``rows`` rows before the current one."""
    return frame.rowsBetween(-rows, -1)


def trailing(rows: int, frame: WindowSpec) -> WindowSpec:
    """The current row and those before it, ``rows`` in all."""
    return frame.rowsBetween(-(rows - 1), 0)


def numbered_by_time(df: DataFrame, keys, ts: str = "timestamp", name: str = "rn") -> DataFrame:
    """Dense number 0..n-1 in time order per series, and the series length ``n``.

    Rows are numbered inside a day; the rows of earlier days come from the daily
    counts, which are few. So a long series is numbered by many tasks.
    """
    dated = df.withColumn("_day", F.to_date(ts))
    days = dated.groupBy(*keys, "_day").agg(F.count("*").alias("_rows"))
    order = W.partitionBy(*keys).orderBy("_day")
    starts = days.select(
        *keys, "_day",
        (F.sum("_rows").over(order) - F.col("_rows")).alias("_start"),
        F.sum("_rows").over(W.partitionBy(*keys)).alias("n"),
    )
    in_day = W.partitionBy(*keys, "_day").orderBy(ts)
    return (
        dated.join(starts, [*keys, "_day"])
        .withColumn(name, F.col("_start") + F.row_number().over(in_day) - 1)
        .select(*df.columns, name, "n")
    )
