"""Reusable report shapes. Each takes column names, so it also runs on any fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str,
                fn: str = "row_number") -> DataFrame:
    """Position inside each ``by`` group. Use only where a group is bounded (an
    aggregate's output per key, e.g. items of one franchise); whole-table order goes
    through ``ordinal.rank_all``."""
    w = Window.partitionBy(*by).orderBy(*order)
    f = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[fn]
    return df.withColumn(out, f().over(w).cast("long"))


def previous_period(df: DataFrame, by: Sequence[str], period: str, value: str, out: str) -> DataFrame:
    """Value of the previous present period of the same key (gaps are not filled)."""
    w = Window.partitionBy(*by).orderBy(F.col(period).asc_nulls_last())
    return df.withColumn(out, F.lag(value, 1).over(w))


def total_of(df: DataFrame, value: str) -> Column:
    """Grand total as an uncorrelated scalar subquery (one row; computed once)."""
    return df.select(F.sum(value)).scalar()


def spread_nulls(df: DataFrame, key: str, places: int = 1000) -> DataFrame:
    """Adds ``_spread``: 0 where ``key`` has a value, else one of ``places`` numbers from 1 on. With it
    as a second join key (0 on the other side) rows without a key match nothing and are dealt out."""
    place = F.pmod(F.xxhash64(*df.columns), F.lit(places)) + 1
    return df.withColumn("_spread", F.when(F.col(key).isNull(), place).otherwise(F.lit(0)).cast("int"))
