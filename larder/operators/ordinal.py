"""Order-dependent operators that never funnel a whole table, or one hot group, into one task.

``RANK() OVER (ORDER BY ...)`` with no partition is a single-task window in Spark. Here
it is one pass over the rows:

1. the rows are range-partitioned and sorted by the key and, among ties, by a hash of the row, so a
   key that a third of all rows share is cut too; each partition numbers its runs of equal
   keys and counts the rows before each run (Arrow batches, one pass);
2. one row a partition (rows, runs, first and last key) gives its offset, and for a run that
   goes on from the partition before, where it began;
3. rank = 1 + offset + rows before the run. Nothing is joined back but that one row a partition.

Step 1's output is stored in the shared folder, so the range cut is fixed for both
consumers and survives an executor loss.

Order keys follow the dialect's NULL placement: ascending puts NULLs last, descending
first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import partitions, removed, scratch_path, shared_dir, shuffles_removed

NO_MIN = np.iinfo(np.int64).max  # "no earlier row" in a running minimum

OrderSpec = Sequence[tuple[str, bool]]  # (column, descending)


def stored(df: DataFrame) -> DataFrame:
    """A copy in the shared folder: it cuts the lineage and outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """A copy in the shared folder by columns, for readers that ask for no order of its rows: packed, and each reads only
    the columns that it needs. Types that such files cannot hold are stored as rows."""
    if any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema.fields):
        return stored(df)
    return _kept_at(df, scratch_path(df.sparkSession, "kept"))


def _kept_at(df: DataFrame, path: str) -> DataFrame:
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept_meanwhile(df: DataFrame) -> Iterator[DataFrame]:
    """A copy as of ``kept`` that is removed after the block: what is built in it must be stored in it."""
    if any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema.fields):
        yield stored(df)
        return
    path = scratch_path(df.sparkSession, "meanwhile")
    try:
        yield _kept_at(df, path)
    finally:
        removed(df.sparkSession, path)


def sort_columns(order: OrderSpec) -> list[Column]:
    return [F.col(c).desc_nulls_first() if desc else F.col(c).asc_nulls_last() for c, desc in order]


def rank_all(df: DataFrame, order: OrderSpec, out: str, *, dense: bool = False,
             num_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out`` = RANK (or DENSE_RANK) over the whole input ordered by ``order``."""
    return ranks_all(df, {out: order}, dense=dense, num_partitions=num_partitions)


def ranks_all(df: DataFrame, orders: dict[str, OrderSpec], *, dense: bool = False,
              num_partitions: int | None = None) -> DataFrame:
    """``df`` plus one rank column for each of ``orders``."""
    for name, order in orders.items():
        df = _ranked(df, order, name, dense, num_partitions or partitions(df.sparkSession))
    return df


def _same_as_before(column: pa.Array) -> np.ndarray:
    """For each row but the first whether it equals the row before; NULL equals NULL, NaN equals NaN."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.fill_null(pc.equal(a, b), False)
    same = pc.or_(same, pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
    return same.to_numpy(zero_copy_only=False)


def _numbered_runs(keys: list[str]):
    """Adds ``_run``, the number of each run of equal keys in the partition, and ``_before``, the rows before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, number, began, last = 0, -1, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for k in keys:
                column = batch.column(batch.schema.get_field_index(k))
                new[1:] |= ~_same_as_before(column)
                if last is not None:
                    new[0] |= not _same_as_before(pa.concat_arrays([last[k], column.slice(0, 1)]))[0]
            new[0] |= last is None
            runs = number + np.cumsum(new)
            starts = np.concatenate([[began], rows + np.flatnonzero(new)])
            before = starts[runs - number]
            rows, number, began = rows + n, int(runs[-1]), int(before[-1])
            last = {k: batch.column(batch.schema.get_field_index(k)).slice(n - 1, 1) for k in keys}
            yield batch.append_column("_run", pa.array(runs.astype(np.int64))).append_column("_before", pa.array(before.astype(np.int64)))

    return run


def _ranked(df: DataFrame, order: OrderSpec, out: str, dense: bool, parts: int) -> DataFrame:
    keys = [c for c, _ in order]
    hashed = [c.name for c in df.schema.fields if not isinstance(c.dataType, (T.MapType, T.VariantType))]
    sort = [*sort_columns(order), F.xxhash64(*hashed)]
    staged = df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*staged.schema.fields, T.StructField("_run", T.LongType()), T.StructField("_before", T.LongType())])
    spread = stored(staged.mapInArrow(_numbered_runs(keys), schema))
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    parts_ = spread.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), (F.max("_run") + 1).alias("_runs"), F.max("_before").alias("_last"),
        F.min_by(key, "_run").alias("_first_key"), F.max_by(key, "_run").alias("_last_key"))
    by_part = Window.orderBy("_part")  # one row a partition
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    parts_ = parts_.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).withColumn(
        "_on", F.coalesce(F.lag("_last_key").over(by_part).eqNullSafe(F.col("_first_key")) & F.lag("_rows").over(by_part).isNotNull(), F.lit(False)))
    began = F.when(~F.col("_on") | (F.col("_runs") > 1), F.col("_offset") + F.col("_last"))  # of the last run
    parts_ = parts_.withColumn("_start", F.last(began, ignorenulls=True).over(earlier)).withColumn(
        "_distinct", F.coalesce(F.sum(F.col("_runs") - F.col("_on").cast("long")).over(earlier), F.lit(0)))
    rank = F.when(F.col("_on") & (F.col("_run") == 0), F.col("_start")).otherwise(F.col("_offset") + F.col("_before"))
    if dense:
        rank = F.col("_distinct") + F.col("_run") - F.col("_on").cast("long")
    offsets = parts_.select("_part", "_offset", "_on", "_start", "_distinct")
    return spread.join(F.broadcast(offsets), "_part").select(*df.columns, (rank + 1).cast("long").alias(out))


# ---------------------------------------------------------------------------- scans
def _local_scan(by: Sequence[str], value: str):
    """Per partition, rows sorted by (by, order): position, running sum and the running
    minimum of the running sum before each row, all within the group's run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key of the row before
        carry_n, carry_sum, carry_min = 0, 0, NO_MIN  # of its group: rows, sum, and minimum of running sums before the next row
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = {b: batch.column(batch.schema.get_field_index(b)) for b in by}
            new = np.zeros(n, dtype=bool)
            for b, column in keys.items():
                new[1:] |= ~_same_as_before(column)
                if last is not None:
                    new[0] |= not _same_as_before(pa.concat_arrays([last[b], column.slice(0, 1)]))[0]
            new[0] |= last is None
            runs, starts = np.cumsum(new), np.flatnonzero(new)  # run 0 goes on from the batch before
            vals = pc.fill_null(batch.column(batch.schema.get_field_index(value)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(vals)
            pos = np.arange(1, n + 1) - np.concatenate([[-carry_n], starts])[runs]
            csum = sums - np.concatenate([[-carry_sum], sums[starts] - vals[starts]])[runs]
            prev_min = pd.Series(csum).groupby(runs).cummin().groupby(runs).shift(1, fill_value=NO_MIN).to_numpy(copy=True)
            head = runs == 0
            prev_min[head] = np.minimum(prev_min[head], carry_min)
            last = {b: column.slice(n - 1, 1) for b, column in keys.items()}
            carry_n, carry_sum, carry_min = int(pos[-1]), int(csum[-1]), int(min(csum[-1], prev_min[-1]))
            for name, found in (("_pos", pos), ("_run", csum), ("_min_prev", prev_min)):
                batch = batch.append_column(name, pa.array(found.astype(np.int64)))
            yield batch

    return run


def scan_within(df: DataFrame, by: Sequence[str], order: OrderSpec, value: Column | str | None = None,
                *, num_partitions: int | None = None) -> DataFrame:
    """Ordered prefix scan per ``by`` group, skew-safe.

    Adds ``_pos`` (1-based position), ``_run`` (inclusive running sum of ``value``,
    whole numbers) and ``_min_prev`` (minimum of ``_run`` over the earlier rows of the
    group, NULL for the first row). ``order`` must be total within a group.

    Rows are range-partitioned on (group, order), so a hot group spreads over many
    partitions; each partition scans its rows once; a group that crosses partition
    boundaries gets a carry (count, sum, minimum) from the partitions before it. Only
    boundary-crossing groups need a carry, at most one per partition boundary, so the
    carry table is bounded by the partition count and is broadcast.
    """
    spark = df.sparkSession
    shared_dir(spark)
    val = F.lit(1) if value is None else (F.col(value) if isinstance(value, str) else value)
    staged = df.withColumn("_val", val.cast("long"))
    sort_cols = [F.col(b).asc_nulls_last() for b in by] + sort_columns(order)
    schema = T.StructType(list(staged.schema.fields) + [
        T.StructField("_part", T.IntegerType(), False), T.StructField("_pos", T.LongType(), False),
        T.StructField("_run", T.LongType(), False), T.StructField("_min_prev", T.LongType(), True)])
    staged = kept(staged)  # read by the range sampler and by the scan
    parts = num_partitions or partitions(spark, staged)
    spread = kept(staged.repartitionByRange(parts, *sort_cols).sortWithinPartitions(*sort_cols)
                  .withColumn("_part", F.spark_partition_id())
                  .mapInArrow(_local_scan(by, "_val"), schema))
    seg = (spread.groupBy("_part", *by)
           .agg(F.max("_pos").alias("_n"), F.max_by("_run", "_pos").alias("_total"),
                F.min("_run").alias("_low")))
    grp = Window.partitionBy(*by)
    prior = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = (seg.withColumn("_spans", F.count(F.lit(1)).over(grp)).filter(F.col("_spans") > 1)
             .withColumn("_c_n", F.sum("_n").over(prior))
             .withColumn("_c_sum", F.sum("_total").over(prior))
             .withColumn("_abs_low", F.col("_low") + F.coalesce(F.col("_c_sum"), F.lit(0)))
             .withColumn("_c_low", F.min("_abs_low").over(prior))
             .filter(F.col("_c_n").isNotNull())
             .select("_part", *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], "_c_n", "_c_sum", "_c_low"))
    cond = [spread["_part"] == carry["_part"]] + [spread[b].eqNullSafe(carry[f"_b{i}"]) for i, b in enumerate(by)]
    joined = spread.join(F.broadcast(carry), cond, "left")  # carry: at most one row per partition boundary
    c_n = F.coalesce(F.col("_c_n"), F.lit(0))
    c_sum = F.coalesce(F.col("_c_sum"), F.lit(0))
    # least() skips NULL: no carry, or no earlier row in the partition
    min_prev = F.least(F.when(F.col("_min_prev") != NO_MIN, F.col("_min_prev") + c_sum), F.col("_c_low"))
    keep = [c for c in df.columns]
    return joined.select(*[spread[c] for c in keep],
                         (F.col("_pos") + c_n).alias("_pos"),
                         (F.col("_run") + c_sum).alias("_run"),
                         min_prev.alias("_min_prev"))
