"""Structured Streaming forms of the row-event jobs.

E06: coupon totals on a stream of order requests (stream-static join; stateless).
E07: stock status on a stream of inventory rows, the latest row per key as keyed state; a ``foreachBatch``
     sink writes what changed, and the reader reads the state.
E08: stock reservation on a stream of shipment lines (``foreachBatch``): the state is the stock left, a
     table a micro-batch, and the lines that took units, as written.

Sources, sinks and checkpoints live below the shared folder; a restarted query resumes
from its checkpoint, and the file sink commits each micro-batch exactly once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.events import LINE_ORDER, apply_coupon_totals, reserve_stock, stock_status
from larder.operators.ordinal import OrderSpec
from larder.session import partitions


def stream_files(spark: SparkSession, path: str, template: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A parquet file stream with the schema of ``template`` (never inferred)."""
    return (spark.readStream.schema(template.schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(path))


def run_to_sink(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available (``availableNow``), writing parquet, then stop."""
    q = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------------------------- E06
def coupon_totals_stream(requests: DataFrame, coupons: DataFrame, as_of: dt.datetime | Column | None = None) -> DataFrame:
    """The E01 job on a stream (same function; the coupon table is static). ``as_of``: a column of the requests,
    so a coupon runs out while the stream runs; by default the time of each micro-batch, which a batch that
    runs again after a crash keeps; one fixed time replays a past day."""
    return apply_coupon_totals(requests, coupons, F.current_timestamp() if as_of is None else as_of)


# ------------------------------------------------------------------------- E07
INVENTORY_KEY = ("Material_Id", "inv_Id")


#: Rows that one step of the reader makes of a counted row.
COPIES = 1 << 16


def latest_stock_status(stream: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The stream scored (E02) and reduced to keyed state: for each (material, inventory) the row of the latest
    micro-batch that has it, in it the greatest by ``order`` (then by the other columns). Spark reduces within tasks
    first, so a hot key costs one row a task. A row with a NULL in the key is no version of another: it has a state of its
    own, equal ones with a count. The place of a micro-batch is its time, which a batch that runs again keeps;
    the driver's clock must not run backwards between restarts. In update mode only changed keys come out."""
    scored = stock_status(stream)
    keys = [c for c in INVENTORY_KEY if c in scored.columns]
    lacking = F.lit(False)
    for k in keys:
        lacking = lacking | F.col(k).isNull()
    row = F.struct(*[F.col(f"_row.{c}") for c in order], F.col("_row"))
    return (scored.select(*keys, F.struct(*scored.columns).alias("_row"), lacking.alias("_lacking"), F.current_timestamp().alias("_at"))
            .groupBy(*keys, F.when(F.col("_lacking"), F.col("_row")).alias("_own"))
            .agg(F.max(F.struct(F.col("_at"), row.alias("_by"), F.col("_row").alias("_last"))), F.count(F.when(F.col("_lacking"), 1)))
            .toDF(*keys, "_own", "_state", "_n"))


def stock_status_changes(root: str):
    """``foreachBatch`` function: writes the rows that the micro-batch changed as files of its own, for readers downstream;
    a batch that runs again after a crash replaces them. ``copies``: how many such rows there are by now."""

    def change(batch: DataFrame, epoch: int) -> None:
        batch.select("_state._last.*", F.greatest(F.col("_n"), F.lit(1)).alias("copies")).write.mode("overwrite").parquet(
            f"{root.rstrip('/')}/epoch={epoch}")

    return change


def run_stock_status_stream(stream: DataFrame, root: str, checkpoint: str, order: Sequence[str] = ()) -> None:
    """E07. The partitions of the state are the session's shuffle partitions at the first start; a state larger than the
    executors' memory wants the session's RocksDB state store."""
    q = (latest_stock_status(stream, order).writeStream.outputMode("update").foreachBatch(stock_status_changes(root))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_stock_status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows as the last finished micro-batch left them, from the stream's state: no history is reduced. Rows without
    a whole key are made again from their count, in steps that several tasks share."""
    state = spark.read.format("statestore").load(checkpoint).select("value.max._last", F.col("value.count").alias("_n"))
    many = state.filter("_n > 1").withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}"))))
    many = many.repartition(partitions(spark), F.xxhash64("_last", "_step")).withColumn(
        "_place", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("_n") - F.col("_step") * COPIES))))
    return state.filter("_n <= 1").select("_last.*").unionByName(many.select("_last.*"))


# ------------------------------------------------------------------------- E08
def reservation_changes(root: str, materials: DataFrame, order: OrderSpec, shipments: DataFrame | None, existing: DataFrame | None):
    """``foreachBatch`` function: E03 on the batch, with the stock that the batch before it left. Writes the judged
    lines and the stock after them, each to a folder of the batch: one that runs again after a crash
    reads the same stock and replaces both. A line repeats one of an earlier batch if that one was taken: these
    are read from the lines as written, for materials with stock left only (the others fail for
    stock first), so no more of them are read than there were units, however long the stream is."""
    base = root.rstrip("/")

    def reserve(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        stock, had = materials, existing
        if epoch:
            stock = spark.read.parquet(f"{base}/stock/epoch={epoch - 1}")
            took = spark.read.parquet(f"{base}/lines").filter(f"epoch < {epoch} AND status = 'accepted'")
            left = stock.filter("quantity > 0").select(F.col("material_Id").alias("_left"))
            took = took.join(left, F.col("Material_Id") == F.col("_left"), "left_semi").select("Material_Id", "trackingID")
            had = took if existing is None else took.unionByName(existing.select("Material_Id", "trackingID"))
        judged = reserve_stock(batch, stock.select("material_Id", "quantity"), order, shipments, had)
        judged.lines.write.mode("overwrite").parquet(f"{base}/lines/epoch={epoch}")
        # what the batch took is counted from the lines as written
        taken = spark.read.parquet(f"{base}/lines/epoch={epoch}").filter("status = 'accepted'").groupBy("Material_Id").agg(
            F.count(F.lit(1)).alias("_taken"))
        left = stock.join(taken, stock["material_Id"] == taken["Material_Id"], "left").select(
            stock["material_Id"], (F.col("quantity") - F.coalesce("_taken", F.lit(0))).cast("long").alias("quantity"))
        left.write.mode("overwrite").parquet(f"{base}/stock/epoch={epoch}")

    return reserve


def run_reservation_stream(lines: DataFrame, materials: DataFrame, root: str, checkpoint: str, order: OrderSpec = LINE_ORDER,
                           shipments: DataFrame | None = None, existing: DataFrame | None = None) -> None:
    """E03 on a stream of shipment lines. Within a micro-batch lines are taken in ``order`` by a scan that splits
    a hot material; across batches, batch order is arrival order. Stock changes after the start must arrive as
    events (E05), not as edits of the snapshot."""
    q = (lines.writeStream.foreachBatch(reservation_changes(root, materials, order, shipments, existing))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_reservations(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/lines").drop("epoch")
