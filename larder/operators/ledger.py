"""E05 stock ledger: receipts and reservations on the one stock counter of a material, in order.

A receipt adds its quantity (also a negative one) and never fails. A reservation takes one unit if the
stock is above 0 and its key, (material, tracking id), has not taken one; else it fails and changes
nothing. A line that failed for want of stock may come again: the next line of its key tries anew.

The events are range-partitioned on (material, order), each material's stock before its first event, and each task folds the
materials that lie inside its partition, retries included, in that one pass. What may be cut, the first and the last material of
a partition and those of more than ``LONG`` events, is told apart there and settled apart, so that no task gets a whole hot material:

1. These events are range-partitioned on (material, order) and stored, so a hot material is cut into segments.
2. The stock after a segment is a function of the stock before it that rises by 1 or stays level from
   one unit to the next. ``StockMap`` holds it as the list of its level stretches; stretches below any
   stock that can come in are left out, so a segment without negative receipts has one at most.
3. The maps of the segments of a material, one row a partition boundary, are applied one after the
   other to the stock at the start: that gives the stock before each segment.
4. Each segment is walked once with the stock before it.

Retries are a fixed point: a line counts as long as no earlier line of its key was taken. The first walk lets
the first line of each key count; materials in which a later line found stock after its first one had
failed are walked again with the lines up to the first that found stock. Each turn settles at
least the earliest line that was judged wrongly, only unsettled materials run again, and the
result is that of the plain fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.ordinal import OrderSpec, _same_as_before, kept, sort_columns, stored
from larder.session import partitions, shuffles_removed

LEDGER_ORDER: OrderSpec = (("arrival_key", False), ("kind_rank", False), ("line", False), ("part", False), ("ref", False))
LEDGER_SCHEMA = ("Material_Id string, kind string, quantity long, arrival_key long, kind_rank int, line long, part long, "
                 "ref string")
MAP_SCHEMA = "_part int, Material_Id string, _start long, _shift long, _at array<long>, _extra array<long>"
CARRY_SCHEMA = "_part int, Material_Id string, _before long"
LONG = 1 << 17  # events of one material that a task holds at most
NO_STOCK = -(1 << 63)  # stands for a stock that is NULL: no line finds any


def ledger_events(lines: DataFrame, receipts: DataFrame, line_arrival: str = "arrival_seq",
                  receipt_arrival: Sequence[str] = ("arrival_order", "arrival_line", "arrival_part")) -> DataFrame:
    """One event table from reservation lines (E03 shape) and accepted purchase orders (E04
    shape). ``line_arrival`` and the first of ``receipt_arrival`` are the same counter, on which
    a receipt comes before the lines; the others order receipts of equal arrival."""
    key, line, part = (F.col(c).cast("long") for c in receipt_arrival)
    none = F.lit(0).cast("long")
    res = lines.select("Material_Id", F.lit("reservation").alias("kind"), F.lit(1).cast("long").alias("quantity"),
                       F.col(line_arrival).cast("long").alias("arrival_key"), F.lit(1).alias("kind_rank"),
                       none.alias("line"), none.alias("part"), F.col("trackingID").alias("ref"))
    rec = receipts.select(F.col("p_material_id").alias("Material_Id"), F.lit("receipt").alias("kind"),
                          F.col("p_purchase_qty").cast("long").alias("quantity"), key.alias("arrival_key"),
                          F.lit(0).alias("kind_rank"), line.alias("line"), part.alias("part"),
                          F.col("p_po_no").alias("ref"))
    return res.unionByName(rec)


# ---------------------------------------------------------------- the map of a segment
class StockMap:
    """Stock after a run of events as a function of the stock before it.

    A level stretch of ``extra`` units at value v means that ``extra + 1`` stocks before lead to v; everywhere
    else one unit more before is one unit more after. Stretches are kept by their present value in
    two stacks, at most 0 and above, whose tops are next to 0, so that a receipt moves only those that cross 0.
    """

    def __init__(self) -> None:
        self.shift = 0  # sum of the receipts
        self.low: list[list[int]] = []  # [value less low_by, extra], values rising
        self.high: list[list[int]] = []  # [value less high_by, extra], values falling
        self.low_by = self.high_by = 0

    def receive(self, quantity: int) -> None:
        self.shift += quantity
        self.low_by += quantity
        self.high_by += quantity
        while self.low and self.low[-1][0] + self.low_by > 0:
            value, extra = self.low.pop()
            self.high.append([value + self.low_by - self.high_by, extra])
        while self.high and self.high[-1][0] + self.high_by <= 0:
            value, extra = self.high.pop()
            self.low.append([value + self.high_by - self.low_by, extra])

    def reserve(self, lines: int) -> None:
        """That many reservations in a row: stocks of 0 to ``lines`` end at 0."""
        extra = lines
        while self.high and self.high[-1][0] + self.high_by <= lines:
            extra += self.high.pop()[1]
        if self.low and self.low[-1][0] + self.low_by == 0:
            self.low[-1][1] += extra
        else:
            self.low.append([-self.low_by, extra])
        self.high_by -= lines

    def add(self, receipts: np.ndarray, quantities: np.ndarray) -> None:
        """Events in order: ``receipts`` says which are receipts, ``quantities`` how much they bring."""
        at = np.flatnonzero(receipts)
        between = np.diff(np.concatenate([[-1], at, [len(receipts)]])) - 1  # reservations before each receipt, and after the last
        for lines, quantity in zip(between.tolist(), quantities[at].tolist() + [0]):
            if lines:
                self.reserve(lines)
            if quantity:
                self.receive(quantity)

    def stretches(self, floor: int) -> tuple[int, list[int], list[int]]:
        """Shift, and where the level stretches begin and how long they are, for stocks of ``floor`` or more:
        those wholly below it take their full length from the shift."""
        shift, at, extra, passed = self.shift, [], [], 0
        for value, more in [(v + self.low_by, e) for v, e in self.low] + [(v + self.high_by, e) for v, e in reversed(self.high)]:
            begin = value - self.shift + passed
            passed += more
            if begin + more <= floor:
                shift -= more
            else:
                at.append(begin)
                extra.append(more)
        return shift, at, extra


def stock_after(before: int, shift: int, at: Sequence[int], extra: Sequence[int]) -> int:
    return before + shift - sum(min(max(before - a, 0), e) for a, e in zip(at, extra))


# ---------------------------------------------------------------- inside tasks
def _runs(pdf: pd.DataFrame) -> list[tuple[str, int, int]]:
    """Material, first and last row (exclusive) of each run of equal materials."""
    names = pdf["Material_Id"].to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]]) if len(names) else np.zeros(1, dtype=int)
    return [(names[a], int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def _segment_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The map of each segment of this partition (rows in order; a partition has few segments of cut materials)."""
    maps: dict[str, tuple] = {}
    for pdf in batches:
        active = pdf["_counts"].to_numpy(dtype=bool)
        receipt = pdf["_receipt"].to_numpy(dtype=bool)
        quantity = pdf["quantity"].fillna(0).to_numpy(dtype=np.int64)
        for name, a, b in _runs(pdf):
            if name not in maps:
                maps[name] = (StockMap(), int(pdf["_part"].iloc[a]), int(pdf["_start"].iloc[a]), int(pdf["_floor"].iloc[a]))
            kept = active[a:b]
            maps[name][0].add(receipt[a:b][kept], quantity[a:b][kept])
    rows = [(part, name, start, *m.stretches(floor)) for name, (m, part, start, floor) in maps.items()]
    yield pd.DataFrame(rows, columns=["_part", "Material_Id", "_start", "_shift", "_at", "_extra"])


def _carried(pdf: pd.DataFrame) -> pd.DataFrame:
    """The stock before each segment of a material but its first: one row a segment comes in."""
    pdf = pdf.sort_values("_part")
    stock, out = int(pdf["_start"].iloc[0]), []
    for i, (shift, at, extra) in enumerate(zip(pdf["_shift"], pdf["_at"], pdf["_extra"])):
        if i:
            out.append((int(pdf["_part"].iloc[i]), pdf["Material_Id"].iloc[0], stock))
        stock = stock_after(stock, int(shift), [int(x) for x in at], [int(x) for x in extra])
    return pd.DataFrame(out, columns=["_part", "Material_Id", "_before"])


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judges the rows of a partition in order; ``_found`` says whether there was stock at a row."""
    material, stock = None, 0
    for pdf in batches:
        balance = np.empty(len(pdf), dtype=np.int64)
        accepted = np.empty(len(pdf), dtype=bool)
        found = np.empty(len(pdf), dtype=bool)
        active, receipt = pdf["_counts"].to_numpy(dtype=bool), pdf["_receipt"].to_numpy(dtype=bool)
        quantity = pdf["quantity"].fillna(0).to_numpy(dtype=np.int64)
        before = pdf["_before"].to_numpy(dtype=np.int64)
        for name, a, b in _runs(pdf):
            if name != material:
                material, stock = name, int(before[a])
            at = a
            for r in [*(np.flatnonzero(receipt[a:b]) + a).tolist(), b]:
                if r > at:  # the reservations up to the next receipt take what there is
                    taken = np.minimum(np.cumsum(active[at:r]), max(stock, 0))
                    left = np.concatenate([[stock], stock - taken])
                    balance[at:r], found[at:r] = left[1:], left[:-1] > 0
                    accepted[at:r] = found[at:r] & active[at:r]
                    stock = int(left[-1])
                if r < b:
                    stock += int(quantity[r])
                    balance[r], accepted[r], found[r] = stock, True, True
                at = r + 1
        yield pdf.drop(columns=["_before"]).assign(accepted=accepted, balance=balance, _found=found)


def _fold(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Events of whole materials (``starts``: where each begins) with ``accepted`` and ``balance``. The rows that open a material give
    its stock and are left out; without one it is unknown, and of several each stands for a copy of its events."""
    opens = batch.column("_opens").to_numpy(zero_copy_only=False).tolist()
    receipt = pc.fill_null(pc.equal(batch.column("kind"), "receipt"), False).to_numpy(zero_copy_only=False).tolist()
    stocks = pc.fill_null(batch.column("quantity"), NO_STOCK).to_numpy().tolist()
    quantity = pc.fill_null(batch.column("quantity"), 0).to_numpy().tolist()
    refs = pc.fill_null(batch.column("ref").dictionary_encode().indices, -1).to_numpy().tolist()
    rows, accepted, balance = [], [], []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        first = a
        while first < b and opens[first]:
            first += 1
        copies, taken = first - a, set()
        if not copies:
            continue
        stock = stocks[a]
        events = range(first, b) if copies == 1 else [i for i in range(first, b) for _ in range(copies)]
        for i in events:
            ok = True
            if receipt[i]:
                stock += quantity[i]
            elif stock <= 0 or refs[i] in taken:
                ok = False
            else:
                stock -= 1
                if refs[i] >= 0:  # lines without an id repeat none
                    taken.add(refs[i])
            accepted.append(ok)
            balance.append(stock)
        rows.extend(events)
    return (batch.take(pa.array(rows, pa.int64())).append_column("accepted", pa.array(accepted, pa.bool_()))
            .append_column("balance", pa.array(balance, pa.int64())))


def _left(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Events that are settled apart."""
    return batch.append_column("accepted", pa.nulls(batch.num_rows, pa.bool_())).append_column("balance", pa.nulls(batch.num_rows, pa.int64()))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in order: materials that lie inside it are folded, the others left."""
    begun, left, rest = False, None, None  # the material that is left; rows of the last one so far
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        names = batch.column("Material_Id")
        if not begun:
            begun, left = True, names[0].as_py()
        starts = np.concatenate([[0], np.flatnonzero(~_same_as_before(names)) + 1])
        last = int(starts[-1])
        whole, rest = batch.slice(0, last), batch.slice(last)
        if names[0].as_py() == left:
            head = int(starts[1]) if last else batch.num_rows
            yield _left(batch.slice(0, head))
            whole, starts = whole.slice(head), starts[1:] - head
            rest = rest if last else None
        if whole.num_rows:
            yield _fold(whole, starts[:-1])
        if rest is not None and rest.num_rows > LONG:
            left = names[last].as_py()
            yield _left(rest)
            rest = None
    if rest is not None:
        yield _left(rest)


# ---------------------------------------------------------------- the job
def _walked(events: DataFrame, order: OrderSpec, parts: int) -> DataFrame:
    """events with _start, _receipt and _counts: one ordered walk; adds accepted, balance, _found and _row (a number in
    order of material and ``order``); stored."""
    sort = [F.col("Material_Id").asc_nulls_last(), *sort_columns(order)]
    with shuffles_removed(events.sparkSession):
        spread = stored(events.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
                        .withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    drop = F.sum(F.when(F.col("_receipt") & (F.col("quantity") < 0), F.col("quantity")).otherwise(0))
    parts = spread.groupBy("Material_Id", "_part").agg(drop.alias("_drop"), F.first("_start").alias("_start"))
    mine = Window.partitionBy("Material_Id")  # one row a segment
    earlier = mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cut = parts.withColumn("_spans", F.count("*").over(mine)).withColumn("_dropped", F.coalesce(F.sum("_drop").over(earlier), F.lit(0)))
    floor = F.coalesce(F.try_add(F.least("_start", F.lit(0)), "_dropped"), F.lit(NO_STOCK))
    cut = cut.where("_spans > 1").select("Material_Id", "_part", floor.alias("_floor"))
    # at most two of a partition's materials are cut: the table is bounded by the partition count
    inside = spread.join(F.broadcast(cut), ["Material_Id", "_part"]).select(
        "Material_Id", "_part", "_start", "_floor", "_receipt", "_counts", "quantity")
    carry = inside.mapInPandas(_segment_maps, MAP_SCHEMA).groupBy("Material_Id").applyInPandas(_carried, CARRY_SCHEMA)
    joined = spread.join(F.broadcast(carry), ["Material_Id", "_part"], "left").select(
        *spread.columns, F.coalesce("_before", "_start").alias("_before"))
    schema = T.StructType([*spread.schema.fields, T.StructField("accepted", T.BooleanType()),
                           T.StructField("balance", T.LongType()), T.StructField("_found", T.BooleanType())])
    return kept(joined.mapInPandas(_walk, schema))


def stock_ledger(events: DataFrame, materials: DataFrame, order: OrderSpec = LEDGER_ORDER) -> DataFrame:
    """Each event (``LEDGER_SCHEMA``) with ``accepted`` and the ``balance`` after it. Events of unknown materials
    are left out; of lines that are equal in all of ``order`` and in their key one is the first. The events are read for
    their number, for the cuts and for the rows: hand in stored ones."""
    opening = materials.filter(F.col("material_Id").isNotNull()).select(
        F.col("material_Id").alias("Material_Id"), F.col("quantity").cast("long").alias("quantity"), F.lit(True).alias("_opens"))
    rows = events.filter(F.col("Material_Id").isNotNull()).withColumn("_opens", F.lit(False)).unionByName(opening, allowMissingColumns=True)
    sort = [F.col("Material_Id").asc_nulls_last(), F.col("_opens").desc(), *sort_columns(order)]
    spread = rows.repartitionByRange(partitions(rows.sparkSession, rows), *sort).sortWithinPartitions(*sort)
    schema = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("balance", T.LongType())])
    folded = kept(spread.mapInArrow(_folded, schema))
    # at most two materials of a partition, and those of more than LONG events: their stocks are bounded by these
    left = folded.where(F.col("accepted").isNull())
    stock = left.where("_opens").select(F.col("Material_Id").alias("_mid"), F.coalesce("quantity", F.lit(NO_STOCK)).alias("_start"))
    apart = left.where("NOT _opens").select(*events.columns).join(F.broadcast(stock), F.col("Material_Id") == F.col("_mid")).drop("_mid")
    settled = _settled(apart, order)
    return folded.where(F.col("accepted").isNotNull()).select(*settled.columns).unionByName(settled)


def _settled(events: DataFrame, order: OrderSpec) -> DataFrame:
    """The ledger of events with the stock of their material before them (``_start``), whatever a material's share of all rows."""
    cols = [c for c in events.columns if c != "_start"]
    ev = events.withColumn("_receipt", F.col("kind") == "receipt").withColumn("_id", F.monotonically_increasing_id())
    ev = kept(ev)  # read for the keys and for the walk
    key = ["Material_Id", "ref"]
    place = F.struct(*[x for i, (c, _) in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}"))], "_id")
    again = ev.where(~F.col("_receipt")).groupBy(*key).agg(F.count("*").alias("_lines"), F.min(place).alias("_first")).where(
        "_lines > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_first._id").alias("_first_id"))
    repeated = ~F.col("_receipt") & (F.col("Material_Id") == F.col("_k0")) & (F.col("ref") == F.col("_k1"))
    pending = ev.join(again, repeated, "left").withColumn(
        "_counts", F.col("_first_id").isNull() | (F.col("_id") == F.col("_first_id"))).withColumn(
        "_again", F.col("_first_id").isNotNull()).drop("_k0", "_k1", "_first_id", "_id")
    parts = partitions(ev.sparkSession, ev)
    done: list[DataFrame] = []
    while True:
        walked = _walked(pending, order, parts)
        hits = walked.where("_again").groupBy(*key).agg(F.min(F.when(F.col("_found"), F.col("_row"))).alias("_hit"))
        judged = walked.where("_again").join(hits, key).withColumn(
            "_should", F.col("_hit").isNull() | (F.col("_row") <= F.col("_hit")))
        # a line may count or not without effect while there is no stock: only those that found some matter
        wrong = judged.where((F.col("_should") != F.col("_counts")) & F.col("_found")).select("Material_Id").distinct()
        wrong = kept(wrong)
        if wrong.isEmpty():
            done.append(walked)
            break
        done.append(walked.join(wrong, "Material_Id", "left_anti"))
        turn = walked.join(wrong, "Material_Id", "left_semi").drop("accepted", "balance", "_found", "_part")
        pending = turn.join(judged.select("_row", "_should"), "_row", "left").withColumn(
            "_counts", F.coalesce("_should", F.col("_counts"))).drop("_should", "_row")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*cols, "accepted", "balance")
