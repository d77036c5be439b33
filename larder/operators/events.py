"""Row-event jobs: the reference's triggers and procedure as set-based DataFrame jobs.

E01 coupon totals, E02 stock status, E03 stock reservation, E04 purchase-order intake,
E05 stock ledger (E03 and E04 interleaved on the one counter they share; in ``ledger``).

A trigger fires per row in arrival order; here a batch of rows is one job. Order
dependence (one unit per shipment line while stock lasts, running stock after each
purchase) goes through ``ordinal.scan_within``, which never puts one material's rows
into one task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from contextlib import ExitStack
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.exprs import first_date_at_or_after
from larder.operators.ledger import LEDGER_ORDER, LEDGER_SCHEMA, ledger_events, stock_ledger  # noqa: F401  (E05)
from larder.operators.ordinal import OrderSpec, kept, kept_meanwhile, scan_within
from larder.operators.shaping import spread_nulls

# Fixed values of the reference's error handling.
INSUFFICIENT_STOCK = -20005
INSUFFICIENT_STOCK_TEXT = "Insufficient stock for the material."
MATERIAL_NOT_FOUND = -20002
MATERIAL_NOT_FOUND_TEXT = "Material ID not found in RAW_MATERIALS table."
UNEXPECTED_ERROR = -20003
UNEXPECTED_ERROR_TEXT = "An unexpected error occurred: "
PO_PREFIX = "PO"
PO_NO_WIDTH = 16

STOCK_LABELS = ("Low", "Decent", "High")  # fixed labels of the stock-status trigger


# ------------------------------------------------------------------------- E01
def apply_coupon_totals(order_requests: DataFrame, coupons: DataFrame, as_of: dt.datetime | Column) -> DataFrame:
    """``totalamount`` of each incoming order from its subtotal and optional coupon.

    A coupon applies when ``subtotal >= minimum`` and ``as_of <= expiry`` (both
    inclusive; the expiry date means its midnight). ``as_of`` is one time for all rows, or a column:
    the time of each request, or ``F.current_timestamp()``, which a stream sets anew for each
    micro-batch. A request without a time gets no discount. An unknown code, a missing total or
    a negative total rejects the row (``accepted`` false, ``totalamount`` NULL).

    Requests are read once: those without a coupon get a spread key that no coupon has, so they
    neither match nor meet in one task.
    """
    if isinstance(as_of, dt.datetime):
        in_time = F.col("_expiry") >= F.lit(first_date_at_or_after(as_of))
    else:
        in_time = F.col("_expiry").cast("timestamp") >= as_of
    c = coupons.filter(F.col("coupon_code").isNotNull()).select(
        F.col("coupon_code").alias("_code"), F.col("minPurchase_amt").alias("_min"), F.col("coupExpiry").alias("_expiry"),
        F.col("coupDiscount").alias("_discount"), F.lit(0).alias("_place"))
    both = spread_nulls(order_requests, "coupon_code").join(
        c, F.col("coupon_code").eqNullSafe(F.col("_code")) & (F.col("_spread") == F.col("_place")), "left")
    has = F.col("coupon_code").isNotNull()
    known = F.col("_code").isNotNull()
    valid = (F.col("subtotal") >= F.col("_min")) & in_time
    total = (F.when(~has, F.col("subtotal"))
             .when(~known, F.lit(None))
             .when(valid, F.col("subtotal") - F.col("_discount"))
             .otherwise(F.col("subtotal")))
    status = (F.when(has & ~known, F.lit("unknown_coupon"))
              .when(F.col("_total").isNull(), F.lit("missing_total"))
              .when(F.col("_total") < 0, F.lit("negative_total"))
              .when(~has, F.lit("no_coupon"))
              .when(valid, F.lit("applied"))
              .otherwise(F.lit("not_applied")))
    staged = both.withColumn("_total", total.cast("decimal(18,2)")).withColumn("coupon_status", status)
    accepted = F.col("coupon_status").isin("no_coupon", "applied", "not_applied")
    return staged.select(*order_requests.columns,
                         F.when(accepted, F.col("_total")).alias("totalamount"),
                         "coupon_status", accepted.alias("accepted"))


# ------------------------------------------------------------------------- E02
def stock_status(inventory_details: DataFrame) -> DataFrame:
    """``inv_stock_status`` from quantity on hand against the reorder level.

    At or below the level: Low; at or below twice the level: Decent; otherwise (NULLs
    included) High. A supplied status is overwritten.
    """
    q, level = F.col("inv_qoh"), F.col("inv_reorder_level")
    status = (F.when(q <= level, F.lit(STOCK_LABELS[0]))
              .when(q <= level * 2, F.lit(STOCK_LABELS[1]))
              .otherwise(F.lit(STOCK_LABELS[2])))
    return inventory_details.withColumn("inv_stock_status", status)


# ------------------------------------------------------------------------- E03
class Reservation:
    """E03 outputs, each built on first use. ``lines`` runs the ordered scan;
    ``eligible`` needs neither it nor the keys that repeat: the lines that may take a unit, repeated ones included (a line that
    failed for want of stock may come again in a ledger). ``materials_after`` needs no line but only the keys: the order says
    which lines take the units of a material, not how many units are taken."""

    def __init__(self, build_judged, build_lines, build_eligible, build_after):
        self._build_judged = build_judged
        self._build_lines = build_lines
        self._build_eligible = build_eligible
        self._build_after = build_after

    @cached_property
    def _judged(self) -> DataFrame:  # every input line with its material's stock and what is wrong with its key
        return self._build_judged()

    @cached_property
    def lines(self) -> DataFrame:  # every input line with status / error
        return self._build_lines(self._judged)

    @cached_property
    def eligible(self) -> DataFrame:
        return self._build_eligible()

    @cached_property
    def materials_after(self) -> DataFrame:  # material_Id, quantity after the accepted reservations
        return self._build_after()


LINE_ORDER: OrderSpec = (("arrival_seq", False), ("trackingID", False))
#: Reasons of lines that pass the stock test and break a rule of their table.
LINE_REASONS = ("missing_key", "duplicate_line", "unknown_shipment")


def _numbered(df: DataFrame) -> DataFrame:
    """A stored copy with ``_id``, a number of each row that no later step changes."""
    return kept(df.withColumn("_id", F.monotonically_increasing_id()))


def _place(order: OrderSpec, numbered: bool = True) -> Column:
    """A row's place in ``order``, NULLs last; equal rows by their number."""
    if any(desc for _, desc in order):
        raise ValueError("first rows are taken in ascending order")
    return F.struct(*[x for i, (c, _) in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}"))],
                    *[F.col("_id").alias("_id")] * numbered)


def _first_of_key(df: DataFrame, key: Sequence[str], order: OrderSpec) -> DataFrame:
    """``_id`` of the first row of each key (column ``_first_id``), by a partial aggregate: a key
    with a third of all rows is reduced where it is read."""
    return df.groupBy(*key).agg(F.min(_place(order)).alias("_place")).select(F.col("_place._id").alias("_first_id"))


def _with_stock(df: DataFrame, column: str, materials: DataFrame) -> DataFrame:
    """``_mid`` and ``_stock`` of each row's material; rows without one do not meet the join."""
    stock = materials.select(F.col("material_Id").alias("_mid"), F.col("quantity").alias("_stock"))
    found = df.filter(F.col(column).isNotNull()).join(stock, F.col(column) == F.col("_mid"), "left")
    return found.unionByName(df.filter(F.col(column).isNull()), allowMissingColumns=True)


def _keys(lines: DataFrame, existing: DataFrame | None, place: Column) -> DataFrame:
    """The whole keys of ``lines`` and of the stored rows: ``_lines`` that have it, ``_place`` of the first one, and ``_held``, whether
    it is stored. Partly summed where they are read."""
    whole = F.col("Material_Id").isNotNull() & F.col("trackingID").isNotNull()
    seen = lines.filter(whole).select("Material_Id", "trackingID", place.alias("_place"), F.lit(False).alias("_held"))
    if existing is not None:
        none = F.lit(None).cast(seen.schema["_place"].dataType)
        seen = seen.unionByName(existing.filter(whole).select("Material_Id", "trackingID", none.alias("_place"), F.lit(True).alias("_held")))
    return seen.groupBy("Material_Id", "trackingID").agg(
        F.count("_place").alias("_lines"), F.min("_place").alias("_place"), F.max("_held").alias("_held"))


def _stock_left(materials: DataFrame, asked: DataFrame) -> DataFrame:
    """``materials`` after ``_asked`` lines of each ``Material_Id`` have come, each of which takes a unit while there is one.
    A line is held against each row of its material: the c-th of m rows (from 0) sees the lines at places c, c + m, ..."""
    rows = Window.partitionBy("_mid")  # those of one material
    stock = materials.filter(F.col("material_Id").isNotNull()).select(F.col("material_Id").alias("_mid"), F.col("quantity").alias("_stock"))
    stock = stock.withColumn("_m", F.count(F.lit(1)).over(rows)).withColumn("_c", F.row_number().over(rows.orderBy("_stock")) - 1)
    taken = (asked.join(stock, F.col("Material_Id") == F.col("_mid"))
             .withColumn("_places", F.least(F.greatest(F.ceil("_stock").cast("long"), F.lit(0)), F.col("_asked") * F.col("_m")))
             .groupBy("_mid").agg(F.sum(F.expr("(_places - _c + _m - 1) div _m")).alias("_used")))
    return (materials.join(taken, F.col("material_Id") == F.col("_mid"), "left")
            .select("material_Id", (F.col("quantity") - F.coalesce(F.col("_used"), F.lit(0))).cast("long").alias("quantity")))


def reserve_stock(shipment_lines: DataFrame, materials: DataFrame, order: OrderSpec = LINE_ORDER,
                  shipments: DataFrame | None = None, existing: DataFrame | None = None) -> Reservation:
    """Each new shipment line takes one unit of its material while stock is above 0.

    Lines are judged in ``order`` per material. The stock test comes first: with nothing left a
    line fails with INSUFFICIENT_STOCK, whatever else is wrong. Then its key: a missing part, a
    tracking id that ``shipments`` lacks, or a (material, tracking id) that an earlier line or
    ``existing`` has fails the line, and it takes nothing.
    """
    cols, place = shipment_lines.columns, _place(order)
    missing, duplicate, unknown = (F.lit(r) for r in LINE_REASONS)

    def build_judged() -> DataFrame:
        lines = _numbered(shipment_lines)
        keyed = lines.filter(F.col("Material_Id").isNotNull() & F.col("trackingID").isNotNull())
        # the keys that lines share or that are stored: a line whose key is none of them is new
        shared = _keys(lines, existing, place).filter("_lines > 1 OR (_lines = 1 AND _held)").select(
            F.col("Material_Id").alias("_km"), F.col("trackingID").alias("_kt"), F.col("_place._id").alias("_first_id"), "_held")
        checked = keyed.join(shared, (F.col("Material_Id") == F.col("_km")) & (F.col("trackingID") == F.col("_kt")), "left")
        known, stored_before = F.lit(True), F.coalesce("_held", F.lit(False))
        if shipments is not None:
            ids = shipments.filter(F.col("trackingID").isNotNull()).select(F.col("trackingID").alias("_tid")).distinct()
            checked = checked.join(ids, F.col("trackingID") == F.col("_tid"), "left")
            known = F.col("_tid").isNotNull()
        repeats = stored_before | F.coalesce(F.col("_id") != F.col("_first_id"), F.lit(False))
        checked = checked.select(*cols, F.when(~known, unknown).when(repeats, duplicate).alias("_reason"))
        bare = lines.filter(F.col("Material_Id").isNull() | F.col("trackingID").isNull()).select(*cols, missing.alias("_reason"))
        stock = materials.select(F.col("material_Id").alias("_mid"), F.col("quantity").alias("_stock"))
        named = checked.unionByName(bare.filter(F.col("Material_Id").isNotNull()))
        return named.join(stock, F.col("Material_Id") == F.col("_mid"), "left").unionByName(
            bare.filter(F.col("Material_Id").isNull()), allowMissingColumns=True)

    def build_lines(judged: DataFrame) -> DataFrame:
        """All lines go through the scan, so they are judged once; those of no material are marked after it."""
        takes = F.col("_reason").isNull().cast("long")
        scanned = scan_within(judged, ["Material_Id"], order, takes)
        there = F.col("_mid").isNotNull()
        left = F.col("_stock") - (F.col("_run") - takes) > 0
        ok = there & left & F.col("_reason").isNull()
        return scanned.select(
            *cols, F.when(ok, F.lit("accepted")).otherwise(F.lit("rejected")).alias("status"),
            F.when(there & ~left, F.lit(INSUFFICIENT_STOCK)).cast("int").alias("error_code"),
            F.when(~there, F.lit("unknown_material")).when(~left, F.lit("insufficient_stock")).otherwise(F.col("_reason")).alias("reason"))

    def build_eligible() -> DataFrame:
        """Lines with a whole key that is not stored, a known shipment and a known material. Each lookup ends in a copy, so that
        the shuffles of one lookup only are on disk at a time."""
        found = shipment_lines.filter(F.col("Material_Id").isNotNull() & F.col("trackingID").isNotNull())
        steps = []
        if shipments is not None:
            steps.append((shipments.select(F.col("trackingID").alias("_tid")), F.col("trackingID") == F.col("_tid"), "left_semi"))
        if existing is not None:
            held = existing.select(F.col("Material_Id").alias("_km"), F.col("trackingID").alias("_kt"))
            steps.append((held, (F.col("Material_Id") == F.col("_km")) & (F.col("trackingID") == F.col("_kt")), "left_anti"))
        steps.append((materials.select(F.col("material_Id").alias("_mid")), F.col("Material_Id") == F.col("_mid"), "inner"))
        with ExitStack() as copies:
            for other, on, how in steps:
                done = copies.pop_all()
                found = found.join(other, on, how).select(*cols)
                found = kept(found) if how == "inner" else copies.enter_context(kept_meanwhile(found))
                done.close()  # the copy before
        return found

    def build_after() -> DataFrame:
        """The first line of each key that is known and not stored asks for a unit, whatever its place; the others break a rule."""
        new = _keys(shipment_lines, existing, F.lit(True)).filter("_lines > 0 AND NOT _held")
        if shipments is not None:
            new = new.join(shipments.select(F.col("trackingID").alias("_tid")), F.col("trackingID") == F.col("_tid"), "left_semi")
        return _stock_left(materials, new.groupBy("Material_Id").agg(F.count(F.lit(1)).alias("_asked")))

    return Reservation(build_judged, build_lines, build_eligible, build_after)


# ------------------------------------------------------------------------- E04
class Intake:
    """E04 outputs, each built on first use."""

    def __init__(self, build_ok, build_rejected, build_after, build_audit):
        self._build_ok = build_ok
        self._build_rejected = build_rejected
        self._build_after = build_after
        self._build_audit = build_audit

    @cached_property
    def _ok(self) -> DataFrame:  # accepted requests with the stock of their material
        return self._build_ok()

    @cached_property
    def accepted(self) -> DataFrame:  # inserted purchase orders (PONo, PODate, PurcQty, Material_Id)
        return self._ok.select(F.col("p_po_no").alias("PONo"), F.col("p_po_date").alias("PODate"),
                               F.col("p_purchase_qty").cast("long").alias("PurcQty"), F.col("p_material_id").alias("Material_Id"))

    @cached_property
    def accepted_requests(self) -> DataFrame:  # the accepted requests in their input shape
        return self._ok.drop("_stock")

    @cached_property
    def rejected(self) -> DataFrame:  # request columns + error_code + error_message
        return self._build_rejected()

    @cached_property
    def materials_after(self) -> DataFrame:  # material_Id, quantity
        return self._build_after(self.accepted)

    @property
    def audit(self) -> DataFrame:  # PONo, Material_Id, updated_quantity (runs the ordered scan)
        return self._build_audit(self._ok)


REQUEST_ORDER: OrderSpec = (("arrival_order", False), ("arrival_line", False), ("arrival_part", False),
                            ("p_material_id", False), ("p_purchase_qty", False), ("p_po_date", False))


def process_purchase_orders(requests: DataFrame, materials: DataFrame, existing_orders: DataFrame,
                            order: OrderSpec = REQUEST_ORDER) -> Intake:
    """Purchase-order intake.

    Failure order: a missing material (-20002) first; then insert failures (-20003):
    NULL number, date or quantity, a number without the prefix or too wide, a number
    already taken (by an existing order, or by an earlier request of this batch). A
    request that failed does not use up its number. Accepted quantities are added to the
    material's stock; the audit carries the stock after each order, in arrival order.
    """
    cols, by = requests.columns, [c for c, _ in order]
    null_field = (F.col("p_po_no").isNull() | F.col("p_po_date").isNull() | F.col("p_purchase_qty").isNull())
    bad_number = ~F.col("p_po_no").startswith(PO_PREFIX) | (F.octet_length("p_po_no") > PO_NO_WIDTH)
    taken = existing_orders.filter(F.col("PONo").isNotNull()).select(F.col("PONo").alias("_taken")).distinct()
    # requests of one number that are equal in ``order`` are equal in all: any of them is the first
    alike = set(cols) <= {*by, "p_po_no"}
    numbered = cache(lambda: _numbered(requests))

    def build_ok() -> DataFrame:
        """The first fit request of each number comes out of the aggregate itself; its stock is looked up after that. The lookup of
        the material ends in a copy, so that its shuffles are gone when the numbers are grouped."""
        rows = requests if alike else numbered()
        fit = rows.filter(~null_field & ~bad_number).join(
            materials.select(F.col("material_Id").alias("_mid")), F.col("p_material_id") == F.col("_mid"), "left_semi")
        with kept_meanwhile(fit) as fit:
            groups = fit.groupBy(F.col("p_po_no").alias("_no"))
            if alike:  # the place has the whole row
                first = groups.agg(F.min(_place(order, False)).alias("_row")).select(
                    "_no", *[(F.col("_no") if c not in by else F.col(f"_row.c{by.index(c)}")).alias(c) for c in cols])
            else:
                first = groups.agg(F.min_by(F.struct(*cols), _place(order)).alias("_row")).select("_no", "_row.*")
            first = first.join(taken, F.col("_no") == F.col("_taken"), "left_anti")
            stock = materials.select(F.col("material_Id").alias("_mid"), F.col("quantity").alias("_stock"))
            return kept(first.join(stock, F.col("p_material_id") == F.col("_mid")).select(*cols, "_stock"))

    def build_rejected() -> DataFrame:
        req = _with_stock(numbered(), "p_material_id", materials)
        first_fail = (F.when(F.col("_mid").isNull(), F.lit("material"))
                      .when(null_field, F.lit("cannot insert NULL into PURCHASE_ORDER"))
                      .when(bad_number, F.lit("check constraint on PURCHASE_ORDER.PONo violated")))
        req = req.withColumn("_fail", first_fail)
        candidates = req.filter(F.col("_fail").isNull())
        candidates = (candidates.join(_first_of_key(candidates, ["p_po_no"], order), F.col("_id") == F.col("_first_id"), "left")
                      .join(taken, F.col("p_po_no") == F.col("_taken"), "left"))
        dup = F.col("_first_id").isNull() | F.col("_taken").isNotNull()
        dup_rows = candidates.filter(dup).select(*cols, F.lit("unique constraint on PURCHASE_ORDER.PONo violated")
                                                 .alias("_fail"))
        early = req.filter(F.col("_fail").isNotNull()).select(*cols, "_fail")
        failed = early.unionByName(dup_rows)
        return failed.select(
            *cols,
            F.when(F.col("_fail") == "material", F.lit(MATERIAL_NOT_FOUND)).otherwise(F.lit(UNEXPECTED_ERROR))
             .cast("int").alias("error_code"),
            F.when(F.col("_fail") == "material", F.lit(MATERIAL_NOT_FOUND_TEXT))
             .otherwise(F.concat(F.lit(UNEXPECTED_ERROR_TEXT), F.col("_fail"))).alias("error_message"))

    def build_after(accepted: DataFrame) -> DataFrame:
        added = accepted.groupBy("Material_Id").agg(F.sum("PurcQty").alias("_added"))
        return (materials.join(added, materials["material_Id"] == added["Material_Id"], "left")
                .select(materials["material_Id"], (F.col("quantity") + F.coalesce(F.col("_added"), F.lit(0)))
                        .cast("long").alias("quantity")))

    def build_audit(ok: DataFrame) -> DataFrame:
        running = scan_within(ok, ["p_material_id"], order, "p_purchase_qty")
        return running.select(F.col("p_po_no").alias("PONo"), F.col("p_material_id").alias("Material_Id"),
                              (F.col("_stock") + F.col("_run")).cast("long").alias("updated_quantity"))

    return Intake(build_ok, build_rejected, build_after, build_audit)
