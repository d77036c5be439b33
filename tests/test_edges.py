"""Edge tables, one per semantic bullet of the reports and row-event jobs."""

import datetime as dt
from decimal import Decimal

from larder.functions.exprs import add_months_keep_end, months_back_literal
from larder.operators import events, reports

D = Decimal


def test_q02_gap_year_and_zero_previous(spark):
    orders = spark.createDataFrame(
        [("FA1", dt.date(2000, 5, 1), D("100.00")), ("FA1", dt.date(2002, 1, 1), D("150.00")),
         ("FA2", dt.date(2000, 1, 1), D("0.00")), ("FA2", dt.date(2001, 1, 1), D("-5.00"))],
        "franchise_id string, orderdate date, totalamount decimal(18,2)")
    rows = {(r.franchise_id, r.year): r for r in reports.yearly_revenue_growth(orders).collect()}
    assert rows[("FA1", 2000)].growth_percentage == "0.00%"
    assert rows[("FA1", 2002)].previous_year_revenue == D("100.00")  # previous present year
    assert rows[("FA1", 2002)].growth_percentage == "50.00%"
    assert rows[("FA2", 2001)].growth_percentage == "0.00%"  # previous revenue zero


def test_q03_null_inventory_ranks_first(spark):
    agreements = spark.createDataFrame(
        [("FA1", dt.date(2000, 1, 1), dt.date(2001, 1, 1)), ("FA2", dt.date(2000, 1, 1), dt.date(2003, 1, 1))],
        "franchise_id string, term_start_date date, term_end_date date")
    fr = spark.createDataFrame([("FA1", "FO1"), ("FA2", "FO1")], "franchise_id string, owner_id string")
    owners = spark.createDataFrame([("FO1", "Doe", "Jo")], "owner_id string, lname string, fname string")
    inv = spark.createDataFrame([("FINV1", "FA1")], "inv_Id string, franchise_id string")
    out = {r.franchise_id: r for r in reports.agreement_inventory_ranking(agreements, fr, owners, inv).collect()}
    assert out["FA2"].total_inventory is None and out["FA2"].inventory_rank == 1
    assert out["FA2"].agreement_rank == 1 and out["FA1"].agreement_years == D("1.00")
    assert out["FA1"].franchise_owner == "Doe, Jo"


def test_q04_band_bounds_and_null(spark):
    fr = spark.createDataFrame([("FA1",)], "franchise_id string")
    emp = spark.createDataFrame([("EMP1", "FA1")], "employee_ID string, franchise_ID string")
    shifts = spark.createDataFrame(
        [("EMP1", D("3.99")), ("EMP1", D("4.00")), ("EMP1", D("8.00")), ("EMP1", D("8.01")), ("EMP1", None)],
        "Employee_ID string, shiftDuration decimal(18,2)")
    rows = reports.shift_pattern_cube(fr, emp, shifts).collect()
    per = {r.shift_type: r.total_shifts for r in rows if r.franchise_id == "FA1"}
    assert per == {"Short Shift": 1, "Regular Shift": 2, "Long Shift": 2, None: 5}
    grand = [r for r in rows if r.franchise_id is None and r.shift_type is None][0]
    assert grand.total_shifts == 5 and grand.total_shift_hours == D("24.00")


def test_e01_coupon_cases(spark):
    coupons = spark.createDataFrame([("C1", D("100.00"), dt.date(1999, 1, 1), D("30.00")),
                                     ("C2", D("0.00"), dt.date(2005, 1, 1), D("500.00"))],
                                    "coupon_code string, minPurchase_amt decimal(18,2), coupExpiry date, "
                                    "coupDiscount decimal(18,2)")
    req = spark.createDataFrame([("O1", D("100.00"), "C1"), ("O2", D("99.99"), "C1"), ("O3", D("50.00"), None),
                                 ("O4", D("50.00"), "NOPE"), ("O5", D("50.00"), "C2")],
                                "order_id string, subtotal decimal(18,2), coupon_code string")
    at_midnight = {r.order_id: r for r in events.apply_coupon_totals(req, coupons, dt.datetime(1999, 1, 1)).collect()}
    assert at_midnight["O1"].coupon_status == "applied" and at_midnight["O1"].totalamount == D("70.00")
    assert at_midnight["O2"].coupon_status == "not_applied" and at_midnight["O2"].totalamount == D("99.99")
    assert at_midnight["O3"].coupon_status == "no_coupon"
    assert at_midnight["O4"].coupon_status == "unknown_coupon" and not at_midnight["O4"].accepted
    assert at_midnight["O5"].coupon_status == "negative_total" and at_midnight["O5"].totalamount is None
    later = {r.order_id: r for r in events.apply_coupon_totals(req, coupons, dt.datetime(1999, 1, 1, 0, 0, 1)).collect()}
    assert later["O1"].coupon_status == "not_applied"  # expired from the first second after midnight


def test_e02_null_level_is_high(spark):
    inv = spark.createDataFrame([("RM1", 5, None), ("RM2", 15, 15), ("RM3", 30, 15), ("RM4", 31, 15)],
                                "Material_Id string, inv_qoh long, inv_reorder_level long")
    got = {r.Material_Id: r.inv_stock_status for r in events.stock_status(inv).collect()}
    assert got == {"RM1": "High", "RM2": "Low", "RM3": "Decent", "RM4": "High"}


def test_e03_stock_zero_duplicates_unknown(spark):
    mats = spark.createDataFrame([("RM1", 2), ("RM2", 0)], "material_Id string, quantity long")
    lines = spark.createDataFrame([("RM1", "S1", 1), ("RM1", "S2", 2), ("RM1", "S3", 3), ("RM1", "S1", 4),
                                   ("RM2", "S4", 5), ("RM9", "S5", 6)],
                                  "Material_Id string, trackingID string, arrival_seq long")
    res = events.reserve_stock(lines, mats)
    got = {r.arrival_seq: (r.status, r.reason) for r in res.lines.collect()}
    assert got[1] == ("accepted", None) and got[2] == ("accepted", None)
    assert got[3] == ("rejected", "insufficient_stock")
    assert got[4] == ("rejected", "insufficient_stock")  # the stock test comes before the key
    assert got[5] == ("rejected", "insufficient_stock")
    assert got[6] == ("rejected", "unknown_material")
    after = {r.material_Id: r.quantity for r in res.materials_after.collect()}
    assert after == {"RM1": 0, "RM2": 0}


def test_e03_key_rules_after_the_stock_test(spark):
    mats = spark.createDataFrame([("RM1", 3), ("RM2", 9)], "material_Id string, quantity long")
    lines = spark.createDataFrame(
        [("RM1", "S1", 1), ("RM1", "S1", 2), ("RM1", None, 3), ("RM1", "S0", 4), ("RM1", "S2", 5), ("RM1", "OLD", 6),
         ("RM1", "S3", 7), ("RM1", "S3", 8), ("RM1", None, 9), (None, "S1", 10), ("RM2", "S1", 11), ("RM2", "S1", 11)],
        "Material_Id string, trackingID string, arrival_seq long")
    ships = spark.createDataFrame([("S1",), ("S2",), ("S3",), ("OLD",), (None,)], "trackingID string")
    old = spark.createDataFrame([("RM1", "OLD")], "Material_Id string, trackingID string")
    res = events.reserve_stock(lines, mats, shipments=ships, existing=old)
    got = sorted((r.arrival_seq, r.status, r.error_code, r.reason) for r in res.lines.collect())
    bad = lambda at, why, code=None: (at, "rejected", code, why)
    ok = lambda at: (at, "accepted", None, None)
    assert [g for g in got if g[0] < 11] == [
        ok(1), bad(2, "duplicate_line"), bad(3, "missing_key"), bad(4, "unknown_shipment"), ok(5), bad(6, "duplicate_line"), ok(7),
        bad(8, "insufficient_stock", -20005), bad(9, "insufficient_stock", -20005), bad(10, "unknown_material")]
    assert sorted(g[1:] for g in got if g[0] == 11) == [("accepted", None, None), ("rejected", None, "duplicate_line")]
    assert {r.material_Id: r.quantity for r in res.materials_after.collect()} == {"RM1": 0, "RM2": 8}


def test_arrival_order_beyond_any_slot(spark):
    """Part keys over a million and order keys over 10**10: a plain fold by (order, kind, line, part)."""
    big = 10**10
    lines = [("RM1", f"S{k}", big + k) for k in range(6)]
    recs = [("PO1", "RM1", 2, dt.date(2001, 1, 1), big + 2, 1, 3_000_001), ("PO2", "RM1", 5, dt.date(2001, 1, 1), big + 4, 7, 9)]
    mats = spark.createDataFrame([("RM1", 1)], "material_Id string, quantity long")
    ev = events.ledger_events(
        spark.createDataFrame(lines, "Material_Id string, trackingID string, arrival_seq long"),
        spark.createDataFrame(recs, "p_po_no string, p_material_id string, p_purchase_qty long, p_po_date date, "
                                    "arrival_order long, arrival_line long, arrival_part long"))
    got = {r.ref: (r.accepted, r.balance) for r in events.stock_ledger(ev, mats).collect()}
    assert got == {"S0": (True, 0), "S1": (False, 0), "PO1": (True, 2), "S2": (True, 1), "S3": (True, 0), "PO2": (True, 5),
                   "S4": (True, 4), "S5": (True, 3)}


def test_month_ends_go_back_to_month_ends(spark):
    assert months_back_literal(dt.datetime(2001, 4, 30), 6) == dt.datetime(2000, 10, 31)
    assert months_back_literal(dt.datetime(2001, 8, 30), 6) == dt.datetime(2001, 2, 28)
    assert months_back_literal(dt.datetime(2001, 8, 1, 5), 6) == dt.datetime(2001, 2, 1, 5)
    days = spark.createDataFrame([(dt.date(2001, 4, 30),), (dt.date(2001, 8, 30),), (None,)], "d date")
    assert [r[0] for r in days.select(add_months_keep_end("d", -6)).collect()] == [
        dt.date(2000, 10, 31), dt.date(2001, 2, 28), None]


def test_e04_failed_material_keeps_number(spark):
    mats = spark.createDataFrame([("RM1", 10)], "material_Id string, quantity long")
    existing = spark.createDataFrame([("PO9",)], "PONo string")
    req = spark.createDataFrame(
        [("PO1", "RM404", 5, dt.date(2001, 1, 1), 1, 1, 1), ("PO1", "RM1", 5, dt.date(2001, 1, 1), 2, 1, 1),
         ("PO1", "RM1", 7, dt.date(2001, 1, 1), 3, 1, 1), ("PO9", "RM1", 1, dt.date(2001, 1, 1), 4, 1, 1),
         ("XX2", "RM1", 1, dt.date(2001, 1, 1), 5, 1, 1), ("PO3", "RM1", -4, dt.date(2001, 1, 1), 6, 1, 1)],
        "p_po_no string, p_material_id string, p_purchase_qty long, p_po_date date, arrival_order long, "
        "arrival_line long, arrival_part long")
    res = events.process_purchase_orders(req, mats, existing)
    assert sorted((r.PONo, r.PurcQty) for r in res.accepted.collect()) == [("PO1", 5), ("PO3", -4)]
    codes = {r.arrival_order: r.error_code for r in res.rejected.collect()}
    assert codes == {1: -20002, 3: -20003, 4: -20003, 5: -20003}
    assert {r.material_Id: r.quantity for r in res.materials_after.collect()} == {"RM1": 11}
    assert sorted(r.updated_quantity for r in res.audit.collect()) == [11, 15]
