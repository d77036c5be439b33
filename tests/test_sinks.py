"""Sources, sinks, rules and streams on hand-made rows: what round one got wrong."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from larder.catalogue import CATALOGUE
from larder.operators import rules
from larder.session import scratch_path
from larder.sources import io
from larder.streaming import jobs


def test_csv_by_name_and_fractions_refused(spark, tmp_path):
    (tmp_path / "m.csv").write_text("quantity,cold_storage,materialName,material_Id,typeofMaterial\n"
                                    "5,Y,flour,RM1,dry\n1.9,N,oil,RM2,wet\nx,N,salt,RM3,dry\n")
    good, refused = io.read_table(spark, "raw_materials", str(tmp_path / "m.csv"), fmt="csv", strict=False)
    assert [(r.material_Id, r.materialName, r.quantity) for r in good.collect()] == [("RM1", "flour", 5)]
    assert sorted((r.material_Id, r.quantity) for r in refused.collect()) == [("RM2", "1.9"), ("RM3", "x")]
    with pytest.raises(Exception, match="does not fit"):
        io.read_table(spark, "raw_materials", str(tmp_path / "m.csv"), fmt="csv").collect()
    (tmp_path / "n.csv").write_text("material_Id\nRM1\n")
    with pytest.raises(ValueError, match="missing columns"):
        io.read_table(spark, "raw_materials", str(tmp_path / "n.csv"), fmt="csv")


def test_ragged_and_broken_lines_have_reasons(spark, tmp_path):
    src = tmp_path / "csv"
    src.mkdir()
    (src / "a.csv").write_text("PurcQty,PONo,PODate,Material_Id\n5,PO1,2001-02-03,RM1\n5,PO2,2001-02-03\n5,PO3,2001-02-03,RM1,9\n"
                               '"6","PO,4",2001-02-03,""\nx,PO5,2001-13-01,\n99999999999999999999,PO6,,RM1\n,,,\n1e2,PO7,2001-02-03,RM1\nPO8\n')
    good, refused = io.read_table(spark, "purchase_order", str(src), "csv", strict=False)
    assert sorted(((r.PONo, r.PurcQty) for r in good.collect()), key=str) == [("PO,4", 6), ("PO1", 5), ("PO7", 100), (None, None)]
    assert good.count() == 4 and refused.count() == 5  # also when no column is asked for
    got = {r.PONo or r.line: ([tuple(x) for x in r.reasons], r.line) for r in refused.collect()}
    assert got == {"PO2": ([(None, "fields")], "5,PO2,2001-02-03"), "PO3": ([(None, "fields")], "5,PO3,2001-02-03,RM1,9"),
                   "PO5": ([("PODate", "not_a_date"), ("PurcQty", "not_a_number")], None),
                   "PO6": ([("PurcQty", "out_of_range")], None), "PO8": ([(None, "fields")], "PO8")}
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        io.read_table(spark, "purchase_order", str(src), "csv").collect()
    (src / "b.csv").write_text("PONo,PurcQty,PODate,Material_Id\nPO9,1,2001-02-03,RM1\n")  # another order of columns
    with pytest.raises(Exception, match="header"):
        io.read_table(spark, "purchase_order", str(src), "csv", strict=False)[0].collect()


def test_text_only_tables_json_and_files_without_header(spark, tmp_path):
    (tmp_path / "m.txt").write_text("EMP1\nEMP2,9\nNULL\n")
    good, refused = io.read_table(spark, "managers", str(tmp_path / "m.txt"), "csv", strict=False, columns=["employee_ID"],
                                  options={"nullValue": "NULL"})
    assert (good.count(), refused.count()) == (2, 1) and sorted(map(str, (r[0] for r in good.collect()))) == ["EMP1", "None"]
    (tmp_path / "o.json").write_text('{"PONo": "PO1", "podate": "2001-02-03", "PurcQty": 5, "Material_Id": null}\n{"PONo": \n'
                                     '{"PONo": "PO2", "podate": "2001-02-03", "PurcQty": 5.5, "Material_Id": "RM1"}\n')
    good, refused = io.read_table(spark, "purchase_order", str(tmp_path / "o.json"), "json", strict=False)
    assert [(r.PONo, r.PurcQty, r.Material_Id) for r in good.collect()] == [("PO1", 5, None)]
    assert sorted((r.PONo or "", r.line or "", [tuple(x) for x in r.reasons]) for r in refused.collect()) == [
        ("", '{"PONo": ', [(None, "fields")]), ("PO2", "", [("PurcQty", "too_fine")])]
    spark.createDataFrame([(1.9,), (2.0,)], "warehouse_id double").selectExpr(
        "'WA1' warehouse_id", "'n' warehouse_name", "warehouse_id zip", "'s' state", "'c' city", "1 capacity").write.parquet(str(tmp_path / "w"))
    good, refused = io.read_table(spark, "warehouse", str(tmp_path / "w"), strict=False)
    assert [r.zip for r in good.collect()] == [2] and [[tuple(x) for x in r.reasons] for r in refused.collect()] == [[("zip", "too_fine")]]


def test_publish_survives_a_crash_before_its_pointer(spark):
    root = scratch_path(spark, "crash")
    one, two = (spark.createDataFrame([(i,)], "x int") for i in (1, 2))
    assert io.next_version(spark, root) == 0
    io.publish_version(one, root, 0)
    two.write.parquet(f"{root}/v000000001-left-by-a-crash/table")  # data without a pointer
    assert io.read_current(spark, root).first().x == 1 and io.next_version(spark, root) == 1
    io.publish_version(two, root, 1)
    assert io.read_current(spark, root).first().x == 2
    io.publish_tables({"a": one, "b": two}, root, 2)
    assert (io.read_current(spark, root, "a").first().x, io.read_current(spark, root, "b").first().x) == (1, 2)
    with pytest.raises(FileNotFoundError):
        io.read_current(spark, root + "-none")


def orders(spark, rows):
    return spark.createDataFrame(rows, "at long, PONo string, PODate date, PurcQty long, Material_Id string")


def test_quarantine_accepts_the_valid_row_of_a_key(spark):
    d = dt.date(2001, 1, 1)
    batch = orders(spark, [(1, "PO1", d, 5, "NOPE"), (2, "PO1", d, 6, "RM1"), (3, "PO1", d, 7, "RM1"), (4, "PO9", d, 1, "RM1"),
                           (5, "", d, 1, "RM1"), (6, "XX", d, 1, "RM1"), (7, "PO2", None, 1, None), (8, "PO3", d, 1, "")])
    mats = spark.createDataFrame([("RM1",), (None,)], "material_Id string")
    old = spark.createDataFrame([("PO9",), (None,)], "PONo string")
    split = rules.quarantine(batch, CATALOGUE["purchase_order"], {"raw_materials": mats}, existing=old, order=["at"])
    assert sorted(r["at"] for r in split.accepted.collect()) == [2, 8]
    assert {r["at"]: r["reasons"] for r in split.rejected.collect()} == {
        1: "foreign_key(Material_Id)", 3: "primary_key(PONo)", 4: "key_exists(PONo)", 5: "not_null(PONo)",
        6: "prefix(PONo)", 7: "not_null(PODate)"}


def test_blank_text_is_null_in_every_rule(spark):
    df = spark.createDataFrame([("",), (None,), ("Y",), ("Q",), ("",)], "c string")
    of = lambda found: sorted(r.value or "-" for r in found.collect())
    assert of(rules.check_in(df, "t", "c", ["Y", "N"])) == ["Q"]
    assert of(rules.check_prefix(df, "t", "c", "Y")) == ["Q"]
    assert of(rules.check_unique(df, "t", "c")) == []
    assert of(rules.check_not_null(df, "t", ["c"])) == ["-", "-", "-"]
    assert of(rules.check_foreign_key(df, "t", "c", spark.createDataFrame([("Y",), ("",)], "p string"), "p")) == ["Q"]
    assert of(rules.check_max_length(df, "t", "c", 0)) == ["Q", "Y"]
    two = spark.createDataFrame([("a", None), (None, "a"), ("a", ""), ("b", "c"), ("b", "c")], "x string, y string")
    found = rules.check_primary_key(two, "t", ["x", "y"]).collect()
    assert sorted(r.row_key for r in found) == ["NULL|a", "a|NULL", "a|NULL", "b|c"]


def test_report_counts_are_those_of_the_finders(spark):
    t = CATALOGUE["purchase_order"]
    d = dt.date(2001, 1, 1)
    df = orders(spark, [(1, "PO1", d, 5, "NOPE"), (2, "PO1", d, 6, "RM1"), (3, None, d, 7, "RM1"), (4, "XX", None, 1, "")]).drop("at")
    tables = {"purchase_order": df, "raw_materials": spark.createDataFrame([("RM1", "a", "b", "Y", 3)], (
        "material_Id string, materialName string, typeofMaterial string, cold_storage string, quantity long"))}
    report = {(r.table_name, r.rule): r.violations for r in rules.constraint_report(tables).collect()}
    want = {}
    for r in rules.table_violations(df, t, tables).collect():
        want[r.table_name, r.rule] = want.get((r.table_name, r.rule), 0) + 1
    assert {k: v for k, v in report.items() if k[0] == "purchase_order"} == want
    assert "foreign_key(Material_Id)" in rules.unchecked_rules(df, t, {}) and not rules.unchecked_rules(df, t, tables)


def test_stock_status_stream_keeps_inventories_and_null_keys(spark):
    root, ckpt, src = (scratch_path(spark, f"e07-{k}") for k in ("out", "ckpt", "in"))
    kind = "Material_Id string, inv_Id string, inv_qoh long, inv_reorder_level long"
    batches = [[("RM1", "A", 5, 10), ("RM1", "B", 50, 10), (None, "A", 1, 1), (None, "A", 9, 1), ("RM2", "A", 8, None)],
               [("RM1", "A", 3, 10), ("RM1", "A", 30, 10), (None, "A", 9, 1)], [("RM1", "A", 4, 10), (None, "A", 9, 1)]]
    for rows in batches:  # stopped and started again between them: each goes on from the checkpoint
        df = spark.createDataFrame(rows, kind)
        df.coalesce(1).write.mode("append").parquet(src)
        jobs.run_stock_status_stream(jobs.stream_files(spark, src, df), root, ckpt)
    of = lambda df, *more: sorted(map(str, ((r.Material_Id, r.inv_Id, r.inv_qoh, r.inv_stock_status, *(r[c] for c in more))
                                            for r in df.collect())))
    assert of(jobs.read_stock_status(spark, ckpt)) == sorted(map(str, [
        ("RM1", "A", 4, "Low"), ("RM1", "B", 50, "High"), ("RM2", "A", 8, "High"), (None, "A", 1, "Low"), *[(None, "A", 9, "High")] * 3]))
    # each micro-batch hands on what it changed, and no more
    changes = spark.read.parquet(root)
    assert of(changes.filter("epoch = 1"), "copies") == sorted(map(str, [("RM1", "A", 30, "High", 1), (None, "A", 9, "High", 2)]))
    assert of(changes.filter("epoch = 2"), "copies") == sorted(map(str, [("RM1", "A", 4, "Low", 1), (None, "A", 9, "High", 3)]))


def test_stock_status_stream_by_a_column_and_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(jobs, "COPIES", 4)
    root, ckpt, src = (scratch_path(spark, f"e07-by-{k}") for k in ("out", "ckpt", "in"))
    rows = spark.createDataFrame([("RM1", "A", 90, 10, 1), ("RM1", "A", 5, 10, 2), ("RM1", "A", 7, 10, 2)] + [("RM1", None, 1, 1, 0)] * 13, (
        "Material_Id string, inv_Id string, inv_qoh long, inv_reorder_level long, seen long"))
    rows.coalesce(1).write.parquet(src)
    jobs.run_stock_status_stream(jobs.stream_files(spark, src, rows), root, ckpt, order=["seen"])
    got = sorted((r.inv_Id or "", r.inv_qoh, r.seen) for r in jobs.read_stock_status(spark, ckpt).collect())
    assert got == [("", 1, 0)] * 13 + [("A", 7, 2)]


def test_reservation_stream_knows_duplicates_and_shipments(spark):
    sink, ckpt, src = (scratch_path(spark, f"e08-{k}") for k in ("out", "ckpt", "in"))
    mats = spark.createDataFrame([("RM1", 2), ("RM2", 9)], "material_Id string, quantity long")
    ships = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "trackingID string")
    kind = "Material_Id string, trackingID string, arrival_seq long"
    batches = [[("RM1", "S1", 1), ("RM1", "S1", 2), ("RM1", "S9", 3), ("RM2", None, 4), (None, "S1", 5), (None, None, 5)],
               [("RM1", "S1", 6), ("RM1", "S2", 7), ("RM1", "S3", 8), ("RM7", "S1", 9), ("RM2", "S3", 10)]]
    for rows in batches:  # stopped and started again between the two
        df = spark.createDataFrame(rows, kind)
        df.coalesce(1).write.mode("append").parquet(src)
        jobs.run_reservation_stream(jobs.stream_files(spark, src, df), mats, sink, ckpt, shipments=ships)
    got = sorted((r.arrival_seq, r.reason, r.error_code) for r in jobs.read_reservations(spark, sink).collect())
    assert [(a, r) for a, r, _ in got] == [
        (1, None), (2, "duplicate_line"), (3, "unknown_shipment"), (4, "missing_key"), (5, "unknown_material"),
        (5, "unknown_material"), (6, "duplicate_line"), (7, None), (8, "insufficient_stock"), (9, "unknown_material"), (10, None)]
    assert [c for _, _, c in got if c] == [-20005]


def test_reservation_batch_that_runs_again_changes_nothing(spark):
    root = scratch_path(spark, "e08-again")
    mats = spark.createDataFrame([("RM1", 3), ("RM2", 0)], "material_Id string, quantity long")
    kind = "Material_Id string, trackingID string, arrival_seq long"
    change = jobs.reservation_changes(root, mats, (("arrival_seq", False), ("trackingID", False)), None,
                                      spark.createDataFrame([("RM1", "OLD")], "Material_Id string, trackingID string"))
    first = spark.createDataFrame([("RM1", f"S{i % 4}", i) for i in range(6)] + [("RM1", "OLD", 9)], kind)
    second = spark.createDataFrame([("RM1", "S0", 20), ("RM1", "S9", 21), ("RM2", "S9", 22)], kind)
    change(first.where("arrival_seq < 2 OR arrival_seq = 9"), 0)
    for _ in range(2):  # the second run is a replay after a crash
        change(second, 1)
    got = sorted((r.arrival_seq, r.reason) for r in jobs.read_reservations(spark, root).collect())
    assert got == [(0, None), (1, None), (9, "duplicate_line"), (20, "duplicate_line"), (21, None), (22, "insufficient_stock")]
    assert {r.material_Id: r.quantity for r in spark.read.parquet(f"{root}/stock/epoch=1").collect()} == {"RM1": 0, "RM2": 0}


def test_coupon_runs_out_while_the_stream_runs(spark):
    """The same coupon applies in the first micro-batch and not in the second: by each request's time, and by the clock."""
    day = dt.date.today()
    coupons = spark.createDataFrame([("C1", D(10), day, D(5)), ("C2", D(10), day + dt.timedelta(days=2), D(5))],
                                    "coupon_code string, minPurchase_amt decimal(18,2), coupExpiry date, coupDiscount decimal(18,2)")
    kind = "order_id string, subtotal decimal(18,2), coupon_code string, at timestamp"
    midnight = dt.datetime.combine(day, dt.time())
    times = [midnight, midnight + dt.timedelta(seconds=1)]
    for name, clock, want in (("asked", F.col("at"), {"A0": 15, "A1": 20, "B0": 15, "B1": 15, "N0": 20, "N1": 20}),
                              ("now", None, {"A0": 20, "A1": 20, "B0": 15, "B1": 15, "N0": 20, "N1": 20})):
        src, out, ckpt = (scratch_path(spark, f"e06-{name}-{k}") for k in ("in", "out", "ckpt"))
        for i, at in enumerate(times):  # a micro-batch each; the stream goes on from its checkpoint
            rows = spark.createDataFrame([(f"A{i}", D(20), "C1", at), (f"B{i}", D(20), "C2", at), (f"N{i}", D(20), None, None)], kind)
            rows.coalesce(1).write.mode("append").parquet(src)
            jobs.run_to_sink(jobs.coupon_totals_stream(jobs.stream_files(spark, src, rows), coupons, clock), out, ckpt)
        assert {r.order_id: int(r.totalamount) for r in spark.read.parquet(out).collect()} == want, name
