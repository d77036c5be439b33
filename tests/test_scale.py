"""Jobs whose cost must grow no faster than their input: each step is run once, and results stay those of the plain rules."""

import datetime as dt

from pyspark.sql import functions as F

from larder.catalogue import CATALOGUE
from larder.operators import events, rules
from larder.plans import registry
from larder.sources import io
from larder.streaming import jobs

LINES = "Material_Id string, trackingID string, arrival_seq long, line long"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def shipment_case(spark):
    rows = [("RM1", "S1", 1, 1), ("RM1", "S2", 2, 1), ("RM1", "S1", 3, 1), ("RM1", "S3", 4, 1), ("RM1", "S4", 5, 1), ("RM2", "S1", 1, 2),
            ("RM2", "S9", 2, 2), ("RM2", None, 3, 2), ("RM2", "S5", 4, 2), ("RMx", "S1", 1, 3), (None, "S1", 2, 3), (None, None, 3, 3)]
    lines = spark.createDataFrame(rows, LINES)
    materials = spark.createDataFrame([("RM1", 2), ("RM2", 5), (None, 7)], "material_Id string, quantity long")
    shipments = spark.createDataFrame([(f"S{i}",) for i in range(1, 6)] + [(None,)], "trackingID string")
    stored = spark.createDataFrame([("RM2", "S5"), ("RM2", "S7"), (None, "S1")], "Material_Id string, trackingID string")
    want = {("RM1", "S1", 1): "ok", ("RM1", "S2", 2): "ok", ("RM1", "S1", 3): "insufficient_stock", ("RM1", "S3", 4): "insufficient_stock",
            ("RM1", "S4", 5): "insufficient_stock", ("RM2", "S1", 1): "ok", ("RM2", "S9", 2): "unknown_shipment",
            ("RM2", None, 3): "missing_key", ("RM2", "S5", 4): "duplicate_line", ("RMx", "S1", 1): "unknown_material",
            (None, "S1", 2): "unknown_material", (None, None, 3): "unknown_material"}
    return lines, materials, shipments, stored, want


def verdicts(df):
    return {(r.Material_Id, r.trackingID, r.arrival_seq): "ok" if r.status == "accepted" else r.reason for r in df.collect()}


def test_f1_micro_batches_do_not_grow_with_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "FILE_ROWS", 1)
    lines, materials, shipments, stored, want = shipment_case(spark)
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    files = registry._slices(lines, src, "arrival_seq")
    stream = jobs.stream_files(spark, src, lines, files)
    jobs.run_reservation_stream(stream, materials, out, ckpt, registry.LINES_BY, shipments, stored)
    assert len(list((tmp_path / "out" / "lines").glob("epoch=*"))) <= registry.BATCHES
    assert verdicts(jobs.read_reservations(spark, out)) == want


def test_f4_f5_lines_are_judged_once(spark):
    lines, materials, shipments, stored, want = shipment_case(spark)
    found = events.reserve_stock(lines, materials, registry.LINES_BY, shipments, stored)
    assert verdicts(found.lines) == want
    assert plan(found.lines).count("Join ") == 1  # the carry of the scan: no second run of the lookups
    assert {(r.material_Id, r.quantity) for r in found.materials_after.collect()} == {("RM1", 0), ("RM2", 4), (None, 7)}


def test_f6_ledger_is_kept_by_columns(spark):
    schema = "Material_Id string, kind string, quantity long, arrival_key long, kind_rank int, line long, part long, ref string"
    rows = [("RM1", "reservation", 1, 1, 1, 0, 0, "a"), ("RM1", "reservation", 1, 2, 1, 0, 0, "b"), ("RM1", "receipt", 3, 3, 0, 0, 0, "p"),
            ("RM1", "reservation", 1, 4, 1, 0, 0, "b"), ("RM1", "reservation", 1, 5, 1, 0, 0, "a")]
    ledger = events.stock_ledger(spark.createDataFrame(rows, schema), spark.createDataFrame([("RM1", 1)], "material_Id string, quantity long"))
    got = {(r.ref, r.arrival_key): (r.accepted, r.balance) for r in ledger.collect()}
    assert got == {("a", 1): (True, 0), ("b", 2): (False, 0), ("p", 3): (True, 3), ("b", 4): (True, 2), ("a", 5): (False, 2)}
    assert "LogicalRDD" not in plan(ledger)


def test_f7_intake_is_judged_once_for_both_inserts(spark, tmp_path, monkeypatch):
    day = dt.date(1998, 1, 2)
    spark.createDataFrame([(i, f"p{i}", "T", 5) for i in range(1, 7)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(
        str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, 1, 1, 1, 3.0, day), (1, 2, 1, 2, 4.0, day), (2, 3, 1, 1, 5.0, day), (3, 6, 1, 1, 6.0, day), (4, 2, 1, 1, 7.0, None)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate date").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    seen, insert = [], io.insert_rows
    monkeypatch.setattr(io, "insert_rows", lambda batch, *more: (seen.append(plan(batch)), insert(batch, *more))[1])
    rows = registry.queries()["s02_append"](spark, str(tmp_path)).collect()
    assert len(seen) == 2 and not any("Join " in p or "Aggregate " in p for p in seen)
    assert sorted((r.PONo, r.PurcQty, r.Material_Id) for r in rows if "_" not in r.PONo) == [("PO1", 3, "RM2"), ("PO2", 5, "RM6")]
    assert sum("_" in r.PONo for r in rows) == 4  # the stored ones


def test_f7_first_request_of_a_number_is_accepted(spark):
    schema = "p_po_no string, p_material_id string, p_purchase_qty long, p_po_date date, arrival_order long, arrival_line long, arrival_part long"
    day = dt.date(2000, 1, 1)
    rows = [("PO1", "none", 1, day, 1, 1, 1), ("PO1", "RM1", 2, day, 1, 2, 1), ("PO1", "RM1", 3, day, 1, 3, 1), ("PO2", "RM1", 4, day, 2, 1, 1),
            ("X3", "RM1", 5, day, 3, 1, 1), (None, "RM1", 6, day, 4, 1, 1), ("PO5", None, 7, day, 5, 1, 1), ("PO6", "RM1", 8, day, None, 1, 1),
            ("PO6", "RM1", 9, day, 6, 1, 1), ("PO6", "RM1", 9, day, 6, 1, 1)]
    found = events.process_purchase_orders(spark.createDataFrame(rows, schema), spark.createDataFrame([("RM1", 10)], "material_Id string, quantity long"),
                                           spark.createDataFrame([("PO2",), (None,)], "PONo string"))
    assert sorted((r.PONo, r.PurcQty) for r in found.accepted.collect()) == [("PO1", 2), ("PO6", 9)]
    assert found.rejected.count() == 8
    assert sorted((r.PONo, r.updated_quantity) for r in found.audit.collect()) == [("PO1", 12), ("PO6", 21)]
    assert plan(found.accepted).count("Join ") <= 3  # known material, taken number, stock: no join back by row


def test_f2_report_runs_no_lambda_over_each_row(spark):
    stored = spark.createDataFrame([("PO1", None, 5, "RM1"), ("PO1", dt.date(2000, 1, 1), 5, "RM9"), ("X2", dt.date(2000, 1, 1), None, None),
                                    ("", dt.date(2000, 1, 1), 1, "RM1")], "PONo string, PODate date, PurcQty long, Material_Id string")
    materials = spark.createDataFrame([("RM1", "a", "b", "Y", 1), ("RM1", "a", "b", "?", -1), (None, "a", "b", "N", 2)],
                                      "material_Id string, materialName string, typeofMaterial string, cold_storage string, quantity long")
    tables = {"purchase_order": stored, "raw_materials": materials}
    report = rules.constraint_report(tables)
    assert "lambda" not in plan(report)
    found = None
    for name, df in tables.items():
        rows = rules.table_violations(df, CATALOGUE[name], tables)
        found = rows if found is None else found.unionByName(rows)
    want = {(r.table_name, r.rule): r["count"] for r in found.groupBy("table_name", "rule").count().collect()}
    # the report counts repeated keys once a key, as the finder does
    assert {(r.table_name, r.rule): r.violations for r in report.where("rule <> 'unchecked'").collect()} == want


def test_f3_file_is_read_once_for_taken_and_refused_rows(spark, tmp_path):
    columns = [c.name for c in CATALOGUE["raw_materials"].columns]
    given = {"material_Id": ["RM1", "RM2", "RM3", "RM4"], "quantity": ["1", "1.5", "x", "NULL"]}
    lines = [",".join(given[c][i] if c in given else "a" for c in columns) for i in range(4)] + ["RM5", ",".join(["a"] * (len(columns) + 1))]
    (tmp_path / "file.csv").write_text("\n".join(lines) + "\n")
    args = (str(tmp_path / "file.csv"), "csv")
    judged = io.judge_table(spark, "raw_materials", *args, columns, {"nullValue": "NULL"})
    assert plan(judged).count("Relation [") == 1
    typed, refused = io.read_table(spark, "raw_materials", *args, strict=False, columns=columns, options={"nullValue": "NULL"})
    assert sorted(judged.where("reasons IS NULL").drop("reasons").collect()) == sorted(typed.collect())
    why = judged.where("reasons IS NOT NULL").select(F.explode("reasons").alias("x")).select("x.*")
    assert sorted(map(str, why.collect())) == sorted(map(str, refused.select(F.explode("reasons").alias("x")).select("x.*").collect()))
    assert typed.count() == 2 and refused.count() == 4


def test_f5_stock_after_lines_needs_no_order(spark, monkeypatch):
    """The stock left is that of the judged lines, but no line is copied, sorted or scanned for it; materials, stored keys and
    shipments that come twice count as they do there."""
    lines, materials, shipments, stored, _ = shipment_case(spark)
    more = spark.createDataFrame([("RM3", f"S{i}", i, 4) for i in (1, 2, 3, 4, 5)] + [("RM4", "S1", 1, 5), ("RM5", "S2", 1, 6), ("RM6", "S2", 1, 7)], LINES)
    lines = lines.unionByName(more).unionByName(lines).unionByName(more)
    materials = materials.unionByName(spark.createDataFrame(  # rows of one material that are equal
        [("RM3", 7), ("RM3", 7), ("RM4", 0), ("RM5", None), ("RM6", -1), ("RM7", 3)], materials.schema))
    found = events.reserve_stock(lines, materials, registry.LINES_BY, shipments.unionByName(shipments), stored.unionByName(stored))
    took = found.lines.filter("status = 'accepted'").groupBy("Material_Id").count()
    want = materials.join(took.select(F.col("Material_Id").alias("m"), "count"), F.col("material_Id") == F.col("m"), "left").select(
        "material_Id", (F.col("quantity") - F.coalesce("count", F.lit(0))).alias("quantity"))
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    want = rows(want)
    assert "('RM3', 0)" in want and "('RM6', -1)" in want

    def none(*args, **kwargs):
        raise AssertionError("a copy or a scan of the lines")

    monkeypatch.setattr(events, "kept", none)
    monkeypatch.setattr(events, "scan_within", none)
    after = events.reserve_stock(lines, materials, registry.LINES_BY, shipments.unionByName(shipments), stored.unionByName(stored)).materials_after
    assert rows(after) == want


def test_f5_rows_of_a_material_with_other_stocks(spark):
    """Each line is held against each row of its material: three lines have places 0, 2, 4 of 1 unit and 1, 3, 5 of 4 units."""
    lines = spark.createDataFrame([("RM1", f"S{i}", i, 1) for i in (1, 2, 3)], LINES)
    materials = spark.createDataFrame([("RM1", 1), ("RM1", 4)], "material_Id string, quantity long")
    after = events.reserve_stock(lines, materials, registry.LINES_BY).materials_after
    assert sorted(r.quantity for r in after.collect()) == [1 - 3, 4 - 3]
