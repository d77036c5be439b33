"""Registry of named jobs: Spark builders and their SQL oracle.

Every builder takes ``(spark, sf_dir)``, derives the reference-shaped tables from the
driver parquet under ``sf_dir`` and returns the job's DataFrame (not collected).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.catalogue import CATALOGUE
from larder.operators import events, reports, rules
from larder.operators.ordinal import kept
from larder.plans import oracle
from larder.plans import rule_sql, stream_sql
from larder.session import scratch_path
from larder.sources import io
from larder.streaming import jobs
from larder.sources.fixtures import COUPONS_AS_OF, PURCHASES_AS_OF, Fixtures
from larder.sources.rest import NULL_TEXT, as_lines, feedback_batch, whole_table

Builder = Callable[[SparkSession, str], DataFrame]


def _reports() -> dict[str, Builder]:
    def q01(spark, root):
        t = Fixtures(spark, root)
        return reports.item_feedback_ranking(t.menu_items, t.lists, t.customer_orders, t.feedback_info,
                                             t.customer_feedbacks, t.franchise)

    def q02(spark, root):
        return reports.yearly_revenue_growth(Fixtures(spark, root).customer_orders)

    def q03(spark, root):
        t = Fixtures(spark, root)
        return reports.agreement_inventory_ranking(t.franchise_agreement, t.franchise, t.franchiseowners,
                                                   t.franchise_inventory)

    def q04(spark, root):
        t = Fixtures(spark, root)
        return reports.shift_pattern_cube(t.franchise, t.employees, t.eshifts_details)

    def q05(spark, root):
        t = Fixtures(spark, root)
        return reports.seating_cost_score(t.franchise, t.salary_details)

    def q06(spark, root):
        t = Fixtures(spark, root)
        return reports.owner_revenue_rank(t.franchise, t.customer_orders, t.franchiseowners)

    def q07(spark, root):
        t = Fixtures(spark, root)
        return reports.revenue_share(t.customer_orders, t.franchise)

    def q08(spark, root):
        t = Fixtures(spark, root)
        return reports.staff_seating_ratio(t.franchise, t.employees)

    def q09(spark, root):
        t = Fixtures(spark, root)
        return reports.revenue_per_employee(t.customer_orders, t.franchise, t.employees)

    def q10(spark, root):
        t = Fixtures(spark, root)
        return reports.purchases_per_seat_status(t.franchise, t.delivery_details, t.shipment_details,
                                                 t.purchase_order, PURCHASES_AS_OF)

    return {
        "q01_item_feedback_ranking": q01,
        "q02_yearly_revenue_growth": q02,
        "q03_agreement_inventory_ranking": q03,
        "q04_shift_pattern_cube": q04,
        "q05_seating_cost_score": q05,
        "q06_owner_revenue_rank": q06,
        "q07_revenue_share": q07,
        "q08_staff_seating_ratio": q08,
        "q09_revenue_per_employee": q09,
        "q10_purchases_per_seat_status": q10,
    }


LINES_BY = (("arrival_seq", False), ("line", False))


def _reservation(spark, root):
    t = Fixtures(spark, root)
    return events.reserve_stock(t.shipment_requests, t.raw_materials, LINES_BY, t.shipment, t.shipment_stored)


def _intake(spark, root):
    t = Fixtures(spark, root)
    return events.process_purchase_orders(t.po_requests, t.raw_materials, t.purchase_order)


def _events() -> dict[str, Builder]:
    def e01(spark, root):
        t = Fixtures(spark, root)
        return events.apply_coupon_totals(t.order_requests, t.coupons, COUPONS_AS_OF)

    def e02(spark, root):
        return events.stock_status(Fixtures(spark, root).inventory_details)

    def e05(spark, root):
        t = Fixtures(spark, root)
        lines = _reservation(spark, root).eligible
        receipts = _intake(spark, root).accepted_requests  # stored, as the lines are
        return events.stock_ledger(events.ledger_events(lines, receipts), t.raw_materials)

    return {
        "e01_coupon_totals": e01,
        "e02_stock_status": e02,
        "e03_reserve_stock": lambda s, r: _reservation(s, r).lines,
        "e03_materials_after": lambda s, r: _reservation(s, r).materials_after,
        "e04_po_accepted": lambda s, r: _intake(s, r).accepted,
        "e04_po_rejected": lambda s, r: _intake(s, r).rejected,
        "e04_materials_after": lambda s, r: _intake(s, r).materials_after,
        "e04_audit": lambda s, r: _intake(s, r).audit,
        "e05_stock_ledger": e05,
    }


ARRIVAL = ("arrival_order", "arrival_line", "arrival_part")
ORDER_COLUMNS = ("PONo", "PODate", "PurcQty", "Material_Id")


def _po_batch(t: Fixtures, *more: str) -> DataFrame:
    r = t.po_requests
    return r.select(*more, r.p_po_no.alias("PONo"), r.p_po_date.alias("PODate"), r.p_purchase_qty.alias("PurcQty"),
                    r.p_material_id.alias("Material_Id"))


def _rules() -> dict[str, Builder]:
    def base(name):
        return lambda spark, root: Fixtures(spark, root).base(name)

    def c01(spark, root):
        return rules.check_not_null(Fixtures(spark, root).delivery_details, "delivery_details", ["DeliveryDate"],
                                    ["Franchise_ID", "trackingID", "confirmationCode"])

    def c05(spark, root):
        t = Fixtures(spark, root)
        return rules.check_foreign_key(t.po_requests, "po_requests", "p_material_id", t.raw_materials,
                                       "material_Id", ["arrival_order", "arrival_line", "arrival_part"])

    def c12(spark, root):
        t = Fixtures(spark, root)
        tables = {name: whole_table(t, name) for name in CATALOGUE}
        tables["purchase_order"] = t.purchase_order.unionByName(_po_batch(t))  # stored + incoming batch
        return rules.constraint_report(tables)

    def c13(spark, root):
        t = Fixtures(spark, root)
        split = rules.quarantine(_po_batch(t, *ARRIVAL), CATALOGUE["purchase_order"], {"raw_materials": t.raw_materials},
                                 existing=t.purchase_order, order=(*ARRIVAL, "Material_Id", "PurcQty", "PODate"))  # as E04
        return rules.Split(split.accepted.select(*ORDER_COLUMNS), split.rejected.select(*ORDER_COLUMNS, "reasons"))

    def c13_batch(spark, root):
        batch, had = feedback_batch(Fixtures(spark, root))
        splits = rules.quarantine_batch(batch, had, {"customer_orders": ["orderdate"]})
        out = None
        for name, split in splits.items():
            key = rules.row_key(split.rejected, [c.name for c in CATALOGUE[name].columns if c.name in batch[name].columns])
            judged = split.rejected.select(F.lit(name).alias("table_name"), key.alias("row_key"), "reasons").unionByName(
                split.accepted.select(F.lit(name).alias("table_name"), key.alias("row_key"), F.lit(None).cast("string").alias("reasons")))
            out = judged if out is None else out.unionByName(judged)
        return out

    return {
        "c13_batch": c13_batch,
        "c01_not_null": c01,
        "c02_primary_key": lambda s, r: rules.check_primary_key(base("lineitem")(s, r), "lineitem", ["l_orderkey"]),
        "c03_primary_key_composite": lambda s, r: rules.check_primary_key(
            base("lineitem")(s, r), "lineitem", ["l_orderkey", "l_linenumber"]),
        "c04_unique": lambda s, r: rules.check_unique(base("part")(s, r), "part", "p_name"),
        "c05_foreign_key": c05,
        "c06_prefix": lambda s, r: rules.check_prefix(base("part")(s, r), "part", "p_type", "S", ["p_partkey"]),
        "c07_min": lambda s, r: rules.check_min(base("customer")(s, r), "customer", "c_acctbal", 0, ["c_custkey"]),
        "c08_between": lambda s, r: rules.check_between(base("events")(s, r), "events", "value", 1, 5, ["event_id"]),
        "c09_in": lambda s, r: rules.check_in(base("orders")(s, r), "orders", "o_orderstatus", ["F", "O"],
                                              ["o_orderkey"]),
        "c10_max_length": lambda s, r: rules.check_max_length(base("part")(s, r), "part", "p_name", 10, ["p_partkey"]),
        "c11_precision": lambda s, r: rules.check_precision(base("orders")(s, r), "orders", "o_totalprice", 5,
                                                            ["o_orderkey"]),
        "c12_constraint_report": c12,
        "c13_quarantine_rejected": lambda s, r: c13(s, r).rejected,
        "c13_quarantine_accepted": lambda s, r: c13(s, r).accepted,
    }


def _sources() -> dict[str, Builder]:
    def materials_file(spark, root):
        """raw_materials as CSV, columns in another order, with a fraction in every seventh quantity."""
        t = Fixtures(spark, root)
        path = scratch_path(spark, "s01-raw-materials")
        odd = F.substring("material_Id", 3, 20).cast("long") % 7 == 0
        quantity = F.concat(F.col("quantity").cast("string"), F.when(odd, F.lit(".5")).otherwise(F.lit("")))
        t.raw_materials.withColumn("quantity", quantity).select(
            "quantity", "cold_storage", "materialName", "material_Id", "typeofMaterial").write.option("header", "true").csv(path)
        return io.read_table(spark, "raw_materials", path, fmt="csv", strict=False)

    def s01(spark, root):
        t = Fixtures(spark, root)
        path = scratch_path(spark, "s01-raw-materials")
        t.raw_materials.write.option("header", "true").csv(path)
        return io.read_table(spark, "raw_materials", path, fmt="csv")

    def s01_refused(spark, root):
        refused = materials_file(spark, root)[1]
        return refused.drop("line").withColumn("reasons", F.array_join(F.transform(
            "reasons", lambda x: F.concat(x["column"], F.lit(": "), x["reason"])), "; "))

    def s01_all(spark, root):
        """Each table of the catalogue as a file with broken lines: rows taken with their filled cells, refused ones by reason."""
        t = Fixtures(spark, root)
        path = scratch_path(spark, "s01-all")
        found = None
        for name, table in CATALOGUE.items():
            file = f"{path}/table_name={name}"
            as_lines(t, name).select("line").write.text(file)  # by table: nothing is sorted into folders
            rows = io.judge_table(spark, name, file, "csv", [c.name for c in table.columns], {"nullValue": NULL_TEXT})
            filled = " + ".join(f"CAST({c.name} IS NOT NULL AS BIGINT)" for c in table.columns)
            rows = rows.selectExpr(f"CASE WHEN reasons IS NULL THEN {filled} ELSE 0 END AS filled", "explode_outer(reasons) AS x").selectExpr(
                f"'{name}' AS table_name", "x.column AS column_name", "coalesce(x.reason, 'accepted') AS outcome", "filled")
            found = rows if found is None else found.unionByName(rows)
        return found.groupBy("table_name", "column_name", "outcome").agg(F.count(F.lit(1)).alias("n_rows"),
                                                                        F.sum("filled").alias("n_filled"))

    def s02(spark, root):
        t = Fixtures(spark, root)
        path = scratch_path(spark, "s02-purchase-order")
        io.append_rows(t.purchase_order, path, "stored")
        batch = kept(_intake(spark, root).accepted)  # inserted twice, judged once
        for _ in range(2):  # the second is a replay: nothing is doubled
            io.insert_rows(batch, "purchase_order", path, "intake", {"raw_materials": t.raw_materials})
        return io.read_rows(spark, path)

    def s03(spark, root):
        t = Fixtures(spark, root)
        table_root = scratch_path(spark, "s03-raw-materials")
        io.publish_version(t.raw_materials, table_root, 0)
        current = io.read_current(spark, table_root)
        changed = io.apply_delta(current, _reservation(spark, root).materials_after, ["material_Id"], "quantity")
        io.publish_version(changed, table_root, io.next_version(spark, table_root))
        return io.read_current(spark, table_root)

    def s04(spark, root):
        t = Fixtures(spark, root)
        return io.enrich(t.order_requests, t.coupons, "coupon_code")

    def s05(spark, root):
        return io.audit_messages(_intake(spark, root).audit)

    return {"s01_typed_scan": s01, "s01_accepted": lambda s, r: materials_file(s, r)[0],
            "s01_refused": s01_refused, "s01_all_tables": s01_all, "s02_append": s02, "s03_apply_delta": s03, "s04_enrich": s04,
            "s05_audit": s05}


#: Rows of one file of a stream's input, and micro-batches at least.
FILE_ROWS = 1_000_000
BATCHES = 4


def _slices(df: DataFrame, path: str, *order: str) -> int:
    """Write ``df`` as files for a file stream, as many as its size asks for, and return how many of
    them make a micro-batch: the number of micro-batches stays, so what each of them reads of the stored tables does not
    grow with the square of the input. With ``order`` each file is a range of it; a file stream takes files by
    their times, so these are set in that order."""
    spark = df.sparkSession
    parts = max(BATCHES, -(-df.count() // FILE_ROWS))
    if not order:
        df.repartition(parts).write.parquet(path)
        return -(-parts // BATCHES)
    df.repartitionByRange(parts, *order).write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    for i, f in enumerate(files):
        fs.setTimes(f.getPath(), files[0].getModificationTime() - 1000 * (len(files) - i), -1)
    return -(-parts // BATCHES)


def _streams() -> dict[str, Builder]:
    def e06(spark, root):
        t = Fixtures(spark, root)
        src, sink, ckpt = (scratch_path(spark, f"e06-{k}") for k in ("in", "out", "ckpt"))
        files = _slices(t.order_requests, src)
        stream = jobs.stream_files(spark, src, t.order_requests, files)
        jobs.run_to_sink(jobs.coupon_totals_stream(stream, t.coupons, COUPONS_AS_OF), sink, ckpt)
        return spark.read.parquet(sink)

    def e07(spark, root):
        t = Fixtures(spark, root)
        src, changes, ckpt = (scratch_path(spark, f"e07-{k}") for k in ("in", "changes", "ckpt"))
        files = _slices(t.inventory_details, src)
        jobs.run_stock_status_stream(jobs.stream_files(spark, src, t.inventory_details, files), changes, ckpt)
        return jobs.read_stock_status(spark, ckpt)

    def e08(spark, root):
        t = Fixtures(spark, root)
        src, root_, ckpt = (scratch_path(spark, f"e08-{k}") for k in ("in", "out", "ckpt"))
        files = _slices(t.shipment_requests, src, "arrival_seq")
        stream = jobs.stream_files(spark, src, t.shipment_requests, files)
        jobs.run_reservation_stream(stream, t.raw_materials, root_, ckpt, LINES_BY, t.shipment, t.shipment_stored)
        return jobs.read_reservations(spark, root_)

    return {"e06_coupon_totals_stream": e06, "e07_stock_status_stream": e07, "e08_reserve_stock_stream": e08}


def queries() -> dict[str, Builder]:
    out: dict[str, Builder] = {}
    out.update(_reports())
    out.update(_events())
    out.update(_rules())
    out.update(_sources())
    out.update(_streams())
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(oracle.REPORT_SQL)
    out.update(oracle.EVENT_SQL)
    out.update(rule_sql.RULE_SQL)
    out.update(stream_sql.SOURCE_AND_STREAM_SQL)
    return {k: v for k, v in out.items() if k in queries()}
