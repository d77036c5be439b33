"""Reference-shaped tables derived from the driver's parquet tables.

The reference ships schemas but no data, so every job runs on tables that Spark derives
from ``/root/testdata/sf*/``; the derivation is part of each job's plan and grows with the
input. Shapes and rules are fixed in FIXTURES.md part B; column names follow the reference
schema in lower-or-mixed case as declared.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed clock values of the fixtures (FIXTURES.md part B).
PURCHASES_AS_OF = dt.datetime(2001, 8, 1, 0, 0, 0)
COUPONS_AS_OF = dt.datetime(1999, 1, 1, 0, 0, 0)

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _tag(prefix: str, *cols: Column) -> Column:
    parts: list[Column] = [F.lit(prefix)]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("_"))
        parts.append(c.cast("string"))
    return F.concat(*parts)


def _day(base: str, offset: Column) -> Column:
    return F.date_add(F.lit(base).cast("date"), offset.cast("int"))


class Fixtures:
    """Lazily built DataFrames; one object per (session, scale dir)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # -- helper: number of franchises, as a scalar subquery (exactly one row) --
    @cached_property
    def franchise_count(self) -> Column:
        return self.base("supplier").select(F.count(F.lit(1))).scalar()

    @cached_property
    def franchiseowners(self) -> DataFrame:
        n = self.base("nation")
        return n.select(
            _tag("FO", F.col("n_nationkey")).alias("owner_id"),
            F.col("n_name").alias("lname"),
            _tag("R", F.col("n_regionkey")).alias("fname"),
            F.concat(F.lit("fo"), F.col("n_nationkey").cast("string"), F.lit("@example.com")).alias("owner_mail"),
        )

    @cached_property
    def franchise(self) -> DataFrame:
        s = self.base("supplier").select("s_suppkey", "s_nationkey")
        n = self.base("nation").select("n_nationkey", "n_name")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            _tag("FA", F.col("s_suppkey")).alias("franchise_id"),
            F.col("n_name").alias("city"),
            (F.lit(20) + F.col("s_suppkey") % 81).cast("bigint").alias("seating_capacity"),
            _tag("FO", F.col("s_nationkey")).alias("owner_id"),
            _day("1990-01-01", F.col("s_suppkey") % 1000).alias("franchise_since"),
        )

    @cached_property
    def franchise_agreement(self) -> DataFrame:
        s = self.base("supplier")
        return s.select(
            _tag("FAGR", F.col("s_suppkey")).alias("agreement_id"),
            _tag("FA", F.col("s_suppkey")).alias("franchise_id"),
            _tag("FO", F.col("s_nationkey")).alias("owner_id"),
            F.lit("1994-12-01").cast("date").alias("agreementdate"),
            _day("1995-01-01", F.col("s_suppkey") % 30).alias("term_start_date"),
            _day("2000-01-01", (F.col("s_suppkey") * 137) % 3650).alias("term_end_date"),
        )

    @cached_property
    def franchise_inventory(self) -> DataFrame:
        li = self.base("lineitem").filter(F.col("l_suppkey") % 7 != 0)
        # de-duplicate on the numeric keys, then build the text ids (same rows, cheaper hashing)
        return li.select("l_suppkey", "l_partkey").distinct().select(
            _tag("FINV", F.col("l_suppkey"), F.col("l_partkey")).alias("inv_Id"),
            _tag("FA", F.col("l_suppkey")).alias("franchise_id"),
        )

    def _staff(self) -> DataFrame:
        c = self.base("customer")
        return c.select(
            "c_custkey", "c_acctbal",
            _tag("EMP", F.col("c_custkey")).alias("employee_ID"),
            _tag("FA", (F.col("c_custkey") % self.franchise_count) * (F.col("c_custkey") % self.franchise_count)
                 % self.franchise_count).alias("franchise_ID"),
        )

    @cached_property
    def employees(self) -> DataFrame:
        return self._staff().select("employee_ID", "franchise_ID")

    @cached_property
    def salary_details(self) -> DataFrame:
        return self._staff().select(
            "employee_ID", "franchise_ID",
            F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("decimal(18,2)").alias("bonus"),
            (F.lit(20000) + (F.col("c_custkey") * 7919) % 60000).cast("decimal(18,2)").alias("base_Salary"),
        )

    @cached_property
    def eshifts_details(self) -> DataFrame:
        e = self.base("events")
        return (e.groupBy(F.col("user_id"), F.col("ts").cast("date").alias("shiftDate"))
                .agg(F.min("ts").alias("startTime"), F.max("ts").alias("endTime"),
                     (F.count(F.lit(1)) * 2).cast("decimal(18,2)").alias("shiftDuration"))
                .select(_tag("EMP", F.col("user_id")).alias("Employee_ID"), "shiftDate", "startTime",
                        "endTime", "shiftDuration"))

    @cached_property
    def menu_items(self) -> DataFrame:
        p = self.base("part")
        return p.select(
            _tag("MI", F.col("p_partkey")).alias("mItemID"),
            F.col("p_name").alias("mItemName"),
            (F.col("p_size") * 10).cast("bigint").alias("mitemCalories"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("mItemPrice"),
            F.col("p_type").alias("mItemCategory"),
        )

    @cached_property
    def customer_orders(self) -> DataFrame:
        o = self.base("orders")
        return o.select(
            _tag("CO", F.col("o_orderkey")).alias("order_id"),
            F.col("o_orderdate").cast("date").alias("orderdate"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("totalamount"),
            _tag("FA", F.col("o_orderkey") % self.franchise_count).alias("franchise_id"),
            _tag("MCDC", F.col("o_custkey")).alias("cus_id"),
        )

    @cached_property
    def lists(self) -> DataFrame:
        li = self.base("lineitem")
        return li.select("l_orderkey", "l_partkey").distinct().select(
            _tag("CO", F.col("l_orderkey")).alias("order_id"), _tag("MI", F.col("l_partkey")).alias("mitemID"))

    def _finished_orders(self) -> DataFrame:
        return self.base("orders").filter(F.col("o_orderstatus") == "F")

    @cached_property
    def customer_feedbacks(self) -> DataFrame:
        o = self._finished_orders()
        return o.select(
            _tag("FB", F.col("o_orderkey")).alias("feedbackID"),
            F.date_add(F.col("o_orderdate").cast("date"), 7).alias("feedback_date"),
            (F.lit(1) + (F.col("o_custkey") * 7 + F.col("o_orderkey") * 3) % 5).cast("decimal(18,2)").alias("rating"),
            F.col("o_orderpriority").alias("service_used"),
        )

    @cached_property
    def feedback_info(self) -> DataFrame:
        o = self._finished_orders()
        return o.select(_tag("MCDC", F.col("o_custkey")).alias("cus_id"),
                        _tag("CO", F.col("o_orderkey")).alias("order_id"),
                        _tag("FB", F.col("o_orderkey")).alias("feedbackID"))

    @cached_property
    def raw_materials(self) -> DataFrame:
        p = self.base("part")
        return p.select(
            _tag("RM", F.col("p_partkey")).alias("material_Id"),
            F.col("p_name").alias("materialName"),
            F.col("p_type").alias("typeofMaterial"),
            F.when(F.col("p_size") % 2 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("cold_storage"),
            F.col("p_size").cast("bigint").alias("quantity"),
        )

    @cached_property
    def shipment_details(self) -> DataFrame:
        li = self.base("lineitem")
        return li.select("l_partkey", "l_orderkey").distinct().select(
            _tag("RM", F.col("l_partkey")).alias("Material_Id"), _tag("SPM", F.col("l_orderkey")).alias("trackingID"),
            F.col("l_orderkey").alias("arrival_seq"))

    @cached_property
    def shipment(self) -> DataFrame:
        """Known shipments: those of most orders."""
        return self.base("orders").filter(F.col("o_orderkey") % 13 != 0).select(_tag("SPM", F.col("o_orderkey")).alias("trackingID"))

    @cached_property
    def shipment_stored(self) -> DataFrame:
        """Lines that SHIPMENT_DETAILS holds before the requests come."""
        li = self.base("lineitem").filter(F.col("l_orderkey") % 23 == 0)
        return li.select("l_partkey", "l_orderkey").distinct().select(
            _tag("RM", F.col("l_partkey")).alias("Material_Id"), _tag("SPM", F.col("l_orderkey")).alias("trackingID"))

    @cached_property
    def shipment_requests(self) -> DataFrame:
        """Incoming shipment lines: repeated ones, missing and unknown materials, missing tracking ids; every fifth
        order's lines come again 40 later. (arrival_seq, line) is their order."""
        li, order = self.base("lineitem"), F.col("l_orderkey")
        lines = li.select("l_partkey", "l_orderkey", order.alias("arrival_seq"), F.col("l_linenumber").cast("bigint").alias("line"))
        again = li.filter(order % 5 == 0).select("l_partkey", "l_orderkey", (order + 40).alias("arrival_seq"),
                                                 (F.col("l_linenumber") + 10).cast("bigint").alias("line"))
        material = F.when(order % 37 == 0, _tag("RM0_", F.col("l_partkey"))).when(order % 31 != 0, _tag("RM", F.col("l_partkey")))
        return lines.unionByName(again).select(material.alias("Material_Id"), F.when(order % 29 != 0, _tag("SPM", order)).alias("trackingID"),
                                               "arrival_seq", "line")

    @cached_property
    def purchase_order(self) -> DataFrame:
        li = self.base("lineitem")
        return (li.groupBy("l_partkey", "l_suppkey")
                .agg(F.min("l_shipdate").cast("date").alias("PODate"),
                     F.sum("l_quantity").cast("bigint").alias("PurcQty"))
                .select(_tag("PO", F.col("l_partkey"), F.col("l_suppkey")).alias("PONo"), "PODate", "PurcQty",
                        _tag("RM", F.col("l_partkey")).alias("Material_Id")))

    @cached_property
    def delivery_details(self) -> DataFrame:
        o = self.base("orders")
        return o.select(
            _tag("FA", F.col("o_orderkey") % self.franchise_count).alias("Franchise_ID"),
            _tag("SPM", F.col("o_orderkey")).alias("trackingID"),
            F.col("o_orderkey").alias("confirmationCode"),
            F.when(F.col("o_orderstatus") != "P", F.date_add(F.col("o_orderdate").cast("date"), 3)).alias("DeliveryDate"),
        )

    @cached_property
    def coupons(self) -> DataFrame:
        r = self.base("region")
        k = F.col("r_regionkey")
        expiry = F.when(k < 3, F.concat(F.lit("199"), (k + 7).cast("string"), F.lit("-01-01")).cast("date")) \
                  .otherwise(F.lit("2005-01-01").cast("date"))
        return r.select(
            _tag("CPN", k).alias("coupon_code"),
            (F.lit(100000) * k).cast("decimal(18,2)").alias("minPurchase_amt"),
            expiry.alias("coupExpiry"),
            (F.lit(500) * (k + 1)).cast("decimal(18,2)").alias("coupDiscount"),
        )

    @cached_property
    def order_requests(self) -> DataFrame:
        o = self.base("orders")
        return o.select(
            _tag("CO", F.col("o_orderkey")).alias("order_id"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("subtotal"),
            F.when(F.col("o_orderstatus") == "F", _tag("CPN", F.col("o_orderkey") % 6)).alias("coupon_code"),
        )

    @cached_property
    def inventory_details(self) -> DataFrame:
        p = self.base("part")
        return p.select(
            _tag("RM", F.col("p_partkey")).alias("Material_Id"),
            F.col("p_size").cast("bigint").alias("inv_qoh"),
            F.when(F.col("p_partkey") % 11 != 0, F.lit(15).cast("bigint")).alias("inv_reorder_level"),
        )

    @cached_property
    def po_requests(self) -> DataFrame:
        li = self.base("lineitem")
        return li.select(
            _tag("PO", F.col("l_orderkey")).alias("p_po_no"),
            _tag("RM", F.col("l_partkey") * 2).alias("p_material_id"),
            F.col("l_quantity").cast("bigint").alias("p_purchase_qty"),
            F.col("l_shipdate").cast("date").alias("p_po_date"),
            # the order of arrival: by order, line, part
            F.col("l_orderkey").alias("arrival_order"), F.col("l_linenumber").cast("bigint").alias("arrival_line"),
            F.col("l_partkey").alias("arrival_part"),
        )


# Derived tables that stand for reference tables, with their columns (for the rule jobs).
REFERENCE_SHAPED: dict[str, tuple[str, ...]] = {
    "franchiseowners": ("owner_id", "lname", "fname", "owner_mail"),
    "franchise": ("franchise_id", "city", "seating_capacity", "owner_id", "franchise_since"),
    "franchise_agreement": ("agreement_id", "franchise_id", "owner_id", "agreementdate", "term_start_date",
                            "term_end_date"),
    "franchise_inventory": ("inv_Id", "franchise_id"),
    "employees": ("employee_ID", "franchise_ID"),
    "salary_details": ("employee_ID", "franchise_ID", "bonus", "base_Salary"),
    "eshifts_details": ("Employee_ID", "shiftDate", "startTime", "endTime", "shiftDuration"),
    "menu_items": ("mItemID", "mItemName", "mitemCalories", "mItemPrice", "mItemCategory"),
    "customer_orders": ("order_id", "orderdate", "totalamount", "franchise_id", "cus_id"),
    "lists": ("order_id", "mitemID"),
    "customer_feedbacks": ("feedbackID", "feedback_date", "rating", "service_used"),
    "feedback_info": ("cus_id", "order_id", "feedbackID"),
    "raw_materials": ("material_Id", "materialName", "typeofMaterial", "cold_storage", "quantity"),
    "shipment_details": ("Material_Id", "trackingID", "arrival_seq"),
    "purchase_order": ("PONo", "PODate", "PurcQty", "Material_Id"),
    "delivery_details": ("Franchise_ID", "trackingID", "confirmationCode", "DeliveryDate"),
    "coupons": ("coupon_code", "minPurchase_amt", "coupExpiry", "coupDiscount"),
    "inventory_details": ("Material_Id", "inv_qoh", "inv_reorder_level"),
}
