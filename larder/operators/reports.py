"""The ten franchise reports (Q01-Q10) as DataFrame plans.

Every report aggregates facts to their final grain before joining dimensions, so the
large inputs are shuffled once and only on their own key; the partial (map-side)
aggregate absorbs a hot key. Whole-table order (ranks) goes through
``ordinal.rank_all``; windows partitioned by a key are used only on aggregate output,
where a group is bounded (years of a franchise, item names of a franchise).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.exprs import (band, first_date_at_or_after, joined_text, mean, months_back_literal,
                                    percent_text, ratio)
from larder.operators.ordinal import rank_all, ranks_all, stored
from larder.operators.shaping import previous_period, rank_within, total_of

SHIFT_BANDS = ("Short Shift", "Regular Shift", "Long Shift")  # fixed labels of the report
SHIFT_BOUNDS = (4, 8)
CAPACITY_LABELS = ("Needs expansion", "Adequate")  # fixed labels of the report
CAPACITY_FACTOR = "1.5"


def item_feedback_ranking(menu_items: DataFrame, order_items: DataFrame, orders: DataFrame,
                          feedback_links: DataFrame, feedbacks: DataFrame, franchises: DataFrame) -> DataFrame:
    """Q01: mean rating and feedback count per franchise and item name, numbered by mean.

    A feedback counts once per listed item of its order. The outer joins of the report
    are inner in effect (its filter keeps franchise-bearing groups with feedback), so the
    plan is: feedback per order -> listed items -> franchise -> names.
    """
    per_order = (feedback_links.select("order_id", "feedbackID")
                 .join(feedbacks.select("feedbackID", "rating"), "feedbackID")
                 .groupBy("order_id")
                 .agg(F.sum("rating").alias("_sum"), F.count("rating").alias("_rated"),
                      F.count("feedbackID").alias("_links")))
    # order grain first: the items meet orders that have feedback and a known franchise
    placed = (orders.select("order_id", "franchise_id").join(per_order, "order_id")
              .join(franchises.select("franchise_id"), "franchise_id", "left_semi"))
    per_item = (order_items.select("order_id", "mitemID")
                .join(placed, "order_id")
                .groupBy("franchise_id", "mitemID")
                .agg(F.sum("_sum").alias("_sum"), F.sum("_rated").alias("_rated"), F.sum("_links").alias("_links")))
    named = (per_item
             .join(menu_items.select(F.col("mItemID").alias("mitemID"), F.col("mItemName").alias("item_name")),
                   "mitemID")
             .filter(F.col("item_name").isNotNull())
             .groupBy("franchise_id", "item_name")
             .agg(F.sum("_sum").alias("_sum"), F.sum("_rated").alias("_rated"), F.sum("_links").alias("_links"))
             .filter(F.col("_links") > 0)
             .select("franchise_id", "item_name",
                     mean("_sum", "_rated").alias("avg_feedback_rating"),
                     F.col("_links").cast("long").alias("total_feedbacks"),
                     # the order is that of the exact mean, not of the rounded one
                     F.when(F.col("_rated") > 0, F.col("_sum").cast("double") / F.col("_rated")).alias("_mean")))
    ranked = rank_within(named, ["franchise_id"], [F.col("_mean").desc_nulls_first(), F.col("item_name").asc()],
                         "feedback_rank").drop("_mean")
    return ranked.orderBy("franchise_id", "feedback_rank")


def yearly_revenue_growth(orders: DataFrame) -> DataFrame:
    """Q02: revenue per franchise and year against the previous present year."""
    yearly = (orders.groupBy("franchise_id", F.year("orderdate").alias("year"))
              .agg(F.sum("totalamount").cast("decimal(38,2)").alias("total_revenue")))
    lagged = previous_period(yearly, ["franchise_id"], "year", "total_revenue", "_prev")
    prev = F.coalesce(F.col("_prev"), F.lit(0).cast("decimal(38,2)"))
    pct = ratio((F.col("total_revenue") - F.col("_prev")) * 100, F.col("_prev"), 2, num_scale=2, den_scale=2)
    return lagged.select(
        "franchise_id", F.col("year").cast("int").alias("year"), "total_revenue",
        prev.cast("decimal(38,2)").alias("previous_year_revenue"),
        (F.col("total_revenue") - prev).cast("decimal(38,2)").alias("growth"),
        F.when(F.col("_prev").isNull() | (F.col("_prev") == 0), F.lit("0.00%"))
         .otherwise(percent_text(pct)).alias("growth_percentage"),
    )


def agreement_inventory_ranking(agreements: DataFrame, franchises: DataFrame, owners: DataFrame,
                                inventories: DataFrame) -> DataFrame:
    """Q03: agreement length in years and inventory record count, with two global ranks.

    One row per agreement; the owner shown is the franchise's owner. Franchises without
    inventory keep a NULL count, which ranks first under descending order.
    """
    spans = (agreements.select("franchise_id", "term_start_date", "term_end_date")
             .join(franchises.select("franchise_id", "owner_id"), "franchise_id")
             .join(owners.select("owner_id", "lname", "fname"), "owner_id")
             .select("franchise_id",
                     joined_text("lname", F.lit(", "), "fname").alias("franchise_owner"),
                     ratio(F.datediff("term_end_date", "term_start_date"), F.lit(365), 2,
                           precision=18).alias("agreement_years")))
    counts = inventories.groupBy("franchise_id").agg(F.count("inv_Id").alias("total_inventory"))
    joined = ranks_all(spans.join(counts, "franchise_id", "left"), {
        "agreement_rank": [("agreement_years", True), ("franchise_id", False)],
        "inventory_rank": [("total_inventory", True), ("franchise_id", False)]})
    return (joined.select("franchise_id", "franchise_owner", "agreement_years", "total_inventory",
                          "agreement_rank", "inventory_rank")
            .orderBy("inventory_rank", "agreement_rank"))


def shift_pattern_cube(franchises: DataFrame, employees: DataFrame, shifts: DataFrame) -> DataFrame:
    """Q04: shifts, mean and total hours by franchise x shift band, with all subtotals.

    Shifts are reduced to (employee, band) before meeting the staff table.
    """
    banded = (shifts.select(F.col("Employee_ID").alias("employee_ID"),
                            band("shiftDuration", *SHIFT_BOUNDS, SHIFT_BANDS).alias("shift_type"),
                            "shiftDuration")
              .groupBy("employee_ID", "shift_type")
              .agg(F.count(F.lit(1)).alias("_rows"), F.count("shiftDuration").alias("_vals"),
                   F.sum("shiftDuration").alias("_sum")))
    staffed = (banded.join(employees.select("employee_ID", F.col("franchise_ID").alias("franchise_id")),
                           "employee_ID")
               .join(franchises.select("franchise_id"), "franchise_id", "left_semi"))
    grain = staffed.groupBy("franchise_id", "shift_type").agg(
        F.sum("_rows").alias("_rows"), F.sum("_vals").alias("_vals"), F.sum("_sum").alias("_sum"))
    cubed = grain.cube("franchise_id", "shift_type").agg(
        F.sum("_rows").alias("total_shifts"), F.sum("_vals").alias("_vals"), F.sum("_sum").alias("_sum"))
    return cubed.select("franchise_id", "shift_type", F.col("total_shifts").cast("long").alias("total_shifts"),
                        mean("_sum", "_vals").alias("avg_shift_duration"),
                        F.col("_sum").cast("decimal(38,2)").alias("total_shift_hours"))


def seating_cost_score(franchises: DataFrame, salaries: DataFrame) -> DataFrame:
    """Q05: seating capacity over mean employee cost (base + bonus, NULL bonus = 0)."""
    cost = (salaries.groupBy(F.col("franchise_ID").alias("franchise_id"))
            .agg(F.sum(F.col("base_Salary") + F.coalesce(F.col("bonus"), F.lit(0))).alias("_sum"),
                 F.count(F.col("base_Salary") + F.coalesce(F.col("bonus"), F.lit(0))).alias("_n")))
    scored = (franchises.select("franchise_id", "city", "seating_capacity").join(cost, "franchise_id")
              .withColumn("avg_employee_cost", mean("_sum", "_n")))
    # one rounding: seats * people / cost, not seats over the rounded mean
    return (scored.select("franchise_id", "city", "seating_capacity", "avg_employee_cost",
                          ratio(F.col("seating_capacity") * F.col("_n"), "_sum", 5, den_scale=2,
                                precision=18).alias("profitability_score"))
            .orderBy(F.col("profitability_score").desc_nulls_first()))


def owner_revenue_rank(franchises: DataFrame, orders: DataFrame, owners: DataFrame) -> DataFrame:
    """Q06: revenue per owner (sum of franchise sums) and its rank (ties share, gaps)."""
    per_franchise = orders.groupBy("franchise_id").agg(F.sum("totalamount").alias("_rev"))
    per_owner = (per_franchise.join(franchises.select("franchise_id", "owner_id"), "franchise_id")
                 .groupBy("owner_id").agg(F.sum("_rev").cast("decimal(38,2)").alias("total_owner_revenue"))
                 .join(owners.select("owner_id", "fname", "lname"), "owner_id")
                 .select("owner_id", joined_text("fname", F.lit(" "), "lname").alias("owner_name"),
                         "total_owner_revenue"))
    return rank_all(per_owner, [("total_owner_revenue", True)], "owner_rank")


def revenue_share(orders: DataFrame, franchises: DataFrame) -> DataFrame:
    """Q07: franchise revenue and its percent of all order revenue (all orders count in
    the denominator, only orders of known franchises in the numerator)."""
    per_franchise = stored(orders.groupBy("franchise_id").agg(
        F.sum("totalamount").cast("decimal(38,2)").alias("franchise_revenue")))  # orders are read once
    total = total_of(per_franchise, "franchise_revenue")
    shares = (per_franchise.join(franchises.select("franchise_id", "city"), "franchise_id")
              .select("franchise_id", "city", "franchise_revenue",
                      ratio(F.col("franchise_revenue") * 100, total, 2, num_scale=2, den_scale=2,
                            precision=18).alias("revenue_share_percentage")))
    return shares.orderBy(F.col("franchise_revenue").desc_nulls_first())


def _staff_counts(franchises: DataFrame, employees: DataFrame, name: str) -> DataFrame:
    return (employees.groupBy(F.col("franchise_ID").alias("franchise_id"))
            .agg(F.count("employee_ID").alias(name))
            .join(franchises.select("franchise_id"), "franchise_id", "left_semi"))


def staff_seating_ratio(franchises: DataFrame, employees: DataFrame) -> DataFrame:
    """Q08: staff count over seating capacity, unrounded (18 fraction digits)."""
    staff = _staff_counts(franchises, employees, "staff_count")
    return (franchises.select("franchise_id", "city", "seating_capacity").join(staff, "franchise_id")
            .select("franchise_id", "city", "seating_capacity", "staff_count",
                    ratio("staff_count", "seating_capacity", 18).alias("staff_to_seating_ratio"))
            .orderBy(F.col("staff_to_seating_ratio").desc_nulls_first()))


def revenue_per_employee(orders: DataFrame, franchises: DataFrame, employees: DataFrame) -> DataFrame:
    """Q09: revenue per employee from two separately aggregated branches."""
    revenue = orders.groupBy("franchise_id").agg(F.sum("totalamount").cast("decimal(38,2)").alias("total_revenue"))
    staff = _staff_counts(franchises, employees, "num_employees")
    return (revenue.join(staff, "franchise_id")
            .join(franchises.select("franchise_id", "city"), "franchise_id")
            .filter(F.col("num_employees") > 0)
            .select("franchise_id", "city", "total_revenue", "num_employees",
                    ratio("total_revenue", "num_employees", 2, num_scale=2).alias("revenue_per_employee"))
            .orderBy(F.col("revenue_per_employee").desc_nulls_first()))


def purchases_per_seat_status(franchises: DataFrame, deliveries: DataFrame, shipment_materials: DataFrame,
                              purchase_orders: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Q10: purchased quantity of recently delivered materials per seat, against 1.5 x the
    mean over franchises.

    Each delivery line meets every purchase order of its material (intended fan-out); the
    sum distributes over that join, so purchases are summed per material first and the
    many-to-many join never materialises. The six-month bound is a driver-side literal.
    """
    since = first_date_at_or_after(months_back_literal(as_of, 6))
    per_material = purchase_orders.groupBy("Material_Id").agg(F.sum("PurcQty").alias("_qty"))
    recent = deliveries.filter(F.col("DeliveryDate") >= F.lit(since)).select(
        F.col("Franchise_ID").alias("franchise_id"), "trackingID")
    # only recently delivered shipments are counted, per franchise and material, before quantities join
    per_franchise = (shipment_materials.select("trackingID", "Material_Id").join(recent, "trackingID")
                     .groupBy("franchise_id", "Material_Id").agg(F.count(F.lit(1)).alias("_times"))
                     .join(per_material, "Material_Id").groupBy("franchise_id")
                     .agg(F.sum(F.col("_times") * F.col("_qty")).alias("total_purchases")))
    seats = (franchises.select("franchise_id", "city", "seating_capacity").join(per_franchise, "franchise_id")
             .withColumn("_ratio", ratio("total_purchases", "seating_capacity", 18)))
    avg_ratio = seats.select(F.avg("_ratio").cast("decimal(38,18)")).scalar()  # one row
    return (seats.select(
        "franchise_id", "city", "seating_capacity", F.col("total_purchases").cast("long").alias("total_purchases"),
        ratio("total_purchases", "seating_capacity", 2).alias("purchases_per_seat"),
        F.round(avg_ratio, 2).cast("decimal(38,2)").alias("avg_purchases_per_seat"),
        # decimal(30,18) operands keep the product exact (no precision-loss rounding)
        F.when(F.col("_ratio").cast("decimal(30,18)")
               > avg_ratio.cast("decimal(30,18)") * F.lit(CAPACITY_FACTOR).cast("decimal(2,1)"),
               F.lit(CAPACITY_LABELS[0])).otherwise(F.lit(CAPACITY_LABELS[1])).alias("capacity_status"))
        .orderBy(F.col("purchases_per_seat").desc_nulls_first()))
