"""Independent SQL for every registered job, runnable by DuckDB on the driver tables.

Each text puts the fixture derivations (FIXTURES.md part B) in front as CTEs and then
states the job from its meaning, in another way than the Spark plan does.
DuckDB divides decimals in DOUBLE, so quotients here use exact integer arithmetic with
half-away-from-zero rounding (``div``), the same values Spark's decimal division gives.
"""

from __future__ import annotations

import re

from larder.functions.exprs import months_back_literal
from larder.operators.reports import CAPACITY_LABELS, SHIFT_BANDS, SHIFT_BOUNDS
from larder.sources.fixtures import PURCHASES_AS_OF

# ---------------------------------------------------------------- fixture CTEs
FIXTURE_SQL: dict[str, str] = {
    "nsup": "SELECT CAST(COUNT(*) AS BIGINT) AS n FROM supplier",
    "franchiseowners": (
        "SELECT 'FO'||CAST(n_nationkey AS VARCHAR) AS owner_id, n_name AS lname, "
        "'R'||CAST(n_regionkey AS VARCHAR) AS fname, 'fo'||CAST(n_nationkey AS VARCHAR)||'@example.com' AS owner_mail "
        "FROM nation"),
    "franchise": (
        "SELECT 'FA'||CAST(s_suppkey AS VARCHAR) AS franchise_id, n_name AS city, "
        "CAST(20 + s_suppkey % 81 AS BIGINT) AS seating_capacity, 'FO'||CAST(s_nationkey AS VARCHAR) AS owner_id, "
        "DATE '1990-01-01' + CAST(s_suppkey % 1000 AS INT) AS franchise_since "
        "FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "franchise_agreement": (
        "SELECT 'FAGR'||CAST(s_suppkey AS VARCHAR) AS agreement_id, 'FA'||CAST(s_suppkey AS VARCHAR) AS franchise_id, "
        "'FO'||CAST(s_nationkey AS VARCHAR) AS owner_id, DATE '1994-12-01' AS agreementdate, "
        "DATE '1995-01-01' + CAST(s_suppkey % 30 AS INT) AS term_start_date, "
        "DATE '2000-01-01' + CAST((s_suppkey * 137) % 3650 AS INT) AS term_end_date FROM supplier"),
    "franchise_inventory": (
        "SELECT DISTINCT 'FINV'||CAST(l_suppkey AS VARCHAR)||'_'||CAST(l_partkey AS VARCHAR) AS inv_Id, "
        "'FA'||CAST(l_suppkey AS VARCHAR) AS franchise_id FROM lineitem WHERE l_suppkey % 7 <> 0"),
    "employees": (
        "SELECT 'EMP'||CAST(c_custkey AS VARCHAR) AS employee_ID, "
        "'FA'||CAST(((c_custkey % n) * (c_custkey % n)) % n AS VARCHAR) AS franchise_ID FROM customer CROSS JOIN nsup"),
    "salary_details": (
        "SELECT 'EMP'||CAST(c_custkey AS VARCHAR) AS employee_ID, "
        "'FA'||CAST(((c_custkey % n) * (c_custkey % n)) % n AS VARCHAR) AS franchise_ID, "
        "CAST(GREATEST(c_acctbal, 0) AS DECIMAL(18,2)) AS bonus, "
        "CAST(20000 + (c_custkey * 7919) % 60000 AS DECIMAL(18,2)) AS base_Salary FROM customer CROSS JOIN nsup"),
    "eshifts_details": (
        "SELECT 'EMP'||CAST(user_id AS VARCHAR) AS Employee_ID, CAST(ts AS DATE) AS shiftDate, MIN(ts) AS startTime, "
        "MAX(ts) AS endTime, CAST(COUNT(*) * 2 AS DECIMAL(18,2)) AS shiftDuration "
        "FROM events GROUP BY user_id, CAST(ts AS DATE)"),
    "menu_items": (
        "SELECT 'MI'||CAST(p_partkey AS VARCHAR) AS mItemID, p_name AS mItemName, "
        "CAST(p_size * 10 AS BIGINT) AS mitemCalories, CAST(p_retailprice AS DECIMAL(18,2)) AS mItemPrice, "
        "p_type AS mItemCategory FROM part"),
    "customer_orders": (
        "SELECT 'CO'||CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS DATE) AS orderdate, "
        "CAST(o_totalprice AS DECIMAL(18,2)) AS totalamount, 'FA'||CAST(o_orderkey % n AS VARCHAR) AS franchise_id, "
        "'MCDC'||CAST(o_custkey AS VARCHAR) AS cus_id FROM orders CROSS JOIN nsup"),
    "lists": (
        "SELECT DISTINCT 'CO'||CAST(l_orderkey AS VARCHAR) AS order_id, 'MI'||CAST(l_partkey AS VARCHAR) AS mitemID "
        "FROM lineitem"),
    "customer_feedbacks": (
        "SELECT 'FB'||CAST(o_orderkey AS VARCHAR) AS feedbackID, CAST(o_orderdate AS DATE) + 7 AS feedback_date, "
        "CAST(1 + (o_custkey * 7 + o_orderkey * 3) % 5 AS DECIMAL(18,2)) AS rating, o_orderpriority AS service_used "
        "FROM orders WHERE o_orderstatus = 'F'"),
    "feedback_info": (
        "SELECT 'MCDC'||CAST(o_custkey AS VARCHAR) AS cus_id, 'CO'||CAST(o_orderkey AS VARCHAR) AS order_id, "
        "'FB'||CAST(o_orderkey AS VARCHAR) AS feedbackID FROM orders WHERE o_orderstatus = 'F'"),
    "raw_materials": (
        "SELECT 'RM'||CAST(p_partkey AS VARCHAR) AS material_Id, p_name AS materialName, p_type AS typeofMaterial, "
        "CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END AS cold_storage, CAST(p_size AS BIGINT) AS quantity FROM part"),
    "shipment_details": (
        "SELECT DISTINCT 'RM'||CAST(l_partkey AS VARCHAR) AS Material_Id, 'SPM'||CAST(l_orderkey AS VARCHAR) AS trackingID, "
        "l_orderkey AS arrival_seq FROM lineitem"),
    "shipment": "SELECT 'SPM'||CAST(o_orderkey AS VARCHAR) AS trackingID FROM orders WHERE o_orderkey % 13 <> 0",
    "shipment_stored": (
        "SELECT DISTINCT 'RM'||CAST(l_partkey AS VARCHAR) AS Material_Id, 'SPM'||CAST(l_orderkey AS VARCHAR) AS trackingID "
        "FROM lineitem WHERE l_orderkey % 23 = 0"),
    "shipment_requests": (
        "SELECT CASE WHEN l_orderkey % 37 = 0 THEN 'RM0_'||CAST(l_partkey AS VARCHAR) "
        "WHEN l_orderkey % 31 <> 0 THEN 'RM'||CAST(l_partkey AS VARCHAR) END AS Material_Id, "
        "CASE WHEN l_orderkey % 29 <> 0 THEN 'SPM'||CAST(l_orderkey AS VARCHAR) END AS trackingID, "
        "l_orderkey + late AS arrival_seq, CAST(l_linenumber + late // 4 AS BIGINT) AS line "
        "FROM lineitem, (VALUES (0), (40)) AS again(late) WHERE late = 0 OR l_orderkey % 5 = 0"),
    "purchase_order": (
        "SELECT 'PO'||CAST(l_partkey AS VARCHAR)||'_'||CAST(l_suppkey AS VARCHAR) AS PONo, "
        "CAST(MIN(l_shipdate) AS DATE) AS PODate, CAST(SUM(l_quantity) AS BIGINT) AS PurcQty, "
        "'RM'||CAST(l_partkey AS VARCHAR) AS Material_Id FROM lineitem GROUP BY l_partkey, l_suppkey"),
    "delivery_details": (
        "SELECT 'FA'||CAST(o_orderkey % n AS VARCHAR) AS Franchise_ID, 'SPM'||CAST(o_orderkey AS VARCHAR) AS trackingID, "
        "o_orderkey AS confirmationCode, "
        "CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + 3 END AS DeliveryDate "
        "FROM orders CROSS JOIN nsup"),
    "coupons": (
        "SELECT 'CPN'||CAST(r_regionkey AS VARCHAR) AS coupon_code, CAST(100000 * r_regionkey AS DECIMAL(18,2)) AS minPurchase_amt, "
        "CAST('199'||CAST(7 + r_regionkey AS VARCHAR)||'-01-01' AS DATE) AS coupExpiry, "
        "CAST(500 * (1 + r_regionkey) AS DECIMAL(18,2)) AS coupDiscount FROM region WHERE r_regionkey < 3 "
        "UNION ALL SELECT 'CPN'||CAST(r_regionkey AS VARCHAR), CAST(100000 * r_regionkey AS DECIMAL(18,2)), "
        "DATE '2005-01-01', CAST(500 * (1 + r_regionkey) AS DECIMAL(18,2)) FROM region WHERE r_regionkey >= 3"),
    "order_requests": (
        "SELECT 'CO'||CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_totalprice AS DECIMAL(18,2)) AS subtotal, "
        "CASE WHEN o_orderstatus = 'F' THEN 'CPN'||CAST(o_orderkey % 6 AS VARCHAR) END AS coupon_code FROM orders"),
    "inventory_details": (
        "SELECT 'RM'||CAST(p_partkey AS VARCHAR) AS Material_Id, CAST(p_size AS BIGINT) AS inv_qoh, "
        "CASE WHEN p_partkey % 11 <> 0 THEN CAST(15 AS BIGINT) END AS inv_reorder_level FROM part"),
    "po_requests": (
        "SELECT 'PO'||CAST(l_orderkey AS VARCHAR) AS p_po_no, 'RM'||CAST(l_partkey * 2 AS VARCHAR) AS p_material_id, "
        "CAST(l_quantity AS BIGINT) AS p_purchase_qty, CAST(l_shipdate AS DATE) AS p_po_date, "
        "l_orderkey AS arrival_order, CAST(l_linenumber AS BIGINT) AS arrival_line, l_partkey AS arrival_part FROM lineitem"),
}

_NEEDS = {name: (["nsup"] if re.search(r"\bnsup\b", sql) else []) for name, sql in FIXTURE_SQL.items()}


def with_fixtures(body: str, *extra_ctes: tuple[str, str], recursive: bool = False) -> str:
    """Prefix ``body`` with the fixture CTEs it names (and ``extra_ctes`` verbatim)."""
    text = body + " ".join(sql for _, sql in extra_ctes)
    used: list[str] = []
    for name in FIXTURE_SQL:
        if re.search(rf"\b{name}\b", text) and name != "nsup":
            used.append(name)
    if any(_NEEDS[n] for n in used) or re.search(r"\bnsup\b", text):
        used.insert(0, "nsup")
    ctes = [f"{n} AS ({FIXTURE_SQL[n]})" for n in used] + [f"{n} AS ({sql})" for n, sql in extra_ctes]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" + body) if ctes else body


# ---------------------------------------------------------------- exact arithmetic
def scaled(expr: str, scale: int) -> str:
    """A decimal expression with ``scale`` fraction digits as an exact integer."""
    return f"CAST(({expr}) * {10 ** scale} AS HUGEINT)" if scale else f"CAST(({expr}) AS HUGEINT)"


def div(num: str, num_scale: int, den: str, den_scale: int, places: int, dtype: str | None = None) -> str:
    """``num / den`` rounded half away from zero to ``places``; inputs are decimals with the
    given scales (0 for integers). Result is DECIMAL(38, places) or ``dtype``."""
    n = f"({scaled(num, num_scale)} * {10 ** den_scale})"
    d = f"({scaled(den, den_scale)} * {10 ** num_scale})"
    q = f"((2 * abs({n}) * {10 ** places} + abs({d})) // (2 * abs({d})))"
    signed = f"(sign({n}) * sign({d}) * {q})"
    value = f"CAST({signed} AS DECIMAL(38,0))"
    if places:
        value = f"({value} * CAST('{10 ** -places:.{places}f}' AS DECIMAL(38,{places})))"
    return f"CAST({value} AS {dtype or f'DECIMAL(38,{places})'})"


def mean_sql(total: str, count: str, scale: int = 2) -> str:
    return f"CASE WHEN {count} > 0 THEN {div(total, scale, count, 0, 6, 'DECIMAL(22,6)')} END"




# ---------------------------------------------------------------- reports (Q01-Q10)
def _report_sql() -> dict[str, str]:
    """Written from the meaning of each report: facts are counted at their own grain first, names
    and places are looked up last. Labels come from the constants of ``reports``."""
    out: dict[str, str] = {}
    out["q01_item_feedback_ranking"] = with_fixtures(f"""
SELECT store AS franchise_id, dish AS item_name, {mean_sql('points', 'rated')} AS avg_feedback_rating,
       CAST(given AS BIGINT) AS total_feedbacks,
       CAST(ROW_NUMBER() OVER (PARTITION BY store ORDER BY CAST(points AS DOUBLE) / NULLIF(rated, 0) DESC NULLS FIRST,
                               dish) AS BIGINT) AS feedback_rank
FROM dish_votes WHERE given > 0""", ("order_votes", """
  SELECT order_id, SUM(rating) AS points, COUNT(rating) AS rated, COUNT(*) AS given
  FROM customer_feedbacks JOIN feedback_info USING (feedbackID) GROUP BY order_id"""), ("dish_votes", """
  SELECT placed.franchise_id AS store, mItemName AS dish, SUM(points) AS points, SUM(rated) AS rated, SUM(given) AS given
  FROM order_votes JOIN customer_orders AS placed USING (order_id)
       JOIN lists AS listed USING (order_id) JOIN menu_items ON menu_items.mItemID = listed.mitemID
  WHERE mItemName IS NOT NULL AND placed.franchise_id IN (SELECT franchise_id FROM franchise)
  GROUP BY ALL"""))

    pct = div("(total_revenue - prev) * 100", 2, "prev", 2, 2)
    out["q02_yearly_revenue_growth"] = with_fixtures(f"""
SELECT franchise_id, year, total_revenue,
       CAST(COALESCE(prev, 0) AS DECIMAL(38,2)) AS previous_year_revenue,
       CAST(total_revenue - COALESCE(prev, 0) AS DECIMAL(38,2)) AS growth,
       CASE WHEN prev IS NULL OR prev = 0 THEN '0.00%' ELSE CAST({pct} AS VARCHAR) || '%' END AS growth_percentage
FROM (SELECT *, (SELECT MAX_BY(e.total_revenue, e.year) FROM takings e
                 WHERE e.franchise_id = t.franchise_id AND e.year < t.year) AS prev FROM takings t)""", ("takings", """
  SELECT franchise_id, CAST(year(orderdate) AS INTEGER) AS year, CAST(SUM(totalamount) AS DECIMAL(38,2)) AS total_revenue
  FROM customer_orders GROUP BY ALL"""))

    years = div("term_end_date - term_start_date", 0, "365", 0, 2, "DECIMAL(18,2)")
    out["q03_agreement_inventory_ranking"] = with_fixtures("""
SELECT terms.franchise_id, franchise_owner, agreement_years, stocked.records AS total_inventory,
       CAST(RANK() OVER by_length AS BIGINT) AS agreement_rank, CAST(RANK() OVER by_stock AS BIGINT) AS inventory_rank
FROM terms LEFT JOIN stocked USING (franchise_id)
WINDOW by_length AS (ORDER BY agreement_years DESC NULLS FIRST, terms.franchise_id),
       by_stock AS (ORDER BY stocked.records DESC NULLS FIRST, terms.franchise_id)""", ("named", """
  SELECT franchise_id, concat(lname, ', ', fname) AS franchise_owner FROM franchise JOIN franchiseowners USING (owner_id)"""),
        ("terms", f"""
  SELECT franchise_id, franchise_owner, {years} AS agreement_years
  FROM (SELECT franchise_id, term_start_date, term_end_date FROM franchise_agreement) JOIN named USING (franchise_id)"""),
        ("stocked", "SELECT franchise_id, COUNT(inv_Id) AS records FROM franchise_inventory GROUP BY franchise_id"))

    short, regular, long = SHIFT_BANDS
    low, high = SHIFT_BOUNDS
    out["q04_shift_pattern_cube"] = with_fixtures(f"""
SELECT place AS franchise_id, label AS shift_type, CAST(SUM(n) AS BIGINT) AS total_shifts,
       {mean_sql('SUM(hours)', 'SUM(timed)')} AS avg_shift_duration, CAST(SUM(hours) AS DECIMAL(38,2)) AS total_shift_hours
FROM worked GROUP BY GROUPING SETS ((place, label), (place), (label), ())""", ("labelled", f"""
  SELECT Employee_ID AS person, shiftDuration AS hours,
         if(shiftDuration >= {low} AND shiftDuration <= {high}, '{regular}', if(shiftDuration < {low}, '{short}', '{long}')) AS label
  FROM eshifts_details"""), ("worked", """
  SELECT employees.franchise_ID AS place, label, COUNT(*) AS n, COUNT(hours) AS timed, SUM(hours) AS hours
  FROM labelled JOIN employees ON employees.employee_ID = person
  WHERE employees.franchise_ID IN (SELECT franchise_id FROM franchise) GROUP BY ALL"""))

    out["q05_seating_cost_score"] = with_fixtures(f"""
SELECT franchise_id, city, seating_capacity, {mean_sql('paid', 'people')} AS avg_employee_cost,
       {div('seating_capacity * people', 0, 'paid', 2, 5, 'DECIMAL(18,5)')} AS profitability_score
FROM franchise JOIN payroll USING (franchise_id)""", ("payroll", """
  SELECT franchise_ID AS franchise_id, SUM(pay) AS paid, COUNT(pay) AS people
  FROM (SELECT franchise_ID, base_Salary + COALESCE(bonus, 0) AS pay FROM salary_details) GROUP BY franchise_ID"""))

    out["q06_owner_revenue_rank"] = with_fixtures("""
SELECT owner_id, concat(fname, ' ', lname) AS owner_name, earned AS total_owner_revenue,
       CAST(RANK() OVER (ORDER BY earned DESC NULLS FIRST) AS BIGINT) AS owner_rank
FROM franchiseowners JOIN earnings USING (owner_id)""", ("earnings", """
  SELECT owner_id, CAST(SUM(totalamount) AS DECIMAL(38,2)) AS earned
  FROM customer_orders JOIN franchise USING (franchise_id)
  GROUP BY owner_id"""))

    share = div("taken * 100", 2, "company", 2, 2, "DECIMAL(18,2)")
    out["q07_revenue_share"] = with_fixtures(f"""
SELECT franchise_id, city, CAST(taken AS DECIMAL(38,2)) AS franchise_revenue, {share} AS revenue_share_percentage
FROM franchise JOIN shares USING (franchise_id)""", ("shares", """
  SELECT franchise_id, SUM(totalamount) AS taken, SUM(SUM(totalamount)) OVER () AS company
  FROM customer_orders GROUP BY franchise_id"""))

    heads = ("heads", "SELECT franchise_ID AS franchise_id, COUNT(employee_ID) AS people FROM employees GROUP BY franchise_ID")
    out["q08_staff_seating_ratio"] = with_fixtures(f"""
SELECT franchise_id, city, seating_capacity, people AS staff_count,
       {div('people', 0, 'seating_capacity', 0, 18)} AS staff_to_seating_ratio
FROM heads JOIN franchise USING (franchise_id)""", heads)

    out["q09_revenue_per_employee"] = with_fixtures(f"""
SELECT franchise_id, city, taken AS total_revenue, people AS num_employees, {div('taken', 2, 'people', 0, 2)} AS revenue_per_employee
FROM franchise JOIN heads USING (franchise_id) JOIN income USING (franchise_id) WHERE people > 0""", heads, ("income", """
  SELECT franchise_id, CAST(SUM(totalamount) AS DECIMAL(38,2)) AS taken FROM customer_orders GROUP BY franchise_id"""))

    since = months_back_literal(PURCHASES_AS_OF, 6)
    r18 = "CAST(bought AS HUGEINT) * CAST(1000000000000000000 AS HUGEINT)"
    out["q10_purchases_per_seat_status"] = with_fixtures(f"""
SELECT franchise_id, city, seating_capacity, bought AS total_purchases,
       {div('bought', 0, 'seating_capacity', 0, 2)} AS purchases_per_seat,
       {div('level', 0, '1000000000000000000', 0, 2)} AS avg_purchases_per_seat,
       if(2 * r18 > 3 * level, '{CAPACITY_LABELS[0]}', '{CAPACITY_LABELS[1]}') AS capacity_status
FROM (SELECT *, {div('SUM(r18) OVER ()', 0, 'COUNT(*) OVER ()', 0, 0)} AS level FROM seated)""", ("arrived", f"""
  SELECT Franchise_ID AS place, Material_Id, COUNT(*) AS times FROM shipment_details JOIN delivery_details USING (trackingID)
  WHERE DeliveryDate >= TIMESTAMP '{since}' GROUP BY ALL"""), ("ordered", """
  SELECT Material_Id, SUM(PurcQty) AS qty FROM purchase_order GROUP BY Material_Id"""), ("needed", """
  SELECT place AS franchise_id, CAST(SUM(times * qty) AS BIGINT) AS bought FROM arrived JOIN ordered USING (Material_Id) GROUP BY place"""),
        ("seated", f"""
  SELECT franchise_id, city, seating_capacity, bought, CAST({div(r18, 0, 'seating_capacity', 0, 0)} AS HUGEINT) AS r18
  FROM needed JOIN franchise USING (franchise_id)"""))
    return out


REPORT_SQL = _report_sql()


# ---------------------------------------------------------------- row-event jobs
E01_STATUS_OK = "('no_coupon', 'applied', 'not_applied')"
E03_LINES = ("e03_l", """
  SELECT s.*, s.trackingID IS NULL OR s.trackingID NOT IN (SELECT trackingID FROM shipment) OR held AS never,
         CASE WHEN s.trackingID IS NULL THEN 'missing_key'
              WHEN s.trackingID NOT IN (SELECT trackingID FROM shipment) THEN 'unknown_shipment'
              WHEN ROW_NUMBER() OVER (PARTITION BY s.Material_Id, s.trackingID ORDER BY s.arrival_seq, s.line) > 1 OR held
                THEN 'duplicate_line' END AS broken
  FROM (SELECT sr.*, rm.material_Id AS mid, rm.quantity AS stock, ss.Material_Id IS NOT NULL AS held
        FROM shipment_requests sr LEFT JOIN raw_materials rm ON sr.Material_Id = rm.material_Id
             LEFT JOIN shipment_stored ss ON sr.Material_Id = ss.Material_Id AND sr.trackingID = ss.trackingID) s""")
E03_NUMBERED = ("e03_n", """
  SELECT *, stock - COUNT(*) FILTER (broken IS NULL) OVER (
           PARTITION BY Material_Id ORDER BY arrival_seq, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS units
  FROM e03_l WHERE mid IS NOT NULL""")
E03_RESULT = ("e03_r", """
  SELECT Material_Id, trackingID, arrival_seq, line, if(units > 0 AND broken IS NULL, 'accepted', 'rejected') AS status,
         CAST(if(units > 0, NULL, -20005) AS INTEGER) AS error_code,
         if(units > 0, broken, 'insufficient_stock') AS reason
  FROM e03_n
  UNION ALL
  SELECT Material_Id, trackingID, arrival_seq, line, 'rejected', CAST(NULL AS INTEGER), 'unknown_material'
  FROM e03_l WHERE mid IS NULL""")
E04_ORDER = "arrival_order, arrival_line, arrival_part, p_material_id, p_purchase_qty, p_po_date"
E04_REQ = ("e04_f", """
  SELECT r.*, rm.quantity AS stock,
         CASE WHEN rm.material_Id IS NULL THEN 'material'
              WHEN r.p_po_no IS NULL OR r.p_po_date IS NULL OR r.p_purchase_qty IS NULL
                THEN 'cannot insert NULL into PURCHASE_ORDER'
              WHEN NOT starts_with(r.p_po_no, 'PO') OR strlen(r.p_po_no) > 16
                THEN 'check constraint on PURCHASE_ORDER.PONo violated' END AS fail
  FROM po_requests r LEFT JOIN raw_materials rm ON r.p_material_id = rm.material_Id""")
E04_CAND = ("e04_c", f"""
  SELECT *, ROW_NUMBER() OVER (PARTITION BY p_po_no ORDER BY {E04_ORDER}) AS k,
         p_po_no IN (SELECT PONo FROM purchase_order) AS taken
  FROM e04_f WHERE fail IS NULL""")
E04_OK = ("e04_ok", "SELECT * FROM e04_c WHERE k = 1 AND NOT taken")
E04_REQ_COLS = "p_po_no, p_material_id, p_purchase_qty, p_po_date, arrival_order, arrival_line, arrival_part"


def _event_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["e01_coupon_totals"] = with_fixtures(f"""
SELECT order_id, subtotal, coupon_code,
       CASE WHEN coupon_status IN {E01_STATUS_OK} THEN total END AS totalamount,
       coupon_status, coupon_status IN {E01_STATUS_OK} AS accepted
FROM e01_s""", ("e01_t", """
  SELECT r.order_id, r.subtotal, r.coupon_code, c.coupon_code AS code,
         (r.subtotal >= c.minPurchase_amt AND TIMESTAMP '1999-01-01 00:00:00' <= c.coupExpiry) AS valid,
         CAST(CASE WHEN r.coupon_code IS NULL THEN r.subtotal
                   WHEN c.coupon_code IS NULL THEN NULL
                   WHEN r.subtotal >= c.minPurchase_amt AND TIMESTAMP '1999-01-01 00:00:00' <= c.coupExpiry
                     THEN r.subtotal - c.coupDiscount
                   ELSE r.subtotal END AS DECIMAL(18,2)) AS total
  FROM order_requests r LEFT JOIN coupons c ON r.coupon_code = c.coupon_code"""), ("e01_s", """
  SELECT *, CASE WHEN coupon_code IS NOT NULL AND code IS NULL THEN 'unknown_coupon'
                 WHEN total IS NULL THEN 'missing_total'
                 WHEN total < 0 THEN 'negative_total'
                 WHEN coupon_code IS NULL THEN 'no_coupon'
                 WHEN valid THEN 'applied' ELSE 'not_applied' END AS coupon_status
  FROM e01_t"""))
    out["e02_stock_status"] = with_fixtures("""
SELECT Material_Id, inv_qoh, inv_reorder_level,
       CASE WHEN inv_qoh <= inv_reorder_level THEN 'Low'
            WHEN inv_qoh <= 2 * inv_reorder_level THEN 'Decent' ELSE 'High' END AS inv_stock_status
FROM inventory_details""")
    out["e03_reserve_stock"] = with_fixtures("SELECT * FROM e03_r", E03_LINES, E03_NUMBERED, E03_RESULT)
    out["e03_materials_after"] = with_fixtures("""
SELECT rm.material_Id, CAST(rm.quantity - COALESCE(u.used, 0) AS BIGINT) AS quantity
FROM raw_materials rm LEFT JOIN (SELECT Material_Id, COUNT(*) AS used FROM e03_r WHERE status = 'accepted'
                                  GROUP BY Material_Id) u ON rm.material_Id = u.Material_Id""",
                                               E03_LINES, E03_NUMBERED, E03_RESULT)
    e04 = (E04_REQ, E04_CAND, E04_OK)
    out["e04_po_accepted"] = with_fixtures("""
SELECT p_po_no AS PONo, p_po_date AS PODate, CAST(p_purchase_qty AS BIGINT) AS PurcQty, p_material_id AS Material_Id
FROM e04_ok""", *e04)
    out["e04_po_rejected"] = with_fixtures(f"""
SELECT {E04_REQ_COLS},
       CAST(CASE WHEN fail = 'material' THEN -20002 ELSE -20003 END AS INTEGER) AS error_code,
       CASE WHEN fail = 'material' THEN 'Material ID not found in RAW_MATERIALS table.'
            ELSE 'An unexpected error occurred: ' || fail END AS error_message
FROM (SELECT {E04_REQ_COLS}, fail FROM e04_f WHERE fail IS NOT NULL
      UNION ALL
      SELECT {E04_REQ_COLS}, 'unique constraint on PURCHASE_ORDER.PONo violated' FROM e04_c
      WHERE k > 1 OR taken) x""", *e04)
    out["e04_materials_after"] = with_fixtures("""
SELECT rm.material_Id, CAST(rm.quantity + COALESCE(a.added, 0) AS BIGINT) AS quantity
FROM raw_materials rm LEFT JOIN (SELECT p_material_id, SUM(p_purchase_qty) AS added FROM e04_ok
                                  GROUP BY p_material_id) a ON rm.material_Id = a.p_material_id""", *e04)
    out["e04_audit"] = with_fixtures(f"""
SELECT p_po_no AS PONo, p_material_id AS Material_Id,
       CAST(stock + SUM(p_purchase_qty) OVER (PARTITION BY p_material_id ORDER BY {E04_ORDER}
                                              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS updated_quantity
FROM e04_ok""", *e04)
    out["e05_stock_ledger"] = with_fixtures("""
SELECT e.Material_Id, e.kind, e.quantity, e.arrival_key, e.kind_rank, e.line, e.part, e.ref, w.acc AS accepted,
       CAST(w.bal AS BIGINT) AS balance
FROM walk w JOIN e05_n e ON e.Material_Id = w.Material_Id AND e.rn = w.rn""",
        E03_LINES, E03_NUMBERED, *e04, ("e05_ev", """
  SELECT Material_Id, 'reservation' AS kind, CAST(1 AS BIGINT) AS quantity, CAST(arrival_seq AS BIGINT) AS arrival_key,
         1 AS kind_rank, CAST(0 AS BIGINT) AS line, CAST(0 AS BIGINT) AS part, trackingID AS ref FROM e03_n WHERE NOT never
  UNION ALL
  SELECT p_material_id, 'receipt', CAST(p_purchase_qty AS BIGINT), arrival_order, 0, arrival_line, arrival_part,
         p_po_no FROM e04_ok"""), ("e05_n", """
  SELECT ev.*, ROW_NUMBER() OVER (PARTITION BY ev.Material_Id ORDER BY arrival_key, kind_rank, line, part, ref) AS rn
  FROM e05_ev ev JOIN raw_materials rm ON ev.Material_Id = rm.material_Id"""), ("walk", """
  SELECT material_Id AS Material_Id, CAST(0 AS BIGINT) AS rn, CAST(quantity AS BIGINT) AS bal, TRUE AS acc,
         CAST([] AS VARCHAR[]) AS taken
  FROM raw_materials
  UNION ALL
  SELECT w.Material_Id, e.rn,
         CASE WHEN e.kind = 'receipt' THEN w.bal + e.quantity
              WHEN w.bal > 0 AND NOT list_contains(w.taken, e.ref) THEN w.bal - 1 ELSE w.bal END,
         e.kind = 'receipt' OR (w.bal > 0 AND NOT list_contains(w.taken, e.ref)),
         CASE WHEN e.kind = 'reservation' AND w.bal > 0 THEN list_append(w.taken, e.ref) ELSE w.taken END
  FROM walk w JOIN e05_n e ON e.Material_Id = w.Material_Id AND e.rn = w.rn + 1"""), recursive=True)
    return out


EVENT_SQL = _event_sql()
