"""SQL oracle for sources/sinks (S01-S05) and the streaming jobs (E06-E08): the batch
result each must reproduce."""

from __future__ import annotations

from larder.catalogue import CATALOGUE
from larder.plans import rule_sql
from larder.plans.oracle import E03_LINES, E03_NUMBERED, E03_RESULT, E04_CAND, E04_OK, E04_REQ, EVENT_SQL, with_fixtures
from larder.sources.rest import broken_cells

E04 = (E04_REQ, E04_CAND, E04_OK)



def all_tables_sql() -> str:
    """What the scan of each table's file must find: a cell without a value cannot be broken."""
    parts = []
    for name, table in CATALOGUE.items():
        columns = [c.name for c in table.columns]
        broken = [(mark, c, why) for mark, (c, _, why) in broken_cells(table).items()]
        outcome = "".join(f" WHEN last = '{mark}' AND {c} IS NOT NULL THEN '{why}'" for mark, c, why in broken)
        column = "".join(f" WHEN last = '{mark}' AND {c} IS NOT NULL THEN '{c}'" for mark, c, _ in broken)
        filled = " + ".join(f"CAST({c} IS NOT NULL AS BIGINT)" for c in columns)
        parts.append(f"SELECT '{name}' AS table_name, CASE WHEN last IN ('3', '7') THEN NULL{column} END AS column_name, "
                     f"CASE WHEN last IN ('3', '7') THEN 'fields'{outcome} ELSE 'accepted' END AS outcome, {filled} AS filled "
                     f"FROM (SELECT {', '.join(columns)}, right({columns[0]}, 1) AS last FROM {rule_sql.source_of(name)})")
    return with_fixtures("SELECT table_name, column_name, outcome, COUNT(*) AS n_rows, "
                         "CAST(SUM(CASE WHEN outcome = 'accepted' THEN filled ELSE 0 END) AS BIGINT) AS n_filled FROM (\n"
                         + "\nUNION ALL\n".join(parts) + "\n) GROUP BY table_name, column_name, outcome", *rule_sql.whole_tables())


SOURCE_AND_STREAM_SQL = {
    "s01_all_tables": all_tables_sql(),
    "s01_typed_scan": with_fixtures(
        "SELECT material_Id, materialName, typeofMaterial, cold_storage, quantity FROM raw_materials"),
    "s01_accepted": with_fixtures(
        "SELECT material_Id, materialName, typeofMaterial, cold_storage, quantity FROM raw_materials "
        "WHERE CAST(material_Id[3:] AS BIGINT) % 7 <> 0"),
    "s01_refused": with_fixtures(
        "SELECT material_Id, materialName, typeofMaterial, cold_storage, CAST(quantity AS VARCHAR) || '.5' AS quantity, "
        "'quantity: too_fine' AS reasons FROM raw_materials WHERE CAST(material_Id[3:] AS BIGINT) % 7 = 0"),
    "s02_append": with_fixtures("""
SELECT PONo, PODate, PurcQty, Material_Id FROM purchase_order
UNION ALL
SELECT p_po_no, p_po_date, CAST(p_purchase_qty AS BIGINT), p_material_id FROM e04_ok""", *E04),
    "s03_apply_delta": with_fixtures("""
SELECT rm.material_Id, rm.materialName, rm.typeofMaterial, rm.cold_storage,
       CAST(rm.quantity - COALESCE(u.used, 0) AS BIGINT) AS quantity
FROM raw_materials rm LEFT JOIN (SELECT Material_Id, COUNT(*) AS used FROM e03_r WHERE status = 'accepted'
                                  GROUP BY Material_Id) u ON rm.material_Id = u.Material_Id""",
                                     E03_LINES, E03_NUMBERED, E03_RESULT),
    "s04_enrich": with_fixtures("""
SELECT r.order_id, r.subtotal, r.coupon_code, c.minPurchase_amt, c.coupExpiry, c.coupDiscount
FROM order_requests r LEFT JOIN coupons c ON r.coupon_code = c.coupon_code"""),
    "s05_audit": with_fixtures("""
SELECT PONo, 1 AS line, 'Purchase Order Processed Successfully: ' || PONo AS message FROM audit
UNION ALL
SELECT PONo, 2, 'Material ID: ' || Material_Id || ' Updated Quantity: ' || CAST(updated_quantity AS VARCHAR)
FROM audit""", *E04, ("audit", """
  SELECT p_po_no AS PONo, p_material_id AS Material_Id,
         CAST(stock + SUM(p_purchase_qty) OVER (PARTITION BY p_material_id
              ORDER BY arrival_order, arrival_line, arrival_part, p_material_id, p_purchase_qty, p_po_date ROWS UNBOUNDED PRECEDING) AS BIGINT)
           AS updated_quantity
  FROM e04_ok""")),
    "e06_coupon_totals_stream": EVENT_SQL["e01_coupon_totals"],
    "e07_stock_status_stream": EVENT_SQL["e02_stock_status"],
    "e08_reserve_stock_stream": EVENT_SQL["e03_reserve_stock"],
}
