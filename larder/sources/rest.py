"""The other tables of the schema, and the columns that the shaped tables lack, derived by rule from the catalogue.

Each of these tables takes its rows from one driver table and a whole number of each row. A column's
value follows from the number and from the column's place in the schema (key, foreign key, prefix, value
rule, type), with some values that break a rule: every 103rd key repeats, every 211th lacks its prefix,
every 307th value is missing, every 89th reference has no parent. The expressions are SQL that Spark
and the oracle read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.catalogue import CATALOGUE, Column, Table
from larder.sources.fixtures import REFERENCE_SHAPED, Fixtures

#: table -> (driver table, number of a row); the others are shaped in ``fixtures``.
SOURCES: dict[str, tuple[str, str]] = {
    "warehouse": ("supplier", "s_suppkey"), "mcdcustomers": ("customer", "c_custkey"), "suppliers": ("supplier", "s_suppkey"),
    "employee_training": ("part", "p_partkey"), "suppliers_products": ("supplier", "s_suppkey"), "managers": ("customer", "c_custkey"),
    "supervisor": ("customer", "c_custkey"), "distribution_centers": ("supplier", "s_suppkey"),
    "dc_inventory_items": ("part", "p_partkey"), "distribution_centers_contact": ("supplier", "s_suppkey"),
    "third_party_logistics": ("supplier", "s_suppkey"), "third_party_logistics_services": ("supplier", "s_suppkey"),
    "operated_by": ("part", "p_partkey"), "non_perishable": ("part", "p_partkey"), "perishable": ("part", "p_partkey"),
    "perishable_storage": ("part", "p_partkey"), "prepares": ("lineitem", "l_partkey"), "promotions": ("part", "p_partkey"),
    "promo_offers": ("part", "p_partkey"), "marketing_campaigns": ("part", "p_partkey"), "organised_promo": ("part", "p_partkey"),
    "conducted_campaigns": ("part", "p_partkey"), "avail_coupons": ("part", "p_partkey"), "cus_order_detail": ("lineitem", "l_orderkey"),
    "training_details": ("customer", "c_custkey"), "shipment": ("orders", "o_orderkey"), "orders_to_dc": ("orders", "o_orderkey"),
    "owns": ("part", "p_partkey"), "can_supply": ("part", "p_partkey"), "crew_member": ("customer", "c_custkey"),
    "franchiseowner_phones": ("nation", "n_nationkey"),
}
#: References that keep the row's own number, so that they meet parents of the same rows.
OWN_NUMBER = {("cus_order_detail", "order_id")}
COUPON_PREFIX = "CPN"


def _prefix(table: Table, column: str) -> str:
    own = [p for c, p in table.prefixes if c == column]
    for c, parent, parent_column in table.foreign_keys:
        if c == column:
            return _prefix(CATALOGUE[parent], parent_column)
    return own[0] if own else COUPON_PREFIX if (table.name, column) == ("coupons", "coupon_code") else ""


def _plain(column: Column, k: str) -> str:
    """A value of the column's type from the number."""
    return {"s": f"concat('{column.name[:3]} ', {k})", "c": f"CASE WHEN {k} % 2 = 0 THEN 'Y' ELSE 'N' END", "i": f"CAST({k} * 37 % 110000 AS INT)",
            "m": f"CAST({k} % 1000 - 2 AS DECIMAL(18,2))", "n": f"CAST({k} % 1000 - 2 AS BIGINT)",
            "d": f"DATE '2000-01-01' + CAST({k} % 1000 AS INT)", "t": "TIMESTAMP '2000-01-01 00:00:00'"}[column.kind]


def column_sql(table: Table, column: Column, k: str) -> str:
    name = column.name
    reference = [(p, pc) for c, p, pc in table.foreign_keys if c == name]
    rules = {kind: args for c, kind, args in table.value_rules if c == name}
    prefix = _prefix(table, name)
    if table.key == (name,):
        value = f"concat('{prefix}', CASE WHEN {k} % 103 = 1 THEN {k} - 1 ELSE {k} END)"
    elif reference:
        number = k if (table.name, name) in OWN_NUMBER else f"{k} % {30 + len(name) * 7} + 1"
        value = f"CASE WHEN {k} % 89 = 2 THEN '{prefix}none' ELSE concat('{prefix}', {number}) END"
    elif prefix:
        value = f"concat('{prefix}', {k})"
    elif "in" in rules:
        value = f"CASE {k} % 3 WHEN 0 THEN '{rules['in'][0]}' WHEN 1 THEN '{rules['in'][1]}' ELSE 'n/a' END"
    elif "between" in rules:
        value = f"CAST({k} % 7 AS DECIMAL(18,2))"
    elif name in table.uniques:
        value = f"concat('mail', {k} % 499, '@example.com')"
    else:
        value = _plain(column, k)
    if prefix and any(c == name for c, _ in table.prefixes):
        value = f"CASE WHEN {k} % 211 = 3 THEN concat('?', {k}) ELSE {value} END"
    return f"CASE WHEN {k} % 307 = {5 + len(name)} THEN NULL ELSE {value} END"


def rest_columns(name: str) -> list[tuple[str, str]]:
    """(column, SQL) of a table of ``SOURCES``."""
    table = CATALOGUE[name]
    return [(c.name, column_sql(table, c, SOURCES[name][1])) for c in table.columns]


def missing_columns(name: str) -> list[tuple[str, str]]:
    """(column, SQL) of the declared columns that a shaped table lacks: one value for all rows."""
    have = {c.lower() for c in REFERENCE_SHAPED[name]}
    table = CATALOGUE[name]
    out = []
    for c in table.columns:
        if c.name.lower() not in have:
            prefix = _prefix(table, c.name)
            out.append((c.name, f"'{prefix}1_1'" if prefix else _plain(c, "12")))
    return out


def whole_table(t: Fixtures, name: str) -> DataFrame:
    """A table of the catalogue with all its declared columns."""
    if name in SOURCES:
        return t.base(SOURCES[name][0]).selectExpr(*[f"{sql} AS {c}" for c, sql in rest_columns(name)])
    return getattr(t, name).selectExpr("*", *[f"{sql} AS {c}" for c, sql in missing_columns(name)])


#: A batch over four tables, every third order: some totals are negative or missing, some franchises unknown, some
#: numbers stored or repeated, and a feedback breaks its range. (table, driver table, filter, columns as SQL)
BATCH: dict[str, tuple[str, str, tuple[tuple[str, str], ...]]] = {
    "customer_orders": ("orders", "o_orderkey % 3 = 0", (
        ("order_id", "CASE WHEN o_orderkey % 17 = 5 THEN concat('X', o_orderkey) WHEN o_orderkey % 19 = 4 THEN 'CO1' "
                     "WHEN o_orderkey % 23 = 7 THEN concat('CO', o_orderkey - 21) ELSE concat('CO', o_orderkey) END"),
        ("orderdate", "CAST(o_orderdate AS DATE)"),
        ("totalamount", "CASE WHEN o_orderkey % 11 = 2 THEN CAST(-1 AS DECIMAL(18,2)) WHEN o_orderkey % 13 <> 3 THEN CAST(o_totalprice AS DECIMAL(18,2)) END"),
        ("franchise_id", "CASE WHEN o_orderkey % 7 = 1 THEN 'FAnone' ELSE concat('FA', o_orderkey % 5 + 1) END"),
        ("cus_id", "concat('MCDC', o_custkey)"))),
    "lists": ("lineitem", "l_orderkey % 3 = 0", (
        ("order_id", "concat('CO', l_orderkey)"), ("mitemID", "CASE WHEN l_partkey % 31 = 3 THEN 'MInone' ELSE concat('MI', l_partkey) END"))),
    "customer_feedbacks": ("orders", "o_orderkey % 6 = 0", (
        ("feedbackID", "concat('FB', o_orderkey)"), ("feedback_date", "CAST(o_orderdate AS DATE)"),
        ("rating", "CAST(o_orderkey % 8 AS DECIMAL(18,2))"), ("service_used", "o_orderpriority"))),
    "feedback_info": ("orders", "o_orderkey % 3 = 0", (
        ("cus_id", "concat('MCDC', o_custkey)"), ("order_id", "concat('CO', o_orderkey)"), ("feedbackID", "concat('FB', o_orderkey)"))),
}
#: What is stored before: the other orders and their lists, and the parents.
BATCH_STORED = {"customer_orders": "order_id", "lists": "order_id"}


def feedback_batch(t: Fixtures) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The batch and the stored tables."""
    batch = {name: t.base(base).filter(cond).select(*[F.expr(sql).alias(c) for c, sql in columns])
             for name, (base, cond, columns) in BATCH.items()}
    had = {"franchise": t.franchise, "menu_items": t.menu_items}
    for name, column in BATCH_STORED.items():
        had[name] = getattr(t, name).filter(F.substring(column, 3, 20).cast("bigint") % 3 != 0)
    return batch, had


# ---------------------------------------------------------------- the tables as files with broken lines
#: What a line without a value has in a column (one-column tables would have blank lines, which readers skip).
NULL_TEXT = "NULL"


def broken_cells(table: Table) -> dict[str, tuple[str, str, str]]:
    """By the last character of the first column: (column, SQL of its broken text, reason that the scan must give).
    ``3`` and ``7`` are the lines with a field too many and too few."""
    out = {}
    for c in table.columns:
        if c.kind in "imn" and "1" not in out:
            out["1"] = (c.name, f"concat(CAST({c.name} AS STRING), '{'5' if c.kind == 'm' else '.5'}')", "too_fine")
        if c.kind in "imndt" and "9" not in out:
            out["9"] = (c.name, f"concat('x', CAST({c.name} AS STRING))",
                        {"d": "not_a_date", "t": "not_a_timestamp"}.get(c.kind, "not_a_number"))
    return out


def as_lines(t: Fixtures, name: str) -> DataFrame:
    """A table as (table_name, line) in CSV without a header, with some broken lines."""
    table = CATALOGUE[name]
    last, broken = f"right({table.columns[0].name}, 1)", broken_cells(table)
    cells = {c.name: f"CAST({c.name} AS STRING)" for c in table.columns}
    for mark, (column, text, _) in broken.items():
        cells[column] = f"CASE WHEN {last} = '{mark}' THEN {text} ELSE {cells[column]} END"
    fields = [f"'{c}', {cell}" for c, cell in cells.items()]
    write = f"map('nullValue', '{NULL_TEXT}', 'ignoreLeadingWhiteSpace', 'false', 'ignoreTrailingWhiteSpace', 'false')"
    line = f"to_csv(named_struct({', '.join(fields)}), {write})"
    more = f"concat({line}, ',more')"
    cut = f"to_csv(named_struct({', '.join(fields[:-1])}), {write})" if len(fields) > 1 else more
    return whole_table(t, name).selectExpr(
        f"'{name}' AS table_name", f"CASE WHEN {last} = '3' THEN {more} WHEN {last} = '7' THEN {cut} ELSE {line} END AS line")
