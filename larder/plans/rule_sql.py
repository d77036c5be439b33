"""SQL oracle for the data rules (C01-C13), generated per rule from the catalogue."""

from __future__ import annotations

from larder.catalogue import CATALOGUE
from larder.plans.oracle import with_fixtures
from larder.sources.fixtures import REFERENCE_SHAPED
from larder.sources.rest import BATCH, BATCH_STORED, missing_columns, rest_columns
from larder.sources.rest import SOURCES as REST

STRING_KINDS = ("s", "c")
DOUBLE_COLUMNS = {("customer", "c_acctbal"), ("events", "value"), ("orders", "o_totalprice")}


def _render(table: str, col: str) -> str:
    if (table, col) in DOUBLE_COLUMNS:
        return f"CAST(CAST({col} AS DECIMAL(38,6)) AS VARCHAR)"
    return f"CAST({col} AS VARCHAR)"


def _key(table: str, key: list[str]) -> str:
    parts = ", ".join(f"coalesce({_render(table, k)}, 'NULL')" for k in key)
    return f"concat_ws('|', {parts})"


def found(table: str, src: str, cond: str, rule: str, column: str, key: list[str], value: str | None = None) -> str:
    return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, {_key(table, key)} AS row_key, "
            f"'{column}' AS column_name, {value or _render(table, column)} AS value FROM {src} WHERE {cond}")


def primary_key(table: str, src: str, key: list[str], blank_text: set[str]) -> str:
    def blank(k):
        return f"({k} IS NULL OR {k} = '')" if k in blank_text else f"{k} IS NULL"
    label = ",".join(key)
    nulls = found(table, src, " OR ".join(blank(k) for k in key), "primary_key", label, key, "CAST(NULL AS VARCHAR)")
    cols = ", ".join(key)
    dups = (f"SELECT '{table}' AS table_name, 'primary_key' AS rule, {_key(table, key)} AS row_key, "
            f"'{label}' AS column_name, CAST(COUNT(*) AS VARCHAR) AS value FROM {src} "
            f"WHERE {' AND '.join(f'{k} IS NOT NULL' for k in key)} GROUP BY {cols} HAVING COUNT(*) > 1")
    return f"{nulls}\nUNION ALL\n{dups}"


def unique(table: str, src: str, col: str) -> str:
    return (f"SELECT '{table}' AS table_name, 'unique' AS rule, {_render(table, col)} AS row_key, "
            f"'{col}' AS column_name, CAST(COUNT(*) AS VARCHAR) AS value FROM {src} "
            f"WHERE {col} IS NOT NULL GROUP BY {col} HAVING COUNT(*) > 1")


def foreign_key(table: str, src: str, col: str, parent: str, pcol: str, key: list[str]) -> str:
    cond = f"{col} IS NOT NULL AND {col} NOT IN (SELECT {pcol} FROM {parent} WHERE {pcol} IS NOT NULL)"
    return found(table, src, cond, "foreign_key", col, key)


# The report's purchase_order input: stored orders plus the incoming request batch.
SOURCES = {"purchase_order": ("(SELECT PONo, PODate, PurcQty, Material_Id FROM purchase_order UNION ALL "
                              "SELECT p_po_no, p_po_date, p_purchase_qty, p_material_id FROM po_requests) po_all")}


SOURCES |= {name: f"rest_{name}" for name in REST}
SOURCES |= {name: f"whole_{name}" for name in REFERENCE_SHAPED if missing_columns(name)}


def whole_tables() -> list[tuple[str, str]]:
    """The tables that no job but the report reads, and the shaped ones with all their columns."""
    out = [(f"rest_{name}", "SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in rest_columns(name)) + f" FROM {base}")
           for name, (base, _) in REST.items()]
    return out + [(f"whole_{name}", "SELECT *, " + ", ".join(f"{sql} AS {c}" for c, sql in missing_columns(name)) + f" FROM {name}")
                  for name in REFERENCE_SHAPED if missing_columns(name)]


def source_of(name: str) -> str:
    """The table with all its columns, as jobs over files read it (without a batch)."""
    return name if name == "purchase_order" else SOURCES.get(name, name)


def _declared(name: str) -> tuple[str, ...]:
    """All columns of a whole table, as they are named there."""
    own = REFERENCE_SHAPED.get(name, ())
    return (*own, *(c for c, _ in (missing_columns(name) if own else rest_columns(name))))


def table_rules(name: str, columns: tuple[str, ...], present: set[str]) -> list[str]:
    t = CATALOGUE[name]
    src = SOURCES.get(name, name)
    have = {c.lower(): c for c in columns}
    key = [have[k.lower()] for k in t.key] if t.key and all(k.lower() in have for k in t.key) else list(columns)
    out = []
    for col in t.columns:
        c = have.get(col.name.lower())
        if c is None:
            continue
        if not col.nullable or col.name in t.key:
            cond = f"({c} IS NULL OR {c} = '')" if col.kind in STRING_KINDS else f"{c} IS NULL"
            out.append(found(name, src, cond, "not_null", c, key))
        if col.kind in STRING_KINDS and col.width:
            out.append(found(name, src, f"strlen({c}) > {col.width}", "max_length", c, key))
        if col.kind == "i" and col.width:
            out.append(found(name, src, f"abs({c}) >= {10 ** col.width}", "precision", c, key))
    for column, prefix in t.prefixes:
        c = have.get(column.lower())
        if c:
            out.append(found(name, src, f"NOT starts_with({c}, '{prefix}')", "prefix", c, key))
    for column, kind, args in t.value_rules:
        c = have.get(column.lower())
        if not c:
            continue
        cond = {"min": f"{c} < {args[0]}" if kind == "min" else "",
                "between": f"NOT ({c} BETWEEN {args[0]} AND {args[-1]})",
                "in": f"{c} NOT IN ({', '.join(repr(a) for a in args)})"}[kind]
        out.append(found(name, src, cond, kind, c, key))
    if t.key and all(k.lower() in have for k in t.key):
        blank_text = {have[col.name.lower()] for col in t.columns
                      if col.kind in STRING_KINDS and col.name.lower() in have}
        out.append(primary_key(name, src, key, blank_text))
    for column in t.uniques:
        if column.lower() in have:
            out.append(unique(name, src, have[column.lower()]))
    for column, parent, pcol in t.foreign_keys:
        if column.lower() in have and parent in present:
            pc = {c.lower(): c for c in _declared(parent)}[pcol.lower()]
            out.append(foreign_key(name, src, have[column.lower()], SOURCES.get(parent, parent), pc, key))
    return out


def constraint_report_sql() -> str:
    parts = [sql for name in CATALOGUE for sql in table_rules(name, _declared(name), set(CATALOGUE))]
    body = ("SELECT table_name, rule, CAST(COUNT(*) AS BIGINT) AS violations FROM (\n"
            + "\nUNION ALL\n".join(parts) + "\n) v GROUP BY table_name, rule")
    return with_fixtures(body, *whole_tables())


def _simple() -> dict[str, str]:
    out = {
        "c01_not_null": with_fixtures(found("delivery_details", "delivery_details", "DeliveryDate IS NULL", "not_null",
                                            "DeliveryDate", ["Franchise_ID", "trackingID", "confirmationCode"])),
        "c02_primary_key": primary_key("lineitem", "lineitem", ["l_orderkey"], set()),
        "c03_primary_key_composite": primary_key("lineitem", "lineitem", ["l_orderkey", "l_linenumber"], set()),
        "c04_unique": unique("part", "part", "p_name"),
        "c05_foreign_key": with_fixtures(foreign_key("po_requests", "po_requests", "p_material_id", "raw_materials",
                                                     "material_Id", ["arrival_order", "arrival_line", "arrival_part"])),
        "c06_prefix": found("part", "part", "NOT starts_with(p_type, 'S')", "prefix", "p_type", ["p_partkey"]),
        "c07_min": found("customer", "customer", "c_acctbal < 0", "min", "c_acctbal", ["c_custkey"]),
        "c08_between": found("events", "events", "NOT (value BETWEEN 1 AND 5)", "between", "value", ["event_id"]),
        "c09_in": found("orders", "orders", "o_orderstatus NOT IN ('F', 'O')", "in", "o_orderstatus", ["o_orderkey"]),
        "c10_max_length": found("part", "part", "strlen(p_name) > 10", "max_length", "p_name", ["p_partkey"]),
        "c11_precision": found("orders", "orders", "abs(o_totalprice) >= 100000", "precision", "o_totalprice",
                               ["o_orderkey"]),
        "c12_constraint_report": constraint_report_sql(),
    }
    batch = ("SELECT p_po_no AS PONo, p_po_date AS PODate, p_purchase_qty AS PurcQty, p_material_id AS Material_Id, "
             "arrival_order, arrival_line, arrival_part FROM po_requests")
    reasons = ("SELECT b.*, "
               "list_filter([CASE WHEN b.PONo IS NULL OR b.PONo = '' THEN 'not_null(PONo)' END, "
               "CASE WHEN strlen(b.PONo) > 16 THEN 'max_length(PONo)' END, "
               "CASE WHEN b.PODate IS NULL THEN 'not_null(PODate)' END, "
               "CASE WHEN b.PurcQty IS NULL THEN 'not_null(PurcQty)' END, "
               "CASE WHEN strlen(b.Material_Id) > 16 THEN 'max_length(Material_Id)' END, "
               "CASE WHEN NOT starts_with(b.PONo, 'PO') THEN 'prefix(PONo)' END, "
               "CASE WHEN b.Material_Id IS NOT NULL AND b.Material_Id NOT IN (SELECT material_Id FROM raw_materials) "
               "THEN 'foreign_key(Material_Id)' END], lambda x: x IS NOT NULL) AS other FROM batch b")
    # the key is judged last: the first valid row of each number has it
    keyed = ("SELECT *, CASE WHEN len(other) > 0 THEN other ELSE list_filter(["
             "CASE WHEN PONo IN (SELECT PONo FROM purchase_order) THEN 'key_exists(PONo)' END, "
             "CASE WHEN ROW_NUMBER() OVER (PARTITION BY PONo, len(other) = 0 "
             "ORDER BY arrival_order, arrival_line, arrival_part, Material_Id, PurcQty, PODate) > 1 THEN 'primary_key(PONo)' END], "
             "lambda x: x IS NOT NULL) END AS why FROM flagged")
    ctes = (("batch", batch), ("flagged", reasons), ("keyed", keyed))
    out["c13_quarantine_rejected"] = with_fixtures(
        "SELECT PONo, PODate, PurcQty, Material_Id, array_to_string(list_sort(why), '; ') AS reasons FROM keyed "
        "WHERE len(why) > 0", *ctes)
    out["c13_quarantine_accepted"] = with_fixtures(
        "SELECT PONo, PODate, PurcQty, Material_Id FROM keyed WHERE len(why) = 0", *ctes)
    return out


def batch_sql() -> str:
    """The batch over four tables, judged one after the other: each CTE of a child reads its parents' verdicts."""
    ctes = [(f"in_{name}", "SELECT *, row_number() OVER () AS row FROM (SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in columns)
             + f" FROM {base} WHERE {cond})") for name, (base, cond, columns) in BATCH.items()]
    stored = {name: f"(SELECT * FROM {name} WHERE CAST({c}[3:] AS BIGINT) % 3 <> 0)" for name, c in BATCH_STORED.items()}
    out = []
    for name, (_, _, columns) in BATCH.items():
        t = CATALOGUE[name]
        have = [c for c, _ in columns]
        why = [(f"not_null({c})", f"{c} IS NULL OR CAST({c} AS VARCHAR) = ''") for c in have if not t.column(c).nullable or c in t.key]
        why += [(f"max_length({c})", f"strlen({c}) > {t.column(c).width}") for c in have if t.column(c).kind == "s"]
        why += [(f"prefix({c})", f"NOT starts_with({c}, '{p}')") for c, p in t.prefixes if c in have]
        why += [(f"{k}({c})", f"{c} < {a[0]}" if k == "min" else f"NOT ({c} BETWEEN {a[0]} AND {a[1]})") for c, k, a in t.value_rules if c in have]
        for c, parent, pc in t.foreign_keys:
            if parent in BATCH:
                known = f"SELECT {pc} FROM ok_{parent}" + (f" UNION ALL SELECT {pc} FROM {stored[parent]}" if parent in stored else "")
            elif parent in ("franchise", "menu_items"):
                known = f"SELECT {pc} FROM {parent}"
            else:
                continue
            why.append((f"foreign_key({c})", f"{c} IS NOT NULL AND {c} NOT IN (SELECT {pc} FROM ({known}) WHERE {pc} IS NOT NULL)"))
        cases = ", ".join(f"CASE WHEN {cond} THEN '{label}' END" for label, cond in why)
        ctes.append((f"why_{name}", f"SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL) AS other FROM in_{name}"))
        keys, last = ", ".join(t.key), "list_filter([CAST(NULL AS VARCHAR)], lambda x: x IS NOT NULL)"
        if t.key:
            order = ", ".join([*(["orderdate"] if name == "customer_orders" else []), *have, "row"])
            held = f"CASE WHEN ({keys}) IN (SELECT ({keys}) FROM {stored[name]}) THEN 'key_exists({','.join(t.key)})' END" if name in stored else "NULL"
            last = (f"list_filter([CASE WHEN ROW_NUMBER() OVER (PARTITION BY {keys}, len(other) = 0 ORDER BY {order}) > 1 "
                    f"THEN 'primary_key({','.join(t.key)})' END, {held}], lambda x: x IS NOT NULL)")
        ctes.append((f"all_{name}", f"SELECT *, CASE WHEN len(other) > 0 THEN other ELSE {last} END AS why FROM why_{name}"))
        ctes.append((f"ok_{name}", f"SELECT * FROM all_{name} WHERE len(why) = 0"))
        cols = [c.name for c in t.columns if c.name in have]
        out.append(f"SELECT '{name}' AS table_name, {_key(name, cols)} AS row_key, "
                   f"CASE WHEN len(why) > 0 THEN array_to_string(list_sort(why), '; ') END AS reasons FROM all_{name}")
    return with_fixtures("\nUNION ALL\n".join(out), *ctes)


RULE_SQL = _simple() | {"c13_batch": batch_sql()}
