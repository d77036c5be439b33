"""Data rules of the reference schema as violation finders.

Every finder returns rows ``(table_name, rule, row_key, column_name, value)``:
row-level rules (NOT NULL, prefix, minimum, range, value list, byte length, digits) are
fused into one projection per table, so a table is scanned once for all of them; keys,
UNIQUE and foreign keys are aggregates or anti joins (partial aggregation absorbs a hot
key; AQE splits a skewed anti-join partition).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.catalogue import CATALOGUE, Table
from larder.operators.ordinal import kept

VIOLATION_COLUMNS = ("table_name", "rule", "row_key", "column_name", "value")


def render(df: DataFrame, name: str) -> Column:
    """A value as text: floating point through decimal(38,6), everything else as cast."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = c.cast("decimal(38,6)")
    return c.cast("string")


def row_key(df: DataFrame, key: Sequence[str] | None) -> Column:
    """Key parts joined by ``|``; a NULL part reads ``NULL``, so the place of each part stays known."""
    cols = list(key) if key else df.columns
    return F.concat_ws("|", *[F.coalesce(render(df, k), F.lit("NULL")) for k in cols])


def _found(df: DataFrame, table: str, cond: Column, rule: str, column: str, key: Sequence[str] | None,
           value: Column | None = None) -> DataFrame:
    return df.filter(cond).select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                                  row_key(df, key).alias("row_key"), F.lit(column).alias("column_name"),
                                  (render(df, column) if value is None else value).alias("value"))


def _blank(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return c.isNull() | (c == "")  # the dialect stores '' as NULL
    return c.isNull()


def valued(df: DataFrame) -> DataFrame:
    """The same rows with empty text as NULL, as the dialect stores it: every rule reads this."""
    return df.select(*[F.when(F.col(f"`{f.name}`") != "", F.col(f"`{f.name}`")).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


# ---------------------------------------------------------------- single rules
def check_not_null(df: DataFrame, table: str, cols: Sequence[str], key: Sequence[str] | None = None) -> DataFrame:
    """NULL (or empty text) in a NOT NULL column."""
    df = valued(df)
    missing = F.filter(F.array(*[F.when(_blank(df, c), F.lit(c)) for c in cols]), lambda c: c.isNotNull())
    return df.select(row_key(df, key).alias("row_key"), F.explode(missing).alias("column_name")).select(  # one scan
        F.lit(table).alias("table_name"), F.lit("not_null").alias("rule"), "row_key", "column_name",
        F.lit(None).cast("string").alias("value"))


def check_primary_key(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """A key part is NULL (one row per row) or a key value repeats (one row per key,
    value = number of rows)."""
    df = valued(df)
    label = ",".join(key)
    nulls = _found(df, table, F.greatest(*[_blank(df, k) for k in key]) if len(key) > 1 else _blank(df, key[0]),
                   "primary_key", label, key, value=F.lit(None).cast("string"))
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    for k in key:
        counted = counted.filter(F.col(k).isNotNull())
    dups = counted.select(F.lit(table).alias("table_name"), F.lit("primary_key").alias("rule"),
                          row_key(counted, key).alias("row_key"), F.lit(label).alias("column_name"),
                          F.col("_n").cast("string").alias("value"))
    return nulls.unionByName(dups)


def check_unique(df: DataFrame, table: str, column: str) -> DataFrame:
    """A non-key value that repeats (NULLs exempt); one row per value."""
    df = valued(df)
    counted = (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
               .filter(F.col("_n") > 1))
    return counted.select(F.lit(table).alias("table_name"), F.lit("unique").alias("rule"),
                          render(counted, column).alias("row_key"), F.lit(column).alias("column_name"),
                          F.col("_n").cast("string").alias("value"))


def check_foreign_key(child: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str,
                      key: Sequence[str] | None = None) -> DataFrame:
    """A non-NULL child value with no parent row."""
    child, parent = valued(child), valued(parent)
    keys = parent.select(F.col(parent_column).alias("_pk")).filter(F.col("_pk").isNotNull())
    orphans = child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_pk"), "left_anti")
    return _found(orphans, table, F.lit(True), "foreign_key", column, key)


def check_prefix(df: DataFrame, table: str, column: str, prefix: str, key: Sequence[str] | None = None) -> DataFrame:
    """``LIKE 'prefix%'`` fails (case-sensitive; NULL passes)."""
    df = valued(df)
    return _found(df, table, ~F.col(column).startswith(prefix), "prefix", column, key)


def check_min(df: DataFrame, table: str, column: str, low=0, key: Sequence[str] | None = None) -> DataFrame:
    """Value below the minimum (NULL passes)."""
    df = valued(df)
    return _found(df, table, F.col(column) < low, "min", column, key)


def check_between(df: DataFrame, table: str, column: str, low, high, key: Sequence[str] | None = None) -> DataFrame:
    """Value outside the inclusive range (NULL passes)."""
    df = valued(df)
    return _found(df, table, ~F.col(column).between(low, high), "between", column, key)


def check_in(df: DataFrame, table: str, column: str, values: Sequence, key: Sequence[str] | None = None) -> DataFrame:
    """Value outside the list (NULL passes)."""
    df = valued(df)
    return _found(df, table, ~F.col(column).isin(*values), "in", column, key)


def check_max_length(df: DataFrame, table: str, column: str, width: int,
                     key: Sequence[str] | None = None) -> DataFrame:
    """Text longer than the declared number of bytes."""
    df = valued(df)
    return _found(df, table, F.octet_length(column) > width, "max_length", column, key)


def check_precision(df: DataFrame, table: str, column: str, digits: int,
                    key: Sequence[str] | None = None) -> DataFrame:
    """C11: number with more integer digits than declared."""
    df = valued(df)
    return _found(df, table, F.abs(F.col(column)) >= 10 ** digits, "precision", column, key)


# ---------------------------------------------------------------- catalogue-driven
def _row_conditions(df: DataFrame, table: Table) -> list[tuple[str, str, Column]]:
    present = {c.lower(): c for c in df.columns}
    out: list[tuple[str, str, Column]] = []
    for col in table.columns:
        name = present.get(col.name.lower())
        if name is None:
            continue
        if not col.nullable or col.name in table.key:
            out.append(("not_null", name, _blank(df, name)))
        if col.kind in ("s", "c") and col.width:
            out.append(("max_length", name, F.octet_length(name) > col.width))
        if col.kind == "i" and col.width:
            out.append(("precision", name, F.abs(F.col(name)) >= 10 ** col.width))
    for column, prefix in table.prefixes:
        name = present.get(column.lower())
        if name:
            out.append(("prefix", name, ~F.col(name).startswith(prefix)))
    for column, kind, args in table.value_rules:
        name = present.get(column.lower())
        if not name:
            continue
        c = F.col(name)
        cond = {"min": lambda: c < args[0], "between": lambda: ~c.between(*args), "in": lambda: ~c.isin(*args)}[kind]()
        out.append((kind, name, cond))
    return out


def _key_of(df: DataFrame, table: Table) -> list[str] | None:
    present = {c.lower(): c for c in df.columns}
    key = [present.get(k.lower()) for k in table.key]
    return key if key and all(key) else None


def row_rules(df: DataFrame, table: Table) -> DataFrame:
    """All row-level rules of ``table`` over ``df`` in one pass."""
    df = valued(df)
    conds = _row_conditions(df, table)
    key = _key_of(df, table)
    if not conds:
        return df.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in VIOLATION_COLUMNS))
    hits = F.filter(F.array(*[
        F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("column_name"),
                              render(df, name).alias("value")))
        for rule, name, cond in conds]), lambda x: x.isNotNull())
    return (df.select(row_key(df, key).alias("row_key"), F.explode(hits).alias("_v"))
            .select(F.lit(table.name).alias("table_name"), F.col("_v.rule").alias("rule"), "row_key",
                    F.col("_v.column_name").alias("column_name"), F.col("_v.value").alias("value")))


def table_violations(df: DataFrame, table: Table, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Every rule of ``table`` that can be checked with the columns and parents at hand."""
    df = valued(df)
    present = {c.lower(): c for c in df.columns}
    out = row_rules(df, table)
    key = _key_of(df, table)
    if key:
        out = out.unionByName(check_primary_key(df, table.name, key))
    for column in table.uniques:
        if column.lower() in present:
            out = out.unionByName(check_unique(df, table.name, present[column.lower()]))
    for column, parent, parent_column in table.foreign_keys:
        if column.lower() in present and parent in parents:
            pdf = parents[parent]
            pcol = {c.lower(): c for c in pdf.columns}.get(parent_column.lower())
            if pcol:
                out = out.unionByName(check_foreign_key(df, table.name, present[column.lower()], pdf, pcol, key))
    return out


class _Tags:
    """Numbers for what a report counts: rules of rows, and sets of keys that rows hold or refer to."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, str]] = []  # (table, rule) of rules of single rows
        self.keys: dict[tuple, int] = {}        # (table, columns) -> number of the key set
        self.repeats: dict[int, tuple[str, str]] = {}  # key set -> (table, rule) that repeated keys break
        self.users: dict[int, list[str]] = {}   # key set -> tables of the foreign keys that refer to it

    def key_set(self, table: str, columns: Sequence[str]) -> int:
        return self.keys.setdefault((table, tuple(c.lower() for c in columns)), len(self.keys))


def _key_text(names: Sequence[str]) -> Column:
    """Key values as one text; the parts of a longer key carry their lengths, so no two keys read alike."""
    if len(names) == 1:
        return F.col(names[0]).cast("string")
    parts = [F.concat(F.octet_length(F.col(n).cast("string")).cast("string"), F.lit(":"), F.col(n).cast("string")) for n in names]
    full = F.lit(True)
    for n in names:
        full = full & F.col(n).isNotNull()
    return F.when(full, F.concat(*parts))


def _tagged(df: DataFrame, table: Table, parents: Mapping[str, DataFrame], tags: _Tags) -> DataFrame:
    """Everything that the report needs of a table, in one pass: (kind, number, key, slot). A row gives one entry for
    each rule it breaks (kind 0, number of the rule) and one for each key it holds (kind 1, slot 0) or
    refers to (slot: place of the foreign key among those of the key set)."""
    df = valued(df)
    present = {c.lower(): c for c in df.columns}
    entries: list[Column] = []

    def entry(kind: int, number: int, key: Column, slot: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(number).alias("number"), key.alias("key"), F.lit(slot).alias("slot"))

    conds = [(rule, cond) for rule, _, cond in _row_conditions(df, table)]
    key = _key_of(df, table)
    if key:
        blank = [_blank(df, k) for k in key]
        conds.append(("primary_key", F.greatest(*blank) if len(blank) > 1 else blank[0]))
    for rule, cond in conds:
        tags.rules.append((table.name, rule))
        entries.append(F.when(cond, entry(0, len(tags.rules) - 1, F.lit(None).cast("string"), 0)))
    held = {tuple(k.lower() for k in table.key): "primary_key"} if key else {}
    held.update({(u.lower(),): "unique" for u in table.uniques if u.lower() in present})
    referred = {(p, pc.lower()) for t in CATALOGUE.values() for _, p, pc in t.foreign_keys}
    for columns in {*held, *((pc,) for p, pc in referred if p == table.name and pc in present)}:
        number = tags.key_set(table.name, columns)
        if columns in held:
            tags.repeats[number] = (table.name, held[columns])
        text = _key_text([present[c] for c in columns])
        entries.append(F.when(text.isNotNull(), entry(1, number, text, 0)))
    for column, parent, parent_column in table.foreign_keys:
        if column.lower() in present and parent in parents and parent_column.lower() in {c.lower() for c in parents[parent].columns}:
            number = tags.key_set(parent, [parent_column])
            users = tags.users.setdefault(number, [])
            users.append(table.name)
            text = _key_text([present[column.lower()]])
            entries.append(F.when(text.isNotNull(), entry(1, number, text, len(users))))
    # the empty entries are dropped after the explode: a lambda over the array would run interpreted, row by row
    return df.select(F.explode(F.array(*entries)).alias("e")).filter(F.col("e").isNotNull()).select("e.*")


def constraint_report(tables: Mapping[str, DataFrame], catalogue: Mapping[str, Table] = CATALOGUE) -> DataFrame:
    """Violation count per table and rule over a set of tables (rules with none are left
    out). Counts equal the rows ``table_violations`` would return. Rules that the tables at hand
    cannot check, those of absent tables included, are counted as ``unchecked``.

    Each table is read once. All keys, UNIQUE columns and foreign keys meet in one exchange of (key set, key),
    partly summed where they are read: a key's holders and, for each foreign key, its users stand in one
    row, which says whether the key repeats and which users have no holder.
    """
    tags = _Tags()
    spark = next(iter(tables.values())).sparkSession
    parts = [_tagged(df, catalogue[name], tables, tags) for name, df in tables.items()]
    while len(parts) > 1:  # in pairs: the plan stays shallow
        parts = [a.union(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
    entries = parts[0]
    slots = range(1 + max([0, *map(len, tags.users.values())]))
    per_key = entries.groupBy("kind", "number", "key").agg(
        *[F.sum((F.col("slot") == i).cast("long")).alias(f"n{i}") for i in slots])
    lone = F.col("n0") == 0
    sums = per_key.groupBy("kind", "number").agg(
        F.sum("n0").alias("rows"), F.sum((F.col("n0") > 1).cast("long")).alias("repeated"),
        *[F.sum(F.when(lone, F.col(f"n{i}")).otherwise(0)).alias(f"lone{i}") for i in slots[1:]])
    # what the numbers stand for: a row for each rule of the catalogue
    meaning = [(0, i, "rows", table, rule) for i, (table, rule) in enumerate(tags.rules)]
    meaning += [(1, i, "repeated", table, rule) for i, (table, rule) in tags.repeats.items()]
    meaning += [(1, i, f"lone{j}", table, "foreign_key") for i, users in tags.users.items() for j, table in enumerate(users, 1)]
    named = spark.createDataFrame(meaning, "kind int, number int, measure string, table_name string, rule string")
    measures = ["rows", "repeated", *[f"lone{i}" for i in slots[1:]]]
    long = sums.select("kind", "number", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in measures])).alias("m")).select("kind", "number", "m.*")
    allv = long.join(named, ["kind", "number", "measure"]).select("table_name", "rule", "n")
    left = [(name, "unchecked", len(unchecked_rules(tables.get(name), table, tables))) for name, table in catalogue.items()]
    allv = allv.unionByName(spark.createDataFrame(left, "table_name string, rule string, n long"))  # one row a table
    return (allv.groupBy("table_name", "rule").agg(F.sum("n").cast("long").alias("violations"))
            .filter(F.col("violations") > 0))


def unchecked_rules(df: DataFrame | None, table: Table, parents: Mapping[str, DataFrame]) -> list[str]:
    """Rules of ``table`` (None: no such table at hand) that the columns and parents cannot check."""
    present = {c.lower() for c in df.columns} if df is not None else set()
    out = [f"column({c.name})" for c in table.columns if c.name.lower() not in present]
    if table.key and not all(k.lower() in present for k in table.key):
        out.append(f"primary_key({','.join(table.key)})")
    out += [f"prefix({c})" for c, _ in table.prefixes if c.lower() not in present]
    out += [f"{kind}({c})" for c, kind, _ in table.value_rules if c.lower() not in present]
    out += [f"unique({c})" for c in table.uniques if c.lower() not in present]
    for column, parent, parent_column in table.foreign_keys:
        there = parent in parents and parent_column.lower() in {c.lower() for c in parents[parent].columns}
        if column.lower() not in present or not there:
            out.append(f"foreign_key({column})")
    return out


class Split(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame  # batch columns + reasons (sorted, '; '-joined)


def quarantine(batch: DataFrame, table: Table, parents: Mapping[str, DataFrame],
               existing: DataFrame | None = None, order: Sequence[str] = ()) -> Split:
    """Split an incoming batch by every rule of its table.

    The key is judged last, over the rows that pass all other rules: of equal keys the first by
    ``order`` (then by the columns of the batch) is accepted, unless ``existing`` has the key. The
    split is stored once, so both outputs are of one run.
    """
    present = {c.lower(): c for c in batch.columns}
    staged = valued(batch)
    reasons: list[Column] = [F.when(cond, F.lit(f"{rule}({name})")) for rule, name, cond in _row_conditions(staged, table)]
    for j, (column, parent, parent_column) in enumerate(table.foreign_keys):
        if column.lower() not in present or parent not in parents:
            continue
        pdf = valued(parents[parent])
        pcol = {c.lower(): c for c in pdf.columns}.get(parent_column.lower())
        if pcol is None:
            continue
        ok = pdf.select(F.col(pcol).alias(f"_p{j}")).filter(F.col(f"_p{j}").isNotNull()).distinct()
        name = present[column.lower()]
        bare = staged.filter(F.col(name).isNull())  # NULL keys do not meet the join
        staged = staged.filter(F.col(name).isNotNull()).join(ok, F.col(name) == F.col(f"_p{j}"), "left").unionByName(
            bare, allowMissingColumns=True)
        reasons.append(F.when(F.col(name).isNotNull() & F.col(f"_p{j}").isNull(), F.lit(f"foreign_key({name})")))
    found = F.filter(F.array(*reasons), lambda x: x.isNotNull()) if reasons else F.array().cast("array<string>")
    staged = kept(staged.select(*batch.columns, found.alias("_why"), F.monotonically_increasing_id().alias("_id")))
    key = _key_of(batch, table)
    if key:
        places = [*order, *batch.columns]
        place = F.struct(*[x for i, c in enumerate(places) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}"))],
                         F.col("_id").alias("_id"))
        fit = staged.filter(F.size("_why") == 0)
        first = fit.groupBy(*key).agg(F.min(place).alias("_place")).select(F.col("_place._id").alias("_first"))
        judged = fit.join(first, F.col("_id") == F.col("_first"), "left")
        why = [F.when(F.col("_first").isNull(), F.lit(f"primary_key({','.join(key)})"))]
        if existing is not None:
            old = valued(existing).select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(key)]).dropna("any").distinct()
            judged = judged.join(old, [F.col(k) == F.col(f"_e{i}") for i, k in enumerate(key)], "left")
            why.append(F.when(F.col("_e0").isNotNull(), F.lit(f"key_exists({','.join(key)})")))
        judged = judged.select(*batch.columns, F.filter(F.array(*why), lambda x: x.isNotNull()).alias("_why"))
        staged = kept(judged.unionByName(staged.filter(F.size("_why") > 0).select(*batch.columns, "_why")))
    accepted = staged.filter(F.size("_why") == 0).select(*batch.columns)
    rejected = staged.filter(F.size("_why") > 0).select(
        *batch.columns, F.concat_ws("; ", F.array_sort("_why")).alias("reasons"))
    return Split(accepted, rejected)


def quarantine_batch(batch: Mapping[str, DataFrame], existing: Mapping[str, DataFrame],
                     order: Mapping[str, Sequence[str]] | None = None, catalogue: Mapping[str, Table] = CATALOGUE) -> dict[str, Split]:
    """C13 for a batch over several tables: a split of each, by name.

    Tables are judged in the order of the schema, in which a parent stands before its children, and each verdict is
    handed down: a row's parents are the stored rows and those that the batch itself got accepted, so a child
    of a rejected parent is rejected with it, and a child of a parent of the same batch passes. Foreign keys to
    tables that are in neither are not judged. ``order``: columns by which the first of equal keys is taken.
    """
    out: dict[str, Split] = {}
    parents: dict[str, DataFrame] = dict(existing)
    for name, table in catalogue.items():
        if name not in batch:
            continue
        out[name] = quarantine(batch[name], table, parents, existing.get(name), (order or {}).get(name, ()))
        wanted = [c for c in batch[name].columns if name not in existing or c in existing[name].columns]
        accepted = out[name].accepted.select(*wanted)
        parents[name] = accepted if name not in existing else existing[name].select(*wanted).unionByName(accepted)
    return out
