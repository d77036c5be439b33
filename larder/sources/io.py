"""Sources and sinks.

Plain files have no MERGE and no multi-file transaction. An appended batch has a directory of its
own, so a replay replaces it. A changed table is written to a new directory and published by one
small pointer file a version, written last: a crash before it leaves the old version in place and
no name in the way of the next attempt. Several tables share one pointer, so they change
together. All paths live below the cluster's shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.catalogue import CATALOGUE
from larder.operators.rules import quarantine
from larder.operators.shaping import spread_nulls

POINTERS = "versions"
EXACT = T.DecimalType(38, 10)


# ---------------------------------------------------------------- S01
#: Reasons of refused cells; a line with another number of fields than its file has columns is refused as a whole.
FIELDS, NO_NUMBER, TOO_FINE, OUT_OF_RANGE = "fields", "not_a_number", "too_fine", "out_of_range"
OTHER_REASONS = {T.DateType: "not_a_date", T.TimestampNTZType: "not_a_timestamp"}


def _typed(value: str, kind: T.DataType) -> tuple[str, str | None]:
    """SQL of the value in its declared type, and of the reason if it does not fit (text always does): numbers must come
    through the cast unchanged, so a fraction in a whole number or a third decimal place is refused."""
    if isinstance(kind, T.StringType):
        return f"CAST({value} AS STRING)", None
    if not isinstance(kind, (T.IntegerType, T.LongType, T.DecimalType)):
        cast = f"try_cast({value} AS {kind.simpleString()})"
        return cast, f"CASE WHEN {value} IS NOT NULL AND {cast} IS NULL THEN '{OTHER_REASONS[type(kind)]}' END"
    exact = f"try_cast({value} AS {EXACT.simpleString()})"
    fits = f"try_cast({exact} AS {kind.simpleString()})"
    places = kind.scale if isinstance(kind, T.DecimalType) else 0
    return (f"CASE WHEN {fits} = {exact} THEN {fits} END",
            f"CASE WHEN {value} IS NULL OR {fits} = {exact} THEN NULL WHEN try_cast({value} AS DOUBLE) IS NULL THEN '{NO_NUMBER}' "
            f"WHEN round({exact}, {places}) <> {exact} THEN '{TOO_FINE}' ELSE '{OUT_OF_RANGE}' END")


def _as_written(spark: SparkSession, path: str, fmt: str, strict: bool, columns: Sequence[str] | None,
                options: Mapping[str, str]) -> tuple[DataFrame, str | None]:
    """The values of a file, of text formats as text, and the name of a column with the lines that are no record.
    ``strict``: such a line fails the job instead."""
    reader = spark.read.format(fmt).options(**options)
    if fmt not in ("csv", "json"):
        return reader.load(path), None
    if fmt == "csv":  # a field too many shows only if no column is pruned, and each file's header must be the first one's
        reader = reader.options(header=columns is None, inferSchema=False, columnPruning=False, enforceSchema=False)
    line = "_line"
    names = list(columns or reader.option("columnNameOfCorruptRecord", line).load(path).drop(line).columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if strict:
        return reader.option("mode", "FAILFAST").schema(schema).load(path), None
    return reader.option("columnNameOfCorruptRecord", line).schema(schema.add(line, T.StringType())).load(path), line


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", strict: bool = True,
               columns: Sequence[str] | None = None, options: Mapping[str, str] | None = None
               ) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Typed scan of a catalogue table: every declared column cast to its declared type.

    Columns are matched by name, whatever their order and case (CSV: by the header, or by ``columns`` for files without
    one); a missing column is an error. ``strict``: a value that does not fit its type, a CSV line with a field too few
    or too many, or a broken JSON line fails the job; otherwise returns ``(typed, refused)``: the refused rows as text
    with ``reasons``, an array of (column, reason), and ``line``, the text of a line that is no record. ``options``:
    those of the reader (separator, null value).
    """
    raw, made, whys, src, line = _cells(spark, name, path, fmt, strict, columns, options)
    if strict:
        return raw.selectExpr(*[
            f"{cast} AS {c}" if c not in whys else f"CASE WHEN {whys[c]} IS NOT NULL THEN raise_error(concat('{name}.{c}: value does not fit: ', "
            f"CAST({src[c]} AS STRING))) ELSE {cast} END AS {c}" for c, (cast, _) in made.items()])
    wrong, reasons = _verdict(whys, src, line)
    return (raw.filter(f"NOT ({wrong})").selectExpr(*[f"{cast} AS {c}" for c, (cast, _) in made.items()]),
            raw.filter(wrong).selectExpr(*[f"CAST({src[c]} AS STRING) AS {c}" for c in made], f"{reasons} AS reasons",
                                         f"{line or 'CAST(NULL AS STRING)'} AS line"))


def judge_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", columns: Sequence[str] | None = None,
                options: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of ``read_table(strict=False)``, taken and refused ones in one pass over the files: every declared column in its
    declared type, and ``reasons``, NULL for a row that is taken."""
    raw, made, whys, src, line = _cells(spark, name, path, fmt, False, columns, options)
    wrong, reasons = _verdict(whys, src, line)
    return raw.selectExpr(*[f"{cast} AS {c}" for c, (cast, _) in made.items()], f"CASE WHEN {wrong} THEN {reasons} END AS reasons")


def _cells(spark: SparkSession, name: str, path: str, fmt: str, strict: bool, columns: Sequence[str] | None,
           options: Mapping[str, str] | None):
    """Raw rows; by column (SQL of the typed value, SQL of the reason), the reasons, the SQL of the raw value; the SQL of a
    line that is no record."""
    table = CATALOGUE[name]
    raw, line = _as_written(spark, path, fmt, strict, columns, options or {})
    have = {c.lower(): c for c in raw.columns}
    missing = [c.name for c in table.columns if c.name.lower() not in have]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    src = {c.name: _quoted(have[c.name.lower()]) for c in table.columns}
    made = {c.name: _typed(src[c.name], c.spark_type) for c in table.columns}
    return raw, made, {c: why for c, (_, why) in made.items() if why}, src, line and _quoted(line)


def _verdict(whys: Mapping[str, str], src: Mapping[str, str], line: str | None) -> tuple[str, str]:
    """SQL that says whether a row is refused, and of its reasons."""
    # the reader gives lines without any column no answer: the length of a value (never negative) asks for one
    tests = [f"{line} IS NOT NULL", f"coalesce(length({next(iter(src.values()))}), 0) < 0"] if line else []
    wrong = " OR ".join([*tests, *(f"{why} IS NOT NULL" for why in whys.values())]) or "false"
    found = [f"CASE WHEN {line} IS NOT NULL THEN {_reason('CAST(NULL AS STRING)', repr(FIELDS))} END"] if line else []
    whole = f"{line} IS NULL AND " if line else ""
    found += [f"CASE WHEN {whole}{why} IS NOT NULL THEN {_reason(repr(c), why)} END" for c, why in whys.items()]
    reasons = f"filter(array({', '.join(found)}), x -> x IS NOT NULL)" if found else f"array({_reason('CAST(NULL AS STRING)', repr(FIELDS))})"
    return wrong, reasons


def _quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def _reason(column: str, reason: str) -> str:
    return f"named_struct('column', {column}, 'reason', {reason})"


# ---------------------------------------------------------------- S02
def append_rows(df: DataFrame, path: str, batch_id: str, fmt: str = "parquet") -> None:
    """Insert rows as the batch ``batch_id``; the same batch again takes the place of the first."""
    df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch={batch_id}")


def read_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path).drop("batch")


def insert_rows(batch: DataFrame, name: str, path: str, batch_id: str, parents: Mapping[str, DataFrame],
                order: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """S02 behind C13: appends what the table's rules accept and returns the rest with reasons.
    Rows of an earlier run of the same batch do not count as stored."""
    stored_rows = batch.sparkSession.read.format(fmt).load(path).filter(F.col("batch").cast("string") != batch_id).drop("batch")
    split = quarantine(batch, CATALOGUE[name], parents, existing=stored_rows, order=order)
    append_rows(split.accepted.drop(*order), path, batch_id, fmt)
    return split.rejected


# ---------------------------------------------------------------- S03
def apply_delta(snapshot: DataFrame, delta: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Update one column by key: rows of ``delta`` (key + new value) replace the value;
    keys absent from ``delta`` keep theirs. ``delta`` must hold one row per key."""
    d = delta.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(column).alias("_new"),
                     F.lit(True).alias("_hit"))
    joined = snapshot.join(d, [snapshot[k] == d[f"_k{i}"] for i, k in enumerate(key)], "left")
    return joined.select(*[F.when(F.col("_hit"), F.col("_new")).otherwise(snapshot[c]).cast(snapshot.schema[c].dataType)
                           .alias(c) if c == column else snapshot[c] for c in snapshot.columns])


def publish_tables(tables: Mapping[str, DataFrame], root: str, version: int) -> dict[str, str]:
    """Write all ``tables`` as version ``version`` of ``root``, then the one pointer to them."""
    root = root.rstrip("/")
    attempt = f"v{version:09d}-{uuid.uuid4().hex}"  # of its own: what a crash leaves is in nobody's way
    targets = {name: f"{root}/{attempt}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(targets[name])
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, n, p) for n, p in targets.items()], "version long, name string, path string").coalesce(
        1).write.json(f"{root}/{POINTERS}/{attempt}")
    return targets


def _current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]] | None:
    """The highest version with a pointer; None only if there is no pointer at all."""
    try:
        rows = spark.read.schema("version long, name string, path string").json(f"{root.rstrip('/')}/{POINTERS}/*")
        last = rows.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if last is None:
        return None
    found = rows.filter(F.col("version") == last).groupBy("name").agg(F.max("path").alias("path")).collect()
    return last, {r["name"]: r["path"] for r in found}  # one row a table of this root


def publish_version(df: DataFrame, root: str, version: int) -> str:
    return publish_tables({"table": df}, root, version)["table"]


def read_current(spark: SparkSession, root: str, name: str = "table") -> DataFrame:
    found = _current(spark, root)
    if found is None:
        raise FileNotFoundError(f"no published version under {root}")
    return spark.read.parquet(found[1][name])


def next_version(spark: SparkSession, root: str) -> int:
    found = _current(spark, root)
    return 0 if found is None else found[0] + 1


# ---------------------------------------------------------------- S04
def enrich(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None,
           columns: Sequence[str] | None = None) -> DataFrame:
    """Key lookup into a dimension (a left equi join; no match keeps NULLs).

    The join strategy is left to AQE: the dimension is broadcast only when its measured
    size is under the broadcast threshold.
    """
    dk = dim_key or key
    cols = list(columns) if columns is not None else [c for c in dim.columns if c != dk]
    d = dim.filter(F.col(dk).isNotNull()).select(F.col(dk).alias("_dk"), *cols, F.lit(0).alias("_place"))
    keyed = spread_nulls(df, key)  # rows without a key match nothing and do not meet in one task
    return keyed.join(d, F.col(key).eqNullSafe(F.col("_dk")) & (F.col("_spread") == F.col("_place")), "left").drop(
        "_dk", "_spread", "_place")


# ---------------------------------------------------------------- S05
# The procedure's success messages.
PROCESSED_TEXT = "Purchase Order Processed Successfully: "
MATERIAL_TEXT = "Material ID: "
UPDATED_TEXT = " Updated Quantity: "


def audit_messages(audit: DataFrame) -> DataFrame:
    """Success messages of the purchase-order procedure as rows (two lines per order)."""
    first = audit.select("PONo", F.lit(1).alias("line"), F.concat(F.lit(PROCESSED_TEXT), F.col("PONo")).alias("message"))
    second = audit.select("PONo", F.lit(2).alias("line"),
                          F.concat(F.lit(MATERIAL_TEXT), F.col("Material_Id"), F.lit(UPDATED_TEXT),
                                   F.col("updated_quantity").cast("string")).alias("message"))
    return first.unionByName(second)
