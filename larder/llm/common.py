"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import partitions, scratch_path

#: Fixed value: white space of every word rule here (space and the controls 09-0D).
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only: other letters keep their case."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def stored(spark: SparkSession, df: DataFrame, kind: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    return partitions(spark)


#: One counter for bit i in the low half of a long, one for bit i + 32 in the high half.
PAIR_MASK = 0x0000000100000001
HALF = 32


def vote_sums(hash_col: Column, weight: Column | None = None) -> list[Column]:
    """32 sums that hold, for each of the 64 bits, the weight of the hashes with that bit set.

    Each long holds two counters of 32 bits, so a document's weights may add up to 2**31.
    """
    out = []
    for i in range(HALF):
        bits = F.shiftrightunsigned(hash_col, i).bitwiseAND(F.lit(PAIR_MASK))
        out.append(F.sum(bits if weight is None else bits * weight).alias(f"v{i}"))
    return out


def signed_bits(total: Column) -> Column:
    """The 64-bit fingerprint: a bit is 1 if its votes are over half of ``total``."""
    low, high = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(HALF):
        v = F.col(f"v{i}")
        low = low.bitwiseOR(F.when(v.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > total, F.lit(1 << i)).otherwise(F.lit(0)))
        high = high.bitwiseOR(F.when(F.shiftrightunsigned(v, 32) * 2 > total, F.lit(1 << i)).otherwise(F.lit(0)))
    return low.bitwiseOR(F.shiftleft(high, 32))


def hex16(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
