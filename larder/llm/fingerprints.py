"""Document fingerprints: SimHash of weighted terms, and a search by permuted block tables.

A term is a word in lower case; each occurrence votes with its hash on 64 signed bits, with a
weight that grows with its length (short words are mostly function words). The votes of a
document are added up before they are shuffled: 32 sums of two counters each.

``near``: a fingerprint is cut into ``BLOCKS`` blocks. Each choice of BLOCKS - radius blocks is a
table, whose key is the choice and these blocks brought to the front (permuted); two fingerprints
within the radius leave at least that many blocks alone, so some table holds both under one key.

Defined results: a null text counts as empty and has fingerprint zero; equal texts have equal
fingerprints; repeated rows come back one by one; an empty table gives no rows; other columns are
not read; a null id comes before all others.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import hex16, shuffle_tasks, signed_bits, stored, table, vote_sums, whole, words_of

#: Letters of a term that add to its weight, and the bits of a fingerprint.
FULL_WEIGHT = 8
BITS = 64
#: Search: the Hamming radius, the blocks of a fingerprint, and the ids that the query searches for.
RADIUS = 3
BLOCKS = 5
QUERY_EVERY = 50


def fingerprints(df: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """key_cols and ``fingerprint`` (long); the keys must tell the rows apart."""
    each = df.select(*key_cols, F.explode_outer(words_of(F.lower(whole(F.col(text_col))))).alias("term"))
    each = each.select(*key_cols, F.coalesce(F.xxhash64("term"), F.lit(0)).alias("h"), F.coalesce(
        F.least(F.char_length("term"), F.lit(FULL_WEIGHT)), F.lit(0)).cast("long").alias("weight"),
        F.col("term").isNotNull().alias("real"))
    each = each.select(*key_cols, F.when(F.col("real"), F.col("h")).otherwise(F.lit(0)).alias("h"), "weight")
    votes = each.groupBy(*key_cols).agg(F.sum("weight").alias("total"), *vote_sums(F.col("h"), F.col("weight")))
    return votes.select(*key_cols, signed_bits(F.col("total")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _block(fp: Column, i: int) -> tuple[Column, int]:
    low, high = BITS * i // BLOCKS, BITS * (i + 1) // BLOCKS
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long")), high - low


def _tables(fp: Column, radius: int) -> Column:
    """Array of (table, key): for each choice of blocks, these as the leading bits of the key."""
    out = []
    for t, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius)):
        key = F.lit(0).cast("long")
        for i in chosen:
            block, width = _block(fp, i)
            key = F.shiftleft(key, width).bitwiseOR(block)
        out.append(F.struct(F.lit(t).alias("table"), key.alias("key")))
    return F.array(*out)


def _first_table(a: Column, b: Column, radius: int) -> Column:
    """The first table that holds both under one key, so that a pair counts once."""
    bits = a.bitwiseXOR(b)
    found = F.lit(None).cast("int")
    for t, chosen in reversed(list(enumerate(combinations(range(BLOCKS), BLOCKS - radius)))):
        alike = F.lit(True)
        for i in chosen:
            alike = alike & (_block(bits, i)[0] == 0)
        found = F.when(alike, F.lit(t)).otherwise(found)
    return found


def near(wanted: DataFrame, known: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (fp, near_fp) of distinct fingerprints within the radius; both have a column fp."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"the radius must be from 0 to {BLOCKS - 1}")
    left = wanted.select("fp").distinct().select("fp", F.explode(_tables(F.col("fp"), radius)).alias("t"))
    right = known.select("fp").distinct().select(F.col("fp").alias("near_fp"), F.explode(
        _tables(F.col("fp"), radius)).alias("u"))
    left = left.select("fp", F.col("t.table").alias("table"), F.col("t.key").alias("key"))
    right = right.select("near_fp", F.col("u.table").alias("u_table"), F.col("u.key").alias("u_key"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("near_fp"))) <= radius
    first = _first_table(F.col("fp"), F.col("near_fp"), radius) == F.col("table")
    return left.join(right, (F.col("table") == F.col("u_table")) & (F.col("key") == F.col("u_key")) & close & first
                     ).select("fp", "near_fp")


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, place, id, text, next_text, next_bucket, next_place: each row with the row after it
    by ascending id (after the last: the first).

    Rows go to buckets of neighbouring ids, cut at ids that the table has; the first row of each
    bucket also goes to the bucket before it, so every row meets its next one in one bucket.
    The driver holds the cuts alone, one for each bucket.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    docs = df.select(order.alias("o"), F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    n = 4 * shuffle_tasks(df.sparkSession)
    cuts = docs.agg(F.min("o").alias("least"), F.percentile_approx("o", [i / n for i in range(1, n)], 20 * n).alias("cuts")
                    ).first()
    starts = sorted({cuts["least"], *(cuts["cuts"] or [])} - {None})  # bucket k begins at starts[k - 1]
    step = max(1, int(len(starts) ** 0.5))
    heads = starts[::step]  # looked up in two steps, so that many buckets cost little
    runs = [starts[i:i + step] for i in range(0, len(starts), step)]
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("o")))
    lists = F.transform(F.split(F.lit(";".join(",".join(map(str, r)) for r in runs)), ";"),
                        lambda s: F.split(s, ",").cast("array<bigint>"))
    if not starts:
        heads, lists = [0], F.array(literal([0]))
    docs = docs.withColumn("run", below(literal(heads)) - 1)
    docs = docs.withColumn("bucket", F.col("run") * step + below(F.get(lists, F.col("run"))))
    begins = F.col("o") == F.get(literal(starts or [0]), F.col("bucket") - 1)
    last = len(starts)
    docs = docs.withColumn("to", F.explode(F.when(begins, F.array(
        F.struct(F.col("bucket"), F.lit(False).alias("guest")),
        F.struct(F.when(F.col("bucket") == 1, last).otherwise(F.col("bucket") - 1).alias("bucket"),
                 F.lit(True).alias("guest")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("guest"))))))
    docs = docs.select("o", "id", "text", F.xxhash64("text").alias("tie"), F.col("to.bucket").alias("bucket"),
                       F.col("to.guest").alias("guest"))
    ordered = Window.partitionBy("bucket").orderBy("guest", "o", "tie")
    out = docs.select("id", "guest", "bucket", "text", F.row_number().over(ordered).alias("place"),
                      F.lead("text").over(ordered).alias("next_text"), F.lead("guest").over(ordered).alias("to_guest"))
    after = F.when(F.col("bucket") == last, 1).otherwise(F.col("bucket") + 1)
    return out.where("NOT guest").select(
        "bucket", "place", "id", "text", "next_text",
        F.when(F.col("to_guest"), after).otherwise(F.col("bucket")).alias("next_bucket"),
        F.when(F.col("to_guest"), 1).otherwise(F.col("place") + 1).alias("next_place"))


def edited(text: Column, next_text: Column) -> Column:
    """The text whose last half (floor) is replaced by the beginning of the next one."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))


def compare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, the two fingerprints (long) and their
    likeness, and the likeness to the next row's fingerprint."""
    spark = df.sparkSession
    rows = with_next(df, id_col, text_col)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    keys = ["bucket", "place", "id", "next_bucket", "next_place", "n_chars", "edited_sha256"]
    rows = rows.select(
        "bucket", "place", "id", "next_bucket", "next_place", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(
            F.struct(F.lit(False).alias("changed"), F.col("text").alias("text")),
            F.struct(F.lit(True).alias("changed"), F.col("edited").alias("text")))).alias("v"))
    both = fingerprints(rows.select(*keys, "v.changed", "v.text"), [*keys, "changed"])
    of = lambda changed: F.max(F.when(F.col("changed") == changed, F.col("fingerprint")))
    mine = stored(spark, both.groupBy(*keys).agg(
        of(False).alias("fingerprint"), of(True).alias("edited_fingerprint")), "fingerprints")
    other = mine.select(F.col("bucket").alias("next_bucket"), F.col("place").alias("next_place"),
                        F.col("fingerprint").alias("next_fingerprint"))
    return mine.join(other, ["next_bucket", "next_place"], "left").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near``: for ids divisible by QUERY_EVERY, the documents whose fingerprint lies within
    RADIUS of this one's (itself included); null for the others."""
    rows = stored(spark, compare(table(spark, sf_dir, "documents")), "compared")
    asked = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    known = rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("n"))
    wanted = rows.where(asked).select(F.col("fingerprint").alias("fp"))
    found = near(wanted, known).join(known.withColumnRenamed("fp", "near_fp"), "near_fp").groupBy("fp").agg(
        F.sum("n").alias("n_near")).withColumnRenamed("fp", "fingerprint")
    # only the rows asked for meet the join: the others have no key
    out = rows.where(asked).join(found, "fingerprint", "left").unionByName(
        rows.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fingerprint")).alias("fingerprint"),
        hex16(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
