"""SimHash near-duplicates: pivot distance tables over the distinct fingerprints.

1. A document's fingerprint: each 3-word shingle's XXH64 votes on 64 bits.
2. Equal fingerprints become one node, which bears its smallest document id.
3. Two fingerprints that differ in at most 3 bits agree in one of four 16-bit blocks, and, in the
   48 bits beside it, in one of four 12-bit blocks: 16 bucket keys of 28 bits hold every link.
4. In a bucket the Hamming distances to the pivots (many fixed reference fingerprints) are
   computed once for each fingerprint. A pair whose largest coordinate difference is over 3 is
   discarded (triangle inequality); the rest is verified by its bits.
5. A bucket hands on only a star for each of its linked sets, so a group of copies gives as many
   rows as it has members. A bucket over ``BLOCK`` fingerprints is cut into blocks; each pair of
   blocks is work of its own, so no task holds a whole hot bucket.
6. Stars are joined to components by alternating star steps, each written to the shared folder.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links
like any other; repeated rows come back one by one; an empty table gives no rows; other columns
are not read. A null id is never a component's id unless all its members' ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import (ascii_lower, hex16, shuffle_tasks, signed_bits, stored, table, vote_sums, whole,
                               words_of)

#: Words of a shingle, and the largest distance of a link.
SHINGLE = 3
DISTANCE = 3
#: Reference fingerprints; fingerprints that one step of a task compares with another such block.
PIVOTS = 24
BLOCK = 1024


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random bits, the same on every machine."""
    return np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, n, dtype=np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id, fingerprint (long) and the text's hash. Votes are summed before they are shuffled."""
    docs = df.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")).select(
        "id", F.xxhash64("text").alias("text_hash"), words_of(ascii_lower(F.col("text"))).alias("words"))
    n = F.greatest(F.size("words") - (shingle - 1), F.least(F.size("words"), F.lit(1)))
    zipped = F.arrays_zip(*[F.slice("words", k + 1, n) for k in range(shingle)])
    each = docs.select("id", "text_hash", F.posexplode_outer(zipped).alias("at", "s"))
    joined = F.concat_ws(" ", *[F.col("s")[str(k)] for k in range(shingle)])
    each = each.select("id", "text_hash", (F.coalesce("at", F.lit(0)) == 0).cast("long").alias("first"),
                       F.when(F.col("s").isNotNull(), F.xxhash64(joined)).otherwise(F.lit(0)).alias("h"),
                       F.col("s").isNotNull().cast("long").alias("real"))
    votes = each.groupBy("id", "text_hash").agg(
        F.sum("first").alias("rows"), F.sum("real").alias("total"), *vote_sums(F.col("h")))
    out = votes.select("id", "rows", "text_hash", signed_bits(F.col("total")).alias("fingerprint"))
    # rows that are equal in id and text were summed up together: their bits are the same
    return out.select(F.col("id").alias(id_col), "fingerprint", "text_hash", F.explode(F.when(
        F.col("rows") > 1, F.array_repeat(F.lit(0), F.col("rows").cast("int"))).otherwise(F.array(F.lit(0)))).alias("_")
    ).drop("_")


def _bucket_keys(fp: Column) -> Column:
    """The 16 keys of a fingerprint: a 16-bit block, and a 12-bit block of the other 48 bits."""
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << (16 * i)) - 1)) if i else F.lit(0).cast("long")
        high = F.shiftrightunsigned(fp, 16 * (i + 1)) if i < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(F.shiftleft(high, 16 * i))
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((i * 4 + j) << 28).cast("long").bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


def _linked(a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs a[i], b[i] are within the distance: pivots first, then the bits of what is left."""
    near = np.flatnonzero(np.abs(da - db).max(axis=1) <= distance) if len(a) else np.zeros(0, np.int64)
    return near[np.bitwise_count(a[near] ^ b[near]) <= distance]


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a[i] - b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_links(reference: np.ndarray, distance: int):
    """For mapInPandas over rows sorted by (bucket, part): links within each group, as stars."""

    def solve(key: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        table_ = np.bitwise_count(fp[:, None] ^ reference[None, :]).astype(np.int8)  # distances to the pivots
        left, right = [], []
        gap = 1
        live = np.arange(len(fp) - 1)
        while len(live):  # rows of a group stand together: compare each with the row `gap` places on
            live = live[live + gap < len(fp)]
            live = live[key[live] == key[live + gap]]
            # of two blocks only pairs across count, the pairs within have a group of their own
            want = live[(side[live] != side[live + gap]) | (side[live] < 0)]
            hit = want[_linked(fp[want], fp[want + gap], table_[want], table_[want + gap], distance)]
            left.append(hit)
            right.append(hit + gap)
            gap += 1
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        label = _stars(len(fp), a, b)
        member = np.flatnonzero(label != np.arange(len(fp)))
        one, two = fp[member].view(np.int64), fp[label[member]].view(np.int64)
        return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            last = np.flatnonzero(new_group(frame))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            held = frame.iloc[cut:]
            if cut:
                yield of(frame.iloc[:cut])
        if held is not None and len(held):
            yield of(held)

    def new_group(frame: pd.DataFrame) -> np.ndarray:
        bucket, part = frame["bucket"].to_numpy(), frame["part"].to_numpy()
        return (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        group = np.append(0, np.cumsum(new_group(frame)))
        return solve(group, frame["side"].to_numpy(), frame["fp"].to_numpy().view(np.uint64))

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK, references: int = PIVOTS) -> DataFrame:
    """nodes: distinct fingerprints (column fp). Returns links (a < b as longs) that connect what
    chains of links within ``distance`` (at most 3) connect."""
    if not 0 <= distance <= 3:
        raise ValueError("the bucket keys hold for distances from 0 to 3")
    spark = nodes.sparkSession
    keyed = nodes.select("fp", F.explode(_bucket_keys(F.col("fp"))).alias("bucket"))
    size = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("bucket"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    shared = keyed.join(size, "bucket")
    # pairs of blocks: (i, i) for each block, (i, j) for each two; a row goes to the pairs with its block
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("long")
    shared = shared.withColumn("own", own).select(
        "bucket", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    shared = shared.select(
        "bucket", "fp", (F.shiftleft(low.cast("long"), 31) + high).alias("part"),
        F.when(low == high, -1).otherwise(F.col("own")).cast("long").alias("side"))
    tasks = shuffle_tasks(spark)
    dealt = shared.repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "part")
    return dealt.mapInPandas(_bucket_links(pivots(references), distance), "a long, b long").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Columns node, root: the smallest node of each component, for every node of ``edges`` (a, b).

    Alternating star steps: each node's larger neighbours move to its smallest neighbour, then
    its smaller ones. A node's neighbours are reduced to their smallest before they are joined.
    """
    state = stored(spark, edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).distinct()
        state = stored(spark, small, "links")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, with_text_hash: bool = False) -> DataFrame:
    """One row per input row: id, fingerprint (long), component_id (the smallest id reachable);
    ``with_text_hash`` also the text's hash and root, the component's smallest fingerprint."""
    spark = df.sparkSession
    docs = stored(spark, fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = docs.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("least"))
    nodes = stored(spark, nodes, "nodes")
    joined = components(spark, links(nodes, distance))
    named = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    named = stored(spark, named.withColumn("root", F.coalesce("root", "fp")), "roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "root").join(ids, "root").withColumnRenamed("fp", "fingerprint")
    return docs.join(of, "fingerprint").select(
        id_col, "fingerprint", "component_id", *(["text_hash", "root"] if with_text_hash else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with one left of each component: the smallest id's (null ids last), of
    several rows with that id the one whose text comes first.

    The rows that go are few columns; the texts meet only the rows to keep.
    """
    found = near_duplicates(df, id_col, text_col, with_text_hash=True)
    # a component is known by its smallest fingerprint as well, since its ids may be null
    rank = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("text_hash"))
    best = found.groupBy("root").agg(F.min(rank).alias("best")).select("best.*")
    keys = ["no_id", "id_text", "text_hash"]
    as_text = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id_text")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(id_col).isNull().alias("no_id"),
                     F.xxhash64(whole(F.col(text_col))).alias("text_hash"))
    rows = rows.select("row", "no_id", as_text, "text_hash").dropDuplicates(keys)  # equal rows meet map-side
    return rows.join(best.select("no_id", as_text, "text_hash"), keys, "left_semi").select("row.*")
