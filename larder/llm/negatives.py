"""Hard-negative mining: exact windows of integer scores, with angles that rule pairs out first.

1. Each vector becomes whole numbers, floor(256 * x). Its norm and its angles to ``REFERENCES``
   directions are computed once and stored. The directions are centres of a bounded sample
   (``SAMPLE_ROWS`` rows of the smallest hashes); they decide how much is ruled out, never what is found.
2. Two vectors' angle lies between the largest difference and the smallest sum (beyond pi: its
   rest to 2 pi) of their angles to one direction. The cosines of these bounds, times both norms and
   widened by ``ANGLE_SLACK`` and 1, enclose the integer score.
3. Positives: rows of the anchor's label. The rows of the highest upper bounds are scored; only rows
   whose upper bound reaches the last place so far are scored besides.
4. Negatives: for each positive the window of scores from 80 % to 100 % of its own. Only rows of other
   labels whose bounds overlap the windows are scored.

Rows are dealt to blocks of about ``BLOCK_ROWS`` by a hash, whatever their label, and anchors to blocks of
their own; each block of anchors meets each block of rows, so a hot label or a vector that a third of
all rows share is spread like any other, and a task holds two blocks. Only the few best of
each anchor and block leave a task.

Scores are exact: products are taken in double precision where all stay under 2**53, else in
Python's whole numbers.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part;
rows equal in id, label and vector count once, and rows of one id that differ are rows and anchors
each; a row is never its own id's positive; a zero or empty vector takes part, with score 0; a
vector that is shorter than another counts as filled up with zeros; components and scores beyond
64 bits count as the nearest 64-bit number; an anchor without other rows of its label, and a
positive with a score below zero (its window is empty), give no rows; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import stored, table
from larder.llm.vectors import block_pairs, blocks_of, column, dealt, doubles, finite, lists, matrix, width_of

BLOCK_ROWS = 4096
ANCHOR_ROWS = 1024
REFERENCES = 16
SAMPLE_ROWS = 4096
ANGLE_SLACK = 1e-6
ROUNDS = 6
#: Pairs of an anchor and a row whose bounds one step of a task holds.
STEP_PAIRS = 1 << 19

LONG = np.iinfo(np.int64)
EXACT = float(1 << 53)
ROW_SCHEMA = "vec_id bigint, label bigint, ints array<bigint>, norm double, angles array<double>"
POSITIVE_SCHEMA = "anchor bigint, anchor_id bigint, positive_id bigint, positive_score bigint"
NEGATIVE_SCHEMA = ("anchor bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, "
                   "negative_id bigint, negative_score bigint")


# ---------------------------------------------------------------- bounds and scores, in numpy
def directions(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit directions: seeds far from each other, then centres of the rows nearest to them."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    seeds, best = [0], unit @ unit[0]
    while len(seeds) < min(count, len(unit)):
        far = int(best.argmin())
        seeds.append(far)
        best = np.maximum(best, unit @ unit[far])
    centres = unit[seeds]
    for _ in range(ROUNDS):
        sums = np.zeros_like(centres)
        np.add.at(sums, (unit @ centres.T).argmax(axis=1), unit)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
    return centres


def angles_to(ints: np.ndarray, norms: np.ndarray, refs: np.ndarray) -> np.ndarray:
    cos = (ints.astype(np.float64) @ refs.T) / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cos, -1, 1))


def bounds(norms_a: np.ndarray, angles_a: np.ndarray, norms_b: np.ndarray, angles_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all pairs (rows: a, columns: b)."""
    low, high = np.zeros((len(norms_a), len(norms_b))), np.full((len(norms_a), len(norms_b)), np.pi)
    for r in range(angles_a.shape[1]):
        a, b = angles_a[:, r][:, None], angles_b[:, r][None, :]
        np.maximum(low, np.abs(a - b), out=low)
        both = a + b
        np.minimum(high, np.minimum(both, 2 * np.pi - both), out=high)
    size = norms_a[:, None] * norms_b[None, :]
    size = size * (1 + 1e-9)
    lower, upper = size * np.cos(np.minimum(high + ANGLE_SLACK, np.pi)) - 1, size * np.cos(np.maximum(low - ANGLE_SLACK, 0)) + 1
    return np.clip(lower, LONG.min, LONG.max), np.clip(upper, LONG.min, LONG.max)  # as scores are


class Block:
    """One block of rows (or anchors) of a task."""

    def __init__(self, rows: pa.Table, id_name: str, width: int):
        self.ids, self.labels = column(rows, id_name), column(rows, "label")
        self.norms = column(rows, "norm")
        self.angles = matrix(rows, "angles", width_of(rows, name="angles"))
        self.ints = matrix(rows, "ints", width)
        self.reals = self.ints.astype(np.float64)
        self.top = float(self.norms.max()) if len(self.norms) else 0.0

    def scores(self, rows: np.ndarray, other: "Block", i: int) -> np.ndarray:
        """Exact scores of these rows with row ``i`` of another block."""
        if self.top * other.top * (1 + 1e-6) < EXACT:
            return (self.reals[rows] @ other.reals[i]).astype(np.int64)
        one = other.ints[i].tolist()
        exact = (sum(x * y for x, y in zip(v, one)) for v in self.ints[rows].tolist())
        return np.fromiter((min(max(s, LONG.min), LONG.max) for s in exact), np.int64, len(rows))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by the smaller id."""
    if len(scores) > 4 * k:  # at most these can be among them
        rows = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        rows = np.arange(len(scores))
    return rows[np.lexsort((ids[rows], -scores[rows].astype(object) if (scores == LONG.min).any() else -scores[rows]))[:k]]


def _steps(anchors: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    size = max(1, STEP_PAIRS // max(1, rows))
    for a in range(0, len(anchors), size):
        yield anchors[a:a + size]


def _positives(k: int):
    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            width = width_of(rows, anchors, name="ints")
            block, asked, number = Block(rows, "vec_id", width), Block(anchors, "anchor_id", width), column(anchors, "anchor")
            for label in np.intersect1d(block.labels, asked.labels):
                same = np.flatnonzero(block.labels == label)
                for some in _steps(np.flatnonzero(asked.labels == label), len(same)):
                    _, upper = bounds(asked.norms[some], asked.angles[some], block.norms[same], block.angles[same])
                    for at, i in enumerate(some):
                        up = np.where(block.ids[same] == asked.ids[i], -np.inf, upper[at])
                        first = np.argpartition(-up, min(k, len(up)) - 1)[:k]
                        first = first[up[first] > -np.inf]
                        if not len(first):
                            continue
                        last = block.scores(same[first], asked, i).min() if len(first) == k else LONG.min
                        chosen = same[(up >= last) & (up > -np.inf)]
                        scores = block.scores(chosen, asked, i)
                        best = _best(scores, block.ids[chosen], k)
                        out.append((np.full(len(best), number[i]), np.full(len(best), asked.ids[i]), block.ids[chosen[best]], scores[best]))
        return _table(out, ["anchor", "anchor_id", "positive_id", "positive_score"])

    return find


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest score with low * positive <= 100 * score <= high * positive (percent)."""
    return -(-low * score // 100), high * score // 100


def _negatives(k: int, low: int, high: int):
    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            width = width_of(rows, anchors, name="ints")
            block, asked, number = Block(rows, "vec_id", width), Block(anchors, "anchor_id", width), column(anchors, "anchor")
            ids, offsets = lists(anchors, "positive_ids")
            wanted, _ = lists(anchors, "positive_scores")
            for some in _steps(np.arange(len(number)), len(block.ids)):
                lower, upper = bounds(asked.norms[some], asked.angles[some], block.norms, block.angles)
                for at, i in enumerate(some):
                    places = range(offsets[i], offsets[i + 1])
                    windows = [_window(int(wanted[p]), low, high) for p in places]
                    real = [w for w in windows if w[0] <= w[1]]
                    if not real:
                        continue
                    overlap = (upper[at] >= min(w[0] for w in real)) & (lower[at] <= max(w[1] for w in real))
                    chosen = np.flatnonzero(overlap & (block.labels != asked.labels[i]))
                    scores = block.scores(chosen, asked, i)
                    for place, (p, (a, b)) in enumerate(zip(places, windows)):
                        inside = np.flatnonzero((scores >= a) & (scores <= b)) if a <= b else np.zeros(0, dtype=np.int64)
                        best = inside[_best(scores[inside], block.ids[chosen[inside]], k)]
                        if len(best):
                            one = np.ones(len(best), dtype=np.int64)
                            out.append((one * number[i], one * asked.ids[i], (one * place).astype(np.int32), one * ids[p], one * wanted[p],
                                        block.ids[chosen[best]], scores[best]))
        return _table(out, ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    return find


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    kinds = [pa.int32() if n == "place" else pa.int64() for n in names]
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64) for _ in names]
    return pa.table({n: pa.array(c, type=t) for n, c, t in zip(names, columns, kinds)})


# ---------------------------------------------------------------- the job
def whole_numbers(vec: Column) -> Column:
    return F.transform(doubles(vec), lambda x: F.floor(x * 256).cast("long"))


def scored_rows(df: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """vec_id, label, ints, norm, angles of the rows that take part, each once; stored."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec"))).select(
        "vec_id", "label", whole_numbers(F.col("vec")).alias("ints")).distinct()
    sample = rows.select("ints").orderBy(F.xxhash64("vec_id", "label", "ints"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    refs = directions(matrix(sample, "ints", width_of(sample, name="ints")).astype(np.float64))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if not part.num_rows:
                continue
            ints = matrix(part, "ints", max(width_of(part, name="ints"), refs.shape[1]))
            norms = np.sqrt(np.einsum("ij,ij->i", ints.astype(np.float64), ints.astype(np.float64)))
            known = np.zeros((len(refs), ints.shape[1]))
            known[:, :refs.shape[1]] = refs
            angles = angles_to(ints, norms, known)
            offsets = np.arange(part.num_rows + 1, dtype=np.int32) * len(refs)
            yield from part.append_column("norm", pa.array(norms)).append_column("angles", pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(angles.ravel()))).to_batches()

    return stored(spark, rows.mapInArrow(measured, ROW_SCHEMA), "scored")


def mined(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
          block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """rows: ``scored_rows``. For each row that ``anchors`` holds for and each of its ``positives`` best rows of
    its label, the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent of the
    positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    asked = stored(spark, rows.where(anchors).select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"),
                                                     "label", "ints", "norm", "angles"), "anchors")
    row_blocks, anchor_blocks = blocks_of(rows.count(), block_rows), blocks_of(asked.count(), anchor_rows)
    dealt_rows = dealt(rows, ["vec_id", "label", "ints"], row_blocks, "block")
    asked = dealt(asked, ["anchor"], anchor_blocks, "query_block")

    best = block_pairs(dealt_rows, row_blocks, asked, anchor_blocks).applyInArrow(_positives(positives), POSITIVE_SCHEMA)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
    best = best.withColumn("place", place).where(F.col("place") <= positives).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))  # a few each
    asked = stored(spark, asked.join(best, "anchor").withColumn("positive_ids", F.col("p.positive_id")).withColumn(
        "positive_scores", F.col("p.positive_score")).drop("p"), "positives")

    found = block_pairs(dealt_rows, row_blocks, asked, anchor_blocks).applyInArrow(_negatives(negatives, low, high), NEGATIVE_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = scored_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return mined(rows, F.col("vec_id") % 100 == 0)


#: DuckDB: all pairs of an anchor and a row.
SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
