"""Approximate nearest neighbours: robust-pruned directed graphs, one a shard, searched by beams.

1. Equal vectors are one node, which keeps the ``k + 1`` smallest ids that have it: no more of
   them can be among the ``k`` nearest of any query, since ties go to the smaller id.
2. Nodes are dealt to shards of about ``SHARD_ROWS`` by a hash, so a shard's task is bounded and
   more rows make more shards, not larger ones.
3. In each shard a directed graph is built. Nodes enter in batches of doubling size: a greedy beam
   search from the medoid over the graph so far visits the nodes that may become neighbours, and
   relaxed pruning goes through them from the nearest: a kept neighbour removes those that are
   nearer to it, times ``SLACK``, than to the node. What is left, ``DEGREE`` edges at most, points to
   different directions. Each edge is added backwards too; a full node is pruned again. A second
   round over all nodes mends the edges of those that came early.
4. The index is a table (shard, node, ids, vector, edges) in the shared folder; it answers any
   queries. Each block of queries meets each shard: a beam search of ``SEARCH_BEAM`` places gives the
   shard's nearest, whose distances are taken anew in double precision from the stored vectors;
   the best of all shards are the answer.

Every row is in the index and every shard is searched, so only a beam that ends early can miss a
neighbour (recall: README and tests).

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part,
nor do rows without an id; rows equal in id and vector count once; rows of one id with different
vectors are candidates each, and queries each; a query's own id is never its neighbour; a vector
that is shorter than another counts as filled up with zeros; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import stored, table
from larder.llm.vectors import block_pairs, blocks_of, column, dealt, doubles, finite, lists, matrix, width_of

SHARD_ROWS = 8192
QUERY_ROWS = 8192
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 160
SLACK = 1.2
#: Nodes that enter at once, and floats that one step of a task holds.
BATCH = 512
STEP_FLOATS = 1 << 22

INDEX_SCHEMA = "block int, node int, start boolean, ids array<bigint>, vec array<double>, edges array<int>"
FOUND_SCHEMA = "query bigint, query_id bigint, vec_id bigint, score double"


# ---------------------------------------------------------------- one shard, in numpy
class Graph:
    """Vectors (scaled to single precision) and the edges of one shard. Distances are taken from differences,
    so near copies are told apart."""

    def __init__(self, vecs: np.ndarray, edges: np.ndarray | None = None, start: int | None = None):
        top = float(np.abs(vecs).max()) if vecs.size else 0.0
        self.scale = 1.0 / top if top > 0 else 1.0
        self.vecs = (vecs * self.scale).astype(np.float32)
        self.edges = np.full((len(vecs), DEGREE), -1, dtype=np.int32) if edges is None else edges
        self.start = self._medoid() if start is None else start

    def _medoid(self) -> int:
        return int(((self.vecs - self.vecs.mean(axis=0)) ** 2).sum(axis=1).argmin()) if len(self.vecs) else 0

    def _apart(self, near: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of nodes."""
        gap = self.vecs[near]
        gap -= q[:, None, :]
        return np.einsum("ijk,ijk->ij", gap, gap)

    def walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step. Nodes of each beam (-1: none), and the nodes visited."""
        m, n = len(q), len(self.vecs)
        ids, dist = np.full((m, beam), -1, np.int32), np.full((m, beam), np.inf, np.float32)
        fresh = np.zeros((m, beam), dtype=bool)
        ids[:, 0], fresh[:, 0] = self.start, True
        dist[:, 0] = ((q - self.vecs[self.start]) ** 2).sum(axis=1)
        seen = np.zeros((m, n), dtype=bool)
        seen[:, self.start] = True
        visited, live = [], np.arange(m)
        while True:
            d = np.where(fresh[live], dist[live], np.inf)
            at = d.argmin(axis=1)
            go = d[np.arange(len(live)), at] < np.inf
            live, at = live[go], at[go]
            if not len(live):
                break
            now = ids[live, at]
            fresh[live, at] = False
            step = np.full(m, -1, np.int32)
            step[live] = now
            visited.append(step)
            near = self.edges[now]
            new = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(near >= 0, near, now[:, None])] = True
            nd = self._apart(near, q[live])
            nd[~new] = np.inf
            all_d = np.concatenate([dist[live], nd], axis=1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[live] = np.take_along_axis(all_d, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), keep, 1)
            fresh[live] = np.take_along_axis(np.concatenate([fresh[live], new], axis=1), keep, 1)
        ids[np.isinf(dist)] = -1
        return ids, np.stack(visited, axis=1)

    def pruned(self, nodes: np.ndarray, near: np.ndarray, slack: float) -> np.ndarray:
        """Relaxed pruning: of the candidates ``near`` (-1: none) of each node the edges that it keeps."""
        out = np.full((len(nodes), DEGREE), -1, dtype=np.int32)
        size = max(1, STEP_FLOATS // max(1, near.shape[1] * self.vecs.shape[1]))
        for a in range(0, len(nodes), size):
            out[a:a + size] = self._pruned(nodes[a:a + size], near[a:a + size], slack)
        return out

    def _pruned(self, nodes: np.ndarray, near: np.ndarray, slack: float) -> np.ndarray:
        near = np.sort(near, axis=1)
        none = (near < 0) | (near == nodes[:, None])
        none[:, 1:] |= near[:, 1:] == near[:, :-1]
        x = self.vecs[near]
        gap = x - self.vecs[nodes][:, None, :]
        d = np.where(none, np.inf, np.einsum("ijk,ijk->ij", gap, gap))
        out, i = np.full((len(nodes), DEGREE), -1, dtype=np.int32), np.arange(len(nodes))
        left = d.copy()
        for r in range(DEGREE):
            j = left.argmin(axis=1)
            ok = left[i, j] < np.inf
            if not ok.any():
                break
            pick = near[i, j]
            out[ok, r] = pick[ok]
            np.subtract(x, self.vecs[pick][:, None, :], out=gap)
            left[(slack * slack * np.einsum("ijk,ijk->ij", gap, gap) <= d) & ok[:, None]] = np.inf
            left[i, j] = np.inf
        return out

    def _backwards(self, nodes: np.ndarray, slack: float) -> None:
        """Each edge of ``nodes`` is added to its target; a target with no place left is pruned anew."""
        edges = self.edges[nodes]
        source, target = np.repeat(nodes, DEGREE), edges.ravel()
        source, target = source[target >= 0], target[target >= 0]
        new = ~(self.edges[target] == source[:, None]).any(axis=1)
        source, target = source[new], target[new]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        degree = (self.edges[heads] >= 0).sum(axis=1)
        fits = degree + count <= DEGREE
        row = np.repeat(fits, count)
        at = np.repeat(degree, count) + place
        self.edges[target[row], at[row]] = source[row]
        full = np.flatnonzero(~fits)
        full = full[np.argsort(count[full])]  # like sizes together: little padding
        for a in range(0, len(full), 64):
            some = full[a:a + 64]
            near = np.full((len(some), DEGREE + int(count[some].max())), -1, dtype=np.int32)
            near[:, :DEGREE] = self.edges[heads[some]]
            for k, h in enumerate(some):
                near[k, DEGREE:DEGREE + count[h]] = source[first[h]:first[h] + count[h]]
            self.edges[heads[some]] = self.pruned(heads[some], near, slack)

    def enter(self, nodes: np.ndarray, slack: float) -> None:
        for a in range(0, len(nodes), BATCH):
            some = nodes[a:a + BATCH]
            _, visited = self.walk(self.vecs[some], BUILD_BEAM)
            near = np.concatenate([visited, self.edges[some]], axis=1)
            self.edges[some] = self.pruned(some, near, slack)
            self._backwards(some, slack)

    def build(self) -> "Graph":
        n = len(self.vecs)
        order = np.random.default_rng(7).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int32)
        done = 1
        while done < n:
            size = min(BATCH, done, n - done)
            self.enter(order[done:done + size], SLACK)
            done += size
        self.enter(order, SLACK)
        return self


def _build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    vecs = matrix(rows, "vec", width_of(rows, name="vec"))
    graph = Graph(vecs).build()
    n = rows.num_rows
    degree = (graph.edges >= 0).sum(axis=1)
    offsets = np.concatenate([[0], np.cumsum(degree)]).astype(np.int32)
    edges = pa.ListArray.from_arrays(pa.array(offsets), pa.array(graph.edges[graph.edges >= 0], type=pa.int32()))
    return pa.table({"block": pa.array(np.full(n, key[0].as_py(), dtype=np.int32)), "node": pa.array(np.arange(n, dtype=np.int32)),
                     "start": pa.array(np.arange(n) == graph.start), "ids": rows["ids"], "vec": rows["vec"], "edges": edges})


def _search_shard(k: int, beam: int):
    def search(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if shard.num_rows and queries.num_rows:
            shard = shard.sort_by("node")
            width = width_of(shard, queries, name="vec")
            vecs, asked = matrix(shard, "vec", width), matrix(queries, "vec", width)
            edges = np.full((shard.num_rows, DEGREE), -1, dtype=np.int32)
            values, offsets = lists(shard, "edges")
            degree = np.diff(offsets)
            edges[np.repeat(np.arange(len(degree)), degree), np.arange(len(values)) - np.repeat(offsets[:-1], degree)] = values
            graph = Graph(vecs, edges, int(np.flatnonzero(column(shard, "start"))[0]))
            ids, id_offsets = lists(shard, "ids")
            number, own = column(queries, "query"), column(queries, "query_id")
            size = max(1, min(BATCH, STEP_FLOATS // (DEGREE * width)))
            for a in range(0, len(asked), size):
                q = asked[a:a + size]
                nodes, _ = graph.walk((q * graph.scale).astype(np.float32), beam)
                for i, found in enumerate(nodes):
                    found = found[found >= 0]
                    gap = vecs[found] - q[i]
                    score = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                    count = id_offsets[found + 1] - id_offsets[found]
                    each = np.concatenate([ids[id_offsets[f]:id_offsets[f + 1]] for f in found])
                    score = np.repeat(score, count)
                    other = each != own[a + i]
                    each, score = each[other], score[other]
                    best = np.lexsort((each, score))[:k]
                    out["query"].append(np.full(len(best), number[a + i]))
                    out["query_id"].append(np.full(len(best), own[a + i]))
                    out["vec_id"].append(each[best])
                    out["score"].append(score[best])
        kinds = {"query": np.int64, "query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({c: pa.array(np.concatenate([*v, np.zeros(0)]).astype(kinds[c]) if c == "score" else np.concatenate(
            [*v, np.zeros(0, dtype=np.int64)]).astype(np.int64)) for c, v in out.items()})

    return search


# ---------------------------------------------------------------- the job
def vector_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec of the rows that take part, each once."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), doubles(F.col(vec_col)).alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & finite(F.col("vec")) & F.exists("vec", lambda x: x != 0)).distinct()


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows: vec_id, vec (``vector_rows``). The stored index, one row a node; ``k``: neighbours that a
    search may ask for."""
    spark = rows.sparkSession
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    nodes = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vec").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    nodes = stored(spark, nodes, "nodes")
    shards = blocks_of(nodes.count(), shard_rows)
    return stored(spark, dealt(nodes, ["vec"], shards, "block").groupBy("block").applyInArrow(_build_shard, INDEX_SCHEMA), "index")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """queries: vec_id, vec. The ``k`` nearest of each that the beams of all shards found: query_id, rank,
    vec_id, score."""
    spark = index.sparkSession
    asked = stored(spark, queries.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "vec"),
                   "queries")
    shards = (index.agg(F.max("block")).first()[0] or 0) + 1
    blocks = blocks_of(asked.count(), query_rows)
    pairs = block_pairs(index, shards, dealt(asked, ["query"], blocks, "query_block"), blocks)
    found = pairs.applyInArrow(_search_shard(k, beam), FOUND_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"),
                                                                           "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(build_index(rows, 10), rows.where("vec_id % 100 = 0"), 10)
