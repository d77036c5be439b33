"""SimHash near duplicates against all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larder.llm import simhash_dedup
from larder.llm.common import hex16
from tests.llm.cases import ROWS, frame, order


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def components(nodes):
    """{fingerprint: smallest fingerprint reachable}, by all pairs."""
    nodes = sorted(set(nodes))
    up = {f: f for f in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    a = np.array(nodes, dtype=np.uint64)
    for i, f in enumerate(nodes):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3):
            x, y = find(f), find(nodes[i + 1 + j])
            up[max(x, y)] = min(x, y)
    return {f: find(f) for f in nodes}


def expected(rows):
    fps = [(d, simhash(t)) for d, t in rows]
    root = components([f for _, f in fps])
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    return [(d, f"{f:016x}", least.get(root[f])) for d, f in fps]


def texts():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 150)) for _ in range(60)]
    rows = [(1000 + i, t) for i, t in enumerate(base)]
    for k in range(150):  # near copies: one word changed, in chains
        w = rows[int(rng.integers(0, len(rows)))][1].split()
        w[int(rng.integers(0, len(w)))] = "changed"
        rows.append((5000 - k, " ".join(w)))
    return rows + [(9000 + i, base[0]) for i in range(30)]


@pytest.mark.parametrize("rows", [ROWS, texts(), texts() + ROWS])
def test_components_are_those_of_all_pairs(spark, rows):
    got = simhash_dedup.near_duplicates(frame(spark, rows)).select(
        "doc_id", hex16(F.col("fingerprint")), "component_id").collect()
    assert order(map(tuple, got)) == order(expected(rows))


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_no_link_is_lost_in_hot_buckets(spark, block):
    rng = np.random.default_rng(block)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    nodes = set(base)
    for b in base[:20]:
        x = b
        for _ in range(10):
            for k in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(k)
            nodes.add(x)
    for _ in range(150):
        x = base[30]
        for k in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            x ^= 1 << int(k)
        nodes.add(x)
    signed = {x: int(np.uint64(x).view(np.int64)) for x in nodes}
    links = simhash_dedup.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), block=block)
    root = {r.node: r.root for r in simhash_dedup.components(spark, links).collect()}
    groups = {}
    for x, v in signed.items():
        groups.setdefault(root.get(v, v), []).append(x)
    want = components(nodes)
    assert {x: min(g) for g in groups.values() for x in g} == want
    with pytest.raises(ValueError):
        simhash_dedup.links(spark.createDataFrame([(1,)], "fp long"), distance=4)


def test_one_of_each(spark):
    rows = texts() + ROWS
    df = frame(spark, rows)
    out = simhash_dedup.one_of_each(df)
    root = components([simhash(t) for _, t in rows])
    best = {}
    for d, t in rows:
        best.setdefault(root[simhash(t)], []).append((d is None, d or 0))
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted(min(v) for v in best.values())


def test_empty_tables(spark):
    assert simhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert simhash_dedup.one_of_each(frame(spark, [])).count() == 0
