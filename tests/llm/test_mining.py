"""Phrase mining, graph search and hard negatives against brute force."""

import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import ann, negatives, phrases
from larder.llm.common import table
from tests.llm.cases import LONG, frame

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- op11
def plain_phrases(docs, min_count=10, covered=50, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    count[lang, tuple(w[i:i + size])] += 1
    rows = []
    for (lang, w), a in count.items():
        if len(w) < 2 or a < min_count:
            continue
        if len(w) == 2 and any(100 * n >= covered * a and n >= min_count for (lg, v), n in longer(count, lang, w)):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = count[lang, w[:k]], count[lang, w[k:]]
            cuts.append((math.floor(Fraction(1000000 * a * a, left * right)), k, left, right))
        score, _, left, right = min(cuts)
        rows.append((lang, " ".join(w), a, left, right, total[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    out = []
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        out += [(r[0], i, *r[1:]) for i, r in enumerate(list(group)[:top], 1)]
    return out


def longer(count, lang, w):
    return [(key, n) for key, n in count.items() if key[0] == lang and len(key[1]) == 3 and w in (key[1][:2], key[1][1:])]


def mined_phrases(df, **how):
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in cols) for r in phrases.collocations(df, "lang", "text", **how).collect())


def test_phrases_against_brute_force(spark):
    rng = random.Random(5)
    words = ["Of", "the", "new", "york", "é", "ß", "a\x00b", "x\x85y", "zz", "time"]
    docs = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "])
                                                      for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    docs += [("en", None), ("en", ""), ("de", " .,\t\n"), ("en", "new york time " * 40), ("fr", "un deux trois quatre " * 11), (None, LONG)]
    docs += [("en", "same passage here again")] * 30
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    for how in ({"min_count": 10}, {"min_count": 3, "covered": 90, "top": 7}, {"min_count": 10, "share": 1}):
        plain = {k: v for k, v in how.items() if k != "share"}
        assert mined_phrases(df, **how) == sorted(plain_phrases(docs, **plain))


def test_phrases_close_after_border_failures(spark):
    """A sample that sees nothing still ends in the whole result, after more passes."""
    docs = [("en", "alpha beta gamma delta")] * 12 + [("en", "beta gamma")] * 3
    df = spark.createDataFrame(docs, "lang string, text string")
    report = []
    got = mined_phrases(df, share=10**9, report=report)
    assert got == sorted(plain_phrases(docs))
    assert len(report) == 3 and report[0]["new_words"] and report[1]["new_pairs"] and not report[2]["new_pairs"]


def test_phrases_of_odd_tables(spark):
    assert mined_phrases(frame(spark, lang=True).where("false")) == []
    odd = frame(spark, lang=True)
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert mined_phrases(odd) == sorted(plain_phrases(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB.é \t\n,\U0001F600", max_size=30), max_size=6))
def test_words_and_pieces(texts):
    import pyarrow as pa
    words, rows, joined = phrases.words_and_pieces(pa.array(texts, type=pa.large_string()))
    want = []
    for i, t in enumerate(texts):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.replace("B", "b")):
            w = re.findall(r"[^\x20\x09]+", piece)
            want += [(x, i, k + 1 < len(w)) for k, x in enumerate(w)]
    assert list(zip(words.to_pylist(), rows.tolist(), joined.tolist())) == want


@pytest.mark.parametrize("exact, border, kept", [(40, 10, 10**6), (10**6, 12, 10**6), (30, 10**6, 10**6), (10**6, 10**6, 25)])
def test_sums_handed_on_early_add_up(monkeypatch, exact, border, kept):
    """Whatever a task hands on before its end, the ranges merge to the sums of the whole."""
    import pyarrow as pa
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    chosen = phrases.Bits(12), phrases.Bits(12)
    chosen[0].data[:] = list(rng.randbytes(len(chosen[0].data)))
    chosen[1].data[:] = list(rng.randbytes(len(chosen[1].data)))

    def sums():
        tally, rows = phrases.Tally(phrases.Pass(*chosen)), []
        for i, text in enumerate(texts):
            found, _, joined = phrases.words_and_pieces(pa.array([text], type=pa.large_string()))
            tally.add("en" if i % 3 else "de", tally.numbered(found), joined)
            some, everything = tally.full()
            if some:
                rows += tally.handed_on(5, everything)
        rows += tally.handed_on(5)
        whole = pa.Table.from_batches(rows)
        out = []
        for r in range(5):
            part = whole.filter(pc.equal(whole["range"], r))
            if part.num_rows:
                out += [tuple(x.values()) for x in phrases._merge_range(2)(None, part).to_pylist()]
        return len(rows), sorted(out, key=repr)

    once, want = sums()
    monkeypatch.setattr(phrases, "KEYS_KEPT", {True: exact, False: border})
    monkeypatch.setattr(phrases, "WORDS_KEPT", kept)
    times, got = sums()
    assert once == 1 and times > 2 and got == want and len(want) > 60


# ---------------------------------------------------------------- op12
def vectors_frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], f"vec_id long, embedding array<{kind}>, node string, block string")


def nearest(vecs, ids, q, own, k):
    d = np.sqrt(((vecs - q) ** 2).sum(axis=1))
    keep = ids != own
    at = np.lexsort((ids[keep], d[keep]))[:k]
    return list(zip(ids[keep][at].tolist(), d[keep][at].tolist()))


def test_graph_recall(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    vecs, ids = np.stack(t["embedding"].to_numpy()).astype(np.float64), t["vec_id"].to_numpy()
    rows = ann.vector_rows(table(spark, "/root/testdata/sf0.1", "embeddings"), "vec_id", "embedding")
    index = ann.build_index(rows, 10, shard_rows=700)
    assert index.select("block").distinct().count() == 3 and index.count() == len(ids)
    got = {}
    for r in ann.search(index, rows.where("vec_id % 40 = 0"), 10, query_rows=20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11))
        want = nearest(vecs, ids, vecs[ids == q][0], q, 10)
        hits += len({v for v, _ in want} & {v for v, _ in found.values()})
        assert [s for _, s in sorted((k, v[1]) for k, v in found.items())] == sorted(v[1] for v in found.values())
        for v, s in found.values():
            assert s == pytest.approx(float(np.linalg.norm(vecs[ids == v][0] - vecs[ids == q][0])), rel=1e-12, abs=1e-12)
    assert len(got) == 50 and hits / (10 * len(got)) >= 0.95


def test_graph_edges_are_bounded_and_diverse():
    rng = np.random.default_rng(1)
    vecs = np.concatenate([rng.normal(size=(400, 8)), np.zeros((60, 8)) + 5 + 1e-4 * rng.normal(size=(60, 8))])
    graph = ann.Graph(vecs).build()
    assert graph.edges.shape == (460, ann.DEGREE)
    for i, e in enumerate(graph.edges):
        e = e[e >= 0]
        assert len(set(e.tolist())) == len(e) and i not in e
    found, _ = graph.walk(graph.vecs, 20)
    assert np.mean([i in f for i, f in enumerate(found.tolist())]) > 0.99  # every node can be reached


def test_graph_odd_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(100, same), (100, same), (200, same), (7, [1.0, 2.0]), (8, None), (9, [0.0, 0.0, 0.0]), (10, [1.0, None, 2.0]),
            (11, [float("nan"), 1.0, 1.0]), (12, [float("inf"), 1.0, 1.0]), (None, same), (300, []), (13, [1e30, 1.0, 1.0]), (14, [1.0, 2.0, 3.5])]
    rows += [(i, same) for i in range(1000, 1040)]  # more equal vectors than are asked for
    df = vectors_frame(spark, rows)
    clean = ann.vector_rows(df, "vec_id", "embedding")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in
                 ann.search(ann.build_index(clean, 3), clean.where("vec_id % 100 = 0"), 3).collect())
    assert got == [(100, 1, 200, 0.0), (100, 2, 1000, 0.0), (100, 3, 1001, 0.0),
                   (200, 1, 100, 0.0), (200, 2, 1000, 0.0), (200, 3, 1001, 0.0),
                   (1000, 1, 100, 0.0), (1000, 2, 200, 0.0), (1000, 3, 1001, 0.0)]
    few = ann.vector_rows(vectors_frame(spark, [(100, same), (7, [1.0, 2.0])]), "vec_id", "embedding")
    got = ann.search(ann.build_index(few, 10), few.where("vec_id = 100"), 10).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(100, 1, 7, 3.0)]
    none = clean.where("false")
    assert ann.search(ann.build_index(none, 10), none, 10).count() == 0


# ---------------------------------------------------------------- op13
def plain_negatives(rows, anchors=lambda i: i % 100 == 0, k=5):
    """rows: distinct (id, label, ints)."""
    out = []
    dot = lambda a, b: max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63))
    for i, label, v in rows:
        if not anchors(i):
            continue
        scored = [(-dot(v, w), j, lab) for j, lab, w in rows]
        positives = sorted((s, j) for s, j, lab in scored if lab == label and j != i)[:k]
        for s, j in positives:
            inside = sorted((t, m) for t, m, lab in scored if lab != label and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(inside, 1)]
    return sorted(out)


def mined_negatives(rows, anchors="vec_id % 100 = 0", **how):
    from pyspark.sql import functions as F
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in cols) for r in negatives.mined(rows, F.expr(anchors), **how).collect())


def whole(v):
    return [min(max(math.floor(256 * x), -(2**63)), 2**63 - 1) for x in v]


def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    rows = []
    for i in range(400):
        label = int(rng.integers(0, 5))
        near = centres[i % 4] if i % 3 else centres[0]  # a third of all rows lies together
        rows.append((i, [float(np.float32(x)) for x in near + 0.05 * rng.normal(size=6)], label))
    rows += [(i, [0.5] * 6, 1) for i in range(500, 560)] + [(600, [0.0] * 6, 1), (700, [], 2), (800, [1.0, 1.0], 1), (900, [-1.0] * 6, 9)]
    rows += [rows[0], rows[100]]
    bad = [(1000, None, 1), (1100, [1.0] * 6, None), (None, [1.0] * 6, 1), (1200, [None] * 6, 1), (1300, [float("nan")] * 6, 1),
           (1400, [float("-inf")] * 6, 1)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows + bad], "vec_id long, embedding array<float>, label int, block string, anchor string")
    from pyspark.sql import functions as F
    clean = negatives.scored_rows(df, "vec_id", "embedding", F.col("label"))
    want = plain_negatives(sorted({(i, lab, tuple(whole(v))) for i, v, lab in rows}))
    assert len(want) > 100
    assert mined_negatives(clean, block_rows=150, anchor_rows=3) == want
    assert mined_negatives(clean) == want
    assert mined_negatives(clean.where("false")) == []


def test_negatives_beyond_double_precision(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1, -1]) * rng.random() * 2.0**30 for _ in range(4)], i % 3) for i in range(120)]
    rows += [(200, [1e300] * 4, 0), (201, [1e300] * 4, 0), (202, [1e300] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    from pyspark.sql import functions as F
    clean = negatives.scored_rows(df, "vec_id", "embedding", F.col("label"))
    want = plain_negatives([(i, lab, whole(v)) for i, v, lab in rows], anchors=lambda i: i % 20 == 0)
    assert mined_negatives(clean, "vec_id % 20 = 0") == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    ints = np.concatenate([rng.integers(-300, 300, size=(12, 5)), np.zeros((1, 5), dtype=np.int64), [[256] * 5] * 2, [[-256] * 5]])
    norms = np.sqrt((ints.astype(float) ** 2).sum(axis=1))
    refs = negatives.directions(ints.astype(float), 4)
    angles = negatives.angles_to(ints, norms, refs)
    low, high = negatives.bounds(norms, angles, norms, angles)
    exact = ints @ ints.T
    assert (low <= exact).all() and (exact <= high).all()


def test_bounds_rule_pairs_out():
    """Rows that point elsewhere are not scored."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 64))
    ints = np.floor(256 * (centres[np.arange(400) % 8] + 0.1 * rng.normal(size=(400, 64)))).astype(np.int64)
    norms = np.sqrt((ints.astype(float) ** 2).sum(axis=1))
    angles = negatives.angles_to(ints, norms, negatives.directions(ints.astype(float)))
    _, high = negatives.bounds(norms, angles, norms, angles)
    own = (ints @ ints.T)[np.arange(400), (np.arange(400) + 8) % 400]  # a score within the cluster
    assert (high >= 0.8 * own[:, None]).mean() < 0.2
