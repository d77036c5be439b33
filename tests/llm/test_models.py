"""Language spans and LM scores against plain Python, and held-out accuracy."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from larder.llm import langid, ngram_lm
from larder.llm.eliasfano import EliasFano, Trie
from tests.llm.cases import ROWS, frame

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n,labels,every", [(1, 3, 1), (2, 2, 9), (50, 4, 12), (1000, 5, 60), (777, 2, 777)])
def test_viterbi_is_the_best_path(n, labels, every):
    rng = np.random.default_rng(n)
    s = np.round(rng.normal(size=(n, labels)) * 4, 2)
    first = np.arange(n) % every == 0
    path = langid.viterbi(s, first, 6.0)
    value = sum(s[i, path[i]] for i in range(n)) - 6.0 * sum(path[i] != path[i - 1] and not first[i] for i in range(1, n))
    best = s[0].copy()
    for i in range(1, n):
        best = np.maximum(best, best.max() - (0.0 if first[i] else 6.0)) + s[i]
    assert math.isclose(value, best.max(), abs_tol=1e-9)


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(langid.learned_rows(spark.read.parquet(f"{SF}/documents.parquet")))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(langid.held_out())
    got = {r.doc_id: r for r in langid.identify(docs, model, ["doc_id"]).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([got[d].lang_pred == v for d, v in truth.items()]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_spans_of_mixed_text(spark, model):
    words = lambda lang: " ".join(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where(
        f"lang = '{lang}' AND n_chars > 900").limit(1).collect())[:600].rsplit(" ", 1)[0]
    text = words("de") + " " + words("fr")
    r = langid.identify(frame(spark, [(1, text)]), model, ["doc_id"]).first()
    share = collections.Counter()
    for lang, n in zip(r.span_langs, r.span_words):
        share[lang] += n
    assert r.span_langs[0] == "de" and r.span_langs[-1] == "fr" and share["de"] + share["fr"] > 0.9 * sum(share.values())


def test_language_edges(spark, model):
    rows = ROWS + [(70, "123 $$ --"), (71, "привет мир")]
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(frame(spark, rows), model, ["doc_id"]).collect()}
    assert {(1, "en"), (8, "de"), (2, "und"), (3, "und"), (4, "und"), (70, "und"), (None, "und")} <= got
    assert langid.identify(frame(spark, []), model, ["doc_id"]).count() == 0
    none = langid.train(frame(spark, [], lang=True))
    assert {r.lang_pred for r in langid.identify(frame(spark), none, ["doc_id"]).collect()} == {"und"}


def test_language_keep_returns_rows(spark, model):
    df = frame(spark, lang=True)
    out = langid.keep(df, model)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} >= {1, 7, 8, 9} and out.where("doc_id in (2, 3, 4)").count() == 0


@pytest.mark.parametrize("values", [
    [], [5], [0, 0, 0, 7, 2**64 - 1], list(range(1000)), "random", "dense"])
def test_elias_fano(values):
    rng = np.random.default_rng(1)
    if values == "random":
        values = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * 2 + 1)
    elif values == "dense":
        values = np.sort(rng.integers(0, 300, 1000).astype(np.uint64))
    values = np.array(values, dtype=np.uint64)
    e = EliasFano.of(values)
    assert (e.get(np.arange(len(values))) == values).all()
    ask = np.concatenate([values, rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.arange(400, dtype=np.uint64)])
    assert (e.successor(ask) == np.searchsorted(values, ask)).all()
    assert (e.find(values) == np.searchsorted(values, values)).all()


def test_trie_finds_its_pairs():
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, len(words), 3000), rng.integers(0, 500, 3000))})
    parent, before = np.array([p for p, _ in pairs]), np.array([b for _, b in pairs], dtype=np.uint64)
    logs = rng.normal(size=len(pairs))
    t = Trie(words, np.arange(len(words)), parent, before, logs)
    assert np.abs(t.mass(t.word(words[parent]), before) - logs).max() <= t.bin
    there = set(pairs)
    ask = [(p, b) for p in range(0, len(words), 3) for b in range(0, 600, 7)]
    got = t.mass(np.array([p for p, _ in ask]), np.array([b for _, b in ask], dtype=np.uint64))
    assert [not math.isnan(x) for x in got] == [x in there for x in ask]
    assert t.word(np.array([3], dtype=np.uint64))[0] == -1


def brute(rows, learn):
    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]) for d, t in rows]
    c, pairs = collections.Counter(), collections.Counter()
    for d, w in tokens:
        if learn(d):
            c.update(w)
            pairs.update(zip([None, *w], w))
    total, distinct = sum(c.values()), len(c)
    before = lambda v: c[""] if v is None else c[v]
    mu = lambda v: ngram_lm.STRENGTH
    return [(d, len(w), sum(c[x] > 0 for x in w), total,
             sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w),
             sum(math.log10((pairs[v, x] + mu(v) * (c[x] + 1) / (total + distinct + 1)) / (before(v) + mu(v)))
                 for v, x in zip([None, *w], w))) for d, w in tokens]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def check(got, want):
    got, want = (sorted(map(tuple, x), key=lambda r: repr(r[:4]) + f"{r[4]:.6f}") for x in (got, want))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        assert math.isclose(g[4], w[4], abs_tol=1e-6) and abs(g[5] - w[5]) < 0.02 * w[1]


def test_scores(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 300").collect()]
    rows += ROWS + [(900 + i, "very common words " * 200) for i in range(40)]
    got = ngram_lm.score(frame(spark, rows), "NOT coalesce(crc32(cast(doc_id AS string)) % 7 = 2, false)").collect()
    want = brute(rows, lambda d: not held(d))
    check(got, want)
    out = [r for r in want if held(r[0])]
    assert sum(r[5] for r in out) > sum(r[4] for r in out)  # better than the words alone, on texts not learned


def test_scores_edges(spark):
    assert ngram_lm.score(frame(spark, []), "true").count() == 0
    check(ngram_lm.score(frame(spark), "false").collect(), brute(ROWS, lambda d: False))
    check(ngram_lm.score(frame(spark), "true").collect(), brute(ROWS, lambda d: True))


@pytest.mark.parametrize("fill", [1_000, 400_000])
def test_pairs_weigh_the_same_at_every_size(spark, fill):
    m = ngram_lm.STRENGTH
    rows = [(i, "alpha beta") for i in range(300)] + [(1000, "alpha beta"), (1001, "some other filling words " * (fill // 4))]
    got = ngram_lm.score(frame(spark, rows), "doc_id <> 1000", strength=m).where("doc_id = 1000").first()
    total, distinct = 300 * 3 + fill + 1, 7
    want = 0.0
    for pair, before, count in ((300, 301, 300), (300, 300, 300), (300, 300, 301)):  # start alpha, alpha beta, beta end
        want += math.log10((pair + m * (count + 1) / (total + distinct + 1)) / (before + m))
    assert got.train_tokens == total and abs(got.score - want) < 0.02


def test_registered_scores(spark):
    """The query's own rows against the plain formula on whole texts."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = ngram_lm.query(spark, SF).collect()
    check([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], brute(rows, lambda d: not held(d)))
    assert {r.doc_id: r.held_out for r in got} == {d: held(d) for d, _ in rows}
