"""BPE and packing against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import bpe, packing
from tests.llm.cases import ROWS, frame, order

BPE, WORDS = public_tokenizers.path(bpe.FILE), public_tokenizers.path(packing.FILE)
ODD = ["  a  b ", "\n\n x\t y z   　 q", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|startoftext|>",
       "it's we'll 'S can't I'VE", "a" * 300 + "   ", "日本語 テスト \U0001F600\U0001F600 \U0001F469‍\U0001F469‍\U0001F467",
       "\x85 x \x1c y \x0b\x0c z", "  ", "\n", "a \nb", "0123456789 12 ½ ² Ⅷ", "é ́x e ́", " lead", "İI ſ ΑΣ Σ's",
       "end.,;: end?! <|ENDOFTEXT|> x.<|endoftext|>", "q" * 3000 + " zz", "ab​c ﻿"]
ALL = ROWS + [(200 + i, t) for i, t in enumerate(ODD)]


def test_ids_and_texts_are_the_librarys(spark):
    t = Tokenizer.from_file(BPE)
    got = [tuple(r) for r in bpe.decode(bpe.encode(frame(spark, ALL), BPE), BPE).collect()]
    want = []
    for d, text in ALL:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, ids, t.decode(ids, skip_special_tokens=False)))
    assert order(got) == order(want)
    assert order(map(tuple, bpe.encode(frame(spark, ALL), BPE, decoded=True).collect())) == order(want)


def test_decode_of_any_ids(spark):
    t = Tokenizer.from_file(BPE)
    rng = np.random.default_rng(0)
    lists = [rng.integers(0, 50257, n).tolist() for n in (0, 1, 5, 200)] + [[220, 50256, 447], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df, BPE).collect()}
    assert got == {i: None if x is None else t.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}


def test_merge_rounds_on_repeats():
    c, t = bpe.codec(BPE), Tokenizer.from_file(BPE)
    words = ["a" * n for n in range(1, 40)] + ["abab" * n for n in range(1, 9)] + ["=-" * 50, "é" * 9]
    assert c.merge(words) == [t.encode(w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("total", [0, 1, 7, 4096, 4097, 12345, 4096 * 3 + 2048])
def test_capacities_are_exact(total):
    sizes = packing.capacities(total, 4096)
    assert sizes.sum() == total and all(s == 4096 or s & (s - 1) == 0 for s in sizes.tolist())


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.lognormal(5, 1, 3000).astype(np.int64) + 1, 4096)
    pieces, costs = packing.assign(lengths)
    rest = lengths < 4096
    full = np.bincount(pieces[:, 3], weights=pieces[:, 2])[len(costs) - len(packing.capacities(int(lengths[rest].sum()), 4096)):]
    level = costs[-len(full):][full == 4096]
    assert level.std() < 0.25 * level.mean()
    given = rng.permutation(len(lengths))  # as they come: less even
    where = np.cumsum(lengths[given]) // 4096
    plain = np.bincount(where, weights=packing.cost(lengths[given].astype(float)))[:-1]
    assert level.std() < plain.std()


def test_every_id_is_packed_once(spark):
    t = Tokenizer.from_file(WORDS)
    rows = ALL + [(400 + i, "some words of text " * (i % 50)) for i in range(200)]
    ids = {}
    for k, (d, text) in enumerate(rows):
        ids.setdefault((d, tuple(t.encode(text or "", add_special_tokens=False).ids) + (2,)), []).append(k)
    pieces = packing.pack(frame(spark, rows), WORDS, length=512, group=4).collect()
    sequences, docs = {}, {}
    for p in pieces:
        assert len(p.ids) == p.length and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.sequence_tokens))
        docs.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.ids))
    for s in sequences.values():
        at = 0
        for offset, n, total in sorted(s):
            assert offset == at
            at += n
        assert at == total and (at == 512 or at & (at - 1) == 0)
    assert sum(p.length for p in pieces) == sum(len(x) * len(v) for (_, x), v in ids.items())
    for (d, x), v in ids.items():
        if len([1 for (e, y) in ids if e == d and len(y) == len(x)]) == 1 and len(v) == 1:
            assert sum((p for _, p in sorted(docs[d, len(x)])), []) == list(x)


def test_empty_tables(spark):
    assert bpe.encode(frame(spark, []), BPE).count() == 0
    assert packing.pack(frame(spark, []), WORDS).count() == 0
    assert [r.length for r in packing.pack(frame(spark, [(1, None)]), WORDS).collect()] == [1]


def test_query_columns(spark):
    df = packing.query(spark, "/root/testdata/sf0.001")
    assert df.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    r = df.agg(F.sum("length"), F.countDistinct("doc_id")).first()
    one = df.where("start = 0").agg(F.sum("doc_tokens")).first()
    assert r[0] == one[0] and r[1] == 200


def test_pieces_that_come_twice_in_a_batch_shift_no_later_ones():
    ours, theirs = bpe.Codec(BPE), Tokenizer.from_file(BPE)
    for texts in ([" x", "a x", " x x"], ["b x y", " y", "new words here"], ["here are new words", " x", ""], [" x", "more of  them"]):
        ids, n = ours.encode(pa.array(texts, pa.large_string()))
        want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
