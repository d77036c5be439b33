"""Cost-balanced packing of tokenized documents into sequences.

Each task packs what it reads, in groups of ``GROUP`` sequences, so nothing is shuffled and a
group is all that is held. In a group, whole sequences are cut off long documents; the rest,
longest first, goes to the sequence of the lowest cost (linear plus quadratic in a piece's
length, as attention is) that has room. A piece that fits nowhere is cut. The last tokens of a
group, less than one sequence, fill sequences whose lengths are powers of two, so there is no
padding at all.

Defined results: a null text counts as empty and has the end id alone; repeated rows are packed
one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.batches import Remembered, coded, kept, ragged, steps, strings, take, text_column, words_of
from larder.llm.common import table

FILE = "word_bpe_49k.json"
END_ID = 2
LENGTH = 4096
#: Sequences of a group.
GROUP = 256
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (in units of one token's layer work).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
COLUMNS = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "sequence_tokens long, sequence_cost double")


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


#: Distinct words kept by one Python worker; signs that end words and are words of their own.
KEPT_WORDS = 600_000
END_SIGNS = ".,;:!?"


@kept
@lru_cache(maxsize=2)
def _encoder(path: str, limit: int) -> Remembered:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return Remembered(lambda words: ragged([e.ids for e in made.encode_batch_fast(words, add_special_tokens=False)]),
                      limit)


def tokens(texts: pa.Array, path: str, kept_words: int = KEPT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts with END_ID after each, and their numbers.

    This file's words never cross white space, nor the end of ASCII letters before end signs, and
    its normalizer lower-cases; so distinct words without their end signs, and these signs, are
    encoded once. Lower-casing first is left out where it could make a special token.
    """
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    values, row = words_of(texts)
    code, distinct = coded(values)
    core = pc.ascii_rtrim(distinct, characters=END_SIGNS)
    parted = pc.match_substring_regex(core, "[A-Za-z]$")  # else the word stays whole
    core = pc.if_else(parted, core, distinct)
    signs = pa.array([d[len(c):] for d, c in zip(strings(distinct), strings(core))], pa.large_string())
    part, parts = coded(pa.concat_arrays([core, signs]))
    ids, offsets, which = _encoder(path, kept_words)(strings(parts))
    pairs = which[part].reshape(2, -1).T.reshape(-1)  # core, signs, core, signs, ...
    word_ids, lengths = take(ids, offsets, pairs)
    word_offsets = np.append(0, np.cumsum(lengths))[::2]
    out, lengths = take(word_ids, word_offsets, code)
    counts = np.bincount(row, weights=lengths, minlength=len(texts)).astype(np.int64) if len(row) else np.zeros(
        len(texts), np.int64)
    return np.insert(out, np.cumsum(counts), END_ID), counts + 1


def capacities(total: int, length: int) -> np.ndarray:
    """Sequences for ``total`` tokens: full ones, and powers of two for what is left."""
    left = total % length
    tail = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    return np.array([length] * (total // length) + tail, dtype=np.int64)


def assign(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (document, start, length, sequence, offset) of one group, and the cost of each sequence."""
    pieces = []
    whole = lengths // length
    sequence = 0
    for d in np.flatnonzero(whole).tolist():
        for k in range(int(whole[d])):
            pieces.append((d, k * length, length, sequence, 0))
            sequence += 1
    rest = lengths - whole * length
    room = capacities(int(rest.sum()), length)
    size = room.copy()
    spent = np.zeros(len(room))
    for d in np.argsort(-rest, kind="stable").tolist():
        start, left = int(whole[d]) * length, int(rest[d])
        while left:
            fits = np.flatnonzero(room >= left)
            if len(fits):
                s = int(fits[np.argmin(spent[fits])])
                n = left
            else:
                s = int(np.argmax(room))
                n = int(room[s])
            pieces.append((d, start, n, sequence + s, int(size[s] - room[s])))
            room[s] -= n
            spent[s] += cost(n)
            start, left = start + n, left - n
    return np.array(pieces, dtype=np.int64).reshape(-1, 5), np.append(np.full(sequence, cost(float(length))), spent)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         group: int = GROUP, with_ids: bool = True, kept_words: int = KEPT_WORDS) -> DataFrame:
    """One row per piece: the id column, COLUMNS and, ``with_ids``, its ids (array<int>). ``kept_words``: encoded words
    that a worker keeps, which bounds its memory and changes no result."""
    kind = df.schema[id_col].dataType.simpleString()

    def packed(keys: list, ids: list, counts: list, first: int) -> tuple[pa.RecordBatch, int]:
        key, flat, n = pa.concat_arrays(keys), np.concatenate(ids), np.concatenate(counts)
        flat = flat.astype("<u4")
        pieces, costs = assign(n, length)
        begin = (np.cumsum(n) - n)[pieces[:, 0]] + pieces[:, 1]
        cuts = [flat[a:b] for a, b in zip(begin.tolist(), (begin + pieces[:, 2]).tolist())]
        seq = pieces[:, 3]
        held = np.bincount(seq, weights=pieces[:, 2], minlength=len(costs)).astype(np.int64)
        columns = [
            key.take(pa.array(pieces[:, 0])), pa.array(pieces[:, 1]), pa.array(pieces[:, 2]),
            pa.array([zlib.crc32(c.tobytes()) for c in cuts], pa.int64()), pa.array(n[pieces[:, 0]]),
            pa.array(seq + first), pa.array(pieces[:, 4]), pa.array(held[seq]), pa.array(costs[seq])]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens",
                 "sequence_cost"]
        if with_ids:
            columns.append(pa.array([c.astype(np.int32) for c in cuts], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names), len(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40  # a task's sequences have numbers of their own
        keys, ids, counts, held = [], [], [], 0
        for step in steps(batches, "text"):
            got, n = tokens(text_column(step, "text"), path, kept_words)
            keys.append(step.column(0))
            ids.append(got)
            counts.append(n)
            held += len(got)
            if held >= group * length:
                out, used = packed(keys, ids, counts, sequence)
                yield out
                sequence += used
                keys, ids, counts, held = [], [], [], 0
        if held:
            yield packed(keys, ids, counts, sequence)[0]

    schema = f"`{id_col}` {kind}, {COLUMNS}" + (", ids array<int>" if with_ids else "")
    return df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), path or tokenizer_file(), with_ids=False)
