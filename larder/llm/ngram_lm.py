"""LM scoring with a sharded Elias-Fano bigram trie.

The trie stands on its last words, as tries for scoring do: level 1 has a word, level 2 the words
seen before it. A shard holds whole words, so their counts and quantised probabilities are all
there; it is a set of arrays in one memory-mapped file, queried by successor searches relative to
the word (see eliasfano).

P(w | v) = (c(v w) + m P(w)) / (c(v) + m), P(w) = (c(w) + 1) / (N + V + 1),
m = ``strength``, a constant: what a pair's counts weigh does not depend on the corpus around
them. In a sum of logs the divisor belongs to v alone; so each shard scores its own words, as last
words and as words before the next one, without asking another shard.

1. Words are counted per batch, then by Spark: N, V, and the words with more than 1 / HOT_PARTS of
   all tokens (HOT_PARTS at most, so they may be sent to every task).
2. Each batch of texts hands its (word, word before, document) counts to the slots of the words, a
   row per batch and slot; a hot word's are spread over all slots by the word before it.
3. A task has the slots of some ``TASK_BYTES`` of text, learned or not: it counts the training tokens, builds its
   shard, looks up all its entries and hands a sum per document back to each batch.
4. The sums of a batch meet.
What is gathered grows with the corpus; nothing is pruned, capped or sampled.

Words are told apart by 64-bit hashes (the word before by 40 bits of it, below its word).
Defined results: a null text counts as empty and has the end token alone; without training text
every token is unknown (N and V are 0); repeated rows are scored one by one; an empty table gives
no rows; other columns are not read. The rows must come in the same order when they are read
again, as those of a table do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.batches import coded, steps, text_column, words_of
from larder.llm.common import shuffle_tasks, stored, table
from larder.llm.eliasfano import Trie

#: Strength of the word's own probability below each word before it, at every size of the corpus: of 4, 64, 256, 1024
#: and 4096 the one that gave the texts not learned of sf0.1 most.
STRENGTH = 256.0
#: A word is hot from 1 / HOT_PARTS of all tokens.
HOT_PARTS = 4096
#: Bytes of text of a task and of a batch, rows of a batch (their number has 16 bits).
TASK_BYTES = 9 << 20
BATCH_BYTES = 6 << 20
BATCH_ROWS = 60_000
SLOTS_A_TASK = 16
#: Keys of the bytes of all texts, of the end and of the start of a text; the rest of a key is a hash, which may not be these.
BYTES, END, START = 0, 1, 2
BEFORE_BITS = 40
BEFORE = np.uint64((1 << BEFORE_BITS) - 1)
MOST = 127  # largest count of one entry; the top bit says that the document is one to learn from


def _keys(distinct: pa.Array) -> np.ndarray:
    found = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)
    return np.where(found <= START, found + np.uint64(3), found)


def _batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in steps(frames, "text", BATCH_BYTES):
        for a in range(0, step.num_rows, BATCH_ROWS):
            yield step.slice(a, BATCH_ROWS)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, its number among the distinct words, and their keys."""
    values, row = words_of(pc.ascii_lower(texts))
    code, distinct = coded(values)
    return row, code, _keys(distinct) if len(distinct) else np.zeros(0, np.uint64)


def count_words(docs: DataFrame) -> DataFrame:
    """docs: text, train. Columns key and n: the counts of the words and of the end, in training texts, and the bytes of
    all texts."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(frames):
            learn = batch.filter(batch.column(batch.schema.get_field_index("train")))
            if learn.num_rows:
                _, code, keys = _tokens(text_column(learn, "text"))
                n = np.bincount(code, minlength=len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(keys, np.uint64(END)).view(np.int64)), pa.array(np.append(n, learn.num_rows))],
                    names=["key", "n"])
            size = pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index("text")))).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([BYTES], pa.int64()), pa.array([size], pa.int64())], names=["key", "n"])

    return docs.select("text", "train").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _entries(texts: pa.Array, train: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word key, key of the word before, row, flagged count), sorted by the first three, and tokens of each row."""
    row, code, keys = _tokens(texts)
    keys = np.append(keys, np.array([END, START], dtype=np.uint64))
    end, start = len(keys) - 2, len(keys) - 1
    n = np.bincount(row, minlength=len(texts)).astype(np.int64) if len(row) else np.zeros(len(texts), np.int64)
    ends = np.cumsum(n)
    word = np.insert(code, ends, end)
    row = np.insert(row, ends, np.arange(len(texts)))
    before = np.append(start, word[:-1])
    before[before == end] = start
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.arange(len(keys))
    width = max(1, int(len(keys)).bit_length())
    rows = max(1, len(texts).bit_length())
    if 2 * width + rows > 63:
        raise ValueError("a batch has too many words")
    packed = np.sort(place[word] << (width + rows) | place[before] << rows | row)
    new = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
    count = np.diff(np.append(new, len(packed)))
    packed = packed[new]
    parts = -(-count // MOST)  # larger counts take more than one entry
    packed, left = np.repeat(packed, parts), np.repeat(count, parts)
    turn = np.arange(len(packed)) - np.repeat(np.cumsum(parts) - parts, parts)
    count = np.minimum(left - turn * MOST, MOST)
    keys = keys[order]
    at = packed & ((1 << rows) - 1)
    flag = np.where(train[at], 128, 0)
    return (keys[packed >> (width + rows)], keys[packed >> rows & ((1 << width) - 1)] & BEFORE, at.astype(np.uint16),
            (count | flag).astype(np.uint8), n + 1)


def _dump(word: np.ndarray, before: np.ndarray, row: np.ndarray, count: np.ndarray) -> bytes:
    """Planes of one kind each: distinct words and their numbers, words before (32 + 8 bits), rows, counts."""
    new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    sizes = np.diff(np.append(new, len(word))).astype(np.uint32)
    head = np.array([len(new), len(word)], dtype=np.uint32)
    return b"".join(x.tobytes() for x in (
        head, word[new], sizes, (before & np.uint64(0xFFFFFFFF)).astype(np.uint32),
        (before >> np.uint64(32)).astype(np.uint8), row, count))


def _load(data: bytes) -> tuple[np.ndarray, ...]:
    words, n = np.frombuffer(data, np.uint32, 2).tolist()
    at, out = 8, []
    for kind, size in ((np.uint64, words), (np.uint32, words), (np.uint32, n), (np.uint8, n), (np.uint16, n), (np.uint8, n)):
        out.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    word, sizes, low, high, row, count = out
    return np.repeat(word, sizes), low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), row, count


def _shard(keys: np.ndarray, index: np.ndarray, before: np.ndarray, times: np.ndarray, learn: np.ndarray, hot: tuple, total: int,
           distinct: int, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Builds the shard of these entries (index: of the word among keys) and looks them up: for each
    entry the count of its word, log10 of its probability mass, and log10 of its word's divisor as
    a word before."""
    counts = np.bincount(index, weights=np.where(learn, times, 0), minlength=len(keys)).astype(np.int64)
    hot_keys, hot_counts = hot  # a hot word's entries lie in many shards: its count comes from step 1
    at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
    counts = np.where(hot_keys[at] == keys, hot_counts[at], counts)
    own = (counts + 1) / (total + distinct + 1)
    pair = index[learn].astype(np.uint64) << np.uint64(BEFORE_BITS) | before[learn]
    order = np.argsort(pair, kind="stable")
    pair, weight = pair[order], times[learn][order].astype(np.float64)
    new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[:len(pair)])
    seen = np.add.reduceat(weight, new) if len(new) else np.zeros(0)
    parent = (pair[new] >> np.uint64(BEFORE_BITS)).astype(np.int64)
    trie = Trie(keys, counts, parent, pair[new] & BEFORE, np.log10(seen + strength * own[parent]))
    del pair, weight, order, parent, seen, new
    # every entry asks the shard; equal questions stand together, so each is asked once
    ask = index.astype(np.uint64) << np.uint64(BEFORE_BITS) | before
    asked, back = np.unique(ask, return_inverse=True)
    asked_keys = keys[(asked >> np.uint64(BEFORE_BITS)).astype(np.int64)]
    node = trie.word(asked_keys)
    mass = trie.mass(node, asked & BEFORE)
    count = trie.counts[node]
    del ask
    mass = np.where(np.isnan(mass), np.log10(strength * (count + 1) / (total + distinct + 1)), mass)
    divisor = np.where(asked_keys == END, 0.0, np.log10(count + strength))
    return count[back], mass[back], divisor[back]


def score(df: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH) -> DataFrame:
    """One row per input row: the id, n_tokens, n_known, train_tokens, base_score and score.
    ``train``: SQL of a condition, the rows to learn from (null: not). ``strength``: m, over 0."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                     F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    counted = stored(spark, count_words(docs), "words")
    size = counted.where(F.col("key") == BYTES).first()
    counted = counted.where(F.col("key") != BYTES)
    sums = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    texts = counted.where(F.col("key") == END).first()
    texts = int(texts["n"]) if texts else 0
    few = counted.where(F.col("n") * HOT_PARTS >= total).orderBy("key").collect() if total else []  # HOT_PARTS at most
    hot_keys = np.array([START, *(r["key"] for r in few)], dtype=np.int64).view(np.uint64)
    order = np.argsort(hot_keys)
    hot = hot_keys[order], np.array([texts, *(r["n"] for r in few)], dtype=np.int64)[order]
    tasks = max(shuffle_tasks(spark), -(-int(size["n"] if size else 0) // TASK_BYTES))
    slots = tasks * SLOTS_A_TASK
    id_type = docs.schema["id"].dataType

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in _batches(frames):
            number += 1
            learn = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), dtype=bool)
            word, before, row, count, n = _entries(text_column(batch, "text"), learn)
            is_hot = np.isin(word, hot[0])
            slot = (_spread(np.where(is_hot, _spread(word) ^ before, word)) % np.uint64(slots)).astype(np.int64)
            by = np.argsort(slot, kind="stable")
            cuts = np.flatnonzero(np.append(True, slot[by][1:] != slot[by][:-1]))
            rows = [(int(slot[by[a]]), _dump(*(x[by[a:b]] for x in (word, before, row, count))))
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)])]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            tokens = pa.array([n.tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()),
                 pa.array([d for _, d in rows], pa.binary()), pa.nulls(len(rows), ids.type),
                 pa.nulls(len(rows), tokens.type)], names=["slot", "batch", "data", "ids", "tokens"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([number % slots], pa.int64()), pa.array([number], pa.int64()), pa.nulls(1, pa.binary()), ids, tokens],
                names=["slot", "batch", "data", "ids", "tokens"])
            del rows, word, before, row, count, slot, by
            pa.default_memory_pool().release_unused()

    def look_up(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, batch_of = [], []
        for frame in frames:
            info = frame.filter(pc.is_null(frame.column(2)))
            if info.num_rows:
                yield info.drop_columns(["slot"])
            mine = frame.filter(pc.is_valid(frame.column(2)))
            parts += [_load(d) for d in mine.column(2).to_pylist()]
            batch_of += mine.column(1).to_pylist()
        if not parts:
            return
        sizes = [len(p[0]) for p in parts]
        columns = [list(x) for x in zip(*parts)]
        parts.clear()
        count, row, before, word = (np.concatenate(columns.pop()) for _ in range(4))
        pa.default_memory_pool().release_unused()
        learn, times = count >= 128, (count & MOST).astype(np.float32)
        keys, index = np.unique(word, return_inverse=True)
        del word, count
        index = index.astype(np.int32)
        found, mass, divisor = _shard(keys, index, before, times, learn, hot, total, distinct, strength)
        del index, before, learn
        names, number = np.unique(np.array(batch_of, dtype=np.int64), return_inverse=True)
        place = np.repeat(number, sizes) << 16 | row
        docs_, back = np.unique(place, return_inverse=True)
        n = len(docs_)
        known = np.bincount(back, weights=times * (found > 0), minlength=n).astype(np.uint32)
        base = np.bincount(back, weights=times * np.log10(found + 1.0), minlength=n)
        got = np.bincount(back, weights=times * (mass - divisor), minlength=n).astype(np.float32)
        cuts = np.flatnonzero(np.append(True, docs_[1:] >> 16 != docs_[:-1] >> 16)).tolist()
        for a, b in zip(cuts, [*cuts[1:], n]):
            data = b"".join(x.tobytes() for x in ((docs_[a:b] & 0xFFFF).astype(np.uint16), known[a:b], base[a:b], got[a:b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(names[docs_[a] >> 16])], pa.int64()), pa.array([data], pa.binary()),
                 pa.nulls(1, pa.list_(id_arrow)), pa.nulls(1, pa.list_(pa.int64()))],
                names=["batch", "data", "ids", "tokens"])

    def add_up(sums_: pa.Table) -> pa.Table:
        info = sums_.filter(pc.is_null(sums_["data"]))
        ids, n = info["ids"].combine_chunks().flatten(), info["tokens"].combine_chunks().flatten()
        known, base, got = (np.zeros(len(ids)) for _ in range(3))
        for data in sums_["data"].drop_null().to_pylist():
            size = len(data) // 18
            at = np.frombuffer(data, np.uint16, size)
            known[at] += np.frombuffer(data, np.uint32, size, size * 2)
            base[at] += np.frombuffer(data, np.float64, size, size * 6)
            got[at] += np.frombuffer(data, np.float32, size, size * 14)
        tokens = n.to_numpy()
        return pa.table([ids, n, pa.array(known.astype(np.int64)), pa.array(base - tokens * np.log10(total + distinct + 1)),
                         pa.array(got - np.log10(texts + strength))], names=out.names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)
    listed = [T.StructField("ids", T.ArrayType(id_type)), T.StructField("tokens", T.ArrayType(T.LongType()))]
    dealt = T.StructType([T.StructField("slot", T.LongType()), T.StructField("batch", T.LongType()),
                          T.StructField("data", T.BinaryType()), *listed])
    replied = T.StructType(dealt.fields[1:])
    out = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()),
                        T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()),
                        T.StructField("score", T.DoubleType())])
    entries = docs.mapInArrow(deal, dealt).repartition(tasks, "slot")
    scored = entries.mapInArrow(look_up, replied).groupBy("batch").applyInArrow(add_up, out)
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known",
                         F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "crc32(cast(doc_id AS string)) % 7 = 2"
    return score(table(spark, sf_dir, "documents"), f"NOT coalesce({held_out}, false)").select(
        "doc_id", F.expr(f"coalesce({held_out}, false)").alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")
