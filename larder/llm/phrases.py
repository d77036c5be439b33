"""Phrase collocation mining: Toivonen's sampling with exact counts, phrases of two or three words.

1. A sample of the documents (one in ``SAMPLE_SHARE``) proposes words and pairs that it holds at least
   ``SAMPLE_SEEN`` times.
2. A full pass counts the proposed phrases exactly, and their negative border as far as it occurs: all
   other words, all other pairs of two proposed words, all triples of two proposed pairs. The border is
   long and rare, so it is counted under keys of 48 bits; two phrases of one key can only seem
   more frequent than they are.
3. Phrases of the border that reach the count are its failures: a further pass counts them exactly as
   themselves, with the phrases that come into question by them: pairs of new words and triples of
   new pairs. Passes follow until no new frequent word or pair comes up, so nothing depends on the sample but
   the number of passes: a phrase is frequent only if its parts are.

The sets that a pass asks for are bit tables of fixed size (``WORD_BITS``, ``PAIR_BITS``) over the keys, so what
goes to the tasks does not grow with the corpus. A bit that two keys share makes a phrase be counted that
need not be; since all tasks ask the same tables, a phrase is counted everywhere or nowhere, and
the earlier passes' tables say exactly which were. Tasks count in arrays of word numbers and hand
on partial sums as sorted arrays, one row for each range of keys, so a phrase that a third of the corpus
repeats is a few entries. The number of ranges follows from the bytes of text (``RANGE_BYTES``), and each range is
merged by a task of its own.

Score of a cut after k words: floor(10**6 * a * a / (l * r)) in whole numbers of 38 digits (exact while
a is below 10**16); the lowest cut counts, ties to the smallest k.

Defined results: a null text counts as empty, a null language as ``und``; empty texts and texts of
separators alone have no words; repeated rows count each; control characters but tab and the separators
are part of words; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.batches import steps, strings, text_column
from larder.llm.common import stored, table, whole
from larder.llm.vectors import blocks_of
from larder.operators.ordinal import scan_within

SAMPLE_SHARE = 8
SAMPLE_SEEN = 2
WORD_BITS = 24
PAIR_BITS = 26
#: Words that a task numbers before it hands on its sums (21 bits of a key), and keys that it holds.
WORDS_KEPT = 1 << 17
KEYS_KEPT = {True: 1 << 19, False: 1 << 18}  # exact ones, the border's
STEP = 1 << 20
#: Bytes of text whose keys make one range.
RANGE_BYTES = 4 << 20

#: Blanks between words, marks between pieces, capitals that are lowered.
BLANKS = b"\x20\x09"
MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[list(BLANKS)] = 1
CLASS[list(MARKS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

COUNT_SCHEMA = "size int, key bigint, lang string, phrase string, n bigint"
RANGE_SCHEMA = ("range int, low binary, high binary, counts binary, sizes array<int>, langs array<string>, "
                "phrases array<string>, sums array<bigint>")
SHIFT = 21
LOW = (1 << SHIFT) - 1


# ---------------------------------------------------------------- words of a batch
def words_and_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words in lower case, the row of each, and whether the word after it is in the same piece."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = CLASS[raw]
    part = kind == 0
    begins = part.copy()
    begins[1:] &= ~part[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    begins[heads] = part[heads]
    starts = np.flatnonzero(begins)
    kept = np.cumsum(part, dtype=np.int32)  # a step is far below 2**31 bytes, a text too
    ends = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(LOWER[raw[part]]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    marks = np.cumsum(kind == 2, dtype=np.int32)[starts]
    joined = np.zeros(len(starts), dtype=bool)
    joined[:-1] = (marks[1:] == marks[:-1]) & (rows[1:] == rows[:-1])
    return words, rows, joined


# ---------------------------------------------------------------- sets as bit tables
def word_hash(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def longer_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a phrase from the key of all its words but the last, and the hash of that one."""
    return mixed(key * np.uint64(0x9E3779B97F4A7C15) + word)


def phrase_keys(langs: list[str], phrases: list[str]) -> pa.Array:
    """Keys of whole phrases (words with one blank between them)."""
    words = [p.split(" ") for p in phrases]
    base = {lang: xxhash.xxh3_64_intdigest(lang) for lang in set(langs)}
    first = np.fromiter((xxhash.xxh3_64_intdigest(w[0]) ^ base[lang] for lang, w in zip(langs, words)), np.uint64, len(words))
    key = mixed(first)
    for k in (1, 2):
        rows = np.array([i for i, w in enumerate(words) if len(w) > k], dtype=np.int64)
        key[rows] = longer_key(key[rows], word_hash([words[i][k] for i in rows]))
    return pa.array(key.view(np.int64))


class Bits:
    """A set of hashes as a table of 2**bits bits; a bit may stand for more than one key."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(1 << (bits - 3), dtype=np.uint8) if data is None else data

    def places(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def bits_of(found: DataFrame, size: int, bits: int) -> Bits:
    """The table of the keys of phrases of ``size`` words: 2**bits / 64 rows at most come to the driver,
    whatever the number of phrases."""
    place = F.shiftrightunsigned("key", 64 - bits)
    slots = found.where(F.col("size") == size).select(place.alias("place")).select(
        F.shiftright("place", 6).alias("slot"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bits"))
    slots = slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    return Bits(bits, out.view(np.uint8))


class Pass:
    """What a pass counts. ``words``, ``pairs``: proposed in the first pass, frequent ones in later passes.
    ``before``: the passes before it; ``failed``: their border's failures by size."""

    def __init__(self, words: Bits, pairs: Bits, before: list["Pass"] = (), failed: dict[int, Bits] | None = None):
        self.words, self.pairs, self.before, self.failed = words, pairs, list(before), failed

    def _reached(self, table: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits = getattr(self, table)
        return bits.has(a) & bits.has(b)

    def judged(self, size: int, key: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> tuple:
        """Which occurrences to count exactly, and which under their key; ``a``, ``b``: keys of the two parts."""
        table = {1: None, 2: "words", 3: "pairs"}[size]
        if not self.before:
            asked = np.ones(len(key), dtype=bool) if size == 1 else self._reached(table, a, b)
            own = {1: self.words, 2: self.pairs}.get(size)
            exact = asked & own.has(key) if own else np.zeros(len(key), dtype=bool)
            return exact, asked & ~exact
        first, later = self.before[0], self.before[1:]
        known = first._reached(table, a, b) if size > 1 else np.ones(len(key), dtype=bool)
        # asked by the first pass: only what failed there, once
        own = {1: first.words, 2: first.pairs}.get(size)
        exact = known & self.failed[size].has(key) if not later else np.zeros(len(key), dtype=bool)
        if own is not None and not later:
            exact &= ~own.has(key)
        if size > 1:
            new = ~known & self._reached(table, a, b)
            for old in later:
                new &= ~old._reached(table, a, b)
            exact |= new
        return exact, np.zeros(len(key), dtype=bool)


# ---------------------------------------------------------------- one task
class Tally:
    """Partial sums of one task: word numbers by language, size and kind, handed on before they outgrow it."""

    def __init__(self, asked: Pass | None):
        self.asked = asked
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.words: list[str] = []
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.sums: dict[tuple[str, int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.totals: dict[str, int] = {}
        self.held = {True: 0, False: 0}  # exact sums, the border's

    def numbered(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        distinct = strings(coded.dictionary)
        new = [w for w in distinct if w not in self.numbers]
        if new:
            self.numbers.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.words += new
            self.hashes = np.concatenate([self.hashes, word_hash(new)])
        place = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        return place[np.asarray(coded.indices, dtype=np.int64)]

    def put(self, lang: str, size: int, exact: bool, codes: np.ndarray) -> None:
        if len(codes):
            codes, n = np.unique(codes, return_counts=True)
            self.sums.setdefault((lang, size, exact), []).append((codes, n))
            self.held[exact] += len(codes)

    def add(self, lang: str, codes: np.ndarray, joined: np.ndarray) -> None:
        """Words in order, and whether the next one continues the piece."""
        self.totals[lang] = self.totals.get(lang, 0) + len(codes)
        h, base = self.hashes, np.uint64(xxhash.xxh3_64_intdigest(lang))
        first = mixed(h ^ base)  # keys of the words
        two = joined[:-1]
        a, b = codes[:-1][two], codes[1:][two]
        if self.asked is None:
            self.put(lang, 1, False, codes)
            self.put(lang, 2, False, a << SHIFT | b)
            return
        exact, border = self.asked.judged(1, first)
        self.put(lang, 1, True, codes[exact[codes]])
        self.put(lang, 1, False, codes[border[codes]])
        if not len(a):
            return
        # pairs are judged once a distinct pair of the batch, not once an occurrence
        pairs, where = np.unique(a << SHIFT | b, return_inverse=True)
        a, b = pairs >> SHIFT, pairs & LOW
        key = longer_key(first[a], h[b])
        exact, border = self.asked.judged(2, key, first[a], first[b])
        self._counted(lang, 2, pairs, where, exact, border)
        place = np.full(len(codes) - 1, -1)
        place[two] = where
        i = np.flatnonzero(two[:-1] & two[1:])
        left, right = place[i], place[i + 1]
        if not len(i):
            return
        last = b[right]
        exact, border = self.asked.judged(3, longer_key(key[left], h[last]), key[left], key[right])
        triple = pairs[left] << SHIFT | last
        self.put(lang, 3, True, triple[exact])
        self.put(lang, 3, False, triple[border])

    def _counted(self, lang: str, size: int, codes: np.ndarray, where: np.ndarray, exact: np.ndarray, border: np.ndarray) -> None:
        n = np.bincount(where, minlength=len(codes))
        for kind, mask in ((True, exact), (False, border)):
            if mask.any():
                self.sums.setdefault((lang, size, kind), []).append((codes[mask], n[mask]))
                self.held[kind] += int(mask.sum())

    def merged(self, kind: bool) -> None:
        self.held[kind] = 0
        for at, parts in self.sums.items():
            if at[2] == kind:
                if len(parts) > 1:
                    self.sums[at] = [summed(np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts]))]
                self.held[kind] += len(self.sums[at][0][0])

    def full(self) -> tuple[bool, bool]:
        """Whether anything has to be handed on, and whether all of it: the exact sums of a task are worth keeping."""
        over = {True: len(self.words) > WORDS_KEPT, False: False}
        for kind, limit in KEYS_KEPT.items():
            if self.held[kind] > limit:
                self.merged(kind)
                over[kind] |= self.held[kind] > limit // 2
        return any(over.values()), over[True]

    def handed_on(self, ranges: int, everything: bool = True) -> Iterator[pa.RecordBatch]:
        """One row for each range of keys that has any; else than ``everything`` only the border's sums."""
        self.merged(False)
        if everything:
            self.merged(True)
        words = pa.array(self.words, type=pa.string())
        border: list[tuple[np.ndarray, np.ndarray]] = []
        sizes, keys, langs, phrases, sums = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [pa.array([], pa.string())], [
            pa.array([], pa.string())], [np.zeros(0, np.int64)]
        for lang, size, exact in [at for at in self.sums if everything or not at[2]]:
            [(codes, n)] = self.sums.pop((lang, size, exact))
            base = np.uint64(xxhash.xxh3_64_intdigest(lang))
            parts = [codes >> (SHIFT * (size - 1 - i)) & LOW for i in range(size)]
            key = mixed(self.hashes[parts[0]] ^ base)
            for part in parts[1:]:
                key = longer_key(key, self.hashes[part])
            if exact:
                named = [words.take(pa.array(part)) for part in parts]
                phrases.append(named[0] if size == 1 else pc.binary_join_element_wise(*named, " "))
                langs.append(pa.array([lang] * len(codes), type=pa.string()))
                sizes.append(np.full(len(codes), size, dtype=np.int32))
                keys.append(key)
                sums.append(n.astype(np.int64))
            else:
                border.append((key >> np.uint64(18) << np.uint64(2) | np.uint64(size), n))
        if everything and self.totals:
            langs.append(pa.array(list(self.totals), type=pa.string()))
            phrases.append(pa.array([""] * len(self.totals), type=pa.string()))
            sizes.append(np.zeros(len(self.totals), dtype=np.int32))
            keys.append(word_hash(list(self.totals)))
            sums.append(np.array(list(self.totals.values()), dtype=np.int64))
        yield self._rows(border, np.concatenate(sizes), np.concatenate(keys), pa.concat_arrays(langs), pa.concat_arrays(phrases),
                         np.concatenate(sums), ranges)
        if everything:
            self.clear()
        self.held[False] = 0
        pa.default_memory_pool().release_unused()

    @staticmethod
    def _rows(border: list, sizes: np.ndarray, keys: np.ndarray, langs: pa.Array, phrases: pa.Array, sums: np.ndarray,
              ranges: int) -> pa.RecordBatch:
        key, n = summed(np.concatenate([k for k, _ in border]), np.concatenate([x for _, x in border])) if border else (
            np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cuts = np.searchsorted(range_of(key << np.uint64(16), ranges), np.arange(ranges + 1))
        place = range_of(keys, ranges)
        order = np.argsort(place, kind="stable")
        marks = np.searchsorted(place[order], np.arange(ranges + 1)).astype(np.int32)

        def packed(values: np.ndarray) -> pa.Array:
            offsets = (cuts * values.itemsize).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), ranges, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])

        def listed(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(marks), values.take(pa.array(order)))

        rows = pa.record_batch({
            "range": pa.array(np.arange(ranges, dtype=np.int32)), "low": packed((key & np.uint64(0xFFFFFFFF)).astype(np.uint32)),
            "high": packed((key >> np.uint64(32)).astype(np.uint16)), "counts": packed(n.astype(np.uint32)),
            "sizes": listed(pa.array(sizes)), "langs": listed(langs), "phrases": listed(phrases), "sums": listed(pa.array(sums))})
        return rows.filter(pa.array((np.diff(cuts) > 0) | (np.diff(marks) > 0)))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[heads], np.add.reduceat(n, heads)


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a 64-bit key; it rises with the key."""
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _merge_range(least: int):
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        def all_of(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, dtype=kind) for x in rows[name].to_pylist() if x] or [np.zeros(0, dtype=kind)])

        border, n = summed(all_of("high", np.uint16).astype(np.uint64) << np.uint64(32) | all_of("low", np.uint32),
                           all_of("counts", np.uint32).astype(np.int64))
        border, n = border[n >= least], n[n >= least]
        flat = {name: pa.concat_arrays([x.flatten() for x in rows[column].chunks]) for name, column in (
            ("size", "sizes"), ("lang", "langs"), ("phrase", "phrases"), ("n", "sums"))}
        exact = pa.table(flat).group_by(["size", "lang", "phrase"]).aggregate([("n", "sum")])
        exact = exact.filter(pc.or_(pc.equal(exact["size"], 0), pc.greater_equal(exact["n_sum"], least)))
        names = ["size", "key", "lang", "phrase", "n"]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        exact = [exact["size"], pa.chunked_array([phrase_keys(exact["lang"].to_pylist(), exact["phrase"].to_pylist())]), exact["lang"],
                 exact["phrase"], exact["n_sum"]]
        counted = [(border & np.uint64(3)).astype(np.int32), (border >> np.uint64(2) << np.uint64(18)).view(np.int64),
                   pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.string()), n]
        return pa.table({name: pa.chunked_array([*a.cast(kind).chunks, pa.array(b, type=kind)], type=kind)
                         for name, kind, a, b in zip(names, kinds, exact, counted)})

    return merge


def counted(docs: DataFrame, asked: Pass | None, ranges: int, least: int) -> DataFrame:
    """size, key, lang, phrase, n over docs (lang, text), from ``least`` on: exact sums (with lang and phrase) and the
    border's (without) of what ``asked`` asks for, and the words of each language as size 0. None: all
    words and pairs by their keys."""
    held = docs.sparkSession.sparkContext.broadcast(asked)  # tables of fixed size

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Tally(held.value)
        for batch in steps(batches, "text", STEP):
            words, rows, joined = words_and_pieces(text_column(batch, "text"))
            if not len(words):
                continue
            codes = sums.numbered(words)
            coded = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
            langs, lang_of = strings(coded.dictionary), np.asarray(coded.indices, dtype=np.int64)[rows]
            for i, lang in enumerate(langs):  # a text's words stay together, so no piece is torn
                own = np.flatnonzero(lang_of == i) if len(langs) > 1 else slice(None)
                if len(codes[own]):
                    sums.add(lang, codes[own], joined[own])
            some, everything = sums.full()
            if some:
                yield from sums.handed_on(ranges, everything)
        yield from sums.handed_on(ranges)

    return docs.select("lang", "text").mapInArrow(tally, RANGE_SCHEMA).groupBy("range").applyInArrow(_merge_range(least), COUNT_SCHEMA)


# ---------------------------------------------------------------- the passes
def frequent_phrases(docs: DataFrame, min_count: int, share: int = SAMPLE_SHARE, seen: int = SAMPLE_SEEN,
                     report: list | None = None) -> tuple[DataFrame, DataFrame]:
    """docs: lang, text. Phrases of one to three words that occur ``min_count`` times or more (lang, size,
    phrase, n), and the words of each language (lang, total). ``report``: gets a line a pass."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = blocks_of(size, RANGE_BYTES)
    sample = docs.where(F.rand(7) * share < 1)
    proposed = stored(spark, counted(sample, None, blocks_of(size, share * RANGE_BYTES), seen), "proposed")
    passes = [Pass(bits_of(proposed, 1, WORD_BITS), bits_of(proposed, 2, PAIR_BITS))]
    first = stored(spark, counted(docs, passes[0], ranges, min_count), "counted")
    totals = first.where("size = 0").select("lang", F.col("n").alias("total"))
    found, failed = first.where("size > 0 AND phrase IS NOT NULL"), first.where("phrase IS NULL")
    while True:
        frequent = found.unionByName(failed) if len(passes) == 1 else found
        words, pairs = bits_of(frequent, 1, WORD_BITS), bits_of(frequent, 2, PAIR_BITS)
        last = passes[-1]
        new_words, new_pairs = bool((words.data & ~last.words.data).any()), bool((pairs.data & ~last.pairs.data).any())
        if len(passes) == 1:
            failures = {1: bits_of(failed, 1, WORD_BITS), 2: bits_of(failed, 2, PAIR_BITS), 3: bits_of(failed, 3, PAIR_BITS)}
            open_border = any(b.data.any() for b in failures.values())
        else:
            failures, open_border = None, False
        if report is not None:
            report.append({"pass": len(passes), "new_words": new_words, "new_pairs": new_pairs, "border_failed": open_border})
        if not (new_words or new_pairs or open_border):  # all phrases of frequent parts have been asked for
            return found, totals
        passes.append(Pass(words, pairs, before=passes, failed=failures))
        more = stored(spark, counted(docs, passes[-1], ranges, min_count).where("size > 0"), "counted")
        found = found.unionByName(more)


def collocations(docs: DataFrame, lang_col: str, text_col: str, min_count: int = 10, covered: int = 50,
                 top: int = 2000, share: int = SAMPLE_SHARE, report: list | None = None) -> DataFrame:
    """Per language the ``top`` phrases of two or three words: lang, rank, phrase, a, l, r, n, score. A phrase
    goes if a longer one of at least ``covered`` percent of its count holds it."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole(F.col(text_col)).alias("text"))
    found, totals = frequent_phrases(docs, min_count, share, report=report)
    scored = _scored(found)
    inside = found.where("size = 3").select("lang", F.col("n").alias("longer"), F.explode(_parts(2)).alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(
        (F.col("size") == 3) | F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).select(
        "lang", "phrase", "a", "l", "r", "score")
    placed = scan_within(kept, ["lang"], [("score", True), ("a", True), ("phrase", False)])
    return placed.where(F.col("_pos") <= top).join(totals, "lang").select(
        "lang", F.col("_pos").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _parts(size: int) -> Column:
    """All contiguous parts of ``size`` words of a phrase."""
    words = F.split("phrase", " ")
    return F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))


def _scored(found: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of the phrases of two or three words, by their lowest cut."""
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("left"),
        F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("right")))
    cut = found.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(cuts).alias("c")).select(
        "lang", "phrase", "size", "a", "c.k", F.col("c.left").alias("left"), F.col("c.right").alias("right"))
    parts = found.where("size < 3")
    cut = cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    whole_number = lambda c: F.col(c).cast("decimal(16,0)")
    cut = cut.withColumn("over", F.lit(1000000).cast("decimal(7,0)") * (whole_number("a") * whole_number("a"))).withColumn(
        "under", whole_number("l") * whole_number("r"))
    cut = cut.withColumn("score", F.expr("over div under"))
    return cut.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select(
        "lang", "phrase", "size", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), "lang", "text")


#: DuckDB: every phrase is counted.
SQL = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, words
      FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS words FROM d)),
w AS (SELECT lang, piece, unnest(list_filter(string_split_regex(words, '[\\x20\\x09]+'), lambda x: x <> '')) AS word,
             generate_subscripts(list_filter(string_split_regex(words, '[\\x20\\x09]+'), lambda x: x <> ''), 1) AS place FROM p),
x AS (SELECT lang, word AS one, lead(word, 1) OVER (PARTITION BY piece ORDER BY place) AS two,
             lead(word, 2) OVER (PARTITION BY piece ORDER BY place) AS three FROM w),
f AS (SELECT lang, 1 AS size, one AS phrase, count(*) AS n FROM x GROUP BY ALL
      UNION ALL
      SELECT lang, 2, one || ' ' || two, count(*) FROM x WHERE two IS NOT NULL GROUP BY ALL
      UNION ALL
      SELECT lang, 3, one || ' ' || two || ' ' || three, count(*) FROM x WHERE three IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, sum(n) AS total FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
s AS (SELECT c.lang, c.phrase, c.size, c.a, k.k, x.n AS l, y.n AS r,
             CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
      FROM c JOIN (VALUES (1), (2)) AS k(k) ON k.k < c.size
      JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k.k], ' ')
      JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, part, max(a) AS longer
      FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.part = b.phrase AND b.size = 2
         WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(total AS BIGINT) AS n, score
FROM ranked JOIN t USING (lang) WHERE rank <= 2000"""
