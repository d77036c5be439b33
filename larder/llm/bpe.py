"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

The distinct words of a batch lie in one flat array of symbols. Each round looks up every
adjacent pair by binary search over the sorted pair keys, finds the lowest rank of each word
and joins that pair wherever it stands in the word; words without a pair leave. Ids equal those
of the tokenizers library for files with a ByteLevel pre-tokenizer (no prefix space), no
normalizer and a BPE model without unknown token.

Defined results: a null text counts as empty and has no ids; the file's special tokens in a text
get their id; repeated rows are encoded one by one; an empty table gives no rows; other columns
are not read. Bytes that are no UTF-8 decode to the replacement character.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.batches import Remembered, coded, kept, list_array, ragged, steps, strings, take, text_column
from larder.llm.common import table

#: White space, and the rule that cuts a text into words.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + BLANK + r"\p{L}\p{N}]+|["
         + BLANK + r"]+(?![^" + BLANK + r"])|[" + BLANK + r"]+")
FILE = "byte_bpe_50k.json"
#: Bytes of text encoded, and ids decoded, at once.
STEP_TEXT = 2 << 20
STEP_IDS = 1 << 20
#: Words merged at once.
STEP_WORDS = 1 << 14
#: Distinct pieces of text kept by one Python worker.
KEPT_PIECES = 300_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the file: printable ones for themselves, the
    others by code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model, vocab = content["model"], content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.first = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.joined = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        spelled = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
                   for t, i in (*vocab.items(), *self.special.items())}
        self.bytes, self.byte_at = ragged([spelled.get(i, b"") for i in range(self.size)])
        self.bytes = self.bytes.astype(np.uint8)
        self.words = regex.compile(WORDS)
        letter = regex.compile(f"[{BLANK}]")
        self.blank = {"", *(chr(i) for i in range(0x3001) if letter.match(chr(i)))}
        self.cut_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.kept = Remembered(self.pieces, KEPT_PIECES)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by merge rounds over all words at once."""
        raw = [w.encode() for w in words]
        sym = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        done_sym, done_word = [], []
        none = len(self.joined)
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.append(starts, len(sym)))
            lowest = np.repeat(best, spans)
            over = lowest == none
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            hit = (rank == lowest) & ~over
            # of hits in a row (equal symbols) every other one counts, from the left
            run = np.flatnonzero(hit)
            if len(run):
                new = np.append(True, np.diff(run) != 1)
                first = run[new][np.cumsum(new) - 1]
                left = run[(run - first) % 2 == 0]
                sym = sym.copy()
                sym[left] = self.joined[rank[left]]
                over[left + 1] = True
            sym, word = sym[~over], word[~over]
        out_word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        out_sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        order = np.argsort(out_word, kind="stable")
        ends = np.cumsum(np.bincount(out_word, minlength=len(raw)))
        flat = out_sym[order].tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings that no word crosses the ends of, as one array and offsets."""
        cut = [self.words.findall(p) for p in pieces]
        sizes = [len(ws) for ws in cut]
        each = [w for ws in cut for w in ws]
        places = {w: k for k, w in enumerate(dict.fromkeys(each))}
        words = list(places)
        ids, offsets = ragged([x for k in range(0, len(words), STEP_WORDS) for x in self.merge(words[k:k + STEP_WORDS])])
        out, lengths = take(ids, offsets, np.fromiter((places[w] for w in each), np.int64, len(each)))
        return out, np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(sizes)).astype(np.int64)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each text's."""
        values, rows = [], []
        marks: dict[int, int] = {}
        for row, text in enumerate(texts.to_pylist()) if self._special(texts) else ():
            for k, part in enumerate(self.cut_special.split(text)):
                if k:
                    marks[len(values)] = self.special[self.cut_special.findall(text)[k - 1]]
                    values.append("")
                    rows.append(row)
                values.append(part)
                rows.append(row)
        parts = pa.array(values, pa.large_string()) if values else texts
        ids, n = self._plain(parts)
        if not values:
            return ids, n
        starts = np.cumsum(n) - n
        at = np.array(sorted(marks), dtype=np.int64)
        ids = np.insert(ids, starts[at], [marks[i] for i in at.tolist()])
        n[at] += 1
        return ids, np.bincount(rows, weights=n, minlength=len(texts)).astype(np.int64)

    def _special(self, texts: pa.Array) -> bool:
        return any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words end before a blank that stands between two other characters, so a text is cut
        there; what lies between such blanks is encoded once for the whole batch."""
        lists = pc.split_pattern(texts, " ")
        values, row = lists.flatten(), np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
        code, distinct = coded(values)
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        parts = strings(distinct)
        opens = np.array([s[:1] not in self.blank for s in parts])
        closes = np.array([s[-1:] not in self.blank for s in parts])
        inner = np.append(False, row[1:] == row[:-1])  # follows a blank
        free = ~inner | (opens[code] & np.append(False, closes[code[:-1]]))  # a piece begins here
        alone = free & np.append(free[1:], True)
        key = np.where(alone, code * 2 + inner, -1)
        heads = np.flatnonzero(free)
        extra: dict[str, int] = {}
        ends = np.append(heads[1:], len(code))
        for a, b in zip(heads[~alone[heads]].tolist(), ends[~alone[heads]].tolist()):
            s = (" " if inner[a] else "") + " ".join(parts[c] for c in code[a:b].tolist())
            key[a] = 2 * len(parts) + extra.setdefault(s, len(extra))
        kinds, which = np.unique(key[heads], return_inverse=True)
        more = list(extra)
        known = [more[k - 2 * len(parts)] if k >= 2 * len(parts) else (" " if k % 2 else "") + parts[k // 2]
                 for k in kinds.tolist()]
        ids, offsets, place = self.kept(known)
        out, n = take(ids, offsets, place[which])
        return out, np.bincount(row[heads], weights=n, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of the ids, by their numbers; unknown ids have no text."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, 0) if len(ids) else ids
        raw, lengths = take(self.bytes, self.byte_at, ids)
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        data = raw.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


@kept
@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per input row: the id column, ``ids`` (array<int>) and, with ``decoded``, the text
    that decoding these ids gives (in the same task, so that the ids make one way only)."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for step in steps(batches, "text", STEP_TEXT):
            ids, n = c.encode(text_column(step, "text"))
            columns = [step.column(0), list_array(ids.astype(np.int32), n, pa.int32())]
            if decoded:
                columns.append(pa.array(c.decode(ids, n), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The input rows with ``decoded``: the text of the ids (null ids: null)."""
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            part = np.cumsum(size) // (STEP_IDS)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    cut = lists.slice(a, b - a)
                    texts = c.decode(np.asarray(cut.flatten(), dtype=np.int64), size[a:b])
                    texts = [t if ok else None for t, ok in zip(texts, cut.is_valid().to_pylist())]
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(texts, pa.string())],
                                                     names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(FILE)
    done = encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
