"""Language of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

Training: a bounded sample of labelled rows (``SAMPLE_ROWS``, the smallest hashes of the ids)
gives counts of letter n-grams (1 to 3 within a word, hashed to ``SLOTS`` places) and of scripts
for each language. Prediction: a word's script leaves the languages that use it; these get the
word's log-likelihood; Viterbi over the words of a text, where going on in the same language is
free and changing it costs ``SWITCH``, labels each word. The text's language is the one with the
most letters, the score its share of the letters.

All words of a batch lie in one flat array; the paths of all its texts are found at once, in
blocks of words side by side, since a step over a block is a (max, +) product of its words.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no spans; ties
go to the first language by name; repeated rows are judged one by one; without labelled rows
everything with a letter is ``und``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.batches import coded, drop_kept, list_array, steps, strings, text_column, words_of
from larder.llm.common import table

#: Bytes of text that a task holds at once.
STEP = 1 << 21
#: Bound of the labelled sample, in rows.
SAMPLE_ROWS = 8192
SLOTS = 1 << 16
#: Nats that a change of language costs, weight of a word's n-grams (they overlap), smoothing.
SWITCH = 6.0
NGRAM_WEIGHT = 0.4
ADDED = 0.5
#: A language is a candidate for a script that has at least this share of its letters.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"

#: First and last code point of script ranges (letters outside of them: "Other").
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F), ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF), ("Tamil", 0x0B80, 0x0BFF), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF),
    ("Ethiopic", 0x1200, 0x137F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = [*dict.fromkeys(s for s, _, _ in SCRIPTS), "Other"]


class Words:
    """Distinct words as flat code points: lower case, what is no letter is 0."""

    def __init__(self, distinct: pa.Array):
        lower = pc.utf8_lower(distinct)
        # beyond ASCII, other signs than letters, marks and digits part words too
        plain = pc.replace_substring_regex(lower, r"[^\p{L}\p{M}]", " ")
        joined = "".join(w + "\n" for w in strings(plain))
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        ends = np.flatnonzero(points == 10)
        self.n = len(distinct)
        self.word = np.repeat(np.arange(self.n), np.diff(np.append(-1, ends)))
        self.points = np.where((points == 32) | (points == 10), 0, points)
        self.letter = self.points > 0
        self.letters = np.bincount(self.word[self.letter], minlength=self.n) if len(points) else np.zeros(self.n, int)

    def scripts(self) -> np.ndarray:
        """n x scripts: letters of each."""
        which = np.full(len(self.points), len(SCRIPT_NAMES) - 1)
        for name, low, high in SCRIPTS:
            which[(self.points >= low) & (self.points <= high)] = SCRIPT_NAMES.index(name)
        flat = self.word[self.letter] * len(SCRIPT_NAMES) + which[self.letter]
        return np.bincount(flat, minlength=self.n * len(SCRIPT_NAMES)).reshape(self.n, len(SCRIPT_NAMES))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Place of each n-gram and its word; word ends are part of the longer ones."""
        p = np.concatenate([[0], self.points])  # points[i] has p[i] before it
        one = self.points
        before, after = p[:-1], np.append(self.points[1:], 0)
        mix = lambda *xs: _mixed(xs)
        places = [mix(one), mix(before, one), mix(before, one, after)]
        keep = self.letter
        return (np.concatenate([x[keep] for x in places]), np.concatenate([self.word[keep]] * 3))


def _mixed(parts) -> np.ndarray:
    """A fixed hash of 1 to 3 code points to SLOTS places."""
    h = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(40)).astype(np.int64) % SLOTS


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word. scores: words x labels; first: where a text begins (there a change
    is free). Blocks of words run side by side: once to get each block's best way from every label
    to every label, then a pass over the blocks, then once more inside them with the way back."""
    n, labels = scores.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    pad = blocks * width - n
    s = np.concatenate([scores, np.zeros((pad, labels))]).reshape(blocks, width, labels)
    free = np.concatenate([first, np.zeros(pad, dtype=bool)]).reshape(blocks, width)

    def step(value: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """value: blocks x ... x labels -> (stay value, best value, best label)."""
        best = value.argmax(axis=-1)
        return value, np.take_along_axis(value, best[..., None], -1), best

    # 1. best way through each block from each entry label (rows) to each label
    way = np.full((blocks, labels, labels), -np.inf)
    way[:, np.arange(labels), np.arange(labels)] = 0.0
    for k in range(width):
        stay, top, _ = step(way, k)
        cost = np.where(free[:, k], 0.0, switch)[:, None, None]
        way = np.maximum(stay, top - cost) + s[:, k, None, :]
    # 2. values on entering each block
    enter = np.zeros((blocks, labels))
    for b in range(1, blocks):
        value = (enter[b - 1][:, None] + way[b - 1]).max(axis=0)
        enter[b] = value - value.max()
    # 3. inside the blocks, with the label that each label came from
    came = np.empty((width, blocks, labels), dtype=np.int8 if labels < 128 else np.int32)
    value = enter
    for k in range(width):
        stay, top, best = step(value, k)
        cost = np.where(free[:, k], 0.0, switch)[:, None]
        change = top - cost > stay
        came[k] = np.where(change, best[:, None], np.arange(labels))
        value = np.where(change, top - cost, stay) + s[:, k]
    # 4. back: for every last label of a block the labels before it, then the chain of blocks
    back = np.empty((width, blocks, labels), dtype=came.dtype)
    at = np.tile(np.arange(labels), (blocks, 1))
    for k in range(width - 1, -1, -1):
        back[k] = at
        at = np.take_along_axis(came[k], at, axis=1)
    out = np.empty((blocks, width), dtype=np.int64)
    last = int(value[-1].argmax())
    for b in range(blocks - 1, -1, -1):
        out[b] = back[:, b, last]
        last = int(at[b, last])
    return out.reshape(-1)[:n]


class Model:
    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        """grams: SLOTS x languages, scripts: scripts x languages, both counts."""
        self.languages = languages
        total = grams.sum(axis=0) + ADDED * SLOTS
        self.weight = (np.log((grams + ADDED) / total) * NGRAM_WEIGHT).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.uses = share >= SCRIPT_SHARE

    def word_scores(self, words: Words) -> np.ndarray:
        """words x languages: log-likelihood less the best candidate's; 0 for words without letters.
        Languages that do not use the word's main script are out, unless none does."""
        place, word = words.grams()
        n = len(self.languages)
        score = np.stack([np.bincount(word, weights=self.weight[place, k], minlength=words.n) for k in range(n)], axis=1)
        can = self.uses[words.scripts().argmax(axis=1)]
        none = ~can.any(axis=1)
        score = np.where(can | none[:, None], score, score.min(axis=1, keepdims=True) - 50.0)
        score -= score.max(axis=1, keepdims=True)
        score[words.letters == 0] = 0.0
        return score

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, label and letters of each word that has a letter, and rows x languages letters."""
        values, row = words_of(texts)
        code, distinct = coded(values)
        n = len(self.languages)
        words = Words(distinct)
        letters = words.letters[code] if len(code) else np.zeros(0, int)
        real = letters > 0
        row, code, letters = row[real], code[real], letters[real]
        if n == 0:
            return row, np.zeros(len(row), int), letters, np.zeros((len(texts), 0))
        scores = self.word_scores(words)[code]
        path = viterbi(scores, np.append(True, row[1:] != row[:-1])[:len(row)], SWITCH)
        held = np.bincount(row * n + path, weights=letters, minlength=len(texts) * n).reshape(len(texts), n)
        return row, path, letters, held


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          rows: int = SAMPLE_ROWS) -> Model:
    """Counts over the sample, added up by Spark; the driver gets SLOTS x languages numbers at most."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = labelled.select(F.col(id_col).alias("key")).distinct().orderBy(F.xxhash64("key"), "key").limit(rows)
    chosen = labelled.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"),
                             F.col(lang_col).cast("string").alias("lang")).join(F.broadcast(ids), "key", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for step in steps(batches, "text", STEP):
            langs, names = coded(step.column(step.schema.get_field_index("lang")))
            values, row = words_of(text_column(step, "text"))
            for k, name in enumerate(names.to_pylist()):
                code, distinct = coded(values.filter(pa.array(langs[row] == k)))
                if not len(code):
                    continue
                words, times = Words(distinct), np.bincount(code)
                place, word = words.grams()
                grams = np.bincount(place, weights=times[word], minlength=SLOTS)
                scripts = (words.scripts() * times[:, None]).sum(axis=0)
                full = np.concatenate([grams, scripts])
                at = np.flatnonzero(full)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(full[at])],
                    names=["lang", "place", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, place long, n double").groupBy(
        "lang", "place").agg(F.sum("n").alias("n")).toArrow()  # at most (SLOTS + scripts) x languages rows
    languages = sorted(set(counted["lang"].to_pylist()))
    full = np.zeros((SLOTS + len(SCRIPT_NAMES), len(languages)))
    if languages:
        code = pc.index_in(counted["lang"], pa.array(languages)).to_numpy()
        full[counted["place"].to_numpy(), code] = counted["n"].to_numpy()
    return Model(languages, full[:SLOTS], full[SLOTS:])


def identify(df: DataFrame, model: Model, id_cols: list[str], text_col: str = "text",
             with_spans: bool = True) -> DataFrame:
    """id_cols, lang_pred, score and, ``with_spans``, the spans as arrays: language and number of
    words with a letter, in the order of the text."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # SLOTS x languages numbers
    keys = df.select(*id_cols).schema
    names = [*keys.names]
    own = text_col in names and isinstance(keys[text_col].dataType, T.StringType)  # then the text goes to the tasks once
    text = text_col if own else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        m = shared.value
        langs = np.array([*m.languages, UNKNOWN], dtype=object)
        for step in steps(batches, text, STEP):
            row, path, letters, held = m.label(text_column(step, text))
            total = held.sum(axis=1)
            best = np.where(total > 0, held.argmax(axis=1) if held.shape[1] else 0, len(langs) - 1)
            most = held.max(axis=1) if held.shape[1] else total
            score = np.where(total > 0, most / np.maximum(total, 1), 0.0)
            columns = [*step.columns[:len(names)], pa.array(langs[best], pa.string()), pa.array(score)]
            if with_spans:
                new = np.append(True, (row[1:] != row[:-1]) | (path[1:] != path[:-1]))[:len(row)]
                if not m.languages:
                    new[:] = False
                at = np.flatnonzero(new)
                size = np.diff(np.append(at, len(row))) if len(at) else at
                each = np.bincount(row[at], minlength=step.num_rows) if len(at) else np.zeros(step.num_rows, int)
                columns += [list_array(langs[path[at]] if len(at) else [], each, pa.string()),
                            list_array(size.astype(np.int64), each, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if with_spans:
        more += [T.StructField("span_langs", T.ArrayType(T.StringType())),
                 T.StructField("span_words", T.ArrayType(T.LongType()))]
    out = T.StructType([*keys.fields, *more])
    asked = [] if own else [F.col(text_col).cast("string").alias(text)]
    return df.select(*[F.col(c) for c in id_cols], *asked).mapInArrow(run, out)


def keep(df: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang",
         least: float = 0.3) -> DataFrame:
    """The input rows whose text has a language with at least the share ``least`` of its letters;
    a null ``lang_col`` becomes the predicted language."""
    others = [F.col(c) for c in df.columns if c != text_col] or [F.lit(0).alias("none")]
    rows = df.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    found = identify(rows, model, ["row", "text"], "text", with_spans=False).where(
        (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[(F.col("text") if c == text_col else F.coalesce(F.col("row")[c], F.col("lang_pred")) if c == lang_col
                           else F.col("row")[c]).alias(c) for c in df.columns])


def learned_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that the query may learn from."""
    return df.where(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(learned_rows(docs)), ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score",
        F.size("span_words").cast("long").alias("n_spans"))
