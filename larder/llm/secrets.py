"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on random strings: the values of pattern matches, and strings drawn evenly from each
alphabet in which keys are written (``ALPHABETS``; their expected letter pairs are known, so none need be
made). Each of these samples weighs the same, so what the corpus happens to hold does not decide alone. The other is
trained on ordinary identifiers: all other words. Both come from a bounded, labelled sample of rows, and keep the case
of letters. A long run of key characters outside the pattern matches is a secret if the random model
explains its letters better by ``MIN_RATIO`` nats, and ``LENGTH_RATIO`` more for each letter beyond ``MIN_RUN``.
Everything is DataFrame functions; the only thing that reaches the driver is the table of letter pairs (at most
69 * 69 cells a model).

Positions are running sums over a text's matches, taken in pieces of ``PIECE`` matches, and spans of the kinds are
compared in one pass over their sorted list, so a text of many matches costs in proportion to them.

Defined results: a null text counts as empty and has no span; repeated rows are scanned one by
one; an empty table gives no rows (the models then know the alphabets alone); other columns are left alone.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import table, whole

#: The pattern of each kind, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIN_VALUE = 6

#: The method's own kind: runs of key characters, at least 20, with a letter.
RANDOM = "random"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Letters that the models tell apart; all others share place 0.
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
DIGITS = "0123456789"
LETTERS = LOWER + UPPER + DIGITS + "+/_.=-"
SIZE = len(LETTERS) + 1
#: Alphabets in which keys are written: hex, letters of one case, base32, base36, base62, base64.
ALPHABETS = (DIGITS + "abcdef", LOWER, UPPER, UPPER + "234567", LOWER + DIGITS, LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/")
#: Bound of the labelled sample: distinct rows with the smallest hashes of id and text.
SAMPLE_ROWS = 4096
#: Letter pairs that each sample of random strings counts as.
SAMPLE_PAIRS = 4000.0
#: Strength of the single-letter distribution in each pair distribution; nats to call a run random, and more a letter.
PRIOR = 8.0
MIN_RUN = 20
MIN_RATIO = 12.0
LENGTH_RATIO = 0.2
#: Matches of a text that are summed up before they join the others; code points of a piece of text.
PIECE = 256
TEXT_PIECE = 8192
REDACTED = "[SECRET]"


SPAN = "struct<start:int,place:int,end:int,kind:string,run:string>"


def in_pieces(items: Column, start: Column, step, out_type: str) -> Column:
    """A running pass over an array: ``step(state, item)`` gives (next state, array of results). The results of
    ``PIECE`` items are gathered before they are put to the others, so long arrays are not copied for each item."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int")),
                         lambda k: F.slice(items, k * PIECE + 1, F.lit(PIECE)))
    empty = F.array().cast(f"array<{out_type}>")

    def piece(acc: Column, some: Column) -> Column:
        def one(state: Column, item: Column) -> Column:
            moved, found = step(state["at"], item)
            return F.struct(moved.alias("at"), F.concat(state["out"], found).alias("out"))

        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), empty.alias("out")), one)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out"))), F.lit(0))

    whole_pass = F.aggregate(pieces, F.struct(start.alias("at"), empty.alias("out")), piece)["out"]
    return F.when(F.size(items) > 0, whole_pass).otherwise(empty)


def _spans(text: Column, pattern: str, kind: str, group: bool = False) -> Column:
    """Matches as sorted spans: what lies between matches (split) and the matches themselves alternate, so their
    lengths add up to the positions. Spans of runs keep their text."""
    place = (*KINDS, RANDOM).index(kind)
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if group else hits
    each = F.slice(F.arrays_zip(between.alias("b"), hits.alias("h"), value.alias("v")), F.lit(1), F.size(hits))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.char_length(x["b"])
        end = start + F.char_length(x["h"])
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(kind).alias("kind"),
                        (x["h"] if kind == RANDOM else F.lit(None).cast("string")).alias("run"))
        return end, F.when(F.char_length(x["v"]) >= (MIN_VALUE if group else 1), F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.when(text.rlike(pattern), in_pieces(each, F.lit(0), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    return F.concat(_spans(text, ASSIGN, "assign", True), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))


def _codes(run: Column) -> Column:
    """Places of a string's letters in the models' alphabet."""
    return F.transform(F.array_remove(F.split(run, ""), ""), lambda c: F.instr(F.lit(LETTERS), c))


def _pair_counts(labelled: DataFrame) -> DataFrame:
    """(random, word, n) -> (random, pair, n) over the letter pairs of each word."""
    coded = labelled.select("random", "n", _codes(F.col("word")).alias("c")).where(F.size("c") > 1)
    pairs = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1),
                       lambda a, b: a * SIZE + b)
    return (coded.select("random", "n", F.explode(pairs).alias("pair"))
            .groupBy("random", "pair").agg(F.sum("n").alias("n")))


def sample(df: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` distinct rows, chosen by a hash of id and text: hashes first, then their texts."""
    keyed = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), whole(F.col(text_col)).alias("text"))
    keys = keyed.select("key").distinct().orderBy("key").limit(rows)
    return keyed.join(F.broadcast(keys), "key", "left_semi").dropDuplicates(["key"])


def labelled_words(texts: DataFrame) -> DataFrame:
    """(random, word, n): values of pattern matches, and all words outside of them."""
    marked = texts.select(
        F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)),
                 F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
                 F.regexp_extract_all("text", F.lit(HEX), F.lit(0))).alias("secret"),
        F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " "),
                r"[^A-Za-z0-9+/_=-]+").alias("plain"))
    one = lambda c, label: marked.select(F.lit(label).alias("random"), F.explode(c).alias("word"))
    return (one("secret", True).where(F.char_length("word") >= MIN_VALUE)
            .unionByName(one("plain", False).where(F.char_length("word") >= 2))
            .groupBy("random", "word").agg(F.count("*").alias("n")))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[float]:
    """Log-likelihood ratios of the letter pairs (random over ordinary), by a * SIZE + b."""
    counted = _pair_counts(labelled_words(sample(df, id_col, text_col, rows))).collect()  # at most 2 * SIZE**2
    pairs = {label: [1e-9] * (SIZE * SIZE) for label in (True, False)}
    matched = sum(r["n"] for r in counted if r["random"])
    for r in counted:
        pairs[r["random"]][r["pair"]] += r["n"] * (SAMPLE_PAIRS / matched if r["random"] else 1.0)
    for letters in ALPHABETS:
        places = [LETTERS.index(c) + 1 for c in letters]
        for a in places:
            for b in places:
                pairs[True][a * SIZE + b] += SAMPLE_PAIRS / len(places) ** 2
    logs = {}
    for label, pair in pairs.items():
        after = [sum(pair[a * SIZE + b] for a in range(SIZE)) for b in range(SIZE)]
        spread = sum(after) + SIZE
        single = [(n + 1) / spread for n in after]
        before = [sum(pair[a * SIZE:(a + 1) * SIZE]) for a in range(SIZE)]
        logs[label] = [math.log((pair[a * SIZE + b] + PRIOR * single[b]) / (before[a] + PRIOR)) for a in range(SIZE) for b in range(SIZE)]
    return [r - o for r, o in zip(logs[True], logs[False])]


def _random_spans(text: Column, ratios: list[float]) -> Column:
    """Runs whose ratio reaches the threshold of their length."""
    weights = F.split(F.lit(",".join(repr(x) for x in ratios)), ",").cast("array<double>")

    def ratio(run: Column) -> Column:
        total = F.aggregate(
            _codes(run), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
            lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(
                acc["last"] >= 0, F.get(weights, acc["last"] * SIZE + c)).otherwise(0.0)).alias("sum")))
        return total["sum"]

    return F.filter(_spans(text, RUN, RANDOM), lambda s: s["run"].rlike("[A-Za-z]") & (
        ratio(s["run"]) >= MIN_RATIO + LENGTH_RATIO * (s["end"] - s["start"] - MIN_RUN)))


def _apart(spans: Column) -> Column:
    """Of sorted spans the method's own that touch no other: such a span waits for the next one, which is the only one
    that can begin inside it; those before it are known by their greatest end."""
    none = F.lit(None).cast(SPAN)
    state = F.struct(F.lit(0).alias("end"), none.alias("waiting"))
    last = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(0).alias("place"), F.lit(2**31 - 1).alias("end"),
                            F.lit("").alias("kind"), F.lit(None).cast("string").alias("run")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        own = x["kind"] == RANDOM
        moved = F.struct(F.when(own, at["end"]).otherwise(F.greatest(at["end"], x["end"])).alias("end"),
                         F.when(own & (x["start"] >= at["end"]), x).otherwise(none).alias("waiting"))
        free = at["waiting"].isNotNull() & (at["waiting"]["end"] <= x["start"])
        return moved, F.when(free, F.array(at["waiting"])).otherwise(F.array().cast(f"array<{SPAN}>"))

    return in_pieces(F.concat(spans, last), state, step, SPAN)


def scan(df: DataFrame, ratios: list[float], text_col: str = "text") -> DataFrame:
    """row (the input row), text, base and spans: sorted arrays of struct<start, place, end, kind>.

    The method's spans do not overlap base spans.
    """
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"], x["place"], x["end"], x["kind"]))
    out = df.select(F.struct("*").alias("row"), whole(F.col(text_col)).alias("text"))
    out = out.withColumn("found", F.sort_array(base_spans(F.col("text")))).withColumn("more", _random_spans(F.col("text"), ratios))
    # the base spans end where those of runs begin to be judged: runs that touch none stay
    out = out.withColumn("more", F.when((F.size("more") > 0) & (F.size("found") > 0), _apart(F.sort_array(F.concat("found", "more")))).otherwise(
        F.col("more")))
    return out.select("row", "text", plain(F.col("found")).alias("base"), F.sort_array(plain(F.concat("found", "more"))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(
        s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, ratios: list[float], text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The input rows with each secret (overlapping spans as one) replaced by REDACTED.

    ``length_col``, where there is such a column, gets the new length of a changed text.
    """
    found = scan(df, ratios, text_col)
    cut = "struct<start:int,end:int>"
    none = F.lit(None).cast(cut)
    stop = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(0).alias("place"), F.lit(2**31 - 1).alias("end"), F.lit("").alias("kind")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        grows = at.isNotNull() & (at["end"] > x["start"])
        moved = F.struct(F.when(grows, at["start"]).otherwise(x["start"]).alias("start"),
                         F.when(grows, F.greatest(at["end"], x["end"])).otherwise(x["end"]).alias("end"))
        return moved, F.when(at.isNotNull() & ~grows, F.array(at)).otherwise(F.array().cast(f"array<{cut}>"))

    found = found.withColumn("cut", F.when(F.size("spans") > 0, in_pieces(F.concat("spans", stop), none, step, cut)).otherwise(
        F.array().cast(f"array<{cut}>")))
    stops = F.concat("cut", F.array(F.struct(F.char_length("text").alias("start"), F.char_length("text").alias("end"))))
    found = found.withColumn("stops", stops)
    # the text in pieces, so that no part of it is sought from its beginning
    found = found.withColumn("pieces", F.when(F.size("cut") > 0, F.transform(
        F.sequence(F.lit(0), F.floor(F.char_length("text") / TEXT_PIECE).cast("int")),
        lambda k: F.col("text").substr(k * TEXT_PIECE + 1, F.lit(TEXT_PIECE)))))

    def part(a: Column, b: Column) -> Column:
        at = lambda x, k: F.greatest(F.lit(0), F.least(F.lit(TEXT_PIECE), x - k * TEXT_PIECE))
        return F.array_join(F.transform(
            F.sequence(F.floor(a / TEXT_PIECE).cast("int"), F.floor(b / TEXT_PIECE).cast("int")),
            lambda k: F.get("pieces", k).substr(at(a, k) + 1, at(b, k) - at(a, k))), "")

    clean = F.array_join(F.transform("stops", lambda s, i: part(
        F.when(i == 0, 0).otherwise(F.get("stops", i - 1)["end"]), s["start"])), REDACTED)
    clean = F.when(F.size("pieces") > 0, clean)  # a second use, so that the pieces are made once
    found = found.withColumn("clean", F.when(F.size("cut") > 0, clean))
    out = []
    for name, kind in df.dtypes:
        old = F.col("row")[name]
        if name == text_col:
            old = F.coalesce(F.col("clean"), old)
        elif name == length_col:
            old = F.when(F.col("clean").isNull(), old).otherwise(F.char_length("clean").cast(kind))
        out.append(old.alias(name))
    return found.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
