"""Quality rules: a threshold table compiled into one Spark projection (no user functions).

``measure`` takes any DataFrame and returns one row per input row: the id, the counts, the
names of the rules that failed and the verdict. ``keep`` returns the input rows that pass.

Defined results: a null text counts as empty; a text without a word has only zero counts,
fails ``base`` and goes; repeated rows are judged one by one; an empty table gives no rows;
other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import table, whole, words_of

#: Characters that count as symbols, window length and limits of the base rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Fewer repeated lines than this say nothing: one of three lines is a third of a short text.
MIN_DUP_LINES = 3

#: Function words of four languages. Compared as they stand, so shouted text has few of them.
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it of on or that the this to was were which with you "
    "auf aus bei das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "al como con de del el en es la las lo los más no para por que se su un una y "
    "au aux avec ce dans du elle est et le les ne pas plus pour qui sont sur une"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document only if low <= metric <= high (None: no bound)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: metric: an SQL expression over the counts below.
RULES = (
    Rule("length", "n_words", MIN_WORDS, None),
    Rule("word_length", "word_chars / n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("stop_words", "n_stop_words / n_words", 0.04, None),
    Rule("repeated_lines", f"CASE WHEN n_dup_lines < {MIN_DUP_LINES} THEN 0 ELSE n_dup_lines / n_lines END", None, 0.3),
)


def compiled(rules: tuple[Rule, ...]) -> str:
    """One SQL expression: the names of the rules that a row fails, comma-joined, in table order."""
    tests = []
    for r in rules:
        parts = ([f"({r.metric}) < {r.low!r}"] if r.low is not None else []) + (
            [f"({r.metric}) > {r.high!r}"] if r.high is not None else [])
        tests.append(f"CASE WHEN {' OR '.join(parts)} THEN '{r.name}' END")
    return f"concat_ws(',', {', '.join(tests)})"


def _pairs(a: Column, gap: int, n: Column) -> Column:
    """Hash of each element with the one ``gap`` places on; n: elements of the result."""
    return F.zip_with(F.slice(a, 1, n), F.slice(a, gap + 1, n), lambda x, y: F.xxhash64(x, y))


def _counted(df: DataFrame, text: str) -> DataFrame:
    """Columns row, text -> row and the counts. Words in repeated windows: hash each window by
    doubling (1, 2, 4, 8 words), sort the window hashes of the row and add up what the windows
    found twice cover; only rows with an equal pair of hashes sort."""
    left = lambda less: F.greatest(F.col("n_words") - less, F.lit(0)).cast("int")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    df = df.withColumn("words", words_of(F.col(text))).withColumn(
        "lines", F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.array_contains(stop, w))).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    for gap in (1, 2, 4):
        df = df.withColumn("h", _pairs(F.col("h"), gap, left(2 * gap - 1)))
    df = df.withColumn("sorted", F.when(
        F.size("h") > F.size(F.array_distinct("h")),
        F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, i: (F.get("sorted", i - 1)["h"].eqNullSafe(x["h"])
                         | F.get("sorted", i + 1)["h"].eqNullSafe(x["h"]))
    df = df.withColumn("starts", F.sort_array(F.filter(
        F.transform("sorted", lambda x, i: F.when(twin(x, i), x["i"])), lambda p: p.isNotNull())))
    cover = F.aggregate(
        "starts", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + WINDOW).alias("end"),
                                (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n")))["n"]
    return df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")).drop("h", "sorted", "starts")


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            rules: tuple[Rule, ...] = RULES) -> DataFrame:
    counted = _judged(df.select(F.struct(F.col(id_col).alias("id")).alias("row"),
                                whole(F.col(text_col)).alias("text")), rules)
    return counted.select(F.col("row.id").alias(id_col), *[c for c in counted.columns if c != "row"])


def _judged(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    out = _counted(df, "text")
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    safe = tuple(Rule(r.name, r.metric.replace("/ n_words", "/ greatest(n_words, 1)").replace(
        "/ n_lines", "/ greatest(n_lines, 1)"), r.low, r.high) for r in rules)
    return (out.withColumn("base_failed", F.expr(base))
            .withColumn("failed", F.expr(compiled(safe)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("failed") == "")))


def keep(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes the base rule and the table, with their columns as they were."""
    judged = _judged(df.select(F.struct("*").alias("row"), whole(F.col(text_col)).alias("text")), rules)
    # a filter would be pushed below the counts, and all of them be written out in it
    return judged.select(F.inline(F.when(F.col("kept"), F.array("row"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words", "failed")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows in DuckDB SQL: windows as joined strings, counted per document."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    metrics = {r.name: r.metric.replace("/ n_words", "/ greatest(n_words, 1)").replace(
        "/ n_lines", "/ greatest(n_lines, 1)") for r in rules}
    failed = compiled(tuple(Rule(r.name, metrics[r.name], r.low, r.high) for r in rules))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text,
             list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
        FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, unnest(range(0, {WINDOW})) AS u(o) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(list_filter(words, lambda x: x IN ({stops}))) AS BIGINT) AS n_stop_words
      FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
             {failed} AS failed FROM m)
SELECT *, (NOT base_failed AND failed = '') AS kept FROM f"""
