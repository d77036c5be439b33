"""Chat formatting by quotation linking: who answers whom, from quoted passages alone.

1. Each message is cut into runs of lines of one quote level: the leading ``>`` signs, with
   blanks between them, are the level; level 0 is the message's own text.
2. A passage is a run's text, normalised: lower case, white space as one blank, ends cut off.
   Its key is its SHA-256 within its scope (a mailbox, list or conversation). The paragraphs of a
   run (blocks between blank lines) have keys of their own.
3. Level-0 passages are the originals. Originals and quotes of one scope and key stand together in order, and each
   quote takes the latest original before it. A passage that thousands of messages share is not reduced to one
   row nor put into one task: the rows are cut into ranges of (scope, key, order), each range is
   scanned alone, and what lies before it comes from one row for each range that a key reaches into.
4. A run has the latest earlier message that has it as a whole run, or else the latest that one of its
   paragraphs comes from, so trimmed and interleaved quotes are found too. A message's parent is the
   latest message that one of its level-1 runs comes from, whole runs before paragraphs; if none is
   found, of its deeper ones.
5. Conversations are the trees of parents: the root of each message is found by doubling the
   parent pointers, in as many turns as the logarithm of the longest chain of replies. The rows
   are sorted by conversation and order, so every message stands after the one that it answers.

Lines of attribution ("... wrote:") at the end of a passage are no part of it.

Defined results: a null text counts as empty and is kept as an empty message; a null order comes
before all others; of rows with equal scope and order the smaller hash of the text comes first;
rows equal in scope, order and text are one message, but each comes back; null scopes are one
scope of their own; a quote of a later message does not link; a quote whose original is not there
leaves its message to the other quotes, or a root; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import shuffle_tasks, stored, table, whole

#: A line's quote signs and the blanks between them (possessive: no step back, whatever their number),
#: the gap between paragraphs, a letter or digit, and a line that introduces a quote.
SIGNS = r"^[ \t>]*+"
SPACES = " \t\n\x0b\x0c\r"
BLANK_LINES = r"\n[\x20\x09-\x0D]*\n"
WORDY = r"[\p{L}\p{N}]"
ATTRIBUTION = r"(?i)(?:^|\n)[^\n]*\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def own_text(text: Column) -> Column:
    """A level-0 run without a line of attribution at its end."""
    return F.regexp_replace(text, ATTRIBUTION, "")


def with_runs(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``runs``, array<struct<level, text>>: the runs of lines of one quote level, in order."""
    df = df.withColumn("lines", F.split(F.col(text_col), r"\r?\n"))
    df = df.withColumn("signs", F.transform("lines", lambda line: F.rtrim(F.regexp_extract(line, SIGNS, 0), F.lit(" \t"))))
    df = df.withColumn("levels", F.transform("signs", lambda s: F.char_length(s) - F.char_length(F.translate(s, ">", ""))))
    bare = lambda line, s: line.substr(F.char_length(s) + 1, F.char_length(line))
    df = df.withColumn("lines", F.transform("lines", lambda line, i: F.when(
        F.get("levels", i) == 0, line).otherwise(F.regexp_replace(bare(line, F.get("signs", i)), r"^[ \t]", "")))).drop("signs")
    df = df.withColumn("starts", F.filter(
        F.transform("levels", lambda v, i: F.when((i == 0) | (v != F.get("levels", i - 1)), i)),
        lambda i: i.isNotNull()))
    runs = F.transform("starts", lambda at, k: F.struct(
        F.get("levels", at).alias("level"), F.array_join(F.slice(
            "lines", at + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - at), "\n").alias("text")))
    return df.withColumn("runs", runs).drop("lines", "levels", "starts")


def with_earlier(originals: DataFrame, asked: DataFrame) -> DataFrame:
    """originals: scope, key, m, whole; asked: scope, key, m and more. ``asked`` with ``last``, the greatest m of an
    original of the scope and key before the row's own, and ``last_whole``, of those that are ``whole``."""
    spark = asked.sparkSession
    both = originals.withColumn("original", F.lit(True)).unionByName(asked.withColumn("original", F.lit(False)), allowMissingColumns=True)
    order = ["scope", "key", "m", "original"]  # of one message the quotes come first
    both = stored(spark, both.repartitionByRange(shuffle_tasks(spark), *order).withColumn("part", F.spark_partition_id()), "ranges")
    last = {"last": F.when(F.col("original"), F.col("m")), "last_whole": F.when(F.col("original") & F.col("whole"), F.col("m"))}
    reached = both.groupBy("scope", "key", "part").agg(*[F.max(c).alias(name) for name, c in last.items()])
    mine = Window.partitionBy("scope", "key")  # one row a range
    before = mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = reached.withColumn("ranges", F.count("*").over(mine)).select(
        "scope", "key", "part", "ranges", *[F.max(name).over(before).alias(f"earlier_{name}") for name in last])
    carry = carry.where("ranges > 1").drop("ranges")  # two rows a range at most
    here = Window.partitionBy("part", "scope", "key").orderBy("m", "original")
    scanned = both.select("*", *[F.max(c).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"here_{name}")
                                 for name, c in last.items()]).where("NOT original")
    scanned = scanned.join(F.broadcast(carry), ["scope", "key", "part"], "left")
    return scanned.select(*asked.columns, *[F.coalesce(f"here_{name}", f"earlier_{name}").alias(name) for name in last])


def linked(rows: DataFrame) -> DataFrame:
    """rows: scope, m (struct of order and text hash, a message within its scope), runs. One row per
    message: scope, m, n_quotes, n_found, parent (the m that it answers, or null)."""
    level, text = F.col("r.level"), F.col("r.text")
    parts = rows.select("scope", "m", F.explode("runs").alias("r")).select(
        "scope", "m", level.alias("level"), F.when(level > 0, text).otherwise(own_text(text)).alias("text"))
    parts = parts.withColumn("norm", normalised(F.col("text"))).where(F.col("norm").rlike(WORDY))
    blocks = F.filter(F.transform(F.split("text", BLANK_LINES), normalised), lambda x: x.rlike(WORDY))
    parts = parts.select("scope", "m", "level", F.sha2("norm", 256).alias("key"),
                         F.transform(blocks, lambda x: F.sha2(x, 256)).alias("blocks"))
    asked = F.explode(F.array_union(F.array("key"), "blocks")).alias("key")  # a run of one paragraph has one key
    originals = parts.where("level = 0").select("scope", "m", F.col("key").alias("run"), asked).groupBy("scope", "key", "m").agg(
        F.max(F.col("key") == F.col("run")).alias("whole"))
    # a message that quotes one passage twice asks once
    quotes = parts.where("level > 0").groupBy("scope", "key", "m").agg(
        F.min(F.struct("level", "blocks")).alias("q")).select(
        "scope", "m", F.col("q.level").alias("level"), F.col("key").alias("run"), F.col("key"), F.col("q.blocks").alias("blocks"))
    found = with_earlier(originals, quotes.select("scope", "m", "level", "run", asked)).groupBy("scope", "m", "level", "run").agg(
        F.max(F.when(F.col("key") == F.col("run"), F.col("last_whole"))).alias("whole"), F.max("last").alias("part"))
    found = found.withColumn("origin", F.coalesce("whole", "part"))
    best = found.groupBy("scope", "m").agg(
        F.count("*").alias("n_quotes"), F.count("origin").alias("n_found"),
        F.max(F.when(F.col("origin").isNotNull(), F.struct(
            (-F.col("level")).alias("l"), F.col("whole").isNotNull().alias("w"), F.col("origin")))).alias("b"))
    return rows.select("scope", "m").distinct().join(best, ["scope", "m"], "left").select(
        "scope", "m", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"), F.col("b.origin").alias("parent"))


def conversations(spark: SparkSession, links: DataFrame) -> DataFrame:
    """scope, m, root (the conversation's first message) and depth, for links with a parent."""
    up = links.where("parent IS NOT NULL").select("scope", "m", F.col("parent").alias("head"))
    replies = up.select("scope", F.col("m").alias("head"), F.lit(False).alias("ended"))
    state = stored(spark, up.join(replies, ["scope", "head"], "left").select(  # heads that answer nothing are roots
        "scope", "m", "head", F.lit(1).cast("long").alias("steps"), F.coalesce("ended", F.lit(True)).alias("ended")), "replies")
    while not state.where("NOT ended").isEmpty():  # only messages that are not at their root meet the join
        top = state.select("scope", F.col("m").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"),
                           F.col("ended").alias("done"))
        moved = state.where("NOT ended").join(top, ["scope", "head"]).select(
            "scope", "m", F.col("next").alias("head"), (F.col("steps") + F.col("more")).alias("steps"), F.col("done").alias("ended"))
        state = stored(spark, state.where("ended").unionByName(moved), "replies")
    return state.select("scope", "m", F.col("head").alias("root"), F.col("steps").alias("depth"))


def formatted(df: DataFrame, id_col: str, order_col: str, text_col: str, scope_col: str | None = None) -> DataFrame:
    """One row per input row: id, scope, seq (its order), root and parent (orders of the first message
    and of the one answered), depth, n_quotes, n_found, text (without quotes); sorted."""
    spark = df.sparkSession
    scope = F.col(scope_col).cast("string") if scope_col else F.lit("")
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), scope), F.lit("")).alias("scope"), F.col(id_col).alias("id"),
        F.struct(F.coalesce(F.col(order_col).cast("long"), F.lit(-(1 << 63))).alias("o"),
                 F.xxhash64(whole(F.col(text_col))).alias("tie")).alias("m"), whole(F.col(text_col)).alias("text"))
    rows = with_runs(rows, "text").drop("text")
    own = F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: own_text(r["text"])), "\n")
    rows = stored(spark, rows.withColumn("own", F.trim(own, F.lit(SPACES))), "messages")
    links = stored(spark, linked(rows), "links")
    links = links.join(conversations(spark, links), ["scope", "m"], "left")
    full = rows.select("scope", "m", "id", "own").join(links, ["scope", "m"])
    return full.select(
        F.col("id").alias(id_col), "scope", F.col("m.o").alias("seq"), F.coalesce("root", "m")["o"].alias("root"),
        F.col("parent.o").alias("parent"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", "n_found",
        F.col("own").alias("text")).orderBy("scope", "root", "seq")


def quoted_mail(turns: DataFrame) -> DataFrame:
    """Messages as mail readers show them, from the turns of conversations. Lines are paragraphs, and each message
    ends with its role as a paragraph of its own, which others share. Of four turns two quote the whole turn before
    (and, a level deeper, the one before that), one quotes its last paragraph alone, and one its
    first and second with a word of its own between them."""
    quote = lambda c: F.regexp_replace(c, r"(?m)^", "> ")
    text = F.concat_ws("\n\n", F.regexp_replace(F.trim(whole(F.col("text")), F.lit(SPACES)), r"[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*", "\n\n"),
                       F.concat(F.lit("Yours, "), whole(F.col("role"))))
    named = turns.select("conv_id", "turn", F.col("role"), text.alias("text"))
    back = lambda k, name: named.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(name))
    shown = named.join(back(1, "before"), ["conv_id", "turn"], "left").join(back(2, "older"), ["conv_id", "turn"], "left")
    blocks = F.split("before", "\n\n")
    full = F.concat_ws("\n", quote(quote(F.col("older"))), quote(F.col("before")))
    trimmed = quote(F.element_at(blocks, -1))
    between = F.concat_ws("\n", quote(F.get(blocks, F.lit(0))), F.concat(F.lit("\nSo "), F.col("turn").cast("string")), quote(F.get(blocks, F.lit(1))))
    shape = F.pmod(F.col("turn"), F.lit(4))
    head = F.when(F.col("before").isNotNull(), F.when(shape == 2, trimmed).when(shape == 3, between).otherwise(full))
    return shown.select("conv_id", "turn", F.struct("conv_id", "turn", "role").alias("id"),
                        F.concat_ws("\n", head, F.when(head.isNotNull(), F.lit("")), F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = quoted_mail(table(spark, sf_dir, "conversations"))
    return formatted(mail, "id", "turn", "text", "conv_id").select(
        F.col("id.conv_id").alias("conv_id"), F.col("id.turn").alias("turn"), F.col("id.role").alias("role"),
        "root", "depth", "parent", "n_quotes", "n_found", "text")


#: DuckDB: the same mail as runs of one level; for each quoted run the latest earlier turn that has it, whole or in part.
SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, concat_ws(chr(10) || chr(10),
    regexp_replace(trim(coalesce(text, ''), e' \\t\\n\\x0b\\x0c\\r'), '[\\x20\\x09-\\x0D]*\\n[\\x20\\x09-\\x0D]*', e'\\n\\n', 'g'),
    'Yours, ' || coalesce(role, '')) AS text FROM conversations),
b AS (SELECT t.*, b.text AS before, o.text AS older, string_split(b.text, e'\\n\\n') AS p
      FROM t LEFT JOIN t AS b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1
             LEFT JOIN t AS o ON o.conv_id = t.conv_id AND o.turn = t.turn - 2),
runs AS (
  SELECT conv_id, turn, 0 AS level, text AS run FROM b
  UNION ALL SELECT conv_id, turn, 2, older FROM b WHERE turn % 4 < 2 AND before IS NOT NULL AND older IS NOT NULL
  UNION ALL SELECT conv_id, turn, 1, before FROM b WHERE turn % 4 < 2 AND before IS NOT NULL
  UNION ALL SELECT conv_id, turn, 1, p[len(p)] FROM b WHERE turn % 4 = 2 AND before IS NOT NULL
  UNION ALL SELECT conv_id, turn, 1, unnest(p[1:2]) FROM b WHERE turn % 4 = 3 AND before IS NOT NULL
  UNION ALL SELECT conv_id, turn, 0, 'So ' || turn FROM b WHERE turn % 4 = 3 AND before IS NOT NULL),
k AS (SELECT conv_id, turn, level, list_transform([run] || string_split(run, e'\\n\\n'),
             lambda x: trim(regexp_replace(lower(x), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS keys FROM runs),
w AS (SELECT conv_id, turn, level, keys[1] AS run, list_distinct(list_filter(keys, lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))) AS keys
      FROM k WHERE regexp_matches(keys[1], '[\\p{L}\\p{N}]')),
o AS (SELECT conv_id, turn, key, bool_or(key = run) AS whole FROM (SELECT conv_id, turn, run, unnest(keys) AS key FROM w WHERE level = 0)
      GROUP BY ALL),
q AS (SELECT conv_id, turn, run, min(level) AS level, any_value(keys) AS keys FROM w WHERE level > 0 GROUP BY conv_id, turn, run),
a AS (SELECT q.conv_id, q.turn, q.level, q.run, max(CASE WHEN o.whole AND o.key = q.run THEN o.turn END) AS had, max(o.turn) AS part
      FROM (SELECT conv_id, turn, run, level, unnest(keys) AS key FROM q) AS q
      LEFT JOIN o ON o.conv_id = q.conv_id AND o.key = q.key AND o.turn < q.turn GROUP BY ALL),
l AS (SELECT conv_id, turn, count(*) AS n_quotes, count(coalesce(had, part)) AS n_found,
             max(CASE WHEN part IS NOT NULL THEN {'l': -level, 'w': had IS NOT NULL, 'o': coalesce(had, part)} END).o AS parent
      FROM a GROUP BY ALL),
r AS (SELECT t.conv_id, t.turn, t.turn AS root, CAST(0 AS BIGINT) AS depth
      FROM t LEFT JOIN l USING (conv_id, turn) WHERE l.parent IS NULL
      UNION ALL
      SELECT l.conv_id, l.turn, r.root, r.depth + 1 FROM l JOIN r ON l.conv_id = r.conv_id AND l.parent = r.turn)
SELECT b.conv_id, b.turn, b.role, r.root, r.depth, l.parent, coalesce(l.n_quotes, 0) AS n_quotes, coalesce(l.n_found, 0) AS n_found,
       trim(CASE WHEN b.turn % 4 = 3 AND b.before IS NOT NULL THEN 'So ' || b.turn || e'\\n\\n' ELSE '' END
            || b.text, e' \\t\\n\\x0b\\x0c\\r') AS text
FROM b JOIN r USING (conv_id, turn) LEFT JOIN l USING (conv_id, turn)"""
