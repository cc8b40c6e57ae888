r"""Quotation linking of messages. DataFrame functions only.

A line's quote level is its number of leading ``>`` marks (blanks between them
allowed). Neighbouring lines of one level that are not blank form a passage.
Passages are normalised (lower case, white space collapsed) and hashed with
SHA-256. The unquoted passages of a message, and each of their lines, are what
later messages can quote. A quoted passage is linked to the latest earlier turn
of its conversation that holds it; a message replies to the turn that the
outermost of its linked passages came from (of several, the latest).

Finding the latest earlier turn takes no pairs: distinct turns of one
conversation and hash are walked in order, in buckets of ``BUCKET`` turns, and
what earlier buckets held enters as one pre-aggregated row each. Thread roots
come from pointer doubling. Positions within a conversation are ranks in
buckets plus sums over earlier buckets, so that a conversation with a third of
all messages is no single task's load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from .shared import write_table

BUCKET = 1024
MARKS = r"^[ \t]*(>[ \t]*)+"
_PASSAGES = "array<struct<level:int,body:string>>"


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s]+", " "))


def _lines(text: Column) -> Column:
    """Array of (level, body); the body is the line without its marks and outer blanks."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("level"),
            F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"[\s]+", " ")).alias("body"),
        ),
    )


def _passages(lines: Column) -> Column:
    """Array of (level, body) of the maximal runs of non-blank lines of one level."""
    indexed = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["level"].alias("level"), x["body"].alias("body"))), lambda x: x["body"] != "")
    before = lambda x: F.get(lines, x["i"] - 1)
    starts = F.filter(indexed, lambda x: (x["i"] == 0) | F.coalesce((before(x)["body"] == "") | (before(x)["level"] != x["level"]), F.lit(True)))

    def runs(t: Column) -> Column:
        after = lambda k: F.coalesce(F.get(t, k + 1)["i"], F.size(lines))
        body = lambda s, k: F.array_join(F.transform(F.filter(F.slice(lines, s["i"] + 1, after(k) - s["i"]), lambda x: (x["body"] != "") & (x["level"] == s["level"])), lambda x: x["body"]), " ")
        return F.transform(t, lambda s, k: F.struct(s["level"].alias("level"), body(s, k).alias("body")))

    return let(starts, runs)


def parse(messages: DataFrame) -> DataFrame:
    """Adds ``_row``, ``clean_text`` (lines of level 0) and ``_passages``, ``_own_lines``."""
    text = F.coalesce("text", F.lit(""))
    quoted = F.rlike(text, F.lit("(?m)" + MARKS))
    return (
        messages.withColumn("_l", _lines(text))
        .withColumn("_passages", _passages(F.col("_l")))
        .withColumn("_own_lines", F.transform(F.filter("_l", lambda x: (x["level"] == 0) & (x["body"] != "")), lambda x: x["body"]))
        .withColumn("clean_text", F.when(quoted, F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~F.rlike(line, F.lit(MARKS))), "\n")).otherwise(F.col("text")))
        .drop("_l")
    )


def _latest_earlier(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """Per distinct (conv_id, hash, turn) of ``quotes``: ``found``, the latest smaller turn of ``originals`` with the same hash."""
    key = ["conv_id", "hash"]
    marked = quotes.select(*key, "turn", F.lit(0).alias("own")).unionByName(originals.select(*key, "turn", F.lit(1).alias("own")))
    turns = marked.groupBy(*key, "turn").agg(F.max("own").alias("own"), F.min("own").alias("asks")).withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    held = F.when(F.col("own") == 1, F.col("turn"))
    buckets = turns.groupBy(*key, "bucket").agg(F.max(held).alias("most"))
    earlier = F.max("most").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    within = F.max(held).over(Window.partitionBy(*key, "bucket").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return (
        turns.withColumn("within", within)
        .where("asks = 0")
        .join(buckets.select(*key, "bucket", earlier.alias("earlier")), [*key, "bucket"])
        .select(*key, "turn", F.coalesce("within", "earlier").alias("found"))
        .where("found is not null")
    )


def links(parsed: DataFrame) -> DataFrame:
    """Linked passages: ``conv_id``, ``turn``, ``level``, ``hash``, ``found``, and per (conv_id, turn) all that matter once."""
    hashed = lambda body: F.sha2(normalise(body), 256)
    keyed = parsed.where("conv_id is not null and turn is not null")
    each = keyed.select("conv_id", "turn", F.explode("_passages").alias("p")).where("p.level > 0")
    quotes = write_table(each.select("conv_id", "turn", F.col("p.level").alias("level"), hashed(F.col("p.body")).alias("hash")).distinct(), "quotes")
    own = F.concat(F.transform(F.filter("_passages", lambda p: p["level"] == 0), lambda p: p["body"]), F.col("_own_lines"))
    wanted = quotes.select("conv_id", "hash").distinct()
    originals = keyed.select("conv_id", "turn", F.explode(F.array_distinct(own)).alias("body")).select("conv_id", "turn", hashed(F.col("body")).alias("hash")).join(wanted, ["conv_id", "hash"], "left_semi")
    return quotes.join(_latest_earlier(quotes, originals), ["conv_id", "hash", "turn"])


def _threads(replies: DataFrame, rounds: int = 64) -> DataFrame:
    """``conv_id``, ``turn``, ``reply_to``, ``root``, ``depth`` of messages with a reply link, by pointer doubling."""
    now = write_table(replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(rounds):
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        if not now.join(up, ["conv_id", "root"], "left_semi").limit(1).count():
            return now
        step = now.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", "reply_to", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        now = write_table(step, "threads")
    raise RuntimeError("threads did not settle")


def link_conversations(messages: DataFrame) -> DataFrame:
    """One row per input row, ready to be read in reply order.

    Columns: ``conv_id``, ``turn``, ``role``, ``position`` (from 0 in the
    conversation: by thread root, then turn), ``reply_to`` (a turn or null),
    ``thread_root``, ``depth`` (links to the root), ``n_quotes`` (distinct quoted passages by level),
    ``n_linked``, ``clean_text`` (the text without quote lines).

    Null texts have no passages and stay null. Rows without ``conv_id`` or
    ``turn`` take no part in linking; they are ranked with the rows of equal
    (null) keys. Rows that repeat a turn share its links; ties in position go by
    role, then text. Extra columns are ignored.
    """
    parsed = write_table(parse(messages.select("conv_id", "turn", "role", "text")), "messages")
    found = write_table(links(parsed), "quote-links")
    replies = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("found"))).alias("m"), F.count("*").alias("n_linked")).select("conv_id", "turn", (-F.col("m")["col2"]).alias("reply_to"), "n_linked")
    threads = _threads(replies).join(replies.select("conv_id", "turn", "n_linked"), ["conv_id", "turn"])
    quotes = F.size(F.array_distinct(F.transform(F.filter("_passages", lambda p: p["level"] > 0), lambda p: F.struct(p["level"], normalise(p["body"]))))).cast("long")
    rows = (
        parsed.select("conv_id", "turn", "role", "text", "clean_text", quotes.alias("n_quotes"))
        .join(threads, ["conv_id", "turn"], "left")
        .withColumn("thread_root", F.coalesce("root", "turn"))
        .withColumn("_b", F.floor(F.col("turn") / BUCKET))
    )
    rows = write_table(rows, "linked")
    key = ["conv_id", "thread_root", "_b"]
    # Two levels of sums, so that a conversation of many roots is summed in buckets of roots.
    sums = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("_rb", F.floor(F.col("thread_root") / BUCKET))
    earlier = lambda value, by, order: F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sums.groupBy("conv_id", "_rb").agg(F.sum("n").alias("t"))
    totals = totals.select(F.col("conv_id").alias("tc"), F.col("_rb").alias("tb"), earlier("t", ["conv_id"], ["_rb"]).alias("far"))
    sums = sums.withColumn("near", earlier("n", ["conv_id", "_rb"], ["thread_root", "_b"])).join(totals, F.col("conv_id").eqNullSafe(F.col("tc")) & F.col("_rb").eqNullSafe(F.col("tb")))
    sums = sums.select(*[F.col(k).alias(f"x{i}") for i, k in enumerate(key)], (F.col("near") + F.col("far")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("turn", "role", "text"))
    same = [F.col(k).eqNullSafe(F.col(f"x{i}")) for i, k in enumerate(key)]
    return rows.withColumn("_r", rank).join(sums, same).select(
        "conv_id", "turn", "role",
        (F.col("before") + F.col("_r") - 1).cast("long").alias("position"),
        "reply_to", "thread_root",
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "clean_text",
    )


ORACLE_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text, coalesce(text, '') AS t FROM conversations),
l AS (
  SELECT r, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(regexp_replace(line, '^[ \t]*(>[ \t]*)+', ''), '[\s]+', ' ', 'g')) AS body, line
  FROM (SELECT r, conv_id, turn, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM m)),
g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (
    SELECT *, CASE WHEN lag(level) OVER w IS NULL OR lag(level) OVER w <> level OR lag(body) OVER w = '' THEN 1 ELSE 0 END AS fresh
    FROM l WINDOW w AS (PARTITION BY r ORDER BY i))),
p AS (SELECT r, conv_id, turn, level, trim(lower(string_agg(body, ' ' ORDER BY i))) AS body FROM g WHERE body <> '' GROUP BY r, conv_id, turn, level, run),
q AS (SELECT DISTINCT conv_id, turn, level, body FROM p WHERE level > 0),
o AS (SELECT DISTINCT conv_id, turn, body FROM (
  SELECT conv_id, turn, body FROM p WHERE level = 0 UNION ALL SELECT conv_id, turn, lower(body) FROM l WHERE level = 0 AND body <> '')),
k AS (SELECT q.conv_id, q.turn, q.level, q.body, max(o.turn) AS found FROM q JOIN o ON q.conv_id = o.conv_id AND q.body = o.body AND o.turn < q.turn GROUP BY ALL),
y AS (SELECT conv_id, turn, arg_min(found, level * 1e12 - found) AS reply_to, count(*) AS n_linked FROM k GROUP BY ALL),
th AS (
  SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM y
  UNION ALL SELECT th.conv_id, th.turn, y.reply_to, th.depth + 1 FROM th JOIN y ON th.conv_id = y.conv_id AND th.root = y.turn),
top AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM th GROUP BY ALL),
c AS (SELECT r, count(DISTINCT (level, body)) AS n_quotes FROM p WHERE level > 0 GROUP BY r),
x AS (SELECT r, CASE WHEN bool_or(level > 0) THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), '') END AS cleaned FROM l GROUP BY r)
SELECT m.conv_id, m.turn, m.role,
  row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(root, m.turn), m.turn, m.role, m.text) - 1 AS position,
  y.reply_to, coalesce(root, m.turn) AS thread_root, CAST(coalesce(depth, 0) AS BIGINT) AS depth,
  CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, coalesce(cleaned, m.text) AS clean_text
FROM m LEFT JOIN x USING (r) LEFT JOIN c USING (r)
  LEFT JOIN y ON m.conv_id = y.conv_id AND m.turn = y.turn
  LEFT JOIN top ON m.conv_id = top.conv_id AND m.turn = top.turn
"""
