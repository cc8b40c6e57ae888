"""Benchmark decontamination with a broadcast hash set of normalised test n-grams. DataFrame functions only.

Every ``size`` consecutive words of a benchmark item are a window; an item of
fewer words is one window. A document word inside any occurrence of a window is
hit. The hashes of the windows' first three words go to every task as a hash
set; a document is scanned in its own row, and only the few positions whose
three words are in the set have their window built and verified as text.
The sets are broadcast only while the benchmark is below ``max_windows``
windows. Beyond that, one narrow row a word position (number, place, hash of
three words) is joined with the heads by a shuffle, and the windows built at the
places that are met are verified by a second join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import write_table

SIZE = 13
HEAD = 3
MAX_WINDOWS = 50_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HITS = "array<struct<start:int,n:int,window:string>>"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else unchanged; ``lower`` does just that where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), 0), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per distinct window: ``window``, ``n`` words, ``head`` hash, ``items`` (sorted item ids as strings)."""
    w = F.col("w")
    several = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.slice(w, i, size))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
        .where((F.size("w") > 0) & F.col("item_id").isNotNull())
        .select("item_id", F.explode(F.when(F.size(w) <= size, F.array(w)).otherwise(several)).alias("v"))
        .groupBy(F.array_join("v", " ").alias("window"), F.size("v").alias("n"), F.xxhash64(*[F.get("v", F.lit(i)) for i in range(HEAD)]).alias("head"))
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )


def _built(positions: Column, w: Column, lengths: list[int]) -> Column:
    """Array of (start, n, window) for the windows of these lengths that begin at the positions and fit."""
    made = F.flatten(F.transform(positions, lambda i: F.transform(F.array(*map(F.lit, lengths)), lambda n: F.struct(i.alias("start"), n.alias("n"), F.array_join(F.slice(w, i + 1, n), " ").alias("window")))))
    return F.filter(made, lambda c: c["start"] + c["n"] <= F.size(w))


def _long(value: int) -> str:
    return f"{value}L" if value >= 0 else f"CAST('{value}' AS BIGINT)"


def _scan_in_row(docs: DataFrame, table: DataFrame) -> DataFrame:
    known = table.collect()  # at most max_windows rows
    lengths = sorted({r.n for r in known})
    tests = []
    for k in range(1, HEAD + 1):
        heads = sorted({r.head for r in known if min(r.n, HEAD) == k})
        if heads:
            parts = ", ".join(f"get(_w, i + {j})" for j in range(k))
            tests.append(f"xxhash64({parts}) IN ({', '.join(map(_long, heads))})")
    quoted = ", ".join(f"'{r.window}'" for r in known)  # words hold no quote and no backslash
    first = F.expr(f"filter(sequence(0, size(_w) - 1), i -> {' OR '.join(tests)})")
    return (
        docs.withColumn("_w", words_of(F.col("text")))
        .withColumn("_p", F.when(F.size("_w") > 0, first).otherwise(F.array().cast("array<int>")))
        .withColumn("_hits", F.when(F.size("_p") > 0, _built(F.col("_p"), F.col("_w"), lengths)).otherwise(F.array().cast(HITS)))
        .withColumn("_hits", F.when(F.size("_hits") > 0, F.expr(f"filter(_hits, c -> c.window IN ({quoted}))")).otherwise(F.array().cast(HITS)))
        .drop("_p")
    )


def _scan_by_join(docs: DataFrame, table: DataFrame) -> DataFrame:
    """One narrow row a word position meets the window heads; windows are built and verified only where a head is met."""
    docs = write_table(docs.withColumn("_row", F.monotonically_increasing_id()), "scanned")
    words, w = docs.select("_row", words_of(F.col("text")).alias("_w")), F.col("_w")
    lengths = [r.n for r in table.select("n").distinct().orderBy("n").collect()]  # at most the window size
    start = lambda i, k: F.struct(F.lit(k).alias("k"), i.alias("i"), F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("head"))
    every = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array(*[start(i, k) for k in sorted({min(n, HEAD) for n in lengths})]))
    heads = table.select(F.least("n", F.lit(HEAD)).alias("k"), "head").distinct()
    met = words.where(F.size(w) > 0).select("_row", F.explode(F.flatten(every)).alias("s")).select("_row", "s.*").join(heads, ["k", "head"], "left_semi")
    places = met.groupBy("_row").agg(F.sort_array(F.collect_set("i")).alias("_p"))
    hits = (
        words.join(places, "_row")
        .select("_row", F.explode(_built(F.col("_p"), w, lengths)).alias("c"))
        .withColumn("window", F.col("c.window"))
        .join(table.select("window"), "window", "left_semi")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list("c")).alias("_hits"))
    )
    return docs.withColumn("_w", words_of(F.col("text"))).join(hits, "_row", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast(HITS))).drop("_row")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_windows: int = MAX_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with ``_w`` words and ``_hits``, an array of (start, n, window) in order of start; the window table)."""
    table = write_table(benchmark_windows(benchmark, size), "windows")
    known = table.limit(max_windows + 1).count()
    if known == 0:
        return docs.withColumn("_w", words_of(F.col("text"))).withColumn("_hits", F.array().cast(HITS)), table
    return (_scan_in_row if known <= max_windows else _scan_by_join)(docs, table), table


def hit_words(hits: Column) -> Column:
    """Words covered by hits, given in order of start."""
    step = lambda acc, c: F.struct(
        (acc["n"] + F.greatest(F.lit(0), c["start"] + c["n"] - F.greatest(c["start"], acc["end"]))).cast("long").alias("n"),
        F.greatest(acc["end"], c["start"] + c["n"]).alias("end"),
    )
    return F.aggregate(hits, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``items``.

    Null and wordless texts have no words and no hits. Benchmark rows without
    an id or without words are ignored; equal windows of several items count
    for each. Rows that repeat a ``doc_id`` or lack one are judged on their
    own. Extra columns are ignored.
    """
    found, table = scan(docs.select("doc_id", "text"), benchmark, size, max_windows)
    narrow = found.select(
        "doc_id",
        F.monotonically_increasing_id().alias("_row"),
        F.size("_w").cast("long").alias("n_words"),
        hit_words(F.col("_hits")).alias("n_hit"),
        F.array_distinct(F.transform("_hits", lambda c: c["window"])).alias("windows"),
    )
    per_window = narrow.select("doc_id", "_row", "n_words", "n_hit", F.explode_outer("windows").alias("window"))
    bounded = table.select("window", "items")
    if table.limit(max_windows + 1).count() <= max_windows:
        bounded = F.broadcast(bounded)
    return (
        per_window.join(bounded, "window", "left")
        .withColumn("item", F.explode_outer("items"))
        .groupBy("_row", "doc_id", "n_words", "n_hit")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
            "items",
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without contaminated rows; in the rows that stay, words hit by a window are removed from the text.

    A removed word leaves the characters between words in place. Rows without a
    hit are returned unchanged, null texts included; repeated rows are treated
    alike. All input columns stay, whatever their names.
    """
    found, _ = scan(docs.select("text", F.struct("*").alias("row")), benchmark, size, max_windows)
    # Stored, since a filter on the hits would be pushed below their computation and repeat it.
    found = write_table(found.select("row", F.size("_w").alias("_n"), hit_words(F.col("_hits")).alias("_hit"), "_hits"), "scanned")
    text = F.col("row.text")
    cased = F.regexp_extract_all(text, F.lit(CASED_WORD), 0)
    gaps = F.split(text, CASED_WORD, -1)
    covered = lambda i: F.exists("_hits", lambda c: (c["start"] <= i) & (i < c["start"] + c["n"]))
    kept = F.transform(cased, lambda word, i: F.concat(F.when(covered(i), F.lit("")).otherwise(word), F.get(F.col("_g"), i + 1)))
    cleaned = F.when(F.size("_hits") > 0, F.concat(F.get("_g", F.lit(0)), F.array_join(kept, ""))).otherwise(text)
    return (
        found.where(~is_contaminated(F.col("_hit"), F.col("_n")))
        .withColumn("_g", F.when(F.size("_hits") > 0, gaps))
        .select(F.col("row").withField("text", cleaned).alias("row"))
        .select("row.*")
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids, list(item ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
