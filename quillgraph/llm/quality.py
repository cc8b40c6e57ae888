"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over symbols, of order ``ORDER``: an n-gram is one long of 12 bits
a symbol, with start and end symbols. A code point below ``PLAIN`` is one
symbol, any other three (its seven-bit parts, each with symbols of its own), so
that different texts never share their symbols. Trusted text is every document of quality 1 that is not held out;
its n-grams are counted in all its text. Counts, continuation counts, discounts
and interpolated probabilities are DataFrame aggregates and joins.

The finished tables are written in shards by key range. Scoring is a map-side
join: a task sorts the distinct n-grams of some documents and looks them up
shard by shard, so its memory is bounded by one batch and a few shards, whatever
the model's size; no document text is shuffled for it. Texts become n-grams a
slice at a time and results leave the task a group at a time, as Spark's own
batches (10,000 rows or 64 MB) are too large to be held several times over.

A short text's perplexity says little, so the statistic is the log perplexity
shrunk by ``PSEUDO`` characters towards the language's median. A document passes
when that is at most its language's threshold: the ``QUANTILE`` of trusted
held-out documents plus ``MARGIN``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_paths, drop_tables, filesystem, new_path, write_table
from .tokens import drop_encoders
from .toxicity import held_out

ORDER = 5
BITS = 12
SYMBOLS = 1 << BITS
END = SYMBOLS - 1
PLAIN = 3700
SHARD_ROWS = 500_000
KEPT_SHARDS = 6
GROUP_BYTES = 2_000_000
SLICE_BYTES = 250_000
LOOKUPS = 500_000
FLUSH = 1_500_000
ROWS_OUT = 1_000
QUANTILE, MARGIN = 0.99, 0.1
PSEUDO = 40
CACHE_BITS = 20


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = points >= PLAIN
    if wide.any():
        sizes = np.where(wide, 3, 1)
        points, wide = np.repeat(points, sizes), np.repeat(wide, sizes)
        part = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        points = np.where(wide, PLAIN + 128 * part + (points >> (14 - 7 * part) & 127), points)
    return points + 1


def ngram_codes(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the n-gram ending at every character and at each end symbol, positions per text)."""
    parts, sizes = [], []
    start, end = np.zeros(order - 1, np.int64), np.array([END])
    for text in texts:
        own = symbols(text or "")
        parts += [start, own, end]
        sizes.append(len(own) + 1)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.concatenate(parts)
    code = np.zeros(len(flat) - order + 1, np.int64)
    for k in range(order):
        code = code << BITS | flat[k : len(flat) - order + 1 + k]
    lengths = np.array(sizes, np.int64)
    first = np.cumsum(lengths + order - 1) - (lengths + order - 1)  # a text's own codes begin where its padding does
    keep = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    return code[keep], lengths


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to ``most`` at most, a larger item alone."""
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if len(sizes):
        yield first, len(sizes)


def _sizes(texts) -> np.ndarray:
    """Bytes of each text of an Arrow array, and one for its end; never less than its symbols."""
    import pyarrow.compute as pc

    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _slices(texts, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``ngram_codes`` of an Arrow array, about SLICE_BYTES at a time."""
    for a, b in _groups(_sizes(texts), SLICE_BYTES):
        yield ngram_codes(texts.slice(a, b - a).to_pylist(), order)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of all parts, sorted, with their counts added up."""
    codes = np.concatenate([c for c, _ in parts])
    order = np.argsort(codes)
    codes, counts = codes[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(codes), 1), bool), codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def count_ngrams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``code`` and ``n`` over all of column ``text``; each task adds up its own before the shuffle."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts, fresh = [none], 0  # the first is merged, the others have ``fresh`` codes
        for batch in batches:
            for own, _ in _slices(batch.column(0), order):
                parts.append(np.unique(own, return_counts=True))
                fresh += len(parts[-1][0])
                if fresh > LOOKUPS:
                    parts, fresh = [_merged(parts)], 0
                    if len(parts[0][0]) > FLUSH:
                        yield out(*parts[0])
                        parts = [none]
            pa.default_memory_pool().release_unused()
        yield out(*_merged(parts))

    return texts.select("text").where("text is not null").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    got = {r.n: r.k for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    k1, k2, k3, k4 = (got.get(i, 0) for i in (1, 2, 3, 4))
    if not (k1 and k2):
        return 0.5, 0.75, 0.9
    y = k1 / (k1 + 2 * k2)
    found = (1 - 2 * y * k2 / k1, 2 - 3 * y * k3 / k2, 3 - 4 * y * k4 / k3 if k3 else 3 * y)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))  # type: ignore[return-value]


@dataclass
class Model:
    """Folders of key-sorted shards: ``key`` = order << 60 | code; ``value`` = log probability, or log back-off weight."""

    probabilities: str
    backoffs: str
    order: int = ORDER


def _key(n: int, code):
    return code.bitwiseOR(F.lit(n << 60))


def _write_shards(spark: SparkSession, table: DataFrame, name: str) -> str:
    path = new_path(spark, name)
    shards = 1 + table.count() // SHARD_ROWS
    table.repartitionByRange(shards, "key").sortWithinPartitions("key").write.parquet(path)
    return path


def train(trusted: DataFrame, order: int = ORDER) -> Model:
    """Fit on all of ``trusted`` (column ``text``). Without any text only the uniform unigram remains."""
    spark = trusted.sparkSession
    counts = write_table(count_ngrams(trusted, order), "ngrams")
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        suffix = F.col("code").bitwiseAND(F.lit((1 << BITS * n) - 1))
        levels[n] = write_table(levels[n + 1].groupBy(suffix.alias("code")).agg(F.count("*").alias("n")), "ngrams")
    lower, gammas, probs, tables = None, [], [], []
    for n in range(1, order + 1):
        d1, d2, d3 = discounts(levels[n])
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        grams = levels[n].withColumn("context", F.shiftright("code", BITS))
        context = grams.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("mass")).withColumn("gamma", F.col("mass") / F.col("total"))
        joined = grams.join(context, "context").select("code", ((F.col("n") - off) / F.col("total")).alias("own"), "gamma")
        if n == 1:
            table = joined.select("code", (F.col("own") + F.col("gamma") / SYMBOLS).alias("p"))
        else:
            shorter = lower.select(F.col("code").alias("suffix"), F.col("p").alias("below"))
            table = joined.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))).join(shorter, "suffix").select("code", (F.col("own") + F.col("gamma") * F.col("below")).alias("p"))
        lower = write_table(table, "probabilities")
        tables.append(lower)
        probs.append(lower.select(_key(n, F.col("code")).alias("key"), F.log("p").cast("float").alias("value")))
        gammas.append(context.select(_key(n, F.col("context")).alias("key"), F.log("gamma").cast("float").alias("value")))
    union = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(union(tables[1:]))
    model = Model(_write_shards(spark, union(probs), "model-p"), _write_shards(spark, union(gammas), "model-g"), order)
    drop_tables(*levels.values(), *tables)
    return model


class Shards:
    """Lookups in a folder of key-sorted shards; holds a few shards at a time.

    Lookups go through all shards again and again, so the shard read last makes room for the next one.
    """

    def __init__(self, uri: str):
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.fs, root = filesystem(uri)
        infos = self.fs.get_file_info(fs.FileSelector(root))
        self.paths = sorted(i.path for i in infos if i.path.endswith(".parquet"))
        self.firsts, self.kept = [], {}
        bounds = []
        for p in self.paths:
            with self.fs.open_input_file(p) as file:  # the first key is in the footer
                footer = pq.ParquetFile(file).metadata
                if footer.num_rows:
                    at = next(i for i in range(footer.num_columns) if footer.row_group(0).column(i).path_in_schema == "key")
                    bounds.append((int(footer.row_group(0).column(at).statistics.min), p))
        bounds.sort()
        self.firsts, self.paths = np.array([b for b, _ in bounds], np.int64), [p for _, p in bounds]

    def _read(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.parquet as pq

        if path not in self.kept:
            if len(self.kept) >= KEPT_SHARDS:
                self.kept.popitem()
            with self.fs.open_input_file(path) as file:
                table = pq.ParquetFile(file).read(["key", "value"], use_threads=False)
            self.kept[path] = (table["key"].to_numpy(), table["value"].to_numpy())
        return self.kept[path]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; nan where absent."""
        out = np.full(len(keys), np.nan)
        if not len(self.firsts):
            return out
        order = np.argsort(keys)
        ordered = keys[order]
        cuts = [*np.searchsorted(ordered, self.firsts).tolist(), len(ordered)]
        for k, path in enumerate(self.paths):
            if cuts[k] < cuts[k + 1]:
                have, values = self._read(path)
                some = ordered[cuts[k] : cuts[k + 1]]
                at = np.minimum(np.searchsorted(have, some), len(have) - 1)
                out[order[cuts[k] : cuts[k + 1]]] = np.where(have[at] == some, values[at], np.nan)
        return out


class Scorer:
    """Log probabilities of n-gram codes, with a direct-mapped cache of fixed size in front of the shards."""

    def __init__(self, model: Model):
        self.order = model.order
        self.p, self.g = Shards(model.probabilities), Shards(model.backoffs)
        self.keys = np.full(1 << CACHE_BITS, -1, np.int64)
        self.values = np.zeros(1 << CACHE_BITS)

    def _chain(self, codes: np.ndarray) -> np.ndarray:
        """Back off from the longest n-gram until one is known; an unknown character gets the uniform share."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for n in range(self.order, 0, -1):
            part = codes[open_] & ((1 << BITS * n) - 1)
            found = self.p.find(part | n << 60)
            known = ~np.isnan(found)
            out[open_[known]] += found[known]
            open_, part = open_[~known], part[~known]
            if not len(open_):
                return out
            gamma = self.g.find(part >> BITS | n << 60)
            out[open_] += np.where(np.isnan(gamma), 0, gamma)
        out[open_] -= np.log(SYMBOLS)
        return out

    def __call__(self, slices: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(mean negative log probability, positions) of each text of some slices of ``ngram_codes``.

        What the cache lacks is looked up at once for all slices, so that shards are read once.
        """
        found, missed, wanted, sizes = [], [], [], []
        for codes, lengths in slices:
            slot = self._slot(codes)
            found.append(self.values[slot])
            missed.append(np.flatnonzero(self.keys[slot] != codes))
            wanted.append(codes[missed[-1]])
            sizes.append(lengths)
        if any(map(len, wanted)):
            fresh = np.unique(np.concatenate([np.unique(w) for w in wanted]))
            values = np.concatenate([self._chain(fresh[a : a + LOOKUPS]) for a in range(0, len(fresh), LOOKUPS)])
            for own, at, codes in zip(found, missed, wanted, strict=True):
                own[at] = values[np.searchsorted(fresh, codes)]
            slot = self._slot(fresh)
            self.keys[slot], self.values[slot] = fresh, values
        means = [-np.add.reduceat(own, np.cumsum(n) - n) / n for own, n in zip(found, sizes, strict=True)]
        return np.concatenate(means), np.concatenate(sizes)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """``row`` (the input row, or these columns of it), ``log_ppl``, the mean negative log probability of a symbol of its ``text``, and ``chars``, its symbols (the end counts as one)."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    at = docs.columns.index("text")
    back = [docs.columns.index(c) for c in columns] if columns else range(len(docs.columns))
    schema = StructType([StructField("row", StructType([docs.schema.fields[i] for i in back])), StructField("log_ppl", DoubleType()), StructField("chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(model)
            rows = batch.column(0)
            texts, kept = rows.field(at), pa.StructArray.from_arrays([rows.field(i) for i in back], fields=[rows.type.field(i) for i in back])
            for a, b in _groups(_sizes(texts), GROUP_BYTES):
                values, chars = scorer(_slices(texts.slice(a, b - a), model.order))
                yield pa.RecordBatch.from_arrays([kept.slice(a, b - a), pa.array(values), pa.array(chars)], names=["row", "log_ppl", "chars"])
            pa.default_memory_pool().release_unused()

    return docs.select(F.struct("*").alias("row")).mapInArrow(run, schema)


def _trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored ``doc_id``, ``lang``, ``text`` of the trusted documents, for training and thresholds.

    No text is shuffled: the trusted ids are written in shards, as a model is,
    and each task looks up the ids of its own rows. Only ids that are no
    integers are joined, hashed by ``doc_id`` at every size.
    """
    import pyarrow as pa

    rows, ids = docs.select("doc_id", "lang", "text"), _trusted_ids(labels)
    whole = {"bigint", "int", "smallint", "tinyint"}
    if not {docs.schema["doc_id"].dataType.simpleString(), labels.schema["doc_id"].dataType.simpleString()} <= whole:
        return write_table(rows.join(ids.hint("shuffle_hash"), "doc_id", "left_semi"), "trusted")
    uri = _write_shards(docs.sparkSession, ids.select(F.col("doc_id").cast("long").alias("key"), F.lit(0).cast("float").alias("value")), "trusted-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        shards = None
        for batch in batches:
            shards = shards or Shards(uri)
            own = batch.column(0)
            found = ~np.isnan(shards.find(own.fill_null(0).cast(pa.int64()).to_numpy()))
            found &= own.is_valid().to_numpy(zero_copy_only=False)
            for a in range(0, len(found), ROWS_OUT):
                yield batch.slice(a, ROWS_OUT).filter(pa.array(found[a : a + ROWS_OUT]))
            pa.default_memory_pool().release_unused()

    stored = write_table(rows.mapInArrow(run, rows.schema), "trusted")
    drop_paths(docs.sparkSession, uri)
    return stored


def fit(trusted: DataFrame, order: int = ORDER) -> Model:
    """Train on the trusted documents that are not held out."""
    return train(trusted.where(~held_out(F.col("doc_id"))), order)


def _by_language(values: dict[str | None, float], lang):
    """Column: the value of the row's language, else that of all languages (key null)."""
    own = {k: v for k, v in values.items() if k is not None}
    general = F.lit(values.get(None)).cast("double")
    if not own:
        return general
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.coalesce(lang, F.lit("und"))), general)


def _quantiles(rows: DataFrame, value, quantile: float) -> dict[str | None, float]:
    """Quantile of each language and, under null, of all; a few numbers a language, pre-aggregated as sketches."""
    sketch = F.percentile_approx(value, quantile, 10_000).alias("q")
    out = {r.k: r.q for r in rows.groupBy(F.coalesce("row.lang", F.lit("und")).alias("k")).agg(sketch).collect()}
    return out | {None: rows.agg(sketch).first().q}


@dataclass
class Limits:
    """Per language, and under null for all: the median log perplexity and the threshold of the shrunk one."""

    centre: dict[str | None, float]
    limit: dict[str | None, float]

    def statistic(self):
        """Shrunk log perplexity of a row of ``score``."""
        return (F.col("log_ppl") * F.col("chars") + PSEUDO * _by_language(self.centre, F.col("row.lang"))) / (F.col("chars") + PSEUDO)

    def threshold(self):
        return _by_language(self.limit, F.col("row.lang"))

    def keep(self):
        return F.coalesce(self.statistic() <= self.threshold(), F.lit(True))


def limits(trusted: DataFrame, model: Model, quantile: float = QUANTILE, margin: float = MARGIN) -> Limits:
    """Thresholds from the trusted documents that are held out."""
    scored = write_table(score(trusted.where(held_out(F.col("doc_id"))), model, ["lang"]), "perplexity")
    found = Limits(_quantiles(scored, F.col("log_ppl"), 0.5), {})
    found.limit = {k: None if v is None else v + margin for k, v in _quantiles(scored, found.statistic(), quantile).items()}
    drop_tables(scored)
    return found


def _fitted(docs: DataFrame, labels: DataFrame) -> tuple[Model, Limits]:
    trusted = trusted_texts(docs, labels)
    model = fit(trusted)
    found = limits(trusted, model)
    drop_tables(trusted)
    return model, found


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id``, ``lang``, ``perplexity`` (a symbol), ``shrunk`` perplexity, ``threshold``, ``keep``.

    Null and empty texts are the end symbol alone and judged like any text. A
    null language counts as ``und``; a language without trusted held-out text
    takes the threshold of all such text; without any, every row is kept.
    Repeated rows are judged alike; extra columns are ignored.
    """
    model, found = _fitted(docs, labels)
    return score(docs.select("doc_id", "lang", "text"), model, ["doc_id", "lang"]).select(
        "row.doc_id", "row.lang", F.exp("log_ppl").alias("perplexity"), F.exp(found.statistic()).alias("shrunk"), F.exp(found.threshold()).alias("threshold"), found.keep().alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, by the rules of ``judge``; columns unchanged, whatever their names.

    Null, empty and repeated rows are judged like any other; texts pass through
    once, as the thresholds come from the trusted documents alone.
    """
    model, found = _fitted(docs, labels)
    return score(docs, model).where(found.keep()).select("row.*")
