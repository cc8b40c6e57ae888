"""SimHash near-duplicates through pivot distance tables.

A text's fingerprint is the bitwise majority of the XXH64 values (seed 42) of
its word shingles. Two fingerprints link when at most ``max_bits`` bits differ;
groups are the connected components of the links.

Candidates come from a table of Hamming distances to reference fingerprints
(pivots). The 64 bits are cut into blocks. Pivot j is the concatenation of one
short reference per block, so its distance to a fingerprint is the sum of the
per-block distances, and the table keeps both. In every block the references
form a resolving set (distinct block values have distinct distance vectors).
Two fingerprints within ``max_bits`` can differ in at most ``max_bits`` blocks,
so their coordinates agree on all the others: each choice of those blocks is an
equi-join key. Within a key, pairs whose largest difference over ``PIVOTS``
distances exceeds ``max_bits`` are discarded (triangle inequality; of unrelated
pairs about one in ten thousand is left), survivors are verified.
Nothing is approximate and no bucket is capped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import write_table

BITS = 64
PIVOTS = 16
SEED = 42
SPLIT = r"[\x20\x09-\x0D]+"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def shingle_bytes(text: str | None, words: int = 4) -> list[bytes]:
    """The word shingles of a whole text, repeats included; fewer words make one, none make none."""
    if not text:
        return []
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_BLANKS).split()
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[words - 1 :].tolist()
    return [joined[a:b] for a, b in zip(starts[: len(ends)].tolist(), ends, strict=True)]


def majority(shingles: list[bytes], seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is in over half the hashes; no shingles give 0."""
    import xxhash

    n, digest = len(shingles), xxhash.xxh64_intdigest
    if not n:
        return 0
    hashes = np.array([digest(s, seed) for s in shingles], dtype=">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, words: int = 4, seed: int = SEED) -> int:
    """Fingerprint of a whole text; null and wordless texts give 0."""
    return majority(shingle_bytes(text, words), seed)


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp``, the fingerprint's bits as a signed long, of every row."""
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["k", "fp"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", key)


def resolving_references(width: int, seed: int = 7) -> list[int]:
    """References whose distances tell all ``width``-bit values apart, drawn greedily from a seeded stream."""
    values = np.arange(1 << width, dtype=np.uint32)
    rng, codes, chosen = np.random.default_rng(seed), np.zeros(1 << width, dtype=np.int64), []
    while len(np.unique(codes)) < len(values):
        tries = rng.integers(0, 1 << width, size=16, dtype=np.uint32)
        spread = [len(np.unique(codes * 16 + np.bitwise_count(values ^ t))) for t in tries]
        best = int(tries[int(np.argmax(spread))])
        chosen.append(best)
        codes = np.unique(codes * 16 + np.bitwise_count(values ^ np.uint32(best)), return_inverse=True)[1].astype(np.int64)
    return chosen


def block_count(rows: int, max_bits: int = 4, chance: float = 1) -> int:
    """Blocks for which chance meetings in all keys stay below about ``chance`` per fingerprint; any number is exact.

    More blocks mean longer keys and fewer meetings, but more keys.
    """
    for m in range(max_bits + 2, max_bits + 9):
        key_bits = BITS * (m - max_bits) // m
        if math.comb(m, max_bits) * rows / 2 / 2**key_bits <= chance:
            return m
    return max_bits + 8


class PivotTable:
    """Block layout, pivots and the column expressions of the distance table."""

    def __init__(self, blocks: int, max_bits: int = 4, pivots: int = PIVOTS):
        self.max_bits = max_bits
        cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
        self.blocks = [(a, b - a) for a, b in itertools.pairwise(cuts)]
        resolving = {w: resolving_references(w) for w in {w for _, w in self.blocks}}
        self.resolving = max(map(len, resolving.values()))
        self.pivots = max(pivots, self.resolving)
        rng = np.random.default_rng(11)
        more = rng.integers(0, 1 << 32, size=(blocks, self.pivots), dtype=np.uint64).tolist()
        self.refs = [[*resolving[w], *[x % (1 << w) for x in extra]][: self.pivots] for (_, w), extra in zip(self.blocks, more, strict=True)]

    def _distance(self, fp, block: int, j: int):
        shift, width = self.blocks[block]
        part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        return F.bit_count(part.bitwiseXOR(F.lit(self.refs[block][j]).cast("long")))

    def block_coordinates(self, fp):
        """Array of longs: per block its distances to the block's references, four bits each."""
        out = []
        for b in range(len(self.blocks)):
            packed = F.lit(0).cast("long")
            for j in range(self.resolving):
                packed = packed.bitwiseOR(F.shiftleft(self._distance(fp, b, j).cast("long"), 4 * j))
            out.append(packed)
        return F.array(*out)

    def coordinates(self, fp):
        """Array of longs with the distances to all pivots, eight bits each; a pivot is one number, its distance one popcount."""
        words = []
        for first in range(0, self.pivots, 8):
            packed = F.lit(0).cast("long")
            for j in range(first, min(first + 8, self.pivots)):
                distance = F.bit_count(fp.bitwiseXOR(F.lit(self.pivot(j)).cast("long")))
                packed = packed.bitwiseOR(F.shiftleft(distance.cast("long"), 8 * (j - first)))
            words.append(packed)
        return F.array(*words)

    def pivot(self, j: int) -> int:
        """Pivot ``j`` as a signed long: its references of all blocks side by side."""
        x = sum(refs[j] << shift for refs, (shift, _) in zip(self.refs, self.blocks, strict=True))
        return x - (1 << BITS) if x >> (BITS - 1) else x

    def within(self, x, y, reach: int | None = None):
        """Whether no coordinate of two packed rows differs by more than ``reach`` (``max_bits`` if not given)."""
        at = lambda c, j: F.shiftrightunsigned(F.get(c, F.lit(j // 8)), 8 * (j % 8)).bitwiseAND(F.lit(0xFF).cast("long"))
        out = F.lit(True)
        for j in range(self.pivots):
            out = out & (F.abs(at(x, j) - at(y, j)) <= (self.max_bits if reach is None else reach))
        return out

    def keys(self, coords):
        """Array of one hash for each choice of blocks that must agree."""
        return F.array(*[F.xxhash64(F.lit(i), *[coords[b] for b in kept]) for i, kept in enumerate(itertools.combinations(range(len(self.blocks)), len(self.blocks) - self.max_bits))])


def links(nodes: DataFrame, max_bits: int = 4, blocks: int | None = None, chance: float = 1) -> DataFrame:
    """Distinct linked pairs ``a`` < ``b`` of the distinct fingerprints ``fp`` of ``nodes``.

    The planner does not see that ``explode`` multiplies rows and would take the
    keys for as small as ``nodes``; the hint keeps them out of the driver.
    """
    blocks = blocks or block_count(nodes.count(), max_bits, chance)
    table = PivotTable(blocks, max_bits)
    keyed = (
        nodes.select("fp")
        .withColumn("c", table.block_coordinates(F.col("fp")))
        .withColumn("d", table.coordinates(F.col("fp")))
        .select("fp", "d", F.explode(table.keys(F.col("c"))).alias("key"))
    )
    side = lambda x: keyed.select("key", F.col("fp").alias(x), F.col("d").alias(f"{x}_d"))
    pairs = side("a").join(side("b").hint("merge"), "key").where(F.col("a") < F.col("b")).where(table.within(F.col("a_d"), F.col("b_d")))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, key: str = "doc_id", text: str = "text", chance: float = 1) -> DataFrame:
    """One row per input row: ``key``, ``fingerprint`` (hex), ``component_id``, ``n_links``.

    ``component_id`` is the smallest ``key`` reachable over links, itself
    included; ``n_links`` counts other distinct fingerprints within ``max_bits``.
    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null key get a null component unless their fingerprint has a keyed
    row. Rows that repeat a key are one graph node. Extra columns are ignored.
    Joins of tables that grow with ``docs`` are hashed and sorted at every size:
    Parquet holds their rows in far less than a broadcast takes of the driver.
    """
    fps = write_table(fingerprints(docs, words, key, text), "simhash")
    nodes = write_table(fps.groupBy("fp").agg(F.min(key).alias("rep")), "simhash-nodes")
    found = write_table(links(nodes, max_bits, None, chance), "simhash-links")
    degree = found.select(F.col("a").alias("fp")).unionByName(found.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    node = lambda x, rep: nodes.select(F.col("fp").alias(x), F.col("rep").alias(rep)).hint("merge")
    edges = found.join(node("a", "u"), "a").join(node("b", "v"), "b").select("u", "v")
    shared_keys = fps.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    repeated = fps.join(shared_keys.select(key).hint("merge"), key, "left_semi").join(nodes.hint("merge"), "fp").select(F.col(key).alias("u"), F.col("rep").alias("v"))
    groups = connected_components(edges.unionByName(repeated))
    labelled = (
        nodes.join(groups.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
        .join(degree.hint("merge"), "fp", "left")
        .select("fp", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    return fps.join(labelled.hint("merge"), "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the rows that name their group, the one with the smallest ``doc_id``; ``found`` has ``doc_id`` and ``component_id``.

    Rows without a ``doc_id`` stay. Of rows that repeat a kept ``doc_id`` one stays.
    """
    kept = found.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n")).where("c = doc_id")
    kept = write_table(kept.select("doc_id", "n"), "simhash-kept")
    out = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    if kept.where("n > 1").limit(1).count():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        out = out.groupBy("doc_id").agg(F.min(row).alias("row")).select("row.*")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names).unionByName(docs.where("doc_id is null").select(*names))


def keep_one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near copies by fingerprint, as ``keep_first`` has them."""
    return keep_first(docs, near_duplicates(docs, **options).where("doc_id is not null"))
