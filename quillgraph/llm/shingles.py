"""Near copies by similarity of their word shingles: the verified form of SimHash near-dedup.

Two texts link when the Jaccard similarity of their shingle sets is at least
four fifths. Fingerprints alone can't tell: at that similarity they differ in
ten of 64 bits on average, which no block key reaches. So the SimHash links of
the pivot table come first, verified, and form groups; what they cannot reach
meets on prefixes, across those groups: with all sets sorted in one common order, two such sets of n and m
shingles have a shingle in common among their first n // 5 + 1 and m // 5 + 1.
Any order is exact; shingles that a sample shows to be common are put last, so
that prefixes hold rare ones. Of the pairs that meet, those are discarded that
size or position rules out, then those with a pivot distance or fingerprints
further apart than ``REACH`` (see ``REACH`` for the odds), and every other is
verified on the whole sets.

Only the components of the links are wanted, so the members of a prefix key are
first compared with one hub of that key each, the member in whose set the key
comes first: in a group of edited copies, whose own new shingles come before the
shared ones, that is the text nearest to the original. All pairs of a key are
compared only where its members still lie in different components; a pair
within one component cannot change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import drop_tables, small_batches, write_table
from .simhash import BITS, SEED, PivotTable, keep_first, links, shingle_bytes
from .tokens import drop_encoders

#: Fingerprints of two sets of ``LEAST`` or more shingles that are four fifths similar differ in 9.9 bits on average
#: and in more than 26 with a chance of about one in 10 million; closer pairs have smaller odds. Unrelated ones differ
#: in 32, so nine of ten such pairs are discarded. Smaller sets are not judged by fingerprint.
REACH, LEAST = 26, 64
BLOCKS = 6
SAMPLE = 16  # one document in so many is counted for the order
COMMON, MOST = 3, 200_000  # occurrences in the sample, shingles sent to the workers


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingle_bytes(text, words)], dtype=np.uint64))


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a whole set."""
    import xxhash

    x = xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def prefix(shingles: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """(The first n // 5 + 1 shingles, common ones last; how many of them are not common). None of an empty set."""
    last = np.zeros(len(shingles), bool)
    if len(common):
        last = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
    keep = len(shingles) // 5 + 1
    return np.concatenate((shingles[~last], shingles[last]))[:keep], min(keep, int((~last).sum()))


def common_shingles(docs: DataFrame, words: int = 5) -> np.ndarray:
    """Shingles that several documents of the sample hold, at most ``MOST``; this affects cost, never the result."""
    some = sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), words)
    counts = some.select(F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    return np.sort(np.array([r.x for r in counts.orderBy(F.desc("c"), "x").limit(MOST).select("x").collect()], np.int64).view(np.uint64))


def set_fingerprint(shingles: np.ndarray) -> int:
    """Signed SimHash of a set: the bitwise majority of its values, as ``simhash.majority`` has it."""
    if not len(shingles):
        return 0
    ones = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(len(shingles), 8), axis=1).sum(axis=0, dtype=np.int64)
    x = int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _per_text(docs: DataFrame, words: int, common: np.ndarray | None) -> DataFrame:
    """``doc_id``, ``node`` (hash of the set), ``n`` (its size), ``fp``, the set's prefix as ``keys`` and the number of its ``rare`` ones; all of the set if ``common`` is null."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        last = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingle_set(t.as_py(), words) for t in part.column(1)]
                keys = [(s, 0) if last is None else prefix(s, last) for s in found]
                columns = [
                    pa.array([set_id(s) for s in found], pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([0 if last is None else set_fingerprint(s) for s in found], pa.int64()),
                    pa.array([rare for _, rare in keys], pa.int32()),
                    pa.array([k.view(np.int64) for k, _ in keys], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "node", "n", "fp", "rare", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, n long, fp long, rare int, keys array<long>")


def sets(docs: DataFrame, words: int = 5) -> DataFrame:
    return _per_text(docs, words, None).select("doc_id", "node", "n", F.col("keys").alias("shingles"))


def _possible(x: str, y: str, table: PivotTable):
    """Whether the sets of two key rows can be similar enough: their sizes, the places of the key, pivot distances, fingerprints."""
    n, m, p, q = (F.col(f"{side}.{c}") for c in ("n", "p") for side in (x, y))
    fits = (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - p, m - q) >= 4 * (n + m))
    near = table.within(F.col(f"{x}.d"), F.col(f"{y}.d"), REACH) & (F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= REACH)
    return fits & ((F.least(n, m) < LEAST) | near)


def _pairs(x: DataFrame, y: DataFrame, more, table: PivotTable) -> DataFrame:
    """Distinct pairs ``u`` < ``v`` of different nodes that share a key, can be similar and fulfil ``more``."""
    met = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & more & _possible("x", "y", table))
    return met.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()


def _fingerprint_pairs(reps: DataFrame) -> DataFrame:
    """Distinct pairs ``u`` < ``v`` of nodes by SimHash: a node and the least one of its fingerprint, and such nodes of linked fingerprints.

    Of a fingerprint's links to smaller ones that to the smallest is taken, so
    that there is about a pair a node in a group of copies; prefixes reach the others.
    """
    nodes = write_table(reps.groupBy("fp").agg(F.min("node").alias("head")), "shingle-fingerprints")
    near = links(nodes).groupBy("b").agg(F.min("a").alias("a"))
    head = lambda x, to: nodes.select(F.col("fp").alias(x), F.col("head").alias(to)).hint("merge")
    linked = near.join(head("a", "u"), "a").join(head("b", "v"), "b").select("u", "v")
    same = reps.select("fp", F.col("node").alias("u")).join(head("fp", "v"), "fp").where("u <> v").select("u", "v")
    return linked.unionByName(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """The pairs ``u``, ``v`` whose whole sets are similar enough."""
    used = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    # Stored, so that its size is known before the join is planned: a short list is broadcast and no text moves.
    used = write_table(used.join(reps, "node").select(F.col("rep").alias("doc_id")), "shingle-used")
    known = write_table(sets(docs.join(used, "doc_id", "left_semi"), words).select("node", "shingles"), "shingle-sets")
    side = lambda x: known.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_s"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    similar = 9 * F.size(F.array_intersect("u_s", "v_s")) >= 4 * (F.size("u_s") + F.size("v_s"))
    out = write_table(both.where(similar).select("u", "v").distinct(), "shingle-links")
    drop_tables(used, known)
    return out


def _shared_keys(nodes: DataFrame) -> DataFrame:
    """``key``, ``node``, ``p`` (place of the key in the set) and ``hub`` (whether it comes first in this one) of the keys that several nodes hold.

    Rare keys, most of which one node alone holds, are dealt by key once. Common
    ones, which very many may hold, are pre-aggregated and joined back, so that
    a hot key is split like any skewed join.
    """
    each = nodes.select("node", "rare", F.posexplode("keys").alias("p", "key"))
    rank = F.shiftleft(F.least("p", F.lit((1 << 20) - 1)).cast("long"), 42).bitwiseOR(F.shiftrightunsigned(F.xxhash64("node"), 22))
    hub = (rank == F.col("least")).alias("hub")
    by = Window.partitionBy("key")
    rare = each.where("p < rare").select("key", "node", "p").withColumns({"least": F.min(rank).over(by), "lo": F.min("node").over(by), "hi": F.max("node").over(by)})
    common = each.where("p >= rare").select("key", "node", "p")
    least = common.groupBy("key").agg(F.min(rank).alias("least"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key", "least")
    columns = ["key", "node", "p", hub]
    return rare.where("lo <> hi").select(*columns).unionByName(common.join(least, "key").select(*columns))


def near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id`` and ``component_id`` (the smallest ``doc_id`` of the group) of every row with a ``doc_id``.

    Texts with equal sets are one node, those without words (null ones too) are
    another. Rows that repeat a ``doc_id`` belong to one group.
    """
    with small_batches(docs.sparkSession):
        return _near_copies(docs.where("doc_id is not null"), words)


def _near_copies(docs: DataFrame, words: int) -> DataFrame:
    table = PivotTable(BLOCKS)
    marked = write_table(_per_text(docs, words, common_shingles(docs, words)), "shingle-marks")
    reps = write_table(marked.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("fp").alias("fp")), "shingle-nodes")
    held = write_table(_shared_keys(marked.join(reps.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"], "left_semi")), "shingle-shared")
    repeated = marked.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("w")).where("u <> w").select("doc_id", "u")
    repeated = marked.join(repeated, "doc_id").select("u", F.col("node").alias("v"))
    near = write_table(_fingerprint_pairs(reps), "shingle-near")
    first = _verified(near, docs, reps, words)
    grouped = reps.join(connected_components(first.unionByName(repeated)), "node", "left").select("node", "n", "fp", F.coalesce("component", "node").alias("g"))
    sized = held.join(grouped, "node")
    small, held = held, write_table(sized.withColumn("d", table.coordinates(F.col("fp"))), "shingle-keys")
    drop_tables(small)

    spokes = write_table(_pairs(held, held.where("hub"), F.col("x.g") != F.col("y.g"), table).join(near, ["u", "v"], "left_anti"), "shingle-spokes")
    second = _verified(spokes, docs, reps, words)
    groups = connected_components(first.unionByName(second).unionByName(repeated))

    label = F.coalesce("component", "node").alias("g")
    rest = held.drop("hub", "g").join(groups, "node", "left").select("key", "node", "n", "p", "fp", "d", label)
    mixed = rest.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("key")
    rest = write_table(rest.join(mixed, "key", "left_semi"), "shingle-rest")
    across = (F.col("x.node") < F.col("y.node")) & (F.col("x.g") != F.col("y.g"))
    pairs = write_table(_pairs(rest, rest, across, table).join(spokes.unionByName(near), ["u", "v"], "left_anti"), "shingle-pairs")
    more = _verified(pairs, docs, reps, words)

    # What is still to be joined are groups, so the second search runs over their labels alone.
    of = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"{x}_g"))
    between = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_g", "u").alias("u"), F.coalesce("v_g", "v").alias("v"))
    wider = connected_components(between).withColumnRenamed("node", "g")
    named = reps.join(groups, "node", "left").select("node", "rep", label).join(wider, "g", "left").select("node", "rep", F.coalesce("component", "g").alias("g"))
    least = named.groupBy("g").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "g").select("node", "component_id")
    out = write_table(marked.select("doc_id", "node").join(named, "node").select("doc_id", "component_id"), "shingle-groups")
    drop_tables(marked, reps, held, near, first, spokes, second, rest, pairs, more)
    return out


def keep_one_of_each_similar(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest ``doc_id`` stays, and rows without one."""
    return keep_first(docs, near_copies(docs, words))
