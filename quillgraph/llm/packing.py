"""Sequence packing: shortest pack first over the length histogram.

Documents become pieces of at most ``size`` ids. The histogram of piece lengths
(at most ``size`` rows, a proven bound) is packed on the driver: lengths are
placed longest first, each into the shortest open pack it fits, for many equal
packs at once. The outcome is a list of slots (length, first rank, count, first
sequence, offset). Pieces get their rank among equal lengths from counts per
input partition, and find their slot by that rank.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import write_table
from .tokens import encoder, vocabulary_path

SIZE = 4096
END_ID = 2


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset) that hold every piece once.

    The shortest pack is the one with most room. Equal packs are runs of
    sequence numbers, so placing a length in part of a run only cuts that run.
    """
    slots, runs, sequences = [], [], 0  # runs: heap of (-room, first sequence, packs)
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if runs and -runs[0][0] >= length:
                room, first, packs = heapq.heappop(runs)
                room = -room
                n = min(left, packs)
                if packs > n:
                    heapq.heappush(runs, (-room, first + n, packs - n))
            else:
                room, first, n = size, sequences, left
                sequences += n
            slots.append((length, rank, n, first, size - room))
            if room > length:
                heapq.heappush(runs, (length - room, first, n))
            rank += n
            left -= n
    return slots


def cut(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``part``, ``nth`` (among the part's equal lengths)."""
    import pyarrow as pa

    vocabulary = vocabulary or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("start", "length", "ids_crc32", "doc_tokens", "part", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, part = encoder(vocabulary), np.array([end_id], np.uint32), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows, whose = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate((enc.encode(text or ""), end)).astype("<u4")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    rows.append((at, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, int(seen[len(piece)])))
                    whose.append(i)
                    seen[len(piece)] += 1
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``padded_length``.

    Null and empty texts are the end id alone. Each row of the input is packed,
    repeated rows and null ids included; an empty table gives no pieces.
    ``padded_length`` is ``size``, or the sequence's own length where that is a
    power of two. Extra columns are ignored.
    """
    import pyarrow as pa

    pieces = write_table(cut(docs, size, vocabulary, end_id), "pieces")
    counts = write_table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = np.array(pack_histogram(histogram, size), np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    runs = np.unique(np.concatenate(([0], slots[:, 3], slots[:, 3] + slots[:, 2])))  # between these, sequences are equally long
    change = np.zeros(len(runs), np.int64)
    np.add.at(change, np.searchsorted(runs, slots[:, 3]), slots[:, 0])
    np.add.at(change, np.searchsorted(runs, slots[:, 3] + slots[:, 2]), -slots[:, 0])
    run_length = np.cumsum(change)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            slot = np.searchsorted(code, length << 44 | rank, side="right") - 1
            sequence = slots[slot, 3] + rank - slots[slot, 1]
            total = run_length[np.searchsorted(runs, sequence, side="right") - 1]
            padded = np.where(total & (total - 1) == 0, total, size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, (sequence, slots[slot, 4], padded))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])

    return ranked.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long")
