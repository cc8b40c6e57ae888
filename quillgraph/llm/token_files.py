"""Token ids in files of independent zstandard frames with a trailing seek table.

Layout of a file: document frames, then one index frame, then the seek table (a
skippable frame, so that plain zstd tools can still read the file).

* A document frame holds the little-endian ids of whole documents, two bytes an
  id (the vocabulary has fewer than 65,536), and carries zstd's own checksum.
* The index frame holds, for the documents in order, int64 doc ids, uint32
  token counts and uint32 frame numbers.
* The seek table has one entry a frame (compressed size, size, low half of the
  XXH64 of the content), then the frame count, a flag byte and a magic number,
  so that a reader finds everything from the file's end and decompresses only
  the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, new_path, write_table
from .tokens import encoder, vocabulary_path

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

END_ID = 1
FRAME_BYTES = 1 << 18
NO_ID = -(1 << 63)  # stands for a missing doc_id; nulls come first in the order, as this value does


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFileWriter:
    """Writes documents in the order given; holds one frame in memory, and 16 bytes a document for the index."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.ids, self.counts, self.frames, self.entries = [], [], [], []
        self.held, self.held_bytes, self.tokens = [], 0, 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError("an id needs more than two bytes")
        data = ids.astype("<u2").tobytes()
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.frames.append(len(self.entries))
        self.held.append(data)
        self.held_bytes += len(data)
        self.tokens += len(ids)
        if self.held_bytes >= self.frame_bytes:
            self._flush()

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), _checksum(data)))

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes() + np.array(self.frames, "<u4").tobytes())
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class TokenFileReader:
    """Reads chosen documents of a file (any seekable binary file object)."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - 9)
        count, flag, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end")
        file.seek(size - 9 - 12 * count)
        self.entries = np.frombuffer(file.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.entries[:, 0])))
        index = self.frame(count - 1)
        n = len(index) // 16
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.counts = np.frombuffer(index, "<u4", n, 8 * n).astype(np.int64)
        self.frames = np.frombuffer(index, "<u4", n, 12 * n)

    def frame(self, k: int) -> bytes:
        """A frame's content, checked against the seek table."""
        import zstandard

        self.file.seek(int(self.starts[k]))
        packed, size, check = (int(x) for x in self.entries[k])
        data = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
        if len(data) != size or _checksum(data) != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in file order, one frame in memory at a time."""
        bounds = np.flatnonzero(np.diff(self.frames, prepend=-1)).tolist() + [len(self.frames)]
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            data, at = self.frame(int(self.frames[first])), 0
            for i in range(first, last):
                n = int(self.counts[i])
                yield int(self.doc_ids[i]), np.frombuffer(data, "<u2", n, at).astype(np.uint32)
                at += 2 * n

    def read(self, doc_id: int) -> list[np.ndarray]:
        """The id arrays of every document with this id; decompresses only their frames."""
        out = []
        for i in np.flatnonzero(self.doc_ids == doc_id):
            first = int(np.searchsorted(self.frames, self.frames[i]))
            at = 2 * int(self.counts[first:i].sum())
            out.append(np.frombuffer(self.frame(int(self.frames[i])), "<u2", int(self.counts[i]), at).astype(np.uint32))
        return out


def write_token_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encode and write all texts in ascending ``doc_id`` order; returns the manifest.

    Manifest: ``part`` (the files' order), ``path``, ``n_docs``, ``n_tokens``.
    Each task streams its range of documents into a file of a fresh name, and
    only committed tasks enter the manifest, so that retries do no harm. Null
    texts are empty; rows without ``doc_id`` come first. Rows that repeat a ``doc_id`` follow one another, ordered by text.
    """
    import pyarrow as pa

    vocabulary = vocabulary or vocabulary_path()
    folder = folder or new_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, writer = encoder(vocabulary), np.array([end_id], np.uint32), None
        fs, root = filesystem(folder)
        path = f"{root}/{uuid.uuid4().hex}.zst"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                    writer = TokenFileWriter(out)
                writer.add(NO_ID if doc_id is None else doc_id, np.concatenate((enc.encode(text or ""), end)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [path], "n_docs": [len(writer.ids)], "n_tokens": [writer.tokens]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(run, "part int, path string, n_docs long, n_tokens long")
    return write_table(manifest.withColumn("folder", F.lit(folder)), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the stored files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    The driver sees one manifest row a file (its place and token count), never documents.
    """
    import pyarrow as pa

    spark, rows, at = manifest.sparkSession, [], 0
    for r in manifest.orderBy("part").collect():
        rows.append((r.folder, r.path, at))
        at += r.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, path, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, _ = filesystem(folder)
                with fs.open_input_file(path) as file:
                    ids, starts, counts, crcs = [], [], [], []
                    for doc_id, tokens in TokenFileReader(file).documents():
                        ids.append(None if doc_id == NO_ID else doc_id)
                        starts.append(start)
                        counts.append(len(tokens))
                        crcs.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                        start += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, starts, counts, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "folder string, path string, start long").repartition(max(1, len(rows)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
