"""Text bytes as WAV media columns, and spectral-peak pair fingerprints of them.

``store`` keeps a text's bytes, padded with zeros to a positive multiple of 64,
as 8-bit mono samples of a WAV file in a binary column. ``analyse`` reads such
files back with the wave module, takes a short-time Fourier transform, finds
each frame's strongest spectral peaks and pairs every peak with those of the
next frames. A fingerprint is an array of longs, time coded in the high bits:
frame << 32 | first bin << 20 | second bin << 8 | frames between.

Payloads of at most one frame, in which no peak has a later one, are cut into
short frames that reach over both ends; their codes carry ``SHORT``, as bins and
times of the two lengths do not compare.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
RATE = 8000
FRAME, HOP = 1024, 512
SHORT_FRAME, SHORT_HOP = 128, 32  # for payloads of at most FRAME bytes
SHORT = 0x80  # marks codes of short frames
PEAKS = 2
REACH = 2  # following frames whose peaks are paired
FLOOR = 1e-6
CHUNK = 4096  # frames transformed at once

_HANN = {n: np.hanning(n + 1)[:-1] for n in (FRAME, SHORT_FRAME)}


def payload(text: str | None) -> tuple[bytes, int]:
    """(padded bytes, length before padding)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        if file.getnchannels() != 1 or file.getsampwidth() != 1:
            raise ValueError("one channel of 8-bit samples is expected")
        return file.readframes(file.getnframes())


def frames_of(samples: bytes) -> np.ndarray:
    """Signal frames (frames, FRAME) in -1..1, the last one padded with silence; a view where possible."""
    signal = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    n = 1 + max(0, -(-(len(signal) - FRAME) // HOP))
    padded = np.zeros((n - 1) * HOP + FRAME)
    padded[: len(signal)] = signal
    return np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]


def short_frames_of(samples: bytes) -> np.ndarray:
    """Short frames (frames, SHORT_FRAME) of a payload without its mean, from the first to the last that holds a sample."""
    signal = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    lead = SHORT_FRAME - SHORT_HOP
    n = 1 + (lead + len(signal) - 1) // SHORT_HOP
    padded = np.zeros((n - 1) * SHORT_HOP + SHORT_FRAME)
    padded[lead : lead + len(signal)] = signal - signal.mean()
    return np.lib.stride_tricks.sliding_window_view(padded, SHORT_FRAME)[::SHORT_HOP]


def spectral_peaks(frames: np.ndarray) -> np.ndarray:
    """Bins (frames, PEAKS) of the strongest local maxima, strongest first; -1 where there are fewer.

    A peak exceeds its lower neighbour, is at least its upper one, and lies
    above the floor; of equal peaks the lower bin comes first.
    """
    centred = frames - frames.mean(axis=1, keepdims=True)
    power = np.round(np.abs(np.fft.rfft(centred * _HANN[frames.shape[1]], axis=1)), 6)
    inner = power[:, 1:-1]
    strength = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > FLOOR), inner, 0)
    out = np.full((len(frames), PEAKS), -1)
    rows = np.arange(len(frames))
    for k in range(PEAKS):
        best = strength.argmax(axis=1)
        found = strength[rows, best] > 0
        out[found, k] = best[found] + 1
        strength[rows, best] = 0
    return out


def peak_pairs(peaks: np.ndarray) -> np.ndarray:
    """Time-coded pair codes in order of frame, anchor peak, distance and second peak."""
    n, parts = len(peaks), []
    for gap in range(1, REACH + 1):
        for i in range(PEAKS):
            for j in range(PEAKS):
                first, second = peaks[: max(n - gap, 0), i], peaks[gap:, j]
                t = np.flatnonzero((first >= 0) & (second >= 0))
                parts.append(np.stack((t, np.full(len(t), i), np.full(len(t), gap), np.full(len(t), j), t << 32 | first[t] << 20 | second[t] << 8 | gap)))
    table = np.concatenate(parts, axis=1)
    return table[4, np.lexsort((table[3], table[2], table[1], table[0]))]


def fingerprint(samples: bytes) -> np.ndarray:
    if len(samples) <= FRAME:
        # without the zeros at the end, whose step outdoes a short text, unless nothing with a peak is left
        body = samples.rstrip(b"\0")
        found = peak_pairs(spectral_peaks(short_frames_of(body))) if body else peak_pairs(np.empty((0, PEAKS), np.int64))
        return (found if len(found) else peak_pairs(spectral_peaks(short_frames_of(samples)))) | SHORT
    frames = frames_of(samples)
    peaks = [spectral_peaks(frames[a : a + CHUNK]) for a in range(0, len(frames), CHUNK)]
    return peak_pairs(np.concatenate(peaks))


def store(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media`` (a WAV file) for every input row; null texts are empty."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [payload(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([to_wav(b) for b, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def analyse(media: DataFrame) -> DataFrame:
    """Digests and fingerprint of every stored file, from its bytes as read back.

    Columns: ``doc_id``, ``n_bytes``, ``payload_bytes``, ``payload_sha256``,
    ``tail_crc32``, ``media_bytes``, ``media_sha256``, ``fingerprint``. Silence
    has an empty fingerprint. Repeated rows are
    analysed each; equal files give equal values; extra columns are ignored.
    """
    import pyarrow as pa

    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(2):
                stored = file.as_py()
                samples = from_wav(stored)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), fingerprint(samples)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>")


def feature_string(fingerprint_column):
    """A fingerprint as comma-joined lowercase hex."""
    return F.array_join(F.transform(fingerprint_column, lambda x: F.lower(F.hex(x))), ",")
