"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability in a language is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words (runs
of letters, lower-cased, with the word-start mark in front). Piece
probabilities are fitted by expectation-maximisation, which also sums over all
segmentations, on at most ``per_lang`` documents of each language.

The forward pass runs over the distinct words of a batch at once: one step per
character, all words and languages in numpy. A run of letters longer than
``LONGEST`` is scored in parts of that length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample
from .toxicity import held_out

VOCABULARY = "piece_bpe_32k.model"
LONGEST = 64
PER_LANG, MAX_CHARS = 1500, 8_000_000
CHUNK = 250_000  # words scored at once
CELLS = 100_000  # words times languages in one lattice
SCALE = 12.0  # per character, so that products of probabilities stay in range
UNKNOWN = 1e-7
MARK = "▁"

_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased, long ones in parts.

    Letters are what ``str.isalpha`` says: digits, fractions, superscripts and
    letter-like numbers such as Roman numeral signs are none. Combining marks
    are none either and part the letters around them.
    """
    found = _WORD.findall(text.lower()) if text else []
    if not all(map(str.isalpha, found)):
        found = [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


class Pieces:
    """The vocabulary as a hash table over code point sequences; ids by lookup of many substrings at once."""

    BITS = 20

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.hashes = np.array([self._hash(p) for p in pieces] + [0], np.uint64)
        self.unknown = len(pieces)
        self.levels = []
        left = np.arange(len(pieces))
        while len(left):
            shift = np.uint64(64 - self.BITS - 7 * (len(self.levels) % 6))
            table = np.full(1 << self.BITS, self.unknown, np.int32)
            slot = ((self.hashes[left] >> shift) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)
            table[slot] = left
            self.levels.append((shift, table))
            left = left[table[slot] != left]

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for ch in piece:
            h = ((h ^ (ord(ch) + 1)) * int(_BASE)) & (2**64 - 1)
        return h ^ h >> 29

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of rolling hash states; ``unknown`` where no piece matches."""
        h = h ^ (h >> np.uint64(29))
        out = None
        for shift, table in self.levels:
            got = table[((h >> shift) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)]
            got = np.where(self.hashes[got] == h, got, self.unknown)
            out = got if out is None else np.where(out == self.unknown, got, out)
        return out


@dataclass
class Lattice:
    """Arcs of the distinct words: per (end, length) the words' piece ids. Words are sorted, longest first."""

    lengths: np.ndarray
    arcs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]  # (end, length) -> (word rows, piece ids)
    order: np.ndarray


def lattice(words: list[str], pieces: Pieces) -> Lattice:
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    width = int(lengths[0]) if len(words) else 0
    joined = "".join(MARK + words[i] for i in order)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    grid = np.zeros((width, len(words)), np.uint64)
    starts = np.cumsum(lengths) - lengths
    active = np.searchsorted(-lengths, -np.arange(1, width + 1), side="right")  # words at least this long
    for j in range(width):
        grid[j, : active[j]] = codes[starts[: active[j]] + j]
    arcs = {}
    for i in range(width):
        h = np.zeros(active[i], np.uint64)
        for k in range(1, min(pieces.longest, width - i) + 1):
            n = int(active[i + k - 1])
            h = (h[:n] ^ (grid[i + k - 1, :n] + np.uint64(1))) * _BASE
            ids = pieces.find(h)
            if k == 1:
                arcs[i + 1, 1] = (np.arange(n), ids)
            else:
                rows = np.flatnonzero(ids != pieces.unknown)
                if len(rows):
                    arcs[i + k, k] = (rows, ids[rows])
    return Lattice(lengths, arcs, order)


def forward(lat: Lattice, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probability (words, languages) in the caller's order, all forward values)."""
    n, langs = len(lat.lengths), p.shape[1]
    width = int(lat.lengths[0]) if n else 0
    alpha = np.zeros((width + 1, n, langs))
    alpha[0] = 1
    for (end, k), (rows, ids) in sorted(lat.arcs.items(), key=lambda x: x[0]):
        add = alpha[end - k, rows] * p[ids] * SCALE**k
        if len(rows) and rows[-1] == len(rows) - 1:
            alpha[end, : len(rows)] += add
        else:
            alpha[end, rows] += add
    last = np.maximum(alpha[lat.lengths, np.arange(n)], 1e-300)
    out = np.empty((n, langs))
    out[lat.order] = np.log(last) - lat.lengths[:, None] * np.log(SCALE)
    return out, alpha


def expected_counts(lat: Lattice, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces + unknown, languages); ``weights`` (words, languages) in the caller's order."""
    n, langs = len(lat.lengths), p.shape[1]
    _, alpha = forward(lat, p)
    beta = np.zeros_like(alpha)
    beta[lat.lengths, np.arange(n)] = 1
    total = np.maximum(alpha[lat.lengths, np.arange(n)], 1e-300)
    share = weights[lat.order] / total
    out = np.zeros_like(p)
    for (end, k), (rows, ids) in sorted(lat.arcs.items(), key=lambda x: -x[0][0]):
        through = p[ids] * SCALE**k * beta[end, rows]
        beta[end - k, rows] += through
        got = alpha[end - k, rows] * through * share[rows]
        for c in range(langs):
            out[:, c] += np.bincount(ids, got[:, c], len(p))
    return out


@dataclass
class Model:
    langs: list[str]
    p: np.ndarray  # (pieces + unknown, languages)
    path: str


_loaded: dict[str, Pieces] = {}


def load_pieces(path: str) -> Pieces:
    """The vocabulary's ordinary pieces (control and byte pieces aside), loaded once a worker."""
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded[path] = Pieces([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))])
    return _loaded[path]


def fit(texts: list[str | None], langs: list[str], path: str, rounds: int = 4, add: float = 0.02) -> Model:
    """Piece probabilities of each language by expectation-maximisation from a uniform start."""
    pieces, names = load_pieces(path), sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    counts: dict[str, list[float]] = {}
    per_lang = [Counter() for _ in names]
    for text, lang in zip(texts, langs, strict=True):
        per_lang[place[lang]].update(words_of(text))
    for c, words in enumerate(per_lang):
        for w, n in words.items():
            counts.setdefault(w, [0.0] * len(names))[c] = n
    words = sorted(counts)
    p = np.full((len(pieces.pieces) + 1, len(names)), 1 / len(pieces.pieces))
    p[-1] = UNKNOWN
    weights = np.array([counts[w] for w in words]).reshape(-1, len(names))
    for _ in range(rounds if words else 0):
        total = np.zeros_like(p)
        step = max(500, CELLS // len(names))
        for a in range(0, len(words), step):
            total += expected_counts(lattice(words[a : a + step], pieces), p, weights[a : a + step])
        total[:-1] += add
        p = total / total[:-1].sum(axis=0)
        p[-1] = UNKNOWN
    return Model(names, p, path)


def sample_and_fit(docs: DataFrame, path: str | None = None, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS) -> Model:
    """Fit on at most ``per_lang`` rows and ``max_chars`` characters of each language, none held out, taken by the smallest hash of ``doc_id``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = bounded_sample(usable.select("doc_id", "lang", "text"), "lang", per_lang, max_chars)
    if not rows:
        return Model([], np.zeros((1, 0)), path)
    rows.sort(key=lambda r: (r.lang, r.doc_id))
    return fit([r.text for r in rows], [r.lang for r in rows], path)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (posterior under equal priors).

    Null, empty and letterless texts, and all texts if nothing was learned, get
    ``und`` with score 0. Ties go to the first language by name. Extra columns,
    ``lang`` and ``source`` included, play no part.
    """
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pieces = load_pieces(m.path)
        for batch in batches:
            texts, at = batch.column(2), 0
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            while at < len(texts) and m.langs:
                memo: dict[str, int] = {}
                first, rows, sizes = at, [], []
                while at < len(texts) and len(rows) < CHUNK:
                    found = words_of(texts[at].as_py())
                    rows += [memo.setdefault(w, len(memo)) for w in found]
                    sizes.append(len(found))
                    at += 1
                if not rows:
                    continue
                words = list(memo)
                step = max(500, CELLS // len(m.langs))
                logs = np.concatenate([forward(lattice(words[a : a + step], pieces), m.p)[0] for a in range(0, len(words), step)])
                sizes_ = np.array(sizes)
                some = np.flatnonzero(sizes_)
                starts = (np.cumsum(sizes_) - sizes_)[some]
                totals = np.add.reduceat(logs[np.array(rows)], starts, axis=0)
                best = totals.argmax(axis=1)
                post = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, s in zip((first + some).tolist(), best.tolist(), post.tolist(), strict=True):
                    names[i], scores[i] = m.langs[b], s
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
