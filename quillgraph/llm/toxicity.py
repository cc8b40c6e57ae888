"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Each word enters as a word vector (hashed word) and a character vector (mean of
its hashed letter trigrams). A gated recurrent unit reads a window of words in
both directions, attention pools the states, and a logistic unit scores the
window. A text's score is that of its worst window; windows overlap by half and
cover every word. Labels say which documents are toxic, not where, so training
alternates between finding each document's worst window and fitting on it.

The network is trained in numpy on the driver, on at most ``per_class``
labelled documents of each class (those with the smallest hash of ``doc_id``);
its size is fixed. Scoring is one Arrow pass over all documents.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample

WORDS = 1 << 15
GRAMS = 1 << 15
WIDTH = 6
HIDDEN = 8
ATTEND = 8
WINDOW, STRIDE = 32, 16
PER_CLASS = 3000
MAX_CHARS = 16_000_000
THRESHOLD = 0.3
CHUNK = 60_000  # words scored at once

_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id):
    """Column: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def tokenize(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Lexicon:
    """Words to rows of hashed features; the memo is bounded."""

    def __init__(self, memo: int = 150_000):
        self.memo: dict[str, int] = {}
        self.limit = memo
        self.clear()

    def clear(self) -> None:
        self.memo.clear()
        self.word = array("q")
        self.grams: list[list[int]] = []

    def rows(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = memo.get(w)
            if k is None:
                k = memo[w] = len(self.word)
                raw = f"<{w}>"
                self.word.append(zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS)
                self.grams.append([zlib.crc32(raw[j : j + 3].encode("utf-8", "surrogatepass")) % GRAMS for j in range(len(raw) - 2)])
            out[i] = k
        return out

    def gram_means(self, table: np.ndarray, first: int = 0) -> np.ndarray:
        sizes = np.array([len(g) for g in self.grams[first:]], np.int64)
        flat = np.fromiter((x for g in self.grams[first:] for x in g), np.int64, int(sizes.sum()))
        sums = np.add.reduceat(table[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) if len(flat) else np.zeros((0, table.shape[1]), table.dtype)
        return sums / sizes[:, None]


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover ``n`` words."""
    return np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE)[: 1 + -(-max(n - WINDOW, 0) // STRIDE)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Parameters by name, float32, and the forward and backward passes."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float = 0.0

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        rng, d, h = np.random.default_rng(seed), 2 * WIDTH, HIDDEN
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"word": draw(WORDS, WIDTH) * 5, "gram": draw(GRAMS, WIDTH) * 5}
        for side in ("f", "b"):
            p |= {f"W{side}": draw(d, 3 * h), f"U{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        p |= {"Wa": draw(2 * h, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": draw(ATTEND), "wo": draw(2 * h) / 2, "bo": np.zeros(1, np.float32)}
        return Network(p)

    def _read(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """States (T, B, H) of one direction; ``x`` (T, B, 3H) holds the projected inputs."""
        steps, b = x.shape[:2]
        h, hs, kept, U, n = np.zeros((b, HIDDEN), np.float32), np.empty((steps, b, HIDDEN), np.float32), [], self.p[f"U{side}"], HIDDEN
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = h @ U
            gates = _sigmoid(x[t, :, : 2 * n] + a[:, : 2 * n])
            r, z = gates[:, :n], gates[:, n:]
            c = np.tanh(x[t, :, 2 * n :] + r * a[:, 2 * n :])
            new = h + mask[t][:, None] * (1 - z) * (c - h)
            if keep:
                kept.append((t, h, r, z, c, a[:, 2 * n :]))
            h = new
            hs[t] = h
        return hs, kept

    def forward(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Window logits (B,), from projected inputs (T, B, 3H) and the mask (T, B)."""
        hf, kf = self._read(xf, mask, "f", keep)
        hb, kb = self._read(xb, mask, "b", keep)
        states = np.concatenate((hf, hb), axis=2)
        s = np.tanh(states @ self.p["Wa"] + self.p["ba"])
        e = np.where(mask > 0, s @ self.p["va"], -1e9)
        e = np.exp(e - e.max(axis=0))
        e *= mask
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = (alpha[:, :, None] * states).sum(axis=0)
        logits = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logits, (states, s, alpha, pooled, kf, kb)) if keep else logits

    def gradients(self, rows: np.ndarray, mask: np.ndarray, y: np.ndarray, lex: Lexicon, gram_mean: np.ndarray, weight: np.ndarray):
        """Gradients of the mean log loss on windows (T, B) of lexicon rows."""
        p, n = self.p, HIDDEN
        word = np.array(lex.word)[rows]
        x = np.concatenate((p["word"][word], gram_mean[rows]), axis=2)
        logits, (states, s, alpha, pooled, kf, kb) = self.forward(x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"], mask, True)
        dl = ((_sigmoid(logits) - y) * weight / len(y)).astype(np.float32)
        g = {"wo": pooled.T @ dl, "bo": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * p["wo"]
        dstates = alpha[:, :, None] * dpool
        dalpha = (states * dpool).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        ds = de[:, :, None] * p["va"] * (1 - s * s)
        g |= {"va": np.einsum("tb,tba->a", de, s), "Wa": np.einsum("tbh,tba->ha", states, ds), "ba": ds.sum(axis=(0, 1))}
        dstates = dstates + ds @ p["Wa"].T
        dx = np.zeros_like(x)
        for side, kept, part in (("f", kf, dstates[:, :, :n]), ("b", kb, dstates[:, :, n:])):
            U, W = p[f"U{side}"], p[f"W{side}"]
            dU, dh, dproj = np.zeros_like(U), np.zeros((x.shape[1], n), np.float32), np.zeros((*x.shape[:2], 3 * n), np.float32)
            for t, h, r, z, c, ac in reversed(kept):
                dh = dh + part[t]
                dnew = dh * mask[t][:, None]
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (h - c) * z * (1 - z)
                dr = dc * ac * r * (1 - r)
                dproj[t] = np.concatenate((dr, dz, dc), axis=1)
                da = np.concatenate((dr, dz, dc * r), axis=1)
                dU += h.T @ da
                dh = dh - dnew * (1 - z) + da @ U.T
            g |= {f"U{side}": dU, f"W{side}": np.einsum("tbd,tbk->dk", x, dproj), f"c{side}": dproj.sum(axis=(0, 1))}
            dx += dproj @ W.T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], word.ravel(), dx[:, :, :WIDTH].reshape(-1, WIDTH))
        used, where = np.unique(rows.ravel(), return_inverse=True)
        drow = np.zeros((len(used), WIDTH), np.float32)
        np.add.at(drow, where, dx[:, :, WIDTH:].reshape(-1, WIDTH))
        g["gram"] = np.zeros_like(p["gram"])
        sizes = np.array([len(lex.grams[k]) for k in used])
        np.add.at(g["gram"], np.concatenate([lex.grams[k] for k in used]).astype(np.int64), np.repeat(drow / sizes[:, None], sizes, axis=0))
        return g

    def document_logits(self, docs: list[np.ndarray], lex: Lexicon, gram_mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(worst logit, start of that window) of documents given as lexicon rows; wordless ones get -inf."""
        p = self.p
        best, start = np.full(len(docs), -np.inf), np.zeros(len(docs), np.int64)
        if not sum(map(len, docs)):
            return best, start
        used, inverse = np.unique(np.concatenate(docs), return_inverse=True)
        docs = np.split(inverse, np.cumsum([len(d) for d in docs])[:-1])
        x = np.concatenate((p["word"][np.frombuffer(lex.word, np.int64)[used]], gram_mean[used]), axis=1)
        proj = {side: (x @ p[f"W{side}"] + p[f"c{side}"]).astype(np.float32) for side in "fb"}
        for whose, starts, rows, mask in _batches(docs):
            logits = self.forward(proj["f"][rows], proj["b"][rows], mask)
            order = np.lexsort((starts, -logits, whose))
            first = order[np.unique(whose[order], return_index=True)[1]]
            better = logits[first] > best[whose[first]]
            best[whose[first][better]], start[whose[first][better]] = logits[first][better], starts[first][better]
        return best, start


def _cut(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = starts[None, :] + np.arange(WINDOW)[:, None]
    return rows[np.minimum(at, len(rows) - 1)], (at < len(rows)).astype(np.float32)


def _batches(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of many documents, at most about CHUNK words at once; one document may span several batches."""
    most = CHUNK // STRIDE
    whose, starts, parts, held = [], [], [], 0
    for i, rows in enumerate(docs):
        if not len(rows):
            continue
        every = windows(len(rows))
        for a in range(0, len(every), most):
            some = every[a : a + most]
            parts.append(_cut(rows, some))
            whose.append(np.full(len(some), i))
            starts.append(some)
            held += len(some)
            if held >= most:
                yield np.concatenate(whose), np.concatenate(starts), np.concatenate([x for x, _ in parts], axis=1), np.concatenate([m for _, m in parts], axis=1)
                whose, starts, parts, held = [], [], [], 0
    if held:
        yield np.concatenate(whose), np.concatenate(starts), np.concatenate([x for x, _ in parts], axis=1), np.concatenate([m for _, m in parts], axis=1)


def _log_odds(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Shrunken log odds of document frequencies (2, features)."""
    rate = (counts + 0.5) / (totals[:, None] + 1)
    return np.log(rate[1] / rate[0]) * (counts.sum(axis=0) / (counts.sum(axis=0) + 2))


def train(texts: list[str | None], labels: list[int], prior: float, rounds: int = 4, epochs: int = 4, seed: int = 5) -> Network:
    """Fit a network on whole texts; one class alone leaves a network that only knows ``prior``."""
    net = Network.fresh()
    net.prior = prior
    lex = Lexicon(1 << 60)
    docs = [lex.rows(tokenize(t)) for t in texts]
    y_all = np.array(labels)
    some = [i for i, d in enumerate(docs) if len(d)]
    if len(set(y_all[some].tolist())) < 2:
        net.p = {}
        return net
    word_of = np.array(lex.word)
    counts_w, counts_g = np.zeros((2, WORDS)), np.zeros((2, GRAMS))
    for i in some:
        rows = np.unique(docs[i])
        counts_w[y_all[i], np.unique(word_of[rows])] += 1
        counts_g[y_all[i], np.unique(np.concatenate([lex.grams[k] for k in rows]))] += 1
    totals = np.bincount(y_all[some], minlength=2)
    odds_w, odds_g = _log_odds(counts_w, totals), _log_odds(counts_g, totals)
    net.p["word"][:, 0], net.p["gram"][:, 0] = odds_w / 2, odds_g / 2
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    hint = odds_w[word_of]
    for turn in range(rounds):
        gram_mean = lex.gram_means(net.p["gram"])
        if turn == 0:  # before anything is learned, the window with the most telling words
            start = np.zeros(len(docs), np.int64)
            for i in some:
                every = windows(len(docs[i]))
                rows, mask = _cut(docs[i], every)
                start[i] = every[int((np.maximum(hint[rows], 0) * mask).sum(axis=0).argmax())]
        else:
            _, start = net.document_logits(docs, lex, gram_mean)
        chosen = [(i, start[i]) for i in some]
        chosen += [(i, int(rng.choice(windows(len(docs[i]))))) for i in some if not y_all[i]]
        for _ in range(epochs):
            order = rng.permutation(len(chosen))
            for a in range(0, len(order), 128):
                batch = [chosen[k] for k in order[a : a + 128]]
                cut = [_cut(docs[i], np.array([s])) for i, s in batch]
                rows, mask = np.concatenate([x for x, _ in cut], axis=1), np.concatenate([m for _, m in cut], axis=1)
                y = np.array([y_all[i] for i, _ in batch], np.float32)
                used = np.unique(rows)
                fresh = np.zeros((len(word_of), WIDTH), np.float32)
                sizes = np.array([len(lex.grams[k]) for k in used])
                flat = np.concatenate([lex.grams[k] for k in used]).astype(np.int64)
                fresh[used] = np.add.reduceat(net.p["gram"][flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None]
                step += 1
                for k, g in net.gradients(rows, mask, y, lex, fresh, np.ones(len(y), np.float32)).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    rate = 0.01 if step < 200 else 0.005
                    net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def sample_and_train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Network:
    """Train on at most ``per_class`` labelled rows and ``max_chars`` characters a class, none of them held out.

    Rows are taken by the smallest hash of ``doc_id``, so the choice depends on
    nothing else. An id with both labels counts as toxic. Only the chosen texts
    come to the driver.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    rows = bounded_sample(docs.select("doc_id", "text").join(usable, "doc_id"), "y", per_class, max_chars)
    if not rows:
        return Network({}, 0.0)
    totals = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = totals.get(1, 0) / sum(totals.values())
    rows.sort(key=lambda r: r.doc_id)
    return train([r.text for r in rows], [r.y for r in rows], prior)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score``, ``predicted``, ``worst_word`` (start of the worst window).

    Null, empty and wordless texts get the training share of toxic rows, at
    most 0.29, and no window. Repeated rows score alike. Extra columns are
    ignored; with no labels, or one class, every text is treated as wordless.
    """
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, lex, means = shared.value, Lexicon(), None
        base = min(net.prior, 0.29)
        for batch in batches:
            texts = batch.column(2)
            scores, worst = np.full(len(texts), base), np.full(len(texts), -1)
            at = 0
            while at < len(texts) and net.p:
                if len(lex.memo) > lex.limit:
                    lex.clear()
                    means = None
                docs_, words, first = [], 0, at
                while at < len(texts) and words < CHUNK:
                    docs_.append(lex.rows(tokenize(texts[at].as_py())))
                    words += len(docs_[-1])
                    at += 1
                done = 0 if means is None else len(means)
                if len(lex.word) > done:
                    fresh = lex.gram_means(net.p["gram"], done)
                    means = fresh if means is None else np.concatenate((means, fresh))
                if words:
                    logits, starts = net.document_logits(docs_, lex, means)
                    seen = np.isfinite(logits)
                    scores[first:at][seen], worst[first:at][seen] = _sigmoid(logits[seen]), starts[seen]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores.astype(np.float64)), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(worst.astype(np.int64))], ["doc_id", "held_out", "score", "predicted", "worst_word"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, worst_word long")
