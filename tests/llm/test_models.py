"""Trained operators: exact forms against brute force, and held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("quillgraph.llm.queries")

SCHEMA = "doc_id long, text string, lang string, source string, score double"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def corpus(spark):
    """Two made-up languages; every seventh text holds an insult; every ninth is noise of low quality."""
    rng = np.random.default_rng(2)
    parts = {"aa": ["ka", "lo", "mi", "ten", "sar"], "bb": ["zu", "ghe", "wox", "pli", "ord"]}
    docs, labels = [], []
    for i in range(420):
        lang = "aa" if i % 2 else "bb"
        words = ["".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(rng.integers(20, 120))]
        toxic, low = int(i % 7 == 0), int(i % 9 == 0)
        if toxic:
            words[int(rng.integers(len(words)))] = str(rng.choice(["idiotish", "scumlike"]))
        if low:
            words = [w.upper() + "%%#!" for w in words]
        docs.append((i, " ".join(words), lang, "s", 0.5))
        labels.append((i, 1 - low, toxic))
    docs += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "12 34 !!", "aa", None, None), (1003, "kalo " * 30000, "aa", None, None), (0, docs[0][1], "bb", "s", 0.5)]
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, {a: (b, c) for a, b, c in labels}


def test_gradients_match_differences():
    from quillgraph.llm.toxicity import Lexicon, Network, _cut

    lex = Lexicon()
    docs = [lex.rows(s.split()) for s in ("one two three four five", "two two six")]
    net = Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    cut = [_cut(d, np.array([0])) for d in docs]
    rows, mask = np.concatenate([x for x, _ in cut], 1), np.concatenate([m for _, m in cut], 1)
    y = np.array([1.0, 0.0])

    def loss():
        x = np.concatenate((net.p["word"][np.array(lex.word)[rows]], lex.gram_means(net.p["gram"])[rows]), axis=2)
        z = net.forward(x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"], mask)
        return np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z))))

    g = net.gradients(rows, mask, y, lex, lex.gram_means(net.p["gram"]), np.ones(2))
    for name, at in (("Wf", (0, 3)), ("Ub", (2, 5)), ("cf", (20,)), ("Wa", (1, 1)), ("va", (2,)), ("wo", (3,)), ("bo", (0,)), ("word", (lex.word[1], 2)), ("gram", (lex.grams[0][0], 1)), ("cb", (10,)), ("Uf", (1, 17))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-4
        up = loss()
        net.p[name][at] = keep - 1e-4
        down = loss()
        net.p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-5), name


def test_windows_cover_every_word():
    from quillgraph.llm.toxicity import WINDOW, windows

    for n in (1, 31, 32, 33, 48, 49, 200):
        starts = windows(n)
        assert set().union(*(range(s, s + WINDOW) for s in starts.tolist())) >= set(range(n)) and starts[0] == 0 and (len(starts) == 1 or starts[-1] < n)


def test_toxicity(spark, corpus):
    from quillgraph.llm.toxicity import sample_and_train, score

    docs, labels, rows, truth = corpus
    net = sample_and_train(docs, labels)
    got = {r.doc_id: r for r in score(docs, net).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id) for r in got.values())
    test = [i for i in truth if held(i)]
    assert np.mean([got[i].predicted == truth[i][1] for i in test]) > 0.9
    assert got[1000].score == got[1001].score < 0.3
    assert score(docs.limit(0), net).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert score(docs, sample_and_train(docs, none)).where("predicted = 1").count() == 0


def test_language(spark, corpus):
    from quillgraph.llm.language import MARK, forward, lattice, load_pieces, predict, sample_and_fit

    docs, _, rows, _ = corpus
    model = sample_and_fit(docs)
    pieces = load_pieces(model.path)
    ids = {p: i for i, p in enumerate(pieces.pieces)}
    words = ["kalo", "zughe", "x", "été", "漢字"]
    logs = forward(lattice(words, pieces), model.p)[0]
    for w, row in zip(words, logs, strict=True):
        s = MARK + w
        for c in range(len(model.langs)):
            a = [1.0] + [0.0] * len(s)
            for j in range(1, len(s) + 1):
                for i in range(j):
                    k = ids.get(s[i:j], -1 if j - i == 1 else None)
                    if k is not None:
                        a[j] += a[i] * model.p[k, c]
            assert row[c] == pytest.approx(math.log(a[-1]))
    got = {r.doc_id: r for r in predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows if i < 420)
    assert {(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)} == {("und", 0.0)}
    assert got[1003].lang_pred == "aa"
    assert {r.lang_pred for r in predict(docs, sample_and_fit(docs.limit(0))).collect()} == {"und"}


def brute_kneser_ney(texts, order):
    """(probability of a symbol after a history, by the definition; counts by order)."""
    from quillgraph.llm.quality import END, SYMBOLS, symbols

    grams = Counter()
    for t in texts:
        s = [0] * (order - 1) + symbols(t).tolist() + [END]
        grams.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    counts = {order: grams}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, context = {}, {}
    for n, c in counts.items():
        k = Counter(c.values())
        if k[1] and k[2]:
            y = k[1] / (k[1] + 2 * k[2])
            d = (1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3] if k[3] else 3 * y)
            discount[n] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
        else:
            discount[n] = [0.5, 0.75, 0.9]
        context[n] = defaultdict(list)
        for g, v in c.items():
            context[n][g[:-1]].append(v)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / SYMBOLS
        below = p(gram[1:])
        seen = context[n].get(gram[:-1])
        if not seen:
            return below
        off = lambda v: discount[n][min(v, 3) - 1]
        v = counts[n].get(gram, 0)
        return ((v - off(v)) if v else 0) / sum(seen) + sum(map(off, seen)) / sum(seen) * below

    return p


def test_kneser_ney_by_definition(spark, corpus):
    from quillgraph.llm.quality import END, score, symbols, train

    _, _, rows, _ = corpus
    texts = [t for i, t, *_ in rows[:30]]
    model = train(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    p = brute_kneser_ney(texts, 3)
    probe = [(0, texts[0]), (1, "kalo Q漢 zz"), (2, ""), (3, None)]
    got = {r.row.doc_id: r for r in score(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    for i, t in probe:
        s = [0, 0, *symbols(t or "").tolist(), END]
        want = -np.mean([math.log(p(tuple(s[k : k + 3]))) for k in range(len(s) - 2)])
        assert got[i].log_ppl == pytest.approx(want, rel=1e-5) and got[i].chars == len(s) - 2
    gap = sum(p((0, 0, w)) for w in range(4096))
    assert gap == pytest.approx(1)


def test_symbols_tell_all_texts_apart():
    from quillgraph.llm.quality import END, symbols

    rng = np.random.default_rng(0)
    points = [int(x) for x in rng.integers(1, 0x10FFFF, 4000) if not 0xD800 <= x < 0xE000] + list(range(3690, 3720)) + [0x4E00, 0x4EFA, 0x10FFFF]
    seen = {}
    for x in points:
        assert seen.setdefault(tuple(symbols(chr(x)).tolist()), x) == x
    assert all(0 < s < END for key in seen for s in key)
    assert symbols("a漢b").tolist() == [*symbols("a"), *symbols("漢"), *symbols("b")]


def test_quality(spark, corpus):
    from quillgraph.llm.quality import judge, keep_good

    docs, labels, rows, truth = corpus
    got = {r.doc_id: r for r in judge(docs, labels).collect()}
    assert len(got) == len({i for i, *_ in rows})
    good = [got[i].keep for i, (q, _) in truth.items() if q]
    bad = [got[i].keep for i, (q, _) in truth.items() if not q]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.05
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in rows if got[i].keep)
    assert judge(docs, labels.limit(0)).where("not keep").count() == 0
    assert judge(docs.limit(0), labels).count() == 0
