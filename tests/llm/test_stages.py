"""Pipeline stages and thresholds against brute force, with odd columns, repeats and empty tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillgraph.llm.queries")

CLASHES = ("_log_ppl", "_chars", "_keep", "_w", "_hits", "_g", "_n", "_hit", "_base", "_tokens", "_spans", "row", "log_ppl", "chars", "key", "node", "a.b")
LETTERS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents whose further columns bear the names that operators might use inside."""
    rng = np.random.default_rng(2)
    words = ["kalo", "mirta", "sobe", "zughe", "plen", "dor", "vashti", "om", "trell", "quon"]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    rows = [(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)] + [(50, None, None, None, None), (51, "", "aa", "s", 0), (3, texts[3], "aa", "s", len(texts[3])), (None, "no id here", "aa", "s", 10), (52, texts[5] + " x", "aa", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(7))
    return docs


def test_stages_keep_every_column(spark, clashing):
    from quillgraph.llm.decontaminate import clean
    from quillgraph.llm.quality import keep_good
    from quillgraph.llm.secrets import redact
    from quillgraph.llm.shingles import keep_one_of_each_similar

    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "entirely other words")], "item_id long, text string")
    for stage in (lambda d: keep_good(d, labels), keep_one_of_each_similar, lambda d: clean(d, bench), redact):
        out = stage(clashing)
        assert out.columns == clashing.columns
        rows = out.collect()
        assert rows and all(r[c] == 7 for r in rows for c in CLASHES)
        assert {r.text for r in rows} <= {r.text for r in clashing.collect()}
        assert stage(clashing.limit(0)).count() == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_group_of_near_copies_that_all_differ(spark):
    """Copies of one text with 0 to 12 words exchanged: the groups are those of all pairs."""
    from quillgraph.llm.shingles import near_copies, shingle_set

    rng, base = np.random.default_rng(4), [f"w{i}" for i in range(110)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(len(words), i % 13, replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(words))
    found = [set(shingle_set(t).tolist()) for t in texts]
    group = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(found[i] & found[j]) >= 4 * len(found[i] | found[j])]
    for _ in range(12):
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == dict(enumerate(group))
    assert len(set(group)) > 5


def test_prefixes_put_common_shingles_last():
    from quillgraph.llm.shingles import prefix

    s = np.arange(1, 21, dtype=np.uint64)
    common = np.array([1, 2, 3, 30], np.uint64)
    keys, rare = prefix(s, common)
    assert keys.tolist() == [4, 5, 6, 7, 8] and rare == 5
    keys, rare = prefix(s, s[:18])
    assert keys.tolist() == [19, 20, 1, 2, 3] and rare == 2
    assert len(prefix(s[:0], common)[0]) == 0


def test_rejections_are_benjamini_hochberg(spark):
    from quillgraph.llm.secrets import GRID, rejection_steps

    rng = np.random.default_rng(1)
    p = np.concatenate((rng.random(400), rng.random(60) ** 6))
    stratum = rng.integers(0, 3, len(p))
    step = np.floor(np.maximum(0, -GRID * np.log2(p))).astype(int)
    limits = rejection_steps(spark.createDataFrame(list(zip(stratum.tolist(), step.tolist(), strict=True)), "stratum int, step int"), 0.05)
    for s in range(3):
        up = np.sort(2.0 ** (-step[stratum == s] / GRID))
        fits = np.flatnonzero(up <= 0.05 * (np.arange(len(up)) + 1) / len(up))
        rejected = set() if not len(fits) else set(np.flatnonzero((stratum == s) & (2.0 ** (-step / GRID) <= up[fits[-1]])).tolist())
        assert {i for i in np.flatnonzero(stratum == s).tolist() if step[i] >= limits.get(s, 1 << 30)} == rejected


def test_battery_tails(spark):
    """Uniform draws of every alphabet reach no nominal level more often than it says."""
    from quillgraph.llm.secrets import p_value

    rng = np.random.default_rng(3)
    for symbols in ("0123456789abcdef", "".join(LETTERS), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        for n in (12, 20, 40):
            tokens = ["".join(rng.choice(list(symbols), n)) for _ in range(1500)]
            p = np.array([r.p for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(p_value(F.col("t")).alias("p")).collect()])
            assert np.mean(p <= 0.05) < 0.065 and np.mean(p <= 0.01) < 0.018


def test_battery_on_words_identifiers_and_keys(spark):
    from quillgraph.llm.secrets import scan

    rng = np.random.default_rng(9)
    keys = ["".join(rng.choice(LETTERS, 28)) for _ in range(40)]
    parts = ["user", "count", "total", "index", "buffer", "handler", "request", "session", "config", "value", "parser", "stream"]
    natural = ["_".join(rng.choice(parts, 3)) for _ in range(300)] + ["/".join(rng.choice(parts, 4)) + "2024" for _ in range(300)] + ["".join(w.capitalize() for w in rng.choice(parts, 3)) for _ in range(300)] + ["".join(rng.choice(parts, 3)) for _ in range(600)] + ["20240115123456789"] * 20
    rows = [(i, f"see {t} here") for i, t in enumerate(keys + natural)] + [(5000, 'token = "' + "".join(rng.choice(LETTERS, 30)) + '"')]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum("random" in got[i].spans for i in range(len(keys)))
    false = sum("random" in got[i].spans for i in range(len(keys), len(keys) + len(natural)))
    assert found >= 35 and false <= 0.05 * (found + false) + 1
    assert all(got[i].n_tokens == 1 for i in range(len(keys) + len(natural)))
    assert got[5000].n_assign == 1 and got[5000].spans.count(":") == 2 and got[5000].n_random == got[5000].n_tokens == 1


def test_encodings_are_inferred_token_by_token(spark):
    from quillgraph.llm.secrets import candidate_tokens

    tokens = {"123456789012": 0, "0f1e2d3c4b5a6978": 1, "Handwritings": 2, "ABCDEFGH2345": 3, "abcxyz987654": 4, "abcXYZ987654": 5, "abc-XYZ_98765": 6, "abc/XYZ+98765==": 7}
    rows = spark.createDataFrame([(t, f"x {t}") for t in tokens], "t string, text string")
    got = {r.t: r.c for r in rows.select("t", candidate_tokens(F.col("text"), F.array().cast("array<struct<start:int,end:int>>")).alias("c")).collect()}
    assert {t: c[0].stratum // 32 for t, c in got.items()} == tokens
    assert all((c[0].start, c[0].end) == (2, 2 + len(t)) and c[0].stratum % 32 == int(math.log2(len(t))) for t, c in got.items())


def test_texts_without_letters_have_no_language(spark):
    from quillgraph.llm.language import predict, sample_and_fit, words_of

    assert words_of("½ ² Ⅳ 12 ٣ ́") == [] and words_of("a½b x²") == ["a", "b", "x"]
    train = [(i, "kalo mirta sobe" if i % 2 else "une petite phrase", "aa" if i % 2 else "bb") for i in range(40)]
    model = sample_and_fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(100, "½ ² ³"), (101, "Ⅳ"), (102, "́̈"), (103, "12 34"), (104, "x"), (105, None)], "doc_id long, text string").withColumn("lang", F.lit("aa"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (100, 101, 102, 103, 105)) and got[104][0] in ("aa", "bb")


def test_samples_are_bounded(spark):
    from quillgraph.llm.shared import bounded_sample

    rows = spark.createDataFrame([(i % 500, "ab" * (1 + i % 5), "x" if i % 10 else "y") for i in range(3000)] + [(7, "hot", "x")] * 2000, "doc_id long, text string, label string")
    got = bounded_sample(rows, "label", 20, 10_000)
    assert max(Counter(r.label for r in got).values()) <= 20 and len({(r.doc_id, r.label) for r in got}) == len(got)
    assert got == bounded_sample(rows.repartition(7), "label", 20, 10_000) or sorted(map(tuple, got)) == sorted(map(tuple, bounded_sample(rows.repartition(7), "label", 20, 10_000)))
    assert sum(len(r.text) for r in bounded_sample(rows, "label", 20, 30) if r.label == "x") <= 30
    assert bounded_sample(rows.limit(0), "label", 20, 30) == []


def test_toxicity_is_the_worst_window(spark):
    """The scoring pass equals the network on each window by itself."""
    from quillgraph.llm.toxicity import WINDOW, Lexicon, _cut, sample_and_train, score, tokenize, windows

    rng = np.random.default_rng(1)
    mild, bad = [f"m{i}" for i in range(60)], ["vile", "foul", "rank"]
    rows = [(i, " ".join(rng.choice(mild, 90 + i)) + (" " + " ".join(bad) if i % 2 else ""), i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    net = sample_and_train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in score(docs, net).collect()}
    for i, text, _ in rows[:6]:
        lex = Lexicon()
        words = lex.rows(tokenize(text))
        means = lex.gram_means(net.p["gram"])
        alone = []
        for s in windows(len(words)).tolist():
            logits, _ = net.document_logits([words[s : s + WINDOW]], lex, means)
            alone.append(float(logits[0]))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(alone))), abs=1e-4)


def test_quality_thresholds_by_definition(spark):
    """Limits are quantiles of the shrunk statistic of trusted held-out documents."""
    from quillgraph.llm.quality import MARGIN, PSEUDO, QUANTILE, fit, judge, limits, score, trusted_texts

    rng = np.random.default_rng(6)
    words = {"aa": ["kalo", "mirta", "sobe"], "bb": ["une", "petite", "phrase"]}
    rows = [(i, " ".join(rng.choice(words["aa" if i % 2 else "bb"], 20 + i % 9)), "aa" if i % 2 else "bb") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(200)], "doc_id long, quality int")
    trusted = trusted_texts(docs, labels)
    model = fit(trusted)
    found = limits(trusted, model)
    scored = [(r.row.lang, r.log_ppl, r.chars) for r in score(docs.where("doc_id < 150"), model).collect() if held(r.row.doc_id)]
    pick = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values)) - 1)]
    for lang in ("aa", "bb"):
        own = [(p, c) for x, p, c in scored if x == lang]
        centre = pick([p for p, _ in own], 0.5)
        assert found.centre[lang] == pytest.approx(centre)
        assert found.limit[lang] == pytest.approx(pick([(p * c + PSEUDO * centre) / (c + PSEUDO) for p, c in own], QUANTILE) + MARGIN)
    assert judge(docs, labels).where("keep").count() >= 150


def test_trusted_texts_are_not_shuffled(spark, monkeypatch):
    """The rows are those of a semi-join by id, for any type of id; a text only passes through its own task."""
    from quillgraph.llm import quality

    monkeypatch.setattr(quality, "SHARD_ROWS", 40)
    rows = [(i, "aa" if i % 2 else None, None if i % 50 == 0 else f"text {i}") for i in (*range(-100, 300), 7, 1 << 62, -(1 << 63))] + [(None, "aa", "nameless"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    marks = [(i, int(i % 3 == 0)) for i in range(-50, 400)] + [(0, 1), (3, 0), (None, 1), (-(1 << 63), 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    good = {i for i, q in marks if q == 1} - {None}
    want = sorted(map(str, [r for r in rows if r[0] in good]))
    plans, kept = [], quality.write_table
    monkeypatch.setattr(quality, "write_table", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    got = lambda *tables: sorted(str(tuple(r)) for r in quality.trusted_texts(*tables).collect())
    assert got(docs, labels) == want and "Join" not in plans[0] and "hashpartitioning" not in plans[0]
    assert got(docs, labels.limit(0)) == []
    assert got(docs.where("doc_id between -100 and 300").withColumn("doc_id", F.col("doc_id").cast("int")), labels) == sorted(map(str, [r for r in rows if r[0] in good and -100 <= r[0] <= 300]))
    text = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert len(got(text, labels.withColumn("doc_id", F.col("doc_id").cast("string")))) == len(want)


def test_fingerprint_links_come_first(spark, monkeypatch):
    """Near-dedup takes the pivot table's links first; prefixes only compare what those did not group."""
    from quillgraph.llm import shingles

    rng, texts = np.random.default_rng(8), []
    for g in range(8):
        words = [f"g{g}w{i}" for i in range(400)]
        texts.append(" ".join(words))
        for edits in (1, 1, 2, 8):
            copy = list(words)
            for at in rng.choice(400, edits, replace=False):
                copy[at] = f"e{rng.integers(10**9)}"
            texts.append(" ".join(copy))
    found = {shingles.set_id(s): s for s in map(shingles.shingle_set, texts)}
    fps = {u: shingles.set_fingerprint(s) for u, s in found.items()}
    near = lambda u, v: ((fps[u] ^ fps[v]) & (2**64 - 1)).bit_count() <= 4
    seen, inner = [], shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda pairs, *rest: (seen.append({(r.u, r.v) for r in pairs.collect()}), inner(pairs, *rest))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()}
    assert got == {i: i // 5 * 5 for i in range(len(texts))}
    assert len(seen[0]) > 8 and all(near(u, v) for u, v in seen[0])
    assert {x for pair in seen[0] for x in pair} >= {u for u in fps if any(near(u, v) and fps[v] < fps[u] for v in fps)}
    assert seen[1] and not seen[0] & seen[1]


class Captured:
    """Stands for a DataFrame: keeps what is given to ``mapInArrow``."""

    def __init__(self, columns=(), schema=None):
        self.columns, self.schema = list(columns), schema

    def select(self, *_):
        return self

    where = groupBy = agg = select

    def mapInArrow(self, run, schema):
        self.run, self.out = run, schema
        return self


def test_quality_worker_memory(spark):
    """Workers hold a few arrays of a group of texts and hand on little at once, however large Spark's batch is."""
    import tracemalloc

    import pyarrow as pa

    from quillgraph.llm.quality import count_ngrams, score, train

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(LETTERS, 6)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 500)) for _ in range(2500)]
    docs = spark.createDataFrame([(1, texts[0])], "doc_id long, text string")
    model, counted, scored = train(docs), Captured(), Captured(docs.columns, docs.schema)
    count_ngrams(counted)
    score(scored, model)
    ids, column = pa.array(range(len(texts))), pa.array(texts)
    for run, batch in ((counted.run, pa.RecordBatch.from_arrays([column], ["text"])), (scored.run, pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([ids, column], ["doc_id", "text"])], ["row"]))):
        rows = most = 0
        tracemalloc.start()
        for out in run(iter([batch])):
            rows, most = rows + out.num_rows, max(most, out.nbytes)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        print(f"peak {peak / 1e6:.0f} MB, largest output {most / 1e6:.1f} MB of {batch.nbytes / 1e6:.1f}")
        assert rows and peak < 100e6 and most < 4e6


def test_quality_in_small_slices(spark, monkeypatch):
    """Slices, groups, merges, evicted shards and partial lookups change no value, and judging hands no text back."""
    from quillgraph.llm import quality

    rng = np.random.default_rng(5)
    words = ["kalo", "mirta", "sobe", "漢字", "é"]
    rows = [(i, "aa", " ".join(rng.choice(words, int(rng.integers(0, 40)))) if i % 13 else None) for i in range(150)] + [(None, None, "漢" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2)
    labels = spark.createDataFrame([(i, int(i < 90)) for i in range(150)], "doc_id long, quality int")
    got = lambda: sorted(map(str, quality.judge(docs, labels).collect()))
    seen, inner = [], quality.score
    monkeypatch.setattr(quality, "score", lambda *a: (seen.append(inner(*a)), seen[-1])[1])
    want = got()
    assert seen and all("text" not in s.schema["row"].dataType.names for s in seen)
    for name, value in (("SHARD_ROWS", 40), ("KEPT_SHARDS", 2), ("GROUP_BYTES", 700), ("SLICE_BYTES", 90), ("LOOKUPS", 50), ("FLUSH", 30), ("ROWS_OUT", 7)):
        monkeypatch.setattr(quality, name, value)
    assert got() == want and len(want) == 151


def test_near_dedup_worker_memory(spark, monkeypatch, tmp_path):
    """Near-dedup hands its workers small batches of whole texts, puts the session's settings back and frees what packing left in a worker."""
    from quillgraph.llm import shingles, tokens
    from quillgraph.llm.shared import BATCH

    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(LETTERS, 9)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(1100)] + [" ".join(rng.choice(words, 300_000)), None]
    docs = spark.createDataFrame([*enumerate(texts), (2000, texts[0]), (2001, texts[1100])], "doc_id long, text string").coalesce(1)
    runs, kind, folder = [], type(docs), str(tmp_path)
    inner = kind.mapInArrow

    def watched(self, run, schema):
        def seen(batches):
            import uuid

            for batch in batches:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                    file.write(f"{batch.num_rows} {batch.nbytes}")
                yield batch

        runs.append(run)
        return inner(self, lambda batches: run(seen(batches)), schema)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    key = next(iter(BATCH))
    spark.conf.set(key, "777")
    try:
        got = {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()}
        assert spark.conf.get(key) == "777" and all(spark.conf.get(k, None) is None for k in BATCH if k != key)
    finally:
        spark.conf.unset(key)
    assert got == {**{i: i for i in range(len(texts))}, 2000: 0, 2001: 1100}
    sizes = [tuple(map(int, file.read_text().split())) for file in tmp_path.iterdir()]
    assert sum(n for n, _ in sizes) >= len(got) and max(n for n, _ in sizes) <= 512
    assert max(b for n, b in sizes if n > 1) < 2 * 2**20 + 3.2e6  # a longer text comes with its batch, whole
    monkeypatch.setitem(tokens._encoders, "left by packing", object())
    assert not list(runs[0](iter([]))) and not tokens._encoders
