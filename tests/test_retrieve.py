import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import vector as V
from quillgraph.operators import prompts as P
from quillgraph.operators import retrieve as R
from quillgraph.plans import evaluation as E


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    c, q = rng.standard_normal((60, 8)), rng.standard_normal((5, 8))
    corpus = spark.createDataFrame([(i, f"h{i % 7}", v.tolist()) for i, v in enumerate(c)], "idx long, head string, text_emb array<double>")
    queries = spark.createDataFrame([(i, v.tolist(), v[::-1].tolist() if i else None) for i, v in enumerate(q)], "qid int, text_emb array<double>, image_emb array<double>")
    return q, c, queries, corpus


def brute(q, c, k):
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    return {i: np.argsort(-row, kind="stable")[:k].tolist() for i, row in enumerate(s)}


def ranks(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.idx)
    return out


@pytest.mark.parametrize("parts, block", [(1, 4096), (6, 2)])
def test_block_topk_equals_brute_force(spark, vectors, parts, block):
    q, c, queries, corpus = vectors
    got = V.block_topk(queries.select("qid", F.col("text_emb").alias("emb")), corpus.select("idx", F.col("text_emb").alias("emb")).repartition(parts), 9, block=block, corpus_block=7 * block)
    assert ranks(got) == brute(q, c, 9)


def test_topk_limits(spark, vectors):
    _, _, queries, corpus = vectors
    q, c = queries.select("qid", F.col("text_emb").alias("emb")), corpus.select("idx", F.col("text_emb").alias("emb"))
    assert V.block_topk(q, c, 0).count() == 0
    assert V.block_topk(q, c, 1000).count() == V.block_topk(q, c, None).count() == 5 * 60
    assert V.block_topk(q, c.limit(0), 3).count() == 0
    assert V.block_topk(q.limit(0), c, 3).count() == 0


def test_random_is_without_repeats(spark, vectors):
    _, _, queries, _ = vectors
    for n, k in ((1, 3), (10, 10), (60, 7)):
        rows = R.random_topk(queries, n, k).collect()
        assert len(rows) == 5 * min(k, n) and len({(r.qid, r.idx) for r in rows}) == len(rows)
        assert all(0 <= r.idx < n and r.score == min(k, n) - r["rank"] + 1 for r in rows)


def test_random_sets_are_equally_likely(spark):
    """All sets of 2 out of 5, each about as often as the others."""
    from collections import Counter

    rows = R.random_topk(spark.range(6000).withColumnRenamed("id", "qid"), 5, 2).groupBy("qid").agg(F.sort_array(F.collect_list("idx")).alias("s")).collect()
    seen = Counter(tuple(r.s) for r in rows)
    assert len(seen) == 10 and all(abs(n - 600) < 120 for n in seen.values())


def test_weighted_fusion_with_agreement(spark, vectors):
    q, c, queries, corpus = vectors
    pictured = corpus.withColumns({"head_emb": F.when(F.col("idx") % 2 == 0, F.reverse("text_emb")), "tail_emb": F.when(F.col("idx") % 3 == 0, F.col("text_emb"))})
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    image = np.array([np.mean([unit(v)] if False else [w for w in ([unit(v[::-1])] if i % 2 == 0 else []) + ([unit(v)] if i % 3 == 0 else [])] or [np.zeros(8)], axis=0) for i, v in enumerate(c)])
    t, s = unit(q) @ unit(c).T, np.array([np.zeros(8) if i == 0 else unit(v[::-1]) for i, v in enumerate(q)]) @ image.T
    score = 0.25 * t + 0.75 * s + 0.3 * t * s
    got = ranks(R.search("MMWeighted", queries, pictured, 7, agreement=0.3))
    assert got == {i: np.argsort(-row, kind="stable")[:7].tolist() for i, row in enumerate(score)}


def test_older_anchor_by_family(spark, vectors):
    """Distinct texts in text order with an image, the first rows without one."""
    q, c, queries, corpus = vectors
    texts = c[[i % 20 for i in range(60)]]
    rows = spark.createDataFrame([(i, f"t{i % 20}", v.tolist(), v.tolist() if i < 3 else None) for i, v in enumerate(texts)], "idx long, text string, text_emb array<double>, head_emb array<double>")
    rows = rows.withColumn("tail_emb", F.lit(None).cast("array<double>"))
    got = ranks(R.search("MMAnchor", queries, rows, 50, family="A", n_img=4, n_text=2, digits=9))
    want = brute(q, texts, 60)
    assert got[0][0] == want[0][0] and len(got[0]) == 2
    for i in range(1, 5):
        assert got[i] == list(dict.fromkeys(x % 20 for x in want[i]))[:6]
    bare = ranks(R.search("MMAnchor", queries, rows.withColumn("head_emb", F.lit(None).cast("array<double>")), 50, family="Q", n_text=3, digits=9))
    assert all(len(x) == 3 for x in bare.values())


def test_anchor_keeps_to_chosen_heads(spark, vectors):
    q, c, queries, corpus = vectors
    heads = corpus.groupBy("head").agg(F.min_by("text_emb", "idx").alias("head_emb"))
    rows = ranks(R.anchor_topk(queries, corpus.join(heads, "head"), 8, n_img=2))
    assert rows[0] == brute(q, c, 8)[0]
    assert all(len({i % 7 for i in rows[k]}) <= 2 for k in range(1, 5))


def test_fusions(spark):
    a, b, none = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(2.0)), F.lit(None).cast("array<double>")
    row = spark.range(1).select(V.fuse(a, b, norm_first=True).alias("n"), V.fuse(a, b, norm_first=False).alias("r"), V.fuse(a, none, norm_first=False).alias("o"), V.mean_of(none, none).alias("x")).first()
    n = (np.array([0.6, 0.8]) + [0, 1]) / 2
    assert np.allclose(row.n, n / np.linalg.norm(n)) and np.allclose(row.r, np.array([1.5, 3]) / np.linalg.norm([1.5, 3]))
    assert np.allclose(row.o, [0.6, 0.8]) and row.x is None


def test_unknown_names(spark, vectors):
    _, _, queries, corpus = vectors
    with pytest.raises(ValueError):
        R.search("Nope", queries, corpus, 3)
    with pytest.raises(ValueError):
        R.search("Random", queries, corpus, 3, family="Z")


def test_choice_prompt(spark):
    problems = spark.createDataFrame([("1", "Q?", ["x", "y"], 1, "", "L\nl", "S")], "pid string, question string, choices array<string>, answer int, hint string, lecture string, solution string")
    shots = problems.withColumn("pos", F.lit(0))
    text = P.few_shot(problems, shots, "CQM-ALE").first().prompt
    shot, test = text.split("\n\n")
    assert shot == "Context: N/A\nQuestion: Q?\nOptions: (A) x (B) y\nAnswer: The answer is B. BECAUSE: L\\nl S"
    assert test == "Now, please answer the question.Context: N/A\nQuestion: Q?\nOptions: (A) x (B) y\nAnswer:"
    with pytest.raises(ValueError):
        P.choice_example("ZZ-A", True)
    many = spark.range(33).select(F.col("id").alias("pos")).crossJoin(problems)
    with pytest.raises(ValueError, match="32 shots"):
        P.few_shot(problems, many, "CQM-A")
    assert P.few_shot(problems, many.where("pos < 32"), "CQM-A").first().prompt.count("Question:") == 33


def test_end_to_end_retrieval(spark):
    corpus = spark.createDataFrame([(i, f"h{i}", "r", f"t{i}", f"head number{i}", "points to", f"tail number{i}", None) for i in range(12)], "doc_id int, head_id string, rel_id string, tail_id string, head_text string, rel_text string, tail_text string, image_path string")
    queries = spark.createDataFrame([(i, f"[IMAGE] head number{i} tail number{i}", False, "tail", f"h{i}", "r", None) for i in range(4)], "qid int, query string, is_multimodal boolean, masked_type string, head_id string, rel_id string, tail_id string")
    qrels = spark.createDataFrame([(i, i, 1) for i in range(4)], "qid int, doc_id int, rel int")
    split = {"queries": queries, "corpus": corpus, "qrels": qrels}
    for family in ("G", "M"):
        rows = {r.k: r for r in E.evaluate_retrieval(split, "SimpleText", ks=(1, 5), family=family).collect()}
        assert rows[5].recall == 1 and 0 <= rows[1].ndcg <= 1


def test_splits_partition_the_queries(spark):
    def side(n, shift):
        q = spark.createDataFrame([(i, "q") for i in range(n)], "qid int, query string")
        c = spark.createDataFrame([(i, "/a/b/c.jpg") for i in range(n)], "doc_id int, image_path string")
        return {"queries": q, "corpus": c, "qrels": spark.createDataFrame([(i, i, 1) for i in range(n)], "qid int, doc_id int, rel int")}

    parts = E.make_splits(side(12, 0), side(8, 0))
    for name, n in (("mm", 12), ("text", 8)):
        ids = [r.qid for p in parts.values() for r in p[f"{name}_queries"].collect()]
        assert sorted(ids) == list(range(n))
    assert parts["val"]["mm_corpus"].first().image_path == "b/c.jpg"


def test_hundredth_queries_search_every_row(spark, tmp_path):
    """The query set grows with the table, and query rows can be returned."""
    from quillgraph.queries import QUERIES

    rows = [(i, i % 3, [float(i % 7 + 1), float(i % 11 + 1)]) for i in range(301)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["full_ranking"](spark, str(tmp_path)).collect()
    assert {r.qid for r in found} == {0, 100, 200, 300} and len(found) == 4 * 301
    assert {r.qid for r in QUERIES["random_retriever"](spark, str(tmp_path)).collect()} == {0, 100, 200, 300}


def shuffled_rows(spark, df):
    """(rows of ``df``, rows that computing them wrote to shuffles)."""
    def total():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    return df.collect(), total() - before


def test_anchor_shuffles_no_pairs(spark):
    """A large head is dealt into blocks; only the best of a block move. Rounded ties go to the smaller index."""
    rng = np.random.default_rng(5)
    c, q = rng.standard_normal((2000, 4)), rng.standard_normal((50, 4))
    c[1000:] = c[:1000]
    corpus = spark.createDataFrame([(i, "ab"[i % 10 == 0], v.tolist(), [1.0, float(i % 10 == 0)]) for i, v in enumerate(c)], "idx long, head string, text_emb array<double>, head_emb array<double>")
    queries = spark.createDataFrame([(i, v.tolist(), [1.0, 0.0]) for i, v in enumerate(q)], "qid int, text_emb array<double>, image_emb array<double>")
    rows, moved = shuffled_rows(spark, R.anchor_topk(queries, corpus, 6, n_img=1, digits=9))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(c).T, 9)
    s[:, ::10] = -2
    want = {i: np.argsort(-row, kind="stable")[:6].tolist() for i, row in enumerate(s)}
    got = {i: [r.idx for r in sorted(rows, key=lambda r: r["rank"]) if r.qid == i] for i in want}
    assert got == want and moved < 20_000  # of 90,000 pairs


def test_topk_within_blocks(spark, vectors):
    """Keys smaller and larger than a block, keys of one side only, missing vectors last."""
    q, c, _, _ = vectors
    keys = [i % 7 if i % 2 else 8 for i in range(60)]
    corpus = spark.createDataFrame([(i, k, None if i == 4 else v.tolist()) for i, (k, v) in enumerate(zip(keys, c, strict=True))], "idx long, head int, emb array<double>")
    asked = [(i, k) for i in range(5) for k in (8, i, 9)]
    queries = spark.createDataFrame([(i, k, q[i].tolist()) for i, k in asked], "qid int, head int, emb array<double>")
    got = ranks(V.topk_within(queries, corpus, "head", 40, block=2, corpus_block=5))
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    s[:, 4] = -9
    for i in range(5):
        mine = [j for j in range(60) if (i, keys[j]) in asked]
        assert got[i] == sorted(mine, key=lambda j: (-s[i, j], j))


@pytest.mark.parametrize("blocks", [{}, {"block": 2, "corpus_block": 9}])
def test_first_relevant(spark, vectors, blocks):
    """Position in the whole ranking, without a row a pair; queries without a relevant row stay."""
    q, c, _, _ = vectors
    label = lambda i: None if i % 10 == 9 else i % 4
    corpus = spark.createDataFrame([(i, label(i), c[i % 40].tolist()) for i in range(60)], "idx long, label int, emb array<double>")
    queries = spark.createDataFrame([(i, 77 if i == 3 else label(i), c[i % 40].tolist()) for i in (0, 1, 3, 9, 42)], "qid int, label int, emb array<double>")
    rows, moved = shuffled_rows(spark, V.first_relevant(queries, corpus, 9, **blocks))
    u = c / np.linalg.norm(c, axis=1, keepdims=True)
    s = np.round(u @ u[[i % 40 for i in range(60)]].T, 9)
    want = {3: None, 9: None}
    for i in (0, 1, 42):
        ranked = sorted(range(60), key=lambda j: (-s[i % 40][j], j))
        want[i] = 1 + next(r for r, j in enumerate(ranked) if label(j) == label(i) and j != i)
    assert {r.qid: r.pos for r in rows} == want and moved < 250


def test_hits_count_queries_without_relevant_rows(spark, tmp_path):
    import duckdb

    from quillgraph.queries import ORACLES, QUERIES

    rows = [(i, i, [float(i % 7 + 1), float(i % 11 + 1)]) for i in range(200)] + [(200, 0, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["hits_mrr"](spark, str(tmp_path)).first()
    want = duckdb.sql(ORACLES["hits_mrr"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()[0]
    assert tuple(map(float, got)) == tuple(map(float, want)) and got.hits_1 == round(1 / 3, 6)


def test_scores_are_made_in_slices(spark):
    """No more than ``SLICE`` scores are held at once, whatever the blocks; the merge of slices is the ranking."""
    rng = np.random.default_rng(9)
    c, q = np.round(rng.standard_normal((30000, 2)), 1), rng.standard_normal((50, 2))
    side = lambda x, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, emb array<double>")
    most = V.SLICE

    def fused(s):
        if s.size > most:
            raise ValueError("too many scores at once")
        return s

    got = ranks(V.rank_scores(V.block_product(side(q, "qid"), side(c, "idx"), {"emb": True}, fused, 3, 9), 3))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    assert got == {i: np.argsort(-row, kind="stable")[:3].tolist() for i, row in enumerate(np.round(unit(q) @ unit(c).T, 9))}


def test_full_ranking_hands_back_small_frames(spark):
    """Without ``k`` a pair of blocks hands back ``SLICE`` rows at most, so blocks of the corpus are smaller."""
    q = spark.range(3).select(F.col("id").alias("qid"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("emb"))
    c = spark.range(20000).select(F.col("id").alias("idx"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("emb"))
    made = V.block_product(q, c, {"emb": True}, lambda s: s * 0 + s.shape[1], None)
    assert made.agg(F.max("score")).first()[0] < 5000 and made.count() == 60000
