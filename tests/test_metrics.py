import math

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import metrics as M


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize("k, ndcg, precision, recall", [(2, 0.479625, 0.5, 0.5), (5, 0.669672, 0.4, 1.0)])
def test_graded_ranking(spark, k, ndcg, precision, recall):
    qrels = spark.createDataFrame([(1, 1, 1), (1, 3, 2)], "qid int, doc_id int, rel int")
    ranked = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 1, 3)], "qid int, doc_id int, rank int")
    ids = spark.createDataFrame([(1,), (2,)], "qid int")
    rows = {r.qid: r for r in M.ranking_by_query(ranked, qrels, ids, (k,)).collect()}
    assert rows[1].ndcg == pytest.approx(ndcg, abs=1e-6)
    assert rows[1].precision == pytest.approx(precision)
    assert rows[1].recall == pytest.approx(recall)
    assert (rows[2].ndcg, rows[2].precision, rows[2].recall) == (0, 0, 0)


def test_cutoffs_must_be_positive(spark):
    empty = spark.createDataFrame([], "qid int, doc_id int, rank int, rel int")
    with pytest.raises(ValueError):
        M.ranking_by_query(empty, empty, empty, (0,))


def test_answer_metrics(spark):
    pred, gold = F.lit("The cat sat on the mat."), F.lit("the cat sat on a mat")
    got = one(spark, fg=M.token_f1(pred, gold), bg=M.bleu4(pred, gold), fm=M.token_f1(pred, gold, True), bm=M.bleu4(pred, gold, True))
    assert got.fg == pytest.approx(1) and got.bg == pytest.approx(1)
    assert got.fm == pytest.approx(0.666667, abs=1e-6) and got.bm == pytest.approx(0.643459, abs=1e-6)


def test_short_and_longer_gold(spark):
    same = F.lit("left lung nodule")
    got = one(spark, em=M.exact_match(same, same), c=M.contains(same, same), f=M.token_f1(same, same), b=M.bleu4(same, same))
    assert (got.em, got.c, got.b) == (1, 1, 0) and got.f == pytest.approx(1)
    pred, gold = F.lit("left upper lung nodule"), F.lit("left upper lung nodule seen")
    got = one(spark, b=M.bleu4(pred, gold), c=M.contains(pred, gold))
    assert got.b == pytest.approx(math.exp(-0.25)) and got.c == 0


def test_empty_answers(spark):
    empty, full = F.lit(""), F.lit("x")
    got = one(spark, both=M.token_f1(empty, empty), one=M.token_f1(empty, full), em=M.exact_match(empty, empty), b=M.bleu4(empty, full), n=M.token_f1(F.lit(None).cast("string"), empty))
    assert (got.both, got.one, got.em, got.b, got.n) == (1, 0, 0, 0, 1)


def test_best_and_joined_golds(spark):
    rows = spark.createDataFrame([("x y", ["a", "x y"]), ("", None)], "pred_text string, golds array<string>")
    best = M.score_answers(rows, "best").orderBy("pred_text").collect()
    assert [r.em for r in best] == [0, 1] and best[0].f1 == 1
    joined = M.score_answers(rows, "joined", light=False).orderBy("pred_text").collect()
    assert joined[1].em == 0
    with pytest.raises(ValueError):
        M.score_answers(rows, "other")


def test_hits_mrr(spark):
    got = spark.createDataFrame([(1,), (4,), (None,)], "p int").agg(*M.hits_mrr(F.col("p"))).first()
    assert got.hits_1 == got.hits_3 == pytest.approx(1 / 3) and got.hits_5 == got.hits_10 == pytest.approx(2 / 3)
    assert got.mrr == pytest.approx(0.416667, abs=1e-6)


def test_closed_metrics_zero_division(spark):
    got = spark.createDataFrame([(0, 0), (0, 0)], "t int, p int").agg(*M.closed_metrics(F.col("t"), F.col("p"))).first()
    assert (got.accuracy, got.precision, got.recall, got.f1) == (1, 0, 0, 0)


def test_whole_turns_are_scored(spark, tmp_path):
    """Texts that differ only after the prefix of the older queries, and golds without the prediction."""
    from quillgraph.queries import QUERIES

    start = " ".join(f"w{i}" for i in range(40))
    rows = [(1, 0, start + " end"), (1, 1, start + " end"), (1, 2, start + " other"), (2, 0, "unlike words"), (2, 1, "nothing shared")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    get = lambda name, col: {(r.conv_id, r.turn): r[col] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert get("em_contains", "em") == get("score_best", "em") == {(1, 0): 1, (1, 1): 0, (2, 0): 0}
    assert get("em_contains", "contains")[1, 1] == get("score_best", "contains")[2, 0] == 0
    assert get("token_f1_g", "f1") == {(1, 0): 1, (1, 1): round(40 / 41, 6), (2, 0): 0}
    assert 0.9 < get("bleu4_m", "bleu")[1, 1] < 1


def test_label_metrics_count_judgements(spark, tmp_path):
    """Judgements by label are counted, not paired; a query without a relevant row is left out, as in the SQL."""
    import duckdb
    from test_retrieve import shuffled_rows

    from quillgraph.queries import METRIC_SQL, ORACLES, QUERIES

    rows = [(i, 7 if i == 300 else i % 2, [float(i % 7 + 1), float(i % 11 + 1)]) for i in range(4000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, moved = shuffled_rows(spark, QUERIES["retrieval_metrics_by_query"](spark, str(tmp_path)))
    sql = ORACLES["retrieval_metrics_by_query"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert METRIC_SQL[:20] == sql[:20] and sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())
    assert len(got) == 39 * 5 and moved < 40_000  # of 78,000 pairs


def test_ideal_from_grades(spark):
    """More grades and more judgements than the cut-off."""
    grades = [3] * 2 + [1] * 9 + [2] * 4
    qrels = spark.createDataFrame([(1, i, g) for i, g in enumerate(grades)], "qid int, doc_id int, rel int")
    ranked = spark.createDataFrame([(1, 5, 1), (1, 0, 2)], "qid int, doc_id int, rank int")
    row = M.ranking_by_query(ranked, qrels, qrels, (5,)).first()
    gain = lambda gs: sum(g / math.log2(i + 2) for i, g in enumerate(gs))
    assert math.isclose(row.ndcg, gain([1, 3]) / gain([3, 3, 2, 2, 2])) and row.precision == 0.4 and math.isclose(row.recall, 2 / 15)


def test_char_bleu_of_a_batch():
    """All pairs of a batch in a few sorts, with characters beyond the basic plane and texts shorter than the orders."""
    import random
    from collections import Counter

    def plain(p, g):
        total = 0.0
        for n in range(1, 5):
            a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (p, g))
            if not (hit := sum((a & b).values())):
                return 0.0
            total += math.log(hit / sum(a.values()))
        return (1 if len(p) > len(g) else math.exp(1 - len(g) / len(p))) * math.exp(total / 4)

    draw = random.Random(4)
    texts = ["".join(draw.choices("ab é\U0001f600", k=draw.choice((0, 1, 3, 4, 5, 30)))) for _ in range(400)]
    golds = texts[:20] + texts[:19:-1]
    got = M._char_bleu(texts, golds)
    assert all(math.isclose(x, plain(p, g), abs_tol=1e-12) for x, p, g in zip(got, texts, golds, strict=True)) and len(M._char_bleu([], [])) == 0


def test_char_bleu_within_means(spark):
    rows = spark.createDataFrame([("a", "the long answer", "long answer"), ("a", None, "long"), ("b", "other", "other")], "k string, p string, g string")
    got = {r.k: (r.bleu, r.em) for r in rows.groupBy("k").agg(*M.open_metrics(F.col("p"), F.col("g"))).collect()}
    assert got == {"a": (0.5, 0.5), "b": (1.0, 1.0)}
