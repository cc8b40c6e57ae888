import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import dataset as D

CORPUS = "doc_id int, head_id string, rel_id string, tail_id string, head_text string, rel_text string, tail_text string, image_path string"


def corpus(spark, *rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], CORPUS)


def test_split_order_and_sizes(spark):
    ids = spark.range(10).select(F.col("id").cast("int").alias("qid"))
    got = {r.qid: r.split for r in D.split_ids(ids).collect()}
    assert {k for k, v in got.items() if v == "val"} == {7} and {k for k, v in got.items() if v == "test"} == {4}
    for n, sizes in ((5977, (4781, 597, 599)), (61136, (48908, 6113, 6115))):
        counts = {r.split: r["count"] for r in D.split_ids(spark.range(n).toDF("qid")).groupBy("split").count().collect()}
        assert (counts["train"], counts["val"], counts["test"]) == sizes
    with pytest.raises(ValueError):
        D.split_ids(ids, train=0.9)


def test_split_does_not_depend_on_partitions(spark):
    ids = spark.range(97).toDF("qid")
    one, many = (sorted(map(tuple, D.split_ids(ids.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_seeds(spark):
    row = spark.range(1).select(T.seed_mod(F.lit("mm_on_text||26")).alias("m"), T.seed_u32(F.lit("aug::26::I1::/p/a.jpg::what is shown")).alias("u")).first()
    assert row.u == 3139728619
    assert row.m == 1912752383


def test_hybrid_offsets(spark):
    mm = {"queries": spark.createDataFrame([(9,)], "qid int"), "corpus": spark.createDataFrame([(4,)], "doc_id int"), "qrels": spark.createDataFrame([(9, 4, 1)], "qid int, doc_id int, rel int")}
    text = {"queries": spark.createDataFrame([(0,)], "qid int"), "corpus": spark.createDataFrame([(0,)], "doc_id int"), "qrels": spark.createDataFrame([(0, 0, 1)], "qid int, doc_id int, rel int")}
    merged = D.merge_hybrid(mm, text)
    assert sorted(map(tuple, merged["qrels"].collect())) == [(9, 4, 1), (10, 5, 1)]
    none = {k: v.limit(0) for k, v in mm.items()}
    assert [tuple(r) for r in D.merge_hybrid(none, text)["qrels"].collect()] == [(0, 0, 1)]


def test_remap_takes_the_largest_grade(spark):
    source = corpus(spark, (1, "Q1", "P1", "Q2"), (2, " Q1", "P1", "Q2 "), (3, "", None, ""))
    target = corpus(spark, (7, "Q1", "P1", "Q2"), (9, "Q1", "P1", "Q2"), (8, None, "", ""))
    qrels = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 1), (2, 1, 0)], "qid int, doc_id int, rel int")
    assert sorted(map(tuple, D.remap_qrels(qrels, source, target).collect())) == [(1, 7, 2), (1, 9, 2)]
    kept = D.remap_qrels(qrels, source, target, keep_unmatched=True).where("qid = 2").collect()
    assert [tuple(r) for r in kept] == [(2, None, None)]


def test_paths_and_strip(spark):
    rows = spark.createDataFrame([("/x/images_subset_kg/Q34266/05474001.jpg",), ("a\\b\\c",), ("one",), ("",), (None,)], "p string")
    assert [r[0] for r in rows.select(T.short_path(F.col("p"))).collect()] == ["Q34266/05474001.jpg", "b/c", "one", "", None]
    row = spark.range(1).select(T.strip(F.lit(" \t x \n")).alias("s"), T.drop_articles_anywhere(F.lit("pizza an the box")).alias("d")).first()
    assert (row.s, row.d) == ("x", "pizzbox")


def test_triplets_and_first_wins(spark):
    rows = spark.createDataFrame([(5, "a", "r", None, "A", "R", None, None), (2, "b", "r", "a", "B", None, "first", None)], CORPUS)
    assert [(r.idx, r.doc_id, r.tail) for r in D.triplets(rows).orderBy("idx").collect()] == [(0, 2, "a"), (1, 5, "None")]
    entities, relations = D.vocabulary(rows)
    assert {r.id: r.text for r in entities.collect()} == {"a": "first", "b": "B"}
    assert {r.id: r.text for r in relations.collect()} == {"r": "R"}


def test_gold_answers(spark):
    docs = spark.createDataFrame([(1, "h", "r", "t1", None, None, " Lung ", None), (2, "h", "r", "t2", None, None, "lung", None), (3, "h", "r", "t3", None, None, "heart", None)], CORPUS)
    queries = spark.createDataFrame([(1, None)], "qid int, masked_type string")
    qrels = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1)], "qid int, doc_id int, rel int")
    assert D.gold_answers(queries, qrels, docs).first().golds == ["Lung", "heart"]
    assert D.gold_answers(queries.withColumn("masked_type", F.lit(" Head ")), qrels, docs).count() == 0
    assert D.gold_answers(queries.withColumn("masked_type", F.lit(" Head ")), qrels, docs, id_fallback=True).first().golds == ["h"]


def test_dense_index_is_gapless(spark):
    rows = D.dense_index(spark.range(1000).repartition(7), "id").collect()
    assert all(r.idx == r.id for r in rows)


def test_candidate_pools(spark):
    entities = spark.range(50).select(F.col("id").alias("pos"), F.concat(F.lit("e"), "id").alias("text"))
    samples = spark.createDataFrame([(1, "e3"), (2, "e4")], "sample_id int, answer string")
    for r in D.candidate_pools(samples, entities, 20).collect():
        assert len(r.candidates) == len(set(r.candidates)) <= 20 and r.answer in r.candidates
