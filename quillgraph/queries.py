"""Queries over the driver's tables, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vector as V
from .operators import dataset as D
from .operators import metrics as M
from .operators import prompts as P
from .operators import retrieve as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- knowledge graph from the star schema -------------------------------------------------------

KG_SQL = """WITH kg AS (
  SELECT CAST(s_suppkey AS BIGINT) AS doc_id, 'S' || s_suppkey AS head_id, 'located' AS rel_id, 'N' || s_nationkey AS tail_id, s_name AS head_text, 'is located in' AS rel_text, n_name AS tail_text FROM supplier JOIN nation ON s_nationkey = n_nationkey),
kg2 AS (
  SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'C' || c_custkey AS head_id, 'located' AS rel_id, 'N' || c_nationkey AS tail_id, c_name AS head_text, 'is located in' AS rel_text, n_name AS tail_text FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def _kg(spark: SparkSession, sf: str, side: str = "supplier") -> DataFrame:
    p, key = ("s", "s_suppkey") if side == "supplier" else ("c", "c_custkey")
    rows = _t(spark, sf, side).join(F.broadcast(_t(spark, sf, "nation")), F.col(f"{p}_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col(key).cast("long").alias("doc_id"), F.concat(F.lit(p.upper()), F.col(key).cast("string")).alias("head_id"), F.lit("located").alias("rel_id"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("tail_id"), F.col(f"{p}_name").alias("head_text"), F.lit("is located in").alias("rel_text"), F.col("n_name").alias("tail_text"),
    )


@_query(KG_SQL + "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, head_id AS head, rel_id AS relation, tail_id AS tail FROM kg2")
def kg_triplets(spark, sf):
    return D.triplets(_kg(spark, sf, "customer"))


@_query(KG_SQL + ", s AS (SELECT doc_id, head_id AS id, head_text AS text, 0 AS pos FROM kg UNION ALL SELECT doc_id, tail_id, tail_text, 1 FROM kg) SELECT id, arg_min(text, doc_id * 2 + pos) AS text FROM s GROUP BY id")
def vocab_first_wins(spark, sf):
    return D.vocabulary(_kg(spark, sf))[0]


@_query(KG_SQL + ", s AS (SELECT doc_id, head_id AS id, head_text AS name, 0 AS pos FROM kg UNION ALL SELECT doc_id, tail_id, tail_text, 1 FROM kg) SELECT id, arg_max(name, doc_id * 2 + pos) AS name FROM s GROUP BY id")
def vocab_last_wins(spark, sf):
    kg = _kg(spark, sf).select(F.col("doc_id").alias("idx"), F.col("head_id").alias("head"), F.col("head_text").alias("head_name"), F.col("tail_id").alias("tail"), F.col("tail_text").alias("tail_name"))
    return D.names_last(kg)


@_query(KG_SQL + "SELECT tail_id AS node, rel_id AS relation, array_to_string(list_sort(list(DISTINCT head_id)), ',') AS neighbours FROM kg GROUP BY ALL")
def adjacency(spark, sf):
    kg = _kg(spark, sf).select(F.col("head_id").alias("head"), F.col("rel_id").alias("relation"), F.col("tail_id").alias("tail"))
    return D.adjacency(kg).withColumn("neighbours", F.array_join("neighbours", ","))


@_query(KG_SQL + "SELECT name, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM (SELECT head_text AS name, head_id AS id FROM kg UNION ALL SELECT tail_text, tail_id FROM kg) GROUP BY name")
def name_ids(spark, sf):
    kg = _kg(spark, sf).select(F.col("head_id").alias("head"), F.col("head_text").alias("head_name"), F.col("tail_id").alias("tail"), F.col("tail_text").alias("tail_name"))
    return D.name_ids(kg).withColumn("ids", F.array_join("ids", ","))


def _mm_text(spark, sf):
    """Supplier facts as the multimodal side, customer facts as the text side; a query asks for a nation's members."""
    out = []
    for side in ("supplier", "customer"):
        kg = _kg(spark, sf, side).withColumn("image_path", F.concat(F.lit("/x/images/"), "head_id", F.lit("/1.jpg")))
        qid = F.substring("tail_id", 2, 9).cast("int")
        queries = kg.groupBy(qid.alias("qid"), F.col("tail_id"), F.col("tail_text")).agg(F.lit(1).alias("_1")).select("qid", F.concat(F.lit("[IMAGE] who "), F.lit("is located in "), "tail_text").alias("query"), F.lit(side == "supplier").alias("is_multimodal"), F.lit("head").alias("masked_type"), F.lit(None).cast("string").alias("head_id"), F.lit("located").alias("rel_id"), "tail_id")
        out.append({"queries": queries, "corpus": kg, "qrels": kg.select(qid.alias("qid"), "doc_id", F.lit(1).alias("rel"))})
    return out


@_query(KG_SQL + "SELECT CAST(substr(tail_id, 2) AS INTEGER) AS qid, string_agg(head_text, '|' ORDER BY doc_id) AS golds FROM kg GROUP BY tail_id")
def gold_answers(spark, sf):
    mm, _ = _mm_text(spark, sf)
    return D.gold_answers(mm["queries"], mm["qrels"], mm["corpus"]).withColumn("golds", F.array_join("golds", "|"))


@_query(KG_SQL + ", o AS (SELECT max(doc_id) + 1 AS d, (SELECT max(CAST(substr(tail_id, 2) AS INTEGER)) + 1 FROM kg) AS q FROM kg) SELECT CAST(substr(tail_id, 2) AS INTEGER) AS qid, doc_id, 1 AS rel FROM kg UNION ALL SELECT CAST(CAST(substr(tail_id, 2) AS INTEGER) + q AS INTEGER), doc_id + d, 1 FROM kg2, o")
def hybrid_merge(spark, sf):
    return D.merge_hybrid(*_mm_text(spark, sf))["qrels"]


@_query(KG_SQL + "SELECT doc_id, head_id FROM kg2 UNION ALL SELECT doc_id + (SELECT max(doc_id) + 1 FROM kg2), head_id FROM kg")
def union_primary(spark, sf):
    return D.union_primary(_kg(spark, sf, "customer"), _kg(spark, sf)).select("doc_id", "head_id")


@_query("SELECT doc_id + 1000 AS doc_id, quality FROM labels")
def offset_ids(spark, sf):
    return D.offset(_t(spark, sf, "labels"), doc_id=1000).select("doc_id", "quality")


@_query("""WITH s AS (SELECT l_orderkey AS qid, l_partkey AS doc_id, max(CAST(l_linenumber AS INTEGER)) AS rel FROM lineitem GROUP BY 1, 2)
SELECT qid, doc_id + 1000000 AS doc_id, rel FROM s""")
def remap_qrels(spark, sf):
    part = _t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("head_id"), F.lit("is").alias("rel_id"), F.col("p_type").alias("tail_id"))
    target = part.select((F.col("doc_id") + 1000000).alias("doc_id"), F.trim("head_id").alias("head_id"), "rel_id", "tail_id")
    qrels = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("rel"))
    return D.remap_qrels(qrels, part, target)


SPLIT_SQL = """WITH h AS (SELECT o_orderkey AS qid, row_number() OVER (ORDER BY sha1('markg_v1::' || o_orderkey)) - 1 AS i, count(*) OVER () AS n FROM orders),
s AS (SELECT qid, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM h)
"""


def _orders_split(spark, sf):
    return D.split_ids(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("qid")))


@_query(SPLIT_SQL + "SELECT qid, split FROM s")
def split_8_1_1(spark, sf):
    return _orders_split(spark, sf)


@_query(SPLIT_SQL + "SELECT split, count(*) AS n FROM s GROUP BY split")
def split_counts(spark, sf):
    return M.distribution(_orders_split(spark, sf), "split")


@_query("SELECT doc_id AS qid FROM labels WHERE quality > 0 AND doc_id IN (SELECT doc_id FROM documents)")
def eval_qids(spark, sf):
    qrels = _t(spark, sf, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").alias("rel"))
    return D.eval_qids(_t(spark, sf, "documents").select(F.col("doc_id").alias("qid")), qrels)


@_query("SELECT doc_id AS qid, quality AS rel FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def filter_qrels(spark, sf):
    return D.restrict(_t(spark, sf, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").alias("rel")), _t(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("qid")))


@_query("SELECT count(*) AS total, count(l.doc_id) AS with_qrels, count(l.doc_id) FILTER (l.quality = 1) AS mapped FROM documents d LEFT JOIN labels l USING (doc_id)")
def qrels_coverage(spark, sf):
    labels = _t(spark, sf, "labels").withColumnRenamed("doc_id", "qid")
    return M.coverage(_t(spark, sf, "documents").withColumnRenamed("doc_id", "qid"), labels, labels.where("quality = 1"))


@_query(KG_SQL + "SELECT (SELECT count(DISTINCT tail_id) FROM kg) AS queries, 100.0::DOUBLE AS multimodal_percent, count(*) AS triplets, count(*) AS answers FROM kg")
def dataset_statistics(spark, sf):
    mm, _ = _mm_text(spark, sf)
    return M.dataset_stats(mm["queries"], mm["corpus"], mm["qrels"])


@_query(KG_SQL + "SELECT doc_id, lower(head_text || ' ' || rel_text || ' ' || tail_text) AS text FROM kg2")
def verbalize(spark, sf):
    kg = _kg(spark, sf, "customer")
    entities, relations = D.vocabulary(kg)
    return D.verbalise(D.triplets(kg), entities, relations, lower=True).select("doc_id", "text")


@_query(KG_SQL + "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a picture of ' || head_id ELSE head_text END AS head_text FROM kg")
def caption_text(spark, sf):
    kg = _kg(spark, sf)
    captions = kg.where("doc_id % 2 = 0").select(F.col("head_id").alias("entity_id"), F.concat(F.lit("a picture of "), "head_id").alias("caption"))
    return R.caption_text(kg, captions).select("doc_id", "head_text")


@_query("SELECT p_partkey AS doc_id FROM part WHERE NOT contains(lower(CASE WHEN p_size % 2 = 0 THEN 'Image_' || p_name ELSE p_name END), 'image_')")
def exclude_image_heads(spark, sf):
    part = _t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Image_"), "p_name")).otherwise(F.col("p_name")).alias("head_text"))
    return D.without_image_heads(part).select("doc_id")


@_query("WITH e AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'f' WHEN o_orderstatus = 'O' THEN 'o' END AS r FROM orders) SELECT o_orderkey FROM e WHERE r IS NOT NULL AND o_custkey IN (SELECT c_custkey FROM customer)")
def edges_with_text(spark, sf):
    edges = _t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("head"), F.col("o_orderstatus").alias("relation"), F.col("o_custkey").cast("string").alias("tail"))
    entities = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return D.edges_with_text(edges, entities, spark.createDataFrame([("F",), ("O",)], "id string"))[0].select("o_orderkey")


# --- vectors ------------------------------------------------------------------------------------

# The query set is every row whose id is divisible by 100, searched for in all rows.
RANKED_SQL = """WITH q AS (SELECT vec_id AS qid, label AS ql, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS doc_id, label AS cl, embedding AS b FROM embeddings),
s AS (SELECT qid, doc_id, ql, cl, round(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])), 9) AS score FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
"""


def _vectors(spark, sf):
    e = _t(spark, sf, "embeddings")
    return e.where(F.col("vec_id") % 100 == 0), e


def _ranked(spark, sf, k=100):
    q, c = _vectors(spark, sf)
    rows = V.block_topk(q.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("emb")), c.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("emb")), k, digits=9)
    return rows.withColumnRenamed("idx", "doc_id")


def _label_metrics(spark, sf):
    """Ranking metrics by query; relevant are the rows of the query's label, other than the query itself, which are counted by label, not paired."""
    q, c = _vectors(spark, sf)
    asked = q.select(F.col("vec_id").alias("qid"), "label")
    labels = c.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("_l"))
    hits = _ranked(spark, sf).where("qid <> doc_id").join(asked, "qid").join(labels, "doc_id").where("label = _l").select("qid", "rank", F.lit(1).alias("rel"))
    all_of, own = labels.groupBy(F.col("_l").alias("label")).agg(F.count("*").alias("_all")), asked.groupBy("qid", "label").agg(F.count("*").alias("_own"))
    grades = own.join(all_of, "label").select("qid", F.lit(1).alias("rel"), (F.col("_own") * (F.col("_all") - F.col("_own"))).alias("n")).where("n > 0")
    return M.ranking_of_hits(hits, grades, grades.select("qid"))


@_query(RANKED_SQL + "SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 100")
def dense_topk(spark, sf):
    return _ranked(spark, sf).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@_query(RANKED_SQL + "SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def block_topk(spark, sf):
    q, c = _vectors(spark, sf)
    rows = V.block_topk(q.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("emb")), c.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("emb")), 10, digits=9, block=16, corpus_block=256)
    return rows.select("qid", F.col("idx").alias("doc_id"), "rank")


@_query(RANKED_SQL + "SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM r")
def full_ranking(spark, sf):
    return _ranked(spark, sf, None).select("qid", "doc_id", "rank")


METRIC_SQL = RANKED_SQL + """, n AS (SELECT qid, count(*) AS n FROM s WHERE ql = cl AND qid <> doc_id GROUP BY qid),
k AS (SELECT unnest([5, 10, 20, 50, 100]) AS k),
m AS (SELECT q.qid, k.k,
  coalesce(sum(1 / log2(r.rank + 1)), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 101) t(i) WHERE i <= least(k.k, any_value(n.n))) AS ndcg,
  count(r.rank) / k.k AS precision, count(r.rank) / any_value(n.n) AS recall
  FROM q CROSS JOIN k JOIN n ON n.qid = q.qid LEFT JOIN r ON r.qid = q.qid AND r.rank <= k.k AND r.ql = r.cl AND r.qid <> r.doc_id GROUP BY q.qid, k.k)
"""


@_query(METRIC_SQL + "SELECT qid, CAST(k AS INTEGER) AS k, round(ndcg, 6) AS ndcg, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m")
def retrieval_metrics_by_query(spark, sf):
    return _label_metrics(spark, sf).select("qid", "k", *[F.round(m, 6).alias(m) for m in ("ndcg", "precision", "recall")])


@_query(METRIC_SQL + "SELECT CAST(k AS INTEGER) AS k, round(avg(ndcg), 6) AS ndcg, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM m GROUP BY k")
def retrieval_metrics(spark, sf):
    means = M.ranking_means(_label_metrics(spark, sf))
    return means.select("k", *[F.round(m, 6).alias(m) for m in ("ndcg", "precision", "recall")])


@_query(RANKED_SQL + ", p AS (SELECT qid, min(rank) FILTER (ql = cl AND qid <> doc_id) AS pos FROM r GROUP BY qid) SELECT " + ", ".join(f"round(avg(CASE WHEN pos <= {k} THEN 1.0 ELSE 0 END), 6) AS hits_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1 / pos, 0)), 6) AS mrr FROM p")
def hits_mrr(spark, sf):
    q, c = _vectors(spark, sf)
    of = lambda d, key: d.select(F.col("vec_id").alias(key), F.col("embedding").alias("emb"), "label")
    rows = V.first_relevant(of(q, "qid"), of(c, "idx"), digits=9).agg(*M.hits_mrr(F.col("pos")))
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


PAIRS_SQL = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM e x LEFT JOIN e y ON y.vec_id = x.vec_id + 1 AND x.vec_id % 3 <> 0)
"""


def _pairs(spark, sf):
    e = _t(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")).where("vec_id % 3 <> 0"), "vec_id", "left")


def _mean_sql(half: str) -> str:
    return PAIRS_SQL + f", m AS (SELECT vec_id, CASE WHEN b IS NULL THEN a ELSE list_transform(list_zip(a, b), lambda z: {half}) END AS v FROM p), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM m) SELECT vec_id, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM u"


@_query(_mean_sql("(z[1] + z[2]) / 2"))
def mean_fusion_raw(spark, sf):
    rows = _pairs(spark, sf).select("vec_id", V.fuse(F.col("a"), F.col("b"), norm_first=False).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_query(_mean_sql("(z[1] / sqrt(list_sum(list_transform(a, lambda y: y * y))) + z[2] / sqrt(list_sum(list_transform(b, lambda y: y * y)))) / 2"))
def mean_fusion_norm_first(spark, sf):
    rows = _pairs(spark, sf).select("vec_id", V.fuse(F.col("a"), F.col("b"), norm_first=True).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_query(RANKED_SQL + """, w AS (SELECT qid, doc_id, list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])) AS t, CASE WHEN doc_id % 3 <> 0 THEN list_cosine_similarity(list_reverse(CAST(a AS DOUBLE[])), CAST(b AS DOUBLE[])) ELSE 0 END AS i FROM q, c),
x AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(0.25 * t + 0.75 * i + 0.1 * t * i, 8) DESC, doc_id) AS rank FROM w) SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM x WHERE rank <= 10""")
def weighted_fusion(spark, sf):
    q, c = _vectors(spark, sf)
    queries = q.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("text_emb"), F.reverse("embedding").alias("image_emb"))
    corpus = c.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("text_emb"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("head_emb"), F.lit(None).cast("array<float>").alias("tail_emb"))
    return R.search("MMWeighted", queries, corpus, 10, agreement=0.1, digits=8).select("qid", F.col("idx").alias("doc_id"), "rank")


@_query(RANKED_SQL + """, hd AS (SELECT cl AS head, arg_min(b, doc_id) AS v FROM c WHERE doc_id % 2 = 0 GROUP BY cl),
h AS (SELECT qid, head, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(list_reverse(CAST(a AS DOUBLE[])), CAST(v AS DOUBLE[])), 9) DESC, head) AS hr FROM q, hd),
x AS (SELECT s.qid, s.doc_id, row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, doc_id) AS rank FROM s JOIN h ON h.qid = s.qid AND h.head = s.cl AND hr <= 3)
SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM x WHERE rank <= 10""")
def two_stage_anchor(spark, sf):
    q, c = _vectors(spark, sf)
    head = c.where("vec_id % 2 = 0").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head_emb"))
    corpus = c.join(head, "label").select(F.col("vec_id").alias("idx"), F.col("label").alias("head"), F.col("embedding").alias("text_emb"), "head_emb")
    queries = q.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("text_emb"), F.reverse("embedding").alias("image_emb"))
    return R.anchor_topk(queries, corpus, 10, n_img=3, digits=9).select("qid", F.col("idx").alias("doc_id"), "rank")


@_query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, first_value(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS t, min(vec_id) OVER (PARTITION BY label) AS head FROM embeddings),
s AS (SELECT q.vec_id AS qid, q.vec_id % 200 = 0 AS pictured, c.vec_id AS doc_id, c.vec_id = c.head AS once, round(list_cosine_similarity(q.v, c.t), 9) AS score FROM e q, e c WHERE q.vec_id % 100 = 0),
x AS (SELECT qid, doc_id, pictured, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE once OR NOT pictured)
SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM x WHERE rank <= CASE WHEN pictured THEN 6 ELSE 3 END""")
def anchor_legacy(spark, sf):
    """The older anchor; a triplet's text is its label, with the vector of the label's first row. Every second query has no image."""
    q, c = _vectors(spark, sf)
    texts = c.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("text_emb"))
    corpus = c.join(texts, "label").select(F.col("vec_id").alias("idx"), F.col("label").cast("string").alias("text"), "text_emb", F.col("embedding").alias("head_emb"), F.lit(None).cast("array<float>").alias("tail_emb"))
    queries = q.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("text_emb"), F.when(F.col("vec_id") % 200 == 0, F.reverse("embedding")).alias("image_emb"))
    return R.search("MMAnchor", queries, corpus, 8, family="A", n_img=2, n_text=3, digits=9).select("qid", F.col("idx").alias("doc_id"), "rank")


@_query()
def random_retriever(spark, sf):
    q, c = _vectors(spark, sf)
    return R.random_topk(q.select(F.col("vec_id").alias("qid")), c.count(), 10)


# --- answers ------------------------------------------------------------------------------------

TURNS_SQL = """WITH w AS (SELECT a.conv_id, a.turn, a.text AS p, b.text AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
"""
# Two golds, the next turn and the one after it.
GOLDS_SQL = TURNS_SQL.replace("b.turn = a.turn + 1", "b.turn IN (a.turn + 1, a.turn + 2)")
JOINED_SQL = """WITH w AS (SELECT a.conv_id, a.turn, a.text AS p, b.text || coalesce(chr(10) || c.text, '') AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2)
"""


def _turns(spark, sf, away: int = 1):
    """Every turn's whole text as the prediction ``p``, a later turn's whole text as the gold ``g``."""
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("p")).join(c.select("conv_id", (F.col("turn") - away).alias("turn"), F.col("text").alias("g")), ["conv_id", "turn"])


def _two_golds(spark, sf):
    """Predictions with the texts of the next two turns as golds, as far as they exist."""
    after = _turns(spark, sf, 2).select("conv_id", "turn", F.col("g").alias("g2"))
    rows = _turns(spark, sf).join(after, ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", F.col("p").alias("pred_text"), F.array_compact(F.array("g", "g2")).alias("golds"))


LIGHT = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
TOKENS = {
    "g": "list_filter(string_split_regex(translate(lower({}), '" + T.PUNCTUATION.replace("'", "''") + "', ''), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))",
    "m": "list_filter(string_split(" + LIGHT + ", ' '), lambda x: x <> '')",
}


@_query(TURNS_SQL + f", n AS (SELECT conv_id, turn, {LIGHT.format('p')} AS p, {LIGHT.format('g')} AS g FROM w) SELECT conv_id, turn, CASE WHEN g <> '' AND p = g THEN 1.0 ELSE 0.0 END::DOUBLE AS em, CASE WHEN g <> '' AND contains(p, g) THEN 1.0 ELSE 0.0 END::DOUBLE AS contains FROM n")
def em_contains(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", M.exact_match(F.col("p"), F.col("g")).alias("em"), M.contains(F.col("p"), F.col("g")).alias("contains"))


def _of(template: str, name: str) -> str:
    """The template with its first empty braces filled (the punctuation holds braces of its own)."""
    return template.replace("{}", name, 1)


def _f1_sql(kind: str, eps: str) -> str:
    return TURNS_SQL + f""", k AS (SELECT conv_id, turn, {_of(TOKENS[kind], 'p')} AS p, {_of(TOKENS[kind], 'g')} AS g FROM w),
o AS (SELECT conv_id, turn, len(p) AS n, len(g) AS m, coalesce(list_sum(list_transform(list_distinct(p), lambda v: least(len(list_filter(p, lambda x: x = v)), len(list_filter(g, lambda x: x = v))))), 0)::DOUBLE AS c FROM k)
SELECT conv_id, turn, round(CASE WHEN n = 0 AND m = 0 THEN 1 WHEN n = 0 OR m = 0 OR c = 0 THEN 0 ELSE 2 * (c / n) * (c / m) / (c / n + c / m + {eps}) END, 6)::DOUBLE AS f1 FROM o"""


@_query(_f1_sql("g", "1e-12"))
def token_f1_g(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(M.token_f1(F.col("p"), F.col("g")), 6).alias("f1"))


@_query(_f1_sql("m", "0"))
def token_f1_m(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(M.token_f1(F.col("p"), F.col("g"), light=True), 6).alias("f1"))


def _bleu_sql(tokens: str, smooth: int = 1) -> str:
    grams = "\n".join(f", g{n} AS (SELECT conv_id, turn, sum(least(a, b)) AS hit FROM (SELECT conv_id, turn, x, count(*) AS a FROM (SELECT conv_id, turn, array_to_string(p[i : i + {n - 1}], chr(1)) AS x FROM (SELECT conv_id, turn, p, unnest(range(1, greatest(len(p) - {n} + 2, 1))) AS i FROM k)) GROUP BY ALL) JOIN (SELECT conv_id, turn, x, count(*) AS b FROM (SELECT conv_id, turn, array_to_string(g[i : i + {n - 1}], chr(1)) AS x FROM (SELECT conv_id, turn, g, unnest(range(1, greatest(len(g) - {n} + 2, 1))) AS i FROM k)) GROUP BY ALL) USING (conv_id, turn, x) GROUP BY ALL)" for n in range(1, 5))
    ratio = lambda n: f"((coalesce(g{n}.hit, 0) + {smooth}) / (c - {n - 1} + {smooth}))"
    zero = "c < 4 OR r = 0" + ("" if smooth else "".join(f" OR coalesce(g{n}.hit, 0) = 0" for n in range(1, 5)))
    return f""", k AS (SELECT conv_id, turn, {_of(tokens, 'p')} AS p, {_of(tokens, 'g')} AS g FROM w) {grams}, l AS (SELECT conv_id, turn, len(p) AS c, len(g) AS r FROM k)
SELECT l.conv_id, l.turn, round(CASE WHEN {zero} THEN 0 ELSE (CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END) * exp(({' + '.join(f'ln({ratio(n)})' for n in range(1, 5))}) / 4) END, 6)::DOUBLE AS bleu
FROM l {' '.join(f'LEFT JOIN g{n} ON g{n}.conv_id = l.conv_id AND g{n}.turn = l.turn' for n in range(1, 5))}"""


@_query(TURNS_SQL + _bleu_sql(TOKENS["g"]))
def bleu4_g(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(M.bleu4(F.col("p"), F.col("g")), 6).alias("bleu"))


@_query(TURNS_SQL + _bleu_sql("regexp_extract_all(" + LIGHT + ", '[a-z0-9]+')"))
def bleu4_m(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(M.bleu4(F.col("p"), F.col("g"), light=True), 6).alias("bleu"))


@_query(TURNS_SQL + _bleu_sql("list_filter(string_split(array_to_string(" + TOKENS["g"] + ", ' '), ''), lambda x: x <> '')", 0))
def char_bleu(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(M.char_bleu(F.col("p"), F.col("g")), 6).alias("bleu"))


def _answers_sql(turns: str, kind: str, eps: str) -> str:
    f1 = _f1_sql(kind, eps).replace(TURNS_SQL, "", 1).lstrip(", ").replace("k AS (", "WITH k AS (", 1)
    exact = f"""SELECT conv_id, turn, CASE WHEN lg <> '' AND lp = lg THEN 1.0 ELSE 0.0 END::DOUBLE AS em, CASE WHEN lg <> '' AND contains(lp, lg) THEN 1.0 ELSE 0.0 END::DOUBLE AS contains
    FROM (SELECT conv_id, turn, {LIGHT.format('p')} AS lp, {LIGHT.format('g')} AS lg FROM w)"""
    return turns + f""", x AS ({exact}), y AS ({f1}), xm AS (SELECT conv_id, turn, max(em) AS em, max(contains) AS contains FROM x GROUP BY ALL), ym AS (SELECT conv_id, turn, max(f1) AS f1 FROM y GROUP BY ALL)
SELECT conv_id, turn, em, contains, f1 FROM xm JOIN ym USING (conv_id, turn)"""


@_query(_answers_sql(GOLDS_SQL, "m", "0"))
def score_best(spark, sf):
    return M.score_answers(_two_golds(spark, sf), "best").select("conv_id", "turn", "em", "contains", F.round("f1", 6).alias("f1"))


@_query(_answers_sql(JOINED_SQL, "g", "1e-12"))
def score_joined(spark, sf):
    return M.score_answers(_two_golds(spark, sf), "joined", light=False).select("conv_id", "turn", "em", "contains", F.round("f1", 6).alias("f1"))


@_query("SELECT avg((quality = toxic)::INTEGER) AS accuracy, count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0) AS precision, count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1), 0) AS recall, 2 * count(*) FILTER (quality = 1 AND toxic = 1) / (count(*) FILTER (toxic = 1) + count(*) FILTER (quality = 1)) AS f1 FROM labels".replace("SELECT avg", "SELECT round(avg").replace(" AS accuracy,", ", 9) AS accuracy, round(").replace(" AS precision,", ", 9) AS precision, round(").replace(" AS recall,", ", 9) AS recall, round(").replace(" AS f1", ", 9) AS f1"))
def closed_metrics(spark, sf):
    rows = _t(spark, sf, "labels").agg(*M.closed_metrics(F.col("quality"), F.col("toxic")))
    return rows.select(*[F.round(c, 9).alias(c) for c in rows.columns])


@_query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS answer FROM orders WHERE o_orderstatus IN ('F', 'O')")
def closed_answer_filter(spark, sf):
    from .sources.readers import closed_answer

    said = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "FALSE").otherwise("maybe")
    return _t(spark, sf, "orders").select("o_orderkey", closed_answer(said)[0].alias("answer")).where("answer is not null")


@_query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def answer_distribution(spark, sf):
    return M.distribution(_t(spark, sf, "conversations"), "role")


@_query("SELECT round(100.0 * avg(CASE WHEN replace(replace(replace(trim(lower(n_name)), 'a ', ''), 'an ', ''), 'the ', '') = replace(replace(replace(trim(lower(CASE WHEN n_nationkey % 2 = 0 THEN 'the ' || n_name ELSE n_name || 'x' END)), 'a ', ''), 'an ', ''), 'the ', '') THEN 1.0 ELSE 0 END), 6)::DOUBLE AS accuracy FROM nation")
def fvqa_accuracy(spark, sf):
    other = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("the "), "n_name")).otherwise(F.concat("n_name", F.lit("x")))
    return _t(spark, sf, "nation").agg(M.lenient_accuracy(F.col("n_name"), other)).select(F.round("accuracy", 6).alias("accuracy"))


_LETTER = "chr(CAST(65 + conv_id % 5 AS INTEGER))"


@_query(f"SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'FAILED' ELSE {_LETTER} END AS letter FROM conversations")
def answer_extract(spark, sf):
    letter = F.char(65 + F.col("conv_id") % 5)
    said = F.when(F.col("turn") % 3 == 2, F.lit("no idea")).otherwise(F.concat(F.lit("Well. The answer is "), letter, F.lit(".")))
    return _t(spark, sf, "conversations").select("conv_id", "turn", T.extract_letter(said).alias("letter"))


@_query("SELECT round(100.0 * avg(CASE WHEN conv_id % 5 = turn % 5 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS accuracy FROM conversations")
def mcq_accuracy(spark, sf):
    letter = F.char(65 + F.col("conv_id") % 5)
    pred = T.letter_index(letter, F.lit(5), F.col("conv_id").cast("string"))
    return _t(spark, sf, "conversations").agg(M.choice_accuracy(pred, (F.col("turn") % 5).cast("int"))).select(F.round("accuracy", 6).alias("accuracy"))


# --- prompts, paths, seeds ----------------------------------------------------------------------


@_query(KG_SQL + f", r AS (SELECT CAST(substr(tail_id, 2) AS INTEGER) AS qid, head_text, rel_text, tail_text, row_number() OVER (PARTITION BY tail_id ORDER BY doc_id) AS rank FROM kg) SELECT qid, '{P.EVIDENCE['G']}' || chr(10) || string_agg('Triplet ' || rank || ': (head, relation, tail) = (' || head_text || ', ' || rel_text || ', ' || tail_text || ')', chr(10) ORDER BY rank) AS prompt FROM r WHERE rank <= 5 GROUP BY qid")
def rag_prompt(spark, sf):
    mm, _ = _mm_text(spark, sf)
    ranked = V.rank_scores(mm["qrels"].select("qid", "doc_id", F.lit(0.0).alias("score")), 5, item="doc_id")
    return P.evidence(ranked, mm["corpus"]).select("qid", P.flat(F.col("evidence")).alias("prompt"))


def _mcq_sql(fmt: str, test: bool, table: str) -> str:
    """One example in SQL; part's name, brand, type and container-free texts stand for question, hint and reasons."""
    because = {"L": "'BECAUSE: ' || lec || chr(10)", "E": "'BECAUSE: ' || sol || chr(10)", "LE": "'BECAUSE: ' || lec || ' ' || sol || chr(10)"}
    line = {"C": "'Context: ' || ctx || chr(10)", "Q": "'Question: ' || p_name || chr(10)", "M": "'Options: (A) ' || p_brand || ' (B) ' || p_type || chr(10)", **because}
    shown, said = fmt.split("-")
    letters = {"QCMLE": ["Q", "C", "M", "LE"], "QCLEM": ["Q", "C", "LE", "M"]}.get(shown, list(shown))
    answer = "'The answer is ' || (CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END) || '.'"
    reasons = {"A": "", "AL": "sol", "AE": "lec", "ALE": "lec || ' ' || sol", "AEL": "sol || ' ' || lec", "LA": "lec", "EA": "sol", "LEA": "lec || ' ' || sol", "ELA": "sol || ' ' || lec"}[said]
    out = "'Answer:'" if test else f"'Answer: ' || {answer}" if said == "A" else f"'Answer: ' || {answer} || ' BECAUSE: ' || {reasons}" if said[0] == "A" else f"'Answer: ' || {reasons} || ' ' || {answer}"
    body = ("'Now, please answer the question.' || " if test else "") + " || ".join(line[x] for x in letters) + f" || {out}"
    return f"SELECT p_partkey, trim(replace({body}, '  ', ' ')) AS text FROM {table}"


MCQ_SQL = """WITH b AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, CASE WHEN p_size % 3 = 0 THEN 'size ' || p_size ELSE 'N/A' END AS ctx, 'all ' || p_brand || chr(92) || 'n are alike' AS lec, 'it is  ' || p_type AS sol FROM part)
"""


@_query(MCQ_SQL + " UNION ALL ".join(
    f"SELECT CAST(t.p_partkey AS VARCHAR) AS pid, '{fmt}' AS format, md5(s.shots || chr(10) || chr(10) || t.text) AS digest FROM ({_mcq_sql(fmt, True, 'b')}) t, (SELECT string_agg(text, chr(10) || chr(10) ORDER BY p_partkey) AS shots FROM ({_mcq_sql(fmt, False, 'b')}) WHERE p_partkey <= 3) s"
    for fmt in P.FORMATS))
def mcq_prompt(spark, sf):
    """Every part as a problem in all formats, after the stated shots (parts 1 to 3)."""
    size = F.col("p_size")
    problems = _t(spark, sf, "part").select(
        "p_partkey", F.col("p_partkey").cast("string").alias("pid"), F.col("p_name").alias("question"), F.array("p_brand", "p_type").alias("choices"), (size % 2).cast("int").alias("answer"),
        F.when(size % 3 == 0, F.concat(F.lit("size "), size.cast("string"))).otherwise("").alias("hint"), F.concat(F.lit("all "), "p_brand", F.lit("\n are alike")).alias("lecture"), F.concat(F.lit("it is  "), "p_type").alias("solution"),
    )
    shots, out = problems.where("p_partkey <= 3").withColumn("pos", F.col("p_partkey")), None
    for fmt in P.FORMATS:
        rows = P.few_shot(problems, shots, fmt).select("pid", F.lit(fmt).alias("format"), F.md5("prompt").alias("digest"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query("SELECT page_id, array_to_string(list_filter(string_split(replace(url, chr(92), '/'), '/'), lambda x: x <> '')[-2:], '/') AS path FROM pages")
def path_rewrite(spark, sf):
    return _t(spark, sf, "pages").select("page_id", T.short_path(F.col("url")).alias("path"))


@_query("SELECT a.doc_id, CASE WHEN a.doc_id % 2 = 0 THEN '/img/' || a.doc_id || '.jpg' END AS query_image_path FROM labels a")
def image_map_join(spark, sf):
    queries = _t(spark, sf, "labels").select("doc_id", F.concat(F.lit(" H"), F.col("doc_id").cast("string")).alias("head_id"))
    images = _t(spark, sf, "labels").where("doc_id % 2 = 0").select(F.concat(F.lit("H"), F.col("doc_id").cast("string")).alias("image_id"), F.concat(F.lit("/img/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    return D.image_by_head(queries, images).select("doc_id", "query_image_path")


@_query("""WITH f AS (SELECT page_id % 40 AS e, page_id % 3 AS k, CASE page_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' ELSE '.webp' END AS ext, page_id % 4 AS er, page_id FROM pages),
g AS (SELECT 'E' || e AS entity_id, CASE WHEN k = 0 THEN '/root_dir/E' || e || ext ELSE '/root_dir/E' || e || '/' || lpad(CAST(page_id AS VARCHAR), 6, '0') || ext END AS path, CASE WHEN k = 0 THEN 0 ELSE 1 END AS kind, CASE WHEN k = 0 THEN er ELSE 0 END AS er FROM f)
SELECT entity_id, arg_min(path, lpad(CAST(kind * 10 + er AS VARCHAR), 3, '0') || path) AS path FROM g GROUP BY entity_id""")
def image_resolution(spark, sf):
    from .sources.readers import entity_images

    p = _t(spark, sf, "pages")
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".jpeg", ".png", ".webp"))), (F.col("page_id") % 4 + 1).cast("int"))
    entity = F.concat(F.lit("E"), (F.col("page_id") % 40).cast("string"))
    top = F.col("page_id") % 3 == 0
    name = F.when(top, F.concat(entity, ext)).otherwise(F.concat(F.lpad(F.col("page_id").cast("string"), 6, "0"), ext))
    files = p.select(F.when(top, F.concat(F.lit("/root_dir/"), name)).otherwise(F.concat(F.lit("/root_dir/"), entity, F.lit("/"), name)).alias("path"), name.alias("name"), F.when(top, "root_dir").otherwise(entity).alias("folder"), ext.alias("ext"))
    return entity_images(files, "root_dir")


@_query("SELECT doc_id, CAST(('0x' || substr(sha1('aug::' || doc_id), 1, 8)) AS BIGINT) AS seed FROM labels")
def seed_u32(spark, sf):
    return _t(spark, sf, "labels").select("doc_id", T.seed_u32(F.concat(F.lit("aug::"), F.col("doc_id").cast("string"))).alias("seed"))


@_query("SELECT doc_id, CAST(list_reduce(list_transform(string_split(sha1('mm::' || doc_id), ''), lambda d: CAST(instr('0123456789abcdef', d) - 1 AS BIGINT)), lambda a, d: (a * 16 + d) % 2147483647) AS BIGINT) AS seed FROM labels")
def seed_mod(spark, sf):
    return _t(spark, sf, "labels").select("doc_id", T.seed_mod(F.concat(F.lit("mm::"), F.col("doc_id").cast("string"))).alias("seed"))


@_query(KG_SQL + "SELECT CAST(substr(tail_id, 2) AS INTEGER) AS qid, arg_min('/x/images/' || head_id || '/1.jpg', doc_id) AS image_path FROM kg GROUP BY tail_id")
def first_relevant_image(spark, sf):
    mm, _ = _mm_text(spark, sf)
    return D.first_relevant_image(mm["qrels"], mm["corpus"])


@_query("SELECT item_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM benchmark".replace("\\\\", "\\"))
def light_normalise(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", F.sha2(T.light_normalise(F.col("text")), 256).alias("digest"))


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    from .streaming.incremental import windowed_counts

    return windowed_counts(_t(spark, sf, "events")).withColumn("total", F.round("total", 4))


from . import file_queries  # noqa: E402, F401 (registers its queries here)
