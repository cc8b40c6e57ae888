"""Queries of sources, sinks, injected models, prompts and string functions, each over whole tables of the driver.

File formats are written from a table to the shared folder and read back
through the reader under test; the SQL works on the table itself.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import models as X
from .functions import text as T
from .functions import vector as V
from .functions.tables import new_path
from .operators import dataset as D
from .operators import metrics as M
from .operators import prompts as P
from .operators import retrieve as R
from .plans import evaluation as E
from .queries import KG_SQL, PAIRS_SQL, QUERIES, RANKED_SQL, _answers_sql, _kg, _mm_text, _pairs, _query, _t
from .queries import METRIC_SQL as _METRICS
from .sources import readers as S
from .sources import sinks as K


def _write_lines(df: DataFrame, path: str, *order: str) -> str:
    """Text lines in order: files by name, lines within them."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
    return path


def _say(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# --- sources and sinks --------------------------------------------------------------------------


@_query("SELECT doc_id, lang, n_chars, md5(coalesce(text, '')) AS digest FROM documents")
def jsonl_scan(spark, sf):
    path = new_path(spark, "documents-jsonl")
    K.write_jsonl(_t(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text"), "doc_id", path)
    rows = S.jsonl(spark, path, "doc_id LONG, lang STRING, n_chars LONG, text STRING")
    return rows.select("doc_id", "lang", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@_query("SELECT CAST(doc_id AS INTEGER) AS qid, '[IMAGE] q' || quality AS query, toxic = 1 AS is_multimodal, 'tail' AS masked_type FROM labels")
def keyed_queries(spark, sf):
    """Each id twice and a blank line between: the last line wins."""
    old = F.to_json(F.struct(F.col("doc_id").alias("qid"), F.lit("old").alias("query")))
    new = F.to_json(F.struct(F.col("doc_id").alias("qid"), _say("[IMAGE] q", "quality").alias("query"), (F.col("toxic") == 1).alias("is_multimodal"), F.lit("tail").alias("masked_type"), F.lit(1).alias("unknown")))
    lines = _t(spark, sf, "labels").select("doc_id", F.posexplode(F.array(old, F.lit("  "), new)).alias("n", "line"))
    return S.queries(spark, _write_lines(lines, new_path(spark, "queries-jsonl"), "doc_id", "n")).select("qid", "query", "is_multimodal", "masked_type")


@_query(KG_SQL + "SELECT CAST(doc_id AS INTEGER) AS doc_id, head_id, rel_id, tail_id, head_text, rel_text, tail_text FROM kg2")
def keyed_corpus(spark, sf):
    path = new_path(spark, "corpus-jsonl")
    K.write_jsonl(_kg(spark, sf, "customer"), "doc_id", path)
    return S.corpus(spark, path).drop("triplet_text", "image_path")


@_query("SELECT CAST(doc_id AS INTEGER) AS qid, CAST(quality + 1 AS INTEGER) AS doc_id, CAST(toxic AS INTEGER) AS rel FROM labels")
def qrels_file(spark, sf):
    path = new_path(spark, "qrels-tsv")
    K.write_qrels(_t(spark, sf, "labels").select(F.col("doc_id").alias("qid"), (F.col("quality") + 1).alias("doc_id"), F.col("toxic").alias("rel")), path)
    return S.qrels(spark, path).select("qid", "doc_id", "rel")


@_query("SELECT CAST(c_custkey AS INTEGER) AS qid, CAST(c_nationkey AS INTEGER) AS doc_id, 3 AS rel FROM customer")
def qrels_any_blanks(spark, sf):
    """Uneven white space, surplus fields, and an earlier judgement of the same pair."""
    said = lambda rel: F.concat_ws(" ", F.lit(" "), F.col("c_custkey").cast("string"), F.lit("\t"), F.col("c_nationkey").cast("string"), F.lit(f"  {rel} more"))
    lines = _t(spark, sf, "customer").select("c_custkey", F.posexplode(F.array(said(1), F.lit(""), said(3))).alias("n", "line"))
    return S.qrels(spark, _write_lines(lines, new_path(spark, "qrels-text"), "c_custkey", "n")).select("qid", "doc_id", "rel")


@_query("SELECT 'I' || s_suppkey AS image_id, CASE WHEN s_suppkey % 2 = 0 THEN '/abs/' ELSE '/root/img/' END || s_suppkey || '.jpg' AS path FROM supplier WHERE s_suppkey % 7 <> 0")
def image_map_file(spark, sf):
    path = new_path(spark, "images-csv")
    place = F.when(F.col("s_suppkey") % 7 == 0, " ").otherwise(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "/abs/").otherwise("img/"), F.col("s_suppkey").cast("string"), F.lit(".jpg ")))
    _t(spark, sf, "supplier").select(_say(" I", "s_suppkey").alias("IID"), place.alias("Image_Path")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.image_map(spark, path, prefix="/root")


@_query("SELECT 'N' || n_nationkey AS head, n_name AS head_name, 'in' AS relation, 'R' || n_regionkey AS tail, CASE WHEN n_regionkey = 0 THEN 'nan' ELSE r_name END AS tail_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def kg_csv_file(spark, sf):
    path = new_path(spark, "kg-csv")
    rows = _t(spark, sf, "nation").join(F.broadcast(_t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows.select(_say("N", "n_nationkey").alias("Head"), F.col("n_name").alias("Head_Name"), F.lit("in").alias("Relation"), _say("R", "n_regionkey").alias("Tail"), F.when(F.col("n_regionkey") != 0, F.col("r_name")).alias("Tail_Name")).write.option("header", True).csv(path)
    return S.kg_csv(spark, path)


@_query(KG_SQL + "SELECT head_id AS head, rel_id AS relation, tail_id AS tail FROM kg2")
def triplets_file(spark, sf):
    kg = _kg(spark, sf, "customer").select("doc_id", F.posexplode(F.array(F.lit(""), F.concat_ws("\t", F.concat(F.lit("  "), "head_id"), "rel_id", "tail_id"))).alias("n", "line"))
    return S.triplets_txt(spark, _write_lines(kg, new_path(spark, "triplets-txt"), "doc_id", "n"), strict=True).drop("line_no")


@_query("SELECT 'P' || p_partkey AS id, p_name || ' ' || p_brand AS text FROM part")
def id_text_file(spark, sf):
    """Further fields are joined by blanks, the last of equal ids wins."""
    lines = _t(spark, sf, "part").select("p_partkey", F.posexplode(F.array(F.concat_ws("\t", _say("P", "p_partkey"), F.lit("old")), F.concat_ws("\t", _say("P", "p_partkey"), "p_name", "p_brand"))).alias("n", "line"))
    return S.id_text(spark, _write_lines(lines, new_path(spark, "id-text"), "p_partkey", "n"))


@_query("SELECT 'P' || p_partkey AS id, p_name AS text FROM part")
def id_text_strict(spark, sf):
    lines = _t(spark, sf, "part").select("p_partkey", F.concat_ws("\t", _say("P", "p_partkey"), "p_name").alias("line"))
    return S.id_text(spark, _write_lines(lines, new_path(spark, "id-text-strict"), "p_partkey"), strict=True)


@_query("SELECT p_partkey, p_name, p_size FROM part")
def tsv_file(spark, sf):
    path = new_path(spark, "part-tsv")
    _t(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.option("sep", "\t").csv(path)
    return S.tsv(spark, path, "p_partkey LONG, p_name STRING, p_size INT")


@_query("SELECT 'C' || c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer")
def id_list_file(spark, sf):
    return S.id_list(spark, _write_lines(_t(spark, sf, "customer").select("c_custkey", _say(" C", "c_custkey").alias("line")), new_path(spark, "ids"), "c_custkey"))


def _object(df: DataFrame, key: Column, value: Column, path: str, field: str | None = None) -> None:
    """One JSON object of a small dimension table as a whole file."""
    entries = F.map_from_entries(F.collect_list(F.struct(key, value)))
    df.agg(F.to_json(F.struct(entries.alias(field)) if field else entries).alias("line")).select("line").write.text(path)


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS key, 'where is ' || n_name || '?' AS question, 'R' || n_regionkey AS answer FROM nation")
def json_object_file(spark, sf):
    path = new_path(spark, "questions-json")
    _object(_t(spark, sf, "nation"), F.col("n_nationkey").cast("string"), F.struct(F.concat(F.lit("where is "), "n_name", F.lit("?")).alias("question"), _say("R", "n_regionkey").alias("answer"), F.lit("x.jpg").alias("img_file")), path)
    return S.json_object(spark, path, "STRUCT<question: STRING, answer: STRING, img_file: STRING>").select("key", "value.question", "value.answer")


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS pid, CASE WHEN n_nationkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, n_name AS question, CAST(n_regionkey AS INTEGER) AS answer, CASE WHEN n_nationkey % 2 = 0 THEN 'a map of ' || n_name ELSE '' END AS caption FROM nation")
def problems_files(spark, sf):
    folder, rows, pid = new_path(spark, "problems"), _t(spark, sf, "nation"), F.col("n_nationkey").cast("string")
    empty = F.lit("")
    _object(rows, pid, F.struct(F.col("n_name").alias("question"), F.array(F.lit("x"), F.lit("y")).alias("choices"), F.col("n_regionkey").cast("int").alias("answer"), empty.alias("hint"), empty.alias("lecture"), empty.alias("solution")), f"{folder}/problems.json")
    splits = rows.groupBy(F.when(F.col("n_nationkey") % 3 == 0, "test").otherwise("train").alias("split")).agg(F.collect_list(pid).alias("ids"))
    _object(splits, F.col("split"), F.col("ids"), f"{folder}/pid_splits.json")
    _object(rows.where("n_nationkey % 2 = 0"), pid, F.concat(F.lit("a map of "), "n_name"), f"{folder}/captions.json", "captions")
    return S.problems(spark, folder).select("pid", "split", "question", "answer", "caption")


@_query("SELECT page_id, md5(html) AS digest FROM pages")
def hub_snapshot(spark, sf):
    return S.snapshot(spark, f"{sf}/pages.parquet").select("page_id", F.md5("html").alias("digest"))


def _json_array(df: DataFrame, path: str) -> str:
    """A small dimension table as one JSON array."""
    df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("line")).write.text(path)
    return path


_SAID = "CASE n_nationkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN ' No' ELSE n_name END"


def _said() -> Column:
    return F.when(F.col("n_nationkey") % 3 == 0, "yes").when(F.col("n_nationkey") % 3 == 1, " No").otherwise(F.col("n_name"))


@_query(f"SELECT '/imgs/' || n_nationkey || '.jpg' AS image_path, n_name AS question, CASE n_nationkey % 3 WHEN 0 THEN 1 ELSE 0 END AS answer_close, CAST(NULL AS VARCHAR) AS answer_open, trim(lower({_SAID})) AS answer_text, 'slake' AS dataset FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 2")
def slake_closed(spark, sf):
    n = _t(spark, sf, "nation")
    name = F.concat(F.col("n_nationkey").cast("string"), F.lit(".jpg"))
    path = _json_array(n.select(F.when(F.col("n_nationkey") % 5 == 0, "zh").otherwise("en").alias("q_lang"), F.col("n_name").alias("question"), _said().alias("answer"), name.alias("img_name")), new_path(spark, "slake"))
    images = n.where("n_nationkey % 4 <> 0").select(F.concat(F.lit("/imgs/"), name).alias("path"))
    return S.slake(spark, path, True, images, "/imgs")


@_query(f"""WITH h AS (SELECT *, row_number() OVER (ORDER BY sha1('42::' || n_nationkey || '.jpg::' || n_name || '::' || {_SAID})) - 1 AS i, count(*) OVER () AS n FROM nation)
SELECT CASE WHEN i < floor(n * 0.9) THEN 'train' ELSE 'val' END AS part, n_nationkey || '.jpg' AS image_path, n_name AS question, trim(lower({_SAID})) AS answer_text FROM h WHERE n_nationkey % 3 = 2""")
def vqa_rad_cut(spark, sf):
    """The exact nine-to-one cut; the open answers of both parts."""
    rows = _t(spark, sf, "nation").select(F.col("n_name").alias("question"), _said().alias("answer"), F.concat(F.col("n_nationkey").cast("string"), F.lit(".jpg")).alias("image_name"))
    path = _json_array(rows, new_path(spark, "vqa-rad"))
    parts = [S.vqa_rad(spark, path, False, part).select(F.lit(part).alias("part"), "image_path", "question", "answer_text") for part in ("train", "val")]
    return parts[0].unionByName(parts[1])


@_query("SELECT p_name AS question, hex(encode(p_brand)) AS image, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS answer_close FROM part WHERE p_partkey % 3 <> 2")
def path_vqa_file(spark, sf):
    folder = new_path(spark, "path-vqa")
    said = F.when(F.col("p_partkey") % 3 == 0, "TRUE ").when(F.col("p_partkey") % 3 == 1, "no").otherwise("maybe")
    _t(spark, sf, "part").select(F.struct(F.col("p_brand").cast("binary").alias("bytes"), F.lit("x").alias("path")).alias("image"), F.col("p_name").alias("question"), said.alias("answer")).write.parquet(f"{folder}/validation")
    return S.path_vqa(spark, folder, "val", True).select("question", F.hex("image").alias("image"), "answer_close")


_FILES_SQL = """WITH f AS (SELECT '/root_dir/E' || page_id % 40 || '/' || lpad(CAST(page_id AS VARCHAR), 6, '0') || CASE page_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.bmp' ELSE '.txt' END AS path, 'E' || page_id % 40 AS e, page_id % 3 AS k FROM pages)
"""


def _files(spark, sf):
    ext = F.when(F.col("page_id") % 3 == 0, ".jpg").when(F.col("page_id") % 3 == 1, ".bmp").otherwise(".txt")
    entity = F.concat(F.lit("E"), (F.col("page_id") % 40).cast("string"))
    name = F.concat(F.lpad(F.col("page_id").cast("string"), 6, "0"), ext)
    return _t(spark, sf, "pages").select(F.concat(F.lit("/root_dir/"), entity, F.lit("/"), name).alias("path"), name.alias("name"), entity.alias("folder"), ext.alias("ext"))


@_query(_FILES_SQL + "SELECT e AS entity_id, min(path) AS path FROM f WHERE k = 0 GROUP BY e")
def image_resolution_strict(spark, sf):
    return S.entity_images(_files(spark, sf), "root_dir", strict=True)


@_query(_FILES_SQL + ", g AS (SELECT e, string_agg(path, '|' ORDER BY path) AS others FROM f WHERE k < 2 GROUP BY e) SELECT path, others FROM f JOIN g USING (e) WHERE k < 2")
def folder_listing(spark, sf):
    return S.folder_images(_files(spark, sf)).withColumn("others", F.array_join("others", "|"))


@_query("SELECT 'E' || vec_id AS entity_id, len(embedding) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def visual_features_file(spark, sf):
    path = new_path(spark, "features")
    _t(spark, sf, "embeddings").select(_say("E", "vec_id").alias("entity_id"), F.col("embedding").alias("features")).write.parquet(path)
    return S.visual_features(spark, path).select("entity_id", F.size("features").cast("long").alias("width"), F.round(F.get("features", F.lit(0)).cast("double"), 6).alias("first"))


@_query(KG_SQL + "SELECT 'mm' AS side, CAST(substr(tail_id, 2) AS INTEGER) AS qid, CAST(doc_id AS INTEGER) AS doc_id, 1 AS rel FROM kg UNION ALL SELECT 'text', CAST(substr(tail_id, 2) AS INTEGER), CAST(doc_id AS INTEGER), 1 FROM kg2")
def split_folder(spark, sf):
    """The six files of a split folder, written and loaded again."""
    folder = new_path(spark, "splits")
    tables = {f"{side}_{kind}": df for side, tables in zip(("mm", "text"), _mm_text(spark, sf), strict=True) for kind, df in tables.items()}
    K.write_splits({"val": tables}, folder, {"val": "valid"})
    loaded = S.load_split(spark, f"{folder}/valid", need="both")
    return loaded["mm_qrels"].select(F.lit("mm").alias("side"), "qid", "doc_id", "rel").unionByName(loaded["text_qrels"].select(F.lit("text").alias("side"), "qid", "doc_id", "rel"))


@_query(KG_SQL + """, q AS (SELECT DISTINCT 'mm' AS side, CAST(substr(tail_id, 2) AS INTEGER) AS qid FROM kg UNION ALL SELECT DISTINCT 'text', CAST(substr(tail_id, 2) AS INTEGER) FROM kg2),
m AS (SELECT *, CASE WHEN side = 'mm' THEN qid ELSE qid + (SELECT max(qid) + 1 FROM q WHERE side = 'mm') END AS merged FROM q),
h AS (SELECT *, row_number() OVER (ORDER BY sha1('markg_v1::' || merged)) - 1 AS i, count(*) OVER () AS n FROM m)
SELECT side, qid, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM h""")
def splits_by_modality(spark, sf):
    out = None
    for split, tables in E.make_splits(*_mm_text(spark, sf)).items():
        for side in ("mm", "text"):
            rows = tables[f"{side}_queries"].select(F.lit(side).alias("side"), "qid", F.lit(split).alias("split"))
            out = rows if out is None else out.unionByName(rows)
    return out


@_query("SELECT doc_id, lang, hex(encode(source)) AS source FROM documents")
def json_log(spark, sf):
    """Records with a binary column, below a name that is no file name."""
    rows = _t(spark, sf, "documents").select("doc_id", "lang", F.col("source").cast("binary").alias("source"))
    path = K.write_log(rows, new_path(spark, "logs"), "mm only/k=5: retrieved")
    return spark.read.schema("doc_id LONG, lang STRING, source STRING").json(path).withColumn("source", F.hex(F.unbase64("source")))


@_query(_METRICS + """, a AS (SELECT CAST(k AS INTEGER) AS k, avg(ndcg) AS ndcg, avg(precision) AS precision, avg(recall) AS recall FROM m GROUP BY k)
SELECT string_agg(printf('K=%d NDCG=%.4f P=%.4f R=%.4f', k, round(ndcg, 6), round(precision, 6), round(recall, 6)), chr(10) ORDER BY k) AS text,
string_agg(printf('%.2f', 100 * round(ndcg, 6)), ' & ' ORDER BY k) || ' & ' || string_agg(printf('%.2f', 100 * round(precision, 6)), ' & ' ORDER BY k) || ' & ' || string_agg(printf('%.2f', 100 * round(recall, 6)), ' & ' ORDER BY k) AS latex FROM a""")
def retrieval_report(spark, sf):
    made = K.metrics_report(QUERIES["retrieval_metrics"](spark, sf).collect(), "all", "dense")
    assert json.loads(made["json"])["retriever"] == "dense"
    return spark.createDataFrame([(made["text"], made["latex"])], "text string, latex string")


@_query("SELECT 'E' || doc_id AS key, 'caption ' || doc_id AS caption FROM labels")
def caption_cache_file(spark, sf):
    """Overlapping appends leave one row a key."""
    path = new_path(spark, "captions")
    rows = _t(spark, sf, "labels").select(_say("E", "doc_id").alias("key"), _say("caption ", "doc_id").alias("caption"))
    K.append_cache(rows.where("key < 'E5'"), "key", path)
    K.append_cache(rows, "key", path)
    return spark.read.parquet(path)


@_query("SELECT p_partkey, p_size * 2 AS twice FROM part")
def resumed_evaluation(spark, sf):
    path, todo = new_path(spark, "results"), _t(spark, sf, "part").select("p_partkey", "p_size")
    work = lambda d: d.select("p_partkey", (F.col("p_size") * 2).alias("twice"))
    K.resume(todo.where("p_partkey % 2 = 0"), path, "p_partkey", work)
    return K.resume(todo, path, "p_partkey", work)


# --- injected models ----------------------------------------------------------------------------

_VOWELS = "aeio"


def _vowel_counts():
    """An encoder that SQL can repeat: how often four letters occur."""

    def encode(items):
        return np.array([[x.count(c if isinstance(x, str) else c.encode()) for c in _VOWELS] for x in items], np.float32)

    return encode


def _counts_sql(column: str) -> str:
    return ", ".join(f"CAST(length({column}) - length(replace({column}, '{c}', '')) AS BIGINT) AS n_{c}" for c in _VOWELS)


def _counts(emb: str) -> list[Column]:
    return [F.get(emb, F.lit(i)).cast("long").alias(f"n_{c}") for i, c in enumerate(_VOWELS)]


@_query(f"SELECT doc_id, {_counts_sql('text')} FROM documents")
def text_embedding(spark, sf):
    return X.embed(_t(spark, sf, "documents").select("doc_id", "text"), "text", _vowel_counts).select("doc_id", *_counts("emb"))


@_query(f"SELECT doc_id, {_counts_sql('text')} FROM documents")
def text_embedding_cached(spark, sf):
    """Half of the rows first, then all: the second run encodes only what the cache lacks."""
    path, rows = new_path(spark, "embeddings"), _t(spark, sf, "documents").select("doc_id", "text")
    X.cached_embed(rows.where("doc_id % 2 = 0"), "text", _vowel_counts, "m", "t", path)
    return X.cached_embed(rows, "text", _vowel_counts, "m", "t", path).select("doc_id", *_counts("emb"))


def _image_rows(spark, sf):
    """Pages as entity images: every fifth has no content."""
    return _t(spark, sf, "pages").select(_say("E", "page_id").alias("entity_id"), F.concat(F.lit("/i/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("path"), F.length("url").cast("long").alias("length"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("modificationTime"), F.when(F.col("page_id") % 5 != 0, F.col("url").cast("binary")).alias("content"))


@_query(f"SELECT 'E' || page_id AS entity_id, {_counts_sql('url')} FROM pages WHERE page_id % 5 <> 0")
def entity_image_cache(spark, sf):
    path, rows = new_path(spark, "entity-images"), _image_rows(spark, sf)
    X.cached_entity_images(rows.where("length(entity_id) < 4"), _vowel_counts, "m", path)
    return X.cached_entity_images(rows, _vowel_counts, "m", path).select("entity_id", *_counts("emb"))


def _byte_counter():
    return lambda images: [f"{len(b)} bytes" for b in images]


@_query("SELECT 'E' || page_id AS entity_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE strlen(url) || ' bytes' END AS caption FROM pages")
def captions_by_entity(spark, sf):
    return X.cached_captions(_image_rows(spark, sf), _byte_counter, new_path(spark, "captions"), by_entity=True)


@_query("SELECT 'E' || page_id AS entity_id, strlen(url) || ' bytes' AS caption FROM pages WHERE page_id % 5 <> 0")
def captions_by_file(spark, sf):
    return X.cached_captions(_image_rows(spark, sf), _byte_counter, new_path(spark, "captions"))


@_query("SELECT p_partkey, trim(p_name) AS pred_text FROM part")
def language_model_call(spark, sf):
    asked = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit("Read this.\nQuestion: "), "p_name", F.lit("\nAnswer concisely.")).alias("prompt"))
    return X.generate(asked, "prompt", X.echo_model()).select("p_partkey", "pred_text")


def _reverse_order():
    """A model that ranks backwards and names something it was not offered."""
    return lambda prompt, request: json.dumps({"ranking": ["none", *sorted(request["properties"]["ranking"]["items"]["enum"], reverse=True)]})


@_query("SELECT p_partkey, array_to_string(list_reverse_sort(list_distinct([p_name, p_brand, p_type])), '|') AS ranking FROM part")
def candidate_ranking(spark, sf):
    asked = _t(spark, sf, "part").select("p_partkey", F.lit("rank").alias("prompt"), F.array("p_name", "p_brand", "p_type").alias("c"))
    return X.rank_candidates(asked, "prompt", "c", _reverse_order).select("p_partkey", F.array_join("ranking", "|").alias("ranking"))


def _word_lengths():
    return lambda text: [len(w) for w in text.split(" ")]


@_query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: length(x)), ',') AS ids FROM part")
def tokenised_features(spark, sf):
    path, rows = new_path(spark, "features"), _t(spark, sf, "part").select("p_partkey", "p_name")
    X.cached_features(rows, "p_name", _word_lengths, path)
    return X.cached_features(rows, "p_name", _word_lengths, path).select("p_partkey", F.array_join("input_ids", ",").alias("ids"))


def _segment_teller():
    return lambda segments, images: f"{len(segments)} {sum(map(len, images))} {segments[-1].get('text', '')}"


@_query("SELECT page_id, '2 ' || strlen(url) || ' what is ' || page_id || '?' AS pred_text FROM pages")
def vision_model_call(spark, sf):
    blocks = F.array(P.image_block(T.data_url(F.col("url").cast("binary"))), P.text_block(F.concat(F.lit("what is "), F.col("page_id").cast("string"), F.lit("?"))))
    return X.generate_segments(_t(spark, sf, "pages").select("page_id", blocks.alias("b")), "b", _segment_teller).select("page_id", "pred_text")


_LETTERS = "AEIORUNST0123456789"


def _letter_counts():
    """An encoder of more letters, for ranking."""

    def encode(items):
        return np.array([[x.count(c) for c in _LETTERS] for x in items], np.float32)

    return encode


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"CAST(length({text}) - length(replace({text}, '{c}', '')) AS DOUBLE)" for c in _LETTERS) + "]"


@_query(KG_SQL + f""", q AS (SELECT DISTINCT CAST(substr(tail_id, 2) AS INTEGER) AS qid, {_letters_sql("('[IMAGE] who is located in ' || tail_text)")} AS a FROM kg),
c AS (SELECT doc_id, CAST(substr(tail_id, 2) AS INTEGER) AS cl, {_letters_sql("(head_text || ' ' || rel_text || ' ' || tail_text)")} AS b FROM kg),
s AS (SELECT qid, doc_id, qid AS ql, cl, round(list_cosine_similarity(a, b), 9) AS score FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
""" + _METRICS[len(RANKED_SQL):].replace(" AND qid <> doc_id", "").replace(" AND r.qid <> r.doc_id", "") + "SELECT 'mm_only' AS setting, 'SimpleText' AS retriever, CAST(k AS INTEGER) AS k, round(avg(ndcg), 6) AS ndcg, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM m GROUP BY k")
def evaluate_text_retrieval(spark, sf):
    mm, _ = _mm_text(spark, sf)
    rows = E.evaluate_retrieval(mm, "SimpleText", "mm_only", load=_letter_counts, digits=9)
    return rows.select("setting", "retriever", "k", *[F.round(c, 6).alias(c) for c in ("ndcg", "precision", "recall")])


def _first_head():
    """A model that answers with the head of the first triplet of its evidence."""
    import re

    return lambda prompt: re.search(r"Triplet 1: .* = \(([^,]*),", prompt)[1]


@_query("SELECT 'mm_only' AS setting, count(*) AS n, round(avg(em), 6)::DOUBLE AS em, round(avg(f1), 6)::DOUBLE AS f1, round(avg(contains), 6)::DOUBLE AS contains FROM (" + _answers_sql(KG_SQL.rstrip() + ", w AS (SELECT tail_id AS conv_id, 0 AS turn, arg_min(head_text, doc_id) AS p, string_agg(head_text, chr(10) ORDER BY doc_id) AS g FROM kg GROUP BY tail_id)\n", "g", "1e-12") + ")")
def generation_scores(spark, sf):
    mm, _ = _mm_text(spark, sf)
    ranked = V.rank_scores(mm["qrels"].select("qid", "doc_id", F.lit(0.0).alias("score")), 5, item="doc_id")
    means = E.evaluate_generation(mm, ranked, _first_head, "mm_only")[1]
    return means.select("setting", "n", *[F.round(c, 6).alias(c) for c in ("em", "f1", "contains")])


# --- vectors ------------------------------------------------------------------------------------

_UNIT = "list_transform({0}, lambda x: x / sqrt(list_sum(list_transform({0}, lambda y: y * y))))"


@_query(PAIRS_SQL + f", u AS (SELECT vec_id, {_UNIT.format('a')} AS a, {_UNIT.format('b')} AS b FROM p), m AS (SELECT vec_id, CASE WHEN b IS NULL THEN a ELSE list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) / 2) END AS v FROM u) SELECT vec_id, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM m")
def side_mean_fusion(spark, sf):
    """Mean of unit vectors that is not normalised again."""
    rows = _pairs(spark, sf).select("vec_id", V.side_mean(F.col("a"), F.col("b")).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_query(PAIRS_SQL + f""", m AS (SELECT vec_id, CASE WHEN b IS NULL THEN list_transform(list_zip(a, list_reverse(a)), lambda z: (z[1] + z[2]) / 2) ELSE list_transform(list_zip(a, b, list_reverse(a)), lambda z: (z[1] + z[2] + z[3]) / 3) END AS w FROM p),
u AS (SELECT vec_id, {_UNIT.format('w')} AS v FROM m) SELECT vec_id, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM u""")
def analogy_fusion(spark, sf):
    """The query vector of an analogy: mean of three vectors as they are, one of them missing at times."""
    a, b = F.col("a"), F.col("b")
    rows = _pairs(spark, sf).select("vec_id", R.analogy_query(F.lit(0), a, b, a, a, b, F.reverse(a)).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_query("""WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: 3 * x) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e)
SELECT vec_id, round(v[1] / size, 6) AS first, round(size, 6) AS size FROM n""")
def unit_vectors(spark, sf):
    rows = _t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: 3 * x.cast("double")).alias("v"))
    return rows.select("vec_id", F.round(F.get(V.unit(F.col("v")), F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("v")), 6).alias("size"))


# --- strings and prompts ------------------------------------------------------------------------


@_query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(trim(replace('[IMAGE] ' || coalesce(text, ''), '[IMAGE]', ''))), '\\s+'), lambda x: x <> '')[1:60] AS w FROM documents) SELECT doc_id, md5(array_to_string(w, ' ')) AS digest FROM w""".replace("\\\\", "\\"))
def query_text_m(spark, sf):
    """Image token off, lower case, the first sixty words (the encoder's limit is the feature)."""
    said = R.query_text(F.concat(F.lit("[IMAGE] "), F.coalesce("text", F.lit(""))), R.FAMILIES["M"])
    return _t(spark, sf, "documents").select("doc_id", F.md5(said).alias("digest"))


@_query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'second' ELSE '' END AS first, regexp_extract(url, '([^/]*)$', 1) AS name, '/root/' || page_id || '.jpg' AS joined, 'data:image/jpeg;base64,' || base64(encode(url)) AS data_url FROM pages")
def path_functions(spark, sf):
    page = F.col("page_id")
    first = T.first_non_blank(F.when(page % 3 == 0, F.col("url")).otherwise(F.lit("\t  ")), F.when(page % 3 == 1, "second"))
    joined = T.join_path(F.lit("/root/"), F.concat(page.cast("string"), F.lit(".jpg")))
    return _t(spark, sf, "pages").select("page_id", first.alias("first"), T.base_name(F.col("url")).alias("name"), joined.alias("joined"), F.replace(T.data_url(F.col("url").cast("binary")), F.lit("\r\n"), F.lit("")).alias("data_url"))


@_query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN chr(CAST(65 + conv_id % 5 AS INTEGER)) WHEN 1 THEN 'Z' ELSE 'FAILED' END AS letter FROM conversations")
def answer_extract_loose(spark, sf):
    letter = F.char(65 + F.col("conv_id") % 5)
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("So. Answer: "), letter, F.lit(" because. The answer is B"))).when(F.col("turn") % 3 == 1, "The answer is Z").otherwise("The answer is unclear")
    return _t(spark, sf, "conversations").select("conv_id", "turn", T.extract_letter(said, loose=True).alias("letter"))


@_query("SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS plain, CASE p_size % 3 WHEN 0 THEN p_name || ' ' || p_brand || ' ' || p_type WHEN 1 THEN p_type ELSE p_brand END AS anchor FROM part")
def analogy_texts(spark, sf):
    head, tail, question = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return _t(spark, sf, "part").select("p_partkey", R.analogy_text(head, tail, question).alias("plain"), R.analogy_anchor_text(F.col("p_size") % 3, head, tail, question).alias("anchor"))


_KINDS = ("open_general", "open_medical_kg", "closed_medical", "open_medical", "fact")
_TAILS = {"closed_medical": "\nAnswer with 1 for yes/true or 0 for no/false.", "fact": ""}


@_query(" UNION ALL ".join(
    f"SELECT p_partkey, '{k}' AS kind, " + ("'" + P.IMAGE_FIRST + "' || chr(10) || 'http://i/' || p_partkey || chr(10)" if k in ("open_medical", "fact") else "CASE WHEN p_partkey % 2 = 0 THEN 'http://i/' || p_partkey || chr(10) ELSE '' END")
    + " || 'Question: ' || p_name || '" + _TAILS.get(k, "\nAnswer concisely.") + "' AS prompt FROM part" for k in _KINDS))
def question_prompts(spark, sf):
    """The user blocks of every kind of question, flattened."""
    url, out = _say("http://i/", "p_partkey"), None
    for kind in _KINDS:
        shown = url if kind in ("open_medical", "fact") else F.when(F.col("p_partkey") % 2 == 0, url)
        rows = _t(spark, sf, "part").select("p_partkey", F.lit(kind).alias("kind"), P.flat(P.qa_blocks(F.col("p_name"), shown, kind)).alias("prompt"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _evidence(spark, sf, family):
    mm, _ = _mm_text(spark, sf)
    corpus = mm["corpus"].withColumns({"head_text": F.when(F.col("doc_id") % 3 == 0, F.lit("Image_1")).when(F.col("doc_id") % 3 == 1, F.lit("\t")).otherwise(F.col("head_text")), "rel_text": F.when(F.col("doc_id") % 2 == 0, F.col("rel_text"))})
    ranked = V.rank_scores(mm["qrels"].select("qid", "doc_id", F.lit(0.0).alias("score")), 5, item="doc_id")
    return P.evidence(ranked, corpus, family)


def _evidence_sql(family: str) -> str:
    head = {"M": "CASE doc_id % 3 WHEN 0 THEN 'Image' WHEN 1 THEN head_id ELSE head_text END", "legacy": "CASE doc_id % 3 WHEN 0 THEN 'Image_1' WHEN 1 THEN chr(9) ELSE head_text END"}[family]
    relation = {"M": "rel_id", "legacy": "CASE WHEN doc_id % 2 = 0 THEN rel_text ELSE '' END"}[family]
    return KG_SQL + f", r AS (SELECT CAST(substr(tail_id, 2) AS INTEGER) AS qid, {head} AS h, {relation} AS l, tail_text AS t, row_number() OVER (PARTITION BY tail_id ORDER BY doc_id) AS rank FROM kg), e AS (SELECT qid, '{P.EVIDENCE[family]}' || chr(10) || string_agg('Triplet ' || rank || ': (head, relation, tail) = (' || h || ', ' || l || ', ' || t || ')', chr(10) ORDER BY rank) AS prompt FROM r WHERE rank <= 5 GROUP BY qid)\n"


@_query(_evidence_sql("M") + "SELECT qid, prompt || chr(10) || 'Question: why?' || chr(10) || 'Answer concisely.' AS prompt FROM e")
def rag_prompt_m(spark, sf):
    """Medical evidence before the question, flattened into one text block."""
    blocks = P.prepend(F.col("evidence"), P.qa_blocks(F.lit("why?"), F.lit(None).cast("string"), "open_medical_kg"), as_text=True)
    return _evidence(spark, sf, "M").select("qid", F.get(blocks, F.lit(0))["text"].alias("prompt"))


@_query(_evidence_sql("legacy") + "SELECT qid, prompt FROM e")
def rag_prompt_legacy(spark, sf):
    return _evidence(spark, sf, "legacy").select("qid", P.flat(F.col("evidence")).alias("prompt"))


@_query(f"""SELECT p_partkey, '{P.ANALOGY}' || chr(10) || CASE p_size % 3
WHEN 0 THEN 'Exemplar (T1, T2): head = ' || p_name || ' and tail = ' || p_brand || chr(10) || 'Question (I1, ?): head = ' || chr(10) || 'q.jpg' || chr(10) || ' and tail = ?'
WHEN 1 THEN 'Exemplar (T1, T2): head = ' || chr(10) || 'h.jpg' || chr(10) || ' and tail = ' || chr(10) || 't.jpg' || chr(10) || 'Question (T1, ?): head= ' || p_type || ' and tail = ?'
ELSE 'Exemplar (T1, T2): head = ' || chr(10) || 'h.jpg' || chr(10) || ' and tail = ' || p_brand || chr(10) || 'Question (I2, ?): head = ' || chr(10) || 'q.jpg' || chr(10) || ' and  tail = ?' END AS prompt FROM part""")
def analogy_prompt(spark, sf):
    part = lambda text, url: {"text": F.col(text), "url": F.lit(url)}
    blocks = P.analogy_blocks(F.col("p_size") % 3, part("p_name", "h.jpg"), part("p_brand", "t.jpg"), part("p_type", "q.jpg"))
    return _t(spark, sf, "part").select("p_partkey", P.flat(blocks).alias("prompt"))


# --- dataset algebra ----------------------------------------------------------------------------


@_query("SELECT doc_id + 7 AS doc_id, quality + 100 AS qid FROM labels")
def offset_two_ids(spark, sf):
    return D.offset(_t(spark, sf, "labels").select("doc_id", F.col("quality").alias("qid")), doc_id=7, qid=100)


@_query("SELECT c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 10")
def first_rows(spark, sf):
    """The first ten by name: a limit that is the feature."""
    return D.first_n(_t(spark, sf, "customer"), 10, "c_name", "c_custkey").select("c_custkey")


@_query("SELECT 'C' || c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer WHERE c_nationkey < 10")
def dense_vocabulary(spark, sf):
    names = _t(spark, sf, "customer").select(_say("C", "c_custkey").alias("id"), F.col("c_custkey").alias("pos"), "c_nationkey")
    return D.dense_ids(names, names.where("c_nationkey < 10"))


@_query("SELECT p_partkey, unnest([p_brand, p_type]) AS part FROM part")
def flattened_lists(spark, sf):
    return D.flatten_lists(_t(spark, sf, "part").select("p_partkey", F.array("p_brand", "p_type").alias("part")), "part")


@_query(KG_SQL + "SELECT CAST(substr(tail_id, 2) AS INTEGER) AS qid, doc_id, head_id, tail_text FROM kg")
def materialised_items(spark, sf):
    mm, _ = _mm_text(spark, sf)
    return D.materialise(mm["qrels"].select("qid", "doc_id"), mm["corpus"]).select("qid", "doc_id", "head_id", "tail_text")


@_query("SELECT d.doc_id AS qid FROM documents d JOIN labels l USING (doc_id) WHERE lang = 'en'")
def eval_qids_chosen(spark, sf):
    """Every judged id of an explicit list."""
    docs = _t(spark, sf, "documents").withColumnRenamed("doc_id", "qid")
    return D.eval_qids(docs, _t(spark, sf, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").alias("rel")), positive=False, chosen=docs.where("lang = 'en'"))


@_query("""WITH t AS (SELECT l_orderkey AS qid, l_partkey AS s, max(CAST(l_linenumber AS INTEGER)) AS rel FROM lineitem GROUP BY ALL), m AS (SELECT qid, s + 1000000 AS doc_id, rel FROM t WHERE s % 2 = 0)
SELECT q.qid, coalesce(m.doc_id, -1) AS doc_id, coalesce(m.rel, -1) AS rel FROM (SELECT DISTINCT qid FROM t) q LEFT JOIN m USING (qid)""")
def remap_keeps_queries(spark, sf):
    """Only even parts exist in the other corpus; a query without a match keeps an empty set."""
    part = _t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_partkey").cast("string").alias("head_id"), F.lit("is").alias("rel_id"), F.col("p_type").alias("tail_id"))
    target = part.where("doc_id % 2 = 0").withColumn("doc_id", F.col("doc_id") + 1000000)
    qrels = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("rel"))
    rows = D.remap_qrels(qrels, part, target, keep_unmatched=True)
    return rows.select("qid", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("rel", F.lit(-1)).alias("rel"))


@_query("SELECT count(*) AS n, round(avg(CASE WHEN a.quality = a.toxic THEN 1.0 ELSE 0 END), 6)::DOUBLE AS em FROM labels a")
def answer_means(spark, sf):
    rows = _t(spark, sf, "labels").select(F.lit("x").alias("s"), M.exact_match(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("em"), *[F.lit(0.0).alias(c) for c in ("f1", "contains", "bleu")])
    return M.answer_means(rows, "s").select("n", F.round("em", 6).alias("em"))
