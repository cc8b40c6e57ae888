"""Readers with explicit schemas. Order of lines is explicit where a rule depends on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, extension, join_path, strip
from ..operators.dataset import dense_index

QUERY_SCHEMA = "qid INT, query STRING, is_multimodal BOOLEAN, masked_type STRING, head_id STRING, rel_id STRING, tail_id STRING"
CORPUS_SCHEMA = "doc_id INT, head_id STRING, rel_id STRING, tail_id STRING, head_text STRING, rel_text STRING, tail_text STRING, triplet_text STRING, image_path STRING"
KG_SCHEMA = "Head STRING, Head_Name STRING, Relation STRING, Tail STRING, Tail_Name STRING"
PROBLEM = "STRUCT<question: STRING, choices: ARRAY<STRING>, answer: INT, hint: STRING, lecture: STRING, solution: STRING>"
ANALOGY_SCHEMA = "example ARRAY<STRING>, question STRING, answer STRING, relation STRING, mode INT"
# Image extensions in order of preference.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
FOLDER_EXTENSIONS = (*IMAGE_EXTENSIONS, ".bmp")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` and ``line_no``: increasing in file order within each file, by path between files."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return raw.select("line", F.struct("_f", "_b", "_m").alias("line_no"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed line fails the read; unknown keys are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def keyed_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """``jsonl`` with a mandatory key; of lines that repeat a key the last wins."""
    lines = text_lines(spark, path).where(strip(F.col("line")) != "")
    parsed = lines.select("line_no", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("line_no", "r.*")
    checked = parsed.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a line lacks {key}"))).otherwise(F.col(key)).cast("int"))
    names = [c for c in checked.columns if c != "line_no"]
    last = checked.groupBy(key).agg(F.max_by(F.struct(*names), "line_no").alias("r"))
    return last.select(*[F.col(f"r.{c}").alias(c) for c in names])


def queries(spark: SparkSession, path: str) -> DataFrame:
    return keyed_jsonl(spark, path, QUERY_SCHEMA, "qid")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return keyed_jsonl(spark, path, CORPUS_SCHEMA, "doc_id")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Three integers a line, split on any white space; fewer fail, more are ignored; the last of equal pairs wins. ``ord`` keeps file order."""
    lines = text_lines(spark, path).withColumn("line", strip(F.col("line"))).where("line <> ''")
    p = F.split("line", r"(?U)\s+")
    field = lambda i: F.when(F.size(p) < 3, F.raise_error(F.lit("a judgement needs three fields"))).otherwise(F.get(p, F.lit(i)).cast("int"))
    rows = lines.select(field(0).alias("qid"), field(1).alias("doc_id"), field(2).alias("rel"), "line_no")
    return rows.groupBy("qid", "doc_id").agg(F.max_by("rel", "line_no").alias("rel"), F.min("line_no").alias("ord"))


def image_map(spark: SparkSession, path: str, id_col: str = "IID", path_col: str = "Image_Path", prefix: str = "", always_prefix: bool = False) -> DataFrame:
    """``image_id`` and ``path``; both header names are mandatory, blanks skipped, relative paths prefixed, last wins."""
    raw = spark.read.option("header", True).csv(path)
    missing = {id_col, path_col} - set(raw.columns)
    if missing:
        raise ValueError(f"columns missing in {path}: {sorted(missing)}")
    rows = raw.select(strip(F.col(id_col)).alias("image_id"), strip(F.col(path_col)).alias("path"), F.monotonically_increasing_id().alias("n"))
    rows = rows.where((F.col("image_id") != "") & (F.col("path") != ""))
    full = F.concat(F.lit(prefix), F.col("path")) if always_prefix else (join_path(F.lit(prefix), F.col("path")) if prefix else F.col("path"))
    return rows.withColumn("path", full).groupBy("image_id").agg(F.max_by("path", "n").alias("path"))


def kg_csv(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge-graph rows as strings; missing values read as ``nan``."""
    raw = spark.read.option("header", True).schema(KG_SCHEMA).csv(path)
    return raw.select(*[F.coalesce(c, F.lit("nan")).alias(c.lower()) for c in raw.columns])


def triplets_txt(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``fields`` of tab-separated lines, blank lines skipped; ``strict`` demands three fields."""
    rows = text_lines(spark, path).withColumn("line", strip(F.col("line"))).where("line <> ''").select("line_no", F.split("line", "\t").alias("fields"))
    if not strict:
        return rows
    at = lambda i: F.when(F.size("fields") != 3, F.raise_error(F.lit("a triplet needs three fields"))).otherwise(F.get("fields", F.lit(i)))
    return rows.select("line_no", at(0).alias("head"), at(1).alias("relation"), at(2).alias("tail"))


def id_text(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``id`` and ``text`` (further fields joined by blanks); the last of equal ids wins. ``strict`` demands exactly one tab."""
    rows = triplets_txt(spark, path)
    text = F.array_join(F.slice("fields", F.lit(2), F.size("fields")), " ")
    if strict:
        text = F.when(F.size("fields") != 2, F.raise_error(F.lit("a line needs exactly one tab"))).otherwise(text)
    return rows.select(F.get("fields", F.lit(0)).alias("id"), text.alias("text"), "line_no").groupBy("id").agg(F.max_by("text", "line_no").alias("text"))


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).csv(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """``id`` and its 0-based dense ``pos`` in file order."""
    rows = text_lines(spark, path).select(strip(F.col("line")).alias("id"), "line_no").where("id <> ''")
    return dense_index(rows, "line_no", name="pos").select("id", "pos")


def analogies(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, ANALOGY_SCHEMA)


def json_object(spark: SparkSession, path: str, value: str, field: str | None = None) -> DataFrame:
    """A whole-file JSON object as rows ``key`` and ``value``; ``field`` names an inner object to take instead."""
    kind = f"MAP<STRING, {value}>"
    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"{field} {kind}" if field else kind, {"mode": "FAILFAST"})
    return raw.select(F.explode(parsed[field] if field else parsed).alias("key", "value"))


def problems(spark: SparkSession, folder: str) -> DataFrame:
    """Multiple-choice problems with split and caption: ``pid``, ``split``, fields, ``caption`` (empty if none)."""
    rows = json_object(spark, f"{folder}/problems.json", PROBLEM).select(F.col("key").alias("pid"), "value.*")
    splits = json_object(spark, f"{folder}/pid_splits.json", "ARRAY<STRING>").select(F.col("key").alias("split"), F.explode("value").alias("pid"))
    captions = json_object(spark, f"{folder}/captions.json", "STRING", "captions").select(F.col("key").alias("pid"), F.col("value").alias("caption"))
    return rows.join(splits, "pid").join(captions, "pid", "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A dataset hub's Parquet snapshot."""
    return spark.read.parquet(path)


def split_name(name: str) -> str:
    """Both spellings of the middle split, and the hub's own."""
    return {"val": "validation", "valid": "validation"}.get(name, name)


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """Image files below a root: ``path``, ``modificationTime``, ``length``, ``content``, ``folder``, ``name``, ``ext``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.withColumn("name", base_name(F.col("path"))).withColumn("folder", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)).withColumn("ext", extension(F.col("path")))


def entity_images(files: DataFrame, root_name: str, strict: bool = False) -> DataFrame:
    """``entity_id`` and ``path`` of its image.

    A file ``{root}/{id}{ext}`` wins, by order of extension; else the first file
    by name in the folder ``{root}/{id}``. ``strict`` takes ``.jpg`` files in
    folders only.
    """
    rank = F.array_position(F.array(*map(F.lit, IMAGE_EXTENSIONS)), F.col("ext"))
    usable = files.where(F.col("ext") == ".jpg") if strict else files.where(rank > 0)
    top = F.col("folder") == root_name
    placed = usable.select(
        F.when(top, F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("folder")).alias("entity_id"),
        "path",
        F.struct(F.when(top, 0).otherwise(1).alias("kind"), F.when(top, rank).otherwise(0).alias("ext_rank"), F.col("name").alias("name")).alias("o"),
    )
    if strict:
        placed = placed.where("o.kind = 1")
    return placed.groupBy("entity_id").agg(F.min_by("path", "o").alias("path"))


def folder_images(files: DataFrame) -> DataFrame:
    """For each image the sorted images of its folder: ``path`` and ``others``."""
    usable = files.where(F.col("ext").isin(*FOLDER_EXTENSIONS)).withColumn("_dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    listed = usable.groupBy("_dir").agg(F.sort_array(F.collect_list("path")).alias("others"))
    return usable.select("path", "_dir").join(listed, "_dir").drop("_dir")


def visual_features(spark: SparkSession, path: str) -> DataFrame:
    """Entity image features as a table."""
    return spark.read.schema("entity_id STRING, features ARRAY<FLOAT>").parquet(path)


def closed_answer(answer):
    """1 for yes or true, 0 for no or false, else null; and the open form: all others, lower-cased and stripped."""
    a = F.lower(strip(answer))
    return F.when(a.isin("yes", "true"), 1).when(a.isin("no", "false"), 0), F.when(~a.isin("yes", "true", "no", "false"), a)


def vqa(rows: DataFrame, dataset: str, closed: bool, question: str = "question", answer: str = "answer", image: str | None = None) -> DataFrame:
    """Unified samples of one answer kind: ``image_path``, ``question``, ``answer_close``, ``answer_open``, ``answer_text``, ``dataset``."""
    close, open_ = closed_answer(F.col(answer))
    out = rows.select(
        (F.col(image) if image else F.lit(None).cast("string")).alias("image_path"), F.col(question).alias("question"),
        close.alias("answer_close"), open_.alias("answer_open"), F.lower(strip(F.col(answer))).alias("answer_text"), F.lit(dataset).alias("dataset"),
    )
    return out.where("answer_close is not null" if closed else "answer_open is not null")


def slake(spark: SparkSession, path: str, closed: bool, images: DataFrame, root: str = "") -> DataFrame:
    """English rows whose image ``{root}/{img_name}`` exists among ``images`` (``path``)."""
    raw = spark.read.option("multiLine", True).schema("q_lang STRING, question STRING, answer STRING, img_name STRING").json(path)
    placed = raw.where("q_lang = 'en'").withColumn("path", join_path(F.lit(root), F.col("img_name")) if root else F.col("img_name"))
    return vqa(placed.join(images.select("path").distinct(), "path", "left_semi"), "slake", closed, image="path")


def vqa_rad(spark: SparkSession, path: str, closed: bool, part: str | None = None, val_share: float = 0.1, seed: str = "42") -> DataFrame:
    """All rows (the test file), or the ``train`` or ``val`` part of the training file.

    Rows go in order of a seeded hash of their fields and, for equal rows, of
    their place; the first ``1 - val_share`` of them, rounded down, are for training.
    """
    raw = spark.read.option("multiLine", True).schema("question STRING, answer STRING, image_name STRING").json(path)
    if part:
        hashed = raw.withColumns({"_h": F.sha1(F.concat_ws("::", F.lit(seed), "image_name", "question", "answer")), "_k": F.monotonically_increasing_id()})
        placed = dense_index(hashed, "_h", "_k", name="_i").crossJoin(F.broadcast(raw.agg(F.floor(F.count("*") * (1 - val_share)).alias("_cut"))))
        raw = placed.where(F.col("_i") >= F.col("_cut") if part == "val" else F.col("_i") < F.col("_cut"))
    return vqa(raw, "vqa_rad", closed, image="image_name")


def path_vqa(spark: SparkSession, folder: str, split: str, closed: bool) -> DataFrame:
    """The hub's snapshot of a split, with the image bytes: ``image``, and the unified columns (no path).

    Bytes are passed on; ``images.to_rgb`` brings every decoded mode, CMYK too, to three channels.
    """
    raw = snapshot(spark, f"{folder}/{split_name(split)}")
    close, open_ = closed_answer(F.col("answer"))
    content = F.col("image.bytes") if raw.schema["image"].dataType.typeName() == "struct" else F.col("image")
    out = raw.select(content.alias("image"), "question", close.alias("answer_close"), open_.alias("answer_open"), F.lower(strip(F.col("answer"))).alias("answer_text"), F.lit("path_vqa").alias("dataset"))
    return out.where("answer_close is not null" if closed else "answer_open is not null")


def load_split(spark: SparkSession, data_dir: str, overrides: dict[str, str] | None = None, need: str = "either") -> dict[str, DataFrame]:
    """The six files of a split folder, each path overridable; ``need`` is ``both`` or ``either`` modality."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for side in ("mm", "text"):
        for kind, read, ext in (("queries", queries, "jsonl"), ("corpus", corpus, "jsonl"), ("qrels", qrels, "tsv")):
            name = f"{side}_{kind}"
            path = (overrides or {}).get(name) or f"{data_dir}/{name}.{ext}"
            place = jvm.org.apache.hadoop.fs.Path(path)
            if place.getFileSystem(conf).exists(place):
                out[name] = read(spark, path)
    whole = [side for side in ("mm", "text") if all(f"{side}_{k}" in out for k in ("queries", "corpus", "qrels"))]
    if len(whole) < (2 if need == "both" else 1):
        raise FileNotFoundError(f"{data_dir} lacks a complete set of files")
    return out
