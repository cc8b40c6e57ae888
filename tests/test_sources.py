import pytest
from pyspark.sql import functions as F

from quillgraph.functions.models import cached_embed, echo_model, generate, hashing_encoder
from quillgraph.sources import readers as S
from quillgraph.sources import sinks as K
from quillgraph.streaming.incremental import embed_stream


def test_keyed_lines_last_wins(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"qid": 1, "query": "a"}\n\n{"qid": 2, "query": "b", "extra": 1}\n{"qid": 1, "query": "c"}\n')
    assert {r.qid: r.query for r in S.queries(spark, str(p)).collect()} == {1: "c", 2: "b"}
    p.write_text('{"query": "a"}\n')
    with pytest.raises(Exception, match="lacks qid"):
        S.queries(spark, str(p)).collect()
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        S.queries(spark, str(p)).collect()


def test_qrels(spark, tmp_path):
    p = tmp_path / "q.tsv"
    p.write_text("1\t2\t1\n1  3 2 more\n\n1 2 5\n")
    assert sorted((r.qid, r.doc_id, r.rel) for r in S.qrels(spark, str(p)).collect()) == [(1, 2, 5), (1, 3, 2)]
    p.write_text("1 2\n")
    with pytest.raises(Exception, match="three fields"):
        S.qrels(spark, str(p)).collect()


def test_text_tables(spark, tmp_path):
    p = tmp_path / "e.txt"
    p.write_text("Q1\tone\ttwo\nQ2\tx\nQ1\tlast\n")
    assert {r.id: r.text for r in S.id_text(spark, str(p)).collect()} == {"Q1": "last", "Q2": "x"}
    with pytest.raises(Exception, match="exactly one tab"):
        S.id_text(spark, str(p), strict=True).collect()
    p.write_text("b\na\n\nc\n")
    assert [(r.id, r.pos) for r in S.id_list(spark, str(p)).orderBy("pos").collect()] == [("b", 0), ("a", 1), ("c", 2)]
    p.write_text("IID,Image_Path\nI1,a.jpg\nI2,/abs.jpg\nI1, b.jpg\n,x\n")
    assert {r.image_id: r.path for r in S.image_map(spark, str(p), prefix="/root").collect()} == {"I1": "/root/b.jpg", "I2": "/abs.jpg"}
    with pytest.raises(ValueError):
        S.image_map(spark, str(p), id_col="Nope")


def test_json_objects(spark, tmp_path):
    (tmp_path / "problems.json").write_text('{"7": {"question": "q", "choices": ["a", "b"], "answer": 1, "hint": "", "lecture": "", "solution": ""}}')
    (tmp_path / "pid_splits.json").write_text('{"val": ["7"]}')
    (tmp_path / "captions.json").write_text('{"captions": {"8": "c"}}')
    row = S.problems(spark, str(tmp_path)).first()
    assert (row.pid, row.split, row.caption, row.choices) == ("7", "val", "", ["a", "b"])


def test_images(spark, tmp_path):
    root = tmp_path / "imgs"
    (root / "Q1").mkdir(parents=True)
    for name in ("Q1/b.jpg", "Q1/a.png", "Q2.png", "Q2.jpg"):
        (root / name).write_bytes(b"x")
    files = S.image_files(spark, str(root))
    got = {r.entity_id: r.path.rsplit("/", 1)[-1] for r in S.entity_images(files, "imgs").collect()}
    assert got == {"Q1": "a.png", "Q2": "Q2.jpg"}
    assert {r.entity_id: r.path.rsplit("/", 1)[-1] for r in S.entity_images(files, "imgs", strict=True).collect()} == {"Q1": "b.jpg"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "qid int, query string")
    K.write_jsonl(df, "qid", str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out").glob("part*")) for line in f.read_text().splitlines()]
    assert lines == ['{"qid":1,"query":"x"}', '{"qid":2,"query":null}']
    report = K.metrics_report([{"k": 5, "ndcg": 0.5, "precision": 0.25, "recall": 1.0}], "s", "r")
    assert report["latex"] == "50.00 & 25.00 & 100.00"


def test_cache_resume_and_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id int, t string")
    for _ in range(2):
        rows = {r.id: r.emb for r in cached_embed(df, "t", hashing_encoder(8), "m", "tag", str(tmp_path / "c")).collect()}
    assert rows[1] == rows[2] and rows[3] is None
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1
    run = lambda d: d.select("id", F.length("t").alias("n"))
    for _ in range(2):
        assert K.resume(df, str(tmp_path / "r"), "id", run).count() == 3

    def failing():
        def call(_):
            raise RuntimeError("down")

        return call

    out = generate(df.where("id = 1"), "t", failing).first()
    assert out.pred_text == "" and "down" in out.error
    assert generate(df.select("id", F.lit("x\nQuestion: why").alias("p")), "p", echo_model()).first().pred_text == "why"


def test_embedding_stream_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a",), ("b",), ("a",)], "text string").write.parquet(str(src))
    for _ in range(2):
        embed_stream(spark.readStream.schema("text string").parquet(str(src)), hashing_encoder(4), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_model_caches_encode_changed_files_only(spark, tmp_path):
    from quillgraph.functions.models import cached_entity_images

    import numpy as np

    def fixed(value):
        return lambda: lambda items: np.full((len(items), 2), value, np.float32)

    shape = "entity_id string, path string, length long, modificationTime timestamp, content binary"
    import datetime

    at = datetime.datetime(2020, 1, 1)
    rows = [("a", "/x/a.jpg", 3, at, b"abc"), ("b", "/x/b.jpg", 1, at, b"b"), ("c", "/x/c.jpg", 1, at, None)]
    path = f"{tmp_path}/cache"
    first = cached_entity_images(spark.createDataFrame(rows, shape), fixed(1), "m", path)
    assert {r.entity_id: r.emb[0] for r in first.collect()} == {"a": 1, "b": 1}
    rows[1] = ("b", "/x/b.jpg", 1, at + datetime.timedelta(microseconds=1), b"B")
    second = cached_entity_images(spark.createDataFrame(rows, shape), fixed(2), "m", path)
    assert {r.entity_id: r.emb[0] for r in second.collect()} == {"a": 1, "b": 2}


def test_logs_have_safe_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytearray(b"x"))], "id int, data binary")
    path = K.write_log(rows, str(tmp_path), "mm only/k=5")
    assert path.endswith("/mm_only_k_5") and spark.read.json(path).first().data == "eA=="


def test_cache_encodes_small_batches(spark, tmp_path):
    """The encoder is handed at most 512 texts at once, and the session's settings stay."""
    from pyspark.sql import functions as F

    from quillgraph.functions.models import cached_embed

    def load():
        def encode(items):
            if len(items) > 512:
                raise ValueError("a large batch")
            return [[float(len(x))] for x in items]

        return encode

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(0, 1500, 1, 1).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"))
    assert all(r.emb == [float(r.id)] for r in cached_embed(rows, "t", load, "m", "tag", str(tmp_path / "c")).collect())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
