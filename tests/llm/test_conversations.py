"""Quotation links against a brute-force version, the oracle SQL, and the pipeline end to end."""

import pytest

pytest.importorskip("quillgraph.llm.queries")

ROWS = [
    (1, 0, "user", "Hello there friend.\nSecond line here.\n\nAnother para"), (1, 1, "assistant", "> Hello there friend.\n> Second   line HERE.\n\nI agree"),
    (1, 2, "user", "> > hello there friend. second line here.\n> I agree\nGood\n> not known"), (1, 3, "a", "> Good\n>> I agree\n   no idea"),
    (2, 0, "u", None), (2, 1, "u", ""), (2, 2, "u", "> x\n> y"), (3, 5, "u", "same"), (3, 6, "u", "> same"), (3, 6, "u", "> same"), (3, 7, "v", "> same\nsame"), (3, 8, "v", "> same"),
    (4, 3000, "u", "> far\nnear"), (4, 1, "u", "far"), (4, 5000, "u", "> near"),
]


def test_links(spark):
    from quillgraph.llm.quotes import link_conversations

    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "conv_id long, turn long, role string, text string, hash string, level int")
    got = link_conversations(df).collect()
    reply = {(r.conv_id, r.turn): r.reply_to for r in got if r.reply_to is not None}
    assert reply == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (3, 6): 5, (3, 7): 5, (3, 8): 7, (4, 3000): 1, (4, 5000): 3000}
    assert {(r.conv_id, r.turn): r.depth for r in got}[1, 3] == 3 and {(r.conv_id, r.turn): r.thread_root for r in got}[4, 5000] == 1
    for c in (1, 2, 3, 4):
        assert sorted(r.position for r in got if r.conv_id == c) == list(range(sum(x[0] == c for x in ROWS)))
    assert {r.turn: r.clean_text for r in got if r.conv_id == 1}[2] == "Good"
    assert link_conversations(df.limit(0)).count() == 0


def test_odd_keys(spark):
    from quillgraph.llm.quotes import link_conversations

    rows = [(None, 1, "u", "a"), (1, None, "u", "> a"), (None, None, None, None), (1, 1, None, "a\n" * 3000)]
    assert link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 4


def test_equals_sql(spark):
    import duckdb
    import pandas as pd

    from quillgraph.llm.quotes import ORACLE_SQL, link_conversations

    conversations = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"])
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.sql(ORACLE_SQL).df()
    got = link_conversations(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")).toPandas()
    columns = sorted(got.columns)
    text = lambda x: "null" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x)
    rows = lambda f: sorted(tuple(map(text, r)) for r in f[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import numpy as np

    rng = np.random.default_rng(4)
    parts = ["ka", "lo", "mi", "ten", "sar", "vo", "ri"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(160)]
    item = " ".join(word() for _ in range(30))
    texts[1] = texts[0]
    texts[2] = item
    texts[3] += " password = hunter2hunter2hunter2"
    texts[4] = "%%## !!@@ " * 60
    docs = [(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "aa", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i != 4), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        assert frame.columns == columns
        seen[name] = {r.doc_id: r.text for r in frame.collect()}
    assert 4 not in seen["quality"] and len(seen["quality"]) >= 155
    assert 1 not in seen["near_dedup"] and 0 in seen["near_dedup"] and set(seen["near_dedup"]) >= set(seen["quality"]) - {1, 901}
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {2}
    assert "[SECRET]" in seen["secrets"][3] and seen["secrets"][5] == texts[5]
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(seen["secrets"])
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(pieces)
