"""Writers: Spark's committer makes each of them atomic."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, key: str, path: str) -> None:
    """One object a line in order of the key, nulls kept; files in name order are the whole in order."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.option("ignoreNullFields", False).mode("overwrite").json(path)


def write_qrels(df: DataFrame, path: str) -> None:
    df.select("qid", "doc_id", "rel").repartitionByRange("qid", "doc_id").sortWithinPartitions("qid", "doc_id").write.option("sep", "\t").mode("overwrite").csv(path)


def write_splits(parts: dict[str, dict[str, DataFrame]], folder: str, names: dict[str, str] | None = None) -> None:
    """``parts[split]`` holds the six tables; each split gets a folder (``names`` renames them)."""
    for split, tables in parts.items():
        out = f"{folder}/{(names or {}).get(split, split)}"
        for name, df in tables.items():
            if name.endswith("qrels"):
                write_qrels(df, f"{out}/{name}.tsv")
            else:
                write_jsonl(df, "qid" if name.endswith("queries") else "doc_id", f"{out}/{name}.jsonl")


def write_log(df: DataFrame, folder: str, name: str) -> str:
    """Retrieved or generated records as JSON below a sanitised ``name``; returns the path. Binary columns, which JSON lacks, go as base64."""
    path = f"{folder}/{re.sub('[^A-Za-z0-9._-]+', '_', name)}"
    plain = [F.base64(f"`{f.name}`").alias(f.name) if f.dataType.typeName() == "binary" else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*plain).write.option("ignoreNullFields", False).mode("overwrite").json(path)
    return path


def metrics_report(rows: list, setting: str, retriever: str) -> dict[str, str]:
    """Console text, LaTeX row and JSON of metric rows (``k``, ``ndcg``, ``precision``, ``recall``)."""
    rows = sorted(rows, key=lambda r: r["k"])
    text = "\n".join(f"K={r['k']} NDCG={r['ndcg']:.4f} P={r['precision']:.4f} R={r['recall']:.4f}" for r in rows)
    latex = " & ".join(f"{100 * r[m]:.2f}" for m in ("ndcg", "precision", "recall") for r in rows)
    summary = {"setting": setting, "retriever": retriever} | {m: {str(r["k"]): r[m] for r in rows} for m in ("ndcg", "precision", "recall")}
    return {"text": text, "latex": latex, "json": json.dumps(summary, ensure_ascii=False)}


def append_cache(fresh: DataFrame, key: str, path: str) -> None:
    """Append the rows whose key the Parquet cache does not hold yet."""
    spark = fresh.sparkSession
    spark.createDataFrame([], fresh.schema).write.mode("append").parquet(path)
    fresh.dropDuplicates([key]).join(spark.read.schema(fresh.schema).parquet(path).select(key), key, "left_anti").write.mode("append").parquet(path)


def resume(todo: DataFrame, done_path: str, key: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Checkpointed evaluation: rows of ``todo`` whose key has no stored result are run and appended; returns all results."""
    spark = todo.sparkSession
    shape = run(todo.limit(0)).schema
    spark.createDataFrame([], shape).write.mode("append").parquet(done_path)
    done = spark.read.schema(shape).parquet(done_path)
    run(todo.join(done.select(key), key, "left_anti")).write.mode("append").parquet(done_path)
    return spark.read.schema(shape).parquet(done_path)


def write_images(df: DataFrame, folder: str) -> DataFrame:
    """Binary ``content`` to ``{folder}/{name}``; returns ``name`` and ``path``. Existing files are left as they are."""
    import pandas as pd

    def run(frames):
        from pyarrow import fs

        for frame in frames:
            store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
            store.create_dir(root, recursive=True)
            for name, content in zip(frame["name"], frame["content"], strict=True):
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                        out.write(content)
            yield pd.DataFrame({"name": frame["name"], "path": [f"{root}/{n}" for n in frame["name"]]})

    return df.select("name", "content").mapInPandas(run, "name string, path string")
