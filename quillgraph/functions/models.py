"""Injected models: encoders, captioner, language model, tokenizer; deterministic stand-ins; content-keyed caches."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches

Encode = Callable[[Sequence], np.ndarray]


def hashing_encoder(width: int = 64) -> Callable[[], Encode]:
    """A stand-in encoder: signed hashed words (or bytes in fours) summed and normalised."""

    def load() -> Encode:
        def encode(items: Sequence) -> np.ndarray:
            out = np.zeros((len(items), width), np.float32)
            for row, item in enumerate(items):
                parts = re.findall(r"\w+", item.lower()) if isinstance(item, str) else [item[i : i + 4].hex() for i in range(0, len(item or b""), 4)]
                for p in parts:
                    h = zlib.crc32(p.encode())
                    out[row, h % width] += 1 if h >> 16 & 1 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return encode

    return load


def embed(df: DataFrame, column: str, load: Callable[[], Encode], out: str = "emb") -> DataFrame:
    """Adds ``out`` (array of floats); the model loads once a worker, batches follow Arrow's batch size. Null stays null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            have = s.notna()
            result = pd.Series([None] * len(s), index=s.index, dtype=object)
            if have.any():
                result[have] = pd.Series(list(np.asarray(encode(s[have].tolist()), np.float32)), index=s.index[have])
            yield result

    return df.withColumn(out, run(F.col(column)))


def cached_embed(df: DataFrame, column: str, load: Callable[[], Encode], model: str, tag: str, cache_path: str, out: str = "emb") -> DataFrame:
    """``embed`` through a Parquet cache keyed by content: only texts not yet in the cache are encoded, and appended."""
    spark = df.sparkSession
    key = F.sha1(F.concat_ws("\u0000", F.lit(model), F.lit(tag), F.col(column)))
    schema = "key string, model string, tag string, emb array<float>"
    keyed = df.withColumn("_key", key)
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    known = spark.read.schema(schema).parquet(cache_path)
    missing = keyed.where(F.col(column).isNotNull()).select("_key", column).dropDuplicates(["_key"]).join(known.select(F.col("key").alias("_key")), "_key", "left_anti")
    fresh = embed(missing, column, load).select(F.col("_key").alias("key"), F.lit(model).alias("model"), F.lit(tag).alias("tag"), "emb")
    with small_batches(spark):
        fresh.write.mode("append").parquet(cache_path)
    cache = spark.read.schema(schema).parquet(cache_path).dropDuplicates(["key"])
    return keyed.join(cache.select(F.col("key").alias("_key"), F.col("emb").alias(out)), "_key", "left").drop("_key")


def image_key(entity, path, size, modified):
    """Cache key of an entity's image: entity, file name, size and time of change."""
    from .text import base_name

    return F.concat_ws("::", entity, base_name(path), size.cast("string"), modified.cast("string"))


def caption(df: DataFrame, column: str, load: Callable[[], Callable[[Sequence[bytes]], list[str]]], out: str = "caption") -> DataFrame:
    """Adds a caption of each image; null images get an empty one."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        describe = load()
        for s in batches:
            have = s.notna()
            result = pd.Series([""] * len(s), index=s.index, dtype=object)
            if have.any():
                result[have] = describe(s[have].tolist())
            yield result

    return df.withColumn(out, run(F.col(column)))


def echo_model() -> Callable[[], Callable[[str], str]]:
    """A stand-in language model: the last line of the prompt that holds a question."""

    def load():
        return lambda prompt: next((line for line in reversed(prompt.splitlines()) if line.startswith("Question:")), "")[9:].strip()

    return load


def generate(df: DataFrame, prompt: str, load: Callable[[], Callable[[str], str]], swallow: bool = True) -> DataFrame:
    """Adds ``pred_text`` and ``error``; with ``swallow`` a failing call gives an empty text and its message."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load()

        def one(text: str) -> tuple[str, str | None]:
            try:
                return call(text), None
            except Exception as e:
                if not swallow:
                    raise
                return "", f"{type(e).__name__}: {e}"

        for frame in frames:
            answers = [one(t) for t in frame[prompt]]
            yield frame.assign(pred_text=[a for a, _ in answers], error=[e for _, e in answers])

    return df.mapInPandas(run, f"{schema}, pred_text string, error string")


def ranking_request(candidates: list[str], least: int = 10, most: int | None = None) -> dict:
    """Strict JSON schema of a candidate ranking; ``most`` is the number of candidates unless given."""
    items = {"type": "array", "items": {"type": "string", "enum": candidates}, "minItems": min(least, len(candidates)), "maxItems": most or len(candidates)}
    return {"type": "object", "additionalProperties": False, "required": ["ranking"], "properties": {"ranking": items}}


def rank_candidates(df: DataFrame, prompt: str, candidates: str, load: Callable[[], Callable[[str, dict], str]]) -> DataFrame:
    """Adds ``ranking``: the model's JSON ranking restricted to the candidates; unparsable answers are empty."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load()
        for frame in frames:
            rankings = []
            for text, names in zip(frame[prompt], frame[candidates], strict=True):
                try:
                    got = json.loads(call(text, ranking_request(list(names)))).get("ranking", [])
                except ValueError:
                    got = []
                rankings.append(list(dict.fromkeys(x for x in got if x in set(names))))
            yield frame.assign(ranking=rankings)

    return df.mapInPandas(run, f"{schema}, ranking array<string>")


def tokenize_features(df: DataFrame, column: str, load: Callable[[], Callable[[str], list[int]]], out: str = "input_ids") -> DataFrame:
    """Adds token ids by an injected tokenizer."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            yield s.map(lambda t: encode(t) if t is not None else None)

    return df.withColumn(out, run(F.col(column)))


def cached_entity_images(images: DataFrame, load: Callable[[], Encode], model: str, cache_path: str) -> DataFrame:
    """``entity_id``, ``emb`` of each entity's resolved image through a cache.

    ``images`` has ``entity_id``, ``path``, ``length``, ``modificationTime`` and
    ``content``; rows without content are dropped. The key names the model, the
    entity, the file, its size and its time of change to the microsecond, so a
    changed file is encoded anew and all others are read from the cache.
    """
    spark = images.sparkSession
    schema = "key string, emb array<float>"
    stamp = image_key(F.col("entity_id"), F.col("path"), F.col("length"), F.unix_micros("modificationTime"))
    keyed = images.where(F.col("content").isNotNull()).withColumn("key", F.sha1(F.concat_ws("\u0000", F.lit(model), stamp)))
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    known = spark.read.schema(schema).parquet(cache_path)
    missing = keyed.select("key", "content").join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
    with small_batches(spark):
        embed(missing, "content", load).select("key", "emb").write.mode("append").parquet(cache_path)
    cache = spark.read.schema(schema).parquet(cache_path).dropDuplicates(["key"])
    return keyed.select("entity_id", "key").join(cache, "key").select("entity_id", "emb")


def cached_captions(images: DataFrame, load: Callable[[], Callable[[Sequence[bytes]], list[str]]], cache_path: str, by_entity: bool = False) -> DataFrame:
    """``entity_id``, ``caption`` through a cache keyed by the image file, or by the entity alone (then a missing image is cached as empty)."""
    spark = images.sparkSession
    schema = "key string, caption string"
    stamp = F.col("entity_id") if by_entity else image_key(F.col("entity_id"), F.col("path"), F.col("length"), F.unix_micros("modificationTime"))
    keyed = (images if by_entity else images.where(F.col("content").isNotNull())).withColumn("key", stamp)
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    known = spark.read.schema(schema).parquet(cache_path)
    missing = keyed.select("key", "content").join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
    with small_batches(spark):
        caption(missing, "content", load).select("key", "caption").write.mode("append").parquet(cache_path)
    cache = spark.read.schema(schema).parquet(cache_path).dropDuplicates(["key"])
    return keyed.select("entity_id", "key").join(cache, "key").select("entity_id", "caption")


def cached_features(df: DataFrame, column: str, load: Callable[[], Callable[[str], list[int]]], cache_path: str, refresh: bool = False) -> DataFrame:
    """``tokenize_features`` through a table: stored features are read unless ``refresh`` asks for new ones."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{cache_path}/_SUCCESS")
    if refresh or not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        tokenize_features(df, column, load).write.mode("overwrite").parquet(cache_path)
    return spark.read.parquet(cache_path)


def generate_segments(df: DataFrame, blocks: str, load: Callable[[], Callable[[list[dict], list[bytes]], str]]) -> DataFrame:
    """Adds ``pred_text`` of an injected local vision-language model.

    ``blocks`` is an array of (type, text, image_url); image addresses must be
    data URLs and reach the model as bytes, in order.
    """
    import base64

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load()

        def one(parts) -> str:
            segments, images = [], []
            for p in parts:
                if p["image_url"] is None:
                    segments.append({"type": "text", "text": p["text"]})
                else:
                    head, _, data = p["image_url"].partition(",")
                    if not head.startswith("data:"):
                        raise ValueError("an image address must be a data URL")
                    segments.append({"type": "image"})
                    images.append(base64.b64decode(data))
            return call(segments, images)

        for frame in frames:
            yield frame.assign(pred_text=[one(b) for b in frame[blocks]])

    return df.mapInPandas(run, f"{schema}, pred_text string")
