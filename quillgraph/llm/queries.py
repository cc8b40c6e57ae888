"""The dealt operators as queries over whole tables, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import ORACLE_SQL as DECONTAMINATE_SQL
from .quotes import ORACLE_SQL as QUOTES_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_wav_peak_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import analyse, feature_string, store
    from .shared import write_table

    found = analyse(write_table(store(_table(spark, sf_dir, "documents")), "media"))
    return found.withColumn("feature", feature_string("fingerprint")).drop("fingerprint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(_table(spark, sf_dir, "documents")))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import link_conversations

    return link_conversations(_table(spark, sf_dir, "conversations"))


def op5_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import sample_and_train, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, sample_and_train(docs, _table(spark, sf_dir, "labels")))


def op6_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict, sample_and_fit

    docs = _table(spark, sf_dir, "documents")
    return predict(docs, sample_and_fit(docs))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op10_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_pivots, op2_wav_peak_pairs, op3_token_files, op4_quotation_links, op5_toxicity_gru, op6_histogram_packing, op7_kneser_ney_quality, op8_language_pieces, op9_decontaminate, op10_secret_battery)
}

ORACLES: dict[str, str] = {"op4_quotation_links": QUOTES_SQL, "op9_decontaminate": DECONTAMINATE_SQL}
