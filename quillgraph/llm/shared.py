"""Stored tables and training samples of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.tables import BATCH, drop_paths, drop_tables, filesystem, new_path, shared_dir, small_batches, write_table

__all__ = ["BATCH", "bounded_sample", "drop_paths", "drop_tables", "filesystem", "new_path", "shared_dir", "small_batches", "write_table"]


def bounded_sample(rows: DataFrame, label: str, per_label: int, max_chars: int) -> list[Row]:
    """At most ``per_label`` rows of each label, whole texts of at most ``max_chars`` characters in all, by the smallest hash of ``doc_id``.

    ``rows`` has ``doc_id``, the label and ``text``; the choice depends on ids
    and lengths alone. Of rows that repeat an id with one label the least text
    is taken. Hashes are uniform, so a bound on the hash leaves about twice the
    wanted rows of each label, which alone are ranked. Texts beyond what is left
    of ``max_chars`` end a label's sample.
    """
    totals = {r[0]: r.n for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    bounds = {k: -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * per_label // n) for k, n in totals.items()}
    if not bounds:
        return []
    h = F.xxhash64("doc_id")
    near = F.lit(False)
    for k, bound in bounds.items():
        near = near | ((F.col(label) == F.lit(k)) & (h <= F.lit(bound)))
    once = rows.where(near).groupBy("doc_id", label).agg(F.min("text").alias("text"))
    by = Window.partitionBy(label).orderBy(h, "doc_id")
    ranked = once.withColumns({"_n": F.row_number().over(by), "_c": F.sum(F.length(F.coalesce("text", F.lit("")))).over(by)})
    return ranked.where((F.col("_n") <= per_label) & (F.col("_c") <= max_chars)).select("doc_id", label, "text").collect()
