"""Dataset algebra on queries, corpus and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import write_table
from ..functions.text import light_normalise, short_path, strip

TRIPLE = ("head_id", "rel_id", "tail_id")


def dense_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Adds the 0-based position by ``order``, without one task sorting all rows.

    Rows are range-partitioned and sorted once and stored with their partition
    and their rank in it; only one count a partition is summed up over them.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id has the partition in its high bits and the row's rank in the low 33.
    stored = write_table(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranged")
    part, rank = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = stored.groupBy(part.alias("_p")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stored.withColumn("_p", part).join(F.broadcast(sizes.select("_p", before.alias("_before"))), "_p")
    return placed.withColumn(name, (F.col("_before") + rank).cast("long")).drop("_p", "_m", "_before")


def triplets(corpus: DataFrame) -> DataFrame:
    """``idx`` (position by doc_id), ``doc_id``, ``head``, ``relation``, ``tail``; a null id reads ``None``."""
    named = corpus.select("doc_id", *[F.coalesce(F.col(a), F.lit("None")).alias(b) for a, b in zip(TRIPLE, ("head", "relation", "tail"), strict=True)])
    return dense_index(named, "doc_id")


def vocabulary(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity texts, relation texts) as ``id``, ``text``: the first text by doc_id wins, head before tail."""
    sides = corpus.select("doc_id", F.expr("stack(2, head_id, head_text, 0, tail_id, tail_text, 1) as (id, text, pos)"))
    first = lambda rows: rows.where("id <> '' and text is not null").groupBy("id").agg(F.min_by("text", F.struct("doc_id", "pos")).alias("text"))
    return first(sides), first(corpus.select("doc_id", F.col("rel_id").alias("id"), F.col("rel_text").alias("text"), F.lit(0).alias("pos")))


def names_last(kg: DataFrame) -> DataFrame:
    """``id``, ``name``: the last naming by ``idx`` wins, tail after head."""
    sides = kg.select("idx", F.expr("stack(2, head, head_name, 0, tail, tail_name, 1) as (id, name, pos)"))
    return sides.groupBy("id").agg(F.max_by("name", F.struct("idx", "pos")).alias("name"))


def name_ids(kg: DataFrame) -> DataFrame:
    """``name`` and the sorted set of its ids."""
    sides = kg.select(F.expr("stack(2, head, head_name, tail, tail_name) as (id, name)"))
    return sides.groupBy("name").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def adjacency(kg: DataFrame, node: str = "tail", other: str = "head") -> DataFrame:
    """``node``, ``relation`` and the sorted set of neighbours."""
    return kg.groupBy(F.col(node).alias("node"), "relation").agg(F.sort_array(F.collect_set(other)).alias("neighbours"))


def offset(df: DataFrame, **shifts: int | Column) -> DataFrame:
    """Adds to the named id columns."""
    return df.withColumns({c: (F.col(c) + s).cast(df.schema[c].dataType) for c, s in shifts.items()})


def next_id(df: DataFrame, key: str) -> DataFrame:
    """One row: the id after the largest, 0 for an empty table."""
    return df.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("off"))


def _shifted(df: DataFrame, **offsets: DataFrame) -> DataFrame:
    for c, one_row in offsets.items():
        df = df.crossJoin(F.broadcast(one_row)).withColumn(c, (F.col(c) + F.col("off")).cast(df.schema[c].dataType)).drop("off")
    return df


def merge_hybrid(mm: dict[str, DataFrame], text: dict[str, DataFrame], parts: tuple[str, ...] = ("queries", "corpus", "qrels")) -> dict[str, DataFrame]:
    """Union in one id space: text ids move beyond the largest multimodal ids."""
    q_off, d_off = next_id(mm["queries"], "qid"), next_id(mm["corpus"], "doc_id") if "corpus" in mm else None
    moved = {"queries": lambda d: _shifted(d, qid=q_off), "corpus": lambda d: _shifted(d, doc_id=d_off), "qrels": lambda d: _shifted(d, qid=q_off, doc_id=d_off) if d_off is not None else _shifted(d, qid=q_off)}
    return {p: mm[p].unionByName(moved[p](text[p]), allowMissingColumns=True) for p in parts}


def union_primary(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Corpus union in which the primary side keeps its ids."""
    return primary.unionByName(_shifted(other, doc_id=next_id(primary, "doc_id")), allowMissingColumns=True)


def eval_qids(queries: DataFrame, qrels: DataFrame, positive: bool = True, limit: int | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """Ids with judgements (with a positive one if asked), only those of ``chosen`` and only the first ``limit`` by id if given."""
    judged = (qrels.where("rel > 0") if positive else qrels).select("qid").distinct()
    out = queries.select("qid").distinct().join(judged, "qid", "left_semi")
    if chosen is not None:
        out = out.join(chosen.select("qid").distinct(), "qid", "left_semi")
    return out.orderBy("qid").limit(limit) if limit is not None else out


def restrict(df: DataFrame, ids: DataFrame, key: str = "qid") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def split_ids(ids: DataFrame, key: str = "qid", train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: str = "markg_v1") -> DataFrame:
    """Adds ``split``: ids in order of SHA-1 of ``seed::id``; floor(n * share) for train, then val, the rest test."""
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError("split shares must sum to 1")
    hashed = ids.select(key).distinct().withColumn("_h", F.sha1(F.concat(F.lit(f"{seed}::"), F.col(key).cast("string"))))
    placed = dense_index(hashed, "_h", name="_i").crossJoin(F.broadcast(ids.agg(F.count_distinct(key).alias("_n"))))
    n_train, n_val = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    name = F.when(F.col("_i") < n_train, "train").when(F.col("_i") < n_train + n_val, "val").otherwise("test")
    return placed.select(key, name.alias("split"))


def split_back(split: DataFrame, off: DataFrame, side: str) -> DataFrame:
    """Merged ids of one modality, back in its own id space."""
    rows = split.crossJoin(F.broadcast(off))
    mine = rows.where("qid < off") if side == "mm" else rows.where("qid >= off").withColumn("qid", F.col("qid") - F.col("off"))
    return mine.drop("off")


def rewrite_paths(corpus: DataFrame, column: str = "image_path") -> DataFrame:
    return corpus.withColumn(column, short_path(F.col(column)))


def without_image_heads(corpus: DataFrame, column: str = "head_text") -> DataFrame:
    return corpus.where(~F.coalesce(F.contains(F.lower(column), F.lit("image_")), F.lit(False)))


def edges_with_text(edges: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends and relation all have a text, the others)."""
    e = entities.select("id").distinct()
    tagged = edges
    for side, known in (("head", e), ("tail", e), ("relation", relations.select("id").distinct())):
        tagged = tagged.join(known.select(F.col("id").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
    ok = F.coalesce(F.col("_head") & F.col("_tail") & F.col("_relation"), F.lit(False))
    flags = ["_head", "_tail", "_relation"]
    return tagged.where(ok).drop(*flags), tagged.where(~ok).drop(*flags)


# The corpus fields that go into a retrieved item.
ITEM_FIELDS = ("head_id", "rel_id", "tail_id", "head_text", "rel_text", "tail_text", "triplet_text", "image_path")


def materialise(ranked: DataFrame, corpus: DataFrame, fields: tuple[str, ...] = ITEM_FIELDS) -> DataFrame:
    """Ranked rows with those of the ``fields`` that the corpus has; unknown documents drop out."""
    return ranked.join(corpus.select("doc_id", *[c for c in fields if c in corpus.columns]), "doc_id")


def triple_key(c: str) -> Column:
    return strip(F.coalesce(F.col(c), F.lit("")))


def remap_qrels(qrels: DataFrame, source: DataFrame, target: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Judgements carried to another corpus by equal, non-empty triple keys; repeats keep the largest grade.

    With ``keep_unmatched`` a query without a match stays, with one row whose
    ``doc_id`` and ``rel`` are null: an empty set of judgements.
    """
    key = [f"_{c}" for c in TRIPLE]
    keyed = lambda d, name: d.select(F.col("doc_id").alias(name), *[triple_key(c).alias(k) for c, k in zip(TRIPLE, key, strict=True)])
    there = keyed(target, "to_id").where(" or ".join(f"{k} <> ''" for k in key))
    moved = qrels.where("rel > 0").join(keyed(source, "doc_id"), "doc_id").join(there, key)
    moved = moved.groupBy("qid", F.col("to_id").alias("doc_id")).agg(F.max("rel").alias("rel"))
    if not keep_unmatched:
        return moved
    return qrels.select("qid").distinct().join(moved, "qid", "left")


def first_relevant_image(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """``qid`` and the image path of its smallest relevant doc_id; queries whose first has none drop out."""
    rows = qrels.where("rel > 0").join(corpus.select("doc_id", "image_path"), "doc_id", "left")
    first = rows.groupBy("qid").agg(F.min(F.struct("doc_id", "image_path")).alias("m"))
    return first.select("qid", F.col("m.image_path").alias("image_path")).where(strip(F.col("image_path")) != "")


def image_by_head(queries: DataFrame, images: DataFrame) -> DataFrame:
    return queries.join(images.select(F.col("image_id").alias("_id"), F.col("path").alias("query_image_path")), strip(F.col("head_id")) == F.col("_id"), "left").drop("_id")


def gold_answers(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, normalise=light_normalise, order: str = "doc_id", id_fallback: bool = False) -> DataFrame:
    """``qid`` and ``golds``: the masked side's stripped texts of relevant documents in order, distinct after normalising, no blanks.

    ``masked_type`` counts without outer white space and case; unknown and null
    ones mean the tail. A null text gives no answer, or the id if ``id_fallback``.
    """
    masked = F.lower(strip(F.coalesce("masked_type", F.lit("tail"))))
    side = lambda name: F.coalesce(f"{name}_text", f"{name}_id") if id_fallback else F.col(f"{name}_text")
    text = strip(F.when(masked == "head", side("head")).when(masked.isin("rel", "relation"), side("rel")).otherwise(side("tail")))
    docs = corpus.select("doc_id", "head_id", "rel_id", "tail_id", "head_text", "rel_text", "tail_text")
    rows = qrels.where("rel > 0").join(queries.select("qid", "masked_type"), "qid").join(docs, "doc_id")
    answers = rows.select("qid", F.col(order).alias("o"), text.alias("a")).where("a <> ''")
    once = answers.withColumn("n", normalise(F.col("a"))).groupBy("qid", "n").agg(F.min(F.struct("o", "a")).alias("m"))
    return once.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["a"]).alias("golds"))


def verbalise(triplet_rows: DataFrame, entities: DataFrame, relations: DataFrame, missing: str = "id", lower: bool = False) -> DataFrame:
    """Adds ``text``: head, relation and tail texts joined by blanks; without a text the id stands in, or the part is left out."""
    out = triplet_rows
    for side, known in (("head", entities), ("relation", relations), ("tail", entities)):
        out = out.join(known.select(F.col("id").alias(side), F.col("text").alias(f"_{side}")), side, "left")
    parts = [F.coalesce(f"_{s}", s) if missing == "id" else F.col(f"_{s}") for s in ("head", "relation", "tail")]
    joined = F.concat_ws(" ", *[F.when(p != "", p) for p in parts])
    return out.withColumn("text", F.lower(joined) if lower else joined).drop("_head", "_relation", "_tail")


def dense_ids(names: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """``id`` and dense ``n`` in vocabulary order; restricted and renumbered if ``keep`` is given."""
    kept = names if keep is None else names.join(keep.select("id"), "id", "left_semi")
    return dense_index(kept.select("id", "pos"), "pos", name="n").select("id", "n")


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def flatten_lists(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.explode(column))


def sample_rows(df: DataFrame, n: int, *key: str, seed: str = "42") -> DataFrame:
    """``n`` rows chosen by a seeded hash of their key: a sampling operator, the same picks in every run."""
    return df.orderBy(F.sha1(F.concat_ws("::", F.lit(seed), *[F.col(k).cast("string") for k in key])), *key).limit(n)


def candidate_pools(samples: DataFrame, entities: DataFrame, n: int = 20, seed: str = "42") -> DataFrame:
    """Adds ``candidates``: the answer and ``n - 1`` other entities, in hashed order.

    ``entities`` (``pos`` dense from 0, ``text``) is reached by drawn positions, so
    no sample meets every entity. Repeated draws are drawn past: each of
    ``2 n`` hashed positions counts once, in order.
    """
    total = entities.agg(F.count("*").alias("_total"))
    number = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("sample_id"), i), F.col("_total"))
    draws = samples.select("sample_id", "answer").crossJoin(F.broadcast(total)).select("sample_id", "answer", F.posexplode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(2 * n)), number))).alias("o", "pos"))
    texts = draws.join(entities.select("pos", "text"), "pos").where("text <> answer")
    pools = texts.groupBy("sample_id", "answer").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]), 1, n - 1).alias("c"))
    shuffled = F.transform(F.sort_array(F.transform(F.concat("c", F.array("answer")), lambda t: F.struct(F.sha1(F.concat_ws("::", F.lit(seed), F.col("sample_id").cast("string"), t)).alias("h"), t.alias("t")))), lambda x: x["t"])
    return samples.join(pools.select("sample_id", shuffled.alias("candidates")), "sample_id")


def pretrain_examples(edges: DataFrame, seed: str = "1") -> DataFrame:
    """Two masked examples of each edge: link prediction (tail masked) and relation prediction, with a hashed modality 0, 1 or 2."""
    chance = F.conv(F.substring(F.sha1(F.concat_ws("::", F.lit(seed), "head", "relation", "tail")), 1, 8), 16, 10).cast("double") / 2**32
    modality = F.when(chance <= 0.4, 0).when(chance < 0.7, 1).otherwise(2)
    kind = lambda task, masked: F.struct(F.lit(task).alias("task"), F.col(masked).alias("label"), modality.alias("modality"))
    return edges.select("head", "relation", "tail", F.explode(F.array(kind("link", "tail"), kind("relation", "relation"))).alias("e")).select("head", "relation", "tail", "e.*")


def place_virtual_tokens(df: DataFrame, entity_base: int, relation_base: int, unk: int, pad: int, sep: int) -> DataFrame:
    """Adds ``ids`` with [UNK] places filled by the entity token and [PAD] marks by the relation token, and ``sep_idx``, ``rel_idx``."""
    ids = F.transform("input_ids", lambda x: F.when(x == unk, entity_base + F.col("entity_no")).when(x == pad, relation_base + F.col("relation_no")).otherwise(x))
    at = lambda token: F.filter(F.transform("input_ids", lambda x, i: F.when(x == token, i)), lambda i: i.isNotNull())
    return df.withColumns({"ids": ids, "sep_idx": at(sep), "rel_idx": at(pad)})


def pad_batch(df: DataFrame, column: str, width: int, pad: int = 0) -> DataFrame:
    """Pads or cuts token arrays to one width and adds the attention mask."""
    n = F.least(F.size(column), F.lit(width))
    return df.withColumns({column: F.concat(F.slice(column, 1, width), F.array_repeat(F.lit(pad), width - n)), "attention_mask": F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), width - n))})
