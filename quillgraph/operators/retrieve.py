"""Retriever families as DataFrame plans over all queries at once.

A corpus is ``idx``, ``doc_id`` and what the retriever needs of ``text_emb``,
``head``, ``head_emb``, ``tail_emb``, ``text``; queries are ``qid`` with
``text_emb`` and, where there is an image, ``image_emb``. Results are ``qid``,
``idx``, ``score``, ``rank``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.tables import drop_tables, write_table
from ..functions.text import first_words, strip_image_token
from ..functions.vector import block_product, block_topk, fuse, late_fusion, rank_scores, side_mean, topk_within, unit


@dataclass(frozen=True)
class Family:
    """How one generation of the task treats texts, images and scores."""

    lower: bool = False
    strip_token: bool = False
    max_words: int | None = None
    missing_text: str = "id"
    exclude_image_heads: bool = False
    norm_first_corpus: bool = True
    norm_first_query: bool = False
    both_sides: bool = False
    ascending_random: bool = False
    anchor_by_text: bool = False
    guard_k: bool = True


FAMILIES: dict[str, Family] = {
    "G": Family(),
    "M": Family(lower=True, strip_token=True, max_words=60, exclude_image_heads=True, norm_first_query=True),
    "A": Family(missing_text="omit", norm_first_corpus=False, both_sides=True, ascending_random=True, anchor_by_text=True),
    "Q": Family(missing_text="omit", norm_first_corpus=False, both_sides=True, ascending_random=True, anchor_by_text=True),
    "V": Family(missing_text="omit", norm_first_corpus=False, both_sides=True, ascending_random=True),
    "D": Family(lower=True, missing_text="omit", exclude_image_heads=True, norm_first_corpus=False, norm_first_query=True, ascending_random=True, anchor_by_text=True),
}


def query_text(c: Column, family: Family) -> Column:
    c = strip_image_token(c) if family.strip_token else c
    c = F.lower(c) if family.lower else c
    return first_words(c, family.max_words) if family.max_words else c


def analogy_text(head: Column, tail: Column, question: Column) -> Column:
    """Query text of an analogy for plain text search: its three texts, whatever the mode."""
    return F.concat_ws(" ", head, tail, question)


def analogy_anchor_text(mode: Column, head: Column, tail: Column, question: Column) -> Column:
    """Query text of an analogy for the anchor and weighted searches, by its mode."""
    return F.when(mode == 0, analogy_text(head, tail, question)).when(mode == 1, question).otherwise(tail)


def analogy_anchor_image(mode: Column, head: Column, tail: Column, question: Column) -> Column:
    """Query image vector of an analogy for the anchor and weighted searches: the question's, or a mean of two."""
    return unit(F.when(mode == 0, unit(question)).when(mode == 1, side_mean(head, tail)).otherwise(side_mean(head, question)))


def choice_query(question: Column, hint: Column) -> Column:
    """Query vector of a multiple-choice problem: the mean of question and hint vectors; a null hint vector (no hint) is left out."""
    return fuse(hint, question, norm_first=False)


def random_topk(queries: DataFrame, n: int, k: int, seed: str = "42", ascending: bool = False) -> DataFrame:
    """``k`` distinct positions of ``n`` per query, every such set as likely as any other; scores run k..1, or 1..k.

    Floyd's sampling: for j = n-k .. n-1 a hashed draw from 0..j enters, or j
    itself where the draw is in already. The order is that of a keyed hash. The
    work depends on ``k`` alone.
    """
    k = max(0, min(k, n))
    if k == 0:
        return queries.select("qid").limit(0).selectExpr("qid", "0L as idx", "0.0D as score", "0 as rank")
    draw = lambda j: F.pmod(F.xxhash64(F.lit(f"{seed}:draw"), F.col("qid"), j), j + 1)
    step = lambda got, j: let(draw(j), lambda t: F.concat(got, F.array(F.when(F.array_contains(got, t), j).otherwise(t))))
    drawn = F.aggregate(F.sequence(F.lit(n - k).cast("long"), F.lit(n - 1).cast("long")), F.array().cast("array<bigint>"), step)
    ordered = F.array_sort(F.transform(drawn, lambda i: F.struct(F.xxhash64(F.lit(f"{seed}:order"), F.col("qid"), i).alias("h"), i.alias("i"))))
    rows = queries.select("qid", F.posexplode(ordered).alias("_p", "_s"))
    score = (F.col("_p") + 1 if ascending else k - F.col("_p")).cast("double")
    return rows.select("qid", F.col("_s.i").alias("idx"), score.alias("score"), (F.col("_p") + 1).cast("int").alias("rank"))


def text_topk(queries: DataFrame, corpus: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    return block_topk(queries.select("qid", F.col("text_emb").alias("emb")), corpus.select("idx", F.col("text_emb").alias("emb")), k, digits)


def multimodal_topk(queries: DataFrame, corpus: DataFrame, k: int, family: Family) -> DataFrame:
    """Means of text and image vectors on both sides."""
    sides = [F.col("text_emb"), F.col("head_emb")] + ([F.col("tail_emb")] if family.both_sides else [])
    c = corpus.select("idx", fuse(*sides, norm_first=family.norm_first_corpus).alias("emb"))
    q = queries.select("qid", fuse(F.col("text_emb"), F.col("image_emb"), norm_first=family.norm_first_query).alias("emb"))
    return block_topk(q, c, k)


def analogy_query(mode: Column, head_text: Column, tail_text: Column, question_text: Column, head_image: Column, tail_image: Column, question_image: Column) -> Column:
    """Query vector of an analogy by its mode: two texts and an image, two images and a text, or image, text and image."""
    two_texts = fuse(head_text, tail_text, question_image, norm_first=False)
    two_images = fuse(head_image, tail_image, question_text, norm_first=False)
    mixed = fuse(head_image, tail_text, question_image, norm_first=False)
    return F.when(mode == 0, two_texts).when(mode == 1, two_images).otherwise(mixed)


def anchor_topk(queries: DataFrame, corpus: DataFrame, k: int, n_img: int = 10, digits: int | None = None) -> DataFrame:
    """Two stages: heads nearest to the query image, then text order among their triplets.

    Queries without an image, and all queries if no head has one, fall back to
    plain text order. Each corpus row meets only the queries that chose its head,
    in blocks, and only the best ``k`` of a block are shuffled.
    """
    heads = corpus.where("head_emb is not null").groupBy("head").agg(F.min_by("head_emb", "idx").alias("emb"))
    heads = write_table(heads.select(F.col("head").alias("idx"), "emb"), "anchor-heads")
    with_image = queries.where("image_emb is not null")
    nearest = block_topk(with_image.select("qid", F.col("image_emb").alias("emb")), heads, n_img, digits)
    chosen = write_table(nearest.select("qid", F.col("idx").alias("head")).distinct(), "anchor-chosen")
    drop_tables(heads)
    asking = chosen.join(queries.select("qid", F.col("text_emb").alias("emb")), "qid")
    among = topk_within(asking, corpus.select("idx", "head", F.col("text_emb").alias("emb")), "head", k, digits)
    rest = queries.join(chosen.select("qid").distinct(), "qid", "left_anti")
    return among.unionByName(text_topk(rest, corpus, k, digits))


def anchor_by_text(queries: DataFrame, corpus: DataFrame, k: int, n_img: int = 10, n_text: int = 5, digits: int | None = None) -> DataFrame:
    """The older anchor: images fix how many rows come, texts fix which.

    A query with an image takes the distinct ``text`` values nearest to its
    text (of equal texts the smallest ``idx``), up to ``min(k, n_img * n_text,
    rows with an image * n_text)``. Without an image on either side it takes the
    first ``n_text`` rows, repeated texts included.
    """
    of = lambda d, key: d.select(key, F.col("text_emb").alias("emb"))
    pictured = corpus.where("head_emb is not null or tail_emb is not null").limit(n_img).count()
    asking = queries.where("image_emb is not null") if pictured else queries.limit(0)
    most = min(k, n_img * n_text, pictured * n_text)
    once = corpus.groupBy("text").agg(F.min("idx").alias("idx"), F.min_by("text_emb", "idx").alias("text_emb"))
    rest = queries.where("image_emb is null") if pictured else queries
    plain = block_topk(of(rest, "qid"), of(corpus, "idx"), n_text, digits)
    return block_topk(of(asking, "qid"), of(once, "idx"), most, digits).unionByName(plain) if pictured else plain


def weighted_scores(text_scores: DataFrame, image_scores: DataFrame, w_text: float = 0.25, w_image: float = 0.75, agreement: float = 0.0) -> DataFrame:
    """Late fusion of two score tables; a missing image score is 0."""
    image = image_scores.select("qid", "idx", F.col("score").alias("_i"))
    return text_scores.join(image, ["qid", "idx"], "left").select("qid", "idx", late_fusion(F.col("score"), F.col("_i"), w_text, w_image, agreement).alias("score"))


def weighted_topk(queries: DataFrame, corpus: DataFrame, k: int | None, w_text: float = 0.25, w_image: float = 0.75, agreement: float = 0.0, digits: int | None = None) -> DataFrame:
    """Late fusion: ``w_text * t + w_image * i + agreement * t * i`` of the text and image cosines.

    A triplet's image vector is the plain mean of its unit head and tail
    vectors; where a side has no image, i is 0.
    """
    c = corpus.select("idx", "text_emb", side_mean(F.col("head_emb"), F.col("tail_emb")).alias("image_emb"))
    fused = lambda t, i: w_text * t + w_image * i + agreement * t * i
    return rank_scores(block_product(queries, c, {"text_emb": True, "image_emb": False}, fused, k, digits), k)


def caption_text(corpus: DataFrame, captions: DataFrame, entities_only: bool = False, both_sides: bool = False) -> DataFrame:
    """Corpus with head (and tail) texts replaced by the image caption where there is one.

    ``entities_only`` captions image entities alone (``image_`` in the text or an
    id that starts with ``I``), and ignores empty captions.
    """
    out = corpus
    for side in ("head", "tail") if both_sides else ("head",):
        known = captions.select(F.col("entity_id").alias(f"{side}_id"), F.col("caption").alias("_c"))
        usable = F.col("_c").isNotNull()
        if entities_only:
            usable = usable & (F.col("_c") != "") & (F.contains(F.lower(F.coalesce(f"{side}_text", F.lit(""))), F.lit("image_")) | F.startswith(f"{side}_id", F.lit("I")))
        out = out.join(known, f"{side}_id", "left").withColumn(f"{side}_text", F.when(usable, F.col("_c")).otherwise(F.coalesce(f"{side}_text", f"{side}_id"))).drop("_c")
    return out


def no_retrieval(queries: DataFrame) -> DataFrame:
    return queries.select("qid").limit(0).selectExpr("qid", "0L as idx", "0.0D as score", "0 as rank")


RETRIEVERS: dict[str, Callable[..., DataFrame]] = {
    "Random": lambda q, c, k, family, **o: random_topk(q, c.count(), k, ascending=family.ascending_random, **o),
    "SimpleText": lambda q, c, k, family, **o: text_topk(q, c, k, **o),
    "SimpleMultimodal": lambda q, c, k, family, **o: multimodal_topk(q, c, k, family),
    "MMAnchor": lambda q, c, k, family, **o: (anchor_by_text if family.anchor_by_text else anchor_topk)(q, c, k, **o),
    "MMWeighted": lambda q, c, k, family, **o: weighted_topk(q, c, k, **o),
    "Caption": lambda q, c, k, family, **o: text_topk(q, c, k, **o),
    "None": lambda q, c, k, family, **o: no_retrieval(q),
}


def search(name: str, queries: DataFrame, corpus: DataFrame, k: int, family: str = "G", **options) -> DataFrame:
    """Run a retriever by name; unknown names and families raise ``ValueError``."""
    if name not in RETRIEVERS:
        raise ValueError(f"unknown retriever {name}; known: {', '.join(RETRIEVERS)}")
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    return RETRIEVERS[name](queries, corpus, k, FAMILIES[family], **options)
