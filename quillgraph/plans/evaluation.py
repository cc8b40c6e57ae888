"""End-to-end plans: retrieval evaluation, generation, splits, and the older question-answering drivers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import embed, generate, hashing_encoder
from ..functions.text import answer_tokens, extract_letter, letter_index, light_normalise, short_path
from ..operators import dataset as D
from ..operators import metrics as M
from ..operators import prompts as P
from ..operators import retrieve as R


def embedded_corpus(corpus: DataFrame, family: str = "G", load: Callable | None = None, images: DataFrame | None = None, captions: DataFrame | None = None) -> DataFrame:
    """Corpus with ``idx``, ``text``, ``text_emb``, ``head``, ``head_emb``, ``tail_emb``; ``images`` is ``entity_id``, ``emb``."""
    f = R.FAMILIES[family]
    rows = D.without_image_heads(corpus) if f.exclude_image_heads else corpus
    if captions is not None:
        rows = R.caption_text(rows, captions, entities_only=family == "M", both_sides=f.both_sides)
    entities, relations = D.vocabulary(rows)
    said = D.verbalise(D.triplets(rows), entities, relations, f.missing_text, f.lower)
    if f.max_words:
        from ..functions.text import first_words

        said = said.withColumn("text", first_words(F.col("text"), f.max_words))
    out = embed(said, "text", load or hashing_encoder(), "text_emb")
    for side in ("head", "tail"):
        if images is None:
            out = out.withColumn(f"{side}_emb", F.lit(None).cast("array<float>"))
        else:
            out = out.join(images.select(F.col("entity_id").alias(side), F.col("emb").alias(f"{side}_emb")), side, "left")
    return out


def embedded_queries(queries: DataFrame, family: str = "G", load: Callable | None = None, images: DataFrame | None = None) -> DataFrame:
    """Queries with ``text_emb`` and ``image_emb`` (of ``images``: ``qid``, ``emb``; null where there is none)."""
    said = queries.withColumn("question", R.query_text(F.col("query"), R.FAMILIES[family]))
    out = embed(said, "question", load or hashing_encoder(), "text_emb")
    if images is None:
        return out.withColumn("image_emb", F.lit(None).cast("array<float>"))
    return out.join(images.select("qid", F.col("emb").alias("image_emb")), "qid", "left")


def retrieve(queries: DataFrame, corpus: DataFrame, retriever: str, k: int, family: str = "G", **options) -> DataFrame:
    """Ranked documents: ``qid``, ``rank``, ``idx``, ``doc_id``, ``score``."""
    ranked = R.search(retriever, queries, corpus, k, family, **options)
    return ranked.join(corpus.select("idx", "doc_id"), "idx").select("qid", "rank", "idx", "doc_id", F.col("score").cast("double").alias("score"))


def evaluate_retrieval(split: dict[str, DataFrame], retriever: str, setting: str = "", ks: tuple[int, ...] = M.KS, family: str = "G", load: Callable | None = None, limit: int | None = None, query_images: DataFrame | None = None, entity_images: DataFrame | None = None, captions: DataFrame | None = None, **options) -> DataFrame:
    """Mean metrics by ``k`` over all evaluated queries, in one job: ``split`` holds ``queries``, ``corpus``, ``qrels``."""
    ids = D.eval_qids(split["queries"], split["qrels"], positive=family == "G", limit=limit)
    queries = embedded_queries(D.restrict(split["queries"], ids), family, load, query_images)
    corpus = embedded_corpus(split["corpus"], family, load, entity_images, captions)
    ranked = retrieve(queries, corpus, retriever, max(ks), family, **options)
    means = M.ranking_means(M.ranking_by_query(ranked, split["qrels"], ids, ks))
    return means.select(F.lit(setting).alias("setting"), F.lit(retriever).alias("retriever"), "k", "ndcg", "precision", "recall")


def settings(mm: dict[str, DataFrame], text: dict[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """The evaluation settings: each modality alone, A and C on unions, B by remapped judgements, and the hybrid merge."""
    remapped = D.remap_qrels(mm["qrels"], mm["corpus"], text["corpus"])
    return {
        "mm_only": mm,
        "text_only": text,
        "A": {"queries": text["queries"], "corpus": D.union_primary(text["corpus"], mm["corpus"]), "qrels": text["qrels"]},
        "B": {"queries": mm["queries"], "corpus": text["corpus"], "qrels": remapped},
        "C": {"queries": mm["queries"], "corpus": D.union_primary(mm["corpus"], text["corpus"]), "qrels": mm["qrels"]},
        "hybrid": D.merge_hybrid(mm, text),
    }


def evaluate_generation(split: dict[str, DataFrame], ranked: DataFrame, model: Callable, setting: str = "", family: str = "G", mode: str | None = None, top_k: int = 5, query_urls: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one record a query with prompt, golds, prediction and scores; their means)."""
    light, mode = family == "M", mode or ("best" if family == "M" else "joined")
    ids = D.eval_qids(split["queries"], split["qrels"], positive=False)
    normalise = light_normalise if family == "M" else (lambda c: F.array_join(answer_tokens(c), " "))
    golds = D.gold_answers(split["queries"], split["qrels"], split["corpus"], normalise)
    rows = D.restrict(split["queries"], ids).withColumn("question", R.strip_image_token(F.col("query"))).join(golds, "qid", "left")
    rows = rows.join(P.evidence(ranked.where(F.col("rank") <= top_k), split["corpus"], family), "qid", "left")
    rows = rows.join(query_urls, "qid", "left") if query_urls is not None else rows.withColumn("url", F.lit(None).cast("string"))
    kind = "open_medical_kg" if family == "M" else "open_general"
    blocks = P.prepend(F.col("evidence"), P.qa_blocks(F.col("question"), F.col("url"), kind), as_text=family == "M")
    asked = rows.select("qid", "question", "is_multimodal", F.col("url").alias("query_image_path"), "golds", P.flat(blocks).alias("prompt"))
    scored = M.score_answers(generate(asked, "prompt", model), mode, light)
    return scored, M.answer_means(scored.withColumn("setting", F.lit(setting)), "setting")


def make_splits(mm: dict[str, DataFrame], text: dict[str, DataFrame], seed: str = "markg_v1") -> dict[str, dict[str, DataFrame]]:
    """Train, val and test folders' tables: ids are split in one merged space, then taken back to each modality."""
    merged = D.merge_hybrid(mm, text, parts=("queries", "qrels"))
    chosen = D.split_ids(D.eval_qids(merged["queries"], merged["qrels"], positive=False), "qid", seed=seed)
    off = D.next_id(mm["queries"], "qid")
    out = {}
    for name in ("train", "val", "test"):
        ids = chosen.where(F.col("split") == name)
        out[name] = {}
        for side, tables in (("mm", mm), ("text", text)):
            own = D.split_back(ids, off, side)
            corpus = tables["corpus"].withColumn("image_path", short_path(F.col("image_path")))
            out[name] |= {f"{side}_queries": D.restrict(tables["queries"], own), f"{side}_qrels": D.restrict(tables["qrels"], own), f"{side}_corpus": corpus}
    return out


def run_analogies(samples: DataFrame, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Hits and MRR of the answer in rankings; ``rank`` adds ``ranking`` to samples with ``candidates``."""
    return rank(samples).withColumn("pos", F.array_position("ranking", F.col("answer"))).agg(*M.hits_mrr(F.col("pos")))


def run_choices(problems: DataFrame, shots: DataFrame, fmt: str, model: Callable, seed: str = "10") -> DataFrame:
    """Multiple choice: ``pid``, ``output``, ``letter``, ``pred``, ``answer``."""
    asked = P.few_shot(problems, shots, fmt).join(problems.select("pid", "answer", F.size("choices").alias("n")), "pid")
    out = generate(asked, "prompt", model)
    letter = extract_letter(F.col("pred_text"))
    return out.select("pid", F.col("pred_text").alias("output"), letter.alias("letter"), letter_index(letter, F.col("n"), F.concat(F.lit(seed), F.col("pid"))).alias("pred"), "answer")


def run_fact_questions(questions: DataFrame, model: Callable) -> DataFrame:
    """Lenient accuracy in percent over ``question``, ``answer``, ``url``."""
    asked = questions.withColumn("prompt", P.flat(P.qa_blocks(F.col("question"), F.col("url"), "fact")))
    return generate(asked, "prompt", model).agg(M.lenient_accuracy(F.col("pred_text"), F.col("answer")))


def run_medical(samples: DataFrame, model: Callable, closed: bool) -> DataFrame:
    """Metrics of closed (0/1) or open medical questions."""
    kind = "closed_medical" if closed else "open_medical"
    asked = samples.withColumn("prompt", P.flat(P.qa_blocks(F.col("question"), F.col("image_path"), kind)))
    out = generate(asked, "prompt", model)
    if closed:
        return out.agg(*M.closed_metrics(F.col("answer_close"), F.col("pred_text").cast("int")))
    return out.agg(*M.open_metrics(F.col("pred_text"), F.col("answer_text")))
