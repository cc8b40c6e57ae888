"""Ranking and answer metrics as aggregates and column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.text import alnum_tokens, answer_tokens, drop_articles_anywhere, light_normalise, light_tokens

KS = (5, 10, 20, 50, 100)


def ranking_by_query(ranked: DataFrame, qrels: DataFrame, eval_ids: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``qid``, ``k``, ``ndcg``, ``precision``, ``recall`` for every evaluated query and cut-off.

    Linear gain over log2(rank + 1); the ideal uses all grades; precision divides
    by k however few were returned; queries without results or without relevant
    documents count as 0. All cut-offs come from one pass over the hits.
    """
    _positive(ks)
    relevant = qrels.where("rel > 0")
    hits = ranked.where(F.col("rank") <= max(ks)).join(relevant, ["qid", "doc_id"]).select("qid", "rank", "rel")
    return ranking_of_hits(hits, relevant.groupBy("qid", "rel").agg(F.count("*").alias("n")), eval_ids, ks)


def _positive(ks: tuple[int, ...]) -> None:
    if any(k <= 0 for k in ks):
        raise ValueError("cut-offs must be positive")


def ranking_of_hits(hits: DataFrame, grades: DataFrame, eval_ids: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``ranking_by_query`` from the relevant rows found (``qid``, ``rank``, ``rel``) and how many there are of each grade (``qid``, ``rel``, ``n``).

    The ideal comes from the numbers, so judgements are counted, never ranked.
    """
    _positive(ks)
    ids = eval_ids.select("qid").distinct()
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    sums = [0.0]
    for i in range(1, max(ks) + 1):
        sums.append(sums[-1] + 1 / math.log2(i + 1))
    discount = lambda n, k: F.get(F.array(*map(F.lit, sums)), F.least(n, F.lit(k)).cast("int"))  # noqa: E731  of the first n ranks up to k
    until = F.sum("n").over(Window.partitionBy("qid").orderBy(F.col("rel").desc()))
    placed = grades.join(ids, "qid", "left_semi").select("qid", "rel", "n", until.alias("to"))

    def upto(value: Column, k: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("rank") <= k, value)), F.lit(0.0))

    got = hits.groupBy("qid").agg(*[upto(gain, k).alias(f"d{k}") for k in ks], *[upto(F.lit(1.0), k).alias(f"h{k}") for k in ks])
    best = placed.groupBy("qid").agg(*[F.sum(F.col("rel") * (discount(F.col("to"), k) - discount(F.col("to") - F.col("n"), k))).alias(f"i{k}") for k in ks], F.sum("n").alias("n"))
    joined = ids.join(got, "qid", "left").join(best, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("k"),
            zero(F.try_divide(F.col(f"d{k}"), F.col(f"i{k}"))).alias("ndcg"),
            (zero(F.col(f"h{k}")) / k).alias("precision"),
            zero(F.try_divide(F.col(f"h{k}"), F.col("n"))).alias("recall"),
        )
        for k in ks
    ])
    return joined.select("qid", F.explode(rows).alias("m")).select("qid", "m.*")


def ranking_means(by_query: DataFrame) -> DataFrame:
    return by_query.groupBy("k").agg(*[F.avg(m).alias(m) for m in ("ndcg", "precision", "recall")])


def hits_mrr(position: Column, ks: tuple[int, ...] = (1, 3, 5, 10)) -> list[Column]:
    """Aggregates over a 1-based answer position (null or 0: absent)."""
    there = F.when(position >= 1, position)
    return [F.avg(F.when(there <= k, 1.0).otherwise(0.0)).alias(f"hits_{k}") for k in ks] + [F.avg(F.coalesce(1 / there, F.lit(0.0))).alias("mrr")]


def exact_match(pred: Column, gold: Column) -> Column:
    p, g = light_normalise(pred), light_normalise(gold)
    return F.when((g != "") & (p == g), 1.0).otherwise(0.0)


def contains(pred: Column, gold: Column) -> Column:
    p, g = light_normalise(pred), light_normalise(gold)
    return F.when((g != "") & F.contains(p, g), 1.0).otherwise(0.0)


def _numbered(tokens: Column) -> Column:
    """Each token with the number of its occurrence, so that a multiset becomes a set; one sort, then linear."""

    def runs(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda t: (t["i"] == 0) | (t["x"] != F.get(s, F.greatest(t["i"] - 1, F.lit(0)))))
        several = lambda f: F.transform(f, lambda t, k: let(F.coalesce(F.get(f, k + 1)["i"], F.size(s)) - t["i"], lambda n: F.transform(F.sequence(F.lit(1), n), lambda j: F.concat_ws("\u0002", t["x"], j.cast("string")))))
        return F.flatten(let(firsts, several))

    return let(F.array_sort(tokens), runs)


def _matched(a: Column, b: Column) -> Column:
    """Multiset overlap of two arrays of strings."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def token_f1(pred: Column, gold: Column, light: bool = False) -> Column:
    """F1 of token multisets; both empty 1, one empty 0. ``light`` keeps punctuation and articles and adds no epsilon."""
    p, g = (light_tokens(pred), light_tokens(gold)) if light else (answer_tokens(pred), answer_tokens(gold))

    def score(t: Column) -> Column:
        n, m, common = F.size(t["p"]), F.size(t["g"]), _matched(t["p"], t["g"])
        f1 = let(F.struct((common / n).alias("p"), (common / m).alias("r")), lambda x: F.when(x["p"] == 0, 0.0).otherwise(2 * x["p"] * x["r"] / (x["p"] + x["r"] + (0.0 if light else 1e-12))))
        return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(f1)

    return let(F.struct(p.alias("p"), g.alias("g")), score)


def _ngrams(tokens: Column, n: int) -> Column:
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), "\u0001"))).otherwise(F.array().cast("array<string>"))


def bleu(pred_tokens: Column, gold_tokens: Column, smooth: bool = True, orders: int = 4) -> Column:
    """Sentence BLEU: geometric mean of n-gram precisions (one added to both counts if ``smooth``) times brevity.

    An order without an n-gram in the prediction, or without a match when not
    smoothed, makes the score 0.
    """
    extra = 1 if smooth else 0

    def ratio(t: Column, n: int) -> Column:
        grams = F.struct(_ngrams(t["p"], n).alias("p"), _ngrams(t["g"], n).alias("g"))
        return let(grams, lambda z: F.when(F.size(z["p"]) == 0, 0.0).otherwise((_matched(z["p"], z["g"]) + extra) / (F.size(z["p"]) + extra)))

    def score(t: Column) -> Column:
        c, r = F.size(t["p"]), F.size(t["g"])
        mean = let(F.array(*[ratio(t, n) for n in range(1, orders + 1)]), lambda x: F.when(F.array_min(x) > 0, F.exp(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.log(v)) / orders)).otherwise(0.0))
        brevity = F.when(c > r, 1.0).otherwise(F.exp(1 - r / F.greatest(c, F.lit(1))))
        return F.when((c == 0) | (r == 0), 0.0).otherwise(brevity * mean)

    return let(F.struct(pred_tokens.alias("p"), gold_tokens.alias("g")), score)


def bleu4(pred: Column, gold: Column, light: bool = False) -> Column:
    tokens = alnum_tokens if light else answer_tokens
    return bleu(tokens(pred), tokens(gold))


def _char_bleu(pred: Sequence[str], gold: Sequence[str]) -> np.ndarray:
    """``bleu`` without smoothing over the characters of each pair of strings; all n-grams of a batch are matched in one sort an order."""
    codes = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    c, r = (np.array([len(x) for x in texts], np.int64) for texts in (pred, gold))
    rows = np.concatenate([np.repeat(np.arange(len(x)), x) for x in (c, r)])
    side = np.repeat([0, 1], [c.sum(), r.sum()])
    start = np.concatenate([np.repeat(np.cumsum(x) - x, x) for x in (c, r)]) + side * c.sum()
    left = np.concatenate([np.repeat(x, x) for x in (c, r)]) - (np.arange(len(rows)) - start)  # characters from here on
    letters = np.unique(np.concatenate([codes(pred), codes(gold)]), return_inverse=True)[1].astype(np.int64)
    total, gram = np.zeros(len(c)), letters
    for n in range(1, 5):
        if n > 1:  # an n-gram is the one before with its next character, numbered anew
            after = np.append(letters[n - 1 :], np.zeros(min(n - 1, len(letters)), np.int64))
            gram = np.unique(gram * (letters.max(initial=0) + 1) + after, return_inverse=True)[1].astype(np.int64)
        full = left >= n
        key, where = np.unique(rows[full] * (gram.max(initial=0) + 1) + gram[full], return_inverse=True)
        counts = np.bincount(where * 2 + side[full], minlength=2 * len(key)).reshape(-1, 2)
        hit = np.bincount(key // (gram.max(initial=0) + 1), counts.min(axis=1), len(c))
        with np.errstate(divide="ignore"):
            total += np.log(np.where(c >= n, hit / np.maximum(c - n + 1, 1), 0))
    return np.where((c == 0) | (r == 0), 0.0, np.where(c > r, 1.0, np.exp(1 - r / np.maximum(c, 1))) * np.exp(total / 4))


def char_bleu(pred: Column, gold: Column) -> Column:
    """Unsmoothed BLEU-4 over the characters of the normalised answers."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(p: pd.Series, g: pd.Series) -> pd.Series:
        parts, at, size = [], 0, 0
        lengths = (p.str.len() + g.str.len()).tolist()
        for i, n in enumerate(lengths):  # about 260,000 characters at once
            size += n
            if size >= 1 << 18 or i + 1 == len(lengths):
                parts.append(_char_bleu(p.iloc[at : i + 1].tolist(), g.iloc[at : i + 1].tolist()))
                at, size = i + 1, 0
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(*[F.array_join(answer_tokens(x), " ") for x in (pred, gold)])


def answer_scores(pred: Column, gold: Column, light: bool) -> dict[str, Column]:
    return {"em": exact_match(pred, gold), "f1": token_f1(pred, gold, light), "contains": contains(pred, gold), "bleu": bleu4(pred, gold, light)}


def score_answers(rows: DataFrame, mode: str = "best", light: bool = True) -> DataFrame:
    """Adds ``em``, ``f1``, ``contains``, ``bleu`` of ``pred_text`` against ``golds``.

    ``best`` takes each metric's maximum over the golds (none: one empty gold);
    ``joined`` scores against all golds joined by newlines.
    """
    golds = F.when(F.size(F.coalesce("golds", F.array().cast("array<string>"))) > 0, F.col("golds")).otherwise(F.array(F.lit("")))
    if mode == "joined":
        return rows.withColumns(answer_scores(F.col("pred_text"), F.array_join(golds, "\n"), light))
    if mode != "best":
        raise ValueError(f"unknown mode {mode}")
    scored = F.transform(golds, lambda g: F.struct(*[v.alias(k) for k, v in answer_scores(F.col("pred_text"), g, light).items()]))
    return rows.withColumn("_s", scored).withColumns({m: F.array_max(F.col(f"_s.{m}")) for m in ("em", "f1", "contains", "bleu")}).drop("_s")


def answer_means(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in ("em", "f1", "contains", "bleu")])


def closed_metrics(truth: Column, pred: Column) -> list[Column]:
    """Accuracy, and precision, recall and F1 of class 1; a zero denominator gives 0."""
    tp, fp, fn = (F.count_if(x) for x in ((truth == 1) & (pred == 1), (truth != 1) & (pred == 1), (truth == 1) & (pred != 1)))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return [zero(F.count_if(truth == pred), F.count("*")).alias("accuracy"), zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1")]


def open_metrics(pred: Column, gold: Column) -> list[Column]:
    text = lambda c: F.array_join(answer_tokens(c), " ")
    return [F.avg(char_bleu(pred, gold)).alias("bleu"), F.avg(F.when(text(pred) == text(gold), 1.0).otherwise(0.0)).alias("em"), F.avg(token_f1(pred, gold)).alias("f1")]


def lenient_accuracy(pred: Column, gold: Column) -> Column:
    """Percent of answers equal once articles are cut out anywhere."""
    return (100 * F.avg(F.when(drop_articles_anywhere(pred) == drop_articles_anywhere(gold), 1.0).otherwise(0.0))).alias("accuracy")


def choice_accuracy(pred: Column, answer: Column) -> Column:
    return (100 * F.avg(F.when(pred == answer, 1.0).otherwise(0.0))).alias("accuracy")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def coverage(queries: DataFrame, qrels: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row: queries, those with judgements, those with mapped judgements."""
    tag = lambda d, name: d.select("qid").distinct().withColumn(name, F.lit(True))
    rows = queries.select("qid").distinct().join(tag(qrels, "_a"), "qid", "left").join(tag(mapped, "_b"), "qid", "left")
    return rows.agg(F.count("*").alias("total"), F.count("_a").alias("with_qrels"), F.count("_b").alias("mapped"))


def dataset_stats(queries: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: queries, multimodal percent, triplets, answers."""
    q = queries.agg(F.count("*").alias("queries"), (100 * F.avg(F.when(F.coalesce("is_multimodal", F.lit(False)), 1.0).otherwise(0.0))).alias("multimodal_percent"))
    return q.crossJoin(corpus.agg(F.count("*").alias("triplets"))).crossJoin(qrels.where("rel > 0").agg(F.count("*").alias("answers")))
