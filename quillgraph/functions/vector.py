"""Vector expressions over array columns, and block top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column, eps: float = 1e-12) -> Column:
    """L2-normalised vector; the norm is taken once a row."""
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(eps)), lambda size: F.transform(v, lambda x: x.cast("double") / size)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def mean_of(*vectors: Column) -> Column:
    """Element-wise mean of the vectors that are not null; null if none is."""

    def total(present: Column) -> Column:
        start = F.transform(F.get(present, F.lit(0)), lambda x: x.cast("double"))
        return F.aggregate(F.slice(present, 2, len(vectors)), start, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))

    def mean(present: Column) -> Column:
        both = F.struct(total(present).alias("v"), F.size(present).alias("n"))
        return let(both, lambda t: F.transform(t["v"], lambda x: x / t["n"]))

    return let(F.filter(F.array(*vectors), lambda v: v.isNotNull()), lambda present: F.when(F.size(present) > 0, mean(present)))


def fuse(*vectors: Column, norm_first: bool) -> Column:
    """Unit mean of the present vectors, each normalised before if ``norm_first``."""
    return unit(mean_of(*[unit(v) if norm_first else v for v in vectors]))


def side_mean(*vectors: Column) -> Column:
    """Mean of unit vectors, not normalised again (image side of an anchor triplet)."""
    return mean_of(*[unit(v) for v in vectors])


def late_fusion(text: Column, image: Column, w_text: float = 0.25, w_image: float = 0.75, agreement: float = 0.0) -> Column:
    image = F.coalesce(image, F.lit(0.0))
    return w_text * text + w_image * image + agreement * text * image


def rank_scores(scores: DataFrame, k: int | None, query: str = "qid", item: str = "idx", digits: int | None = None) -> DataFrame:
    """Adds ``rank`` from 1 by score down, then ``item`` up; keeps the first ``k`` (all if null, none if not positive)."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(score.desc(), F.col(item).asc())))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _in_blocks(df: DataFrame, name: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """(``df`` with a block number ``name`` of about ``rows`` rows each, one row with the number of blocks)."""
    count = df.agg(F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).cast("int").alias(f"{name}_n"))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(f"{name}_n")).cast("int")
    return df.crossJoin(F.broadcast(count)).withColumn(name, place).drop(f"{name}_n"), count


#: How many scores are held at once, 8 bytes each; also bounds the rows that a pair of blocks hands back.
SLICE = 1 << 20


def _matrix(values: list, unit_rows: bool, missing: float = 0.0) -> np.ndarray:
    width = next((len(v) for v in values if v is not None), 1)
    out = np.array([np.full(width, missing) if v is None else v for v in values], np.float64).reshape(-1, width)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12) if unit_rows else out


def _slices(rows: int, columns: int) -> list[slice]:
    """Slices of the rows of a matrix of scores, each of at most ``SLICE`` scores."""
    step = max(1, SLICE // max(1, columns))
    return [slice(i, i + step) for i in range(0, rows, step)]


def _best(qids: np.ndarray, ids: np.ndarray, scores: Callable[[slice, np.ndarray], np.ndarray], k: int | None, digits: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(qid, idx, score) of the best ``k`` a query, from ``scores`` of a slice of queries and an order of the corpus rows."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    for rows in _slices(len(qids), len(ids)):
        s = scores(rows, order)
        s = s if digits is None else np.round(s, digits)
        if k is not None and k < len(ids):
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            s, picked = np.take_along_axis(s, best, 1), ids[best]
        else:
            picked = np.broadcast_to(ids, s.shape)
        yield np.repeat(qids[rows], s.shape[1]), picked.ravel(), s.ravel()


def _scored(parts: list, left, right):
    """A frame of what ``_best`` gave."""
    import pandas as pd

    if not parts:
        return pd.DataFrame({"qid": left["qid"][:0], "idx": right["idx"][:0], "score": np.zeros(0)})
    return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("qid", "idx", "score"), zip(*parts, strict=True), strict=True)})


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _cells(queries: DataFrame, corpus: DataFrame, run: Callable, schema: str, block: int, corpus_block: int) -> DataFrame:
    """``run`` of every pair of a block of queries and a block of corpus rows, a group each."""
    q, q_count = _in_blocks(queries, "_q", block)
    c, c_count = _in_blocks(corpus, "_c", corpus_block)
    each = lambda df, count, name: df.crossJoin(F.broadcast(count)).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"{name}_n") - 1))).drop(f"{name}_n")
    q, c = each(q, c_count, "_c"), each(c, q_count, "_q")
    key = ["_q", "_c"]
    return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(run, schema)


def block_product(
    queries: DataFrame, corpus: DataFrame, columns: dict[str, bool], combine: Callable[..., np.ndarray], k: int | None, digits: int | None = None, block: int = 4096, corpus_block: int = 32768
) -> DataFrame:
    """Scores of every query with every corpus row: ``qid``, ``idx``, ``score``, the best ``k`` a query (all if null).

    ``columns`` names the vector columns of both sides and whether the corpus
    vectors are made unit vectors (queries always are); ``combine`` takes one
    matrix of dot products a column, in which a missing vector counts as 0.

    Both sides are dealt into blocks, every pair of blocks is one group of
    bounded size, whose scores are made ``SLICE`` at a time, and only the best
    ``k`` of a pair are shuffled to be merged. Nothing passes through the
    driver. Both inputs are read twice (for their counts), so computed vectors
    should be stored first. With ``digits``, scores are rounded before they are
    compared; ties go to the smaller ``idx``.
    """
    names = list(columns)
    if k is None or k > 4096:  # what a pair hands back is bounded too
        corpus_block = min(corpus_block, 4096)
    block = min(block, max(1, SLICE // (corpus_block if k is None else min(max(k, 1), corpus_block))))

    def run(left, right):
        if left.empty or right.empty:
            return _scored([], left, right)
        pairs = []
        for name, unit_rows in columns.items():
            a, b = _matrix(list(left[name]), True), _matrix(list(right[name]), unit_rows)
            pairs.append((a, b) if a.shape[1] == b.shape[1] else (np.zeros((len(a), 1)), np.zeros((len(b), 1))))
        scores = lambda rows, order: combine(*[a[rows] @ b.T for a, b in pairs])[:, order]
        return _scored(list(_best(left["qid"].to_numpy(), right["idx"].to_numpy(), scores, k, digits)), left, right)

    return _cells(queries.select("qid", *names), corpus.select("idx", *names), run, f"qid {_kind(queries, 'qid')}, idx {_kind(corpus, 'idx')}, score double", block, corpus_block)


def first_relevant(queries: DataFrame, corpus: DataFrame, digits: int | None = None, block: int = 4096, corpus_block: int = 32768) -> DataFrame:
    """``qid`` and ``pos``: where a query's first relevant row stands in the ranking of the whole corpus; null without one.

    Relevant are the rows with the query's ``label``, other than itself
    (``qid`` = ``idx``). No ranking is made: one product finds each query's best
    relevant row, a second counts the rows that are not relevant and come before
    it; a number a query and block is all that is shuffled.
    """

    def pairs(left, right) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(slice of ``left``, scores, relevant, ids), corpus rows by id."""
        import pandas as pd

        if left.empty or right.empty:
            return
        right = right.sort_values("idx", kind="stable")
        a, b, ids = _matrix(list(left["emb"]), True), _matrix(list(right["emb"]), True), right["idx"].to_numpy()
        label = pd.factorize(pd.concat([left["label"], right["label"]], ignore_index=True))[0]
        mine, theirs, qids = label[: len(left)], label[len(left) :], left["qid"].to_numpy()
        for rows in _slices(len(left), len(right)):
            s = a[rows] @ b.T if a.shape[1] == b.shape[1] else np.zeros((len(a[rows]), len(b)))
            relevant = (mine[rows, None] == theirs) & (mine[rows, None] >= 0) & (qids[rows, None] != ids)
            yield rows, s if digits is None else np.round(s, digits), relevant, ids

    def best(left, right):
        import pandas as pd

        found = [left[["qid"]].iloc[:0].assign(idx=right["idx"][:0], score=np.zeros(0))]
        for rows, s, relevant, ids in pairs(left, right):
            at, some = np.argmax(np.where(relevant, s, -np.inf), axis=1), relevant.any(axis=1)
            found.append(pd.DataFrame({"qid": left["qid"].to_numpy()[rows], "idx": ids[at], "score": s[np.arange(len(s)), at]})[some])
        return pd.concat(found)

    def ahead(left, right):
        import pandas as pd

        found = [left[["qid"]].iloc[:0].assign(n=np.zeros(0, np.int64))]
        for rows, s, relevant, ids in pairs(left, right):
            score, idx = left["_score"].to_numpy()[rows, None], left["_idx"].to_numpy()[rows, None]
            before = ~relevant & ((s > score) | (s == score) & (ids < idx))
            found.append(pd.DataFrame({"qid": left["qid"].to_numpy()[rows], "n": before.sum(axis=1)}))
        return pd.concat(found)

    from .tables import drop_tables, write_table

    qid, columns = f"qid {_kind(queries, 'qid')}", [F.col(x).alias(x) for x in ("emb", "label")]  # anew, as both sides may be of one table
    corpus = corpus.select("idx", *columns)
    each = _cells(queries.select("qid", *columns), corpus, best, f"{qid}, idx {_kind(corpus, 'idx')}, score double", block, corpus_block)
    first = each.groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), "idx")).alias("_f")).select("qid", (-F.col("_f.s")).alias("_score"), F.col("_f.idx").alias("_idx"))
    asking = write_table(queries.select("qid", *columns).join(first, "qid"), "first-relevant")
    counts = _cells(asking, corpus, ahead, f"{qid}, n long", block, corpus_block).groupBy("qid").agg(F.sum("n").alias("n"))
    placed = write_table(counts, "first-positions")
    drop_tables(asking)
    return queries.select("qid").distinct().join(placed, "qid", "left").select("qid", (F.col("n") + 1).alias("pos"))


def topk_within(queries: DataFrame, corpus: DataFrame, key: str, k: int, digits: int | None = None, block: int = 4096, corpus_block: int = 32768) -> DataFrame:
    """Top ``k`` per query among the corpus rows that share a ``key`` with it: ``qid``, ``idx``, ``score``, ``rank``.

    ``queries`` has (``qid``, ``key``, ``emb``), a row for each key of a query;
    ``corpus`` (``idx``, ``key``, ``emb``). Small keys share a group and the
    rows of large ones are dealt into blocks on both sides, so no pair is
    shuffled but the best of a group, and a corpus row goes only to groups of
    queries with its key. A score without a vector is null and comes last.
    """
    rows = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    sizes = rows(queries, "_qs").join(rows(corpus, "_cs"), key)
    groups = sizes.agg(F.greatest(F.ceil(F.coalesce(F.sum("_cs"), F.lit(0)) / corpus_block), F.lit(1)).cast("int").alias("_n"))
    parts = lambda size, most: F.ceil(F.col(size) / most).cast("int")
    plan = sizes.crossJoin(F.broadcast(groups)).select(key, "_n", parts("_qs", block).alias("_qn"), parts("_cs", corpus_block).alias("_cn"))

    def dealt(df: DataFrame, of: str, own: str, other: str) -> DataFrame:
        place = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
        return df.join(plan, key).withColumns({"_g": place(key, "_n"), own: place(of, f"{own}n")}).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}n") - 1))).drop("_n", "_qn", "_cn")

    def run(left, right):
        parts, there = [], right.groupby(key).indices
        for name, at in left.groupby(key).indices.items():
            if name in there:
                l, r = left.iloc[at], right.iloc[there[name]]
                a, b = _matrix(list(l["emb"]), True, np.nan), _matrix(list(r["emb"]), True, np.nan)
                if a.shape[1] != b.shape[1]:
                    a, b = (np.where(np.isnan(x[:, :1]), np.nan, 0.0) for x in (a, b))
                scores = lambda rows, order, a=a, b=b: (a[rows] @ b.T)[:, order]
                parts += _best(l["qid"].to_numpy(), r["idx"].to_numpy(), scores, k, digits)
        return _scored(parts, left, right)

    cell = ["_g", "_q", "_c"]
    q, c = (dealt(df.select(of, *[F.col(x).alias(x) for x in (key, "emb")]), of, *names) for df, of, names in ((queries, "qid", ("_q", "_c")), (corpus, "idx", ("_c", "_q"))))
    best = q.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInPandas(run, f"qid {_kind(queries, 'qid')}, idx {_kind(corpus, 'idx')}, score double")
    return rank_scores(best, k)


def block_topk(queries: DataFrame, corpus: DataFrame, k: int | None, digits: int | None = None, **blocks) -> DataFrame:
    """Top ``k`` per query (all if null) by cosine of (``qid``, ``emb``) with (``idx``, ``emb``): ``qid``, ``idx``, ``score``, ``rank``."""
    if k is not None and k <= 0:
        return queries.select("qid").limit(0).join(corpus.select("idx").limit(0), F.lit(True)).select("qid", "idx", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return rank_scores(block_product(queries, corpus, {"emb": True}, lambda s: s, k, digits, **blocks), k)
