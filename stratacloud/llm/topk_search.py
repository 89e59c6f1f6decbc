"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights; a dimension is a term. A block of candidates is turned into postings (per
term the rows that have it and their weights). Sparse query rows scatter their weighted postings into a dense array of
scores, one term at a time; a partition selection keeps each query's best of the block, and the blocks' bests are
merged. Queries come in blocks too, so that neither side has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacloud.llm._shared import read_table

SCALE = 1024
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 512


def whole_weights(column: pa.Array) -> list[np.ndarray]:
    """floor(SCALE * x) per component of sound vectors; doubles hold these whole numbers exactly, however large."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    offsets = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets - offsets[0], offsets[1:] - offsets[0])]


def _packed(size: int):
    """Rows (id, vector) to blocks: ids, starts of rows, terms and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def block():
            terms = [np.flatnonzero(r) for r in rows]
            at = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
            columns = [np.array(ids, np.int64), at.astype(np.int64), np.concatenate(terms).astype(np.int32), np.concatenate([r[t] for r, t in zip(rows, terms)])]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "at", "terms", "weights"])

        for batch in batches:
            for i, r in zip(batch.column(0).to_pylist(), whole_weights(batch.column(1))):
                ids.append(i)
                rows.append(r)
                if len(ids) == size:
                    yield block()
                    ids, rows = [], []
        if ids:
            yield block()

    return run


_BLOCK = "ids binary, at binary, terms binary, weights binary"


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id: a partition selection, then a sort of what is left."""
    if len(ids) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Postings:
    """A block of candidates by term."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids, order = ids, np.argsort(terms, kind="stable")
        rows, weights, terms = np.repeat(np.arange(len(ids)), np.diff(at))[order], weights[order], terms[order]
        names, first = np.unique(terms, return_index=True)
        self.most = float(np.abs(weights).max(initial=0.0))
        kept = weights.astype(np.int64) if self.most < 2.0**62 else np.array([int(w) for w in weights], object)
        self.of = {int(t): (rows[a:b], kept[a:b]) for t, a, b in zip(names, first, [*first[1:], len(terms)])}


def search_block(query: tuple[np.ndarray, ...], candidates: Postings, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each query's k best candidates of one block as ids and scores.

    Sums that could leave 64 bits run in whole numbers of any size; a score among the best that does not fit is an error.
    """
    q_ids, q_at, q_terms, q_weights = query
    out = []
    for i, q in enumerate(q_ids):
        terms, weights = q_terms[q_at[i] : q_at[i + 1]], q_weights[q_at[i] : q_at[i + 1]]
        small = float(np.abs(weights).sum()) * candidates.most < 2.0**62
        scores = np.zeros(len(candidates.ids), np.int64 if small else object)
        for t, w in zip(terms.tolist(), weights.tolist()):
            if t in candidates.of:
                at, posted = candidates.of[t]
                if not small:
                    scores[at] += int(w) * posted.astype(object)
                elif len(at) == len(scores):
                    scores += int(w) * posted
                else:
                    scores[at] += int(w) * posted
        other = candidates.ids != q
        ids, scores = candidates.ids[other], scores[other]
        if not small:
            order = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k]  # noqa: B023
            ids, scores = ids[order], scores[order]
            if any(not -(1 << 63) <= x < 1 << 63 for x in scores):
                raise OverflowError(f"a score of query {q} does not fit 64 bits")
            scores = scores.astype(np.int64)
        out.append(best_of(ids, scores, k))
    return out


def _searched(k: int):
    """Pairs of blocks to each query's best; what a task finds for one block of queries in a row is merged first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query, best = None, None, []

        def flush() -> pa.RecordBatch:
            columns = np.repeat(query[0], [len(i) for i, _ in best]), np.concatenate([i for i, _ in best]), np.concatenate([x for _, x in best])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                sides = [tuple(np.frombuffer(row[p + n], {"terms": np.int32, "weights": np.float64}.get(n, np.int64)) for n in ("ids", "at", "terms", "weights")) for p in ("q_", "c_")]
                found = search_block(sides[0], Postings(*sides[1]), k)
                key = row["q_ids"], row["q_weights"]
                if key == now:
                    best = [best_of(np.concatenate((a, c)), np.concatenate((b, d)), k) for (a, b), (c, d) in zip(best, found)]
                    continue
                if now is not None:
                    yield flush()
                now, query, best = key, sides[0], found
        if now is not None:
            yield flush()

    return run


def sound(v: Column) -> Column:
    """Vectors that take part: not null, without null or non-finite components."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all candidates but its own id.

    Both frames are (id, vector). Rows without id, null vectors and vectors with null or non-finite components take no
    part. Vectors of different lengths meet in the dimensions that both have. A repeated query id is asked once, with
    its least vector that takes part; repeated candidates are found each. No rows on either side give no rows. Scores
    are exact; one among the k best that leaves 64 bits is an error.

    Tasks form a grid of query parts and candidate parts, as square as the numbers of rows make cheap: each side is sent
    once per part of the other.
    """
    spark = queries.sparkSession
    name = lambda frame: frame.toDF("id", "vector").filter(F.col("id").isNotNull() & sound(F.col("vector")))
    once = name(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    tasks = max(4, 2 * spark.sparkContext.defaultParallelism)
    n_queries, n_candidates = queries.count(), candidates.count()
    across = min(tasks, max(1, round((tasks * n_queries / max(n_candidates, 1)) ** 0.5)), n_queries // query_block + 1)
    down = max(1, tasks // across)
    packed = lambda frame, size, p: frame.mapInArrow(_packed(size), _BLOCK).select(*[F.col(c).alias(f"{p}_{c}") for c in ("ids", "at", "terms", "weights")])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = packed(once, query_block, "q").withColumn("i", own("q_ids", across)).withColumn("j", spread(down))
    c = packed(name(candidates), candidate_block, "c").withColumn("j", own("c_ids", down)).withColumn("i", spread(across))
    found = q.join(c, ["i", "j"]).drop("i", "j").mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best neighbours of every vector whose id is divisible by 100, among all vectors."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
