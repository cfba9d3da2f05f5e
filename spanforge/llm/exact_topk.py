"""Exact nearest vectors by pivot-table elimination.

Vectors are turned into whole numbers, floor(256 x). Each vector keeps its Euclidean distances to ``PIVOTS``
pivots. For a query q and a candidate x the largest |d(q, p) - d(x, p)| over all pivots p is a lower bound of d(q, x), so
(|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of the inner product. The bounds eliminate twice:

1. Before the shuffle. Candidates belong to the cell of their nearest pivot, cells are dealt into blocks. Each query first meets one block of its own cell, which gives a k-th
   best score so far. A cell's least and largest distances to every pivot bound its inner products with the query; the query goes to the blocks of those cells only whose bound reaches
   that score, and blocks go only where queries ask for them.
2. Within a block. Candidates are evaluated in the order of their bounds until these fall below the k-th best score; those whose bound equals it are still evaluated, as ties go
   to the smaller id.

A task has one block of candidates and one block of queries, and yields at most k rows for each query; a window over the few rows of each query gives the result. The pivots are vectors
with the smallest hashes, ``PIVOTS`` of them whatever the table's size; they affect only the speed.

Vectors that are null, or hold null or non-finite components, take no part; rows with a null id take no part. An empty table gives an empty result. Vectors of different lengths are
compared over the shorter one's components. A vec_id that is repeated is as many candidates (equal scores in any order); none of them is a candidate of its own id's query,
and its query runs once for each distinct vector, with a result for each. Columns beside vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from spanforge.llm.common import cut, table

K, EVERY, PIVOTS, QUERY_BLOCK, BLOCK = 5, 50, 24, 1024, 4096
STEP = 64
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v: the components as floor(256 x), doubles; unusable rows are left out."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(usable & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def best_of_block(q_ids: np.ndarray, q: np.ndarray, q_far: np.ndarray, c_ids: np.ndarray, c: np.ndarray, c_far: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate ids, scores) of the k best candidates of each query; those below ``least``, a score of each query, may be left out."""
    bound = np.zeros((len(q), len(c)))
    gap = np.empty_like(bound)
    for p in range(q_far.shape[1]):
        np.subtract(q_far[:, p, None], c_far[None, :, p], out=gap)
        np.abs(gap, out=gap)
        np.maximum(bound, gap, out=bound)
    np.maximum(bound - 1e-6 * (1 + bound), 0, out=bound)  # distances are rounded
    upper = ((q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - bound * bound) / 2
    for i in range(len(q)):
        own = c_ids == q_ids[i]
        up = np.where(own, -np.inf, upper[i])
        order = np.argsort(-up, kind="stable")
        order = order[: len(order) - int(own.sum())]
        ids, scores, at = np.zeros(0, np.int64), np.zeros(0), 0
        step = STEP
        while at < len(order):
            if len(scores) >= k and up[order[at]] < scores[k - 1] - 0.5 or least is not None and up[order[at]] < least[i] - 0.5:
                break
            now = order[at : at + step]
            ids, scores = np.concatenate([ids, c_ids[now]]), np.concatenate([scores, c[now] @ q[i]])
            keep = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[keep], scores[keep]
            at += step
            step *= 2
        yield i, ids, scores


def search(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query (rows whose vec_id is divisible by ``every``)."""
    spark = vectors.sparkSession
    found = whole_vectors(vectors)
    first = found.withColumn("_h", F.xxhash64("v")).orderBy("_h").limit(pivots).select("v").collect()  # bounded: ``pivots`` rows
    width = max((len(r.v) for r in first), default=0)
    table_of = [[*r.v, *[0.0] * (width - len(r.v))] for r in first]

    points = np.array(table_of, float).reshape(len(table_of), width)

    @F.pandas_udf("array<double>")
    def distances(v: pd.Series) -> pd.Series:
        wide = max(width, int(v.map(len).max()) if len(v) else 0)
        x, p = _matrix(v, wide), np.zeros((len(points), wide))
        p[:, :width] = points
        far = np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in p], 1) if len(p) else np.zeros((len(x), 0))
        return pd.Series(list(far))

    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    nearest = F.coalesce(F.array_position("far", F.array_min("far")) - 1, F.lit(0)) if table_of else F.lit(0)
    # the row's number is written with it, so that its block stays the same whatever is recomputed
    placed = found.withColumn("far", distances("v")).withColumns({"size": squares, "cell": nearest.cast("long"), "salt": F.monotonically_increasing_id()})
    placed = cut(placed, "pivots")
    ends = [f(F.col("far")[p]).alias(f"{n}{p}") for p in range(len(table_of)) for n, f in (("lo", F.min), ("hi", F.max))]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("size").alias("size"), *ends).orderBy("cell").collect()  # a row for each pivot
    if not cells:
        return spark.createDataFrame([], RESULT)
    parts = F.create_map(*[F.lit(x) for c in cells for x in (c["cell"], -(-c["n"] // BLOCK))])  # blocks of a cell
    part = F.pmod(F.xxhash64("vec_id", "salt"), parts[F.col("cell")])
    asked = placed.where(F.col("vec_id") % every == 0).withColumn("query", F.xxhash64("v")).dropDuplicates(["vec_id", "query"])
    # queries are dealt into blocks in the order of their cells, so that those of one block are near each other
    counts, before, spots = asked.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect(), 0, [F.lit(-1).cast("long"), F.array(F.lit(0), F.lit(1))]
    for r in counts:
        spots += [F.lit(r["cell"]), F.array(F.lit(before), F.lit(r["n"]))]
        before += r["n"]
    spot = F.create_map(*spots)[F.col("cell")]
    asked = asked.withColumn("qb", F.floor((spot[0] + F.pmod(F.xxhash64(F.lit(7), "vec_id", "query"), spot[1])) / QUERY_BLOCK))
    asked = cut(asked.select("vec_id", "query", "v", "far", "size", "cell", "qb", part.alias("home")), "asked")
    candidates = placed.select("vec_id", "v", "far", "cell", part.alias("part"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int, int]] = []
        if len(left) and len(right):
            width = max(left.v.map(len).max(), right.v.map(len).max())
            far = len(left.far.iloc[0])
            c, c_far = _matrix(right.v, width), _matrix(right.far, far)
            for a in range(0, len(left), 128):  # bounds of 128 queries at a time
                some = left.iloc[a : a + 128]
                for i, ids, scores in best_of_block(some.vec_id.to_numpy(), _matrix(some.v, width), _matrix(some.far, far), right.vec_id.to_numpy(), c, c_far, k, some.least.to_numpy()):
                    rows += [(int(some.vec_id.iloc[i]), int(some["query"].iloc[i]), int(x), int(s)) for x, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(rows, columns=["query_id", "query", "vec_id", "score"]).astype("int64")

    def met(queries: DataFrame) -> DataFrame:
        """The best candidates of ``queries`` (qb, cell, part) in the blocks that they ask for."""
        keys = ["qb", "cell", "part"]
        wanted = queries.select(*(F.col(c).alias(c) for c in keys)).distinct()
        right = candidates.join(wanted, ["cell", "part"])
        return queries.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id bigint, query bigint, vec_id bigint, score bigint")

    columns = ["vec_id", "query", "v", "far", "qb"]
    first_best = cut(met(asked.select(*columns, F.lit(float("-inf")).alias("least"), "cell", F.col("home").alias("part"))), "first")
    kth = first_best.groupBy(F.col("query_id").alias("vec_id"), "query").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    names = np.array([c["cell"] for c in cells])
    lo, hi = (np.array([[c[f"{n}{p}"] for p in range(len(table_of))] for c in cells], float).reshape(len(cells), len(table_of)) for n in ("lo", "hi"))
    sizes = np.array([c["size"] for c in cells])

    @F.pandas_udf("array<bigint>")
    def reached(far: pd.Series, size: pd.Series, least: pd.Series) -> pd.Series:
        """The cells that may hold a vector whose inner product with the query reaches its k-th best so far."""
        x, out = _matrix(far, len(table_of)), []
        for q, n, k_th in zip(x, size.to_numpy(), least.to_numpy(), strict=True):
            gap = np.maximum(np.maximum(q - hi, lo - q).max(1, initial=0.0), 0.0)
            gap = np.maximum(gap - 1e-6 * (1 + gap), 0.0)  # distances are rounded
            out.append(names[(n + sizes - gap * gap) / 2 >= k_th - 0.5])
        return pd.Series(out)

    open_ = reached("far", "size", "least")
    rest = asked.join(kth, ["vec_id", "query"], "left").fillna(float("-inf"), ["least"]).withColumnRenamed("cell", "own").withColumn("cell", F.explode(open_))
    rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts[F.col("cell")].cast("long") - 1))).where("cell <> own OR part <> home")
    best = first_best.unionByName(met(rest.select(*columns, "least", "cell", "part")))
    w = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


QUERIES = {"op5_pivot_topk": lambda spark, sf_dir: search(table(spark, sf_dir, "embeddings"))}
ORACLE = {
    "op5_pivot_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
}
