"""Approximate nearest neighbours in learned partitions: a balanced graph partition and a classifier as router."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.session import stored

# The index is fitted on about this many vectors, chosen by a hash of vec_id; every vector is indexed.
SAMPLE_ROWS = 3_000
GRAPH_NEIGHBOURS = 12
PARTITION_ROWS = 4_000  # the number of partitions follows from the rows, as a power of two in these limits
LEAST_PARTITIONS, MOST_PARTITIONS = 16, 512
COPIES = 2  # most probable partitions that a vector is indexed in
PROBED_SHARE = 0.625  # of the partitions, which a query visits at most
PROBED_MASS = 0.999  # of the router's probability, at which it stops earlier
HIDDEN, EPOCHS = 128, 15
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024  # vectors and queries that meet in one task at once
SLACK = 1e-9  # scores of the block product that are compared again, in a fixed order of summation
SCALE = 1 << 53


def usable(vector: Column) -> Column:
    """Not null, not all zero, and free of null and non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray) -> np.ndarray:
    """A symmetric 0/1 matrix: each point with the points of the largest inner product."""
    product = x @ x.T
    np.fill_diagonal(product, -np.inf)
    k = min(GRAPH_NEIGHBOURS, len(x) - 1)
    graph = np.zeros((len(x), len(x)), dtype=np.float32)
    if k > 0:
        graph[np.arange(len(x))[:, None], np.argpartition(-product, k - 1, axis=1)[:, :k]] = 1
    return np.maximum(graph, graph.T)


def halves(graph: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Two sides of equal size with few edges between: a spectral cut, then swaps that lower the cut."""
    n = len(graph)
    degree = graph.sum(axis=1) + 1
    vector = random.standard_normal(n).astype(np.float32)
    for _ in range(60):
        vector -= (degree @ vector) / degree.sum()
        vector = (graph @ vector + vector) / degree
        vector /= np.linalg.norm(vector) + 1e-30
    side = np.zeros(n, dtype=bool)
    side[np.argsort(vector, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        sign = np.where(side, 1.0, -1.0)
        gain = -sign * (graph @ sign)  # edges to the other side less those to its own
        left, right = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (~side, side))
        pairs = min(len(left), len(right), max(1, n // 50))
        better = gain[left[:pairs]] + gain[right[:pairs]] > 2
        if not better.any():
            break
        side[left[:pairs][better]], side[right[:pairs][better]] = True, False
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 11) -> np.ndarray:
    """A part of equal size for every point, by repeated halving; ``parts`` is a power of two."""
    out, random = np.zeros(len(graph), dtype=np.int64), np.random.default_rng(seed)
    todo = [(np.arange(len(graph)), 0, parts)]
    while todo:
        points, first, count = todo.pop()
        if count == 1 or len(points) < 2:
            out[points] = first
            continue
        side = halves(graph[np.ix_(points, points)], random)
        todo += [(points[~side], first, count // 2), (points[side], first + count // 2, count // 2)]
    return out


class Router:
    """A network with one hidden layer that gives the probabilities of the partitions."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 5):
        random = np.random.default_rng(seed)
        size, parts = x.shape[1], target.shape[1]
        self.weights = [
            random.standard_normal((size, HIDDEN)) / np.sqrt(max(1, size)),
            np.zeros(HIDDEN),
            random.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN),
            np.zeros(parts),
        ]
        if not len(x):
            return
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            for rows in np.array_split(random.permutation(len(x)), max(1, len(x) // 512)):
                step += 1
                hidden, p = self._forward(unit(x[rows]))
                error = (p - target[rows]) / len(rows)
                back = (error @ self.weights[2].T) * (hidden > 0)
                slopes = [unit(x[rows]).T @ back, back.sum(0), hidden.T @ error, error.sum(0)]
                for w, g, m in zip(self.weights, slopes, moments):
                    g = g + 1e-4 * w
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    w -= 0.003 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(x @ self.weights[0] + self.weights[1], 0)
        z = hidden @ self.weights[2] + self.weights[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return hidden, p / p.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(unit(x))[1]


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors at a common scale: directions at length 8, as the network's inputs."""
    return 8 * x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit(sample: np.ndarray, rows: int) -> Router:
    """Partition the neighbour graph of a sample and learn where a point's neighbours lie."""
    parts = LEAST_PARTITIONS
    while parts < MOST_PARTITIONS and parts * PARTITION_ROWS < rows:
        parts *= 2
    graph = neighbour_graph(sample)
    member = np.eye(parts)[balanced_parts(graph, parts)] if len(sample) else np.zeros((0, parts))
    target = graph @ member + member
    return Router(sample, target / np.maximum(target.sum(axis=1, keepdims=True), 1e-30))


def probes(p: np.ndarray) -> list[list[int]]:
    """The most probable partitions of each query, until they hold ``PROBED_MASS``, a share of all at most."""
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
    counts = np.minimum((before < PROBED_MASS).sum(axis=1), max(1, int(PROBED_SHARE * p.shape[1])))
    return [row[:n].tolist() for row, n in zip(order, counts)]


def best_of_block(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best vectors of a block for every query; ties go to the smaller vec_id.

    Equal vectors are scored once, so they tie exactly. The block product only chooses; what is near its ``k``-th
    best is scored again with one order of summation, so a score does not depend on the block.
    """
    empty = {"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)}
    if not len(vectors) or not len(queries):
        return pd.DataFrame(empty)
    vectors = vectors.sort_values("vec_id", kind="stable")
    ids, x = vectors["vec_id"].to_numpy(), np.stack(vectors["vector"]).astype(np.float64)
    q_ids, q = queries["query_id"].to_numpy(), np.stack(queries["asked"]).astype(np.float64)
    kinds, kind = np.unique(x, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    order = np.argsort(kind, kind="stable")  # by kind, then by vec_id
    starts = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
    out = []
    for first in range(0, len(q), 128):
        product = q[first : first + 128] @ kinds.T
        # a query's own vector may be among the best, so one more
        edge = -np.partition(-product, min(k, len(kinds) - 1), axis=1)[:, min(k, len(kinds) - 1)]
        for row in range(len(product)):
            q_id, vector = q_ids[first + row], q[first + row]
            scale = np.abs(product[row]).max()
            least, wanted = edge[row], k + 1
            while True:
                near = np.flatnonzero(product[row] >= least - SLACK * scale)
                scores = (kinds[near] * vector).sum(axis=1)
                found = [order[starts[n] : starts[n + 1]][: k + 1] for n in near]  # an id stands once in a kind
                at = ids[np.concatenate(found)]
                score = np.repeat(scores, [len(f) for f in found])
                best = np.lexsort((at, -score))
                at, score = at[best], score[best]
                # an id counts by its best vector
                fresh = np.sort(np.unique(at, return_index=True)[1])
                fresh = fresh[at[fresh] != q_id]
                if len(fresh) >= k or len(near) == len(kinds):
                    break
                wanted = min(2 * wanted, len(kinds))
                least = -np.partition(-product[row], wanted - 1)[wanted - 1]
            out.append((np.full(len(fresh[:k]), q_id), at[fresh[:k]], score[fresh[:k]]))
    return pd.DataFrame({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(empty)})


def search(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every row of ``vectors`` that ``queries`` picks.

    ``vectors`` has ``vec_id`` and ``embedding``. Nearness is the inner product in double precision; candidates are
    all rows with another vec_id. Rows with a null id, with an unusable vector (null, zero, with null or non-finite
    components) or with another length than most usable ones (ties: the shorter) take no part. A repeated row
    counts once; an id with several vectors is found by its best and asks with each of them. An empty table, or
    one without a second usable row, gives no rows.

    The graph of a sample is cut into balanced parts and a network learns in which parts the neighbours of a point
    lie. Every vector is indexed in its two most probable parts. A part is dealt into blocks of bounded size by a hash,
    its queries likewise, and a task compares a block of either, so neither a crowded part nor many queries of one
    part meet in one task. Blocks give ``k`` rows per query, merged by rank.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size, total = (sizes["size"], sizes["count"]) if sizes else (1, 0)
    rows = rows.where(F.size("vector") == size)
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    chosen = F.pmod(F.xxhash64("vec_id", F.lit("index")), F.lit(SCALE)) / float(SCALE) < share
    sample = rows.where(chosen).select("vec_id", "vector").distinct().orderBy("vec_id", "vector").toPandas()
    points = np.stack(sample["vector"]).astype(np.float64) if len(sample) else np.zeros((0, size))
    sent = spark.sparkContext.broadcast(fit(points, total))

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten().to_numpy()
            p = sent.value.probabilities(flat.reshape(batch.num_rows, -1))
            parts = pa.array(np.argsort(-p, axis=1, kind="stable")[:, :COPIES].tolist(), pa.list_(pa.int64()))
            visits = pa.array(probes(p), pa.list_(pa.int64()))
            yield batch.append_column("parts", parts).append_column("visits", visits)

    kinds = "vec_id long, vector array<double>, asks boolean, parts array<long>, visits array<long>"
    once = rows.groupBy("vec_id", "vector").agg(F.max("asks").alias("asks"))
    routed = stored(once.mapInArrow(route, kinds), "routed")
    visits = routed.where("asks").select(
        F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"), F.explode("visits").alias("part")
    )
    indexed = routed.select("vec_id", "vector", F.explode("parts").alias("part"))
    # the blocks of a part: one row for each part, a few hundred at most
    n_rows = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}
    n_asks = {r["part"]: r["count"] for r in visits.groupBy("part").count().collect()}
    blocks = [
        (p, -(-n // BLOCK_ROWS), max(1, -(-n_asks.get(p, 0) // BLOCK_QUERIES))) for p, n in sorted(n_rows.items())
    ]
    plan = F.broadcast(spark.createDataFrame(blocks, "part long, row_blocks long, ask_blocks long"))
    deal = lambda n, *keys: F.pmod(F.xxhash64(*keys), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(plan, "part").withColumn("row_block", deal("row_blocks", "vec_id", "vector"))
    left = left.select("part", "row_block", every("ask_blocks").alias("ask_block"), "vec_id", "vector")
    right = visits.join(plan, "part").withColumn("ask_block", deal("ask_blocks", "query_id", "asked"))
    right = right.select("part", every("row_blocks").alias("row_block"), "ask_block", "query_id", "asked")
    keys = ["part", "row_block", "ask_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda v, q: best_of_block(v, q, k), "query_id long, vec_id long, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
