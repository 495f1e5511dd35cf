"""Nearest neighbours by inner product from vantage-point trees, one per shard.

With one more component, sqrt(R^2 - |x|^2) for stored vectors (R: the shard's largest norm) and 0 for
queries, the largest inner product is the smallest Euclidean distance, so the triangle inequality
holds. Every (shard, block of queries) pair is one task of bounded size: it builds the shard's tree
and sends its queries down it together. A subtree is left out for the queries whose distance to its
shell exceeds ``factor`` times the distance of their k-th best so far; factor 1 is exact.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwire.llm.vectors import BLOCK, dealt, matrix, sequential_dot, valid_vectors

LEAF = 512
# Queries that go down a tree together; bounds the candidates held at once where all rows tie.
QUERIES = 512
# Fraction of the k-th distance beyond which a shell is left out; 1 restores exact search.
FACTOR = 1.0


class Tree:
    """A vantage-point tree over distinct rows; nodes are nested tuples, leaves hold row numbers."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows = rows
        norms = np.einsum("ij,ij->i", rows, rows)
        self.top = norms.max() if len(rows) else 0.0
        self.lift = np.sqrt(np.maximum(self.top - norms, 0))
        self.leaf = leaf
        self.root = self._build(np.arange(len(rows)))

    def _distance(self, at: int, members: np.ndarray) -> np.ndarray:
        d = self.rows[members] - self.rows[at]
        return np.sqrt(np.einsum("ij,ij->i", d, d) + (self.lift[members] - self.lift[at]) ** 2)

    def _build(self, members: np.ndarray):
        if len(members) <= self.leaf:
            return members
        # The row farthest from an arbitrary one spreads the distances well.
        at = members[np.argmax(self._distance(members[0], members))]
        d = self._distance(at, members)
        order = np.argsort(d, kind="stable")
        half = len(members) // 2
        d = d[order]
        if d[0] == d[-1]:
            return members
        return at, d[half - 1], d[half], d[-1], self._build(members[order[:half]]), self._build(members[order[half:]])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and row numbers of the ``k`` best rows of each query, -1 where there are fewer."""
        return self._visited(queries, k, factor)[:2]

    def candidates(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row), sorted by query, of every row that is not below the query's k-th best score by more than rounding."""
        return self._visited(queries, k, factor)[2:]

    def _visited(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, ...]:
        n = len(queries)
        scores = np.full((n, k), -np.inf)
        found = np.full((n, k), -1, np.int64)
        reach, least = np.full(n, np.inf), np.full(n, -np.inf)
        squares = np.einsum("ij,ij->i", queries, queries) + self.top
        # Above the rounding of a squared distance or of twice a score, whatever the order of summing; ``close`` is the part of squares.
        close = 16 * (self.rows.shape[1] + 4) * np.finfo(np.float64).eps
        slack = close * squares
        met = []

        def visit(node, asked: np.ndarray) -> None:
            if not len(asked):
                return
            if isinstance(node, np.ndarray):
                own = queries[asked] @ self.rows[node].T
                s = np.hstack([scores[asked], own])
                r = np.hstack([found[asked], np.broadcast_to(node, (len(asked), len(node)))])
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                scores[asked] = np.take_along_axis(s, best, 1)
                found[asked] = np.take_along_axis(r, best, 1)
                least[asked] = scores[asked].min(axis=1) - slack[asked]
                reach[asked] = factor * np.sqrt(np.maximum(squares[asked] - 2 * least[asked] + slack[asked], 0))
                i, j = np.nonzero(own >= least[asked][:, None])
                met.append((asked[i], node[j], own[i, j]))
                return
            at, inner, outer, far, inside, outside = node
            d = squares[asked] - 2 * (queries[asked] @ self.rows[at])
            # The distance lies between both; a shell goes only if it is beyond the reach in any case.
            low, high = np.sqrt(np.maximum(d - slack[asked], 0)), np.sqrt(np.maximum(d, 0) + slack[asked])
            near = high <= (inner + outer) / 2
            visit(inside, asked[near])
            visit(outside, asked[~near])
            # The other side, for those whose reach meets its shell by now.
            left = asked[near]
            visit(outside, left[~(outer * (1 - close) - high[near] > reach[left])])
            left = asked[~near]
            visit(inside, left[~(low[~near] - inner * (1 + close) > reach[left])])

        visit(self.root, np.arange(n))
        query, row, own = (np.concatenate(c) for c in zip(*met)) if met else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        kept = np.flatnonzero(own >= least[query])
        kept = kept[np.argsort(query[kept], kind="stable")]
        return scores, found, query[kept], row[kept]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product of each query, its own id left out.

    ``vectors`` and ``queries`` hold (vec_id, embedding). Ties go to the smaller vec_id; scores are the
    inner products in double precision, summed in order. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do null ids; vectors of another length are no candidates.
    Fewer candidates give fewer rows; a repeated row is another candidate of the same id. Other columns
    are not read.
    """
    stored, asked = valid_vectors(vectors), valid_vectors(queries)
    shards = max(1, -(-stored.count() // block))
    blocks = max(1, -(-asked.count() // block))
    left = dealt(stored, shards, "vec_id").withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = dealt(asked, blocks, "vec_id").withColumnRenamed("part", "ask").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def meet(members: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, q = matrix(members["vec"]), matrix(asks["vec"])
        ids, query_ids = members["vec_id"].to_numpy(), asks["vec_id"].to_numpy()
        # Equal vectors are one row of the tree; the smallest k + 1 ids are all that can be wanted.
        x, where = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, where.ravel()))
        starts = np.searchsorted(where.ravel()[order], np.arange(len(x) + 1))
        tree, out = Tree(x), []
        # One of k + 1 different vectors may be the query's own, so k candidates are among them; all rows that tie with the last stay.
        want = min(k + 1, len(x))
        for at in range(0, len(q), QUERIES):
            query, row = tree.candidates(q[at:at + QUERIES], want, factor)
            ends = np.searchsorted(query, np.arange(len(q[at:at + QUERIES]) + 1))
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True), at):
                some = np.concatenate([order[starts[r]:min(starts[r + 1], starts[r] + k + 1)] for r in row[a:b]])
                some = some[ids[some] != query_ids[i]]
                exact = sequential_dot(x[where.ravel()[some]], np.broadcast_to(q[i], (len(some), q.shape[1])))
                best = np.lexsort((ids[some], -exact))[:k]
                out.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[some][best], "score": exact[best]}))
        return pd.concat(out, ignore_index=True)

    met = left.groupBy("dim", "part", "ask").cogroup(right.groupBy("dim", "part", "ask")).applyInPandas(
        meet, "query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
