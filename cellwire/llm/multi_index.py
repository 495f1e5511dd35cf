"""Near-duplicate vectors through an inverted multi-index.

Each half of the unit vectors has its own codebook; the product of both is the grid of cells, and a
vector is listed in one. A vector visits cells in the order of growing distance to them, the sum of
its squared distances to the Voronoi regions of the two codewords, until the bound that holds the
target recall; that bound is measured on copies moved to exactly the similarity threshold. What it
meets there is verified by cosine in double precision.

Equal vectors are one row with a weight. Cells and their visitors are dealt into blocks of bounded
size, and block pairs count links and join neighbours inside the task, so pairs are never listed.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.llm.common import components, joined
from cellwire.llm.vectors import BLOCK, dealt, matrix, valid_vectors
from cellwire.operators.session import materialize

# Rows the codebooks and the visiting bound are fitted on.
SAMPLE = 4096
# Share of the partners at exactly the threshold that one side meets; a pair is found if either side meets the other.
RECALL = 0.9999
MAX_WORDS = 512


def _unit(x: np.ndarray) -> np.ndarray:
    # The largest component first, so that neither tiny nor huge vectors overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :], 0)


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    words = np.unique(x, axis=0)
    words = words[np.linspace(0, len(words) - 1, min(k, len(words))).astype(int)]
    for _ in range(rounds):
        near = _squares(x, words).argmin(1)
        count = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
    return np.unique(words, axis=0)


class Grid:
    """Two codebooks and the bound up to which cells are visited."""

    def __init__(self, sample: np.ndarray, words: int, threshold: float, recall: float, seed: int = 7):
        unit = _unit(sample)
        self.cut = unit.shape[1] // 2
        self.books = [_k_means(h, words) for h in self._halves(unit)]
        rng = np.random.default_rng(seed)
        noise = rng.standard_normal(unit.shape)
        noise -= (noise * unit).sum(1)[:, None] * unit
        size = np.sqrt((noise * noise).sum(1))[:, None]
        moved = threshold * unit + np.sqrt(max(0.0, 1 - threshold * threshold)) * noise / np.where(size > 0, size, 1)
        first, second = self.margins(unit)
        i, j = self.cells(moved)
        rows = np.arange(len(unit))
        reached = first[rows, i] + second[rows, j]
        self.bound = float(np.quantile(reached, recall)) * 1.25 + 1e-12

    def _halves(self, unit: np.ndarray) -> list[np.ndarray]:
        return [unit[:, : self.cut], unit[:, self.cut:]]

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = (_squares(h, b).argmin(1) for h, b in zip(self._halves(unit), self.books, strict=True))
        return i, j

    def margins(self, unit: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each row's halves to the Voronoi regions of the codewords, by the nearest word's border."""
        out = []
        for h, book in zip(self._halves(unit), self.books, strict=True):
            d = _squares(h, book)
            near = d.argmin(1)
            apart = np.sqrt(_squares(book, book))[near]
            gap = (d - d[np.arange(len(h)), near][:, None]) / (2 * np.where(apart > 0, apart, 1))
            out.append(gap * gap)
        return out

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits: per row the cells in order of the sum of both margins, up to the bound."""
        first, second = self.margins(unit)
        by_first, by_second = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
        first, second = np.take_along_axis(first, by_first, 1), np.take_along_axis(second, by_second, 1)
        rows, cells, sums = [], [], []
        width = len(self.books[1])
        for rank in range(first.shape[1]):
            some = np.flatnonzero(first[:, rank] <= self.bound)
            if not len(some):
                break
            left = self.bound - first[some, rank]
            for other in range(second.shape[1]):
                some_now = second[some, other] <= left
                some, left = some[some_now], left[some_now]
                if not len(some):
                    break
                rows.append(some)
                cells.append(by_first[some, rank] * width + by_second[some, other])
                sums.append(first[some, rank] + second[some, other])
        rows, cells, sums = np.concatenate(rows), np.concatenate(cells), np.concatenate(sums)
        order = np.lexsort((cells, sums, rows))
        return rows[order], cells[order]


def linked(
    vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``.

    Two vectors are linked if their cosine is ``threshold`` or more; n_links counts the other rows, and
    component_id is the smallest vec_id reachable. Null, zero and non-finite vectors, and those with
    null components, link with nothing; vectors of another length are not compared. A repeated row
    counts as another vector with the same id. Null ids link with nothing and keep a null component.
    An empty table gives an empty table; other columns are not read.
    """
    spark = vectors.sparkSession
    valid = valid_vectors(vectors)
    # Equal vectors are one row: its smallest id and how many there are.
    unique = materialize(valid.groupBy("dim", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    n = unique.count()
    words = int(np.clip(round((n / 256) ** 0.5), 2, MAX_WORDS))
    grids = {}
    for row in unique.select("dim").distinct().collect():  # one per vector length
        some = unique.where(F.col("dim") == row["dim"]).orderBy(F.xxhash64("rep"), "rep").limit(sample).select("vec").toPandas()
        grids[row["dim"]] = Grid(matrix(some["vec"]), words, threshold, recall)
    shared = spark.sparkContext.broadcast(grids)  # at most MAX_WORDS codewords per half

    def list_cells(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                grid = shared.value[dim]
                i, j = grid.cells(_unit(matrix(part["vec"])))
                yield part.assign(cell=i * len(grid.books[1]) + j)

    def list_visits(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                for at in range(0, len(part), 1024):
                    few = part.iloc[at:at + 1024]
                    rows, cells = shared.value[dim].visits(_unit(matrix(few["vec"])))
                    ends = np.searchsorted(rows, np.arange(len(few) + 1))
                    yield few.assign(cells=[cells[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])

    schema = "dim int, vec array<float>, rep long, weight long"
    read = unique.select("dim", F.col("vec").cast("array<float>").alias("vec"), "rep", "weight")
    if dict(valid.dtypes)["vec"] != "array<float>":
        schema, read = schema.replace("float", "double"), unique.select("dim", F.col("vec").cast("array<double>").alias("vec"), "rep", "weight")
    listed = materialize(read.mapInPandas(list_cells, f"{schema}, cell long"))
    # A vector with the list of its cells: copies of it are made only on the way to the cells.
    visits = materialize(read.mapInPandas(list_visits, f"{schema}, cells array<long>"))
    size = listed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    asks = visits.select("dim", F.explode("cells").alias("cell")).groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).alias("asks"))
    plan = materialize(size.join(asks, ["dim", "cell"]))
    left = listed.join(plan, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn(
        "ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1))
    )
    right = visits.withColumn("cell", F.explode("cells")).drop("cells").join(plan, ["dim", "cell"]).withColumn("ask", F.pmod(F.xxhash64("rep"), F.col("asks"))).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    )
    columns = ["dim", "cell", "part", "ask", "rep", "weight", "vec"]

    def meet(members: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"u": [], "v": [], "links": []}).astype("int64")
        if not len(members) or not len(asks):
            return none
        grid = shared.value[members["dim"].iloc[0]]
        x, y = _unit(matrix(members["vec"])), _unit(matrix(asks["vec"]))
        x_id, y_id = members["rep"].to_numpy(), asks["rep"].to_numpy()
        x_weight, y_weight = members["weight"].to_numpy(), asks["weight"].to_numpy()
        first, second = grid.margins(x)
        i, j = grid.cells(y)
        x_links, y_links = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        pairs = []
        for at in range(0, len(y), 512):
            rows, cols = np.nonzero(y[at:at + 512] @ x.T >= threshold)
            rows += at
            other = y_id[rows] != x_id[cols]
            rows, cols = rows[other], cols[other]
            np.add.at(y_links, rows, x_weight[cols])
            # The member counts the visitor here only if it does not visit the visitor's cell itself.
            missed = first[cols, i[rows]] + second[cols, j[rows]] > grid.bound
            np.add.at(x_links, cols[missed], y_weight[rows[missed]])
            pairs.append((rows, cols))
        ids = np.unique(np.concatenate([x_id, y_id]))
        rows, cols = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        root = ids[joined(len(ids), np.searchsorted(ids, y_id[rows]), np.searchsorted(ids, x_id[cols]))]
        out = pd.DataFrame({"u": np.r_[y_id, x_id], "links": np.r_[y_links, x_links]})
        out["v"] = root[np.searchsorted(ids, out["u"].to_numpy())]
        return out[(out["links"] > 0) | (out["u"] != out["v"])][["u", "v", "links"]]

    met = materialize(
        left.select(columns).groupBy("dim", "cell", "part", "ask")
        .cogroup(right.select(columns).groupBy("dim", "cell", "part", "ask"))
        .applyInPandas(meet, "u long, v long, links long")
    )
    links = met.groupBy("u").agg(F.sum("links").alias("links"))
    classes_of = components(met.select("u", "v"))
    classes = (
        unique.join(links, unique["rep"] == links["u"], "left").join(classes_of, unique["rep"] == classes_of["node"], "left")
        .select("dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    of_row = valid.join(classes, ["dim", "vec"]).select("vec_id", "links", "component")
    rest = rows.select("vec_id", "vec").join(valid.select("vec_id", "vec").distinct(), ["vec_id", "vec"], "left_anti")
    out = of_row.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component")))
    return out.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
