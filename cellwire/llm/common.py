"""Helpers the operators of this folder share."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwire.operators.session import materialize

# Python work goes through texts in slices of about this many characters, so memory does not follow
# the size of an Arrow batch.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(texts: Sequence[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that together stay near ``chars``; every text is in one range."""
    start = total = 0
    for k, text in enumerate(texts):
        if total and total + len(text) > chars:
            yield start, k
            start, total = k, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_of(column) -> list[str]:
    """The texts of a pandas column; null is the empty text."""
    return [t if isinstance(t, str) else "" for t in column]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of ``n`` positions through the pairs (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``: (node, component), component = smallest node reachable.

    Alternates large-star and small-star steps (each keeps the components and shortens the paths), so
    a few rounds of grouped minima and equi-joins suffice. Each round is a stored table; one row comes
    back to the driver per round, to see whether anything changed. Loops and repeated edges are
    harmless; an empty table gives an empty table; null ends are dropped.
    """
    now = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v").distinct()
    )
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: every larger neighbour of u hangs on the smallest of u and its neighbours.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours hang on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(
            small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
