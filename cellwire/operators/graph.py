"""Spatial neighbour graphs and what is derived from them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwire.functions.expressions import spatial_weight
from cellwire.operators import proximity as near
from cellwire.operators.ordered import edges_in_order
from cellwire.operators.ranking import quantiles
from cellwire.operators.session import guard_rows, materialize, spread

EDGE = ["sample_id", "sender_id", "receiver_id", "distance", "weight"]


def _boundary(same_compartment: bool) -> list[str]:
    return ["sample_id", "compartment"] if same_compartment else ["sample_id"]


def radius_edges(
    cells: DataFrame,
    radius: float,
    same_compartment: bool = False,
    weight: str = "binary",
    scale: float | None = None,
    include_self: bool = False,
    max_edges: int | None = None,
    limit: int = near.SENDERS_PER_TILE,
    attributes: Sequence[str] = (),
) -> DataFrame:
    """Directed edges between cells of one sample within ``radius``.

    ``attributes`` of the cells come along as columns of both ends, sender_<name> and receiver_<name>.
    """
    on, dims = _boundary(same_compartment), near.axes(cells)
    carried = [c for c in attributes if c not in on]
    points = cells.select(*on, "cell_id", *dims, *carried)
    s, r = near.prefixed(points, "s", on), near.prefixed(points, "r", on)
    crowded = near.crowded_tiles(s, on, F.lit(float(radius)), dims, limit)
    pairs = near.near_join(s, r, on, radius, dims, crowded)
    if not include_self:
        pairs = pairs.where(F.col("s_cell_id") != F.col("r_cell_id"))
    distance = F.sqrt("d2")
    edges = pairs.select(
        "sample_id", F.col("s_cell_id").alias("sender_id"), F.col("r_cell_id").alias("receiver_id"),
        distance.alias("distance"),
        spatial_weight(distance, weight, radius / 2 if scale is None else scale).alias("weight"),
        *[F.col(c if c in on else f"{tag}_{c}").alias(f"{side}_{c}")
          for c in attributes for side, tag in (("sender", "s"), ("receiver", "r"))],
    )
    return guard_rows(edges, max_edges, "edge list")


def ordered_edges(cells: DataFrame, radius: float) -> DataFrame:
    """The edges of ``radius_edges`` without weights, in the order of sample, sender and receiver.

    Cells are sorted, not edges: senders are dealt by ranges of sample and id into a block per shuffle partition, all
    cells of a block's samples are copied to it, and the edges of a block arise in order. A task holds the cells of
    one sample at a time; what is exchanged grows with cells times partitions, not with the edges.
    """
    parts, dims = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), near.axes(cells)
    finite = [F.abs(F.col(d).cast("double")) < float("inf") for d in dims]
    points = cells.select("sample_id", "cell_id", *[F.col(d).cast("double").alias(d) for d in dims])
    for known in [F.col("sample_id").isNotNull(), F.col("cell_id").isNotNull(), *finite]:
        points = points.where(known)
    # Stored, so that all readers see the same blocks and the planner knows how few the blocks of a sample are.
    senders = materialize(points.repartitionByRange(parts, "sample_id", "cell_id").withColumn("block", F.spark_partition_id()))
    where = materialize(senders.select("sample_id", "block").distinct())
    receivers = senders.drop("block").join(where, "sample_id")
    rows = receivers.withColumn("sender", F.lit(0)).unionByName(senders.withColumn("sender", F.lit(1)))
    rows = rows.repartitionById(parts, "block").sortWithinPartitions("sample_id", "sender", "cell_id", *dims)
    most, types = near.largest_square(float(radius)), dict(points.dtypes)

    def run(batches):
        return edges_in_order(batches, dims, float(radius), most)

    return rows.drop("block").mapInArrow(
        run, f"sample_id {types['sample_id']}, sender_id {types['cell_id']}, receiver_id {types['cell_id']}, distance double")


def radius_edges_bruteforce(
    cells: DataFrame, radius: float, same_compartment: bool = False, max_cells: int = 5000
) -> DataFrame:
    """Quadratic definition of the radius graph; a check for small inputs, refused above the cap."""
    guard_rows(cells, max_cells, "brute-force input")
    on, dims = _boundary(same_compartment), near.axes(cells)
    points = cells.select(*on, "cell_id", *dims)
    pairs = near.prefixed(points, "s", on).join(near.prefixed(points, "r", on), on)
    pairs = pairs.withColumn("distance", F.sqrt(near.squared_distance(dims)))
    return pairs.where(
        (F.col("distance") <= radius) & (F.col("s_cell_id") != F.col("r_cell_id"))
    ).select("sample_id", F.col("s_cell_id").alias("sender_id"),
             F.col("r_cell_id").alias("receiver_id"), "distance")


def location_pairs(
    cells: DataFrame,
    radius: float,
    attributes: Sequence[str] = (),
    same_compartment: bool = False,
    limit: int = near.SENDERS_PER_TILE,
) -> DataFrame:
    """Neighbouring (location, attributes) pairs with the number of cell edges each stands for.

    Cells that share location and attributes are counted once with a multiplicity, so copies of
    one location cost one row in the distance join. Use it for sums over edges.
    """
    on, dims = _boundary(same_compartment), near.axes(cells)
    spots = cells.groupBy(*on, *dims, *attributes).agg(F.count(F.lit(1)).alias("n"))
    s, r = near.prefixed(spots, "s", on), near.prefixed(spots, "r", on)
    crowded = near.crowded_tiles(s, on, F.lit(float(radius)), dims, limit)
    pairs = near.near_join(s, r, on, radius, dims, crowded)
    same = F.col("d2") == 0
    for name in attributes:
        same = same & F.col(f"s_{name}").eqNullSafe(F.col(f"r_{name}"))
    edges = F.col("s_n") * F.when(same, F.col("r_n") - 1).otherwise(F.col("r_n"))
    return pairs.withColumn("edges", edges).withColumn("distance", F.sqrt("d2")).where("edges > 0")


def degrees(
    cells: DataFrame,
    radius: float,
    same_compartment: bool = False,
    weight: str = "binary",
    scale: float | None = None,
    limit: int = near.SENDERS_PER_TILE,
) -> DataFrame:
    """Out-degree and weighted out-degree of every cell, isolated cells included."""
    on, dims = _boundary(same_compartment), near.axes(cells)
    pairs = location_pairs(cells, radius, (), same_compartment, limit)
    w = spatial_weight(F.col("distance"), weight, radius / 2 if scale is None else scale)
    per_cell = F.col("edges") / F.col("s_n")
    place = [*on, *[f"s_{d}" for d in dims]]
    spots = pairs.groupBy(*place).agg(
        F.sum(per_cell).alias("degree"), F.sum(per_cell * w).alias("weighted_degree")
    )
    for d in dims:
        spots = spots.withColumnRenamed(f"s_{d}", d)
    return cells.join(spots, [*on, *dims], "left").select(
        "sample_id", "cell_id",
        F.coalesce(F.col("degree"), F.lit(0.0)).cast("long").alias("degree"),
        F.coalesce(F.col("weighted_degree"), F.lit(0.0)).alias("weighted_degree"),
    )


def weighted_degree(edges: DataFrame) -> DataFrame:
    """Sum of edge weights per sender of an edge table."""
    return edges.groupBy("sample_id", "sender_id").agg(F.sum("weight").alias("weighted_degree"))


def edge_table(edges: DataFrame, cells: DataFrame, max_edges: int | None = None) -> DataFrame:
    """Edges with the group and compartment of both ends."""
    info = cells.select("sample_id", "cell_id", "group", "compartment")
    out = edges
    for side in ("sender", "receiver"):
        out = out.join(
            info.select("sample_id", F.col("cell_id").alias(f"{side}_id"),
                        F.col("group").alias(f"{side}_group"),
                        F.col("compartment").alias(f"{side}_compartment")),
            ["sample_id", f"{side}_id"],
        )
    return guard_rows(out, max_edges, "materialised edges")


def graph_metrics(cells: DataFrame, radius: float) -> DataFrame:
    """Cells, directed edges, mean out-degree, density and isolated cells per sample."""
    return degrees(cells, radius).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("degree").alias("directed_edges"),
        F.avg("degree").alias("mean_out_degree"),
        (F.sum("degree") / F.pow(F.count(F.lit(1)), F.lit(2.0))).alias("density"),
        F.sum((F.col("degree") == 0).cast("long")).alias("isolated_cells"),
    )


def minimum_distance(
    cells: DataFrame, radius: float, limit: int | None = near.SENDERS_PER_TILE
) -> DataFrame:
    """Smallest non-zero distance within ``radius`` per sample; samples without an edge are absent.

    A sixteenth of the radius is searched first, which finds it in all but sparse samples: a smaller reach has the
    smaller distances. ``limit`` None tells that no tile is known to be crowded.
    """
    dims = near.axes(cells)
    spots = cells.groupBy("sample_id", *dims).agg(F.count(F.lit(1)).alias("n")).drop("n")

    def smallest(points: DataFrame, reach: float) -> DataFrame:
        s, r = near.prefixed(points, "s", ["sample_id"]), near.prefixed(points, "r", ["sample_id"])
        crowded = None
        if limit is not None:
            crowded = near.crowded_tiles(s, ["sample_id"], F.lit(float(reach)), dims, limit)
        pairs = near.near_join(s, r, ["sample_id"], reach, dims, crowded, strict=True)
        return pairs.groupBy("sample_id").agg(F.sqrt(F.min("d2")).alias("min_distance"))

    found = materialize(smallest(spots, radius / 16))
    rest = spots.join(found, "sample_id", "left_anti")
    return found if rest.isEmpty() else found.unionByName(smallest(rest, radius))


def knn_edges(
    cells: DataFrame,
    k: int,
    same_compartment: bool = False,
    max_radius: float | None = None,
    weight: str = "binary",
    scale: float | None = None,
    first_reach: float | None = None,
    max_rounds: int = 60,
) -> DataFrame:
    """Directed edges to the ``k`` nearest other cells of the sample, ties by cell id.

    Rounds with a doubling reach: a cell is settled once its k-th neighbour lies inside the reach.
    Only the unsettled cells enter the next round. Of cells at one location only the first k + 1
    ids can be anyone's neighbours, so the others are no candidates. Boundary and ``max_radius``
    apply after the cut to k.
    """
    dims = near.axes(cells)
    points = cells.select("sample_id", "cell_id", *dims)
    spot = W.partitionBy("sample_id", *dims).orderBy("cell_id")
    candidates = points.withColumn("_i", F.row_number().over(spot)).where(F.col("_i") <= k + 1).drop("_i")
    sizes = points.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("_cells"),
        F.greatest(*[F.max(d) - F.min(d) for d in dims]).alias("_extent"),
    )
    if first_reach is None:
        first_reach = _dense_reach(candidates, dims, k)
    pending = points.join(sizes, "sample_id").where(F.col("_cells") > 1)
    reach, settled = first_reach, None
    for _ in range(max_rounds):
        pairs = near.near_join(
            near.prefixed(pending, "s", ["sample_id"]), near.prefixed(candidates, "r", ["sample_id"]),
            ["sample_id"], reach, dims,
        ).where(F.col("s_cell_id") != F.col("r_cell_id"))
        nearest = W.partitionBy("sample_id", "s_cell_id").orderBy("d2", "r_cell_id")
        top = pairs.withColumn("_rank", F.row_number().over(nearest)).where(F.col("_rank") <= k)
        whole = W.partitionBy("sample_id", "s_cell_id")
        complete = (F.count(F.lit(1)).over(whole) == F.least(F.lit(k), F.col("s__cells") - 1))
        found = materialize(
            top.withColumn("_done", complete).where("_done").select(
                "sample_id", F.col("s_cell_id").alias("sender_id"),
                F.col("r_cell_id").alias("receiver_id"), F.sqrt("d2").alias("distance"),
            )
        )
        settled = found if settled is None else settled.unionByName(found)
        pending = materialize(pending.join(
            found.select("sample_id", F.col("sender_id").alias("cell_id")).distinct(),
            ["sample_id", "cell_id"], "left_anti",
        ))
        if pending.isEmpty():
            break
        reach *= 2
    else:
        raise ValueError(f"cells are left without neighbours after {max_rounds} rounds; start with a larger reach")
    edges = settled
    if max_radius is not None:
        edges = edges.where(F.col("distance") <= max_radius)
    if same_compartment:
        kept = edge_table(edges, cells.withColumn("group", F.lit("")))
        edges = kept.where("sender_compartment = receiver_compartment").select(*edges.columns)
    if weight != "binary" and scale is None:
        middle = quantiles(edges.where("distance > 0"), [], "distance", [0.5], ["m"])
        scale = F.coalesce(middle.select("m").scalar(), F.lit(1.0))
    return edges.withColumn("weight", spatial_weight(F.col("distance"), weight, 1.0 if scale is None else scale)).select(*EDGE)


def _dense_reach(points: DataFrame, dims: Sequence[str], k: int) -> float:
    """Tile side, halved until the densest tile holds few candidates; a handful of counting jobs."""
    extent = points.select(
        F.greatest(*[F.max(d) - F.min(d) for d in dims]).alias("e"), F.count(F.lit(1)).alias("n")
    ).first()
    if not extent["e"]:
        return 1.0
    reach = float(extent["e"])
    goal = 4 * (k + 1)
    if extent["n"] <= goal:
        return reach
    for _ in range(40):
        tiles = points.groupBy("sample_id", *[F.floor(F.col(d) / reach) for d in dims])
        densest = tiles.count().agg(F.max("count")).first()[0]
        if densest <= goal:
            break
        reach /= 2 if densest > 8 * goal else 1.5
    return reach


def validate_edges(edges: DataFrame, cells: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row of named checks of an edge table against its cells."""
    # A cell is known by sample and id; ids may repeat in other samples. An end that is missing in the
    # edge's sample is a cross-sample edge if some other sample has the id.
    # Stored, so that the planner knows how small they are beside the edges, which then stay where they are.
    info = materialize(cells.select("sample_id", "cell_id", "compartment"))
    anywhere = materialize(info.select("cell_id").distinct())
    ends = edges
    for side in ("sender", "receiver"):
        ends = ends.join(
            info.select("sample_id", F.col("cell_id").alias(f"{side}_id"), F.col("sample_id").alias(f"{side}_sample"),
                        F.col("compartment").alias(f"{side}_compartment")),
            ["sample_id", f"{side}_id"], "left",
        ).join(
            anywhere.select(F.col("cell_id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_known")), f"{side}_id", "left",
        )
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    holds = lambda c: F.coalesce(F.min(c.cast("int")), F.lit(1)) == 1
    # Dealt by their senders first: nothing can be added up before the exchange, where edges are mostly different.
    dealt = spread(edges.select("sample_id", "sender_id", "receiver_id"), "sample_id", "sender_id")
    copies = dealt.groupBy("sample_id", "sender_id", "receiver_id").agg(F.count(F.lit(1)).alias("_n"))
    return ends.agg(
        holds(F.col("sender_known").isNotNull() & F.col("receiver_known").isNotNull()).alias("ends_known"),
        holds(F.col("sender_sample").isNotNull().eqNullSafe(F.col("sender_known").isNotNull())
              & F.col("receiver_sample").isNotNull().eqNullSafe(F.col("receiver_known").isNotNull())).alias("no_cross_sample_edges"),
        holds(F.col("sender_id") != F.col("receiver_id")).alias("no_self_edges"),
        holds(finite("distance") & (F.col("distance") >= 0)).alias("finite_nonnegative_distance"),
        holds(finite("weight") & (F.col("weight") >= -tolerance)).alias("finite_nonnegative_weight"),
        holds(F.col("sender_compartment").eqNullSafe(F.col("receiver_compartment"))).alias("no_cross_compartment_edges"),
    ).withColumn("no_duplicate_edges", copies.agg(F.coalesce(F.max("_n"), F.lit(0)) <= 1).scalar())


def validate_degrees(edges: DataFrame, degree: DataFrame, cells: DataFrame) -> DataFrame:
    """Checks of the compact form: degrees add up to the edges and cover every cell."""
    back = edges.select("sample_id", F.col("receiver_id").alias("sender_id"),
                        F.col("sender_id").alias("receiver_id"))
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    # Where every edge has its reverse once, 128 bits of hashes add up to the same both ways and no edge is exchanged.
    # Otherwise, also where copies of edges make the sums differ, the edges are looked up one by one.
    ends = [F.col("sender_id"), F.col("receiver_id")]
    sums = [F.sum(F.xxhash64(F.lit(seed), "sample_id", *side).cast("decimal(20,0)")).alias(f"{way}{seed}")
            for way, side in (("there", ends), ("back", ends[::-1])) for seed in (1, 2)]
    found = edges.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    one_way = edges.limit(0)
    if (found["there1"], found["there2"]) != (found["back1"], found["back2"]):
        one_way = edges.join(back, ["sample_id", "sender_id", "receiver_id"], "left_anti")
    return degree.agg(
        (F.sum("degree") == found["n"]).alias("degree_sum_matches"),
        (F.count(F.lit(1)) == count(cells)).alias("every_cell_listed"),
        (F.min("degree") >= 0).alias("degrees_nonnegative"),
    ).withColumn("symmetric", count(one_way) == 0)


def _equal_graphs() -> Column:
    same = (F.col("left_only") + F.col("right_only") == 0) & (F.coalesce(F.col("max_distance_error"), F.lit(0.0)) == 0)
    return same.alias("graphs_equal")


def edge_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equality report of two graphs on (sender, receiver) and distance."""
    keys = ["sample_id", "sender_id", "receiver_id"]
    both = left.select(*keys, F.col("distance").alias("_l")).join(
        right.select(*keys, F.col("distance").alias("_r")), keys, "full"
    )
    return both.agg(
        F.count(F.col("_l")).alias("left_edges"), F.count(F.col("_r")).alias("right_edges"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("left_only"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("right_only"),
        F.max(F.abs(F.col("_l") - F.col("_r"))).alias("max_distance_error"),
    ).select("*", _equal_graphs())


def radius_graph_differences(
    left: DataFrame, right: DataFrame, left_radius: float, right_radius: float, limit: int = near.SENDERS_PER_TILE
) -> DataFrame:
    """``edge_differences`` of the radius graphs of two tables of cells, without storing or exchanging an edge.

    Cells bring their place in the other table along, so a pair shows where it arises whether the other graph
    has it and at what distance. Where ids repeat within a sample, the edge lists themselves are compared.
    """
    key = ["sample_id", "cell_id"]
    copies = [c.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1") for c in (left, right)]
    if not copies[0].unionByName(copies[1]).isEmpty():
        return edge_differences(radius_edges(left, left_radius, limit=limit), radius_edges(right, right_radius, limit=limit))

    def seen(cells: DataFrame, radius: float, other: DataFrame, other_radius: float, side: str) -> DataFrame:
        dims, places = near.axes(cells), [f"other_{d}" for d in near.axes(other)]
        points = cells.select(*key, *dims)
        crowded = near.crowded_tiles(near.prefixed(points, "s", ["sample_id"]), ["sample_id"], F.lit(float(radius)), dims, limit)
        points = points.join(other.select(*key, *[F.col(d).alias(p) for d, p in zip(near.axes(other), places)]), key, "left")
        s, r = near.prefixed(points, "s", ["sample_id"]), near.prefixed(points, "r", ["sample_id"])
        pairs = near.near_join(s, r, ["sample_id"], radius, dims, crowded).where(F.col("s_cell_id") != F.col("r_cell_id"))
        pairs = pairs.withColumn("_d2", near.squared_distance(places))
        matched = near.within(F.col("_d2"), other_radius)
        return pairs.agg(
            F.count(F.lit(1)).alias(f"{side}_edges"),
            F.count(F.when(matched, None).otherwise(1)).alias(f"{side}_only"),
            F.max(F.when(matched, F.abs(F.sqrt("d2") - F.sqrt("_d2")))).alias(f"{side}_error"),
        )

    here, there = seen(left, left_radius, right, right_radius, "left"), seen(right, right_radius, left, left_radius, "right")
    both = here.crossJoin(there).withColumn("max_distance_error", F.col("left_error"))
    return both.select("left_edges", "right_edges", "left_only", "right_only", "max_distance_error", _equal_graphs())


def spatial_blocks(
    cells: DataFrame, size: float | Sequence[float], origin: Sequence[float] | None = None
) -> DataFrame:
    """Add ``block_id``: sample, compartment and floor bins from the origin.

    Names carry their lengths, so that no two pairs of names make one block; a null name is a name of its own.

    Without an origin the grid starts at the multiple of the size below the smallest coordinate.
    """
    dims = near.axes(cells)
    sizes = [float(size)] * len(dims) if isinstance(size, (int, float)) else [float(s) for s in size]
    named = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    parts: list[Column] = [named(F.col(c).cast("string")) for c in ("sample_id", "compartment")]
    for i, (d, s) in enumerate(zip(dims, sizes)):
        start = (
            F.lit(float(origin[i])) if origin is not None
            else cells.agg(F.floor(F.min(d) / F.lit(s)) * F.lit(s)).scalar()
        )
        parts.append(F.floor((F.col(d) - start) / F.lit(s)).cast("string"))
    return cells.withColumn("block_id", F.concat_ws("|", *parts))
