"""Distance join: all pairs within reach of each other, as one equi-join on tiles.

Tiles are two reaches wide. A sender lies in one tile; a receiver is copied to the two tiles per
axis that its reach touches, so every pair meets in exactly one tile. The distance predicate is
part of the join. Tiles that hold too many senders are split by a salt. Both sides are dealt into all
shuffle partitions, since the pairs of a tile grow with the square of its rows.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwire.operators.session import spread

SENDERS_PER_TILE = 4_096
SLACK = 1e-9
EPS = 2.0 ** -52
Meet = Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]


def axes(cells: DataFrame) -> list[str]:
    return ["x", "y", "z"] if "z" in cells.columns else ["x", "y"]


def squared_distance(dims: Sequence[str]) -> Column:
    total = None
    for d in dims:
        delta = F.col(f"s_{d}") - F.col(f"r_{d}")
        total = delta * delta if total is None else total + delta * delta
    return total


def prefixed(cells: DataFrame, side: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns of one side of a pair, renamed with its prefix except the shared join keys."""
    return cells.select(*[c if c in keep else F.col(c).alias(f"{side}_{c}") for c in cells.columns])


def within(d2: Column, reach: Column | float) -> Column:
    """Whether a squared distance is within ``reach``, with a few ulps of tolerance."""
    span = reach if isinstance(reach, Column) else F.lit(float(reach))
    square = span * span
    return d2 <= square + F.greatest(F.lit(1.0), square) * (16 * EPS)


def largest_square(reach: float) -> float:
    """The largest squared distance that is ``within`` a fixed reach."""
    square = reach * reach
    return square + max(1.0, square) * (16 * EPS)


def _side(reach: Column) -> Column:
    return reach * (2 * (1 + SLACK))


def _tile(prefix: str, d: str, reach: Column) -> Column:
    return F.floor(F.col(f"{prefix}_{d}") / _side(reach))


def crowded_tiles(
    points: DataFrame, on: Sequence[str], reach: Column, dims: Sequence[str], limit: int
) -> DataFrame | None:
    """Tiles with more than ``limit`` points and their number of parts; None where there are none.

    One pass over the points. At most rows/limit tiles can qualify.
    """
    tiles = [_tile("s", d, reach).alias(f"_t{d}") for d in dims]
    counts = points.groupBy(*on, *tiles).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    if counts.isEmpty():
        return None
    return counts.select(
        *on, *[f"_t{d}" for d in dims], F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_parts")
    )


def near_join(
    senders: DataFrame,
    receivers: DataFrame,
    on: Sequence[str],
    reach: Column | float,
    dims: Sequence[str] = ("x", "y"),
    crowded: DataFrame | None = None,
    crowded_on: Sequence[str] | None = None,
    strict: bool = False,
    meet: Meet | None = None,
) -> DataFrame:
    """Pairs of a sender (``s_`` columns) and a receiver (``r_`` columns) within ``reach``.

    ``reach`` may be a column that both sides carry under the same name. Adds ``d2``, the squared
    distance. ``strict`` keeps 0 < distance <= reach; otherwise distance zero is kept and the
    bound has a few ulps of tolerance. ``meet`` replaces the join: it gets both sides and the keys
    that rows have to share, and looks at distances itself.
    """
    span = reach if isinstance(reach, Column) else F.lit(float(reach))
    half = _side(span) / 2
    tiles = [f"_t{d}" for d in dims]
    left = senders.withColumns({f"_t{d}": _tile("s", d, span) for d in dims})
    right = receivers
    for d in dims:
        place = F.col(f"r_{d}")
        low, high = F.floor((place - half) / _side(span)), F.floor((place + half) / _side(span))
        right = right.select("*", F.explode(F.sequence(low, high)).alias(f"_t{d}"))
    keys = [*on, *tiles]
    if crowded is not None:
        marks = [*(crowded_on or on), *tiles]
        parts = F.coalesce(F.col("_parts"), F.lit(1))
        salt = F.pmod(F.xxhash64(*[c for c in senders.columns if c.startswith("s_")]), parts)
        left = left.join(crowded, marks, "left").withColumn("_salt", salt.cast("int")).drop("_parts")
        right = right.join(crowded, marks, "left").select(
            "*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_salt")
        ).drop("_parts")
        keys = [*keys, "_salt"]
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    right = right.drop(*shared)
    if meet is not None:
        return meet(left, right, keys)
    pairs = spread(left, *keys).join(spread(right, *keys), keys).drop(*tiles, "_salt").withColumn("d2", squared_distance(dims))
    if strict:
        return pairs.where((F.col("d2") > 0) & (F.sqrt("d2") <= span))
    return pairs.where(within(F.col("d2"), span))


def strict_near_join(
    senders: DataFrame,
    receivers: DataFrame,
    points: DataFrame,
    on: Sequence[str],
    reach: Column | float,
    dims: Sequence[str],
    points_on: Sequence[str],
    crowded: DataFrame | None,
    limit: int = SENDERS_PER_TILE,
    meet: Meet | None = None,
) -> DataFrame:
    """``near_join`` with 0 < distance, safe when very many rows share one location.

    ``points`` lists the cells (``s_`` coordinates, ``points_on`` and a reach column) and
    ``crowded`` their crowded tiles. Rows at one location are no pairs of each other, so a crowded
    location is joined as one point with its neighbours instead of being compared with itself.
    """
    span = reach if isinstance(reach, Column) else F.lit(float(reach))
    plain = dict(on=on, reach=reach, dims=dims, crowded=crowded, crowded_on=points_on, strict=True, meet=meet)
    if crowded is None:
        return near_join(senders, receivers, **plain)
    place_on = [k for k in points_on if k in on]
    spots = (
        points.groupBy(*place_on, *[f"s_{d}" for d in dims])
        .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
        .select("*", F.ceil(F.col("_n") / F.lit(limit)).alias("_parts")).drop("_n")
    )
    if spots.isEmpty():
        return near_join(senders, receivers, **plain)
    s_place = [*place_on, *[f"s_{d}" for d in dims]]
    r_place = [*place_on, *[f"r_{d}" for d in dims]]
    r_spots = spots.select(*place_on, *[F.col(f"s_{d}").alias(f"r_{d}") for d in dims])
    s_cold, s_hot = senders.join(spots, s_place, "left_anti"), senders.join(spots, s_place, "left_semi")
    r_cold, r_hot = (
        receivers.join(r_spots, r_place, "left_anti"), receivers.join(r_spots, r_place, "left_semi")
    )
    widest = points.agg(F.max(span)).scalar() if isinstance(reach, Column) else span
    # Senders of a place are dealt into as many parts as their number asks for, and the receivers of a
    # neighbouring place copied to the parts of its largest neighbour, so two crowded places meet in many tasks.
    neighbours = near_join(
        spots.withColumnRenamed("_parts", "s_parts"), r_spots, place_on, widest, dims, strict=True
    ).drop("d2")
    most = neighbours.groupBy(*r_place).agg(F.max("s_parts").alias("_most"))
    salted = s_hot.join(neighbours, s_place).withColumn(
        "_salt", F.pmod(F.xxhash64(*s_hot.columns), F.col("s_parts"))).drop("s_parts")
    copied = r_hot.join(most, r_place).drop(*[c for c in r_hot.columns if c in s_hot.columns and c not in on]).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") - 1))).drop("_most")
    keys = [*on, *[f"r_{d}" for d in dims], "_salt"]
    if meet is not None:
        hot_pairs = meet(salted, copied, keys)
    else:
        hot_pairs = salted.join(copied, keys).withColumn("d2", squared_distance(dims)).where(F.sqrt("d2") <= span)
    columns = near_join(s_cold, receivers, **plain)
    return (
        columns.unionByName(near_join(s_hot, r_cold, **plain))
        .unionByName(hot_pairs.select(*columns.columns))
    )
