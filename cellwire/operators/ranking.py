"""Exact ranks, running aggregates and quantiles that never need one task for a whole group.

A running aggregate is taken in two levels: inside buckets that follow the sort order, and over
the few bucket totals. Rows with equal sort values are combined before, so a value that occurs in
a third of all rows becomes one row with a count.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwire.operators.session import ROWS_PER_TASK, exceeds, materialize, spread

CUTS = 255
STRIDE = 16
# Features and units of a tile, whose scores are exchanged as one row where zeros are written out.
FEATURES_PER_BLOCK = 128
UNITS_PER_CHUNK = 256


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    bucket: str | None = None,
    how: str = "sum",
    reverse: bool = False,
) -> DataFrame:
    """Running sum or minimum of ``value`` up to and including the row.

    ``bucket`` names a column that never decreases along ``order``; None means that every group
    is known to fit in one task. ``reverse`` runs from the last row to the first.
    """
    function = {"sum": F.sum, "min": F.min}[how]
    directed = [c.desc() if reverse else c.asc() for c in order]
    parts = [*keys, bucket] if bucket else list(keys)
    local = function(value).over(
        W.partitionBy(*parts).orderBy(*directed).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    if bucket is None:
        return df.withColumn(name, local)
    edge = F.col(bucket).desc() if reverse else F.col(bucket).asc()
    before = W.partitionBy(*keys).orderBy(edge).rowsBetween(W.unboundedPreceding, -1)
    totals = (
        df.groupBy(*parts).agg(function(value).alias("_total"))
        .withColumn("_before", function("_total").over(before))
        .drop("_total")
    )
    if how == "sum":
        combined = F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))
    else:
        combined = F.least(F.col("_local"), F.col("_before"))
    return (
        df.withColumn("_local", local).join(totals, parts)
        .withColumn(name, combined).drop("_local", "_before")
    )


def value_bucket(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add a bucket that follows the order of ``value``, balanced by a mergeable sketch per key."""
    points = F.array(*[F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)])
    cuts = F.percentile_approx(value, points, F.lit(10_000)).alias("_cuts")
    if keys:
        held = df.join(df.groupBy(*keys).agg(cuts), list(keys))
    else:
        held = df.withColumn("_cuts", df.agg(cuts).scalar())
    # The number of cuts below the value, in two steps: whole strides first, then inside one stride.
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(value)))
    marks = F.array(*[F.col("_cuts")[i] for i in range(STRIDE - 1, CUTS, STRIDE)])
    held = held.withColumn("_whole", below(marks) * STRIDE)
    return held.withColumn(name, F.col("_whole") + below(F.slice("_cuts", F.col("_whole") + 1, STRIDE))).drop("_cuts", "_whole")


def _bucket_if_large(counted: DataFrame, keys: Sequence[str], value: str, limit: int):
    """Bucket column for distinct values, only where some group is too large for one task."""
    groups = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if exceeds(groups, "_n", limit):
        return value_bucket(counted, keys, value, "_bucket"), "_bucket"
    return counted, None


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, name: str, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Rank with ties averaged, within ``keys``."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    counted, bucket = _bucket_if_large(counted, keys, value, limit)
    through = running(counted, keys, [F.col(value)], F.col("_c"), "_through", bucket)
    ranks = through.select(
        *keys, value, (F.col("_through") - (F.col("_c") - 1) / F.lit(2.0)).alias(name)
    )
    return df.join(ranks, [*keys, value])


def spearman(
    df: DataFrame, keys: Sequence[str], left: str, right: str, name: str = "spearman",
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rank correlation per key. The pairs are stored first, since every rank reads them again."""
    ranked = average_rank(materialize(df.select(*keys, left, right)), keys, left, "_rl", limit)
    ranked = average_rank(ranked, keys, right, "_rr", limit)
    return ranked.groupBy(*keys).agg(F.corr("_rl", "_rr").alias(name))


def bh_adjust(
    df: DataFrame, p: str = "p_value", q: str = "q_value", keys: Sequence[str] = (), limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Benjamini-Hochberg q values over the non-null p values of each key.

    Works on distinct p values with counts. The buckets are fixed functions of p: 1/1024 wide, and
    powers of two below that, so no group ever meets in one task; keyed groups that a size check
    proves small go without. The tests are stored first, because ranks, sizes and the final join
    each read them.
    """
    keys, df = list(keys), materialize(df)
    known = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_c"))
    if keys and not exceeds(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "_n", limit):
        ranked = running(known, keys, [F.col(p)], F.col("_c"), "_rank").withColumn(
            "_raw", F.col(p) * F.sum("_c").over(W.partitionBy(*keys)) / F.col("_rank"))
        ranked = running(ranked, keys, [F.col(p)], F.col("_raw"), "_q", None, "min", reverse=True)
        return df.join(ranked.select(*keys, p, F.least(F.lit(1.0), F.col("_q")).alias(q)), [*keys, p], "left")
    small = -F.least(F.lit(1100.0), F.floor(-F.log2(p)))
    known = known.withColumn(
        "_bucket",
        F.when(F.col(p) >= 1 / 1024, F.floor(F.col(p) * 1024))
        .when(F.col(p) > 0, small.cast("long")).otherwise(F.lit(-1101)),
    )
    ranked = running(known, keys, [F.col(p)], F.col("_c"), "_rank", "_bucket")
    size = F.sum("_c").alias("_m")
    if keys:
        ranked = ranked.join(known.groupBy(*keys).agg(size), keys)
    else:
        ranked = ranked.withColumn("_m", known.agg(size).scalar())
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    ranked = running(ranked, keys, [F.col(p)], F.col("_raw"), "_q", "_bucket", "min", reverse=True)
    adjusted = ranked.select(*keys, p, F.least(F.lit(1.0), F.col("_q")).alias(q))
    return df.join(adjusted, [*keys, p], "left")


def order_statistics(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    count: str,
    sizes: DataFrame,
    probs: Sequence[float],
    names: Sequence[str],
    large: bool,
) -> DataFrame:
    """Type-7 quantiles from distinct values with counts and the full group sizes.

    ``sizes`` has the keys and ``n``; values that ``counted`` lacks are zeros below every listed
    value, so implicit zeros are never written out.
    """
    keys, bucket = list(keys), None
    if large:
        counted, bucket = value_bucket(counted, keys, value, "_bucket"), "_bucket"
    through = running(counted, keys, [F.col(value)], F.col(count), "_through", bucket)
    listed = counted.groupBy(*keys).agg(F.sum(count).alias("_listed"))
    placed = (
        through.join(listed.join(sizes, keys), keys)
        .withColumn("_last", F.col("n") - F.col("_listed") + F.col("_through"))
        .withColumn("_first", F.col("_last") - F.col(count) + 1)
    )
    outputs = []
    for prob, name in zip(probs, names):
        position = (F.col("n") - 1) * F.lit(float(prob)) + 1
        low = F.floor(position)
        share = position - low
        for rank, part in ((low, 1 - share), (F.least(low + 1, F.col("n")), share)):
            hit = (F.col("_first") <= rank) & (F.col("_last") >= rank)
            outputs.append((name, F.sum(F.when(hit, F.col(value) * part))))
    merged = [
        F.coalesce(outputs[2 * i][1], F.lit(0.0)) + F.coalesce(outputs[2 * i + 1][1], F.lit(0.0))
        for i in range(len(names))
    ]
    return placed.groupBy(*keys).agg(*[c.alias(n) for c, n in zip(merged, names)])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exact type-7 quantiles per key.

    Groups up to ``limit`` rows use the built-in exact percentile, whose buffer holds the group;
    larger groups are ranked in buckets.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if not exceeds(sizes, "n", limit):
        wanted = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("_q")
        return known.groupBy(*keys).agg(wanted).select(
            *keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]
        )
    if not keys:
        known, sizes = known.withColumn("_all", F.lit(1)), sizes.withColumn("_all", F.lit(1))
    parts = keys or ["_all"]
    counted = known.groupBy(*parts, value).agg(F.count(F.lit(1)).alias("_c"))
    return order_statistics(counted, parts, value, "_c", sizes, probs, names, True).drop("_all")


def dense_index(df: DataFrame, keys: Sequence[str], order: Column, name: str, bucket: Column) -> DataFrame:
    """Zero-based index along a unique sort column, in two levels."""
    held = df.withColumn("_order", order).withColumn("_bucket", bucket)
    indexed = running(held, keys, [F.col("_order")], F.lit(1), name, "_bucket")
    return indexed.withColumn(name, F.col(name) - 1).drop("_order", "_bucket")


def complete_grid(units: DataFrame, features: DataFrame, unit: str, feature: str) -> DataFrame:
    """Every (unit, feature) key pair, dealt by unit.

    The result has one row per pair by definition; both inputs must be unique keys. Only the keys of the
    smaller side are ever copied; the pairs arise where the keys of the other side lie.
    """
    return spread(units.select(unit), unit).crossJoin(features.select(feature))


def zero_filled(
    nonzero: DataFrame, units: DataFrame, features: DataFrame, unit: str, feature: str, score: str = "score",
    block: int = FEATURES_PER_BLOCK, chunk: int = UNITS_PER_CHUNK,
) -> DataFrame:
    """Every (unit, feature) with its score, zeros written out.

    Features are dealt into blocks and units into chunks. What is exchanged are the listed scores and one row per tile
    of a chunk and a block; the rest arises in the last step, so no table of the size of the result, or of the units
    times the blocks, is sorted or exchanged. The rows of a tile come unit by unit and name its features in one order,
    and neighbouring tiles share a task, so files of them hold runs and repeats of few names. ``unit`` has the same
    type in both tables.
    """
    digest = F.md5(F.col(feature).cast("string"))
    named = features.select(feature).withColumn("_name", F.coalesce(F.concat(digest, F.col(feature).cast("string")), F.lit("")))
    index = dense_index(named, [], F.col("_name"), "_index", F.substring("_name", 1, 3))
    index = materialize(index.select(
        feature, F.floor(F.col("_index") / block).alias("_block"), (F.col("_index") % block).cast("int").alias("_at")))
    names = F.transform(F.sort_array(F.collect_list(F.struct("_at", feature))), lambda e: e[feature])
    blocks = materialize(index.groupBy("_block").agg(names.alias("_all")))
    owners = materialize(units.select(unit))
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    high, wide = max(1, -(-owners.count() // chunk)), max(1, blocks.count())
    dealt = F.pmod(F.xxhash64(unit), F.lit(high)).alias("_chunk")
    held = F.transform(F.collect_list(F.struct(unit)), lambda e: e[unit])
    chunks = materialize(owners.select(unit, dealt).groupBy("_chunk").agg(held.alias("_units")))
    entry = F.struct("_at", feature, F.coalesce(F.col(score), F.lit(0.0)).alias(score)).alias("_entry")
    listed = nonzero.select(unit, feature, score).where(F.col(unit).isNotNull()).join(index, feature).select(dealt, "_block", unit, entry)
    # One row without a unit stands for each tile, also where nothing is listed.
    bare = [F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in (unit, "_entry")]
    tiles = chunks.select("_chunk").crossJoin(blocks.select("_block")).select("*", *bare)
    tile = ["_part", "_chunk", "_block"]
    part = F.expr(f"CAST((_chunk * {wide} + _block) * {parts} div {high * wide} AS INT)")
    rows = listed.unionByName(tiles).withColumn("_part", part).repartitionById(parts, "_part")
    owned = rows.groupBy(*tile, unit).agg(F.collect_list("_entry").alias("_own"))
    known = F.collect_list(F.when(F.col(unit).isNotNull(), F.struct(unit, "_own")))
    rows = owned.groupBy(*tile).agg(F.map_from_entries(known).alias("_listed")).join(chunks, "_chunk").join(blocks, "_block")
    rows = rows.select("_all", "_listed", F.explode("_units").alias(unit))
    rows = rows.select(unit, "_all", F.element_at("_listed", F.col(unit)).alias("_own"))
    absent = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_own")["_at"])
    zeros = F.transform(absent, lambda i: F.struct(i.alias("_at"), F.get("_all", i).alias(feature), F.lit(0.0).alias(score)))
    full = F.when(F.col("_own").isNotNull(), F.sort_array(F.concat("_own", zeros)))
    rows = rows.select(unit, "_all", full.alias("_full"))
    rows = rows.select(unit, F.col("_full")[score].alias("_scores"), F.posexplode(F.coalesce(F.col("_full")[feature], "_all")).alias("_i", feature))
    return rows.select(unit, feature, F.coalesce(F.get("_scores", F.col("_i")), F.lit(0.0)).alias(score))
