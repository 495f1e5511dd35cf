"""Label permutations and permutation tests.

A replicate is a column value, not a loop: every cell carries an array with its true label at
position 0 and its permuted labels after it, and one aggregation keyed by replicate gives the
observed and all null statistics together. The labels come from keyed bijections of the cell's
position in its stratum, so drawing them exchanges each cell once, whatever the number of replicates.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwire.functions.expressions import hash_order
from cellwire.operators.expression import group_sizes, group_trimean, molecule_levels, scale_by_maximum
from cellwire.operators.interactions import Interactions
from cellwire.operators.ranking import running
from cellwire.operators.scoring import group_pair_scores
from cellwire.operators.session import ROWS_PER_TASK, exceeds, materialize, spread

CELL = ["sample_id", "cell_id"]
RECORD = ["lr_index", "sender_group", "receiver_group"]


ROUNDS = 6
# Strata up to this size are ordered by hash, larger ones go through a network, which mixes small ones badly.
ORDERED = 64
# Shapes that are tried for the domain of a network.
SHAPES = 64


def _hash_rank(df: DataFrame, keys: Sequence[str], digest: str, name: str, split: bool) -> DataFrame:
    """Position of each row in the order of its digest, within ``keys``.

    The digest is uniform, so its leading digits cut a large stratum into even parts.
    """
    order = [F.col(digest), *[F.col(c) for c in CELL]]
    if not split:
        return running(df, keys, order, F.lit(1), name)
    parts = df.withColumn("_part", F.substring(digest, 1, 3))
    return running(parts, keys, order, F.lit(1), name, "_part").drop("_part")


def _keyed(strata: DataFrame, keys: Sequence[str], size: str, seed: int) -> DataFrame:
    """Add what the bijections of a stratum need: ``_key``, and a domain of ``_wide`` x ``_high`` positions.

    Of up to ``SHAPES`` near-square domains the one with the fewest positions beyond ``size`` is taken.
    """
    text = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in (F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *text))
    wide = f"CAST(ceil(sqrt({size})) AS BIGINT)"
    widths = f"sequence({wide}, {wide} + least({SHAPES - 1}, {wide} div 4))"
    shapes = f"transform({widths}, w -> struct(w * (({size} + w - 1) div w) AS d, w AS w))"
    return strata.withColumn("_key", F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")).withColumn(
        "_shape", F.expr(f"array_min({shapes})")).withColumn("_wide", F.col("_shape.w")).withColumn(
        "_high", F.expr("_shape.d div _shape.w")).drop("_shape")


def bijection(position: str, replicate: str, size: str = "_size") -> str:
    """SQL of where replicate ``replicate`` of a stratum puts ``position``, both in [0, size).

    Up to ``ORDERED`` positions are ranked by their hashes. More go through a Feistel network over the stratum's
    domain: its two coordinates take turns being shifted by a hash of the other one. A position that lands beyond
    ``size`` goes on through the network until it is back; there are ``_wide * _high - size`` such positions, so that
    many steps are always enough.
    """
    drawn = f"(_key * 4294967296 + {replicate} * 64)"

    def hashed(what: str) -> str:
        return f"xxhash64({drawn}, CAST({what} AS BIGINT))"

    step = f"named_struct('x', s.y, 'y', (s.x + pmod(xxhash64({drawn} + i, s.y), s.m)) % s.m, 'm', s.n, 'n', s.m)"

    def network(at: str) -> str:
        start = f"named_struct('x', {at} div _high, 'y', {at} % _high, 'm', _wide, 'n', _high)"
        return f"reduce(sequence(1, {ROUNDS}), {start}, (s, i) -> {step}, s -> s.x * _high + s.y)"

    walk = f"CASE WHEN t < {size} THEN t ELSE {network('t')} END"
    far = f"reduce(sequence(CAST(0 AS BIGINT), _wide * _high - {size}), {network(position)}, (t, u) -> {walk})"
    own = hashed(position)
    smaller = f"{hashed('j')} < {own} OR {hashed('j')} = {own} AND j < {position}"
    near = f"CAST(size(filter(sequence(CAST(0 AS BIGINT), {size} - 1), j -> {smaller})) AS BIGINT)"
    return f"CASE WHEN {size} <= {ORDERED} THEN {near} ELSE {far} END"


def label_codes(cells: DataFrame, label: str = "group") -> DataFrame:
    """(label, code): labels numbered in their order. Labels are a dictionary, so one array holds them."""
    return cells.agg(F.sort_array(F.collect_set(label)).alias("_l")).select(F.posexplode("_l").alias("code", label))


def permuted_labels(
    cells: DataFrame,
    strata: Sequence[str],
    n_perm: int,
    seed: int = 1,
    label: str = "group",
    limit: int = ROWS_PER_TASK,
    first: int = 1,
    codes: DataFrame | None = None,
) -> DataFrame:
    """``labels``: array of the true label and ``n_perm`` labels permuted within the strata.

    Every cell gets one position in its stratum, by md5 of sample and cell. Replicate b sends the position through
    a bijection keyed by b and takes the label that owns the new position when labels are laid out in order
    with their counts: a permutation of the labels that needs no row per replicate. With ``codes``
    (label, code) the array holds codes. ``first`` numbers the first replicate, so that later batches continue the
    sequence.
    """
    strata = list(strata)
    mark = label
    if codes is not None:
        cells, mark = cells.join(F.broadcast(codes.select(label, F.col("code").alias("_code"))), label), "_code"
    tally = cells.groupBy(*strata, mark).agg(F.count(F.lit(1)).alias("_n"))
    through = running(tally, strata, [F.col(mark)], F.col("_n"), "_upper")
    # One entry per label of a stratum, never per cell.
    owners = through.groupBy(*strata).agg(
        F.sort_array(F.collect_list(F.struct("_upper", F.col(mark).alias("_label")))).alias("_owners"),
        F.sum("_n").alias("_size"),
    )
    owners = materialize(_keyed(owners, strata, "_size", seed))
    split = exceeds(owners, "_size", limit)
    ranked = _hash_rank(cells.withColumn("_digest", hash_order(seed, *[F.col(c) for c in CELL])), strata, "_digest", "_rank", split)
    places = f"transform(sequence({first}L, {first + n_perm - 1}L), b -> {bijection('(_rank - 1)', 'b')})"
    owner = "_owners[size(filter(_owners, o -> o._upper <= p))]._label"
    # A cell is a short row with much work: the replicates are drawn in as many tasks as there are partitions.
    return spread(ranked.join(owners, strata), *CELL).withColumn(
        "labels", F.expr(f"concat(array({mark}), transform({places}, p -> {owner}))")
    ).drop("_digest", "_rank", "_owners", "_size", "_key", "_wide", "_high", "_code")


def permute_within_blocks(blocks: DataFrame, seed: int = 1, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Source cell for every target cell: a bijection inside each block; single cells stay."""
    sizes = materialize(_keyed(group_sizes(blocks, ["block_id"]), ["block_id"], "n", seed))
    split = exceeds(sizes, "n", limit)
    ranked = _hash_rank(
        blocks.select("block_id", *CELL, hash_order(seed, *[F.col(c) for c in CELL]).alias("_d")), ["block_id"], "_d", "_slot", split).drop("_d")
    ranked = materialize(ranked.withColumn("_slot", F.col("_slot") - 1))
    moved = ranked.join(sizes, "block_id").withColumn("_slot", F.expr(bijection("_slot", "1L", "n")))
    source = ranked.select("block_id", "_slot", F.col("cell_id").alias("source_id"))
    return moved.join(source, ["block_id", "_slot"]).select("block_id", "cell_id", "source_id")


def exchangeability(cells: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Blocks, cells in blocks with several groups, and mean share of cells whose label moved."""
    mixed = cells.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("group").alias("_g"))
    shuffled = F.col("_g") > 1
    out = mixed.agg(
        F.count(F.lit(1)).alias("block_count"),
        F.sum(shuffled.cast("long")).alias("mixed_blocks"),
        (F.sum(F.when(shuffled, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("exchangeable_fraction"),
    )
    if labels is None:
        return out
    moved = labels.select(F.explode(F.slice("labels", 2, F.size("labels") - 1)).alias("_l"), "group").agg(
        F.avg((F.col("_l") != F.col("group")).cast("double")).alias("m"))
    return out.withColumn("moved_fraction", moved.scalar())


def null_trimeans(
    expr: DataFrame, labelled: DataFrame, genes: DataFrame, limit: int = ROWS_PER_TASK, codes: DataFrame | None = None
) -> DataFrame:
    """Group triMeans of every replicate (b = 0 is the observed one) for the referenced genes.

    ``codes`` (group, code): the labels are codes, and names come back only on the aggregated rows.
    """
    scaled = scale_by_maximum(expr).join(genes.select("gene").distinct(), "gene", "left_semi")
    drawn = scaled.join(labelled.select(*CELL, "labels"), CELL).select(
        "gene", "value", F.posexplode("labels").alias("b", "group"))
    sizes = group_sizes(labelled.select(F.col("labels")[0].alias("group")), ["group"])
    means = group_trimean(drawn, sizes, ["b", "group", "gene"], ["group"], limit)
    if codes is None:
        return means
    names = F.broadcast(codes.select(F.col("code").alias("group"), F.col("group").alias("_name")))
    return means.join(names, "group").select("b", F.col("_name").alias("group"), "gene", "value")


MARGIN = 1e-12


def exceeds_score(null, observed):
    """Whether a null score lies above the observed one by more than rounding."""
    return null > observed + MARGIN * F.abs(observed)


def _tail(null, observed, tail: str):
    # Sums in another order differ in the last digits; the margin is relative, so small scores keep theirs.
    if tail == "strict_greater":
        return exceeds_score(null, observed)
    if tail == "greater_equal":
        return null >= observed - MARGIN * F.abs(observed)
    raise ValueError(f"unknown tail: {tail}")


def summarize_nulls(
    scores: DataFrame,
    n_perm: int,
    records: DataFrame | None = None,
    tail: str = "strict_greater",
    finite_correction: bool = False,
    moments: bool = False,
) -> DataFrame:
    """p values from scores keyed by replicate; one window per record holds n_perm + 1 rows.

    Without ``records`` the positive observed scores are reported; with them every requested one.
    """
    whole = W.partitionBy(*RECORD)
    first = F.max(F.when(F.col("b") == 0, F.col("probability"))).over(whole)
    held = scores.select("b", *RECORD, "probability").withColumn("_obs", F.coalesce(first, F.lit(0.0)))
    if records is None:
        held = held.where("_obs > 0")
    null = F.col("b") > 0
    out = held.groupBy(*RECORD).agg(
        F.max("_obs").alias("probability"),
        F.count(F.when(null & _tail(F.col("probability"), F.col("_obs"), tail), 1)).alias("n_reject"),
        F.sum(F.when(null, F.col("probability"))).alias("_sum"),
        F.sum(F.when(null, F.col("probability") * F.col("probability"))).alias("_squares"),
    )
    if records is not None:
        out = records.select(*RECORD).join(out, RECORD, "left").fillna(0, ["n_reject"]).fillna(
            0.0, ["probability", "_sum", "_squares"])
        if tail == "greater_equal":
            out = out.withColumn("n_reject", F.when(F.col("probability") == 0, F.lit(n_perm)).otherwise(F.col("n_reject")))
    share = (F.col("n_reject") + 1) / (n_perm + 1.0) if finite_correction else F.col("n_reject") / float(n_perm)
    out = out.withColumn("pvalue", F.when(F.col("probability") == 0, F.lit(1.0)).otherwise(share))
    if moments:
        mean = F.coalesce(F.col("_sum"), F.lit(0.0)) / n_perm
        out = out.withColumn("null_mean", mean).withColumn(
            "null_variance", F.greatest(F.lit(0.0), F.coalesce(F.col("_squares"), F.lit(0.0)) / n_perm - mean * mean))
    return out.drop("_sum", "_squares")


def block_permutation_scores(
    expr: DataFrame,
    labelled: DataFrame,
    support: DataFrame,
    interactions: Interactions,
    kh: float = 0.5,
    n: float = 1.0,
    records: DataFrame | None = None,
    limit: int = ROWS_PER_TASK,
    codes: DataFrame | None = None,
) -> DataFrame:
    """Scores of all replicates for the supported pairs, or for the requested records only."""
    members = interactions.members
    if records is not None:
        members = members.join(records.select("lr_index").distinct(), "lr_index", "left_semi")
    values = null_trimeans(expr, labelled, members, limit, codes)
    levels = molecule_levels(values, members, ["b", "group"], kh, n)
    pairs = support.select("sender_group", "receiver_group")
    scores = group_pair_scores(levels, pairs, ["b"], kh, n)
    if records is not None:
        scores = scores.join(records.select(*RECORD), RECORD, "left_semi")
    return scores


def block_permutation_test(
    expr: DataFrame,
    blocks: DataFrame,
    support: DataFrame,
    interactions: Interactions,
    n_perm: int = 100,
    seed: int = 1,
    kh: float = 0.5,
    n: float = 1.0,
    records: DataFrame | None = None,
    tail: str = "strict_greater",
    finite_correction: bool = False,
    moments: bool = False,
    limit: int = ROWS_PER_TASK,
    first: int = 1,
) -> DataFrame:
    """Permutation test of group-level scores with profiles permuted inside spatial blocks."""
    mixed = blocks.groupBy("block_id").agg(F.countDistinct("group").alias("g"))
    if not exceeds(mixed, "g", 1):
        raise ValueError("no block spans several groups; increase the block size")
    codes = materialize(label_codes(blocks))
    # Stored, since profiles and group sizes read them, and filters on the labels would be drawn again before the exchange.
    labelled = materialize(permuted_labels(blocks, ["block_id"], n_perm, seed, limit=limit, first=first, codes=codes).select(*CELL, "labels"))
    scores = block_permutation_scores(expr, labelled, support, interactions, kh, n, records, limit, codes)
    return summarize_nulls(scores, n_perm, records, tail, finite_correction, moments)
