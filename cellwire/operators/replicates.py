"""Sums over edges for all replicates of the labels: the part of ``plans.communication`` that runs inside a task."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.operators.session import spread

CANDIDATES = 1 << 20  # pairs that are compared at once
PAIRS = 1 << 12  # pairs of labels up to which sums of a replicate stand in an array
HELD = 1 << 20  # sums that a task holds before it passes them on
ENTRIES = ["lr_index", "level", "modulator", "span"]


@dataclass(frozen=True)
class Scores:
    """How an edge is scored; ``labels`` is the number of label codes."""

    radius: float
    ratio: float
    scale_distance: float
    kh: float
    n: float
    labels: int


class Side:
    """Senders or receivers: places, label codes by replicate, and levels by interaction."""

    def __init__(self, rows: pa.Table, dims: int, codes: np.dtype, factor: int = 1):
        rows = rows.combine_chunks()
        self.size = len(rows)
        self.places = [rows[f"p{i}"].to_numpy() for i in range(dims)]
        labels = pc.list_flatten(rows["labels"]).to_numpy().reshape(self.size, -1)
        self.codes = np.ascontiguousarray(labels.T, dtype=codes) * codes.type(factor)
        self.cell = np.repeat(np.arange(self.size), pc.list_value_length(rows["lr_index"]).to_numpy())
        which, self.level, self.modulator, self.span = (pc.list_flatten(rows[c]).to_numpy() for c in ENTRIES)
        self.order = np.argsort(which, kind="stable")
        names, starts, sizes = np.unique(which[self.order], return_index=True, return_counts=True)
        self.of = dict(zip(names.tolist(), zip(starts.tolist(), (starts + sizes).tolist(), strict=True), strict=True))

    def column(self, interaction) -> tuple[np.ndarray, np.ndarray, float]:
        """Level and modulator of every cell, 0 where it has none, and the reach of the interaction."""
        at = self.order[slice(*self.of[interaction])]
        out = np.zeros((2, self.size))
        out[0, self.cell[at]], out[1, self.cell[at]] = self.level[at], self.modulator[at]
        return out[0], out[1], float(self.span[at[0]])


def _terms(senders: Side, receivers: Side, rule: Scores) -> Iterator[tuple]:
    """(interaction, senders, receivers, scores) of the edges between two sides, sender by sender; senders are ordered by the first axis."""
    reach = rule.radius * (1 + 1e-9)
    low, high = np.searchsorted(senders.places[0], [np.nanmin(receivers.places[0]) - reach, np.nanmax(receivers.places[0]) + reach])
    d2 = np.zeros((max(0, high - low), receivers.size))
    for mine, theirs in zip(senders.places, receivers.places, strict=True):
        delta = mine[low:high, None] - theirs[None, :]
        d2 += delta * delta
    distance = np.sqrt(d2)
    s, r = np.nonzero((d2 > 0) & (distance <= rule.radius))
    distance = distance[s, r]
    s += low
    weight = 1.0 / (distance * rule.ratio * rule.scale_distance)
    for interaction in senders.of.keys() & receivers.of.keys():
        left, mine, span = senders.column(interaction)
        right, theirs, _ = receivers.column(interaction)
        product = left[s] * right[r]
        at = np.flatnonzero((product > 0) & (distance <= span))
        product, i, j = product[at], s[at], r[at]
        raised = product if rule.n == 1 else product ** rule.n
        p = raised / (rule.kh ** rule.n + raised) * weight[at] * (mine[i] * theirs[j])
        good = (p > 0) & (p < np.inf)
        if not good.all():
            i, j, p = i[good], j[good], p[good]
        if len(p):
            yield interaction, i, j, p


class Sums:
    """Sums and numbers of edges per interaction, replicate and pair of labels, passed on before they are many."""

    def __init__(self, labels: int, which: pa.DataType):
        self.labels, self.which, self.held = labels, which, {}

    def add(self, senders: Side, receivers: Side, rule: Scores, sample: pa.Scalar) -> Iterator[pa.RecordBatch]:
        bins, replicates = self.labels ** 2, len(senders.codes)
        for interaction, i, j, p in _terms(senders, receivers, rule):
            if bins > PAIRS:
                for b in range(replicates):
                    code, at = np.unique(senders.codes[b][i] + receivers.codes[b][j], return_inverse=True)
                    yield self._batch(sample, interaction, np.full(len(code), b), code, np.bincount(at, p), np.bincount(at))
                continue
            if interaction not in self.held:
                if (len(self.held) + 1) * replicates * bins > HELD:
                    yield from self.passed(sample)
                self.held[interaction] = np.zeros((replicates, bins)), np.zeros((replicates, bins), np.int64)
            totals, edges = self.held[interaction]
            runs = np.bincount(i, minlength=senders.size)
            for b in range(replicates):
                code = np.repeat(senders.codes[b], runs)
                code += receivers.codes[b].take(j)
                totals[b] += np.bincount(code, p, bins)
                edges[b] += np.bincount(code, minlength=bins)

    def passed(self, sample: pa.Scalar) -> Iterator[pa.RecordBatch]:
        for interaction, (totals, edges) in self.held.items():
            b, code = np.nonzero(edges)
            if len(b):
                yield self._batch(sample, interaction, b, code, totals[b, code], edges[b, code])
        self.held = {}

    def _batch(self, sample, interaction, b, code, total, edges) -> pa.RecordBatch:
        number = lambda values, kind: pa.array(values.astype(kind))
        return pa.record_batch(
            [pa.repeat(sample, len(b)), pa.repeat(pa.scalar(interaction, self.which), len(b)), number(b, np.int32),
             number(code // self.labels, np.int32), number(code % self.labels, np.int32), pa.array(total), number(edges, np.int64)],
            ["sample_id", "lr_index", "b", "sender_group", "receiver_group", "total", "active_edges"])


def _stretches(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[bool, bool, pa.Table]]:
    """(whether a new key begins, whether these are receivers, rows) for rows that come by key, senders first."""
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).combine_chunks()
        if not len(table):
            continue
        cut = np.zeros(len(table) - 1, bool)
        for c in [*keys, "receiver"]:
            column = table[c].chunk(0)
            cut |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(cut) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(table)], strict=True):
            key = [table[c][a].as_py() for c in keys]
            yield key != last, bool(table["receiver"][a].as_py()), table.slice(a, b - a)
            last = key


def replicate_sums(batches: Iterator[pa.RecordBatch], keys: Sequence[str], dims: int, rule: Scores) -> Iterator[pa.RecordBatch]:
    """Sums of the edges between the senders and the receivers of each key, whose first column is the sample."""
    narrow, wide = np.min_scalar_type(rule.labels), np.dtype(np.int64)
    sums, sample, waiting, senders = None, None, [], None
    with np.errstate(all="ignore"):
        for new, are_receivers, rows in _stretches(batches, keys):
            if new:
                waiting, senders = [], None
                if sums is not None and rows[keys[0]][0] != sample:
                    yield from sums.passed(sample)
                sample = rows[keys[0]][0]
                sums = sums or Sums(rule.labels, rows["lr_index"].type.value_type)
            if not are_receivers:
                waiting.append(rows)
                continue
            if senders is None:
                if not waiting:
                    continue
                # A pair of labels has one number: the sender's code times the number of labels, plus the receiver's.
                senders, waiting = Side(pa.concat_tables(waiting), dims, wide, rule.labels), []
            step = max(1, CANDIDATES // senders.size)
            for k in range(0, len(rows), step):
                yield from sums.add(senders, Side(rows.slice(k, step), dims, narrow), rule, sample)
        if sums is not None:
            yield from sums.passed(sample)


def sums_of_sides(senders: DataFrame, receivers: DataFrame, keys: Sequence[str], dims: Sequence[str], rule: Scores) -> DataFrame:
    """Sums of the scores of the edges between rows that share ``keys``, per interaction, replicate and pair of label codes.

    Instead of a row per edge, interaction and replicate, a task adds up whole arrays of edges. It holds the senders of
    one key, of which there are few where crowded tiles are split; receivers pass by.
    """
    names = [f"k{i}" for i in range(len(keys))]

    def side(rows: DataFrame, tag: str, flag: int) -> DataFrame:
        # Rows without a key meet nothing.
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        return rows.select(
            *[F.col(k).alias(name) for k, name in zip(keys, names, strict=True)], F.lit(flag).alias("receiver"),
            *[F.col(f"{tag}_{d}").cast("double").alias(f"p{i}") for i, d in enumerate(dims)],
            *[F.col(f"{tag}_{c}").alias(c) for c in [*ENTRIES, "labels"]])

    rows = spread(side(senders, "s", 0).unionByName(side(receivers, "r", 1)), *names)
    rows = rows.sortWithinPartitions(*names, "receiver", "p0")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    which, count = rows.schema["lr_index"].dataType.elementType.simpleString(), len(dims)

    def run(batches):
        return replicate_sums(batches, names, count, rule)

    return rows.mapInArrow(run, f"sample_id {types['k0']}, lr_index {which}, b int, sender_group int, receiver_group int, total double, active_edges long")
