"""Edges of a block of senders in the order of their ids: the part of ``graph.ordered_edges`` that runs inside a task."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CANDIDATES = 1 << 21  # pairs that are compared at once


class Receivers:
    """The cells of one sample in the order of their ids, found by strips of the second axis and ranks of the first."""

    def __init__(self, rows: pa.Table, dims: Sequence[str], radius: float, most: float):
        self.ids = rows["cell_id"].combine_chunks()
        self.names = self.ids.unique()
        self.name = self.rank(self.ids)
        self.places = [rows[d].to_numpy() for d in dims]
        self.most, self.reach = most, max(radius, float(np.sqrt(most))) * (1 + 1e-9)
        self.first = np.sort(self.places[0])
        floors = self._floor(self.places[1])
        self.strips = np.unique(floors)
        # Equal first coordinates share a rank, so a stretch of ranks is a stretch of coordinates.
        key = self._key(np.searchsorted(self.strips, floors), np.searchsorted(self.first, self.places[0]))
        self.at = np.argsort(key, kind="stable")
        self.key = key[self.at]

    def rank(self, ids: pa.Array) -> np.ndarray:
        return pc.index_in(ids, value_set=self.names).to_numpy(zero_copy_only=False).astype(np.int64)

    def _floor(self, place: np.ndarray) -> np.ndarray:
        return np.floor(place / (2 * self.reach))

    def _key(self, strip: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return strip.astype(np.int64) * (len(self.first) + 1) + rank

    def stretches(self, places: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each sender and strip that its reach touches (three at most), where candidates begin and end."""
        low, high = (np.searchsorted(self.first, places[0] + s * self.reach, side)
                     for s, side in ((-1, "left"), (1, "right")))
        bottom = np.searchsorted(self.strips, self._floor(places[1] - self.reach))
        top = np.searchsorted(self.strips, self._floor(places[1] + self.reach), "right")
        begins, ends = [], []
        for k in range(3):
            strip = bottom + k
            begin = np.searchsorted(self.key, self._key(strip, low))
            begins.append(begin)
            ends.append(np.where(strip < top, np.searchsorted(self.key, self._key(strip, high)), begin))
        return np.stack(begins, axis=1), np.stack(ends, axis=1)

    def edges(self, senders: pa.Table, dims: Sequence[str]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        """(sender, receiver, distance) of some senders, ordered by the ids; rows of one id must come together."""
        ids = senders["cell_id"].combine_chunks()
        places, name = [senders[d].to_numpy() for d in dims], self.rank(ids)
        begins, ends = self.stretches(places)
        total = np.r_[0, np.cumsum((ends - begins).sum(axis=1))]
        starts = np.r_[np.flatnonzero(np.r_[True, name[1:] != name[:-1]]), len(name)]
        sums, k = total[starts], 0
        while k < len(starts) - 1:
            stop = max(k + 1, int(np.searchsorted(sums, sums[k] + CANDIDATES, "right")) - 1)
            some = slice(starts[k], starts[stop])
            begin, size = begins[some].ravel(), (ends[some] - begins[some]).ravel()
            s = np.repeat(np.repeat(np.arange(some.start, some.stop), 3), size)
            r = self.at[np.arange(len(s)) + np.repeat(begin - (np.cumsum(size) - size), size)]
            d2 = np.zeros(len(s))
            for mine, theirs in zip(places, self.places, strict=True):
                delta = mine[s] - theirs[r]
                d2 += delta * delta
            met = np.flatnonzero((d2 <= self.most) & (name[s] != self.name[r]))
            met = met[np.argsort(name[s[met]] * len(self.name) + r[met], kind="stable")]
            yield ids.take(pa.array(s[met])), self.ids.take(pa.array(r[met])), np.sqrt(d2[met])
            k = stop


def edges_in_order(batches: Iterator[pa.RecordBatch], dims: Sequence[str], radius: float, most: float) -> Iterator[pa.RecordBatch]:
    """Edges of the senders among rows that come by sample, receivers first, then by id; squared distances up to ``most`` count."""
    sample, held, found, waiting = None, [], None, None

    def written(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for s, r, distance in found.edges(rows, dims):
            if len(distance):
                yield pa.record_batch([pa.repeat(sample, len(s)), s, r, pa.array(distance)], ["sample_id", "sender_id", "receiver_id", "distance"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        code = pc.index_in(table["sample_id"], value_set=table["sample_id"].unique()).to_numpy()
        sender = table["sender"].to_numpy()
        cut = np.flatnonzero((np.diff(code) != 0) | (np.diff(sender) != 0)) + 1
        for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(table)].tolist(), strict=True):
            if a == b:
                continue
            rows = table.slice(a, b - a)
            if sample is None or rows["sample_id"][0] != sample:
                if waiting is not None:
                    yield from written(waiting)
                sample, held, found, waiting = rows["sample_id"][0], [], None, None
            if not sender[a]:
                held.append(rows)
                continue
            if found is None:
                found = Receivers(pa.concat_tables(held), dims, radius, most)
                held = []
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            # The rows of the last id wait for others that may follow.
            name = found.rank(rows["cell_id"].combine_chunks())
            whole = int(np.searchsorted(name, name[-1]))
            waiting = rows.slice(whole)
            yield from written(rows.slice(0, whole))
    if waiting is not None:
        yield from written(waiting)
