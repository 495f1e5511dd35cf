"""Windows of fixed length that repeat in documents of smaller id, over sequences of bytes or words.

A rolling hash of ``gram`` symbols runs over each document. The smallest hash inside a window is the
window's trigger, so equal windows have equal triggers at equal offsets, and consecutive windows of
one trigger form a phrase, at most ``2 * window - gram`` symbols long. Triggers cut documents into
phrases the same way wherever a passage stands, and the distinct phrases are a small dictionary of a
repetitive corpus. Whole copies of a document are told by digests first. One lazy plan of three exchanges over the documents' chunks and two over buckets:

1. a chunk of documents sends the hashes of its triggers to buckets (40 bits each, once per chunk);
2. a bucket answers which of them other chunks hold too (one bit each);
3. a chunk sends its distinct phrases at repeated triggers, each with its smallest document;
4. a bucket joins equal phrases; where a trigger has different phrases it orders their windows and
   gives each the smallest document that holds it (``resolve``, the operators' own step);
5. a chunk marks the windows whose smallest document is below their own.

A trigger with more than ``HOT`` different phrases (the ends of a line that stands between different
neighbours) goes another way from step 3 on: its windows are dealt by their own hashes, so that its
phrases never meet in one task; one entry per chunk and different window.

Rows are arrays packed per (chunk, bucket), so a passage in every document is one entry per chunk.
Chunks and buckets follow the size of the text. Hashes only choose candidates and name phrases: they
have 64 bits, and windows of different phrases are compared by ``resolve``.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.operators.session import materialize

WINDOW = 50
POSITION_BITS = 28
NO_ID = np.iinfo(np.int64).max
SLICE = 1 << 20
# Different phrases at one trigger, over all chunks that have more than two of them, above which its windows are dealt one by one.
HOT = 1024

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_S = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix, in place where the array is its own."""
    x = x * _C
    x ^= x >> _S
    x *= _B
    x ^= x >> _S
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _A
    x += right
    x ^= x >> _S
    x *= _C
    return x


def gram_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """The hash of ``size`` symbols from each position, built from blocks of doubling length."""
    level, length, out, covered = symbols, 1, None, 0
    while True:
        if size & length:
            if out is None:
                out = level
            else:
                n = min(len(out), len(level) - covered)
                out = joined(out[:n], level[covered:covered + n])
            covered += length
        if length * 2 > size:
            return out
        level = joined(level[:-length], level[length:])
        length *= 2


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of ``width`` values from each position."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span:]) if width > span else values


class Phrases:
    """The phrases of a chunk: one per trigger and stretch of windows."""

    def __init__(self, sequences: list[np.ndarray], hashes: Callable, window: int, gram: int, key_bits: int):
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.lengths = lengths
        self.flat = np.concatenate(sequences) if len(sequences) else np.zeros(0, np.uint8)
        parts, k = [], 0
        while k < len(sequences):
            stop, total = k + 1, lengths[k]
            while stop < len(sequences) and total + lengths[stop] <= SLICE:
                total += lengths[stop]
                stop += 1
            if total >= window:
                parts.append(self._slice(k, stop, hashes, window, gram))
            k = stop
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        trigger, self.name, self.doc, self.at, self.count = columns
        self.trigger = trigger >> np.uint64(64 - key_bits)

    def _slice(self, k, stop, hashes, window, gram):
        base = self.starts[k]
        symbols = hashes(self.flat[base:self.starts[stop - 1] + self.lengths[stop - 1]])
        grams = gram_hashes(symbols, gram)
        low = np.uint64((1 << POSITION_BITS) - 1)
        order = grams & ~low
        order |= np.arange(len(grams), dtype=np.uint64)
        trigger = (smallest(order, window - gram + 1) & low).astype(np.int64)
        whole = gram_hashes(symbols, window)
        n = len(whole)
        doc = np.repeat(np.arange(k, stop), self.lengths[k:stop])
        inside = doc[:n] == doc[window - 1:window - 1 + n]
        new = np.r_[True, (trigger[1:n] != trigger[: n - 1]) | (doc[1:n] != doc[: n - 1])] & inside
        first = np.flatnonzero(new)
        # A stretch ends before the next one or where the windows of its document end.
        ends = np.minimum(np.r_[first[1:], n], (self.starts + self.lengths)[doc[first]] - base - window + 1)
        count = ends - first
        where = trigger[first]
        name = joined(joined(whole[first], whole[first + count - 1]), (count * 64 + where - first).astype(np.uint64))
        return mixed(grams[where]), name, doc[first], first + base, count

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct triggers, and how many different phrases each has here."""
        distinct, where, times = np.unique(self.trigger, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[where] > 2)
        some = some[np.lexsort((self.name[some], where[some]))]
        new = np.ones(len(some), bool)
        new[1:] = (where[some][1:] != where[some][:-1]) | (self.name[some][1:] != self.name[some][:-1])
        return distinct, np.maximum(np.bincount(where[some[new]], minlength=len(distinct)), 1)

    def repeated(self, ids: np.ndarray, marked: np.ndarray, hot: np.ndarray) -> None:
        """Keep phrases whose trigger is marked (by position among the distinct ones) or is in two documents here."""
        distinct, where = np.unique(self.trigger, return_inverse=True)
        low = np.full(len(distinct), NO_ID)
        high = np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, where, ids[self.doc])
        np.maximum.at(high, where, ids[self.doc])
        keep = ((low != high) | marked)[where]
        hot = hot[where][keep]
        self.trigger, self.name, self.doc, self.at, self.count = (
            x[keep] for x in (self.trigger, self.name, self.doc, self.at, self.count)
        )
        order = np.lexsort((ids[self.doc], self.name, self.trigger))
        first = np.r_[True, (self.trigger[order][1:] != self.trigger[order][:-1]) | (self.name[order][1:] != self.name[order][:-1])] if len(order) else np.zeros(0, bool)
        self.one = order[first]  # one phrase of each kind, with its smallest document
        self.hot = hot[self.one]
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(first) - 1


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    at = np.repeat(starts - ends + lengths, lengths)
    at += np.arange(len(at))
    return flat[at]


def _split(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of the stretches of a sorted array."""
    if not len(buckets):
        return []
    cut = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    return list(zip(buckets[cut].tolist(), cut.tolist(), np.r_[cut[1:], len(buckets)].tolist(), strict=True))


def repeats(
    docs: DataFrame, parse: Callable, hashes: Callable, resolve: Callable, finish: Callable, schema: str,
    kind: type, gram: int, window: int = WINDOW,
) -> DataFrame:
    """The rows that ``finish(rows, symbols, removed)`` makes of each chunk of documents.

    ``docs``: (doc_id long, raw binary) and columns for ``finish``. ``parse(raw)`` gives the symbols of a document as an array of
    type ``kind``, ``hashes(symbols)`` their 64-bit hashes, ``resolve(symbols, starts, counts, ids)`` the
    smallest id of every window of different phrases. ``removed`` marks symbols covered by a window that
    also starts in a document of smaller id. A null id counts as the largest; rows of one id are not
    smaller than each other.
    """
    total = docs.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    chunks = int(max(1, total >> 23, min(200, total >> 18)))
    bits = max(6, int(total >> 24).bit_length())
    size = np.dtype(kind).itemsize
    # With the text, so that rows of one id are spread too: they don't remove from each other anyway.
    chunk_of = F.pmod(F.xxhash64("id", "raw", F.lit(11)), F.lit(chunks)).cast("int")
    # Whole copies of a document of smaller id need no search: all their windows start there. Digests
    # find them, and each chunk learns of its own as packed rows of ids and digests.
    named = docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).select("id", chunk_of.alias("chunk"), F.conv(F.substring(F.sha2("raw", 256), 1, 15), 16, 10).cast("long").alias("digest"), F.octet_length("raw").alias("size"))
    named = named.where(F.col("size") >= window)
    shared_texts = named.groupBy("digest", "size").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copied = named.join(shared_texts, ["digest", "size"]).where("id > least").select("id", "digest", "chunk")
    known = materialize(
        copied.groupBy("chunk", F.pmod(F.xxhash64("id", "digest"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct("id", "digest")).alias("rows"))
        .select("chunk", F.col("rows.id").alias("copy_ids"), F.col("rows.digest").alias("copy_digests"))
    )
    dealt = docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("chunk", chunk_of).drop("id")
    mask = np.uint64((1 << 40) - 1)

    def phrases(batch: pd.DataFrame, right: pd.DataFrame) -> tuple[Phrases, list[np.ndarray], list[bool]]:
        """The phrases of a chunk without its copies, the symbols of all its rows, and which are copies."""
        listed = {}
        for some, digests in zip(right["copy_ids"], right["copy_digests"], strict=True):
            for i, d in zip(some if some is not None else [], digests if some is not None else [], strict=True):
                listed.setdefault(int(i), set()).add(int(d))
        parsed = [parse(r) for r in batch["raw"]]
        copy = [
            i in listed and len(r) >= window and int(hashlib.sha256(r).hexdigest()[:15], 16) in listed[i]
            for i, r in zip(ids_of(batch).tolist(), batch["raw"], strict=True)
        ]
        return Phrases([x[:0] if c else x for x, c in zip(parsed, copy, strict=True)], hashes, window, gram, 40 + bits), parsed, copy

    def ids_of(batch: pd.DataFrame) -> np.ndarray:
        return np.array([NO_ID if pd.isna(i) else int(i) for i in batch["doc_id"]], np.int64)

    def triggers(batch: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame([], columns=["bucket", "chunk", "keys", "kinds"])
        distinct, kinds = phrases(batch, right)[0].kinds()
        rows = []
        for bucket, a, b in _split(distinct >> np.uint64(40)):
            several = np.flatnonzero(kinds[a:b] > 2)
            rows.append((
                bucket, int(batch["chunk"].iloc[0]), (distinct[a:b] & mask).view(np.uint8).reshape(-1, 8)[:, :5].tobytes(),
                np.stack([several, kinds[a:b][several]]).astype(np.uint32).tobytes(),
            ))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "kinds"])

    def shared(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("chunk")
        counts = [len(k) // 5 for k in batch["keys"]]
        ends = np.cumsum(counts)
        wide = np.zeros((sum(counts), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(batch["keys"]), np.uint8).reshape(-1, 5)
        keys = wide.view(np.uint64).ravel()
        kinds = np.zeros(len(keys), np.int64)
        for e, n, several in zip(ends, counts, batch["kinds"], strict=True):
            at, k = np.frombuffer(several, np.uint32).reshape(2, -1)
            kinds[at.astype(np.int64) + e - n] = k
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        twice[order] = np.r_[False, same] | np.r_[same, False]
        first = np.flatnonzero(np.r_[True, ~same])
        hot[order] = np.repeat(np.add.reduceat(kinds[order], first) > HOT, np.diff(np.r_[first, len(keys)]))
        rows = [
            (int(key[0]), c, np.packbits(twice[e - n:e]).tobytes(), np.flatnonzero(hot[e - n:e]).astype(np.uint32).tobytes())
            for c, e, n in zip(batch["chunk"], ends, counts, strict=True)
        ]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "marks", "hot"])

    def marked(p: Phrases, marks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        distinct = np.unique(p.trigger)
        out, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        of = {b: (m, h) for b, m, h in zip(marks["bucket"], marks["marks"], marks["hot"], strict=True) if m is not None}
        for bucket, a, b in _split(distinct >> np.uint64(40)):
            if bucket in of:
                out[a:b] = np.unpackbits(np.frombuffer(of[bucket][0], np.uint8), count=b - a).astype(bool)
                hot[a + np.frombuffer(of[bucket][1], np.uint32).astype(np.int64)] = True
        return out, hot

    def spread(p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows of phrases at hot triggers by their hashes, which of them each window is, and the windows' phrases."""
        one = p.one[p.hot]
        if not len(one):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), one
        count = p.count[one]
        length = count + window - 1
        whole = gram_hashes(hashes(_gather(p.flat, p.at[one], length)), window)
        at = _gather(np.arange(len(whole)), np.cumsum(length) - length, count)
        phrase = np.repeat(one, count)
        keys, where = np.unique(joined(p.trigger[phrase], whole[at]), return_inverse=True)
        return keys, where, phrase

    def dealt_windows(keys: np.ndarray) -> np.ndarray:
        """The buckets of sorted windows, numbers below zero."""
        return -1 - (keys >> np.uint64(64 - bits)).astype(np.int64)

    def dictionary(batch: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "chunk", "marks", "hot", "head", "ids", "counts", "symbols"]
        if not len(batch):
            return pd.DataFrame([], columns=columns)
        (p, _, _), ids = phrases(batch, marks), ids_of(batch)
        p.repeated(ids, *marked(p, marks))
        of = {b: (m, h) for b, m, h in zip(marks["bucket"], marks["marks"], marks["hot"], strict=True)}
        rows, chunk = [], int(batch["chunk"].iloc[0])
        for bucket, a, b in _split(p.trigger[p.one] >> np.uint64(40)):
            one = p.one[a:b][~p.hot[a:b]]
            symbols = _gather(p.flat, p.at[one], p.count[one] + window - 1) if len(one) else p.flat[:0]
            rows.append((
                bucket, chunk, *of.get(bucket, (None, None)), np.stack([p.trigger[one], p.name[one]]).tobytes(), ids[p.doc[one]].tobytes(),
                p.count[one].astype(np.uint8).tobytes(), symbols.tobytes(),
            ))
        keys, where, phrase = spread(p)
        least = np.full(len(keys), NO_ID)
        np.minimum.at(least, where, ids[p.doc[phrase]])
        for bucket, a, b in _split(dealt_windows(keys)):
            rows.append((bucket, chunk, None, None, keys[a:b].tobytes(), least[a:b].tobytes(), b"", b""))
        return pd.DataFrame(rows, columns=columns)

    def least_of_windows(batch: pd.DataFrame) -> pd.DataFrame:
        keys, where = np.unique(np.frombuffer(b"".join(batch["head"]), np.uint64), return_inverse=True)
        least = np.full(len(keys), NO_ID)
        np.minimum.at(least, where, np.frombuffer(b"".join(batch["ids"]), np.int64))
        ends = np.cumsum([len(h) // 8 for h in batch["head"]])
        out = batch[["bucket", "chunk", "marks", "hot"]].copy()
        out["least"] = [x.tobytes() for x in np.split(least[where], ends[:-1])]
        return out.assign(mixed=b"", each=b"")

    def solved(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("chunk").reset_index(drop=True)
        if batch["bucket"].iloc[0] < 0:
            return least_of_windows(batch)
        heads = [np.frombuffer(h, np.uint64).reshape(2, -1) for h in batch["head"]]
        trigger, name = np.concatenate(heads, axis=1)
        ids = np.frombuffer(b"".join(batch["ids"]), np.int64)
        count = np.frombuffer(b"".join(batch["counts"]), np.uint8).astype(np.int64)
        flat = np.frombuffer(b"".join(batch["symbols"]), kind)
        length = count + window - 1
        start = np.cumsum(length) - length
        order = np.lexsort((ids, name, trigger))
        t, m = trigger[order], name[order]
        first = np.r_[True, (t[1:] != t[:-1]) | (m[1:] != m[:-1])][:len(t)]
        one = order[first]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(first) - 1
        least = ids[one]
        t = trigger[one]
        alone = (np.r_[True, t[1:] != t[:-1]] & np.r_[t[1:] != t[:-1], True])[:len(t)]
        many = np.flatnonzero(~alone)
        windows: dict[int, np.ndarray] = {}
        if len(many):
            k = one[many]
            found = resolve(flat, start[k], count[k], least[many])
            ends = np.cumsum(count[k])
            low = np.minimum.reduceat(found, ends - count[k])
            high = np.maximum.reduceat(found, ends - count[k])
            least[many] = low
            for j in np.flatnonzero(low != high).tolist():
                windows[int(many[j])] = found[ends[j] - count[k[j]]:ends[j]]
        rows, at = [], 0
        for chunk, marks, hot, head in zip(batch["chunk"], batch["marks"], batch["hot"], heads, strict=True):
            mine = of[at:at + head.shape[1]]
            at += head.shape[1]
            mixed_ = np.array([k in windows for k in mine.tolist()], bool) if windows else np.zeros(len(mine), bool)
            each = [windows[k] for k in mine[mixed_].tolist()]
            rows.append((
                int(batch["bucket"].iloc[0]), chunk, marks, hot, least[mine].tobytes(), np.packbits(mixed_).tobytes(),
                np.concatenate(each).tobytes() if each else b"",
            ))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "marks", "hot", "least", "mixed", "each"])

    def applied(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return finish(batch, [], [])
        ids, (p, parsed, copy) = ids_of(batch), phrases(batch, answers)
        p.repeated(ids, *marked(p, answers))
        change = np.zeros(len(p.flat) + 1, np.int64)
        if len(p.one):
            least = np.empty(len(p.one), np.int64)
            various = np.zeros(len(p.one), bool)
            each, each_at = [], np.zeros(len(p.one), np.int64)
            of = {b: row for b, *row in answers[["bucket", "least", "mixed", "each"]].itertuples(index=False) if row[0] is not None}
            offset = 0
            cold = np.flatnonzero(~p.hot)
            for bucket, a, b in _split(p.trigger[p.one[cold]] >> np.uint64(40)):
                low, flags, values = of[bucket]
                least[cold[a:b]] = np.frombuffer(low, np.int64)
                some = np.unpackbits(np.frombuffer(flags, np.uint8), count=b - a).astype(bool)
                various[cold[a:b]] = some
                where = cold[a:b][some]
                sizes = p.count[p.one[where]]
                each_at[where] = offset + np.cumsum(sizes) - sizes
                values = np.frombuffer(values, np.int64)
                offset += len(values)
                each.append(values)
            keys, where, _ = spread(p)
            if len(keys):
                of_window = np.concatenate([np.frombuffer(of[bucket][0], np.int64) for bucket, _, _ in _split(dealt_windows(keys))])
                sizes = p.count[p.one[p.hot]]
                various[p.hot] = True
                each_at[p.hot] = offset + np.cumsum(sizes) - sizes
                each.append(of_window[where])
            each = np.concatenate(each)
            own = ids[p.doc]
            whole = ~various[p.kind] & (least[p.kind] < own)
            np.add.at(change, p.at[whole], 1)
            np.add.at(change, p.at[whole] + p.count[whole] - 1 + window, -1)
            part = np.flatnonzero(various[p.kind])
            if len(part):
                sizes = p.count[part]
                value = _gather(each, each_at[p.kind[part]], sizes)
                at = _gather(np.arange(len(p.flat)), p.at[part], sizes)
                at = at[value < np.repeat(own[part], sizes)]
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
        removed = np.cumsum(change[:-1]) > 0
        cut = [removed[a:a + n] for a, n in zip(p.starts, p.lengths, strict=True)]
        cut = [np.full(len(x), len(x) >= window) if c else r for x, c, r in zip(parsed, copy, cut, strict=True)]
        return finish(batch, parsed, cut)

    by_chunk = dealt.groupBy("chunk")
    sent = by_chunk.cogroup(known.groupBy("chunk")).applyInPandas(triggers, "bucket int, chunk int, keys binary, kinds binary")
    both = sent.groupBy("bucket").applyInPandas(shared, "bucket int, chunk int, marks binary, hot binary")
    phrases_sent = by_chunk.cogroup(both.unionByName(known, allowMissingColumns=True).groupBy("chunk")).applyInPandas(
        dictionary, "bucket int, chunk int, marks binary, hot binary, head binary, ids binary, counts binary, symbols binary"
    )
    answers = phrases_sent.groupBy("bucket").applyInPandas(
        solved, "bucket int, chunk int, marks binary, hot binary, least binary, mixed binary, each binary"
    )
    return by_chunk.cogroup(answers.unionByName(known, allowMissingColumns=True).groupBy("chunk")).applyInPandas(applied, schema)
