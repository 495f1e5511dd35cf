"""Language-model scoring by deleted interpolation: maximum-likelihood n-grams mixed by frequency of their context.

The probability of a token is built up order by order: ``P_k = m * c(gram) / c(context) + (1 - m) * P_(k-1)``,
with the weight m of order k taken from the bucket of the context's count (its number of binary digits); an unseen
context passes to P_(k-1), and P_0 is uniform over the known tokens and one unknown. Texts begin with an unlimited
number of start marks, which are never counted as tokens, and end with an end token, which is.

Counts cover all training documents. They are gathered without a row per token: a chunk of documents sends its
distinct grams, packed, to buckets of the hash space; a bucket adds them up over all chunks and answers each chunk
with what the others hold. Grams of three and more are asked about in a second round, and only where all their pairs
stand in other chunks too; the others can't. Words keep 64-bit hashes; longer grams keep ``22 + log2(tokens)`` bits,
so about one gram in four million shares its count with another at any size. The chunks then store the counts along
their texts, from which the texts are scored without another exchange.

The weights are learned by expectation-maximisation on held-out counts: training documents are halved by their id, and
the tokens of each half are predicted from the counts of the other. Tokens with the same buckets and, to an eighth
of a binary order, the same estimates are one cell with a count. Iterations are aggregations over the stored cells;
the driver gets one row per pair of buckets.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.llm.relative_lz import _words, word_bounds
from cellwire.llm.repeats import joined, mixed
from cellwire.operators.session import materialize

ORDER = 3
CHUNK = 8 << 20  # bytes of text
GRAMS = 1 << 21  # of a bucket, about
LEVEL = 6  # of compression
PART = 1 << 20  # bytes that are cut into words at once
STEPS = 4  # of estimates, per binary order
LEVELS = 512  # codes of an estimate
BUCKETS = 64  # of a context's count, by its binary digits
ROUNDS = 15
SPREAD = 256  # parts of the cells; their number is bounded by their codes
FAMILY = 24  # low bits of a cell that its part does not depend on, so that cells of a part lie close together

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BEGIN, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of each text, the end token last, and their number."""
    parts, sizes, k = [], [], 0
    while k < len(raws):
        stop, total = k + 1, len(raws[k])
        while stop < len(raws) and total + len(raws[stop]) <= PART:
            total += len(raws[stop])
            stop += 1
        flat = b"\n".join(raws[k:stop]).translate(_LOWER)
        starts, _ = word_bounds(flat)
        lengths = np.array([len(r) + 1 for r in raws[k:stop]], np.int64)
        # Words before the end of each text: the end tokens go there.
        ends = np.searchsorted(starts, np.cumsum(lengths))
        parts.append(np.insert(_words(flat), ends, _END))
        sizes.append(np.diff(ends, prepend=0) + 1)
        k = stop
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(sizes)


def grams(words: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the gram of each order that ends at each token."""
    starts = np.cumsum(sizes) - sizes
    out, begin = [words], _BEGIN
    for k in range(2, order + 1):
        before = np.empty_like(words)
        before[1:] = out[-1][:-1]
        before[starts] = begin
        out.append(mixed(joined(before, words) + np.uint64(k)))
        begin = mixed(np.full(1, begin) + np.uint64(k))[0]
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, and the order and stretches that gather equal ones."""
    order = np.argsort(keys)
    ranked = keys[order]
    cut = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return ranked[cut], order, cut


def _counted(own: np.ndarray, order: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.add.reduceat(own[order].astype(np.int64), cut) if len(cut) else np.zeros(0, np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys after Elias and Fano: their low bits side by side, the high ones as marks at ascending places."""
    if not len(keys):
        return b""
    low = max(0, (int(keys[-1]) // len(keys)).bit_length() - 1)
    whole, rest = divmod(low, 8)
    digits = np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(-1, 8)
    parts = [bytes([low]), len(keys).to_bytes(8, "little"), np.ascontiguousarray(digits[:, :whole]).tobytes()]
    if rest:
        parts.append(np.packbits(np.unpackbits(digits[:, whole:whole + 1], axis=1, count=rest, bitorder="little")).tobytes())
    places = (keys >> np.uint64(low)).astype(np.int64) + np.arange(len(keys))
    marks = np.zeros(int(places[-1]) + 1, np.bool_)
    marks[places] = True
    return b"".join([*parts, np.packbits(marks).tobytes()])


def unpacked_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    low, n = raw[0], int.from_bytes(raw[1:9], "little")
    whole, rest = divmod(low, 8)
    digits, at = np.zeros((n, 8), np.uint8), 9 + n * whole
    digits[:, :whole] = np.frombuffer(raw, np.uint8, n * whole, 9).reshape(n, whole)
    if rest:
        size = (n * rest + 7) // 8
        some = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * rest).reshape(n, rest)
        digits[:, whole] = np.packbits(some, axis=1, bitorder="little")[:, 0]
        at += size
    places = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=at)))
    return digits.view("<u8").ravel() | ((places - np.arange(n)).astype(np.uint64) << np.uint64(low))


def packed_counts(*columns: np.ndarray) -> bytes:
    """Columns of counts, one byte each; those from 255 on follow as eight bytes."""
    flat = np.concatenate(columns).astype(np.int64)
    large = flat[flat >= 255].astype("<i8").tobytes()
    return zstandard.compress(np.minimum(flat, 255).astype(np.uint8).tobytes() + large, LEVEL)


def unpacked_counts(raw: bytes, n: int, columns: int) -> np.ndarray:
    data = zstandard.decompress(raw)
    flat = np.frombuffer(data, np.uint8, n * columns).astype(np.int64)
    flat[flat == 255] = np.frombuffer(data, "<i8", offset=n * columns)
    return flat.reshape(columns, n)


def _planes(values: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones, up to the highest that is used."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _joined(planes: bytes, n: int) -> np.ndarray:
    digits = np.zeros((n, 8), np.uint8)
    digits[:, :len(planes) // n] = np.frombuffer(planes, np.uint8).reshape(-1, n).T
    return digits.view("<i8").ravel()


def packed_codes(codes: np.ndarray) -> bytes:
    """Ascending codes that lie close together: their differences, byte by byte."""
    return zstandard.compress(_planes(np.diff(codes, prepend=0)), LEVEL)


def unpacked_codes(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_joined(zstandard.decompress(raw), n))


def packed_ranks(column: np.ndarray) -> bytes:
    """Large counts that repeat: the different ones, most frequent first, and the rank of each, byte by byte."""
    values, ranks, times = np.unique(column, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return zstandard.compress(len(values).to_bytes(8, "little") + values[order].astype("<i8").tobytes() + _planes(place[ranks]), LEVEL)


def unpacked_ranks(raw: bytes, n: int) -> np.ndarray:
    data = zstandard.decompress(raw)
    values = np.frombuffer(data, "<i8", int.from_bytes(data[:8], "little"), 8)
    return values[_joined(data[8 + values.nbytes:], n)]


def packed_texts(rows: pd.DataFrame) -> bytes:
    """Ids, halves and texts of some documents, compressed; a null id has its mark."""
    raws = [r or b"" for r in rows["raw"]]
    known = rows["doc_id"].notna().to_numpy()
    ids = rows["doc_id"].fillna(0).to_numpy(np.int64)
    parts = [np.array([len(raws)], np.int64), ids, np.array([len(r) for r in raws], np.int64), known.astype(np.int8), rows["half"].to_numpy(np.int8)]
    return zstandard.compress(b"".join([p.tobytes() for p in parts] + raws), LEVEL)


def unpacked_texts(packs) -> tuple[list, np.ndarray, list[bytes]]:
    ids, halves, raws = [], [], []
    for pack in packs:
        data = zstandard.decompress(pack)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        numbers = np.frombuffer(data, np.int64, 2 * n, 8)
        marks = np.frombuffer(data, np.int8, 2 * n, 8 + 16 * n)
        ids += [i if k else None for i, k in zip(numbers[:n].tolist(), marks[:n].tolist(), strict=True)]
        halves.append(marks[n:])
        ends = 8 + 18 * n + np.cumsum(numbers[n:])
        raws += [data[a:b] for a, b in zip((ends - numbers[n:]).tolist(), ends.tolist(), strict=True)]
    return ids, np.concatenate(halves), raws


def digits(counts: np.ndarray) -> np.ndarray:
    """The number of binary digits of a count; 0 for 0."""
    return np.frexp(counts.astype(np.float64))[1]


class Part:
    """The distinct grams of one kind in a chunk, with their number in each half, cut by bucket."""

    def __init__(self, keys: np.ndarray, half: np.ndarray, size: int, bucket_bits: int):
        self.keys, self.at, self.cut = _distinct(keys)
        self.own = np.stack([_counted(half == k, self.at, self.cut) for k in (0, 1)])
        self.base = np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(size - bucket_bits)
        self.edges = np.r_[np.searchsorted(self.keys, self.base), len(self.keys)].tolist()

    def asked(self, chunk: int, kind: int) -> list[tuple]:
        rows = []
        for b, base in enumerate(self.base):
            some = slice(self.edges[b], self.edges[b + 1])
            if self.edges[b] < self.edges[b + 1]:
                rows.append((chunk, b, kind, packed_keys(self.keys[some] - base), packed_counts(*self.own[:, some])))
        return rows

    def others(self, answers: pd.DataFrame) -> np.ndarray:
        """What other chunks hold of each distinct gram: counts of both halves, and whether any has it, counted or not."""
        out = np.zeros((3, len(self.keys)), np.int64)
        for b, raw in zip(answers["bucket"], answers["counts"], strict=True):
            out[:, self.edges[b]:self.edges[b + 1]] = unpacked_counts(raw, self.edges[b + 1] - self.edges[b], 3)
        out[2] = out.any(axis=0)
        return out

    def along(self, counts: np.ndarray) -> np.ndarray:
        """The counts of the distinct grams at every gram that went in."""
        # Half the memory where the counts allow it; sums of both halves still fit.
        small = counts.dtype == np.int64 and (not len(counts) or counts.max() < 1 << 30)
        out = np.empty(len(self.at), np.int32 if small else counts.dtype)
        out[self.at] = np.repeat(counts, np.diff(np.r_[self.cut, len(self.at)]))
        return out


class Chunk:
    """The texts of a chunk as tokens and grams. Words (kind 0), pairs (1) and longer grams (2) are asked for apart."""

    def __init__(self, texts: pd.DataFrame, order: int, bits: int, bucket_bits: int):
        self.ids, half, raws = unpacked_texts(texts["texts"])
        self.words, self.sizes = tokens(raws)
        del raws
        self.half = np.repeat(half, self.sizes)
        self.bits, self.bucket_bits = bits, bucket_bits
        shift = np.uint64(64 - bits)
        self.grams = [self.words, *(g >> shift for g in grams(self.words, self.sizes, order)[1:])]

    def part(self, kind: int, opened: list[np.ndarray] | None = None) -> Part:
        if kind < 2:
            return Part(self.grams[kind], self.half, self.bits if kind else 64, self.bucket_bits)
        keys = np.concatenate([g[o] for g, o in zip(self.grams[2:], opened, strict=True)])
        return Part(keys, np.concatenate([self.half[o] for o in opened]), self.bits, self.bucket_bits)

    def opened(self, pairs: Part, others: np.ndarray, order: int) -> list[np.ndarray]:
        """For each order from three on, the tokens whose gram may stand in other chunks: all its pairs do."""
        seen = pairs.along(others[2] > 0)
        place = np.arange(len(seen)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        out = [seen]
        for back in range(1, order - 1):
            before = np.ones_like(seen)
            before[back:] = seen[:-back]
            out.append(out[-1] & (before | (place < back)))
        return out[1:]


ASKED = "chunk int, bucket int, kind int, keys binary, counts binary"
ANSWERED = "chunk int, bucket int, kind int, counts binary, known long"


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's keys, what other chunks hold; the bucket's number of known words goes with one of them."""
    rows = rows.sort_values("chunk")
    keys = [unpacked_keys(k) for k in rows["keys"]]
    edges = np.cumsum([0, *(len(k) for k in keys)]).tolist()
    distinct, at, cut = _distinct(np.concatenate(keys))
    del keys, distinct
    place = np.empty(len(at), np.int64)
    place[at] = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(at)]))
    own = np.concatenate([unpacked_counts(c, b - a, 2) for c, a, b in zip(rows["counts"], edges[:-1], edges[1:], strict=True)], axis=1)
    total = np.stack([_counted(c, at, cut) for c in own])
    known = int((total.sum(axis=0) > 0).sum()) if rows["kind"].iloc[0] == 0 else 0
    others = total[:, place] - own
    # Whether any has it needs telling only where nobody counted it.
    others = np.vstack([others, (np.diff(np.r_[cut, len(at)]) > 1)[place] & ~others.any(axis=0)])
    out = rows[["chunk", "bucket", "kind"]].copy()
    out["counts"] = [packed_counts(*others[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out["known"] = [known, *[0] * (len(out) - 1)]
    return out


def _code(context: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Code of the estimate count / context: 0 for 0, else 1 + STEPS * -log2, rounded."""
    with np.errstate(divide="ignore", invalid="ignore"):
        code = 1 + np.rint(-STEPS * np.log2(count / np.maximum(context, 1)))
    return np.where(count > 0, np.clip(code, 1, LEVELS - 1), 0).astype(np.int64)


def _contexts(counts: list[np.ndarray], sizes: np.ndarray) -> list[np.ndarray]:
    """Counts of the contexts of order 2 and more at each token; a text's first context is as frequent as its end."""
    ends = np.cumsum(sizes)
    out = []
    for c in counts[:-1]:
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[ends - sizes] = counts[0][ends - 1]
        out.append(before)
    return out


def _longer(texts: pd.DataFrame, answers: pd.DataFrame, order: int, bits: int, bucket_bits: int) -> pd.DataFrame:
    """What a chunk asks about its grams of three and more tokens, once it knows which pairs stand elsewhere."""
    held = Chunk(texts, order, bits, bucket_bits)
    pairs = held.part(1)
    opened = held.opened(pairs, pairs.others(answers[answers["kind"] == 1]), order)
    del pairs
    return pd.DataFrame(held.part(2, opened).asked(int(texts["chunk"].iloc[0]), 2), columns=["chunk", "bucket", "kind", "keys", "counts"])


def _annotated(texts: pd.DataFrame, answers: pd.DataFrame, order: int, bits: int, bucket_bits: int) -> pd.DataFrame:
    """The counts along each text of a chunk, and the held-out counts of its training tokens by cell."""
    held = Chunk(texts, order, bits, bucket_bits)
    n = len(held.words)
    along: list[list[np.ndarray]] = [[], []]
    opened: list[np.ndarray] = []
    for kind in range(min(order, 3)):
        part = held.part(kind, opened)
        others = part.others(answers[answers["kind"] == kind])
        if kind == 1 and order > 2:
            opened = held.opened(part, others, order)
        for k in (0, 1):
            counts = part.along(part.own[k] + others[k])
            if kind < 2:
                along[k].append(counts)
                continue
            # Grams that nobody was asked about stand in this chunk only.
            ends = np.cumsum([o.sum() for o in opened])
            for gram, some, asked in zip(held.grams[2:], np.split(counts, ends[:-1]), opened, strict=True):
                alone = Part(gram[~asked], held.half[~asked], held.bits, 0)
                rest = alone.along(alone.own[k])
                whole = np.empty(n, np.promote_types(some.dtype, rest.dtype))
                whole[asked], whole[~asked] = some, rest
                along[k].append(whole)
    del part, others
    cells = []
    for k in (0, 1):
        # The tokens of one half by the counts of the other.
        some = held.half == k
        counts, sizes = along[1 - k], held.sizes
        words = np.where(counts[0] > 0, 1 + np.rint(STEPS * np.log2(np.maximum(counts[0], 1))), 0).astype(np.int64)
        code = k * LEVELS + words
        for context, count in zip(_contexts(counts, sizes), counts[1:], strict=True):
            code = (code * BUCKETS + digits(context)) * LEVELS + _code(context, count)
        cells.append(code[some])
    cell, times = np.unique(np.concatenate(cells), return_counts=True)
    packed = (packed_codes(cell), packed_counts(times), len(cell))
    del cells, cell, times
    both = [a + b for a, b in zip(*along, strict=True)]
    del along, counts
    train = [int((held.half == k).sum()) for k in (0, 1)]
    rows, at, k = [], 0, 0
    while k < len(held.sizes):
        stop, total = k, 0
        while stop < len(held.sizes) and (stop == k or total + held.sizes[stop] <= PART // 4):
            total += held.sizes[stop]
            stop += 1
        some = [c[at:at + total] for c in both]
        words, counts = packed_ranks(some[0]), packed_counts(*some[1:]) if some[1:] else b""
        rows.append((held.ids[k:stop], held.sizes[k:stop].tolist(), words, counts, *(packed if not k else (b"", b"", 0)),
                     *((int(answers["known"].sum()), *train) if not k else (0, 0, 0))))
        at, k = at + total, stop
    return pd.DataFrame(rows, columns=["ids", "sizes", "words", "counts", "cells", "times", "n_cells", "known", "train_0", "train_1"])


def held_out(column: str = "doc_id") -> F.Column:
    """Whether a document is not learned from: crc32 of its id as text is 1 modulo 5 (false for a null id)."""
    return F.coalesce(F.expr(f"crc32(CAST({column} AS STRING)) % 5 = 1"), F.lit(False))


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The stored table of texts with the counts of their grams, cells of held-out counts and totals."""
    if not 1 <= order <= 4:
        raise ValueError("the order must be between 1 and 4")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(max(1, size // CHUNK, min(48, size >> 20)))
    bucket_bits = max(0, int(size // 6 // GRAMS).bit_length())
    bits = min(64, 22 + int(size // 6 + 1).bit_length())
    # Training documents are halved by another digit of the same hash.
    half = F.when(held_out(), 2).otherwise(F.coalesce(F.expr("CAST(crc32(CAST(doc_id AS STRING)) div 5 % 2 AS INT)"), F.lit(0)))
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.lit(chunks)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"), half.alias("half"), chunk.alias("chunk"))

    def pack(batches):
        for batch in batches:
            packs = [(int(k), packed_texts(part)) for k, part in batch.groupby("chunk")]
            yield pd.DataFrame(packs, columns=["chunk", "texts"])

    dealt = rows.mapInPandas(pack, "chunk int, texts binary").repartition(chunks, "chunk")

    def ask(texts: pd.DataFrame) -> pd.DataFrame:
        held, chunk = Chunk(texts, min(order, 2), bits, bucket_bits), int(texts["chunk"].iloc[0])
        rows = [row for kind in range(min(order, 2)) for row in held.part(kind).asked(chunk, kind)]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "kind", "keys", "counts"])

    def longer(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _longer(texts, answers, order, bits, bucket_bits)

    def annotate(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _annotated(texts, answers, order, bits, bucket_bits)

    def answered(asked: DataFrame) -> DataFrame:
        return asked.repartition(1 << bucket_bits, "bucket").groupBy("bucket", "kind").applyInPandas(_answered, ANSWERED).repartition(chunks, "chunk")

    answers = answered(dealt.groupBy("chunk").applyInPandas(ask, ASKED))
    if order > 2:
        again = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(longer, ASKED)
        answers = answers.unionByName(answered(again))
    both = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return materialize(both.applyInPandas(
        annotate, "ids array<long>, sizes array<long>, words binary, counts binary, cells binary, times binary, n_cells long, known long, train_0 long, train_1 long"))


class Mixture:
    """Totals of the training tokens and the weights of each order by bucket of its context."""

    def __init__(self, order: int, known: int, train: tuple[int, int], rounds: int = ROUNDS):
        self.order, self.known, self.train = order, known, train
        self.total = sum(train)
        self.rounds = rounds
        self.weights = np.full((order + 1, BUCKETS), 0.5)
        self.weights[2:, 0] = 0.0
        if not self.total:
            self.weights[1] = 0.0

    def learned(self, cells: DataFrame) -> Mixture:
        """Expectation-maximisation over ``cells(cell, times)``."""
        columns = {}
        unit = LEVELS * BUCKETS
        for k in range(self.order, 1, -1):
            below = unit ** (self.order - k)
            code = F.expr(f"cell div {below} % {LEVELS}")
            columns[f"f{k}"] = F.when(code > 0, F.pow(F.lit(2.0), (1 - code) / STEPS)).otherwise(0.0)
            columns[f"b{k}"] = F.expr(f"CAST(cell div {below * LEVELS} % {BUCKETS} AS INT)")
        below = unit ** (self.order - 1)
        code, half = F.expr(f"cell div {below} % {LEVELS}"), F.expr(f"cell div {below * LEVELS}")
        other = F.when(half == 0, float(max(1, self.train[1]))).otherwise(float(max(1, self.train[0])))
        columns["f1"] = F.when(code > 0, F.pow(F.lit(2.0), (code - 1) / STEPS) / other).otherwise(0.0)
        columns["b1"] = F.lit(1)
        cells = materialize(cells.select("times", *(c.alias(n) for n, c in columns.items())))
        buckets = [f"b{k}" for k in range(1, self.order + 1)]
        for _ in range(self.rounds):
            p = F.lit(1.0 / (self.known + 1))
            mixed_, own = [p], [p]
            for k in range(1, self.order + 1):
                weight = F.element_at(F.array(*(F.lit(float(w)) for w in self.weights[k])), F.col(f"b{k}") + 1)
                own.append(weight * F.col(f"f{k}"))
                p = own[k] + (1 - weight) * p
                mixed_.append(p)
            # A token reaches order k with what the higher orders left, and stays there by the share of its own part.
            reach, sums = F.lit(1.0), []
            for k in range(self.order, 0, -1):
                here = own[k] / mixed_[k]
                sums += [F.sum(F.col("times") * reach).alias(f"r{k}"), F.sum(F.col("times") * reach * here).alias(f"s{k}")]
                reach = reach * (1 - here)
            found = cells.groupBy(*buckets).agg(*sums).collect()  # a row per combination of buckets
            new = np.zeros((2, self.order + 1, BUCKETS))
            for row in found:
                for k in range(1, self.order + 1):
                    new[0, k, row[f"b{k}"]] += row[f"r{k}"]
                    new[1, k, row[f"b{k}"]] += row[f"s{k}"]
            for k in range(1, self.order + 1):
                seen = np.flatnonzero(new[0, k] > 0)
                seen = seen[seen > 0] if k > 1 else seen
                if not len(seen) or not self.total:
                    continue
                # Half a token on either side keeps the weights inside (0, 1); empty buckets take the nearest one's.
                learned = (new[1, k, seen] + 0.5) / (new[0, k, seen] + 1.0)
                near = np.abs(np.arange(BUCKETS)[:, None] - seen[None, :]).argmin(axis=1)
                self.weights[k] = learned[near]
                if k > 1:
                    self.weights[k, 0] = 0.0
        return self

    def log10(self, counts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token from its counts of each order."""
        p = np.full(len(counts[0]), 1.0 / (self.known + 1))
        if self.total:
            m = self.weights[1, 1]
            p = m * counts[0] / self.total + (1 - m) * p
        for k, (context, count) in enumerate(zip(_contexts(counts, sizes), counts[1:], strict=True), 2):
            m = self.weights[k][digits(context)]
            p = m * count / np.maximum(context, 1) + (1 - m) * p
        return np.log10(p)


def model(stored: DataFrame, order: int = ORDER, rounds: int = ROUNDS) -> Mixture:
    """Learn the mixture weights from the cells of a table of ``counted``."""
    totals = stored.agg(F.sum("known"), F.sum("train_0"), F.sum("train_1")).first()

    def spread(batches):
        for batch in batches:
            rows = []
            for cells, times, n in zip(batch["cells"], batch["times"], batch["n_cells"], strict=True):
                codes, counts = unpacked_codes(cells, int(n)), unpacked_counts(times, int(n), 1)[0]
                part = (mixed((codes >> FAMILY).astype(np.uint64)) % np.uint64(SPREAD)).astype(np.int64)
                for k in np.unique(part).tolist():
                    some = part == k
                    rows.append((k, packed_codes(codes[some]), packed_counts(counts[some]), int(some.sum())))
            yield pd.DataFrame(rows, columns=["part", "cells", "times", "n_cells"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate([unpacked_codes(c, int(n)) for c, n in zip(rows["cells"], rows["n_cells"], strict=True)])
        counts = np.concatenate([unpacked_counts(t, int(n), 1)[0] for t, n in zip(rows["times"], rows["n_cells"], strict=True)])
        cells, at, cut = _distinct(codes)
        return pd.DataFrame({"cell": cells, "times": _counted(counts, at, cut)})

    # Packed like the grams: as rows, the cells of all chunks would be the largest exchange.
    packed = stored.where("n_cells > 0").select("cells", "times", "n_cells").mapInPandas(spread, "part int, cells binary, times binary, n_cells long")
    cells = packed.groupBy("part").applyInPandas(merge, "cell long, times long")
    return Mixture(order, totals[0] or 0, (totals[1] or 0, totals[2] or 0), rounds).learned(cells)


def scored(docs: DataFrame, order: int = ORDER, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Tokens are words between the six ASCII white-space characters with A to Z lower-cased, then one end. Documents
    whose crc32 of the id as text is 1 modulo 5 are held out; all others are learned from, those without an id and
    repeated rows too. ``base_score``: sum of log10((c + 0.5) / (N + 0.5 * (V + 1))); ``score``: the mixture's log10
    probability of the text. A null text is empty: its end token only. Without training documents both scores are 0.
    An empty table gives an empty one; only doc_id and text are read. A text is held whole by one task.
    """
    stored = counted(docs, order)
    shared = docs.sparkSession.sparkContext.broadcast(model(stored, order, rounds))

    def run(batches):
        mixture = shared.value
        n, v = mixture.total, mixture.known
        for batch in batches:
            for ids, sizes, words, raw in zip(batch["ids"], batch["sizes"], batch["words"], batch["counts"], strict=True):
                sizes = np.array(sizes, np.int64)
                if not len(sizes):
                    continue
                starts = np.cumsum(sizes) - sizes
                total = int(sizes.sum())
                counts = [unpacked_ranks(words, total), *(unpacked_counts(raw, total, mixture.order - 1) if raw else [])]
                base = np.log10((counts[0] + 0.5) / (n + 0.5 * (v + 1)))
                yield pd.DataFrame({
                    "doc_id": pd.array(list(ids), "Int64"), "n_tokens": sizes, "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), starts),
                    "train_tokens": n, "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(mixture.log10(counts, sizes), starts),
                })

    rows = stored.select("ids", "sizes", "words", "counts").mapInPandas(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
