"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt by a hash into groups of
about ``GROUP_PIECES``; groups are independent, so each packs in its own task and a group wastes less
than one sequence beyond the fill that its lengths allow. A full piece is a sequence of its own.
"""
from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.llm.common import slices, text_of
from cellwire.operators.session import materialize

# Pieces packed together in one task; the number of groups follows the table.
GROUP_PIECES = 20_000
# Passes of the local search over the bins of a group.
PASSES = 4
CACHE_WORDS = 300_000
# Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class WordTokenizer:
    """Token ids of whole texts with the words' ids kept between texts.

    The byte-level pattern always starts a new word at a single space between two characters that are
    no white space, so such stretches are encoded once each. Texts that hold a special token or other
    white space next to a space are cut only at those safe places.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The same vocabulary as merge ranks: it encodes long runs of ordinary words several times faster.
        import tiktoken

        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}
        self.ranked = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(t) for t in ranks]
        self.whole: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        """Whether the text may be cut at every space: spaces are single and touch no other white space."""
        return (
            "  " not in text and " \n" not in text and "\n " not in text and text.strip() == text != ""
            and text.replace("\n", "").isprintable() and not any(s in text for s in self.special)
        )

    def stretches(self, text: str) -> list[str]:
        """Parts of the text whose encodings join to the encoding of the text; the last parts start with a space."""
        if any(s in text for s in self.special):
            return [text]
        parts = text.split(" ")
        out, start = [parts[0]], parts[0]
        joins = not start or start[-1].isspace()
        for part in parts[1:]:
            if joins or not part or part[0].isspace():
                out[-1] += " " + part
            else:
                out.append(" " + part)
            joins = not part or part[-1].isspace()
        return [p for p in out if p]

    def _add_spaced(self, words: list[str]) -> None:
        """Encode many words, each after a space, as one text and cut its ids where the bytes of a word end."""
        for start, stop in slices(words, 1 << 17):
            some = words[start:stop]
            ids = np.array(self.ranked.encode_ordinary(" " + " ".join(some)), "<u4")
            ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in some), np.int64, len(some)))
            cuts = (4 * (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1)).tolist()
            raw, at = ids.tobytes(), 0
            for word, cut in zip(some, cuts, strict=True):
                self.spaced[word] = raw[at:cut]
                at = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for start, stop in slices(texts):
            firsts, rests = [], []
            for text in texts[start:stop]:
                if self.plain(text):
                    parts = text.split(" ")
                    firsts.append(parts[:1])
                    rests.append(parts[1:])
                else:
                    firsts.append(self.stretches(text))
                    rests.append([])
            if len(self.spaced) + len(self.whole) > CACHE_WORDS:
                self.spaced, self.whole = {}, {}
            self._add_spaced(list(set().union(*rests).difference(self.spaced)))
            for word in set().union(*firsts).difference(self.whole):
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
                self.whole[word] = np.array(ids, "<u4").tobytes()
            whole, spaced = self.whole.__getitem__, self.spaced.__getitem__
            out += [b"".join([*map(whole, f), *map(spaced, r)]) for f, r in zip(firsts, rests, strict=True)]
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut to ``capacity``.

    Only documents above ``capacity`` are cut; their first piece is the shorter one. A null text is
    empty (one piece of one token). Repeated rows and null ids give their pieces again; ``row`` is the
    position of the document in its batch and tells such rows apart only for ordering.
    """

    def run(batches):
        tokenizer = tokenizer_of(path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = text_of(batch["text"])
            ids = batch["id"].tolist()
            rows = []
            for start, stop in slices(texts):
                for k, raw in enumerate(tokenizer.encode(texts[start:stop]), start):
                    raw += tail
                    n = len(raw) // 4
                    at = 0
                    for piece in range(-(-n // capacity)):
                        size = (n % capacity or capacity) if piece == 0 else capacity
                        rows.append((k, ids[k], piece, at, size, zlib.crc32(raw[4 * at:4 * (at + size)])))
                        at += size
            out = pd.DataFrame(rows, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    read = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return read.mapInPandas(run, "row int, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers by best fit, longest first. A bit mask of the free spaces finds the tightest bin."""
    by_space: dict[int, list[list[int]]] = defaultdict(list)
    spaces = 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[k]
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            bin_ = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            space, bin_ = capacity, []
        bin_.append(k)
        space -= size
        by_space[space].append(bin_)
        spaces |= 1 << space
    return [b for bins in by_space.values() for b in bins]


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, passes: int = PASSES) -> list[list[int]]:
    """Move, exchange one for one or two for one between underfull bins while the sum of squared fills grows.

    A pass lets each bin give, the emptiest first; passes go on while they empty bins, ``passes`` at most. A step shifts tokens from bin A to a bin B that is at least as full:
    a piece moves into B's space, a piece of A swaps with a smaller one of B, or two pieces of A swap
    with a smaller one of B. Each raises fill(A)^2 + fill(B)^2; bins that run empty go. It stops early at the least number of bins that the total allows.
    """
    least = -(-sum(lengths) // capacity)
    full = [b for b in bins if sum(lengths[k] for k in b) == capacity]
    open_ = [b for b in bins if sum(lengths[k] for k in b) < capacity]
    fill = [sum(lengths[k] for k in b) for b in open_]

    # Open bins by free space, and per space how many pieces of each length they hold.
    by_space: dict[int, set[int]] = defaultdict(set)
    held: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))

    def put(b: int, sign: int) -> None:
        space = capacity - fill[b]
        (by_space[space].add if sign > 0 else by_space[space].discard)(b)
        for k in open_[b]:
            held[space][lengths[k]] += sign
            if not held[space][lengths[k]]:
                del held[space][lengths[k]]
        if not by_space[space]:
            del by_space[space]
            held.pop(space, None)

    for b in range(len(open_)):
        put(b, 1)

    def take(b: int, size: int) -> int:
        k = next(k for k in open_[b] if lengths[k] == size)
        open_[b].remove(k)
        fill[b] -= size
        return k

    def step(a: int) -> bool:
        sizes = sorted({lengths[k] for k in open_[a]}, reverse=True)
        count: dict[int, int] = defaultdict(int)
        for k in open_[a]:
            count[lengths[k]] += 1
        pairs = sorted({(x, y) for i, x in enumerate(sizes) for y in sizes[i:] if x != y or count[x] > 1}, key=lambda p: -sum(p))
        for space in sorted(by_space):
            # B must end above both old fills: then the sum of squares grows.
            if space > capacity - fill[a]:
                break
            others = by_space[space] - {a}
            if not others:
                continue
            for given in [(x,) for x in sizes] + pairs:
                total = sum(given)
                if len(given) == 1 and total <= space:
                    exchange(a, next(iter(others)), given, None)
                    return True
                low = total - space
                for back in held[space]:
                    if low <= back < total:
                        b = next((b for b in others if any(lengths[k] == back for k in open_[b])), None)
                        if b is not None:
                            exchange(a, b, given, back)
                            return True
        return False

    def exchange(a: int, b: int, given: tuple, back: int | None) -> None:
        put(a, -1)
        put(b, -1)
        moved = [take(a, size) for size in given]
        if back is not None:
            k = take(b, back)
            open_[a].append(k)
            fill[a] += back
        for k in moved:
            open_[b].append(k)
            fill[b] += lengths[k]
        if open_[a]:
            put(a, 1)
        put(b, 1)

    alive = len(full) + len(open_)
    for _ in range(passes):
        before = alive
        for a in sorted(range(len(open_)), key=lambda b: fill[b]):
            while alive > least and open_[a] and fill[a] < capacity and step(a):
                alive -= not open_[a]
        if alive in (least, before):
            break
    return full + [b for b in open_ if b]


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces; pieces of a sequence lie gapless from 0.

    ``pieces`` is read twice (counted, then packed) and should be a stored table. Ties of length go by
    document and piece; equal rows are interchangeable. An empty table stays empty. Other columns of
    ``pieces`` are kept.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    names = pieces.columns
    own = [n for n in names if n not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{n}` {pieces.schema[n].dataType.simpleString()}" for n in own) + ", sequence_id long, offset long"

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = batch["length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence = np.zeros(len(lengths), np.int64)
        offset = np.zeros(len(lengths), np.int64)
        for number, members in enumerate(bins):
            at = 0
            for k in members:
                sequence[k], offset[k] = number, at
                at += lengths[k]
        batch["sequence_id"] = sequence + (int(key[0]) << 32)
        batch["offset"] = offset
        return batch[[*own, "sequence_id", "offset"]]

    dealt = pieces.select(*own, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("_group"))
    return dealt.groupBy("_group").applyInPandas(run, schema)


def packed_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Tokenise, cut and pack: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = materialize(token_pieces(docs, path, capacity).drop("row"))
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
