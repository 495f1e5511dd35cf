"""SentencePiece encoding and decoding by vectorised merge rounds.

Texts are cut before every run of word marks (no piece of such a model holds a mark after another
character, which the constructor checks), so words merge independently. All new words of a slice
are merged together on flat numpy arrays: one symbol array, one rank array for each symbol with its
right neighbour, and word starts. A round takes the smallest rank of each word by a segmented
minimum, merges the leftmost non-overlapping pairs of that rank in all words at once, and compacts
the arrays; words without a pair leave.
"""
from __future__ import annotations

import codecs
import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.llm.common import slices, text_of

MARK = "▁"
NONE = np.iinfo(np.int32).max
# Words kept between batches of one Python worker; beyond it the memory is emptied, results don't change.
CACHE_WORDS = 300_000


class _Spelling:
    """Byte strings by id, laid out flat, so many ids are spelled with a few array operations."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - ends + lengths, lengths)
        shift += np.arange(len(shift))
        return self.flat[shift].tobytes()


def _each_byte(error):
    return "�", error.start + 1


codecs.register_error("cellwire-each-byte", _each_byte)


class PieceModel:
    """Merge tables of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any(MARK in names[i].lstrip(MARK) for i in plain):
            raise ValueError("pieces with a word mark inside are not supported")
        self.end = model.eos_id()
        self.unknown = model.unk_id()
        self.size = size
        self.byte_id = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.bytes = set(self.byte_id.values())
        self.surface = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                self.surface[i] = bytes([int(names[i][3:5], 16)])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.surface[i] = names[i].replace(MARK, " ").encode()
        self.spoken = _Spelling(self.surface)
        self.decimal = _Spelling([f"{i} ".encode() for i in range(size)])
        # Symbols: the pieces, then single characters as size + code point.
        symbol = {names[i]: i for i in plain}
        self.of_char = np.arange(0x110000, dtype=np.int64) + size
        for i in plain:
            if len(names[i]) == 1:
                self.of_char[ord(names[i])] = i
        scores = np.array([model.get_score(i) for i in plain])
        order = np.unique(-scores, return_inverse=True)[1]  # equal scores share a rank
        rank_of = dict(zip(plain, order.tolist(), strict=True))
        self.span = size + 0x110000
        keys, ranks, results = [], [], []
        lone = np.zeros(size, bool)
        for i in plain:
            name = names[i]
            for cut in range(1, len(name)):
                pair = []
                for part in (name[:cut], name[cut:]):
                    part_id = symbol.get(part, size + ord(part) if len(part) == 1 else None)
                    pair.append(part_id)
                if None in pair:
                    continue
                keys.append(pair[0] * self.span + pair[1])
                ranks.append(rank_of[i])
                results.append(i)
                # A piece whose merge opens a pair of no larger rank must be merged one at a time.
                for part_id in pair:
                    if part_id < size and rank_of[i] <= rank_of[part_id]:
                        lone[part_id] = True
        at = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[at]
        self.ranks = np.array(ranks, np.int32)[at]
        self.results = np.array(results, np.int64)[at]
        self.lone = lone
        self.cache: dict[str, bytes] = {}
        self.end_bytes = np.int32(self.end).tobytes()

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE).astype(np.int32), np.where(hit, self.results[at], 0)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as 32-bit integers; words are not empty."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols = self.of_char[codes]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        n = len(symbols)
        ranks = np.full(n, NONE, np.int32)
        merged = np.zeros(n, np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        ranks[inside], merged[inside] = self._look_up(symbols[inside], symbols[inside + 1])
        done_symbols, done_words = [], []
        while n:
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, n])
            best = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            over = best == NONE
            if over.any():  # words without a pair leave
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                keep = ~over
                symbols, word, ranks, merged, best = symbols[keep], word[keep], ranks[keep], merged[keep], best[keep]
                n = len(symbols)
                if not n:
                    break
            at = np.flatnonzero(ranks == best)
            # Neighbouring pairs of one rank overlap (they are equal symbols): take every second, from the left.
            first = np.r_[True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])]
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            alone = self.lone[merged[at]]
            if alone.any():
                again = np.r_[False, word[at[1:]] == word[at[:-1]]]
                at = at[~(alone & again)]
            symbols[at] = merged[at]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            # Only the merged symbols and those before them have a new right neighbour or are one.
            touched = np.zeros(n, bool)
            touched[at] = True
            touched = touched[keep]
            touched[:-1] |= touched[1:]
            symbols, word, ranks, merged = symbols[keep], word[keep], ranks[keep], merged[keep]
            n = len(symbols)
            new = np.flatnonzero(touched)
            ranks[new] = NONE
            pair = new[new + 1 < n]
            pair = pair[word[pair] == word[pair + 1]]
            ranks[pair], merged[pair] = self._look_up(symbols[pair], symbols[pair + 1])
        symbols = np.concatenate(done_symbols)
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        symbols = symbols[order]
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        odd = set(word[order][symbols >= self.size].tolist())
        ids, start, out = symbols.astype(np.int32).tobytes(), 0, []
        for end in ends:
            out.append(ids[4 * start:4 * end])
            start = end
        for k in odd:  # characters without a piece become their bytes
            whole = [
                j for i in np.frombuffer(out[k], np.int32).tolist()
                for j in ([i] if i < self.size else [self.byte_id[b] for b in chr(i - self.size).encode()])
            ]
            out[k] = np.array(whole, np.int32).tobytes()
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        """Pieces of the marked text, each a run of marks and what follows it."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked:
            return re.findall(f"{MARK}+[^{MARK}]*", marked)
        return [MARK + w for w in marked[1:].split(MARK)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of each text, the end id last."""
        out: list[np.ndarray] = []
        for start, stop in slices(texts):
            cut = [self.words(t) for t in texts[start:stop]]
            new = list(set(chain.from_iterable(cut)).difference(self.cache))
            if len(self.cache) + len(new) > CACHE_WORDS:
                self.cache = {}
                new = list(set(chain.from_iterable(cut)))
            if new:
                self.cache.update(zip(new, self.merge(new), strict=True))
            known = self.cache.__getitem__
            out += [np.frombuffer(b"".join(map(known, words)) + self.end_bytes, np.int32) for words in cut]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: control ids vanish, each invalid byte becomes U+FFFD, the first mark goes."""
        ids = np.asarray(ids, np.int32)
        ids = ids[self.spoken.lengths[ids] > 0]
        if not len(ids):
            return ""
        raw = self.spoken(ids).decode("utf-8", "cellwire-each-byte")
        first = self.surface[ids[0]]
        return raw[1:] if first[:1] == b" " and ids[0] != self.unknown and ids[0] not in self.bytes else raw


_MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """One model per Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>): all ids of each text, the end id last.

    A null text is the empty text (the end id only); null ids and repeated rows stay as they are; other
    columns are not read. ``path`` must exist on every executor.
    """

    def run(batches):
        model = model_of(path)
        for batch in batches:
            texts = text_of(batch["text"])
            for start, stop in slices(texts, 1 << 22):
                yield pd.DataFrame({"id": batch["id"].iloc[start:stop], "ids": model.encode(texts[start:stop])})

    kind = docs.schema[id_column].dataType.simpleString()
    read = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return read.mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode_ids(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text): the decoded texts; null ids give the empty text."""

    def run(batches):
        model = model_of(path)
        for batch in batches:
            yield pd.DataFrame({
                "id": batch["id"],
                "text": [model.decode([] if i is None else i) for i in batch["ids"]],
            })

    kind = encoded.schema[id_column].dataType.simpleString()
    read = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    return read.mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; (doc_id, n_tokens, ids_sha256, decoded_sha256).

    The ids of a text stay in the Python worker; only the digests return. Nulls, empty texts and
    repeated rows as in ``encode_texts``.
    """

    def run(batches):
        model = model_of(path)
        for batch in batches:
            texts = text_of(batch["text"])
            counts, of_ids, of_text = [], [], []
            for start, stop in slices(texts):
                for ids in model.encode(texts[start:stop]):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(model.decimal(ids)[:-1]).hexdigest())
                    of_text.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_text})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
