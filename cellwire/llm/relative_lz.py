"""Substring dedup of words by relative Lempel-Ziv parsing against indexed reference blocks.

The words at repeated triggers (``repeats``) are dealt into blocks by trigger hash; a block's distinct
phrases, each with its smallest document, are its reference, and the block indexes every place where a
factor of 50 words can start. Each document's phrases are factored greedily against the block: a
factor starts where the index holds the next 50 words in a smaller document, grows word by word, and
where it must move on to another place of the reference, the window across the border is looked up
itself, so no window is lost between factors. Shorter factors cannot remove words and are not built.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.llm.repeats import WINDOW, gram_hashes, mixed, repeats

GRAM = 25
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KNOWN: dict[str, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    """Weights of the first ``n`` bytes of a word."""
    if len(_KNOWN.get("powers", ())) < n:
        out = np.full(max(1024, 2 * n), 0x100000001B3, np.uint64)
        out[0] = 1
        _KNOWN["powers"] = np.multiply.accumulate(out)
    return _KNOWN["powers"]


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of the text."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def _words(raw) -> np.ndarray:
    """A 64-bit hash of each word, from polynomial sums over its bytes."""
    starts, ends = word_bounds(raw or b"")
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = mixed(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1))
    # Every byte is weighted by its place in the word, so equal words have equal sums anywhere.
    lengths = ends - starts
    place = np.arange(len(values)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(values)]))
    longest = int(lengths.max())
    values *= _powers(longest)[np.minimum(place, longest - 1)]
    values[_SPACE[np.frombuffer(raw, np.uint8)]] = 0
    sums = np.add.reduceat(values, starts)
    return mixed(sums ^ lengths.astype(np.uint64))


def factors(windows: np.ndarray, owner: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of phrases against the block they form: (first window, number of windows, place in the reference).

    ``windows`` are the hashes of the phrases' windows in order, ``owner`` their documents and ``phrase``
    the phrase of each. The reference place of a window is its occurrence in the smallest document. A
    factor of 50 words grows by one word as long as the next window stands next in the reference too;
    at its border the window across it starts the next factor by its own lookup.
    """
    order = np.lexsort((np.arange(len(windows)), owner, windows))
    new = np.r_[True, windows[order][1:] != windows[order][:-1]]
    index, first = windows[order][new], order[new]
    place = first[np.searchsorted(index, windows)]
    border = np.r_[True, (place[1:] != place[:-1] + 1) | (phrase[1:] != phrase[:-1]) | (phrase[place[1:]] != phrase[place[:-1]])]
    start = np.flatnonzero(border)
    return start, np.diff(np.r_[start, len(windows)]), place[start]


def _resolve(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each window of the phrases: that of the reference phrase its factor was copied from."""
    whole = gram_hashes(flat, WINDOW)
    ends = np.cumsum(counts)
    at = np.repeat(starts - ends + counts, counts)
    at += np.arange(len(at))
    phrase = np.repeat(np.arange(len(counts)), counts)
    owner = ids[phrase]
    start, length, place = factors(whole[at], owner, phrase)
    return np.repeat(owner[place], length)


def _digest(batch: pd.DataFrame, symbols: list, removed: list) -> pd.DataFrame:
    rows = []
    for raw, r in zip(batch["raw"], removed, strict=False):
        words = _WORD.findall(raw or b"")
        kept = [w for w, gone in zip(words, r.tolist(), strict=True) if not gone] if r.any() else words
        rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
    out.insert(0, "doc_id", batch["doc_id"].to_numpy())
    return out


def removed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): words are runs of bytes other than space and tab to carriage return.

    A word goes if a window of 50 consecutive words that covers it also starts in a document of smaller
    doc_id, judged on the input. A null text has no words; a null doc_id counts as the largest; rows
    that share a doc_id don't remove from each other; an empty table gives an empty one; other columns
    are not read.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return repeats(
        read, _words, lambda s: s, _resolve, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", np.uint64, GRAM,
    )
