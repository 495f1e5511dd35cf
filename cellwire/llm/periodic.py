"""Periodic runs: stretches of words that repeat with a period, found through multi-scale minimizers.

A run of period q is a stretch of at least ``max(24, 3 * q)`` words in which words q apart are equal, q is
the smallest such period, and no neighbouring word extends it.

Periods up to ``SHORT`` are scanned lag by lag. Above, every scale k stands for the periods in (previous k, k].
Its grams have k words, so inside a run of such a period the next equal gram is exactly one period away (a
nearer one would give the run a smaller period). The grams that are smallest in some window of
``2 * (previous k + 1) - k + 1`` grams are the scale's minimizers; such a window and the one a period further
both fit into any run of the scale, so every run holds two equal neighbouring minimizers at its period. These
pairs are the seeds: they are extended to both sides word by word, so hashes decide nothing but where to look.
A seed implies a stretch of two periods, so there are few that are no run.

Texts go through in slices; documents of a slice lie in one array with a different separator each, and those too
short for a scale leave it. Work follows the number of words times the logarithm of the longest text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.llm.common import slices, text_of
from cellwire.llm.repeats import joined, mixed, smallest

LEAST_WORDS = 24
LEAST_PERIODS = 3
SHORT = 8
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edge = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def _matching(flat: np.ndarray, lag: int, at: int, step: int) -> int:
    """How many positions from ``at`` on, going by ``step`` (1 or -1), hold the word that stands ``lag`` later."""
    count, size = 0, 64
    while True:
        if step > 0:
            low, high = at + count, min(at + count + size, len(flat) - lag)
        else:
            low, high = max(at - count - size + 1, 0), at - count + 1
        if high <= low:
            return count
        differs = flat[low:high] != flat[low + lag:high + lag]
        hit = np.flatnonzero(differs)
        if len(hit):
            return count + int(hit[0] if step > 0 else high - low - 1 - hit[-1])
        count += high - low
        size = min(size * 2, 1 << 20)


def _smallest_period(flat: np.ndarray, start: int, period: int) -> bool:
    """Whether the run of ``period`` from ``start`` has no smaller one; that would divide it, the run being three long."""
    rest, prime = period, 2
    factors = set()
    while prime * prime <= rest:
        while rest % prime == 0:
            factors.add(prime)
            rest //= prime
        prime += 1
    if rest > 1:
        factors.add(rest)
    return not any(
        np.array_equal(flat[start:start + period], flat[start + d:start + d + period]) for d in (period // f for f in factors)
    )


def _seeds(flat: np.ndarray, level: np.ndarray, length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, position) of equal neighbouring minimizers of ``high`` words at a lag in [low, high], in that order.

    ``level``: hashes of ``length`` words from each position, length <= high < 2 * length.
    """
    n = len(flat) - high + 1
    grams = level[:n] if length == high else joined(level[:n], level[high - length:high - length + n])
    width = 2 * low - high + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    none = np.zeros(width - 1, np.uint64)
    least = np.concatenate([none, smallest(grams, width), none])
    chosen = np.flatnonzero(~smallest(~least, width) == grams)
    value = grams[chosen]
    order = np.argsort(value, kind="stable")
    value, chosen = value[order], chosen[order]
    lag = np.diff(chosen)
    good = (value[1:] == value[:-1]) & (lag >= low) & (lag <= high)
    lag, at = lag[good], chosen[:-1][good]
    order = np.lexsort((at, lag))
    return lag[order], at[order]


def runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start, then period. Texts are arrays of word numbers >= 0."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    some = [k for k, t in enumerate(texts) if len(t) >= LEAST_WORDS]
    lengths = np.array([len(texts[k]) for k in some], np.int64)
    if not some:
        return found

    def flattened(some: list[int]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([part for k in some for part in (texts[k], [-1 - k])]).astype(np.int64)
        size = np.array([len(texts[k]) + 1 for k in some], np.int64)
        return flat, np.cumsum(size) - size

    def add(some, starts, begin: int, length: int, period: int) -> None:
        k = int(np.searchsorted(starts, begin, "right")) - 1
        found[some[k]].append((begin - int(starts[k]), length, period))

    flat, starts = flattened(some)
    for lag in range(1, SHORT + 1):
        begin, end = _stretches(flat[lag:] == flat[:-lag])
        long = end - begin + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag)
        for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            if _smallest_period(flat, b, lag):
                add(some, starts, b, e - b + lag, lag)
    low = SHORT + 1
    level, length = mixed(flat.astype(np.uint64) + np.uint64(1)), 1
    while True:
        stay = lengths >= max(LEAST_WORDS, LEAST_PERIODS * low)
        if not stay.any():
            break
        if 2 * lengths[stay].sum() < lengths.sum():
            some = [k for k, s in zip(some, stay, strict=True) if s]
            lengths = lengths[stay]
            flat, starts = flattened(some)
            level, length = mixed(flat.astype(np.uint64) + np.uint64(1)), 1
        high = max(low, 3 * (low - 1) // 2)
        while 2 * length <= high and len(level) > length:
            level, length = joined(level[:-length], level[length:]), 2 * length
        lags, ats = _seeds(flat, level, length, low, high)
        k = 0
        while k < len(lags):
            lag, at = int(lags[k]), int(ats[k])
            back = _matching(flat, lag, at - 1, -1)
            ahead = _matching(flat, lag, at, 1)
            if back + ahead + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag) and _smallest_period(flat, at - back, lag):
                add(some, starts, at - back, back + ahead + lag, lag)
            # The other seeds of this stretch.
            stop = int(np.searchsorted(lags, lag, "right"))
            k += max(1, int(np.searchsorted(ats[k:stop], at + max(ahead, 1))))
        low = high + 1
    for each in found:
        each.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that are left when every run keeps its first period only, joined by one space."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in found:
        gone[start + period:start + length] = True
    return b" ".join([words[k] for k in np.flatnonzero(~gone)])


def _rows(texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    for start, stop in slices(texts):
        # bytes.split cuts at the six ASCII white-space characters and nothing else.
        cut = [t.encode("utf-8", "surrogatepass").split() for t in texts[start:stop]]
        numbers: dict[bytes, int] = {}
        ids = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in cut]
        for words, found in zip(cut, runs(ids), strict=True):
            yield len(words), found, collapsed(words, found).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``.

    Words are what stands between the characters space, tab, line feed, vertical tab, form feed and carriage
    return, numbered from 0. ``runs``: (start, length, period) of every run by start, then period; runs may
    overlap. ``collapsed``: the words without those that any run holds after its first period, joined by one
    space. A null text is empty: no words, no runs, collapsed ''. Rows are worked on one by one: repeated rows
    and null ids give rows of their own, an empty table an empty one, and only doc_id and text are read.
    A text is held whole by one task, at some 100 bytes a word.
    """

    def run(batches):
        for batch in batches:
            rows = list(_rows(text_of(batch["text"])))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_words": [r[0] for r in rows],
                "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r[1]] for r in rows],
                "collapsed": [r[2] for r in rows],
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), with a periodic tail in each document whose id has a crc32 divisible by 10.

    With g = floor(crc32 / 10) and n words, word i from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). Texts without words and rows without an id stay as they are.
    """
    words = r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
    chosen = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", "crc32(CAST(doc_id AS STRING)) AS h")
    cut = chosen.withColumn("w", F.expr(f"CASE WHEN h % 10 = 0 THEN {words} END"))
    placed = cut.withColumn("n", F.expr("size(w)")).withColumn("g", F.expr("h div 10"))
    placed = placed.withColumn("a", F.expr("CASE WHEN n > 0 THEN CAST(g % n AS INT) END"))
    placed = placed.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    tail = "concat(slice(w, 1, a), transform(sequence(a, n - 1), i -> w[CAST(a + (i - a) % p AS INT)]))"
    return placed.select("doc_id", F.expr(f"CASE WHEN a IS NULL THEN text ELSE concat_ws(' ', {tail}) END").alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run of largest exponent and digests, from the rows of ``periodic_runs``.

    The largest exact length / period wins; ties go to the smallest start, then period. Without a run the four
    columns of that run are null.
    """
    better = "x.length * acc.period > acc.length * x.period"  # runs come by start, then period, so ties keep the first
    best = found.withColumn("best", F.expr(f"reduce(runs, get(runs, 0), (acc, x) -> CASE WHEN {better} THEN x ELSE acc END)"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.expr(r"sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
