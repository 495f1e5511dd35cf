"""How far the sources of a language diverge in their terms, by row accumulation after Gustavson.

Terms are counted per (lang, source); a language keeps those in enough of its documents. Every group gives every
kept term a scaled share p, and two groups diverge by the sum of ``floor((p - q)^2 / q)`` over the kept terms, exact
in integers. Most counts are zero, so the sum is split: a baseline that takes the zero shares p0 and q0 for absent
terms comes from each group's histogram of shares, and only terms of both groups need a correction,
``f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)``. A group's row scatters its terms through the term-major index into one
dense accumulator over its peers; no pair of postings is written anywhere.

Sources are dealt into blocks and terms into buckets. One task holds the postings of two blocks in one bucket and
returns one row per pair of sources; buckets are added up. The pairs of sources of a language are the result itself.
"""
from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwire.llm.common import text_of
from cellwire.operators.session import materialize

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
BLOCK = 256  # sources of a block
POSTINGS = 1 << 19  # of a task, about
HELD = 400_000  # counted terms that a task holds before it hands them on
FLAT = 1 << 20  # postings that are scattered at once

# Term bytes are letters and everything beyond ASCII; the rest separates. Only A to Z are lower-cased.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; nulls are ''.

    Each row of ``docs`` is a document. Counts are added up in the task first, then in one exchange, so a frequent
    term or a source with a third of all rows is one row per task.
    """

    def flush(held):
        rows = [(lang, source, term.decode("utf-8", "surrogatepass"), n, among[term])
                for (lang, source), (all_, among) in held.items() for term, n in all_.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"])

    def run(batches):
        held = defaultdict(lambda: (Counter(), Counter()))
        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], text_of(batch["text"]), strict=True):
                terms = text.encode("utf-8", "surrogatepass").translate(_TERMS).split()
                if terms:
                    all_, among = held[lang, source]
                    all_.update(terms)
                    among.update(set(terms))
            if sum(len(c[0]) for c in held.values()) > HELD:
                yield flush(held)
        if held:
            yield flush(held)

    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    part = named.mapInPandas(run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> F.Column:
    """The share of a term with ``n`` of ``total`` occurrences among ``kept`` terms; exact beyond 64 bits."""
    return F.expr(f"CAST(1 + (CAST({SCALE} AS DECIMAL(12, 0)) * CAST({n} + 1 AS DECIMAL(19, 0))) div ({total} + {kept}) AS BIGINT)")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of shares, which are at most SCALE + 1, so that the square fits 64 bits."""
    d = p - q
    return d * d // q


def _scatter(row: pd.DataFrame, index: tuple, out: np.ndarray, p0: int, q0: np.ndarray) -> None:
    """Add the corrections of one group's terms to the accumulator ``out`` over its peers."""
    starts, ends, peer, share_of = index
    term, p = row
    sizes = ends[term] - starts[term]
    steps = np.searchsorted(np.cumsum(sizes), np.arange(FLAT, sizes.sum() + FLAT, FLAT))
    for a, b in zip(np.r_[0, steps], np.r_[steps, len(term)], strict=True):
        n = sizes[a:b]
        if not n.sum():
            continue
        at = np.repeat(starts[term[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        h, q, mine = peer[at], share_of[at], np.repeat(p[a:b], n)
        base = q0[h]
        start = np.full(1, p0)
        np.add.at(out, h, divergence(mine, q) - divergence(mine, base) - divergence(start, q) + divergence(start, base))


def _baseline(p: np.ndarray, times: np.ndarray, peer: np.ndarray, q: np.ndarray, q_times: np.ndarray, p0: int, q0: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """The sums over all kept terms of one group and each peer, as if no term were in both."""
    start = np.full(1, p0)
    out = absent * divergence(start, q0)
    step = max(1, FLAT // max(1, len(q0)))
    for k in range(0, len(p), step):
        out += (divergence(p[k:k + step, None], q0[None, :]) * times[k:k + step, None]).sum(axis=0)
    np.add.at(out, peer, divergence(start, q) * q_times)
    return out


def _block_pair(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per ordered pair of sources of two blocks: the baseline (bucket -1) or a bucket's corrections."""
    first = rows.iloc[0]
    source, names = pd.factorize(rows["source"].to_numpy(object))
    one = ~pd.Series(source).duplicated().to_numpy()
    block, p0 = rows["block"].to_numpy()[one], rows["p0"].to_numpy()[one]
    spread, kept = rows["spread"].to_numpy()[one], int(first["kept"])
    own = rows["p"].notna().to_numpy()
    source, p, times = source[own], rows["p"].to_numpy()[own].astype(np.int64), rows["times"].to_numpy()[own]
    term = pd.factorize(rows["term"][own])[0] if first["bucket"] >= 0 else None
    parts = []
    for low, high in {(first["low"], first["high"]), (first["high"], first["low"])}:
        peers = np.flatnonzero(block == high)
        place = np.full(len(names), -1)
        place[peers] = np.arange(len(peers))
        theirs = np.flatnonzero(place[source] >= 0)
        if not len(peers):
            continue
        if term is not None:
            theirs = theirs[np.argsort(term[theirs], kind="stable")]
            edges = np.searchsorted(term[theirs], np.arange(int(term.max(initial=-1)) + 2))
            index = edges[:-1], edges[1:], place[source[theirs]], p[theirs]
        by_source = np.argsort(source, kind="stable")
        cut = np.searchsorted(source[by_source], np.arange(len(names) + 1))
        for g in np.flatnonzero(block == low):
            mine = by_source[cut[g]:cut[g + 1]]
            if term is None:
                out = np.zeros(len(peers), np.int64)
                if kept:
                    out = _baseline(p[mine], times[mine], place[source[theirs]], p[theirs], times[theirs], p0[g], p0[peers], kept - spread[g] - spread[peers])
            else:
                out = np.zeros(len(peers), np.int64)
                _scatter((term[mine], p[mine]), index, out, p0[g], p0[peers])
            other = peers != g
            parts.append((np.full(int(other.sum()), g), peers[other], out[other]))
    left, right, value = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    # As objects: an empty column of pandas strings has no Arrow form of one piece.
    text = pd.DataFrame({"lang": [first["lang"]] * len(value), "source": names[left], "item": names[right]}, dtype=object)
    return text.assign(value=value)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of ``docs``.

    Part ``pair``: every other source of the language with its divergence, all ranks. Part ``term``: the group's
    terms whose share is above that of the language, the ``top`` first. Ranks go by value descending, then item in
    byte order. Null text, lang and source are ''. Every row is a document, repeated ones too. A group without
    kept terms has zero counts; without any kept term in its language all its pairs have value 0. A language with
    one source has no pairs; an empty table gives an empty one. doc_id and other columns are not read.
    """
    counts = materialize(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least_docs)
    entries = materialize(counts.join(kept.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "all_n"))
    seen = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("spread"))
    groups = seen.join(sums, ["lang", "source"], "left").fillna(0, ["total", "spread"])
    terms = entries.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("all_total"), F.count("*").alias("kept"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.sum("spread").alias("postings"))
    langs = sizes.join(terms, "lang", "left").fillna(0, ["all_total", "kept"]).select(
        "lang", "all_total", "kept", "blocks", F.ceil(2 * F.col("postings") / F.col("blocks") / POSTINGS).alias("buckets")
    )
    zero = F.when(F.col("kept") > 0, share("0", "total", "kept"))
    groups = materialize(groups.join(langs, "lang").withColumn("p0", F.coalesce(zero, F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))))
    shares = materialize(entries.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "kept")))

    # Terms of each group above the language's share.
    over = shares.withColumn("q", share("all_n", "all_total", "kept")).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Pairs: every block meets every block of its language, once per bucket and once for the baseline.
    held = ["lang", "source", "block", "blocks", "p0", "spread", "kept"]
    posted = shares.select(F.pmod(F.xxhash64("term"), "buckets").alias("bucket"), *held, "term", "p", F.lit(1).cast("long").alias("times"))
    histogram = shares.groupBy(*held, "p").agg(F.count("*").alias("times"))
    base = groups.select(*held, F.lit(None).cast("long").alias("p"), F.lit(0).cast("long").alias("times")).unionByName(histogram)
    base = base.select(F.lit(-1).cast("long").alias("bucket"), *held, F.lit(None).cast("string").alias("term"), "p", "times")
    met = posted.unionByName(base).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with")).drop("with", "blocks")
    pairs = met.groupBy("lang", "bucket", "low", "high").applyInPandas(_block_pair, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(over)
