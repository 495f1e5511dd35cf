"""Jaccard join of documents on word 5-grams by chosen paths.

Every document's set of shingles is embedded into ``TOKENS`` min-hash tokens, of which two sets share a
fraction equal to their similarity. A run starts with all documents in one node. A node samples one
token position by a hash of its path, and documents with the same token there go to the same child.
Buckets of at most ``SMALL`` documents are searched at once, larger ones are split again, and those of
the last level are searched in blocks, whatever their size. Runs are repeated until a pair at the
threshold, which stays together in a run of depth d with probability threshold^d, is met with the
target recall.

Searched buckets compare tokens and join likely neighbours; the joined groups are then verified on the
shingle sets themselves. Equal sets are one row with a weight. Counts and joins are formed inside the
tasks, so pairs of a group are never listed.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.llm.common import components, joined
from cellwire.llm.relative_lz import _words
from cellwire.llm.repeats import gram_hashes, mixed
from cellwire.operators.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
TOKENS = 64
DEPTH = 3
RECALL = 0.9999
SMALL = 64
BLOCK = 1024
# Token agreement below the threshold by this much still joins a group; about four standard deviations.
SLACK = 0.2

_MULTIPLIERS = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; a text of fewer words has one, all its words."""
    words = _words(raw or b"")
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(size, len(words))))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of min-hash tokens per set; no set is empty."""
    flat = np.concatenate(sets)
    lengths = np.array([len(s) for s in sets])
    starts = np.cumsum(lengths) - lengths
    out = np.empty((len(sets), TOKENS), np.uint32)
    for k, m in enumerate(_MULTIPLIERS):
        x = flat * m
        x ^= x >> np.uint64(29)
        x *= m
        out[:, k] = np.minimum.reduceat(x, starts) >> np.uint64(16)
    return out


def paths(tokens: np.ndarray, runs: int, depth: int = DEPTH) -> np.ndarray:
    """(row, run, level): the node of each row; the token a node splits on follows from its path."""
    out = np.empty((len(tokens), runs, depth), np.uint64)
    rows = np.arange(len(tokens))
    for run in range(runs):
        node = np.full(len(tokens), run + 1, np.uint64)
        for level in range(depth):
            node = mixed(node + np.uint64(0x9E3779B97F4A7C15))
            at = (node % np.uint64(TOKENS)).astype(np.int64)
            node = mixed(node ^ (tokens[rows, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32))))
            out[:, run, level] = node
    return out


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections, by products of 0/1 matrices over stretches of the shared shingles."""
    flat = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    code = np.cumsum(np.r_[True, flat[1:] != flat[:-1]]) - 1
    n = code[-1] + 1
    on_left = owner < len(left)
    shared = (np.bincount(code[on_left], minlength=n) > 0) & (np.bincount(code[~on_left], minlength=n) > 0)
    keep = shared[code]
    code, owner = (np.cumsum(shared) - 1)[code[keep]], owner[keep]
    out = np.zeros((len(left), len(right)))
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(code, [low, low + 4096])
        wide = np.zeros((len(left) + len(right), 4096), np.float32)
        wide[owner[a:b], code[a:b] - low] = 1
        out += wide[: len(left)] @ wide[len(left):].T
    return out


def _likely(tokens: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    keep = []
    for at in range(0, len(a), 1 << 16):
        keep.append((tokens[a[at:at + (1 << 16)]] == tokens[b[at:at + (1 << 16)]]).sum(1) >= least)
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return a[keep], b[keep]


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions inside each stretch; stretches are short."""
    first, second = [], []
    for size in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        first.append((at + i).ravel())
        second.append((at + j).ravel())
    none = np.zeros(0, np.int64)
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def _edges(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Each id that is joined to a smaller one, with the smallest it reaches."""
    distinct, where = np.unique(ids, return_inverse=True)
    root = distinct[joined(len(distinct), where[a], where[b])]
    off = root != distinct
    return pd.DataFrame({"u": distinct[off], "v": root[off]})


def _blocks(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows of large groups, each sent to the pairs of blocks that its own block belongs to."""
    parts = F.ceil(F.col(size) / block)
    own = rows.withColumn("own", F.pmod(F.xxhash64("rep"), parts)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    )
    return own.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, kept) for every row of ``docs(doc_id, text)``.

    Two documents are linked if the Jaccard similarity of their shingle sets is ``threshold`` or more;
    n_links counts the other rows linked directly, class_id is the smallest doc_id reachable, and kept
    says that the row has that id. Words are runs of bytes other than white space. Null and empty texts
    link with nothing. A null doc_id links with nothing and is kept in a class of its own (null). A
    repeated row counts as another document of the same id. An empty table gives an empty table; other
    columns are not read.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** DEPTH)))
    least = (threshold - SLACK) * TOKENS

    def embed(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                sets = [shingles(r) for r in part["raw"]]
                some = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "n": [len(s) for s in sets],
                    "name": [int((mixed(s).sum() ^ (s * np.uint64(3)).sum()).astype(np.int64)) for s in some],
                    "name2": [int(np.bitwise_xor.reduce(mixed(s + np.uint64(1))).astype(np.int64)) for s in some],
                    "tokens": [t.tobytes() for t in sketch(some)],
                })

    embedded = materialize(read.where("doc_id IS NOT NULL").mapInPandas(embed, "doc_id long, n long, name long, name2 long, tokens binary"))
    unique = materialize(
        embedded.where("n > 0").groupBy("n", "name", "name2")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("tokens").alias("tokens"))
    )

    def walk(batches):
        for batch in batches:
            for at in range(0, len(batch), 5000):
                part = batch.iloc[at:at + 5000]
                nodes = paths(np.frombuffer(b"".join(part["tokens"]), np.uint32).reshape(-1, TOKENS), runs).astype(np.int64)
                flat = nodes.reshape(-1, DEPTH)
                yield pd.DataFrame({"rep": np.repeat(part["rep"].to_numpy(), runs), **{f"h{k}": flat[:, k] for k in range(DEPTH)}})

    walked = materialize(unique.select("rep", "tokens").mapInPandas(walk, "rep long, " + ", ".join(f"h{k} long" for k in range(DEPTH))))
    # Level by level: buckets small enough are searched, the others are split on.
    small, rest = [], walked
    for level in range(DEPTH):
        sizes = rest.groupBy(f"h{level}").agg(F.count("*").alias("size")).where("size > 1")
        rest = materialize(rest.join(sizes, f"h{level}"))
        bucket = rest.select(F.col(f"h{level}").alias("bucket"), "rep", "size")
        small.append(bucket.where(F.col("size") <= SMALL))
        if level < DEPTH - 1:
            rest = rest.where(F.col("size") > SMALL).drop("size")
    large = bucket.where(F.col("size") > SMALL)
    few = small[0].unionByName(small[1]).unionByName(small[2])
    tokens = unique.select("rep", "tokens")
    groups = max(1, -(-few.count() // 20_000))

    def table_of(batch: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(batch["tokens"]), np.uint32).reshape(-1, TOKENS)

    def search_small(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["bucket", "rep"], ignore_index=True)
        bucket = batch["bucket"].to_numpy()
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        a, b = _pairs(starts, np.diff(np.r_[starts, len(bucket)]))
        return _edges(batch["rep"].to_numpy(), *_likely(table_of(batch), a, b, least))

    def search_blocks(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.drop_duplicates("rep").sort_values(["own", "rep"], ignore_index=True)
        own, table, ids = batch["own"].to_numpy(), table_of(batch), batch["rep"].to_numpy()
        left = np.flatnonzero(own == key[1])
        right = np.flatnonzero(own == key[2])
        edges = []
        for i in left.tolist():
            some = right[right > i] if key[1] == key[2] else right
            some = some[(table[some] == table[i]).sum(1) >= least]
            edges.append((np.full(len(some), i), some))
        return _edges(ids, *(np.concatenate(x) for x in zip(*edges))) if edges else pd.DataFrame({"u": [], "v": []}).astype("int64")

    met = (
        few.join(tokens, "rep").groupBy(F.pmod(F.xxhash64("bucket"), F.lit(groups)).alias("part"))
        .applyInPandas(search_small, "u long, v long")
    ).unionByName(
        _blocks(large, "bucket", "size", 2 * BLOCK).join(tokens, "rep").groupBy("bucket", "low", "high")
        .applyInPandas(search_blocks, "u long, v long")
    )
    grouped = components(met)
    sizes = grouped.groupBy("component").agg(F.count("*").alias("size"))
    plan = materialize(
        grouped.join(sizes, "component").select(F.col("node").alias("rep"), F.col("component").alias("bucket"), "size")
        .join(unique.select("rep", "weight"), "rep")
    )
    # The texts of the joined sets' representatives, once; each goes to the tasks that verify its group.
    texts = read.join(
        plan.select(F.col("rep").alias("doc_id"), "bucket", "size", "weight").hint("shuffle_hash"), "doc_id"
    ).withColumnRenamed("doc_id", "rep")
    verify_groups = max(1, -(-plan.count() // 1_000))
    schema = "u long, v long, links long"

    def linked_pairs(left: list, right: list) -> np.ndarray:
        both = intersections(left, right)
        total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
        return both >= threshold * (total - both) - 1e-9

    def outcome(ids: np.ndarray, links: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        distinct, where = np.unique(ids, return_inverse=True)
        root = distinct[joined(len(distinct), where[a], where[b])]
        out = pd.DataFrame({"u": ids, "v": root[where], "links": links})
        return out[(out["links"] > 0) | (out["u"] != out["v"])]

    def verify_small(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in batch.drop_duplicates("rep").groupby("bucket"):
            sets = [shingles(r) for r in part["raw"]]
            link = linked_pairs(sets, sets)
            np.fill_diagonal(link, False)
            out.append(outcome(part["rep"].to_numpy(), link @ part["weight"].to_numpy(), *np.nonzero(link)))
        return pd.concat(out)

    def verify_blocks(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.drop_duplicates("rep").sort_values(["own", "rep"], ignore_index=True)
        own, ids, weight = (batch[c].to_numpy() for c in ("own", "rep", "weight"))
        sets = [shingles(r) for r in batch["raw"]]
        left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
        links = np.zeros(len(batch), np.int64)
        if not len(left) or not len(right):
            return outcome(ids, links, left[:0], right[:0])
        link = linked_pairs([sets[k] for k in left], [sets[k] for k in right])
        link &= ids[left][:, None] != ids[right][None, :]
        links[left] += link @ weight[right]
        if key[1] != key[2]:
            links[right] += link.T @ weight[left]
        a, b = np.nonzero(link)
        return outcome(ids, links, left[a], right[b])

    columns = ["bucket", "rep", "weight", "raw"]
    few_texts = texts.where(F.col("size") <= BLOCK).select(*columns)
    many_texts = _blocks(texts.where(F.col("size") > BLOCK), "bucket", "size", BLOCK)
    found = materialize(
        few_texts.groupBy(F.pmod(F.xxhash64("bucket"), F.lit(verify_groups)).alias("part")).applyInPandas(verify_small, schema)
        .unionByName(many_texts.select(*columns, "own", "low", "high").groupBy("bucket", "low", "high").applyInPandas(verify_blocks, schema))
    )
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    classes = components(found.select("u", "v"))
    of_set = (
        unique.join(links, unique["rep"] == links["u"], "left").join(classes, unique["rep"] == classes["node"], "left")
        .select("n", "name", "name2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    )
    out = embedded.join(of_set, ["n", "name", "name2"], "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    nameless = read.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
