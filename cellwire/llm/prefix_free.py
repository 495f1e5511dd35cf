"""Exact substring dedup by prefix-free parsing of the corpus.

Rolling-hash triggers parse every document into phrases (``repeats``); the distinct phrases at
triggers of several documents are the dictionary. A position's place in the corpus order is that of
its phrase suffix, then of the phrases after it; since only windows of 50 bytes are compared, a phrase
carries the 50 bytes behind its last window, and its suffixes settle the order to that depth. Where a
trigger has one phrase its windows are equal by the parse alone; where it has several, the suffix
array of those phrases puts equal windows side by side.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwire.llm.repeats import WINDOW, mixed, repeats

GRAM = 24


def _bytes(raw) -> np.ndarray:
    return np.frombuffer(raw or b"", np.uint8)


_BYTE_HASHES = mixed(np.arange(1, 257, dtype=np.uint64))


def suffix_order(flat: np.ndarray, at: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The positions ``at`` in the order of their next ``depth`` bytes, and which differ from the one before."""
    words = -(-depth // 8)
    keys = np.zeros((words, len(at)), np.uint64)
    for k in range(depth):
        keys[k // 8] |= flat[at + k].astype(np.uint64) << np.uint64(8 * (7 - k % 8))
    order = np.lexsort(keys[::-1])
    new = np.ones(len(at), bool)
    new[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)
    return order, new


def _resolve(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each window of the phrases, from the suffix array of the phrases."""
    ends = np.cumsum(counts)
    at = np.repeat(starts - ends + counts, counts)
    at += np.arange(len(at))
    owner = np.repeat(ids, counts)
    order, new = suffix_order(flat, at)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[order], first)
    out = np.empty(len(at), np.int64)
    out[order] = least[np.cumsum(new) - 1]
    return out


def _spans(removed: np.ndarray) -> int:
    return int(np.count_nonzero(removed[1:] & ~removed[:-1]) + (len(removed) > 0 and removed[0]))


def _digest(batch: pd.DataFrame, symbols: list, removed: list) -> pd.DataFrame:
    rows = [
        (len(s), int(r.sum()), _spans(r), hashlib.sha256(s[~r].tobytes()).hexdigest())
        for s, r in zip(symbols, removed, strict=True)
    ]
    out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    out.insert(0, "doc_id", batch["doc_id"].to_numpy())
    return out


def _texts(batch: pd.DataFrame, symbols: list, removed: list) -> pd.DataFrame:
    # A window may begin or end inside a character; what is left of one is dropped.
    text = [s[~r].tobytes().decode("utf-8", "ignore") for s, r in zip(symbols, removed, strict=True)]
    out = batch.drop(columns=["raw", "chunk"])
    out["text"] = text
    return out


def _run(docs: DataFrame, finish, schema: str, *carried: str) -> DataFrame:
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"), *carried,
    )
    return repeats(read, _bytes, lambda s: _BYTE_HASHES[s], _resolve, finish, schema, np.uint8, GRAM)


def removed_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every text as UTF-8 bytes.

    A byte goes if it lies in a string of 50 bytes that also starts in a document of smaller doc_id,
    judged on the input. A null text is empty; a null doc_id counts as the largest; rows that share a
    doc_id don't remove from each other; an empty table gives an empty one; other columns are not read.
    """
    return _run(docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


# Types that travel as text and come back as they were.
_PLAIN = {"string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp_ntz"}


def _as_text(column, kind: str):
    if kind == "timestamp":
        return F.unix_micros(column).cast("string")
    return F.base64(column) if kind == "binary" else column.cast("string")


def _from_text(column, kind: str):
    if kind == "timestamp":
        return F.timestamp_micros(column.cast("long"))
    return F.unbase64(column) if kind == "binary" else column.cast(kind)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that are left by the rule of ``removed_bytes``, and n_chars, if there, their length.

    Every row stays, also one whose text is all gone (empty then; a null text becomes empty too). A
    character cut by the border of a removed string goes whole. Other columns, whatever their names and types, are
    kept as they are: plain ones travel with the text; with any other, the texts that change come back by a join.
    A null doc_id stays null; one that is no number is an error.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    plain = all(kinds[c] in _PLAIN | {"timestamp", "binary"} or kinds[c].startswith("decimal") for c in others)
    if plain:
        texts = F.struct(*[_as_text(quoted[c], kinds[c]).alias(f"c{k}") for k, c in enumerate(others)]) if others else None
        carried = F.to_json(texts) if others else F.lit("{}")
        read = docs.select("doc_id", "text", carried.alias("carried"))
        kept = _run(read, _texts, "doc_id long, carried string, text string", "carried")
        fields = ", ".join(f"c{k} string" for k in range(len(others)))
        held = F.from_json("carried", fields) if others else F.lit(None)
        kept = kept.withColumn("carried", held)
        columns = {c: _from_text(F.col(f"carried.c{k}"), kinds[c]) for k, c in enumerate(others)}
        columns |= {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.col("text")}
    else:
        # Equal texts of one id leave the same, so the id and a digest of the text name the result.
        name = F.sha2(F.coalesce(quoted["text"], F.lit("")), 256)
        read = docs.select("doc_id", "text", name.alias("digest"))
        left = _run(read, _texts, "doc_id long, digest string, text string", "digest").where(F.sha2("text", 256) != F.col("digest"))
        left = left.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("text").alias("_left")).distinct()
        rows = docs.select(F.struct(*quoted.values()).alias("row"), quoted["doc_id"].cast("long").alias("_key"), name.alias("_name"))
        kept = rows.join(left, rows["_key"].eqNullSafe(left["_id"]) & (rows["_name"] == left["_digest"]), "left")
        columns = {c: F.col("row").getField(c) for c in docs.columns}
        columns["text"] = F.coalesce("_left", columns["text"], F.lit(""))
    if "n_chars" in columns:
        columns["n_chars"] = F.length(columns["text"]).cast(kinds["n_chars"])
    return kept.select(*(columns[c].alias(c) for c in docs.columns))
