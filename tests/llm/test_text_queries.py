"""The registered text queries: equal to their SQL, or to a brute-force version where SQL cannot express them."""
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from cellwire.llm.queries import ORACLES, QUERIES
from oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], ORACLES[name]) is None


def test_sentencepiece_against_the_library(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in QUERIES["op3_sentencepiece"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text, add_eos=True)
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op4_language_id"](spark, FOLDER).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 2048)))
        assert all(r["length"] == 2048 for r in mine[1:])
        at = 0
        for r in mine:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places), sum(r["length"] for r in rows)


def test_packing_against_the_library(spark, texts):
    rows = QUERIES["op7_best_fit_packing"](spark, FOLDER).collect()
    used, total = check_packing(rows, texts)
    assert used <= -(-total // 2048) + 1


def test_pipeline_against_its_parts(spark, texts):
    """Brute-force the similar groups and the repeated strings, then check the packing of what is left."""
    import re

    def words(t):
        return re.findall(rb"[^\x20\x09-\x0d]+", t.encode())

    kept = {i: t for i, t in texts.items() if any(c.isalpha() for c in t)}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, t in kept.items() if (w := words(t))}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= 0.8 * large and (c := len(sets[a] & sets[b])) >= 0.8 * (small + large - c) - 1e-9:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    left = {i: kept[i].encode() for i in ids if find(i) == i}
    first = {}
    for i in sorted(left):
        for p in range(len(left[i]) - 49):
            first.setdefault(left[i][p:p + 50], i)
    final = {}
    for i, raw in left.items():
        gone = [False] * len(raw)
        for p in range(len(raw) - 49):
            if first[raw[p:p + 50]] < i:
                gone[p:p + 50] = [True] * 50
        final[i] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    check_packing(QUERIES["pipeline"](spark, FOLDER).collect(), final)
