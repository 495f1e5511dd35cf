"""Periodic runs against a direct search, and odd input."""
import random
import zlib

import numpy as np

from cellwire.llm import periodic


def direct(w):
    found = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(w[i:i + length - d] == w[i + d:i + length] for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(rnd):
    words = []
    while len(words) < rnd.choice([0, 10, 30, 100, 400]):
        kind = rnd.random()
        if kind < 0.4:
            words += [rnd.randrange(rnd.choice([2, 3, 50])) for _ in range(rnd.randrange(40))]
        elif kind < 0.9:
            q = rnd.choice([1, 2, 3, 5, 8, 9, 10, 12, 13, 17, 20, 24, 30, 41, 50])
            root = [rnd.randrange(rnd.choice([2, 4, 50])) for _ in range(q)]
            size = rnd.randrange(2 * q, 5 * q + 30)
            words += (root * (size // q + 1))[:size]
        else:
            a, b = [0], [0, 1]
            while len(b) < rnd.choice([20, 100, 200]):
                a, b = b, b + a
            words += b
    return words


def test_runs_against_direct_search():
    rnd = random.Random(1)
    texts = [made(rnd) for _ in range(250)]
    got = periodic.runs([np.array(t, np.int64) for t in texts])
    assert got == [direct(t) for t in texts]
    assert sum(map(len, got)) > 100
    assert periodic.runs([]) == []


def test_long_runs():
    root = np.random.default_rng(1).integers(0, 1000, 700)
    assert periodic.runs([np.zeros(500_000, np.int64), np.tile(root, 500)]) == [[(0, 500_000, 1)], [(0, 350_000, 700)]]
    assert periodic.runs([np.arange(100_000)]) == [[]]


def test_rows(spark):
    run = "a b c d " * 10
    rows = [(1, run), (1, run), (2, None), (3, ""), (None, "x " + run + "y"), (4, " ".join("ab" * 20)), (5, "é ß " * 30), (6, "w " * 300_000)]
    docs = spark.createDataFrame([(*r, 1, "q", None) for r in rows], "doc_id long, text string, runs int, collapsed string, start long")
    got = {}
    for r in periodic.periodic_runs(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[1]) == 2 and got[1][0] == got[1][1]
    assert [tuple(x) for x in got[1][0]["runs"]] == [(0, 40, 4)] and got[1][0]["collapsed"] == "a b c d"
    assert got[None][0]["collapsed"] == "x a b c d y" and got[None][0]["n_words"] == 42
    assert got[2][0][1:] == got[3][0][1:] == (0, [], "")
    assert got[4][0]["n_words"] == 1 and got[5][0]["collapsed"] == "é ß"
    assert got[6][0]["collapsed"] == "w"
    digests = {r["doc_id"]: r for r in periodic.digest(periodic.periodic_runs(docs)).collect()}
    assert digests[1]["exponent_milli"] == 10_000 and digests[2]["start"] is None and digests[2]["n_runs"] == 0
    assert periodic.digest(periodic.periodic_runs(docs.limit(0))).count() == 0
    # Ties of the exponent go to the smaller start.
    two = spark.createDataFrame([(1, "a b " * 12 + "z " + "c d e f " * 12 + "y " + "g h " * 24)], "doc_id long, text string")
    assert periodic.digest(periodic.periodic_runs(two)).first()["start"] == 74


def test_planted_tails(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 50))) for k in range(300)] + [(None, "a b"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS a", "3 AS g", "4 AS p", "5 AS h")
    got = sorted(((r["doc_id"], r["text"]) for r in periodic.with_planted_runs(docs).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        words = (text or "").split()
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))
        want.append((doc_id, text))
    assert got == sorted(want, key=repr)
