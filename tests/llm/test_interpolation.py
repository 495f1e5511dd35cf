"""Deleted interpolation against a direct count, and odd input."""
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cellwire.llm import interpolation
from cellwire.llm.queries import QUERIES

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def direct(rows, order, mixture):
    """Counts by words themselves; probabilities with the weights that were learned."""
    cut = [[*(text or "").encode().translate(LOWER).split(), None] for _, text in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count = Counter()
    for words, h in zip(cut, held, strict=True):
        if not h:
            padded = ["<"] * (order - 1) + words
            for t in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    count[tuple(padded[t - k + 1:t + 1])] += 1
    known = sum(len(g) == 1 for g in count)
    total = sum(n for g, n in count.items() if len(g) == 1)
    ends = count[(None,)]
    out = []
    for (i, _), words, h in zip(rows, cut, held, strict=True):
        padded = ["<"] * (order - 1) + words
        base = score = 0.0
        for t in range(order - 1, len(padded)):
            c = count[(padded[t],)]
            base += math.log10((c + 0.5) / (total + 0.5 * (known + 1)))
            p = 1 / (known + 1)
            if total:
                p = mixture.weights[1, 1] * c / total + (1 - mixture.weights[1, 1]) * p
            for k in range(2, order + 1):
                context = tuple(padded[t - k + 1:t])
                n = ends if set(context) == {"<"} else count[context]
                if n:
                    m = mixture.weights[k, n.bit_length()]
                    p = m * count[tuple(padded[t - k + 1:t + 1])] / n + (1 - m) * p
            score += math.log10(p)
        out.append((i, h, len(words), sum(count[(w,)] > 0 for w in words), total, base, score))
    return out


def made(rnd, n):
    words = [f"w{k}" for k in range(40)] + ["Éa", "THE", "the", "x-y"]
    rows = [(k, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(len(words))], k=rnd.randrange(40)))) for k in range(n)]
    copy = " ".join(f"c{k}" for k in range(30))
    return rows + [(None, "no id the"), (3, None), (4, ""), (5, rows[5][1]), (6, "\x85 \xa0 \x1c one")] + [(1000 + k, copy) for k in range(300)]


def matches(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: repr(r[:4])), sorted(want, key=lambda r: repr(r[:4])), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order,chunk,per_bucket", [(3, 1 << 24, 1 << 21), (3, 500, 60), (2, 2000, 100), (1, 2000, 100), (4, 2000, 100)])
def test_scores_against_direct_counts(spark, monkeypatch, order, chunk, per_bucket):
    monkeypatch.setattr(interpolation, "CHUNK", chunk)
    monkeypatch.setattr(interpolation, "GRAMS", per_bucket)
    monkeypatch.setattr(interpolation, "PART", 4000)
    rows = made(random.Random(2), 200)
    docs = spark.createDataFrame([(*r, 1, "h", 2) for r in rows], "doc_id long, text string, chunk int, half string, counts int")
    mixture = interpolation.model(interpolation.counted(docs, order), order, 2)
    got = [tuple(r) for r in interpolation.scored(docs, order, 2).collect()]
    matches(got, direct(rows, order, mixture))
    assert all(0 < w < 1 for w in mixture.weights[1:, 1:].ravel())


def test_packed_sizes():
    """Keys take what their spacing asks for and two bits; what is unpacked equals what was packed."""
    rnd = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 2 ** 64 - 1), (3, 0), (7, 2 ** 63), (1000, 5), (20_000, 2 ** 45), (20_000, 2 ** 64 - 1)):
        keys = np.sort(rnd.integers(0, top, n, dtype=np.uint64, endpoint=True))
        raw = interpolation.packed_keys(keys)
        assert (interpolation.unpacked_keys(raw) == keys).all()
        if n == 20_000:
            assert 8 * len(raw) / n < math.log2(top / n) + 2.2
    for column in (np.array([0, 7, 2 ** 40, 7]), rnd.zipf(1.3, 5000) % 10 ** 6, np.arange(70_000), np.zeros(5, np.int32)):
        assert (interpolation.unpacked_ranks(interpolation.packed_ranks(column), len(column)) == column).all()
        codes = np.sort(column).astype(np.int64)
        assert (interpolation.unpacked_codes(interpolation.packed_codes(codes), len(codes)) == codes).all()
    words = rnd.choice(4000 * np.arange(1, 200), 50_000)
    assert len(interpolation.packed_ranks(words)) < 0.8 * len(interpolation.packed_counts(words))


def test_weights_maximise_the_held_out_likelihood(spark):
    """Words follow each other by a rule in one half of the text and freely in the other, at known rates."""
    rnd = random.Random(7)
    rows = []
    for k in range(400):
        words = ["a0"]
        for _ in range(60):
            words.append(f"a{(int(words[-1][1:]) * 7 + 3) % 50}" if rnd.random() < 0.6 else f"a{rnd.randrange(50)}")
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = interpolation.counted(docs, 2)
    mixture = interpolation.model(stored, 2, 10)
    rows = interpolation.scored(docs, 2, 10).where("held_out").collect()
    per_token = sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    base = sum(r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    best = 0.612 * math.log10(0.608) + 0.392 * math.log10(0.4 / 50)
    assert per_token > base + 0.4 and per_token > best - 0.15
    assert np.median([w for w in mixture.weights[2, 6:9]]) > 0.7


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert interpolation.scored(empty, 2, 1).count() == 0
    only_held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = interpolation.scored(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string"), 3, 1).first()
    assert tuple(row) == (only_held, True, 3, 0, 0, 0.0, 0.0)
    long = spark.createDataFrame([(1, "word and another " * 150_000), (2, "word " + "x" * 3_000_000)], "doc_id long, text string")
    assert [r["n_tokens"] for r in interpolation.scored(long, 3, 1).orderBy("doc_id").collect()] == [450_001, 3]
    with pytest.raises(ValueError):
        interpolation.counted(empty, 5)


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    mixture = interpolation.model(interpolation.counted(docs))
    got = [tuple(r) for r in QUERIES["op13_lm_scoring"](spark, folder).collect()]
    matches(got, direct(rows, interpolation.ORDER, mixture))
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
