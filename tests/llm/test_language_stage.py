"""What the language stage learns from, keeps and rejects; rows of any columns through the stages."""
import datetime
import random

import numpy as np
import pytest

import corpus_pipeline
from cellwire.llm import langid, prefix_free

EN = "the cat and the dog of that house went with them to where they had been "
FR = "le chat et les chiens de la maison vont avec eux dans une ville qui est loin "
DE = "der hund und die katze sind nicht mit dem haus aber auch ein wagen ist da "


def mixed(text, k):
    words = text.split()
    random.Random(k).shuffle(words)
    return " ".join(words)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def stage(spark, docs):
    return sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect())


def test_unlabelled_corpus_stays_whole(spark):
    docs = table(spark, [(k, mixed(EN, k), None) for k in range(20)] + [(20, None, None), (21, "12", None)])
    assert stage(spark, docs) == list(range(22))


def test_long_texts_are_learned_from(spark):
    docs = table(spark, [(k, mixed(EN if k % 2 else FR, k) + (" " + (EN if k % 2 else FR)) * 400, "en" if k % 2 else "fr") for k in range(60)])
    field = langid.fit(docs)
    assert field.labels == ["en", "fr"]
    assert all(len(r["text"].encode()) <= langid.SAMPLE_BYTES for r in langid.sample_of(docs).collect())
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, field).collect()}
    assert all(v == ("en" if k % 2 else "fr") for k, v in got.items())
    assert stage(spark, docs) == list(range(60))


def test_rare_languages_are_learned(spark):
    rows = [(k, mixed(EN, k), "en") for k in range(4000)] + [(5000 + k, mixed(FR, k), "fr") for k in range(12)]
    docs = table(spark, rows + rows[:50])
    drawn = langid.sample_of(docs, 100).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in drawn} == {"en": 50, "fr": sum(1 for k in range(12) if langid_learns(5000 + k))}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit(docs, 400)).collect()}
    assert all(got[5000 + k] == "fr" for k in range(12)) and got[3] == "en"


def langid_learns(doc_id):
    import zlib
    return zlib.crc32(str(doc_id).encode()) % 4 != 2


def test_low_scores_are_rejected(spark):
    texts = {"en": EN, "fr": FR, "de": DE}
    rows = [(k, mixed(texts[n], k), n) for k, n in enumerate(["en", "fr", "de"] * 60)]
    odd = [(1000, "1 2 3", None), (1001, None, "en"), (1002, "", "fr"), (1003, mixed(EN, 5), None)]
    docs = table(spark, rows + odd)
    kept = stage(spark, docs)
    assert kept == [*range(180), 1003]
    field = langid.fit(docs)
    scores = {r["doc_id"]: r["score"] for r in langid.identify(docs, field).collect()}
    # A field that knows nothing about any word is uncertain about all.
    blank = langid.Field(field.labels, {})
    low = langid.Labeller(blank).label(["zzqx qqzv xx"])[0]
    assert low[1] < corpus_pipeline.LEAST_SCORE < min(scores[k] for k in range(180))


def test_gradient_of_a_small_field():
    """The fitted field has a higher likelihood than its neighbours: summed over all label sequences of short texts."""
    import itertools

    rng = np.random.default_rng(3)
    emission, moves, start = rng.random((6, 3)), rng.random((3, 3)), rng.random(3)
    for lengths in ([6], [2, 4], [1, 3, 2]):
        got, at = langid.posteriors(emission, np.array(lengths), moves, start), 0
        for n in lengths:
            total = np.zeros((n, 3))
            for path in itertools.product(range(3), repeat=n):
                weight = start[path[0]] * np.prod([emission[at + k, y] for k, y in enumerate(path)])
                weight *= np.prod([moves[a, b] for a, b in zip(path, path[1:])])
                for k, y in enumerate(path):
                    total[k, y] += weight
            assert np.allclose(got[at:at + n], total / total.sum(1, keepdims=True))
            at += n


def test_predictions_by_all_label_sequences(spark):
    """Every prediction of a tiny field equals the sum over all label sequences."""
    import itertools

    rows = [(k, mixed(EN if k % 2 else FR, k), "en" if k % 2 else "fr") for k in range(80)]
    field = langid.fit(table(spark, rows))
    texts = ["the chat", "le dog de house", "maison", "they vont 12 with eux", "and-et la"]
    docs = table(spark, [(k, t, None) for k, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in langid.identify(docs, field).collect()}
    moves, start = np.exp(field.moves), np.exp(field.start)
    for k, text in enumerate(texts):
        words = [w for w in text.lower().split() if any(c.isalpha() for c in w)]
        score, _ = field.scores(words)
        emission = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-30
        total = np.zeros((len(words), 2))
        for path in itertools.product(range(2), repeat=len(words)):
            weight = start[path[0]] * np.prod([emission[i, y] for i, y in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:])])
            for i, y in enumerate(path):
                total[i, y] += weight
        mean = (total / total.sum(1, keepdims=True)).mean(axis=0)
        assert got[k]["lang_pred"] == field.labels[int(mean.argmax())] and got[k]["score"] == pytest.approx(mean.max(), abs=1e-9)


SHARED = " ".join(f"word{k}" for k in range(30))
STAMP = datetime.datetime(2024, 5, 6, 7, 8, 5, 123456)


@pytest.mark.parametrize("extra", ["plain", "nested"])
def test_any_columns_pass_through_every_stage(spark, extra):
    rows = [(1, f"first {SHARED}", "en"), (2, f"second one {SHARED} then", None), (2, f"second one {SHARED} then", None), (3, None, "fr"), (None, f"no id {SHARED}", "en")]
    docs = table(spark, rows).selectExpr(
        "*", "length(text) AS n_chars", "'r' AS raw", "7 AS chunk", "8 AS carried", "9 AS digest", "TIMESTAMP '2024-05-06 07:08:05.123456' AS stamp",
        "TIMESTAMP_NTZ '1500-05-06 07:08:05.123456' AS ntz", "1.5D AS `a.b`", "X'00ff' AS bytes", "CAST(1.10 AS DECIMAL(38, 10)) AS price", "CAST('NaN' AS DOUBLE) AS x",
        "9007199254740993L AS large", "'' AS empty", "CAST(NULL AS STRING) AS none", "'a\"{' AS quotes")
    if extra == "nested":
        docs = docs.selectExpr("*", "map(1, 'x') AS m", "array(named_struct('t', stamp)) AS deep", "INTERVAL 1 DAY AS pause")
    got = {(r["doc_id"], r["text"]): r for r in prefix_free.deduplicated(docs).collect()}
    before = docs.first()
    assert prefix_free.deduplicated(docs).schema == docs.schema or prefix_free.deduplicated(docs).dtypes == docs.dtypes
    assert {k[0] for k in got} == {1, 2, 3, None} and prefix_free.deduplicated(docs).count() == 5
    for row in got.values():
        for c in docs.columns:
            if c not in ("doc_id", "text", "lang", "n_chars", "x"):
                assert row[c] == before[c], c
        assert row["x"] != row["x"] and row["n_chars"] == len(row["text"])
    assert got[(3, "")]["lang"] == "fr" and (1, rows[0][1]) in got
    assert all(SHARED not in k[1] for k in got if k[0] != 1)
    assert prefix_free.deduplicated(docs.limit(0)).count() == 0
    for _, function in corpus_pipeline.STAGES[:3]:
        out = function(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.packed(spark, docs, "").count() == 5
