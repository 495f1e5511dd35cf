"""Divergence of sources against a direct calculation."""
import random
import re
from collections import Counter, defaultdict

import pytest

from cellwire.llm import source_audit

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct(rows, least=3, top=200):
    counts, among, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        among[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in among[lang].items() if n >= least]
        mine = sorted(g for g in groups if g[0] == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {g: shares(counts[g]) for g in mine}
        whole = shares(sum((counts[g] for g in mine), Counter()))
        for g in mine:
            pairs = [(h[1], sum((p[g][t] - p[h][t]) ** 2 // p[h][t] for t in kept)) for h in mine if h != g]
            terms = [(t, (p[g][t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[g][t] and p[g][t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(*g, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top}
    return out


def rows_of(rnd, n):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["É", "été", "ÀB", "漢", "Zz", "x1y", "a-b"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(" ".join(rnd.choices(words, weights, k=rnd.randrange(30))), rnd.choice(["en", "fr", None]), rnd.choice([f"s{k}" for k in range(9)] + [None])) for _ in range(n)]
    return rows + [(None, "en", "bare"), ("", "xx", "a"), ("one two", "xx", "b"), ("alone alone", "yy", "z"), (rows[0])] + [("the the The", "en", "hot")] * 40


@pytest.mark.parametrize("block,postings", [(256, 1 << 19), (2, 40)])
def test_audit_against_direct(spark, monkeypatch, block, postings):
    monkeypatch.setattr(source_audit, "BLOCK", block)
    monkeypatch.setattr(source_audit, "POSTINGS", postings)
    monkeypatch.setattr(source_audit, "FLAT", 16 if block == 2 else 1 << 20)
    rows = rows_of(random.Random(4), 200)
    schema = "doc_id long, text string, lang string, source string, term int, n int, p string, block string, value int"
    docs = spark.createDataFrame([(None if k % 9 == 0 else k, *r, 1, 2, "x", "y", 3) for k, r in enumerate(rows)], schema).repartition(3)
    got = [tuple(r) for r in source_audit.audit(docs, top=5).collect()]
    assert len(got) == len(set(got)) and set(got) == direct(rows, top=5)


def test_empty_and_long(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert source_audit.audit(docs).count() == 0
    rows = [("same " * 200_000, "en", "a"), ("same other", "en", "b"), ("same other", "en", "b"), ("other", "en", "a")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in source_audit.audit(docs).collect()} == direct(rows)
