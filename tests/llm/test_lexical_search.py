"""Lexical search against a plain form: repeats, ties, nulls, odd characters, several chunks, cut ranges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import lexical_search as L

WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    tfs = [(d, Counter(words(t))) for d, t in docs]
    total, length = sum(bool(c) for _, c in tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in tfs:
            n = sum(c.values())
            m = 25 + (75 * n * total) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id long, text string, rank int, item string")
    i = spark.createDataFrame([(*x, 1.0) for x in items], "item_id string, text string, score double")
    return sorted(map(tuple, L.ranked_search(d, i, **more).collect()), key=str)


@pytest.mark.parametrize("chunk, pairs", [(1_000_000, L.PAIRS), (5, 7)])
def test_against_plain_form(spark, monkeypatch, chunk, pairs):
    monkeypatch.setattr(L, "PAIRS", pairs)
    r = random.Random(3)
    pool = ["the", "The", "of", "é", "ÉCOLE", "école", "x1", "ß", "\U0001f600", "a_b", "tail", " z", "\x85q", *[f"w{k}" for k in range(30)]]
    docs = [(k, r.choice([" ", "\n", ", ", "\x00"]).join(r.choices(pool, k=r.randint(0, 60)))) for k in range(80)]
    docs += [(100 + k, "the tail of w1 w1") for k in range(15)] + [(None, "the tail of w1 w1"), (7, "the tail of w1 w1"), (7, "the tail of w1 w1"), (200, None), (201, ""), (202, "...\n"), (203, "w2 " * 50_000)]
    items = [("a", "The tail of W1, w1!"), ("b", "école ÉCOLE \U0001f600"), ("c", "nothing here"), ("d", None), (None, "w2 w3"), ("f", "w5 w5 w6 x1"), ("f", "w5 w5 w6 x1")]
    want = plain(docs, items)
    assert len(want) > 40 and searched(spark, docs, items, chunk_terms=chunk) == want


def test_nothing_to_rank(spark):
    assert searched(spark, [], [("a", "x")]) == [] and searched(spark, [(1, "x")], []) == [] and searched(spark, [(1, None)], [("a", "x")]) == []


def test_radix_order():
    keys = np.random.default_rng(0).integers(0, 2**63, 5_000).astype(np.uint64) >> np.uint64(20)
    keys = np.r_[keys, keys[:500]]
    assert (L.radix_order(keys) == np.argsort(keys, kind="stable")).all() and len(L.radix_order(keys[:0])) == 0
