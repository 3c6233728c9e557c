"""Mixing against a plain form: caps, nulls, hot sources, repeated rows, reruns."""

import re

import pytest
from pyspark.sql import functions as F

from panelforge.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def plain_targets(sizes):
    """Shares by weight, capped one round after the other, in exact steps."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, share = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        goal = {s: float(3 * sizes[s]) if s in capped else left * weight[s] / share for s in names}
        above = {s for s in names if s not in capped and goal[s] > 3 * sizes[s]}
        if not above:
            return goal
        capped |= above


@pytest.fixture(scope="module")
def rows():
    out = [(k, "w " * (1 + k * 7919 % 211), f"s{k % 9}") for k in range(900)]
    out += [(1000 + k, "a b c\tx\x0by", "hot") for k in range(700)]  # a no-break space is no separator
    out += [(3000, "w " * 20, "a\U0001f600"), (3001, "w " * 5, "a￮"), (3002, "w " * 3000, None), (3003, None, "empty"), (3004, "", "empty"), (3005, " \n", None)]
    return out + [(None, "one two", "s1"), (7, "one two", "s7"), (7, "one two", "s7")]


def test_targets_and_taken(spark, rows):
    got = mixing.mixed(docs_of(spark, rows), stratum_rows=200).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    of = {}
    for _, t, s in rows:
        of[s] = of.get(s, 0) + size(t)
    goal = plain_targets(of)
    by_id = {i: s for i, _, s in rows}
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == of[s] and r.target == goal[s] and r.taken == r.copies * r.size
        rate = goal[s] / of[s] if of[s] else 0.0
        assert r.copies - int(rate) in (0, 1) and r.taken <= 3 * r.size
    for s in of:
        mine = [r for r in got if by_id[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - goal[s]) <= 4 * max(r.size for r in mine)
    assert any(goal[s] == 3 * of[s] > 0 for s in of) and abs(sum(goal.values()) - sum(of.values())) < 1e-6


def test_reruns_agree(spark, rows):
    def seen(d):
        return sorted(map(str, mixing.mixed(d, stratum_rows=200).collect()))

    assert seen(docs_of(spark, rows)) == seen(docs_of(spark, rows[::-1]).repartition(7))


def test_fractions_are_probabilities(spark):
    one = docs_of(spark, [(k, "w " * (k % 5 + 1), "ab"[k % 2]) for k in range(400)])
    taken = {}
    for seed in range(8):
        for r in mixing.mixed(one, weights=(1, 3), seed=seed).filter("doc_id < 40").collect():
            taken.setdefault(r.doc_id, []).append((r.copies, r.target / r.source_size))
    gap = [sum(c for c, _ in v) / len(v) - v[0][1] for v in taken.values()]
    assert abs(sum(gap) / len(gap)) < 0.05 and any(len({c for c, _ in v}) > 1 for v in taken.values())


def test_empty_and_one(spark):
    assert mixing.mixed(docs_of(spark, [])).count() == 0
    assert [(r.size, r.taken, r.target) for r in mixing.mixed(docs_of(spark, [(1, None, None)])).collect()] == [(0, 0, 0.0)]
    assert [(r.size, r.taken, r.target) for r in mixing.mixed(docs_of(spark, [(1, "x y", None)])).collect()] == [(2, 2, 2.0)]


def test_copied(spark):
    docs = docs_of(spark, [(k, "w " * (k + 1), "ab"[k % 2]) for k in range(20)])
    plan = mixing.mixed(docs)
    mix = mixing.copied(docs, plan)
    assert mix.columns == docs.columns
    want = {r.doc_id: r.copies for r in plan.collect() if r.copies}
    assert {r.doc_id: r["n"] for r in mix.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want
