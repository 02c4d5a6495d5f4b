import random
import re

import numpy as np
import pytest

from filingloom.llm import components as cc
from filingloom.llm import common, neardup, shingles
from filingloom.llm.common import Scratch


def brute_set(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    size = min(width, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, width, percent):
    sets = {i: brute_set(t, width) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    out = [(i, len(sets[i]), root(i), root(i) == i) for i, _ in rows if i is not None]
    return out + [(None, len(brute_set(t, width)), None, True) for i, t in rows if i is None]


def check(spark, rows, width=4, percent=80, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' key", "1 n")
    got = [tuple(r) for r in neardup.components(docs, width=width, percent=percent, **more).collect()]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=order) == sorted(brute(rows, width, percent), key=order)


def test_shingles_match_brute_force(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["A", "b", "Ñandú", "x\ty", "Zz"]) for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", " \n ", "one", "one two three"]
    for width in (1, 4, 5):
        assert [len(s) for s in shingles.sets(texts, width)] == [len(brute_set(t, width)) for t in texts]
    whole = shingles.sets(["ab cd ef " * 50 + "verylongword" * 20 + " z", "AB cd"], 3)
    monkeypatch.setattr(shingles, "SEGMENT", 40)
    for a, b in zip(whole, shingles.sets(["ab cd ef " * 50 + "verylongword" * 20 + " z", "AB cd"], 3), strict=True):
        assert np.array_equal(a, b)
    a, b = shingles.sets(["same words here today", "Same  WORDS\nhere today"], 4)
    assert np.array_equal(a, b)


def noisy(rng, words, rate):
    return " ".join(w if rng.random() > rate else f"w{rng.randrange(10**6)}" for w in words)


def test_groups_match_brute_force(spark):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(12):
        base = [f"g{g}_{rng.randrange(500)}" for _ in range(rng.randrange(5, 300))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows) * 3 + 1, noisy(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))))
    for _ in range(60):
        rows.append((len(rows) * 3 + 1, " ".join(passage) + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 120)))))
    rows += [(2, ""), (5, None), (8, "one two"), (11, "One TWO"), (14, rows[3][1]), (None, rows[3][1]), (None, None), rows[5]]
    check(spark, rows)


def test_a_chain_in_one_large_list(spark, monkeypatch):
    # All pass through the complete comparison; near borderline similarities within one group.
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(220)]
    rows = [(i, noisy(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04]))) for i in range(60)]
    check(spark, rows)


def test_hub_rounds_and_rest(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(220)]
    check(spark, [(i, noisy(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04, 0.08]))) for i in range(90)])


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert neardup.components(docs.limit(0), width=4).count() == 0
    assert [tuple(r) for r in neardup.components(docs, width=4).collect()] == [(1, 3, 1, True)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    got = cc.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b", Scratch(spark, "cc")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert len(got) == len({r.node for r in got})


def test_candidates_without_a_link(spark):
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, common + " " + " ".join(f"u{i}_{j}" for j in range(25))) for i in range(4)]
    check(spark, rows)
    got = cc.connected(spark.createDataFrame([], "a long, b long"), "a", "b", Scratch(spark, "cc"))
    assert got.count() == 0
    same = cc.connected(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b", Scratch(spark, "cc"))
    assert same.count() == 0


def test_hot_values_hubs_and_copies(spark, monkeypatch):
    # every key with more than three rows counts as hot, and a hub's set meets three candidates at a time
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(neardup, "GROUP", 3)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.004 else f"x{i}" for w in words)) for i in range(60)]
    rows += [(100 + i, " ".join(words)) for i in range(40)] + [(None, " ".join(words))] * 5
    rows += [(200 + i, " ".join(words[:40] + [f"y{i}-{j}" for j in range(60)])) for i in range(30)]
    check(spark, rows)
