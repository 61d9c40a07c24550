"""Centroid clustering by brute force in Python's integers, and odd vectors."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import centroids
from tests.helpers import assert_same, connect

FOLDER = "/root/testdata/sf0.01"


def by_brute_force(rows, size, clusters, rounds=3):
    rows = [(i, [math.floor(64 * v) for v in e]) for i, e in rows if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), e) for i, e in rows if i is not None)[:clusters]
    c = [e for _, e in first]

    def place(e):
        d = [sum((a - b) ** 2 for a, b in zip(e, x, strict=True)) for x in c]
        return min(range(len(c)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        own = [place(e)[0] for _, e in rows]
        for k in range(len(c)):
            members = [e for (_, e), o in zip(rows, own, strict=True) if o == k]
            if members:
                c[k] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    placed = [(i, *place(e)) for i, e in rows]
    inertia = {k: sum(d for _, o, d in placed if o == k) for k in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, k, d in placed), key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def result(out):
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_equals_brute_force(spark, scale):
    r = random.Random(3)
    rows = [(i, [float(np.float32(r.gauss(i % 5, 1) * scale)) for _ in range(4)]) for i in range(300)]
    rows += rows[:7] + [(None, [0.5] * 4), (None, [2.0] * 4), (900, [1.0] * 3), (901, None), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, []), (5, [9.0] * 4)]
    out = centroids.assigned(frame(spark, rows).withColumns({c: F.lit("x") for c in ("cluster", "distance", "label", "_key")}), clusters=6, size=4)
    assert result(out) == by_brute_force(rows, 4, 6)


def test_ties_and_repeated_rows(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)] + [(7, [0.25, 0.25])] * 30
    assert result(centroids.assigned(frame(spark, rows), clusters=5, size=2)) == by_brute_force(rows, 2, 5)


def test_large_values_fall_back_to_integers(spark):
    rows = [(i, [v, -v / 3]) for i, v in enumerate([1e6, 2e6, 5e9, 3.25e9, 7.0, 1.5, 0.0, -1e8])]
    capped = lambda rows: [(i, k, *(min(v, 2**63 - 1) for v in (d, own, total)), digest) for i, k, d, own, total, digest in rows]
    assert result(centroids.assigned(frame(spark, rows, "double"), clusters=3, size=2)) == capped(by_brute_force(rows, 2, 3))
    far = [(1, [1e30, 0.0]), (2, [0.0, 0.0]), (3, [-1e30, 0.0]), (4, [1e308, 1e308])]
    assert result(centroids.assigned(frame(spark, far[:3], "double"), clusters=2, size=2)) == capped(by_brute_force(far[:3], 2, 2))
    assert centroids.assigned(frame(spark, far, "double"), clusters=2, size=2).count() == 4


def test_expansion_equals_the_integers():
    g = np.random.default_rng(1)
    for most in (3, 1000, 1 << 20, 1 << 23, 1 << 30):
        x, c = g.integers(-most, most + 1, (50, 64)), g.integers(-most, most + 1, (9, 64))
        c[5] = c[2]
        k, d = centroids.nearest(x, c)
        exact = [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b, strict=True)) for b in c] for a in x]
        assert k.tolist() == [row.index(min(row)) for row in exact] and d.tolist() == [min(row) for row in exact]


def test_few_and_no_vectors(spark):
    rows = [(3, [1.0, 2.0]), (4, [0.0, 0.0])]
    assert result(centroids.assigned(frame(spark, rows), size=2)) == by_brute_force(rows, 2, 16)
    for none in ([], [(1, None)], [(None, [1.0, 2.0])]):
        assert centroids.assigned(frame(spark, none), size=2).count() == 0


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 3)
    rows = [(i, [math.sin(i), math.cos(i)]) for i in range(20)]
    assert centroids.blocks(frame(spark, rows)).count() >= 7


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
def test_query_equals_its_sql(spark):
    assert_same(centroids.op13_centroids(spark, FOLDER), centroids.SQL, connect(FOLDER))
