"""Layers by removing undominated vectors again and again, over parts and blocks of any size; offers of odd lines."""

import datetime
import math
import os
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import pareto
from tests.helpers import connect

FOLDER = "/root/testdata/sf0.01"
NULL = pareto.NULL_COST


def layers_by_removal(vectors, most=12):
    left, out, k = set(vectors), {}, 0
    while left and k < most:
        k += 1
        front = {v for v in left if not any(w != v and all(a <= b for a, b in zip(w, v, strict=True)) for w in left)}
        out.update(dict.fromkeys(front, k))
        left -= front
    return out


def vectors(kind, n=260, seed=1):
    r = random.Random(seed)
    if kind == "chain":
        return {(i // 3, i, NULL if i == 0 else i, 5) for i in range(n)}
    if kind == "front":
        return {(i, n - i, r.randint(0, 3), -r.randint(0, 3)) for i in range(n)}
    if kind == "grid":
        return {tuple(r.randint(0, 4) for _ in range(4)) for _ in range(n)}
    return {tuple(r.choice([NULL, *range(30)]) for _ in range(4)) for _ in range(n)}


@pytest.mark.parametrize("kind", ["chain", "front", "grid", "random"])
def test_sort_of_one_part(kind):
    own = sorted(vectors(kind, 900))
    got = pareto.fronts(np.array(own), np.ones(len(own), np.int64))
    expected = layers_by_removal(own)
    assert got.tolist() == [expected.get(v, 13) for v in own]


def test_bounds_of_earlier_rounds_hold():
    own = sorted(vectors("grid", 500))
    expected = layers_by_removal(own)
    bound = np.array([max(1, expected.get(v, 13) - i % 2) for i, v in enumerate(own)])
    assert pareto.fronts(np.array(own), bound).tolist() == [expected.get(v, 13) for v in own]


@pytest.mark.parametrize("block", [10, 60, 100_000])
def test_layers_of_scopes(spark, block):
    scopes = {0: vectors("front"), 1: vectors("grid"), 2: vectors("random"), 3: {(1, 1, 1, 1)}, -7: vectors("chain", 50)}
    rows = [(s, *v) for s, own in scopes.items() for v in own]
    got = pareto.layered(spark.createDataFrame(rows, "scope long, c0 long, c1 long, c2 long, c3 long"), pareto.COSTS, block=block).collect()
    found = {}
    for r in got:
        found.setdefault(r.scope, {})[r.c0, r.c1, r.c2, r.c3] = r.layer
    assert len(got) == sum(map(len, found.values())) and found == {s: layers_by_removal(own) for s, own in scopes.items()}


LINE = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"
SALE = "sale_id long, client_id long, sold_at timestamp_ntz"
ITEM = "item_id long, name string, brand string, kind string, size int, price double"
DAY = datetime.datetime(2024, 1, 1, 23, 30)


def odd_tables(seed=4, lines=700):
    r = random.Random(seed)
    some = lambda values: r.choice(values)
    items = [(i, "n", some(["a", "b", None]), "k", 1, some([None, 0.0, 0.004, 1.25, 20.0, 99.99, float("nan")])) for i in range(1, 16)]
    sales = [(i, 1, some([None, DAY, DAY + datetime.timedelta(days=r.randint(0, 9))])) for i in range(1, 40)]
    rows = [
        (some([None, *range(1, 45)]), 1, some([None, *range(1, 18)]), some([None, *range(1, 9)]), some([None, 0, 1, 2, 5]), some([None, 0.0, 1.005, 12.34, -3.1, float("inf"), float("nan"), 1e300]), some([None, 0.0, 0.05, 0.1, 1.5]), "x",
         some([None, DAY + datetime.timedelta(days=r.randint(-2, 30))]))
        for _ in range(lines)
    ]
    return rows + rows[:50], sales, items


def offers_by_brute_force(lines, sales, items):
    cents = lambda x: math.floor(100 * x + 0.5) if x is not None and math.isfinite(x) and abs(x) < 1e13 else None
    item, sold = {i[0]: (i[2], cents(i[5])) for i in items}, {s[0]: s[2] for s in sales}
    own = {}
    for sale, _, i, v, q, amount, discount, _, shipped in lines:
        if i is not None and v is not None:
            days = (shipped.date() - sold[sale].date()).days if shipped and sold.get(sale) else None
            own.setdefault((i, v), []).append((q, cents(amount), cents(discount), days))
    floor = lambda a, b: None if not b else math.floor(Fraction(a, b))
    out = {}
    for (i, v), rows in own.items():
        brand, p = item.get(i, (None, None))
        priced = [(q, c, d) for q, c, d, _ in rows if None not in (q, c, d)]
        price = floor(sum(c * (100 - d) for _, c, d in priced), p * sum(q for q, _, _ in priced)) if p is not None and p >= 1 else None
        ds, days, qs = ([r[k] for r in rows if r[k] is not None] for k in (2, 3, 0))
        out[i, v] = (brand, price, floor(sum(ds), len(ds)), floor(sum(days), len(days)), max(qs, default=None))
    return out


def test_offers_of_odd_lines(spark):
    tables = odd_tables()
    lines, sales, items = (spark.createDataFrame(rows, kind) for rows, kind in zip(tables, (LINE, SALE, ITEM), strict=True))
    lines = lines.withColumns({c: F.lit("x") for c in ("scope", "layer", "part", "brand", "p", "_days", "n_equal")})
    expected = offers_by_brute_force(*tables)
    cost = {k: (NULL if p is None else p, NULL if d is None else -d, NULL if t is None else t, NULL if q is None else -q) for k, (_, p, d, t, q) in expected.items()}
    every = layers_by_removal(cost.values())
    types = {b: layers_by_removal([cost[k] for k, o in expected.items() if o[0] == b]) for b in {o[0] for o in expected.values()}}
    equal = list(cost.values())
    for block in (7, 100_000):
        got = {(r.item_id, r.vendor_id): tuple(r)[2:] for r in pareto.offer_layers(lines, sales, items, block=block).collect()}
        assert got == {k: (*o, types[o[0]].get(cost[k], 0), every.get(cost[k], 0), equal.count(cost[k])) for k, o in expected.items()}


def test_empty_and_repeated_tables(spark):
    lines, sales, items = (spark.createDataFrame([], kind) for kind in (LINE, SALE, ITEM))
    assert pareto.offer_layers(lines, sales, items).count() == 0
    one = spark.createDataFrame([(1, 1, 2, 3, 4, 5.0, 0.1, "x", DAY)] * 3, LINE)
    assert [tuple(r) for r in pareto.offer_layers(one, sales, items).collect()] == [(2, 3, None, None, 10, None, 4, 1, 1, 1)]
    assert [r.price for r in pareto.offer_layers(one, sales, spark.createDataFrame([(2, "n", "b", "k", 1, 2.0)] * 2, ITEM)).collect()] == [500 * 90 * 3 // (200 * 12)]


def test_floor_of_negative_sums(spark):
    rows = spark.createDataFrame([(-7, 2), (7, 2), (7, -2), (-7, -2), (0, 3), (5, 0), (-6, 3)], "a long, b long").select(F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)"))
    assert [r[0] for r in rows.select(pareto.floored(F.col("a"), F.col("b"))).collect()] == [-4, 3, -4, 3, 0, None, -2]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
def test_query_equals_its_sql(spark):
    got = pareto.op11_pareto(spark, FOLDER)
    own = connect(FOLDER).execute(f"SELECT {', '.join(got.columns)} FROM ({pareto.SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(own, key=str) and len(own) > 4000
