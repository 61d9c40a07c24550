"""Running numbers over all rows, and the choice of statements, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import matching
from tallyforge.operators.ordering import numbered


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_numbers_follow_the_order(spark, partitions):
    r = random.Random(partitions)
    rows = [(r.choice(["a", "b", None]), r.randint(0, 5), "x%d" % r.randint(0, 3)) for _ in range(300)]
    got = sorted(numbered(spark.createDataFrame(rows, "book string, n int, text string").repartition(7), ["book", "n"], partitions=partitions).collect(), key=lambda x: x.ord)
    assert [x.ord for x in got] == list(range(1, 301))
    key = lambda x: (x[0] is not None, x[0] or "", x[1])
    assert [key(x) for x in got] == sorted(map(key, rows)) and sorted(map(str, (tuple(x)[:3] for x in got))) == sorted(map(str, rows))


def test_equal_keys_are_spread_over_partitions(spark):
    rows = spark.range(4000).select(F.lit("one book").alias("book"), F.col("id").alias("n"))
    out = numbered(rows, ["book"], partitions=8)
    per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) > 5 and max(per) < 1500 and out.agg(F.count_distinct("ord"), F.max("ord")).first()[:] == (4000, 4000)


def test_numbers_of_no_equal_and_many_rows(spark):
    assert numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0
    assert sorted(r.ord for r in numbered(spark.createDataFrame([(1,)] * 5, "a int"), ["a"]).collect()) == [1, 2, 3, 4, 5]
    # a book's numbers go on where the one before it ends, however many rows it has
    long = spark.range(200_100, numPartitions=4).select(F.when(F.col("id") < 200_050, 0).otherwise(1).alias("book"), F.col("id").alias("n"))
    first = numbered(long, ["book", "n"], partitions=8).groupBy("book").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).orderBy("book").collect()
    assert [tuple(r) for r in first] == [(0, 1, 200_050), (1, 200_051, 200_100)]


def statements_by_loop(ledgers, overlaps):
    found = {(a, b): n for a, b, n in overlaps}
    left = sorted({b for _, b, _ in overlaps})
    out = []
    for ledger, entries in sorted(ledgers, key=lambda x: (-x[1], x[0])):
        ranked = sorted(left, key=lambda s: (-found.get((ledger, s), 0), s))
        if ranked and found.get((ledger, ranked[0]), 0) >= max(1, entries // 2):
            out.append((ledger, ranked[0]))
            left.remove(ranked[0])
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_statements_are_chosen_as_by_a_loop(spark, seed):
    r = random.Random(seed)
    if seed == 0:  # a chain: each ledger's first choice is what the one before it takes
        ledgers = [("l%02d" % i, 20 - i) for i in range(8)]
        overlaps = [("l%02d" % i, "s%02d" % j, 20 - j) for i in range(8) for j in range(i + 1)] + [("l07", "s90", 7)]
    else:
        ledgers = [("l%02d" % i, r.choice([0, 1, 4, 4, 9])) for i in range(14)]
        overlaps = [("l%02d" % i, "s%02d" % j, r.choice([0, 1, 2, 2, 4, 5])) for i in range(15) for j in range(10) if r.random() < 0.5]
    got = matching.ledger_accounts(spark.createDataFrame(ledgers, "ledger string, entries long"), spark.createDataFrame(overlaps, "ledger string, statement string, overlap long"))
    known = {a for a, _ in ledgers}
    assert sorted(map(tuple, got.collect())) == statements_by_loop(ledgers, [o for o in overlaps if o[0] in known])


def test_comparison_without_a_key(spark):
    a = spark.createDataFrame([(2, "x"), (1, "y"), (5, None)], "ord long, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (9, None), (11, "more")], "ord long, v string")
    assert [tuple(r) for r in matching.compared(a, b, ["v"], []).collect()] == [(2, "v", "x", "z")]
    assert [tuple(r) for r in matching.count_mismatch(a, b, []).collect()] == [(3, 4)]
