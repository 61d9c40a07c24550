"""The prefix-filtered candidate search against all pairs, with words that most texts share, ties and small sets."""

import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions.text import bounded_ratio, words
from tallyforge.operators import matching


def books(seed, n=120):
    """Texts of one to seven words; one word is in most of them."""
    r = random.Random(seed)
    vocabulary = ["boleto", "tarifa", "energia", "aluguel", "imposto", "cliente", "fornecedor", "seguro", "telefone", "frete", "salario", "adiantamento"]
    text = lambda: " ".join((["transferencia"] if r.random() < 0.7 else []) + r.sample(vocabulary, r.randint(0, 6)))
    history = [(i, r.choice("1234"), r.choice("1239"), "h%d" % (i % 5), text()) for i in range(n)]
    asked = [(1000 + i, r.choice(["inflow", "outflow"]), r.choice(["1", "2", "3", "7", None]), text()) for i in range(n)]
    return history, asked


def by_all_pairs(history, asked, money, with_sequence, least=0.5):
    stop = {"transferencia"} & set()
    set_of = lambda t: {w for w in t.split() if len(w) > 2} - stop
    out = {}
    for ord_, direction, account, text in asked:
        side = 1 if direction == "inflow" else 2
        x = set_of(text)
        if account is None or not x:
            continue
        pool = [h for h in history if h[side] == account] or [h for h in history if h[side] in money]
        best = None
        for h in pool:
            y = set_of(h[4])
            if not y:
                continue
            score = len(x & y) / min(len(x), len(y))
            if with_sequence:
                score = 0.75 * score + 0.25 * SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio()
            if best is None or score > best[1] + 1e-12:
                best = (h[3 - side], score, h[3])
        if best and best[1] >= least:
            out[ord_] = (best[0], best[2], round(best[1], 9))
    return out


@pytest.mark.parametrize("with_sequence", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_best_history_equals_all_pairs(spark, seed, with_sequence):
    history, asked = books(seed)
    h = spark.createDataFrame(history, "ord long, debit_account string, credit_account string, standard_history string, complement string")
    m = spark.createDataFrame(asked, "ord long, direction string, financial_account string, text string")
    financial = spark.createDataFrame([("1",), ("2",), ("3",)], "reduced_code string")
    got = {r.ord: (r.counterpart, r.standard_history, round(r.score, 9)) for r in matching.best_history(m, h, financial, with_sequence).collect()}
    assert got == by_all_pairs(history, asked, {"1", "2", "3"}, with_sequence) and len(got) > 50


@pytest.mark.parametrize("hot", [3, 20_000])
def test_candidates_miss_no_pair_and_join_no_common_word(spark, hot):
    r = random.Random(7)
    # each text has the common word and four rare ones: three texts in four share nothing else
    text = lambda i: " ".join(sorted(["common", *("w%d" % r.randint(0, 400) for _ in range(4))]))
    left, right = [text(i) for i in range(150)], [text(i) for i in range(150)]
    texts = spark.createDataFrame([("k", t) for t in dict.fromkeys(left)], "key string, line string")
    rows = spark.createDataFrame([("k", t, i) for i, t in enumerate(dict.fromkeys(right))], "key string, line string, h_ord long").withColumn("h", F.struct(F.lit("c").alias("counterpart"), F.lit("s").alias("standard_history")))
    found = {(p.m_line, p.h_line) for p in matching.containment_candidates(texts, rows, ["key"], hot=hot).collect()}
    share = lambda a, b: len(set(a.split()) & set(b.split())) / min(len(set(a.split())), len(set(b.split())))
    able = {(a, b) for a in left for b in right if share(a, b) > 1 / 3}
    assert able <= found and len(found) < 0.2 * len(left) * len(right)


def test_needed_words(spark):
    sizes = spark.range(1, 13).select(F.col("id").cast("int").alias("n"))
    got = [(r.a, r.b) for r in sizes.select(matching.needed(F.col("n"), 0.5, True).alias("a"), matching.needed(F.col("n"), 0.5, False).alias("b")).collect()]
    # more than a third of the words where the ratio must make up for the rest, half of them without it
    assert got == [(min(n, n // 3 + 1), max(1, -(-n // 2))) for n in range(1, 13)]


def test_bound_of_common_letters(spark):
    r = random.Random(3)
    line = lambda: " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 4)))
    rows = [(line(), line(), r.random()) for _ in range(400)] + [("", "", 0.9), ("ção", "cao", 0.9)]
    got = spark.createDataFrame(rows, "a string, b string, least double").select("a", "b", "least", bounded_ratio("a", "b", F.col("least")).alias("x")).collect()
    for row in got:
        exact = SequenceMatcher(None, row.a, row.b).ratio()
        assert row.x == exact if row.x is not None else exact < row.least
    assert any(row.x is None for row in got)


def test_scores_equal_a_function_of_the_database(spark):
    """The same cascade as SQL, with the sequence ratio as a function of DuckDB."""
    history, asked = books(5, 80)
    con = duckdb.connect()
    con.create_function("ratio", lambda a, b: SequenceMatcher(None, a, b).ratio(), ["VARCHAR", "VARCHAR"], "DOUBLE")
    h = spark.createDataFrame(history, "ord long, debit_account string, credit_account string, standard_history string, complement string")
    m = spark.createDataFrame(asked, "ord long, direction string, financial_account string, text string")
    lines = lambda df, c: df.withColumn("ws", words(F.col(c))).toPandas()
    hp, mp = lines(h, "complement"), lines(m, "text")  # noqa: F841
    expected = con.execute("""
        WITH side AS (SELECT ord, 'inflow' AS direction, debit_account AS account, credit_account AS counterpart, list_sort(ws) AS ws FROM hp UNION ALL SELECT ord, 'outflow', credit_account, debit_account, list_sort(ws) FROM hp),
        asked AS (SELECT *, list_sort(ws) AS w FROM mp WHERE financial_account IS NOT NULL AND len(ws) > 0),
        pair AS (SELECT a.ord, s.ord AS h, s.counterpart, a.w, s.ws FROM asked a JOIN side s ON s.direction = a.direction AND len(s.ws) > 0
          AND CASE WHEN EXISTS (SELECT 1 FROM side e WHERE e.direction = a.direction AND e.account = a.financial_account) THEN s.account = a.financial_account ELSE s.account IN ('1', '2', '3') END),
        scored AS (SELECT ord, h, counterpart, 0.75 * len(list_intersect(w, ws)) / least(len(w), len(ws)) + 0.25 * ratio(array_to_string(w, ' '), array_to_string(ws, ' ')) AS score FROM pair)
        SELECT ord, arg_max(counterpart, (round(score, 12), -h)), round(max(score), 9) FROM scored GROUP BY ord HAVING max(score) >= 0.5""").fetchall()
    financial = spark.createDataFrame([("1",), ("2",), ("3",)], "reduced_code string")
    got = [(r.ord, r.counterpart, round(r.score, 9)) for r in matching.best_history(m, h, financial).collect()]
    assert sorted(got) == sorted(expected)
