"""Clients' models against loops over clients, the arbitration in the cascade, and the text model itself."""

import datetime
import pickle
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import local
from tallyforge.operators.textmodel import TextModel, Vectors, char_terms, word_terms
from tallyforge.plans import engine
from tests.test_engine import EXAMPLES, base, movement

KIND = "client_id string, ord long, date date, text string, direction string, financial_account string, amount decimal(18,2), counterpart string, standard_history string"


def test_terms():
    assert word_terms("Luz a da Rua luz") == ["luz", "da", "rua", "luz", "luz da", "da rua", "rua luz"]
    assert char_terms("a bc") == [" a ", " bc", "bc ", " bc "]


def test_vectors_are_of_unit_length_in_each_block():
    texts = ["conta de luz", "conta de agua", "luz da rua", "conta"]
    vectors = Vectors(texts)
    row, column, weight = vectors.of(texts)
    words = len(vectors.places[0])
    assert set(vectors.places[0]) == {"conta", "de", "luz", "conta de"}
    for i in range(4):
        for block in (column < words, column >= words):
            own = weight[(row == i) & block]
            assert abs((own**2).sum() - 1) < 1e-9
    idf = np.log(5 / 3) + 1
    assert abs(weight[(row == 2) & (column == vectors.places[0]["luz"])][0] - 1) < 1e-9 and abs(vectors.idf[vectors.places[0]["luz"]] - idf) < 1e-9


def test_the_text_model_learns_and_does_not_depend_on_order():
    texts = ["energia eletrica %d" % i for i in range(6)] + ["agua e esgoto %d" % i for i in range(6)] + ["once"]
    labels = ["luz"] * 6 + ["agua"] * 6 + ["rare"]
    a, order = TextModel(texts, labels), random.Random(1).sample(range(13), 13)
    b = TextModel([texts[i] for i in order], [labels[i] for i in order])
    assert a.labels == ["agua", "luz"] and np.array_equal(a.weights, b.weights)
    p = a.predict(["conta de energia", "esgoto", "zzz"])
    assert p.argmax(1)[:2].tolist() == [1, 0] and np.allclose(p.sum(1), 1)
    assert not TextModel(["x", "y"], ["a", "b"]).ready and not TextModel([], []).ready


def examples(seed=3, clients=4):
    r = random.Random(seed)
    words = {"1": ["energia", "luz", "eletrica"], "2": ["agua", "esgoto"], "3": ["aluguel", "sala"], "x": ["erro"]}
    rows = []
    for i in range(260):
        c = r.choice(list(words))
        text = " ".join(r.choice(words[c]) for _ in range(r.randint(1, 3))) + r.choice(["", " filial", " matriz"])
        rows.append(("c%d" % r.randint(1, clients), i, datetime.date(2026, r.randint(1, 9), 3), text, r.choice(["inflow", "outflow"]), r.choice(["7", "8"]), r.choice([None, Decimal("10.50"), Decimal("0.00"), Decimal("7.25")]), c, r.choice(["h" + c, "", None])))
    rows += [("lone", 900, datetime.date(2026, 1, 1), "unico", "inflow", "7", None, "5", None), ("late", 901, datetime.date(2026, 12, 1), "tarde", "inflow", "7", None, "5", None)]
    return rows


def features(text, direction, account, amount=None):
    head = f"direcao_{direction} banco_{account}"
    if amount:
        head += f" valor_{int(abs(amount) * 100)} ordem_{len(str(int(abs(amount))))}"
    return f"{head} {text}"


def by_loop(rows, probes, period):
    out = {}
    for client in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == client and r[2].isoformat()[:7] < period and r[7].isdigit()]
        heads = {}
        for head, column in (("account", 7), ("history", 8)):
            mine = [(features(*r[3:7]), features(*r[3:6]), r[column], r[1]) for r in own if r[column]]
            if not mine:
                continue
            seen = [{}, {}]
            for row in mine:
                for k in (0, 1):
                    seen[k].setdefault(row[k], set()).add(row[2])
            exact = [{f: next(iter(s)) for f, s in x.items() if len(s) == 1} for x in seen]
            n = Counter(row[2] for row in mine)
            most = min(n, key=lambda y: (-n[y], min(row[3] for row in mine if row[2] == y)))
            heads[head] = exact, TextModel([row[0] for row in mine], [row[2] for row in mine]), most
        for c, ord_, text, direction, account, amount in probes:
            if c != client or account is None or not text.strip() or "account" not in heads:
                continue
            told = {}
            for head, (exact, model, most) in heads.items():
                with_amount, without = features(text, direction, account, amount), features(text, direction, account)
                label = exact[0].get(with_amount) or exact[1].get(without)
                if label:
                    told[head] = (label, 1.0, "exact_memory")
                elif model.ready:
                    p = model.predict([with_amount])[0]
                    told[head] = (model.labels[int(p.argmax())], round(float(p.max()), 9), "client_tfidf")
                else:
                    told[head] = (most, 0.0, "client_majority")
            history = told.get("history", (None, None, None))
            out[ord_] = (*told["account"], *history, min(told["account"][1], 1.0 if history[1] is None else history[1]))
    return out


def test_clients_models_equal_a_loop(spark):
    rows = examples()
    r = random.Random(9)
    probes = [("c%d" % r.randint(1, 5), 5000 + i, *r.choice([(x[3], x[4], x[5], x[6]) for x in rows] + [("energia sala", "inflow", "7", None), ("novo texto", "outflow", "8", Decimal("3.00")), (" ", "inflow", "7", None), ("luz", "inflow", None, None)])) for i in range(120)]
    probes += [("lone", 7000, "outro texto", "inflow", "7", None), ("late", 7001, "tarde", "inflow", "7", None), ("nobody", 7002, "luz", "inflow", "7", None)]
    asked = spark.createDataFrame(probes, "client_id string, ord long, text string, direction string, financial_account string, amount decimal(18,2)")
    got = local.predicted(spark.createDataFrame(rows, KIND), asked, "2026-09").collect()
    rounded = lambda x: None if x is None else round(x, 9)
    found = {x.ord: (x.counterpart, rounded(x.p), x.source, x.standard_history, rounded(x.hp), x.hsource, rounded(x.combined)) for x in got}
    expected = by_loop(rows, probes, "2026-09")
    assert found == {k: (*v[:6], rounded(v[6])) for k, v in expected.items()}
    assert {v[2] for v in expected.values()} == {"exact_memory", "client_tfidf", "client_majority"} and len(got) > 90


def test_large_clients_are_split_and_bounded(spark):
    rows = spark.createDataFrame(examples(), KIND)
    heads = local.head_rows(rows, "2026-09")
    few = local.bounded(heads, ["client_id", "head"], 10).groupBy("client_id", "head").count().collect()
    assert all(r["count"] <= 10 for r in few) and sum(r["count"] == 10 for r in few) >= 6
    models = local.classifiers(heads, ["client_id", "head"])
    asked = heads.select("client_id", "head", "ord", "features")
    a, b = ({(r.client_id, r.head, r.ord): (r.label, round(r.probability, 9)) for r in local.classified(models, asked, ["client_id", "head"], most).collect()} for most in (7, 5_000))
    assert a == b and len(a) > 200


def test_training_over_several_tasks_takes_the_steps_of_one(spark):
    rows = [(r[0], features(*r[3:6]) + f" n{r[1] % 40}", "k" + r[7]) for r in examples() if r[0].startswith("c")]
    rows += [("c1", "once", "rare"), ("small", "x", "a"), ("small", "y", "b")]
    df = spark.createDataFrame(rows, "client_id string, features string, label string")
    got = {r.client_id: pickle.loads(r.model) for r in local.classifiers(df, ["client_id"], most=15, rounds=3).collect()}
    assert set(got) == {"c1", "c2", "c3", "c4"}
    for client, model in got.items():
        own = [r for r in rows if r[0] == client]
        one = TextModel([r[1] for r in own], [r[2] for r in own], rounds=3)
        assert model.labels == one.labels and model.vectors.places == one.vectors.places and np.allclose(model.vectors.idf, one.vectors.idf)
        assert np.allclose(model.weights, one.weights, atol=1e-9) and np.allclose(model.bias, one.bias, atol=1e-9)


def test_every_row_counts_in_training(spark):
    """Rows beyond what one task holds were left out of the training before."""
    rows = [("c", i, datetime.date(2026, 1, 1), f"conta {i % 5} parte {i % 3}", "inflow", "7", None, str(1 + (i % 5 == 0) + (i % 7 == 0)), None) for i in range(local.MOST + 3_000)]
    asked = spark.createDataFrame([("c", 1, "conta nova", "inflow", "7", None)], "client_id string, ord long, text string, direction string, financial_account string, amount decimal(18,2)")
    got = local.predicted(spark.createDataFrame(rows, KIND), asked).first()
    model = TextModel([features(*r[3:6]) for r in rows], [r[7] for r in rows])
    assert (got.source, round(got.p, 9)) == ("client_tfidf", round(float(model.predict([features("conta nova", "inflow", "7")]).max()), 9))


def test_folds_equal_a_loop(spark):
    rows = [(r[0], r[1], r[2], features(*r[3:6]), "k" + r[7]) for r in examples() if r[0].startswith("c")]
    got = local.without_each(spark.createDataFrame(rows, "client_id string, ord long, date date, features string, label string")).collect()
    expected = {}
    for client in {r[0] for r in rows}:
        last = max(r[2] for r in rows if r[0] == client).isoformat()[:7]
        own = [r for r in rows if r[0] != client and r[2].isoformat()[:7] < last]
        model, known = TextModel([r[3] for r in own], [r[4] for r in own]), {r[4] for r in own}
        for r in rows:
            if r[0] == client:
                p = model.predict([r[3]])[0]
                expected[r[1]] = (client, r[4], r[4] in known, model.labels[int(p.argmax())], round(float(p.max()), 9))
    assert {x.ord: (x.client_id, x.actual, x.seen, x.label, round(x.probability, 9)) for x in got} == expected
    metrics = {m.client_id: m for m in local.fold_metrics(spark.createDataFrame(got)).collect()}
    own = [v for v in expected.values() if v[0] == "c1"]
    assert metrics["c1"].rows == len(own) and abs(metrics["c1"].top_1 - sum(v[1] == v[3] for v in own) / len(own)) < 1e-9


def test_every_row_of_the_others_counts(spark):
    """Rows beyond a sample were left out of the training before, and labels that are only there were unseen."""
    most = local.MOST + 3_000
    df = spark.range(most).select((F.col("id") % 2).cast("string").alias("client_id"), F.col("id").alias("ord"), F.to_date(F.lit("2026-01-05")).alias("date"), F.concat(F.lit("conta "), F.col("id") % 5).alias("features"), F.concat(F.lit("k"), F.when(F.col("id") % 5 == 0, 1).otherwise(2)).alias("label"))
    late = spark.createDataFrame([(c, most + i, datetime.date(2026, 2, 5), "conta 0", "k1") for i, c in enumerate("01")], df.schema)
    rare = spark.range(2).select(F.col("id").cast("string").alias("client_id"), (F.col("id") + 2 * most).alias("ord"), F.to_date(F.lit("2026-01-05")).alias("date"), F.lit("raro").alias("features"), F.lit("rare").alias("label"))
    rows = df.unionByName(late).unionByName(rare)
    got = {x.ord: x for x in local.without_each(rows).where(F.col("ord") >= most).collect()}
    own = [r for r in rows.collect() if r.client_id == "1" and r.date.month == 1]
    model = TextModel([r.features for r in own], [r.label for r in own])
    assert round(got[most].probability, 9) == round(float(model.predict(["conta 0"]).max()), 9) and got[2 * most].seen and got[2 * most + 1].seen


@pytest.mark.parametrize("threshold,far,expected", [(0.9, None, ("exact_memory:1.00", "LANCAR")), (1.1, None, ("exact_memory:1.00", "REVISAR CONTA")), (1.1, 0.8, ("global_tfidf:0.80", "LANCAR")), (1.1, 0.7, ("exact_memory:1.00", "REVISAR CONTA"))])
def test_arbitration_in_the_cascade(spark, threshold, far, expected):
    b = base(spark, [movement("50", "recebimento", "ACME")], history=[], examples=EXAMPLES)
    common = None if far is None else lambda open_: open_.select("ord", F.lit("31").alias("counterpart"), F.lit(far).alias("probability"))
    r = engine.generate(b, "2026-08", client_threshold=threshold, far=common, far_threshold=0.75).first()
    assert r.reason.split("|")[0] == expected[0] and r.status == expected[1]


def test_an_unknown_text_gets_the_majority_for_review(spark):
    b = base(spark, [movement("50", "texto novo", "ninguem")], history=[], examples=EXAMPLES)
    r = engine.generate(b, "2026-08", client_threshold=0.9).first()
    assert r.status == "REVISAR CONTA" and r.reason.startswith(("client_majority:0.00", "client_tfidf:"))
