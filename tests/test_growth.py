"""What grows with the documents: it is neither broadcast nor one task's."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.lineage import tasks
from tallyforge.operators import accounts, layout, normalize
from tallyforge.plans import catalogue_more, views

CELLS = "doc int, sheet_ord int, row_number int, column int, value string, formula string, calculated_value string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def cells(spark):
    rows = [(1, 0, 1, 1, "Data"), (1, 0, 1, 2, "Entrada"), (1, 0, 1, 3, "Data"), (1, 0, 2, 1, "01/02/2024"), (1, 0, 2, 2, "5,00"), (2, 0, 1, 1, "x"), (2, 0, 1, 2, "--")]
    return spark.createDataFrame([(*r, None, None) for r in rows], CELLS)


def test_headers_are_not_broadcast_to_their_cells(spark, cells):
    header = spark.createDataFrame([(1, 0, 1, {"date": 1, "inflow": 2})], "doc int, sheet_ord int, row_number int, columns map<string,int>")
    out = normalize.records(cells, header)
    assert "BroadcastHashJoin" not in plan(out)
    assert [(r.row_number, r["values"]) for r in out.collect()] == [(2, {"date": "01/02/2024", "inflow": "5,00"})]


def test_a_row_meets_its_titles_once(spark, cells):
    rows = layout.mapped_rows(cells, layout.alias_table(spark, {"date": ("DATA",), "day": ("DATA",), "inflow": ("ENTRADA",)}))
    assert plan(rows).count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan(rows)
    got = {(r.doc, r.row_number): (r.n_cells, r.titles, r.columns) for r in rows.collect()}
    assert got == {(1, 1): (3, ["DATA", "ENTRADA", "DATA"], {"date": 1, "day": 1, "inflow": 2}), (1, 2): (2, ["01022024", "500"], None), (2, 1): (2, ["X"], None)}


def test_proposals_are_not_broadcast(spark, cells):
    header = spark.createDataFrame([(1, 0, 1)], "doc int, sheet_ord int, row_number int")
    out = layout.proposals(cells, header)
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted((r.column, r.field) for r in out.collect() if r.field) == [(2, "inflow"), (3, "date")]


def test_found_recipes_are_not_broadcast_to_documents(spark):
    docs = spark.createDataFrame([(1, "sheet", None, ["DATA", "ENTRADA", "SAIDA", "SALDO"]), (2, "sheet", None, ["X"])], "doc int, source string, text string, titles array<string>")
    out = layout.routed(docs, layout.recipe_table(spark))
    assert plan(out).count("SortMergeJoin") == 1
    assert sorted((r.doc, r.adapter, r.recipe) for r in out.collect()) == [(1, "cash-ledger-spreadsheet-v1", "cash-ledger-report-v1"), (2, None, None)]


@pytest.mark.parametrize("made", [lambda s, d: catalogue_more._cells(s, d), lambda s, d: views.dealt(s, d, "orders")])
def test_what_is_made_of_a_small_file_is_many_tasks(spark, made):
    out = made(spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() == tasks(out) > 1


def test_a_common_code_is_not_one_task(spark):
    chart = spark.range(20_000).select(F.col("id").cast("string").alias("reduced_code"), F.concat(F.lit("key "), "id").alias("semantic_key"))
    rows = spark.range(0, 3_000, 1, 3).select(F.when(F.col("id") % 3 == 0, "x").otherwise((F.col("id") % 5).cast("string")).alias("counterpart"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        out = accounts.resolved(rows, chart)
        got = {(r.counterpart, r.semantic_key, r.reject): r.n for r in out.groupBy("counterpart", "semantic_key", "reject").agg(F.count(F.lit(1)).alias("n")).collect()}
        out.collect()
        final = plan(out).split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == {("x", None, "counterpart_not_in_chart"): 1000} | {(str(i), f"key {i}", None): 400 for i in range(5)}
    assert "BroadcastHashJoin" in final


def test_small_workbooks_share_a_frame(spark, monkeypatch):
    from tallyforge.sources import workbooks

    made = catalogue_more._workbook_bytes(pd.Series([7, 8, 9]))
    held = {}
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInPandas", lambda self, f, schema: held.update(run=f) or self)
    workbooks.xlsx_cells(spark.createDataFrame([("a", bytearray(b""))], "sha256 string, content binary"))
    frames = list(held["run"]([pd.DataFrame({"sha256": ["a", "b", "c", "d"], "content": [made[0], b"no", made[1], made[2]]})]))
    assert len(frames) == 1
    assert [(d, len(g), set(g["issue"])) for d, g in frames[0].groupby("doc")] == [("a", 4, {None}), ("b", 1, {"invalid_xlsx"}), ("c", 4, {None}), ("d", 4, {None})]


def test_an_invoice_is_parsed_once(spark):
    from tallyforge.sources import invoices

    head = '<n:NFSe xmlns:n="http://www.sped.fazenda.gov.br/nfse" versao="1.01">'
    body = '<n:infNFSe n:Id="no" Id="NFS7"><n:nNFSe> 4<!-- x --><![CDATA[2]]>&amp; </n:nNFSe><n:nNFSe>9</n:nNFSe><n:cStat> </n:cStat><n:cStat>1</n:cStat><n:DPS><n:infDPS><n:prest><n:CPF>5</n:CPF></n:prest><n:toma/></n:infDPS></n:DPS></n:infNFSe>'
    docs = spark.createDataFrame([("a", head + body + "</n:NFSe>"), ("broken", head + body), ("none", None)], "doc string, xml string")
    out = invoices.normalized(docs.repartition(3))
    assert "xpath_string" not in plan(out)
    (r,) = out.collect()
    assert (r.doc, r.key, r.number, r.status) == ("a", "7", "42&", None)
    assert (r.provider.tax_id, r.provider.tax_id_type, r.customer.tax_id, r.intermediary) == ("5", "CPF", None, None)
    assert r.customer is not None and r.provenance == {"number": "/NFSe/infNFSe/nNFSe"}
    # texts are read behind the dealing of rows, not in the tasks of their file
    lines = plan(out).split("Initial Plan")[0].split("\n")
    at = lambda w: [i for i, x in enumerate(lines) if w in x]
    assert max(at("ArrowEvalPython")) < min(at("Exchange"))


def test_a_text_is_trained_on_once(spark, monkeypatch):
    from tallyforge.operators import models

    rows = [(f"pago {w} {k}", w if i % 5 else "luz") for i, (w, k) in enumerate([(w, k) for w in ("agua", "luz", "gas") for k in ("um", "dois", "um")] * 40)]
    df = spark.createDataFrame([*rows, ("only once", "single")], "features_text string, label string")
    held, plain = [], models.LogisticRegression.fit
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, data, *a: held.append(data.count()) or plain(self, data, *a))
    model = models.fit(df, 1 << 8)
    assert held == [len(set(rows))]
    eligible = df.where("label <> 'single'").withColumn("grams", models.char_ngrams(F.col("features_text")))
    alike = models.classifier(1 << 8).fit(eligible)
    assert model.stages[0].labels == alike.stages[0].labels
    asked = df.distinct()
    got = {(r.features_text, r.label): (r.predicted, r.confidence, r.ranked) for r in models.predict_texts(model, asked).collect()}
    assert len(got) == asked.count()
    for r in models.predict(alike, asked).collect():
        mine = got[r.features_text, r.label]
        assert (mine[0], mine[2]) == (r.predicted, r.ranked) and abs(mine[1] - r.confidence) < 1e-4


def test_equal_texts_of_the_history_are_read_once(spark, monkeypatch):
    from tallyforge.operators import matching

    read, plain = spark.sparkContext.accumulator(0), matching.words

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    monkeypatch.setattr(matching, "words", lambda text: plain(counted(text)))
    history = spark.range(2_000).select((F.col("id") + 5).alias("ord"), F.lit("1").alias("debit_account"), (F.col("id") % 7).cast("string").alias("credit_account"), F.concat(F.lit("h"), F.col("id") % 3).alias("standard_history"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("paid invoice "), F.element_at(F.array(*map(F.lit, ("rent", "water"))), (F.col("id") % 2 + 1).cast("int")))).alias("complement"))
    moved = spark.range(600).select(F.col("id").alias("ord"), F.lit("inflow").alias("direction"), F.when(F.col("id") % 2 == 0, "1").otherwise("9").alias("financial_account"), F.lit("water invoice").alias("text"))
    out = matching.best_history(moved, history, spark.createDataFrame([("3",)], "reduced_code string"), with_sequence=False)
    got = {tuple(r) for r in out.select("counterpart", "standard_history", "score").collect()}
    # the first row with a text of both words: account 1's own history, none for 9, whose pool on this side is empty
    assert got == {("1", "h1", 1.0)} and out.count() == 300
    assert read.value < 200


def test_equal_rows_of_clients_are_answered_once_and_counted_each(spark):
    import datetime

    from tallyforge.operators import local

    day = lambda m: datetime.date(2024, m, 1)
    rows = [(c, 7, day(m), f"pago {w}", w) for c in ("a", "b") for w in ("agua", "luz") for m in (1, 2, 3) for _ in range(5)] + [("a", 7, day(3), None, "luz")]
    df = spark.createDataFrame(rows, "client_id string, ord long, date date, features string, label string")
    got = {r.client_id: (r.rows, r.top_1) for r in local.fold_metrics(local.without_each(df)).collect()}
    assert set(got) == {"a", "b"} and (got["a"][0], got["b"]) == (31, (30, 1.0))


def test_equal_rows_of_a_text_model_are_one():
    import numpy as np

    from tallyforge.operators import textmodel

    texts, labels = ["pago agua", "pago luz", "pago agua", "luz", "pago agua"] * 8, ["a", "b", "a", "b", "b"] * 8
    seen, plain = [], textmodel.Vectors.of
    textmodel.Vectors.of = lambda self, t: seen.append(len(t)) or plain(self, t)
    try:
        model = textmodel.TextModel(texts, labels)
    finally:
        textmodel.Vectors.of = plain
    assert seen == [4]
    assert np.allclose(model.vectors.idf, textmodel.Vectors(texts).idf)
