"""Every document goes to exactly one adapter, and to no recipe of another family."""

from pyspark.sql import functions as F

from tallyforge.operators import layout

TITLES = {n: list(needs) for n, _, kind, needs in layout.ADAPTERS if kind == "sheet"}


def routed(spark, rows, recipes=layout.RECIPES, least=layout.REUSE_AT):
    docs = spark.createDataFrame(rows, "doc string, source string, text string, titles array<string>")
    return {r.doc: r for r in layout.routed(docs, layout.recipe_table(spark, recipes), least=least).collect()}


def test_nine_adapters_and_the_rest(spark):
    rows = [(n, kind, " / ".join(needs) if kind == "printed" else None, list(needs) if kind == "sheet" else []) for n, _, kind, needs in layout.ADAPTERS]
    rows += [("none", "sheet", None, ["X", "Y"]), ("null", "sheet", None, None), ("empty", "printed", "", []), ("other source", "image", "entrada saldo inicial", ["DATA"])]
    got = routed(spark, rows)
    assert len(got) == len(rows) and all(got[n].adapter == n for n, *_ in layout.ADAPTERS)
    assert all(got[n].adapter is None and got[n].code == "unsupported_layout" for n in ("none", "null", "empty", "other source"))
    # a recognised chart has no saved recipe: its columns wait for confirmation
    assert got["chart-of-accounts"].code == "columns_not_confirmed" and got["itau-spreadsheet-bank-statement-v1"].recipe == "itau-spreadsheet-bank-statement-v1"


def test_the_first_adapter_wins(spark):
    both = ["DATA", "ENTRADA", "SAIDA", "SALDO", "LANCAMENTO", "VALORR", "SALDOR"]
    got = routed(spark, [("both", "sheet", None, both), ("history too", "sheet", None, ["DATA", "LANCAMENTO", "DCTO", "CREDITO", "DEBITO", "SALDO", "VALOR"])])
    assert got["both"].adapter == "cash-ledger-spreadsheet-v1" and got["history too"].adapter == "bradesco-net-empresa-xls-v1"


def test_recipes_of_another_family_do_not_match(spark):
    titles = TITLES["cash-ledger-spreadsheet-v1"]
    bank = ("bank-v1", "bank_statement", None, tuple(titles), ())
    assert routed(spark, [("d", "sheet", None, titles)], [bank])["d"].code == "columns_not_confirmed"
    got = routed(spark, [("d", "sheet", None, titles)], [bank, ("cash-v1", "cash_ledger", None, tuple(titles), ()), ("cash-v2", "cash_ledger", None, tuple(titles), ())])
    assert got["d"].recipe == "cash-v1" and got["d"].similarity == 1.0 and got["d"].code is None


def test_similarity_by_a_loop(spark):
    titles = [["DATA", "VALOR"], ["DATA", "DATA", "LANCAMENTO", "VALOR", "SALDO"], [], ["Q"], ["DATA", "LANCAMENTO", "CREDITO", "DEBITO", "SALDO", "X"]]
    docs = spark.createDataFrame(list(enumerate(titles)), "doc int, titles array<string>")
    got = {r.doc: (r.recipe, round(r.similarity, 9)) for r in layout.best_recipe(docs, layout.recipe_table(spark), 0.3).collect()}
    expected = {}
    for i, t in enumerate(titles):
        best = max(((len(set(t) & set(r[3])) / len(set(t) | set(r[3])) if t else 0.0, -k) for k, r in enumerate(layout.RECIPES)), default=None)
        if best and best[0] >= 0.3:
            expected[i] = (layout.RECIPES[-best[1]][0], round(best[0], 9))
    assert got == expected
    assert docs.select(layout.adapter_of(F.lit("sheet"), F.lit(None).cast("string"), F.col("titles"))).count() == 5
