import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import accounts, layout, matching, models, normalize, reconcile, regression

D = Decimal
DAY = datetime.date


def test_ancestors(spark):
    f = lambda c: spark.createDataFrame([(c,)], "c string").select(accounts.ancestors(F.col("c"))).first()[0]
    assert f("1.1.02.001") == ["1.0.00.000", "1.1.00.000", "1.1.02.000", "1.1.02.001"]
    assert f("12345678") == ["10000000", "12000000", "12300000", "12345000", "12345678"]
    assert f("77") == ["77"]


def test_greedy_transfer_pairing_equals_a_loop(spark):
    r = random.Random(5)
    events = [(i, DAY(2024, 1, r.randint(1, 2)), D(r.choice([-5, 5, -7, 7])), r.choice(["a", "b", "c"])) for i in range(200)]
    used, expected = set(), set()
    for i, (_, day, amount, account) in enumerate(events):
        if i in used:
            continue
        for j in range(i + 1, len(events)):
            o = events[j]
            if j not in used and o[1] == day and o[2] == -amount and o[3] != account:
                used |= {i, j}
                expected.add((i, j))
                break
    df = spark.createDataFrame(events, "ord long, date date, amount decimal(18,2), financial_account string")
    assert {tuple(x) for x in matching.mirrored_pairs(df).collect()} == expected


def test_nearest_row_and_page_repeats(spark):
    rows = spark.createDataFrame([("d", 1, 1, 100.0), ("d", 1, 2, 120.0)], "doc string, page int, ord int, top double")
    points = spark.createDataFrame([("d", 1, "a", 109.0), ("d", 1, "b", 110.0), ("d", 1, "c", 145.0)], "doc string, page int, id string, top double")
    assert {(r.id, r.row_ord) for r in matching.nearest(points, rows, ["doc", "page"]).collect()} == {("a", 1), ("b", 1)}
    lines = spark.createDataFrame([("d", 1, DAY(2024, 1, 1), D(5), "x ACME", 300.0), ("d", 2, DAY(2024, 1, 1), D(5), "ACME", 4.0), ("d", 2, DAY(2024, 1, 1), D(5), "ACME", 40.0)], "doc string, page int, date date, amount decimal(18,2), text string, top double")
    assert matching.without_page_repeats(lines).count() == 2


def test_ledger_takes_the_statement_with_half_its_rows(spark):
    ledgers = spark.createDataFrame([("big", 10), ("small", 4)], "ledger string, entries long")
    found = spark.createDataFrame([("big", "s1", 5), ("small", "s1", 4), ("small", "s2", 1)], "ledger string, statement string, overlap long")
    assert [tuple(r) for r in matching.ledger_accounts(ledgers, found).collect()] == [("big", "s1")]


def test_account_by_words_breaks_ties_by_activity(spark):
    names = spark.createDataFrame([("Banco Azul",), ("nada",)], "name string")
    chart = spark.createDataFrame([("1", "Banco Azul SA", 1), ("2", "Banco Verde", 2)], "reduced_code string, description string, ord int")
    active = spark.createDataFrame([("2", 9)], "reduced_code string, activity long")
    assert [tuple(r) for r in matching.account_by_words(names, chart, active).collect()] == [("Banco Azul", "1")]


def test_carried_and_continued(spark):
    rows = spark.createDataFrame([("d", 1, "a", True), ("d", 2, "b", False), ("d", 3, None, True)], "doc string, ord int, t string, starts boolean")
    assert [r.t for r in reconcile.carried(rows, "doc", "t").orderBy("ord").collect()] == ["a", "b", "b"]
    assert sorted((r.ord, r.t) for r in reconcile.continued(rows.na.fill("c", ["t"]), "doc", "starts", "t").collect()) == [(1, "a b"), (3, "c")]


def cells(spark, rows, doc="d"):
    out = [(doc, 0, r, c, v, None, None) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1) if v is not None]
    return spark.createDataFrame(out, "doc string, sheet_ord int, row_number int, column int, value string, formula string, calculated_value string")


STATEMENT = [["Banco X"], ["Período", "01/01/2024 a 31/01/2024"], ["Data", "Lançamento", "Valor", "Saldo"], ["31/12", "SALDO ANTERIOR", None, "1.000,00"], ["02/01", "PIX Acme", "-50,00", None], ["02/01", "S A L D O", None, "950,00"], ["03/01", "Depósito", "5,00", None]]


def test_statement_sheet(spark):
    c = cells(spark, STATEMENT)
    rows = layout.mapped_rows(c, layout.alias_table(spark))
    header = layout.first_header(rows)
    assert header.first().row_number == 3 and header.select(layout.family_of(F.col("columns"))).first()[0] == "bank_statement"
    period = normalize.printed_period(c)
    assert tuple(period.first())[1:] == (DAY(2024, 1, 1), DAY(2024, 1, 31))
    read = normalize.statement_rows(normalize.records(c, header), period)
    assert [(r.date, r.amount, r.transaction_type) for r in normalize.transactions(read).orderBy("ord").collect()] == [(DAY(2024, 1, 2), D("-50.00"), "debit"), (DAY(2024, 1, 3), D("5.00"), "credit")]
    head = normalize.statements(read).first()
    assert (head.initial_balance, head.final_balance, head.transactions) == (D("1000.00"), D("950.00"), 2)
    assert [(r.date, r.balance) for r in normalize.daily_balances(read).collect()] == [(DAY(2024, 1, 2), D("950.00"))]
    assert normalize.beside(c, "PERIODO").first().value == "01/01/2024 a 31/01/2024"


def test_ledger_sheet_fills_balances(spark):
    rows = [["Data", "Entrada", "Saída", "Saldo", "Anotações"], ["01/01/2024", "10,00", None, "110,00", "a"], ["02/01/2024", None, "5,00", None, "b"], ["03/01/2024", "1,00", None, None, None], ["x", "1,00", None, None, None]]
    c = cells(spark, rows)
    mapped = layout.mapped_rows(c, layout.alias_table(spark))
    header = layout.first_header(mapped)
    assert header.select(layout.family_of(F.col("columns"))).first()[0] == "cash_ledger"
    got = normalize.ledger_entries(normalize.records(c, header)).orderBy("ord").collect()
    assert [(r.inflow, r.outflow, r.balance) for r in got] == [(D("10.00"), D("0.00"), D("110.00")), (D("0.00"), D("5.00"), D("105.00")), (D("1.00"), D("0.00"), D("106.00"))]


def test_later_grids_never_count(spark):
    c = cells(spark, [["x", "y"], ["1", "2"], ["Data", "Valor"], ["Data", "Entrada", "Saída", "Saldo"]])
    assert layout.first_header(layout.mapped_rows(c, layout.alias_table(spark))).first().row_number == 3
    plain = cells(spark, [["q"], ["x", "y"], ["1", "2"]])
    assert layout.first_header(layout.mapped_rows(plain, layout.alias_table(spark))).first().row_number == 2


def test_formula_cells_use_their_cached_value(spark):
    df = spark.createDataFrame([("=A1", "7", None), (None, None, "8")], "formula string, calculated_value string, value string")
    assert [r[0] for r in df.select(layout.effective(F.col("formula"), F.col("calculated_value"), F.col("value"))).collect()] == ["7", "8"]


def test_proposals_give_each_field_once(spark):
    c = cells(spark, [["Data", "Dt", "Histórico", "Vlr", "Algo"], ["01/01/2024", "02/01/2024", "abc", "1,00", "12345678901"]])
    header = layout.first_header(layout.mapped_rows(c, layout.alias_table(spark)))
    got = {r.title: (r.field, r.confidence) for r in layout.proposals(c, header).collect()}
    assert got["Data"] == ("date", 1.0) and got["Dt"] == (None, None) and got["Histórico"] == ("description", 1.0) and got["Vlr"] == ("amount", 0.72) and got["Algo"] == ("tax_id", 0.45)


def test_recipes(spark):
    recipes = layout.recipe_table(spark)
    headers = spark.createDataFrame([("a", ["DATA", "LANCAMENTO", "VALORR", "SALDOR"]), ("b", ["X", "Y"])], "doc string, titles array<string>")
    assert [(r.doc, r.recipe) for r in layout.best_recipe(headers, recipes).collect()] == [("a", "itau-current-account-spreadsheet-v1")]
    new = spark.createDataFrame([(9, "ITAU-spreadsheet-bank-statement-v3", "bank_statement", "Itaú", ["Q"], [])], recipes.schema)
    both = layout.remembered(recipes, new)
    assert both.count() == recipes.count() + 1 and layout.remembered(both, new).count() == both.count()
    assert layout.next_id(both, "bank_statement", "Itau") == "ITAU-spreadsheet-bank-statement-v3"
    assert layout.catalog(recipes, new).count() == recipes.count() + 1


def test_confirmed_maps():
    assert layout.confirmed_map("cash", {"date": 1, "inflow": 2}, {1, 2}) == "cash_ledger"
    for family, columns in (("cash", {"date": 1}), ("bank", {"date": 1, "amount": 1, "description": 2}), ("other", {"date": 1}), ("cash", {"date": 1, "inflow": 5})):
        with pytest.raises(ValueError):
            layout.confirmed_map(family, columns, {1, 2})


def test_missing_fields_and_recognition(spark):
    df = spark.createDataFrame([({"date": 1, "credit": 2},)], "c map<string,int>")
    assert sorted(df.select(layout.missing_fields(F.col("c"), "bank_statement")).first()[0]) == ["amount", "description"]
    text = spark.createDataFrame([("EXTRATO MENSAL Bradesco saldo anterior crédito débito",)], "t string")
    assert text.select(layout.recognised(F.col("t")), layout.bank_of(F.col("t"))).first()[:] == ("bradesco-bank-statement-v1", "Bradesco")


def test_lines_hang_on_their_first_word(spark):
    words = spark.createDataFrame([("d", 1, i, t, x, x + 5.0, y, y + 8) for i, (t, x, y) in enumerate([("a", 0.0, 10.0), ("b", 10.0, 11.5), ("c", 20.0, 12.5), ("e", 0.0, 30.0)])], "doc string, page int, ord int, text string, x0 double, x1 double, top double, bottom double")
    assert [(r.line, r.text) for r in layout.lines(words).orderBy("line").collect()] == [(1, "a b"), (2, "c"), (3, "e")]
    assert layout.without_duplicates(words.union(words)).count() == 4
    grid = layout.word_grid(words).collect()
    assert {(r.row_number, r.column, r.value) for r in grid} == {(12, 1, "b"), (12, 2, "c")}


def test_handshake_and_cids(spark):
    bands = spark.createDataFrame([("DATA", "date", 0.0, 20.0), ("SALDO", "balance", 50.0, 80.0)], "label string, field string, left double, right double")
    words = lambda x: spark.createDataFrame([("d", 1, "Data", 5.0, 9.0), ("d", 1, "Saldo", x, x + 4)], "doc string, page int, text string, x0 double, x1 double")
    assert layout.handshake(words(55.0), bands).first().applies and not layout.handshake(words(90.0), bands).first().applies
    df = spark.createDataFrame([("a(cid:7)(cid:9)",)], "t string")
    assert df.select(layout.decoded_cids(F.col("t"), {7: "Ç"})).first()[0] == "aÇ�"


def test_calibration_and_gates_on_edges(spark):
    empty = spark.createDataFrame([], "confidence double, correct boolean, date date")
    r = models.calibrated(empty, 0.9).first()
    assert (r.threshold, r.accepted, r.coverage, r.observations) == (None, 0, 0.0, 0)
    rows = spark.createDataFrame([(0.9, i != 0, DAY(2024, 1, 5)) for i in range(40)] + [(0.5, False, DAY(2024, 2, 5))], "confidence double, correct boolean, date date")
    assert models.calibrated(rows, 0.96).first().threshold == 0.9
    assert {r.period: r.gate for r in models.prequential_gates(rows).collect()} == {"2024-01": 1.0, "2024-02": 0.8}


def test_cutoffs():
    models.checked_cutoff("2024-01", "2024-01")
    for bad in ("2024-02", "2024"):
        with pytest.raises(ValueError):
            models.checked_cutoff(bad, "2024-01")


def test_char_ngrams_stay_within_words(spark):
    df = spark.createDataFrame([("Ab cde",)], "t string")
    assert df.select(models.char_ngrams(F.col("t"))).first()[0] == [" ab", "ab ", " cd", "cde", "de ", " ab ", " cde", "cde ", " cde "]


def test_classifier_learns_and_abstains(spark):
    rows = spark.createDataFrame([(f"pago {w} loja", w, i) for i, w in enumerate(["agua", "luz"] * 6)], "features_text string, label string, ord int")
    model = models.fit(rows, 1 << 10)
    assert [r.predicted for r in models.predict(model, rows.where("ord < 2").orderBy("ord")).collect()] == ["agua", "luz"]
    with pytest.raises(ValueError):
        models.fit(rows.where("label = 'luz'"))


def test_arbitration(spark):
    df = spark.createDataFrame([((("a", 0.9)), ("b", 0.99)), (("a", 0.5), ("b", 0.99)), (("a", 0.5), ("b", 0.5)), (None, ("b", 0.5)), (None, None)], "local struct<counterpart:string,probability:double>, global struct<counterpart:string,probability:double>")
    got = [(r.choice and (r.choice.counterpart, r.choice.confidence)) for r in models.arbitrated(df, 0.8, 0.9).collect()]
    assert got == [("a", "Alta"), ("b", "Alta"), ("a", "Baixa"), ("b", "Baixa"), None]


def test_dataset_digest_ignores_order(spark):
    rows = [("a", 1), ("b", 2), ("b", 2)]
    digest = lambda x: models.dataset_digest(spark.createDataFrame(x, "a string, b int"), ["a", "b"]).first().digest
    assert digest(rows) == digest(rows[::-1]) != digest(rows[:2])


def test_regression_parts(spark):
    expected = spark.createDataFrame([("1", "a", None), ("1", "b", "x"), ("1", "c", "y")], "id string, field string, value string")
    found = spark.createDataFrame([("1", "a", None), ("1", "b", "z")], "id string, field string, value string")
    assert {r.field: (r.present, r.matches) for r in regression.field_checks(expected, found).collect()} == {"a": (True, True), "b": (True, False), "c": (False, False)}
    manifest = spark.createDataFrame([("x", "0" * 64), ("x", "bad")], "id string, sha256 string")
    assert {r.issue for r in regression.manifest_issues(manifest).collect()} == {"duplicate_id", "invalid_sha256"}


def test_vision_payload(spark):
    payload = '{"bank":"Itaú","transactions":[{"date":"2024-01-02","description":"a","amount":"1.234,56"},{"date":"bad","amount":"1"},{"date":"2024-01-02","amount":"0"}]}'
    rows = normalize.from_vision(spark.createDataFrame([("d", payload)], "doc string, payload string")).collect()
    assert [(r.date, r.amount, r.transaction_type) for r in rows] == [(DAY(2024, 1, 2), D("1234.56"), "credit")]


def words(spark, lines, doc="d"):
    """Lines (page, top, [(x0, text), ...]) as words of width 10."""
    rows = [(doc, page, i * 100 + k, text, float(x), float(x) + 10, float(top), float(top) + 8) for i, (page, top, parts) in enumerate(lines) for k, (x, text) in enumerate(parts)]
    return spark.createDataFrame(rows, "doc string, page int, ord int, text string, x0 double, x1 double, top double, bottom double")


def test_banded_statement_attaches_fragments(spark):
    from tallyforge.operators import printed

    w = words(spark, [
        (1, 100, [(10, "01/02/2024"), (90, "SALDO"), (120, "ANTERIOR"), (520, "100,00")]),
        (1, 110, [(230, "ACME")]),
        (1, 115, [(10, "02/02/2024"), (90, "PIX"), (110, "ENVIADO"), (150, "12345"), (460, "-5,00")]),
        (1, 119, [(230, "PECAS"), (360, "12.345.678/0001-90")]),
        (1, 130, [(10, "02/02/2024"), (90, "SALDO"), (120, "TOTAL"), (150, "DO"), (170, "DIA"), (520, "95,00")]),
        (1, 140, [(230, "LOJA")]),
        (2, 50, [(10, "03/02/2024"), (90, "TED"), (460, "7,00")]),
    ])
    rows = {r.ord: r for r in printed.banded_statement(w).collect()}
    tx = sorted((r for r in rows.values() if r.kind == "transaction"), key=lambda r: r.ord)
    assert [(r.date.day, r.description, r.document, r.counterparty, r.counterparty_tax_id, r.amount) for r in tx] == [
        (2, "PIX ENVIADO", "12345", "ACME PECAS", "12.345.678/0001-90", D("-5.00")), (3, "TED", None, "LOJA", None, D("7.00")),
    ]
    assert sorted((r.kind, r.balance) for r in rows.values() if r.kind != "transaction") == [("daily", D("95.00")), ("opening", D("100.00"))]


def test_text_statement(spark):
    from tallyforge.operators import printed

    text = {1: ["Extrato Mensal", "01/02/2024 SALDO ANTERIOR 1.000,00", "02/02/2024 PIX", "RECEBIDO 98765 50,00 1.050,00", "REMET. ACME", "TARIFA 1,00- x", "BOLETO -20,00 1.030,00"], 2: ["BOLETO -20,00 1.030,00", "Total 1,00 2,00", "03/02/2024 DEP 5,00 1.035,00"]}
    lines = spark.createDataFrame([("d", p, n, t) for p, ts in text.items() for n, t in enumerate(ts, 1)], "doc string, page int, line int, text string")
    got = printed.text_statement(lines).orderBy("ord").collect()
    assert [(r.date.day, r.description, r.document, r.counterparty, r.amount, r.balance) for r in got] == [
        (2, "PIX RECEBIDO", "98765", "ACME", D("50.00"), D("1050.00")), (2, "TARIFA 1,00- x BOLETO", None, None, D("-20.00"), D("1030.00")), (3, "DEP", None, None, D("5.00"), D("1035.00")),
    ]
    assert printed.text_opening(lines).first().initial_balance == D("1000.00")


def test_printed_ledger(spark):
    from tallyforge.operators import printed

    w = words(spark, [
        (1, 60, [(5, "Conta"), (40, "Azul")]),
        (1, 100, [(5, "01/02/2024"), (150, "77"), (230, "ACME"), (660, "10,00"), (770, "110,00")]),
        (1, 105, [(230, "LTDA"), (470, "111.444.777-35")]),
        (1, 110, [(5, "02/02/2024"), (720, "5,00")]),
        (1, 500, [(300, "1"), (320, "/"), (340, "2")]),
        (2, 60, [(5, "Conta"), (40, "Verde")]),
        (2, 100, [(5, "03/02/2024"), (720, "1,00"), (770, "9,00")]),
        (2, 20, [(5, "Data"), (50, "inicial"), (660, "01/02/2024")]),
    ])
    got = printed.printed_ledger(w).orderBy("ord").collect()
    assert [(r.segment, r.account, r.document, r.counterparty, r.counterparty_tax_id, r.notes, r.inflow, r.outflow, r.balance) for r in got] == [
        (1, "Conta Azul", "77", "ACME LTDA", "111.444.777-35", None, D("10.00"), D("0.00"), D("110.00")), (2, "Conta Verde", None, None, None, None, D("0.00"), D("1.00"), D("9.00")),
    ]
    assert printed.ledger_periods(w).first().period_start == DAY(2024, 2, 1)
