import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import models
from tallyforge.plans import cycle, ingestion, training

D = Decimal
DAY = datetime.date
CHART = [("1.1.1.02.000", None, "Bancos Conta Movimento"), ("1.1.1.02.001", "BANK9", "Banco Horizonte"), ("1.1.1.05.001", "REC9", "Duplicatas a Receber"), ("2.1.1.01.001", "SUP9", "Fornecedores")]


def books(spark, ledger="Banco Horizonte", statement=True, history=True, memory=None):
    accounts = spark.createDataFrame([(i, *c) for i, c in enumerate(CHART)], "ord long, code string, reduced_code string, description string")
    past = [(0, DAY(2026, 7, 1), "BANK9", "REC9", None, "Recebimento cliente Acme")] if history else []
    schema = "ord long, date date, debit_account string, credit_account string, standard_history string, complement string"
    entries = spark.createDataFrame([(1, 1, DAY(2026, 8, 1), None, "ACME", None, D("50"), D("0"), 2)], "ledger int, ord int, date date, document string, counterparty string, notes string, inflow decimal(18,2), outflow decimal(18,2), row_number int")
    tx = spark.createDataFrame([(7, 1, DAY(2026, 8, 1), None, "ACME", None, D("50"))], "statement int, ord int, date date, description string, counterparty string, document string, amount decimal(18,2)")
    return cycle.Books(
        accounts, spark.createDataFrame(past, schema), spark.createDataFrame([(1, ledger)], "ledger int, account string") if ledger != "-" else None, entries if ledger != "-" else None,
        spark.createDataFrame([(7, "Horizonte")], "statement int, bank string") if statement else None, tx if statement else None, spark.createDataFrame(memory, schema) if memory else None,
    )


@pytest.mark.parametrize("ledger,statement,rows,mode", [("Banco Horizonte", False, 1, "cash_only"), ("-", True, 1, "statement_only"), ("Banco Horizonte", True, 2, "cash_and_statement")])
def test_cash_statement_or_both(spark, ledger, statement, rows, mode):
    b = books(spark, ledger, statement)
    got = cycle.run(b, "2026-08").collect()
    assert len(got) == rows and cycle.modes(b) == mode
    assert {(r.debit_account, r.credit_account, r.status) for r in got} == {("BANK9", "REC9", "LANCAR")}


def test_an_unnamed_ledger_takes_its_statements_account(spark):
    r = {x.id: x for x in cycle.run(books(spark, None, True), "2026-08").collect()}
    assert r["1-1"].debit_account == "BANK9" and r["1-1"].financial_name == "Horizonte"


def test_an_unknown_ledger_goes_to_review(spark):
    r = cycle.run(books(spark, None, False), "2026-08").first()
    assert (r.debit_account, r.status) == (None, "REVISAR CONTA")


def test_memory_comes_before_the_catalog(spark):
    memory = [(0, DAY(2026, 7, 5), "BANK9", "SUP9", None, "ACME"), (1, DAY(2026, 9, 5), "BANK9", "REC9", None, "ACME")]
    r = cycle.run(books(spark, statement=False, memory=memory), "2026-08").first()
    assert r.credit_account == "SUP9" and r.reason.startswith("historico_competencia:1.00")
    later = cycle.run(books(spark, statement=False, memory=memory[1:]), "2026-08").first()
    assert later.credit_account == "REC9" and later.reason.startswith("historico_textual:")


def test_conflicting_charts_and_empty_books_are_refused(spark):
    b = books(spark)
    b.accounts = b.accounts.unionByName(b.accounts.where("reduced_code = 'BANK9'").withColumn("description", F.lit("Outro")))
    with pytest.raises(ValueError):
        cycle.run(b, "2026-08")
    with pytest.raises(ValueError):
        cycle.run(books(spark, "-", False), "2026-08")


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "bank.csv").write_text("Data;Lançamento;Valor;Saldo\n01/01/2024;SALDO ANTERIOR;;100,00\n02/01/2024;PIX;-5,00;\n02/01/2024;SALDO TOTAL;;95,00\n")
    (tmp_path / "off.csv").write_text("Data;Entrada;Saída;Saldo\n01/01/2024;10,00;;110,00\n02/01/2024;1,00;;500,00\n")
    (tmp_path / "chart.csv").write_text("Classificação;Descrição;Reduzido\n1.1.001;Caixa;11\n1.1.002;Banco;12\n")
    (tmp_path / "past.csv").write_text("Data;Débito;Crédito;Valor;Complemento\n01/01/2024;11;12;7,50;x\n")
    (tmp_path / "what.csv").write_text("q;w\n1;2\n")
    (tmp_path / "bad.pdf").write_bytes(b"nothing at all")
    got = ingestion.ingest(spark, str(tmp_path))
    assert [(r.amount, r.transaction_type) for r in got.transactions.collect()] == [(D("-5.00"), "debit")]
    s = got.statements.first()
    assert (s.initial_balance, s.final_balance) == (D("100.00"), D("95.00"))
    assert sorted(r.reduced_code for r in got.accounts.collect()) == ["11", "12"]
    assert [(r.debit_account, r.amount) for r in got.history.collect()] == [("11", D("7.50"))]
    names = {r.sha256: r.name for r in got.files.collect()}
    issues = {(names[r.doc], r.severity, r.code) for r in got.issues.collect()}
    assert issues == {("off.csv", "error", "cash_balance_mismatch"), ("what.csv", "error", "spreadsheet_columns_not_mapped"), ("bad.pdf", "error", "unknown_format"), ("bad.pdf", "warning", "extension_content_mismatch")}
    assert tuple(ingestion.batch_summary(got).first()) == (6, 3, 3, False)


@pytest.fixture(scope="module")
def clients(spark):
    accounts = spark.createDataFrame([(i, *c) for i, c in enumerate(CHART)], "ord long, code string, reduced_code string, description string")
    rows = []
    for m in (5, 6, 7):
        for k in range(6):
            rows.append((len(rows), DAY(2026, m, k + 1), "BANK9", "REC9", "551", f"recebimento cliente {k}"))
            rows.append((len(rows), DAY(2026, m, k + 1), "SUP9", "BANK9", "552", f"pagamento boleto {k}"))
    rows += [(98, DAY(2026, 8, 1), "BANK9", "REC9", "551", "recebimento cliente"), (99, DAY(2026, 7, 1), "REC9", "SUP9", None, "x"), (100, DAY(2026, 7, 1), "BANK9", "??", None, "x"), (101, DAY(2026, 7, 1), "BANK9", "REC9", None, " ")]
    history = spark.createDataFrame(rows, "ord long, date date, debit_account string, credit_account string, standard_history string, complement string")
    return {"a": (history, accounts), "b": (history, accounts)}


def test_training_data_evaluation_and_fallback(spark, clients, tmp_path):
    rows, audit = training.dataset(clients, "2026-08")
    assert {(r.client_id, r.reason): r.rows for r in audit.collect()} == {(c, k): n for c in "ab" for k, n in {"eligible_rows": 36, "on_or_after_cutoff": 1, "not_single_financial_side": 1, "counterpart_not_in_chart": 1, "missing_text": 1}.items()}
    rows = rows.cache()
    scores = {r.split: r for r in training.evaluated(rows, 1 << 10).collect()}
    assert set(scores) == {"before 2026-07", "without a", "without b"} and all(r.top_1 == 1.0 and r.seen == 1.0 for r in scores.values())
    model = models.fit(rows, 1 << 10)
    training.save(model, str(tmp_path / "m"), "2026-08", 0.9, rows.count())
    loaded, metadata = training.load(str(tmp_path / "m"), "2026-08")
    assert metadata["trained_before"] == "2026-08"
    with pytest.raises(ValueError):
        training.load(str(tmp_path / "m"), "2026-07")
    history, accounts = clients["a"]
    t = training.tested(loaded, history, accounts, "2026-08", 0.5).first()
    assert (t.rows, t.top_1, t.mappable, t.auto_coverage, t.auto_precision) == (1, 1.0, 1.0, 1.0, 1.0)
    b = books(spark, statement=False, history=False)
    b.ledger_entries = b.ledger_entries.withColumn("notes", F.lit("recebimento cliente"))
    r = cycle.run(b, "2026-08", fallback=training.fallback(loaded, 0.5, accounts)).first()
    assert (r.credit_account, r.status) == ("REC9", "LANCAR") and r.reason.startswith("global_tfidf:")


def test_expectations_and_report(spark):
    from tallyforge.operators import regression

    fixtures = spark.createDataFrame([("a", "csv", None), ("b", "pdf", "x"), ("c", "csv", "y")], "id string, source_format string, document_type string")
    results = spark.createDataFrame([("a", "csv", None), ("b", "xml", "x")], "id string, source_format string, document_type string")
    checks = regression.expectation_checks(fixtures, results, ["source_format", "document_type"])
    found = {r.id: (r.passed, r.failed_fields) for r in regression.verdicts(checks).collect()}
    assert found == {"a": (True, []), "b": (False, ["source_format"]), "c": (False, ["document_type", "source_format"])}
    documents = fixtures.join(regression.verdicts(checks), "id").withColumn("found_type", F.col("document_type")).na.fill("none", ["document_type"])
    text = regression.report(documents, regression.coverage(documents, checks.withColumn("present", F.col("found").isNotNull())))
    assert "- passed: 1" in text and "- failed: c" in text and "| none |  | 1 |" in text


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import json

    from tallyforge import __main__ as command

    monkeypatch.setattr(command, "_session", lambda: spark)
    for name, last in (("a", "111,00"), ("b", "112,00")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "l.csv").write_text(f"Data;Entrada;Saída;Saldo\n01/01/2024;10,00;;110,00\n02/01/2024;1,00;;{last}\n")
    assert command.main(["ingest", str(tmp_path / "a"), "--output", str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out)["processed"] == 1 and spark.read.parquet(str(tmp_path / "out/ledger_entries")).count() == 2
    assert command.main(["compare", str(tmp_path / "a"), str(tmp_path / "a")]) == 0
    assert command.main(["compare", str(tmp_path / "a"), str(tmp_path / "b")]) == 1
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert [(d["position"], d["field"]) for d in out["differences"]] == [(2, "balance")]
