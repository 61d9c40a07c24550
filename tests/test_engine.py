import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import engine

D = Decimal
DAY = datetime.date

CHART = [("1.1.1.02.000", "1000000", "Bancos Conta Movimento"), ("1.1.1.02.001", "1000012", "Banco Horizonte"), ("1.1.1.05.001", "2000001", "Duplicatas a Receber"), ("2.1.1.01.001", "3000001", "Fornecedores")]
HISTORY = [(DAY(2026, 7, 1), "1000012", "2000001", "551", "Recebimento Acme"), (DAY(2026, 7, 2), "1000012", "2000001", "551", "Recebimento Acme")]
EXAMPLES = [(DAY(2026, 7, d), "ACME recebimento", "inflow", "1000012", "2000001", "551", D(10 * d)) for d in (1, 2)]


def base(spark, movements, history=HISTORY, examples=None, chart=CHART):
    accounts = spark.createDataFrame([(i, *r) for i, r in enumerate(chart)], "ord long, code string, reduced_code string, description string")
    past = spark.createDataFrame([(i, *r) for i, r in enumerate(history)], "ord long, date date, debit_account string, credit_account string, standard_history string, complement string")
    schema = "ord long, id string, date date, amount decimal(18,2), counterparty string, notes string, document string, financial_account string, financial_name string, source_row int"
    moved = spark.createDataFrame([(i, *r) for i, r in enumerate(movements)], schema)
    known = spark.createDataFrame(examples, "date date, text string, direction string, financial_account string, counterpart string, standard_history string, amount decimal(18,2)") if examples else None
    return engine.Base(accounts, past, moved, known)


def movement(amount, notes, counterparty=None, account="1000012", row=2, day=1, document=None, name="Banco Horizonte", id="m"):
    return (id, DAY(2026, 8, day), D(amount), counterparty, notes, document, account, name, row)


def test_the_portable_example(spark):
    rows = engine.generate(base(spark, [movement("50", "PIX RECEBIDO", "ACME", document="123", id="linha-2")], examples=EXAMPLES), "2026-08").collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert {k: r[k] for k in ("id", "debit_account", "credit_account", "standard_history", "complement", "status", "confidence", "reason", "source_rows", "financial_name", "document")} == {
        "id": "linha-2", "debit_account": "1000012", "credit_account": "2000001", "standard_history": "551", "complement": "RECEBIMENTO PIX - ACME - DOC 123", "status": "LANCAR", "confidence": "Alta",
        "reason": "historico_textual:0.85|hist_contas:2x", "source_rows": [2], "financial_name": "Banco Horizonte", "document": "123",
    }
    assert r["amount"] == D("50.00") and r["account_probability"] == pytest.approx(0.8452380952380952)
    assert (r["account_probability_source"], r["history_probability"], r["history_probability_source"]) == ("text_similarity", 1.0, "account_pair_frequency")
    assert (r["history_cd_candidate"], r["history_cd_probability"], r["history_cd_support"], r["history_cd_alternatives"]) == ("551", 1.0, 2, 1)


def test_memory_answers_where_history_does_not(spark):
    r = engine.generate(base(spark, [movement("50", "recebimento", "ACME")], history=[], examples=EXAMPLES), "2026-08").first()
    assert (r.debit_account, r.credit_account, r.standard_history) == ("1000012", "2000001", "551")
    assert (r.account_probability, r.account_probability_source, r.history_probability, r.history_probability_source) == (1.0, "exact_memory", 1.0, "exact_memory")


def test_direction_default_goes_to_review(spark):
    rows = {r.id: r for r in engine.generate(base(spark, [movement("50", "algo", id="in"), movement("-50", "algo", id="out")], history=[]), "2026-08").collect()}
    assert (rows["in"].credit_account, rows["out"].debit_account) == ("2000001", "3000001")
    assert {r.status for r in rows.values()} == {"REVISAR CONTA"} and {r.reason for r in rows.values()} == {"padrao_por_direcao"}


def test_compound_movements_are_not_classified(spark):
    r = engine.generate(base(spark, [movement("-9", "ICMS e IPI")]), "2026-08").first()
    assert (r.status, r.confidence, r.reason, r.debit_account) == ("REVISAR RATEIO", "Baixa", "movimento_composto_sem_memoria_de_calculo", None)


def test_mirrored_transfers_collapse(spark):
    moved = [movement("-70", "Transferência", account="1000012", row=2, id="a"), movement("70", "Transferência", account="1000000", row=5, name="B", id="b"), movement("70", "Transferência", account="1000000", row=6, day=2, id="c")]
    rows = {r.id: r for r in engine.generate(base(spark, moved), "2026-08").collect()}
    assert set(rows) == {"a+b", "c"}
    t = rows["a+b"]
    assert (t.debit_account, t.credit_account, t.amount, t.reason, t.source_rows, t.financial_name) == ("1000000", "1000012", D("70.00"), "transferencia_espelhada", [2, 5], "Banco Horizonte -> B")


def test_other_months_and_zero_amounts_do_not_count(spark):
    moved = [movement("0", "x"), ("n", DAY(2026, 9, 1), D(5), None, "x", None, "1000012", None, 1)]
    assert engine.generate(base(spark, moved), "2026-08").count() == 0


def test_later_history_only_counts_as_catalog(spark):
    later = [(DAY(2026, 9, 1), "1000012", "2000001", "551", "Recebimento Acme")]
    b = base(spark, [movement("50", "recebido", "ACME")], history=later)
    assert engine.generate(b, "2026-08").first().reason == "padrao_por_direcao"
    assert engine.generate(b, "2026-08", catalog_any_month=True).first().reason.startswith("historico_textual")


def test_rules_come_before_history(spark):
    chart = [*CHART, ("3.1.1.01.001", "4000001", "Despesas Bancárias")]
    r = engine.generate(base(spark, [movement("-5", "Tarifa mensal")], chart=chart), "2026-08").first()
    assert (r.debit_account, r.credit_account, r.reason, r.status) == ("4000001", "1000012", "despesa_bancaria", "LANCAR")


def test_fallback_takes_what_is_open(spark):
    def fallback(open_):
        return open_.select("ord", engine._choice(F.lit("3000001"), None, F.lit("Alta"), F.lit("global_tfidf:0.99"), F.lit(0.99), F.lit("global_tfidf")).alias("choice"))

    entries = engine.generate(base(spark, [movement("50", "algo")], history=[]), "2026-08", fallback=fallback)
    assert entries.first().credit_account == "3000001"
    assert engine.audit(entries).first().asDict() == {"generated_entries": 1, "launch": 1, "review_count": 0, "transfers_collapsed": 0, "global_fallback_count": 1}


def test_audit_parts(spark):
    b = base(spark, [movement("50", "algo", account="999"), movement("-50", "algo")], history=[])
    entries = engine.generate(b, "2026-08")
    assert [r.code for r in engine.unknown_codes(entries, b.accounts).collect()] == ["999"]
    assert [(r.reason, r.entries) for r in engine.review_queue(entries).collect()] == [("padrao_por_direcao", 2)]
    assert [r.ord for r in engine.in_order(entries).collect()] == [0, 1]
