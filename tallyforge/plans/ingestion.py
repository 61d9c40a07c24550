"""From a folder of files to typed records and issues: one linear plan, bad files are rows and never stop the others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import forms, layout, normalize, reconcile
from tallyforge.lineage import cut
from tallyforge.sources import files as f
from tallyforge.sources import invoices
from tallyforge.sources.registry import Readers, default_readers

# Titles of the sheets that hold a chart or a history, and the fields they stand for.
CHART_TITLES = {"code": ("CODIGO", "CONTA", "CLASSIFICACAO"), "description": ("DESCRICAO", "NOME"), "reduced_code": ("REDUZIDO", "CODIGOREDUZIDO")}
HISTORY_TITLES = {
    "date": ("DATA",), "debit_account": ("DEBITO", "CONTADEBITO"), "credit_account": ("CREDITO", "CONTACREDITO"), "amount": ("VALOR",),
    "standard_history": ("HIST", "HISTORICOPADRAO"), "complement": ("COMPLEMENTO", "HISTORICO"),
}
CHART_NEEDS, HISTORY_NEEDS = ("code", "description"), ("date", "debit_account", "credit_account", "amount")


@dataclass
class Ingested:
    """One DataFrame per family, the files, and all issues (doc, severity, code)."""

    files: DataFrame
    statements: DataFrame
    transactions: DataFrame
    daily_balances: DataFrame
    ledger_entries: DataFrame
    accounts: DataFrame
    history: DataFrame
    invoices: DataFrame
    issues: DataFrame
    printed_invoices: DataFrame | None = None


def _has(columns, fields):
    return F.size(F.array_except(F.array(*[F.lit(x) for x in fields]), F.coalesce(F.map_keys(columns), F.array().cast("array<string>")))) == 0


def _headers(cells: DataFrame, titles: dict, needs: tuple[str, ...]) -> DataFrame:
    """The first row of each sheet that has all needed titles."""
    from pyspark.sql import Window

    rows = layout.mapped_rows(cells, layout.alias_table(cells.sparkSession, titles)).where(_has(F.col("columns"), needs))
    w = Window.partitionBy("doc", "sheet_ord").orderBy("row_number")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ingest(spark: SparkSession, path: str, readers: Readers | None = None, words: DataFrame | None = None) -> Ingested:
    """Reads, detects, recognises, normalises and checks every file below a path. A content that occurs twice is read once.

    ``words`` are the placed words of printed pages, doc being the file's sha256, from a decoder outside; pages that are invoices for certain become records.
    """
    all_ = f.detected(f.described(f.discovered(spark, path)))
    held = all_.dropDuplicates(["sha256"])
    # decoding is the costly step and a dozen relations read its result: it runs once
    cells = cut((readers or default_readers()).cells(held))
    bad = cells.where("issue is not null").select("doc", F.col("issue").alias("code")).distinct()
    cells = cells.where("sheet_ord is not null")
    charts, histories = _headers(cells, CHART_TITLES, CHART_NEEDS), _headers(cells, HISTORY_TITLES, HISTORY_NEEDS)
    # a chart is looked for before a history, and both before the movement tables
    histories = histories.join(charts.select("doc").distinct(), "doc", "left_anti")
    tables = layout.first_header(layout.mapped_rows(cells, layout.alias_table(spark)))
    tables = tables.join(charts.select("doc").unionByName(histories.select("doc")).distinct(), "doc", "left_anti")
    tables = tables.withColumn("family", layout.family_of(F.col("columns")))
    of = lambda family: normalize.records(cells, tables.where(F.col("family") == family))
    rows = normalize.statement_rows(of("bank_statement"), normalize.printed_period(cells))
    entries = normalize.ledger_entries(of("cash_ledger"))
    statements, transactions, balances = normalize.statements(rows), normalize.transactions(rows), normalize.daily_balances(rows)
    accounts, history = normalize.chart(normalize.records(cells, charts)), normalize.history(normalize.records(cells, histories))
    xml = held.where("format = 'xml'").select(F.col("sha256").alias("doc"), f.text_of(F.col("content")).alias("xml"))
    records = invoices.normalized(xml)
    error = lambda df: df.select("doc", F.lit("error").alias("severity"), "code")
    warning = lambda df: df.select("doc", F.lit("warning").alias("severity"), "code")
    stopped = ("invalid_xlsx", "xls_reader_unavailable", "unexpected_processing_error")
    broken = reconcile.balance_mismatches(entries, ["doc"]).select("doc", F.lit("cash_balance_mismatch").alias("code"))
    diverged = reconcile.first_divergence(statements.select("doc", "initial_balance", "final_balance"), transactions, balances, "doc")
    parts = [
        error(held.where("issue is not null").select(F.col("sha256").alias("doc"), F.col("issue").alias("code"))),
        warning(held.where("warning is not null").select(F.col("sha256").alias("doc"), F.col("warning").alias("code"))),
        error(bad.where(F.col("code").isin(*stopped))),
        warning(bad.where(~F.col("code").isin(*stopped))),
        error(invoices.gate(xml).where("issue is not null").select("doc", F.col("issue").alias("code"))),
        error(invoices.issues(records).select("doc", F.col("issue").alias("code"))),
        error(normalize.duplicate_codes(accounts).select("doc", F.lit("duplicate_chart_of_accounts_code").alias("code")).distinct()),
        error(tables.where("family is null").select("doc", F.lit("spreadsheet_columns_not_mapped").alias("code"))),
        error(broken),
        warning(diverged),
    ]
    printed = None
    if words is not None:
        # records are checked by two rules and returned: the pages are read once
        printed = cut(forms.printed_invoices(words.join(held.select(F.col("sha256").alias("doc")), "doc", "left_semi")).where("recognised"))
        parts.append(warning(printed.select("doc", F.inline("issues")).select("doc", "code")))
        parts.append(error(invoices.issues(forms.for_rules(printed)).select("doc", F.col("issue").alias("code"))))
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    return Ingested(all_.drop("content"), statements, transactions, balances, entries, accounts, history, records, issues.distinct(), printed)


def batch_summary(ingested: Ingested) -> DataFrame:
    """One row: files, those with an error, and whether there was none."""
    bad = ingested.issues.where("severity = 'error'").select(F.col("doc").alias("sha256")).distinct().withColumn("_bad", F.lit(True))
    marked = ingested.files.join(bad, "sha256", "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    return marked.agg(F.count(F.lit(1)).alias("processed"), F.count_if(~F.col("_bad")).alias("succeeded"), F.count_if("_bad").alias("failed"), (~F.coalesce(F.bool_or("_bad"), F.lit(False))).alias("success"))
