"""Cells to records: statements, ledgers, charts, histories. One function per family, DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bookkeeping import is_daily_balance
from tallyforge.functions.money import MONEY, amount_of, parse_date, parse_money, parse_row_date, transaction_type
from tallyforge.functions.text import clean, fold
from tallyforge.lineage import large
from tallyforge.operators.layout import rendered
from tallyforge.operators.reconcile import running_balance

# Folded beginnings of lines that print a day's balance.
BALANCE_PREFIXES = ("SALDOTOTAL", "SALDOEMCONTA", "SDOCTA")


def records(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below a document's header as (doc, row_number, values map field -> text), by the header's map of columns."""
    head = headers.select("doc", "sheet_ord", F.col("row_number").alias("header_row"), "columns").where("columns is not null")
    below = rendered(cells).select("doc", "sheet_ord", "row_number", "column", "text").join(large(head), ["doc", "sheet_ord"]).where(F.col("row_number") > F.col("header_row"))
    hit = below.withColumn("field", F.explode(F.map_keys(F.map_filter("columns", lambda _, c: c == F.col("column")))))
    return hit.groupBy("doc", "sheet_ord", "row_number").agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("values"))


def _money(field: str):
    return parse_money(F.try_element_at("values", F.lit(field)))


def _text(field: str):
    return clean(F.try_element_at("values", F.lit(field)))


def statement_rows(rows: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Records of bank statements with their kind: opening, daily or transaction; others go.

    ``periods`` (doc, period_start, period_end) dates rows printed as day/month.
    """
    if periods is not None:
        rows = rows.join(large(periods), "doc", "left")
        date = parse_row_date(F.try_element_at("values", F.lit("date")), F.col("period_start"), F.col("period_end"))
    else:
        date = parse_date(F.try_element_at("values", F.lit("date")))
    folded = fold(F.col("description"))
    base = rows.select(
        "doc", F.col("row_number").alias("ord"), date.alias("date"), _text("description").alias("description"), _text("counterparty").alias("counterparty"), _text("tax_id").alias("tax_id"),
        _text("document").alias("document"), _money("balance").alias("balance"), amount_of(_money("amount"), _money("credit"), _money("debit")).alias("amount"),
    ).where("date is not null and description is not null")
    kind = F.when(F.contains(folded, F.lit("SALDOANTERIOR")), "opening").when((folded == "SALDO") | is_daily_balance(folded, BALANCE_PREFIXES), "daily").when(F.col("amount").isNotNull(), "transaction")
    return base.withColumn("kind", kind).where("kind is not null").withColumn("transaction_type", F.when(F.col("kind") == "transaction", transaction_type(F.col("amount"))))


def transactions(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'transaction'").drop("kind", "balance")


def daily_balances(rows: DataFrame) -> DataFrame:
    """The last printed balance of each date, in the order of dates."""
    daily = rows.where("kind = 'daily' and balance is not null").groupBy("doc", "date").agg(F.max_by("balance", "ord").alias("balance"))
    return daily.withColumn("ord", F.datediff("date", F.lit("1970-01-01")))


def statements(rows: DataFrame) -> DataFrame:
    """Header of each statement: opening balance (the first printed), final balance (of the last date), period."""
    opening = F.min_by(F.when(F.col("kind") == "opening", F.col("balance")), F.when((F.col("kind") == "opening") & F.col("balance").isNotNull(), F.col("ord")))
    of_tx = F.when(F.col("kind") == "transaction", F.col("date"))
    last = daily_balances(rows).groupBy("doc").agg(F.max_by("balance", "date").alias("final_balance"))
    head = rows.groupBy("doc").agg(opening.alias("initial_balance"), F.min(of_tx).alias("period_start"), F.max(of_tx).alias("period_end"), F.count(of_tx).alias("transactions"))
    return head.join(large(last), "doc", "left")


def ledger_entries(rows: DataFrame) -> DataFrame:
    """Records of cash ledgers; missing balances run on from the printed ones."""
    base = rows.select(
        "doc", F.col("row_number").alias("ord"), parse_date(F.try_element_at("values", F.lit("date"))).alias("date"), parse_date(F.try_element_at("values", F.lit("issue_date"))).alias("issue_date"),
        _text("document").alias("document"), _text("counterparty").alias("counterparty"), F.coalesce(_text("notes"), _text("description")).alias("notes"),
        _money("inflow").alias("inflow"), _money("outflow").alias("outflow"), _money("balance").alias("balance"),
    ).where("date is not null and (inflow is not null or outflow is not null)")
    base = base.withColumns({c: F.coalesce(c, F.lit(0)).cast(MONEY) for c in ("inflow", "outflow")})
    return running_balance(base, "doc").withColumn("balance", F.col("running")).drop("running")


def chart(rows: DataFrame) -> DataFrame:
    """Records with a code and a description."""
    out = rows.select("doc", F.col("row_number").alias("ord"), _text("code").alias("code"), _text("description").alias("description"), _text("reduced_code").alias("reduced_code"))
    return out.where("code is not null and description is not null")


def duplicate_codes(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("doc", "code").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def history(rows: DataFrame) -> DataFrame:
    """Records with a date, both accounts and an amount."""
    out = rows.select(
        "doc", F.col("row_number").alias("ord"), _text("entry_number").alias("entry_number"), parse_date(F.try_element_at("values", F.lit("date"))).alias("date"),
        _text("debit_account").alias("debit_account"), _text("credit_account").alias("credit_account"), _money("amount").alias("amount"),
        _text("standard_history").alias("standard_history"), _text("complement").alias("complement"), _text("tax_id").alias("tax_id"),
    )
    return out.where("date is not null and debit_account is not null and credit_account is not null and amount is not null")


def before_second_header(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows up to the second header of a sheet."""
    second = headers.groupBy("doc", "sheet_ord").agg(F.get(F.array_sort(F.collect_list("row_number")), F.lit(1)).alias("_second"))
    return rows.join(second, ["doc", "sheet_ord"], "left").where("_second is null or row_number < _second").drop("_second")


def beside(cells: DataFrame, label: str) -> DataFrame:
    """The next cell's text right of a label, per document (the first)."""
    from pyspark.sql import Window

    text = rendered(cells)
    after = F.lead("text").over(Window.partitionBy("doc", "sheet_ord", "row_number").orderBy("column"))
    found = text.withColumn("_next", after).where(fold(F.col("text")) == label)
    return found.groupBy("doc").agg(F.min_by("_next", F.struct("sheet_ord", "row_number", "column")).alias("value"))


def printed_period(cells: DataFrame) -> DataFrame:
    """The first "d/m/y a d/m/y" of a document."""
    pattern = r"(?i)(\d{2}/\d{2}/\d{4})\s*a\s*(\d{2}/\d{2}/\d{4})"
    hit = rendered(cells).where(F.col("text").rlike(pattern))
    first = hit.groupBy("doc").agg(F.min_by("text", F.struct("sheet_ord", "row_number", "column")).alias("_t"))
    return first.select("doc", parse_date(F.regexp_extract("_t", pattern, 1)).alias("period_start"), parse_date(F.regexp_extract("_t", pattern, 2)).alias("period_end"))


def from_vision(payloads: DataFrame) -> DataFrame:
    """JSON of recognised statements (doc, payload) -> transactions; null or zero amounts and bad dates go."""
    from tallyforge.functions.money import parse_mixed

    schema = "struct<bank:string,transactions:array<struct<date:string,description:string,counterparty:string,document:string,amount:string>>>"
    rows = payloads.select("doc", F.posexplode(F.from_json("payload", schema)["transactions"]).alias("ord", "t"))
    amount = parse_mixed(F.col("t.amount"))
    out = rows.select("doc", "ord", F.try_to_date("t.date", "yyyy-MM-dd").alias("date"), clean(F.col("t.description")).alias("description"), clean(F.col("t.counterparty")).alias("counterparty"), F.col("t.document").alias("document"), amount.alias("amount"), transaction_type(amount, zero_is_credit=False).alias("transaction_type"))
    return out.where("date is not null and amount is not null and amount <> 0")
