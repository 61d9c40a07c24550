"""From ledgers and statements to movements with accounts, and a whole cycle: movements, memory and catalog, entries, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.money import period_of, signed
from tallyforge.functions.text import plain
from tallyforge.operators import accounts as acc
from tallyforge.operators import matching
from tallyforge.operators.ordering import numbered
from tallyforge.plans import engine

# Words of accounts that hold investments.
APPLICATION_WORDS = ("cdb", "aplic", "invest")


@dataclass
class Books:
    """ledgers (ledger, account), ledger_entries (ledger, ord, date, document, counterparty, notes, inflow, outflow, row_number),
    statements (statement, bank), transactions (statement, ord, date, description, counterparty, document, amount),
    accounts, history and, if confirmed entries are known, memory."""

    accounts: DataFrame
    history: DataFrame
    ledgers: DataFrame | None = None
    ledger_entries: DataFrame | None = None
    statements: DataFrame | None = None
    transactions: DataFrame | None = None
    memory: DataFrame | None = None


def statement_accounts(statements: DataFrame, accounts: DataFrame, active: DataFrame, financial: DataFrame) -> DataFrame:
    """statement, account: the bank account that shares most words with the bank's name."""
    banks = accounts.join(financial.where("kind = 'bank'").select("reduced_code"), "reduced_code", "left_semi")
    found = matching.account_by_words(statements.select(F.col("bank").alias("name")).distinct(), banks, active)
    return statements.join(found.select(F.col("name").alias("bank"), F.col("reduced_code").alias("account")), "bank", "left").select("statement", "bank", "account")


def ledger_accounts(books: Books, active: DataFrame, financial: DataFrame, of_statement: DataFrame | None) -> DataFrame:
    """ledger, account, name: by the printed name's words (among application or bank accounts, else all), else by the statement
    that holds half of its entries, else, where the notes tell of investments, the most active application account.
    """
    chart = books.accounts.where(F.coalesce("reduced_code", F.lit("")) != "")
    invest = F.lit(False)
    for w in APPLICATION_WORDS:
        invest = invest | F.contains(plain(F.col("account")), F.lit(w))
    named = books.ledgers.where("account is not null").select("ledger", F.col("account").alias("name"), F.when(invest, "application").otherwise("bank").alias("kind"))
    pool = lambda kind: chart.join(financial.where(F.col("kind") == kind).select("reduced_code"), "reduced_code", "left_semi")
    hits = [matching.account_by_words(named.where(F.col("kind") == kind).select("name").distinct(), pool(kind), active).withColumn("kind", F.lit(kind)) for kind in ("bank", "application")]
    inside = hits[0].unionByName(hits[1]).select("name", "kind", F.col("reduced_code").alias("_in"))
    anywhere = matching.account_by_words(named.select("name").distinct(), chart, active).select("name", F.col("reduced_code").alias("_any"))
    by_words = named.join(inside, ["name", "kind"], "left").join(anywhere, "name", "left").select("ledger", F.coalesce("_in", "_any").alias("account"), "name").where("account is not null")
    out = [by_words]
    rest = books.ledgers.join(by_words.select("ledger"), "ledger", "left_anti")
    if of_statement is not None:
        entries = books.ledger_entries.join(rest.select("ledger"), "ledger", "left_semi").withColumn("amount", signed(F.col("inflow"), F.col("outflow")).cast("decimal(18,2)"))
        sizes = entries.groupBy("ledger").agg(F.count(F.lit(1)).alias("entries"))
        pairs = matching.ledger_accounts(sizes, matching.overlap(entries, books.transactions, "ledger", "statement"))
        paired = pairs.join(of_statement, "statement").select("ledger", "account", F.col("bank").alias("name"))
        out.append(paired)
        rest = rest.join(paired.select("ledger"), "ledger", "left_anti")
    told = F.lit(False)
    for w in APPLICATION_WORDS:
        told = told | F.contains(plain(F.col("notes")), F.lit(w))
    tells = books.ledger_entries.groupBy("ledger").agg(F.bool_or(F.coalesce(told, F.lit(False))).alias("_told"))
    best = pool("application").join(active, "reduced_code", "left").agg(F.max_by(F.struct("reduced_code", "description"), F.struct(F.coalesce("activity", F.lit(0)), -F.col("ord"))).alias("b")).select("b.*")
    last = rest.join(tells, "ledger", "left").join(F.broadcast(best), F.col("_told"), "left").select("ledger", F.col("reduced_code").alias("account"), F.coalesce("description", rest["account"]).alias("name"))
    out.append(last)
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    return both


def movements(books: Books, active: DataFrame, financial: DataFrame) -> DataFrame:
    """All rows of ledgers, then all of statements: a movement in both counts twice, as the books have it twice."""
    null = F.lit(None)
    parts = []
    of_statement = statement_accounts(books.statements, books.accounts, active, financial) if books.statements is not None else None
    if books.ledgers is not None:
        known = ledger_accounts(books, active, financial, of_statement)
        rows = books.ledger_entries.join(known, "ledger", "left")
        parts.append(rows.select(
            F.lit(0).alias("_from"), F.col("ledger").cast("string").alias("_book"), F.col("ord").cast("long").alias("_ord"), "date", signed(F.col("inflow"), F.col("outflow")).cast("decimal(18,2)").alias("amount"), "counterparty", "notes", "document",
            F.col("account").alias("financial_account"), F.col("name").alias("financial_name"), F.col("row_number").cast("int").alias("source_row"),
        ))
    if books.statements is not None:
        rows = books.transactions.join(of_statement, "statement", "left")
        parts.append(rows.select(
            F.lit(1).alias("_from"), F.col("statement").cast("string").alias("_book"), F.col("ord").cast("long").alias("_ord"), "date", F.col("amount").cast("decimal(18,2)").alias("amount"), "counterparty", F.col("description").alias("notes"), "document",
            F.col("account").alias("financial_account"), F.col("bank").alias("financial_name"), null.cast("int").alias("source_row"),
        ))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    # ledgers come before statements, books by their names, rows as a book has them: one running number over all
    return numbered(both, ["_from", "_book", "_ord"]).withColumn("id", F.concat_ws("-", "_book", F.col("_ord").cast("string"))).drop("_from", "_book", "_ord")


def run(books: Books, period: str, fallback: engine.Stage | None = None) -> DataFrame:
    """Entries of a period: rules, then confirmed memory of earlier months, then the catalog of any month, then the fallback."""
    if books.ledgers is None and books.statements is None:
        raise ValueError("ledgers or statements are needed")
    if not acc.conflicts(books.accounts).isEmpty():
        raise ValueError("an account is described differently in the charts")
    financial = acc.financial_accounts(books.accounts)
    catalog = acc.usable_history(books.history, books.accounts)
    memory = acc.usable_history(books.memory, books.accounts, period) if books.memory is not None else None
    every = catalog if memory is None else catalog.unionByName(memory, allowMissingColumns=True)
    moved = movements(books, acc.activity(every), financial)

    def later(open_: DataFrame) -> DataFrame:
        found = engine.by_history(open_, catalog, financial, True)
        if fallback is None:
            return found
        rest = open_.join(found.select("ord"), "ord", "left_anti")
        return found.unionByName(fallback(rest).select("ord", "choice"))

    base = engine.Base(books.accounts, memory if memory is not None else catalog, moved)
    if memory is None:
        return engine.generate(base, period, fallback=fallback, catalog_any_month=True)
    return engine.generate(base, period, fallback=later, prefix="historico_competencia", activity_of=every)


def modes(books: Books) -> str:
    return "cash_and_statement" if books.ledgers is not None and books.statements is not None else "cash_only" if books.ledgers is not None else "statement_only"


def months(entries: DataFrame) -> DataFrame:
    return entries.groupBy(period_of(F.col("date")).alias("period"), "status").agg(F.count(F.lit(1)).alias("entries"), F.sum("amount").alias("amount"))
