"""Running balances and their checks: windows over (document, order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import signed


def segments(entries: DataFrame, key: str) -> DataFrame:
    """Ledgers that follow each other in one table: adds segment (from 1) and reason of the break before a row.

    A ledger ends where a named account differs from the carried one, the dates restart, or a row opens at zero
    behind a balance that is none. The carried account is not reset at a break.
    """
    w = Window.partitionBy(key).orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("account", ignorenulls=True).over(before)
    opening = F.col("balance") - F.col("inflow") + F.col("outflow")
    reason = (
        F.when(F.row_number().over(w) == 1, F.lit(None).cast("string"))
        .when(F.col("account") != carried, "account_changed")
        .when(F.col("date") < F.lag("date").over(w), "date_sequence_restarted")
        .when((opening == 0) & (F.lag("balance").over(w) != 0), "zero_opening_balance_restarted")
    )
    out = entries.withColumn("reason", reason)
    return out.withColumn("segment", F.sum(F.col("reason").isNotNull().cast("int")).over(w) + 1)


def ledgers(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Header of each ledger: period, initial balance (before its first row), final balance, entries."""
    first = F.min_by(F.col("balance") - F.col("inflow") + F.col("outflow"), "ord")
    return entries.groupBy(*keys).agg(
        F.min("date").alias("period_start"), F.max("date").alias("period_end"), first.alias("initial_balance"), F.max_by("balance", "ord").alias("final_balance"), F.count(F.lit(1)).alias("entries")
    )


def balance_mismatches(entries: DataFrame, keys: list[str], initial: str | None = None) -> DataFrame:
    """Rows whose printed balance is not the one before plus inflow less outflow."""
    w = Window.partitionBy(*keys).orderBy("ord")
    opening = F.col(initial) if initial else F.first(F.col("balance") - F.col("inflow") + F.col("outflow")).over(w)
    expected = F.coalesce(F.lag("balance").over(w), opening) + F.col("inflow") - F.col("outflow")
    return entries.withColumn("expected_balance", expected).where("expected_balance <> balance")


def running_balance(entries: DataFrame, key: str) -> DataFrame:
    """Fills missing balances: a printed one resets, others accumulate from it."""
    w = Window.partitionBy(key).orderBy("ord")
    island = entries.withColumn("_island", F.count("balance").over(w))
    i = Window.partitionBy(key, "_island").orderBy("ord")
    delta = F.when(F.col("balance").isNull(), signed(F.col("inflow"), F.col("outflow"))).otherwise(F.lit(0))
    value = F.coalesce(F.first("balance").over(i), F.lit(0)) + F.sum(delta).over(i)
    return island.withColumn("running", value.cast("decimal(18,2)")).drop("_island")


def last_per_date(rows: DataFrame, key: str, value: str = "balance") -> DataFrame:
    return rows.groupBy(key, "date").agg(F.max_by(value, "ord").alias(value), F.max("ord").alias("ord"))


def daily_sums(transactions: DataFrame, key: str) -> DataFrame:
    return transactions.groupBy(key, "date").agg(F.sum("amount").cast("decimal(18,2)").alias("moved"), F.count(F.lit(1)).alias("transaction_count"))


def first_divergence(statements: DataFrame, transactions: DataFrame, balances: DataFrame, key: str) -> DataFrame:
    """At most one warning per statement, in this order: no initial balance, a transaction's date without a daily
    balance, the first daily balance that does not follow, no final balance, a final balance unlike the last.

    Balances are taken in their printed order.
    """
    w = Window.partitionBy(key).orderBy("ord")
    moved = daily_sums(transactions, key)
    known = balances.join(statements.select(key, "initial_balance"), key).join(moved, [key, "date"], "left")
    expected = F.coalesce(F.lag("balance").over(w), F.col("initial_balance")) + F.coalesce("moved", F.lit(0))
    known = known.withColumn("_expected", expected.cast("decimal(18,2)"))
    broken = known.where("_expected <> balance").groupBy(key).agg(F.min_by(F.struct("date", F.col("_expected").alias("expected"), F.col("balance").alias("actual")), "ord").alias("_broken"))
    missing = transactions.join(balances.select(key, "date").distinct(), [key, "date"], "left_anti").groupBy(key).agg(F.min_by("date", "ord").alias("_missing"))
    last = balances.groupBy(key).agg(F.max_by("balance", "ord").alias("_last"))
    all_ = statements.join(broken, key, "left").join(missing, key, "left").join(last, key, "left")
    code = (
        F.when(F.col("initial_balance").isNull(), "bank_initial_balance_missing")
        .when(F.col("_missing").isNotNull(), "bank_daily_balance_missing")
        .when(F.col("_broken").isNotNull(), "bank_balance_mismatch")
        .when(F.col("final_balance").isNull(), "bank_final_balance_missing")
        .when(F.col("final_balance") != F.col("_last"), "bank_final_balance_mismatch")
    )
    date = F.when(code == "bank_daily_balance_missing", F.col("_missing")).when(code == "bank_balance_mismatch", F.col("_broken.date"))
    return all_.select(key, code.alias("code"), date.alias("date")).where("code is not null")


def carried(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Fills a column forward in order, as dates and texts printed once for several lines."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def continued(rows: DataFrame, key: str, starts: str, text: str) -> DataFrame:
    """Joins the text of continuation lines to the movement line before them."""
    w = Window.partitionBy(key).orderBy("ord")
    island = rows.withColumn("_island", F.sum(F.col(starts).cast("int")).over(w)).where("_island > 0")
    return island.groupBy(key, "_island").agg(F.min("ord").alias("ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(text).alias("t")))), lambda s: s["t"]), " ").alias(text))
