"""The chart of accounts: hierarchy, semantic identity, financial accounts, activity and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bookkeeping import FINANCIAL_PARENTS, has_role
from tallyforge.functions.money import period_of
from tallyforge.functions.text import plain

#: Fixed value: the name that goes into semantic keys.
PATH_SCHEMA = "chart-description-path.v1"
#: Fixed value: ends of the levels of an undotted code of eight digits.
UNDOTTED_ENDS = (1, 2, 3, 5, 8)


def ancestors(code: Column) -> Column:
    """Codes of an account's levels from the top to itself, lower levels zeroed."""
    parts = F.split(code, r"\.")
    zeros = lambda p: F.regexp_replace(p, ".", "0")
    dotted = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda d: F.array_join(F.transform(parts, lambda p, i: F.when(i < d, p).otherwise(zeros(p))), "."),
    )
    undotted = F.array(*[F.rpad(F.substring(code, 1, e), 8, "0") for e in UNDOTTED_ENDS])
    return F.when(F.size(parts) > 1, dotted).when(code.rlike("^[0-9]{8}$"), undotted).otherwise(F.array(code))


def semantic_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts (code, reduced_code, description) -> reduced_code, path, semantic_key of those with a reduced code.

    The path joins the plain descriptions of the levels that are in the chart; equal paths of different charts
    give equal keys.
    """
    own = accounts.where(F.coalesce("reduced_code", F.lit("")) != "")
    names = accounts.groupBy("code").agg(F.max_by("description", "ord").alias("_name")).select(F.col("code").alias("_code"), plain(F.col("_name")).alias("_name"))
    levels = own.select("reduced_code", "description", "ord", F.posexplode(ancestors(F.col("code"))).alias("_level", "_code"))
    joined = levels.join(names, "_code", "left").groupBy("reduced_code", "ord", "description").agg(
        F.array_sort(F.collect_list(F.when(F.coalesce("_name", F.lit("")) != "", F.struct("_level", "_name")))).alias("_names")
    )
    path = F.array_join(F.col("_names")["_name"], " > ")
    path = F.when(path != "", path).otherwise(plain(F.col("description")))
    last = joined.select("reduced_code", "ord", path.alias("path")).groupBy("reduced_code").agg(F.max_by("path", "ord").alias("path"))
    return last.withColumn("semantic_key", F.sha2(F.concat(F.lit(PATH_SCHEMA), F.char(F.lit(0)), F.col("path")), 256))


def unique_keys(semantic: DataFrame) -> DataFrame:
    """semantic_key -> the local code, for keys with exactly one; others abstain."""
    return semantic.groupBy("semantic_key").agg(F.count(F.lit(1)).alias("_n"), F.min("reduced_code").alias("counterpart")).where("_n = 1").drop("_n")


def resolved(rows: DataFrame, semantic: DataFrame) -> DataFrame:
    """Rows with a counterpart code -> the same with semantic_key and a reject reason where the chart lacks the code."""
    keys = semantic.select(F.col("reduced_code").alias("counterpart"), "semantic_key")
    # codes that occur, once each: a chart of any size meets these, and they are mostly so few that rows need not be dealt by their code, as many may share one
    found = rows.select("counterpart").distinct().join(keys, "counterpart")
    return rows.join(found, "counterpart", "left").withColumn("reject", F.when(F.col("semantic_key").isNull(), "counterpart_not_in_chart"))


def conflicts(accounts: DataFrame) -> DataFrame:
    """Keys (reduced code, else code) that charts describe differently."""
    key = F.coalesce(F.nullif(F.col("reduced_code"), F.lit("")), F.col("code"))
    return accounts.groupBy(key.alias("account_key")).agg(F.count_distinct(plain(F.col("description"))).alias("descriptions")).where("descriptions > 1")


def merged_charts(accounts: DataFrame) -> DataFrame:
    """One row per key, the last in order."""
    key = F.coalesce(F.nullif(F.col("reduced_code"), F.lit("")), F.col("code"))
    return accounts.groupBy(key.alias("account_key")).agg(*(F.max_by(c, "ord").alias(c) for c in accounts.columns))


def financial_accounts(accounts: DataFrame, parents: dict[str, str] = FINANCIAL_PARENTS) -> DataFrame:
    """reduced_code, kind: accounts below (or at) a parent whose description has the kind's words.

    A parent's prefix is its code without the last part. Prefixes are a handful of rows of the chart itself.
    """
    kinds = F.array(*[F.when(F.contains(plain(F.col("description")), F.lit(words)), F.lit(kind)) for kind, words in parents.items()])
    prefix = F.concat(F.regexp_replace("code", r"\.[^.]*$", ""), F.lit("."))
    above = accounts.select(prefix.alias("_prefix"), F.explode(kinds).alias("kind")).where("kind is not null").distinct()
    # an equi-join on every prefix of a code, rather than a range join
    own = accounts.where(F.coalesce("reduced_code", F.lit("")) != "").withColumn("_parts", F.split("code", r"\."))
    own = own.withColumn("_prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda n: F.concat(F.array_join(F.slice("_parts", F.lit(1), n), "."), F.lit(".")))))
    return own.join(above, "_prefix").select("reduced_code", "kind").distinct()


def financial_by_path(semantic: DataFrame, parents: dict[str, str] = FINANCIAL_PARENTS) -> DataFrame:
    """The training side's rule: the path itself has a kind's words."""
    has = F.lit(False)
    for words in parents.values():
        has = has | F.contains("path", F.lit(words))
    return semantic.where(has).select("reduced_code")


def usable_history(history: DataFrame, accounts: DataFrame, before_period: str | None = None) -> DataFrame:
    """History rows with both accounts in the chart, and of months before a period if one is given."""
    codes = accounts.where(F.coalesce("reduced_code", F.lit("")) != "").select("reduced_code").distinct()
    rows = history if before_period is None else history.where(period_of(F.col("date")) < before_period)
    for side in ("debit_account", "credit_account"):
        rows = rows.join(codes, rows[side] == codes["reduced_code"], "left_semi")
    return rows


def activity(history: DataFrame) -> DataFrame:
    """reduced_code, activity: rows an account is on either side of."""
    return history.select(F.explode(F.array("debit_account", "credit_account")).alias("reduced_code")).groupBy("reduced_code").agg(F.count(F.lit(1)).alias("activity"))


def roles(accounts: DataFrame, active: DataFrame, wanted: dict[str, tuple[tuple[str, ...], ...]]) -> DataFrame:
    """role, counterpart: of the accounts whose description fits a role, the most active; ties go to the chart's order."""
    own = accounts.where(F.coalesce("reduced_code", F.lit("")) != "").join(active, "reduced_code", "left")
    fits = F.array(*[F.when(has_role(F.col("description"), groups), F.lit(role)) for role, groups in wanted.items()])
    best = own.select("reduced_code", "ord", F.coalesce("activity", F.lit(0)).alias("_activity"), F.explode(fits).alias("role")).where("role is not null")
    return best.groupBy("role").agg(F.max_by("reduced_code", F.struct("_activity", -F.col("ord"))).alias("counterpart"))


def pair_history(history: DataFrame) -> DataFrame:
    """P(standard history | debit, credit): mode (ties: first seen), probability, support, alternatives, stable."""
    rows = history.where(F.trim(F.coalesce("standard_history", F.lit(""))) != "").withColumn("_hist", F.trim("standard_history"))
    each = rows.groupBy("debit_account", "credit_account", "_hist").agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_first"))
    out = each.groupBy("debit_account", "credit_account").agg(
        F.max_by("_hist", F.struct("_n", -F.col("_first"))).alias("candidate"), F.max("_n").alias("_top"), F.sum("_n").alias("support"), F.count(F.lit(1)).alias("alternatives")
    )
    return out.select("debit_account", "credit_account", "candidate", (F.col("_top") / F.col("support")).alias("probability"), "support", "alternatives", ((F.col("support") >= 2) & (F.col("_top") == F.col("support"))).alias("stable"))


def exact_memory(rows: DataFrame, features: str, label: str) -> DataFrame:
    """Features that were only ever seen with one label."""
    return rows.groupBy(F.col(features).alias("features")).agg(F.count_distinct(label).alias("_n"), F.min(label).alias("label")).where("_n = 1").drop("_n")


def supported(rows: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows whose label occurs at least so often."""
    often = rows.groupBy(label).count().where(F.col("count") >= least).select(label)
    return rows.join(often, label, "left_semi")


def majority(rows: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label, ties to the first seen."""
    each = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_first"))
    return each.agg(F.max_by(label, F.struct("_n", -F.col("_first"))).alias("label"))


def last_window(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc("ord"))
