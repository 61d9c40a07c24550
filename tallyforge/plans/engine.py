"""Movements to entries: the cascade of transfers, rules, history, memory and defaults over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import bookkeeping as b
from tallyforge.functions.money import period_of
from tallyforge.functions.text import local_features, movement_text
from tallyforge.operators import accounts as acc
from tallyforge.operators import local, matching
from tallyforge.operators.models import arbitrated, memory_choice
from tallyforge.lineage import cut

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Base:
    """accounts (code, reduced_code, description, ord); history (ord, date, debit_account, credit_account, standard_history,
    complement); movements (ord, id, date, amount, counterparty, notes, document, financial_account, financial_name,
    source_row); examples (date, text, direction, financial_account, counterpart, standard_history, amount)."""

    accounts: DataFrame
    history: DataFrame
    movements: DataFrame
    examples: DataFrame | None = None


def of_period(movements: DataFrame, period: str) -> DataFrame:
    return movements.where((period_of(F.col("date")) == period) & (F.col("amount") != 0))


def with_text(movements: DataFrame) -> DataFrame:
    text = movement_text(F.col("counterparty"), F.col("notes"), F.col("document"), trim=True)
    return movements.withColumn("text", text).withColumn("direction", F.when(F.col("amount") > 0, "inflow").otherwise("outflow"))


def transfers(movements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of mirrored transfers, and the movements that are in none."""
    asked = movements.where(b.is_transfer(F.col("text")))
    pairs = matching.mirrored_pairs(asked.select("ord", "date", "amount", "financial_account"))
    side = lambda name: movements.select(F.col("ord").alias(name), F.struct("id", "financial_account", "financial_name", "source_row", "amount", "date").alias(f"_{name}"))
    both = pairs.join(side("left"), "left").join(side("right"), "right")
    inflow = F.when(F.col("_left.amount") > 0, F.col("_left")).otherwise(F.col("_right"))
    outflow = F.when(F.col("_left.amount") > 0, F.col("_right")).otherwise(F.col("_left"))
    null = F.lit(None).cast("string")
    name = F.concat_ws(" -> ", F.coalesce(outflow["financial_name"], F.lit("")), F.coalesce(inflow["financial_name"], F.lit("")))
    entries = both.select(
        F.col("left").alias("ord"), F.concat_ws("+", "_left.id", "_right.id").alias("id"), F.col("_left.date").alias("date"), inflow["financial_account"].alias("debit_account"),
        outflow["financial_account"].alias("credit_account"), F.abs("_left.amount").alias("amount"), null.alias("standard_history"), F.lit("Transferencia entre contas").alias("complement"),
        name.alias("financial_name"), null.alias("document"), F.filter(F.array("_left.source_row", "_right.source_row"), lambda r: r.isNotNull() & (r != 0)).alias("source_rows"),
        F.lit("LANCAR").alias("status"), F.lit("Alta").alias("confidence"), F.lit("transferencia_espelhada").alias("reason"), F.lit(1.0).alias("account_probability"),
        F.lit("matched_transfer").alias("account_probability_source"), F.lit(None).cast("double").alias("history_probability"), null.alias("history_probability_source"),
    )
    used = pairs.select(F.explode(F.array("left", "right")).alias("ord"))
    return entries, movements.join(used, "ord", "left_anti")


def _choice(counterpart, hist, confidence, reason, p, source, hp=None, hsource=None):
    cast = lambda x, t: (x if x is not None else F.lit(None)).cast(t)
    return F.struct(
        cast(counterpart, "string").alias("counterpart"), cast(hist, "string").alias("standard_history"), cast(confidence, "string").alias("confidence"), cast(reason, "string").alias("reason"),
        cast(p, "double").alias("p"), cast(source, "string").alias("source"), cast(hp, "double").alias("hp"), cast(hsource, "string").alias("hsource"),
    )


def by_rule(movements: DataFrame, roles: DataFrame) -> DataFrame:
    """Movements with the choice of the first rule that fits and whose account the chart has."""
    known = roles.select(F.col("role").alias("_role"), F.col("counterpart").alias("_counterpart"))
    rule = movements.withColumn("_role", b.rule_of(F.col("text"), F.col("direction"))).join(F.broadcast(known), "_role", "left")
    made = F.when(F.col("_counterpart").isNotNull(), _choice(F.col("_counterpart"), None, F.lit("Alta"), F.col("_role"), F.lit(1.0), F.lit("deterministic_rule")))
    return rule.withColumn("choice", made).drop("_role", "_counterpart")


def by_history(open_: DataFrame, history: DataFrame, financial: DataFrame, with_sequence: bool, prefix: str = "historico_textual") -> DataFrame:
    """ord, choice of the movements a history row resembles."""
    best = matching.best_history(open_, history, financial, with_sequence)
    confidence = F.when(F.col("score") >= 0.70, "Alta").otherwise("Media")
    hist = F.nullif(F.col("standard_history"), F.lit(""))
    return best.select("ord", _choice(F.col("counterpart"), hist, confidence, F.concat(F.lit(prefix + ":"), F.format_string("%.2f", F.bround("score", 2))), F.col("score"), F.lit("text_similarity"), F.when(hist.isNotNull(), F.col("score")), F.when(hist.isNotNull(), F.lit("source_history_similarity"))).alias("choice"))


def by_memory(open_: DataFrame, examples: DataFrame, period: str) -> DataFrame:
    """ord, choice where an approved example's features were only ever answered one way."""
    rows = examples.where((period_of(F.col("date")) < period) & F.col("counterpart").rlike("^[0-9]+$"))
    made = lambda df, amount: df.withColumns({"features": local_features(F.col("text"), F.col("direction"), F.col("financial_account"), amount), "features_text": local_features(F.col("text"), F.col("direction"), F.col("financial_account"))})
    rows, probes = made(rows, F.col("amount")), made(open_.where("financial_account is not null"), F.abs("amount")).select("ord", "features", "features_text")
    account = memory_choice(rows.withColumn("label", F.col("counterpart")), probes).select("ord", F.col("label").alias("counterpart"))
    named = rows.where(F.coalesce("standard_history", F.lit("")) != "").withColumn("label", F.col("standard_history"))
    hist = memory_choice(named, probes).select("ord", F.col("label").alias("hist"))
    both = account.join(hist, "ord", "left")
    tail = F.when(F.col("hist").isNotNull(), "|hist_texto:exact_memory:1.00").otherwise("")
    return both.select("ord", _choice(F.col("counterpart"), F.col("hist"), F.lit("Alta"), F.concat(F.lit("exact_memory:1.00"), tail), F.lit(1.0), F.lit("exact_memory"), F.when(F.col("hist").isNotNull(), F.lit(1.0)), F.when(F.col("hist").isNotNull(), F.lit("exact_memory"))).alias("choice"))


def by_models(open_: DataFrame, examples: DataFrame, period: str, client_threshold: float, far: Stage | None = None, far_threshold: float = 1.0) -> DataFrame:
    """ord, choice by the client's own model and the clients' common one (``far``: open movements -> ord, counterpart, probability).

    The own one where both its heads are sure enough, else the common one where it is, else the own, else the common; the last two are to be reviewed.
    """
    one = F.lit("").alias("client_id")
    known = examples if "ord" in examples.columns else examples.withColumn("ord", F.lit(0).cast("long"))
    own = local.predicted(known.withColumn("client_id", one), open_.select(one, "ord", "text", "direction", "financial_account", "amount"), period)
    own = own.select("ord", F.struct("counterpart", F.col("combined").alias("probability"), "p", "source", "standard_history", "hp", "hsource").alias("local"))
    if far is None:
        both = own.withColumn("global", F.struct(F.lit(None).cast("string").alias("counterpart"), F.lit(None).cast("double").alias("probability")))
    else:
        both = own.join(far(open_).select("ord", F.struct("counterpart", "probability").alias("global")), "ord", "full")
    two = lambda x: F.format_string("%.2f", F.bround(x, 2))
    local_reason = F.concat(F.col("local.source"), F.lit(":"), two(F.col("local.p")), F.coalesce(F.concat(F.lit("|hist_texto:"), F.col("local.hsource"), F.lit(":"), two(F.col("local.hp"))), F.lit("")))
    chosen = arbitrated(both, client_threshold, far_threshold).where("choice is not null")
    p = F.col("choice.probability")
    mine = _choice(F.col("local.counterpart"), F.col("local.standard_history"), F.col("choice.confidence"), local_reason, F.col("local.p"), F.col("local.source"), F.col("local.hp"), F.col("local.hsource"))
    theirs = _choice(F.col("choice.counterpart"), None, F.col("choice.confidence"), F.concat(F.lit("global_tfidf:"), two(p)), p, F.lit("global_tfidf"))
    return chosen.select("ord", F.when(F.col("choice.source") == "local", mine).otherwise(theirs).alias("choice"))


def generate(base: Base, period: str, fallback: Stage | None = None, catalog_any_month: bool = False, with_sequence: bool = True, prefix: str = "historico_textual", activity_of: DataFrame | None = None, client_threshold: float | None = None, far: Stage | None = None, far_threshold: float = 1.0) -> DataFrame:
    """Entries of a period. ``fallback`` maps open movements to (ord, choice); ``catalog_any_month`` lets history of any month classify.

    With ``client_threshold`` the approved examples train the client's model, which the cascade asks after the history, beside the common one (``far``);
    without it they are a memory only. ``prefix`` names the history in reasons, ``activity_of`` is what roles are ranked by where that is more than the history.

    Each stage sees only what the ones before left open; a movement that names several taxes is resolved by none.
    The month's movements are read by every stage twice, so they are cut from their lineage in between: a stage's work
    is then done once, and a lost executor costs no earlier stage.
    """
    financial = acc.financial_accounts(base.accounts)
    history = acc.usable_history(base.history, base.accounts, None if catalog_any_month else period)
    active = acc.activity(history if activity_of is None else activity_of)
    wanted = {reason: groups for _, _, groups, reason in b.TERM_RULES} | {f"tributo:{t}": g for t, g in b.TAX_ROLES.items()} | {f"default:{k}": g for k, g in b.DEFAULT_ROLES.items()}
    roles = acc.roles(base.accounts, active, wanted)
    moved = cut(with_text(of_period(base.movements, period)))
    paired, rest = transfers(moved)
    rest = by_rule(rest.withColumn("compound", b.is_compound(F.col("text"))), roles)
    rest = cut(rest.withColumn("choice", F.when(~F.col("compound"), F.col("choice"))))
    stages: list[Stage] = [lambda open_: by_history(open_, history, financial, with_sequence, prefix)]
    if base.examples is not None and client_threshold is not None:
        stages.append(lambda open_: by_models(open_, base.examples, period, client_threshold, far, far_threshold))
    elif base.examples is not None:
        stages.append(lambda open_: by_memory(open_, base.examples, period))
    if fallback is not None:
        stages.append(fallback)
    for stage in stages:
        open_ = rest.where("choice is null and not compound").drop("choice")
        found = stage(open_).select(F.col("ord").alias("_ord"), F.col("choice").alias("_found"))
        rest = cut(rest.join(found, rest["ord"] == found["_ord"], "left").withColumn("choice", F.coalesce("choice", "_found")).drop("_ord", "_found"))
    default = roles.where(F.startswith("role", F.lit("default:"))).select(F.substring_index("role", ":", -1).alias("direction"), F.col("counterpart").alias("_default"))
    rest = rest.join(F.broadcast(default), "direction", "left")
    rest = rest.withColumn("choice", F.when(F.col("choice").isNull() & ~F.col("compound"), _choice(F.col("_default"), None, F.lit("Baixa"), F.lit("padrao_por_direcao"), F.lit(0.0), F.lit("direction_default"))).otherwise(F.col("choice")))
    return paired.withColumns({"history_cd_candidate": F.lit(None).cast("string"), "history_cd_probability": F.lit(None).cast("double"), "history_cd_support": F.lit(None).cast("long"), "history_cd_alternatives": F.lit(None).cast("long")}).unionByName(assembled(rest, acc.pair_history(history)))


def assembled(rest: DataFrame, pairs: DataFrame) -> DataFrame:
    """Debit and credit by direction, the status, and the standard history that the pair of accounts always had."""
    inflow = F.col("direction") == "inflow"
    sided = rest.withColumns({
        "debit_account": F.when(inflow, F.col("financial_account")).otherwise(F.col("choice.counterpart")),
        "credit_account": F.when(inflow, F.col("choice.counterpart")).otherwise(F.col("financial_account")),
    })
    known = pairs.select(F.col("debit_account").alias("_d"), F.col("credit_account").alias("_c"), F.struct("candidate", "probability", "support", "alternatives", "stable").alias("_pair"))
    both = sided.join(known, (F.col("debit_account") == F.col("_d")) & (F.col("credit_account") == F.col("_c")), "left")
    stable = F.coalesce("_pair.stable", F.lit(False))
    reason = F.when(F.col("compound"), "movimento_composto_sem_memoria_de_calculo").otherwise(F.coalesce("choice.reason", F.lit("sem_classificacao")))
    confidence = F.when(F.col("compound"), "Baixa").otherwise(F.coalesce("choice.confidence", F.lit("Baixa")))
    review = F.col("debit_account").isNull() | F.col("credit_account").isNull() | (confidence == "Baixa")
    return both.select(
        "ord", "id", "date", "debit_account", "credit_account", F.abs("amount").alias("amount"), F.when(stable, F.col("_pair.candidate")).otherwise(F.col("choice.standard_history")).alias("standard_history"),
        b.history_complement(F.col("counterparty"), F.col("notes"), F.col("document"), F.col("amount")).alias("complement"), "financial_name", "document",
        F.filter(F.array("source_row"), lambda r: r.isNotNull() & (r != 0)).alias("source_rows"),
        F.when(F.col("compound"), "REVISAR RATEIO").when(review, "REVISAR CONTA").otherwise("LANCAR").alias("status"), confidence.alias("confidence"),
        F.when(stable, F.concat(reason, F.lit("|hist_contas:"), F.col("_pair.support").cast("string"), F.lit("x"))).otherwise(reason).alias("reason"),
        F.col("choice.p").alias("account_probability"), F.col("choice.source").alias("account_probability_source"),
        F.when(stable, F.col("_pair.probability")).otherwise(F.col("choice.hp")).alias("history_probability"), F.when(stable, F.lit("account_pair_frequency")).otherwise(F.col("choice.hsource")).alias("history_probability_source"),
        F.col("_pair.candidate").alias("history_cd_candidate"), F.col("_pair.probability").alias("history_cd_probability"), F.col("_pair.support").alias("history_cd_support"), F.col("_pair.alternatives").alias("history_cd_alternatives"),
    )


def in_order(entries: DataFrame, by_text: bool = False) -> DataFrame:
    """By date, source rows and amount (as a number, or as text), then as they came: transfers first."""
    amount = F.col("amount").cast("string") if by_text else F.col("amount")
    return entries.orderBy("date", "source_rows", amount, F.col("reason") != "transferencia_espelhada", "ord")


def audit(entries: DataFrame) -> DataFrame:
    """One row of counts."""
    return entries.agg(
        F.count(F.lit(1)).alias("generated_entries"), F.count_if(F.col("status") == "LANCAR").alias("launch"), F.count_if(F.col("status") != "LANCAR").alias("review_count"),
        F.count_if(F.col("reason") == "transferencia_espelhada").alias("transfers_collapsed"), F.count_if(F.startswith("reason", F.lit("global_tfidf:"))).alias("global_fallback_count"),
    )


def unknown_codes(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    used = entries.select(F.explode(F.array("debit_account", "credit_account")).alias("code")).where("code is not null").distinct()
    return used.join(accounts.select(F.col("reduced_code").alias("code")), "code", "left_anti")


def review_queue(entries: DataFrame) -> DataFrame:
    """Reasons by how often they send an entry to review, ties by the first seen."""
    queue = entries.where("status <> 'LANCAR'").groupBy("reason").agg(F.count(F.lit(1)).alias("entries"), F.min("ord").alias("first"))
    return queue.orderBy(F.desc("entries"), "first")
