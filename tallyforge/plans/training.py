"""Training and testing of the account model over several clients' histories."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.money import next_period, period_of
from tallyforge.functions.text import global_features
from tallyforge.operators import accounts as acc
from tallyforge.operators import local, models
from tallyforge.operators.ordering import numbered

SCHEMA = "global-account-counterpart.v1"


def dataset(clients: dict[str, tuple[DataFrame, DataFrame]], before_period: str) -> tuple[DataFrame, DataFrame]:
    """Clients' (history, accounts) -> eligible rows (client_id, date, label, features_text) and the audit by client and reason."""
    if not clients:
        raise ValueError("no client")
    parts = []
    for client, (history, accounts) in clients.items():
        semantic = acc.semantic_accounts(accounts)
        rows = models.training_rows(history, semantic, acc.financial_by_path(semantic), before_period)
        parts.append(rows.withColumn("client_id", F.lit(client)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    audit = every.groupBy("client_id", F.coalesce("reject", F.lit("eligible_rows")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
    rows = every.where("reject is null").select("client_id", "date", F.col("semantic_key").alias("label"), global_features(F.col("complement"), F.col("direction")).alias("features_text"))
    return rows, audit


def evaluated(rows: DataFrame, features: int = 1 << 12) -> DataFrame:
    """Metrics of the temporal hold-out and of leaving each client out, a row each. Clients' models are trained side by side, not in a loop."""
    train, test, month = models.temporal_split(rows)
    whole = _metrics(train, test, f"before {month}", features)
    numbered_rows = numbered(rows.select("client_id", "date", F.col("features_text").alias("features"), "label"), ["client_id", "date"])
    folds = local.fold_metrics(local.without_each(numbered_rows)).withColumn("split", F.concat(F.lit("without "), F.col("client_id").cast("string")))
    return whole.unionByName(folds.select(*whole.columns))


def _metrics(train: DataFrame, test: DataFrame, name: str, features: int) -> DataFrame:
    seen = train.select("label").distinct().withColumn("_seen", F.lit(True))
    predicted = models.predict_texts(models.fit(train, features), test.join(seen, "label", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False))))
    return models.metrics(predicted, seen=F.col("_seen")).withColumn("split", F.lit(name))


def save(model: PipelineModel, path: str, before_period: str, threshold: float | None, rows: int) -> None:
    """The pipeline in Spark's own format, and its metadata beside it."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    held = json.dumps({"schema_version": SCHEMA, "trained_before": before_period, "auto_threshold": threshold, "rows": rows}, sort_keys=True)
    spark.createDataFrame([(held,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(path: str, period: str) -> tuple[PipelineModel, dict]:
    """Refuses other schemas, and models trained on the period or later."""
    spark = SparkSession.active()
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if metadata.get("schema_version") != SCHEMA:
        raise ValueError("unknown model schema")
    models.checked_cutoff(metadata["trained_before"], period)
    return PipelineModel.load(f"{path}/model"), metadata


def fallback(model: PipelineModel, threshold: float, accounts: DataFrame):
    """A stage for the engine: the predicted key's account, if the chart has exactly one, sure from the threshold on."""
    from tallyforge.plans.engine import _choice

    unique = acc.unique_keys(acc.semantic_accounts(accounts))

    def stage(open_: DataFrame) -> DataFrame:
        asked = open_.select("ord", global_features(F.col("text"), F.col("direction")).alias("features_text"))
        found = models.predict(model, asked).select("ord", F.col("predicted").alias("semantic_key"), "confidence").join(unique, "semantic_key")
        sure = F.when(F.col("confidence") >= threshold, "Alta").otherwise("Baixa")
        return found.select("ord", _choice(F.col("counterpart"), None, sure, F.concat(F.lit("global_tfidf:"), F.format_string("%.2f", F.bround("confidence", 2))), F.col("confidence"), F.lit("global_tfidf")).alias("choice"))

    return stage


def tested(model: PipelineModel, history: DataFrame, accounts: DataFrame, period: str, threshold: float) -> DataFrame:
    """One row about a month the model has not seen: top-1, top-3, share of keys with one account, coverage and precision from the threshold on."""
    semantic = acc.semantic_accounts(accounts)
    rows = models.training_rows(history.where(period_of(F.col("date")) == period), semantic, acc.financial_by_path(semantic), _after(period)).where("reject is null")
    asked = rows.select(F.col("semantic_key").alias("label"), global_features(F.col("complement"), F.col("direction")).alias("features_text"))
    found = models.predict(model, asked)
    one = acc.unique_keys(semantic).select(F.col("semantic_key").alias("predicted"), F.lit(True).alias("_one"))
    found = found.join(one, "predicted", "left").withColumn("_one", F.coalesce("_one", F.lit(False)))
    auto, right = F.col("_one") & (F.col("confidence") >= threshold), F.col("label") == F.col("predicted")
    return found.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(right.cast("int")).alias("top_1"), F.avg(F.array_contains(F.slice("ranked", 1, 3), F.col("label")).cast("int")).alias("top_3"),
        F.avg(F.col("_one").cast("int")).alias("mappable"), F.avg(auto.cast("int")).alias("auto_coverage"), F.avg(F.when(auto, right.cast("int"))).alias("auto_precision"),
    )


def _after(period: str) -> str:
    spark = SparkSession.active()
    return spark.range(1).select(next_period(F.lit(period))).first()[0]
