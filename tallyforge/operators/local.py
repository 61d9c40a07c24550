"""Models of each client, trained and applied in parallel: rows of a model table, no loop over clients.

A client's model has two heads, for the counterpart and for the standard history. A head answers from memory (features seen with one label
only, with the amount first, then without), else by its text classifier, else with its most frequent label. Memory and majority are groupings;
classifiers learn from all approved rows, equal ones being one that weighs as much as they are. A client's head of at most ``MOST`` different
rows is trained in one task; one of more has its rows in several tasks, whose slopes are added up in each step.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import period_of
from tallyforge.functions.text import local_features, normalized
from tallyforge.lineage import cut, few, tasks
from tallyforge.operators.textmodel import BLOCKS, LEAST_LABELS, LEAST_ROWS, ROUNDS, TextModel, Vectors, counted
from tallyforge.shipping import ship

if TYPE_CHECKING:
    from pyspark import RDD

#: Different rows of a classifier that one task holds (one of more is trained over several), and probes one task answers.
MOST, PROBES = 20_000, 5_000
#: Steps of a training over several tasks between two checkpoints.
_STEPS = 10
HEADS = {"account": "counterpart", "history": "standard_history"}


def head_rows(examples: DataFrame, period: str | None = None) -> DataFrame:
    """Approved examples (client_id, ord, date, text, direction, financial_account, amount, counterpart, standard_history) as rows (client_id, head, label, ord, features, features_text).

    Only rows before the period count, and only those whose counterpart is a number; rows without a standard history have none in that head.
    """
    rows = examples.where(F.coalesce(F.col("counterpart"), F.lit("")).rlike("^[0-9]+$"))
    rows = rows if period is None else rows.where(period_of(F.col("date")) < period)
    made = lambda amount: local_features(F.col("text"), F.col("direction"), F.coalesce("financial_account", F.lit("")), amount)
    rows = rows.withColumns({"features": made(F.col("amount")), "features_text": made(None)})
    heads = F.array(*[F.struct(F.lit(h).alias("head"), F.nullif(F.col(c), F.lit("")).alias("label")) for h, c in HEADS.items()])
    return rows.select("client_id", "ord", "features", "features_text", F.inline(heads)).where("label is not null")


def memory(rows: DataFrame, features: str) -> DataFrame:
    """client_id, head, features, label: what a client's rows were only ever answered with."""
    return rows.groupBy("client_id", "head", F.col(features).alias("features")).agg(F.count_distinct("label").alias("_n"), F.min("label").alias("label")).where("_n = 1").drop("_n")


def majority(rows: DataFrame, number: Column | None = None) -> DataFrame:
    """client_id, head, majority: the most frequent label, of equal ones the first seen; ``number`` is how many rows a row stands for."""
    each = rows.groupBy("client_id", "head", "label").agg(F.count(F.lit(1)).alias("_n") if number is None else F.sum(number).alias("_n"), F.min("ord").alias("_first"))
    return each.groupBy("client_id", "head").agg(F.max_by("label", F.struct("_n", -F.col("_first"))).alias("majority"))


def bounded(rows: DataFrame, key: list[str], most: int = MOST, sizes: DataFrame | None = None) -> DataFrame:
    """At most ``most`` rows of each key, those with the smallest hashes, to look at: no model, count or threshold is made of them. A hash that lets about twice as many through thins large keys out before any are ranked."""
    sizes = few(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_all")) if sizes is None else sizes)
    place = F.pmod(F.xxhash64("ord", "features", "label"), F.lit(1 << 30)) / float(1 << 30)
    thin = rows.join(sizes, key).withColumn("_place", place).where(F.col("_place") * F.col("_all") <= 2.0 * most)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_place", "ord", "features", "label"))
    return thin.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_all", "_place", "_rank")


def classifiers(rows: DataFrame, key: list[str], most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """(key, model): a row for each key that has two labels of two rows. Rows (key, features, label) all count, those with ``_n`` as so many."""
    ship(rows.sparkSession)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        model = TextModel(own["features"].tolist(), own["label"].tolist(), own["_n"].tolist(), rounds)
        held = {k: [own[k].iloc[0]] for k in key} | {"model": [pickle.dumps(model)]}
        return pd.DataFrame(held if model.ready else {k: [] for k in held}, dtype=object)

    number = F.sum("_n") if "_n" in rows.columns else F.count(F.lit(1))
    each = cut(rows.groupBy(*key, _plain(), "label").agg(number.alias("_n")))
    sizes = few(each.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")))
    each = each.join(sizes, key)
    models = each.where("_parts = 1").select(*key, "features", "label", "_n").groupBy(*key).applyInPandas(run, _kinds(rows, key) + ", model binary")
    large = each.where("_parts > 1")
    return models if large.isEmpty() else models.unionByName(_over_tasks(large, key, rounds))


def _kinds(rows: DataFrame, key: list[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)


def _over_tasks(each: DataFrame, key: list[str], rounds: int) -> DataFrame:
    """(key, model) of keys with more rows (key, _parts, features, label, _n) than a task holds.

    The same steps as a task's: terms are counted by a shuffle, each part's rows are vectors in one task, and the parts' slopes are added up by
    key before the step. A model with its terms is one task's, as it is where it answers; the rows never are.
    """
    spark, n, width = each.sparkSession, tasks(each), len(key)
    enough = each.groupBy(*key, "label").agg(F.sum("_n").alias("_all")).where(F.col("_all") >= LEAST_LABELS).drop("_all")
    rows = cut(each.join(enough, [*key, "label"]).select(*key, "_parts", F.pmod(F.xxhash64("features", "label"), F.col("_parts")).cast("int").alias("_part"), "features", "label", "_n"))

    def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, found in batch.groupby(key, dropna=False):
                blocks = counted(found["features"].tolist(), found["_n"].tolist())
                out = pd.DataFrame([(i, t, m) for i, block in enumerate(blocks) for t, m in block.items()], columns=["block", "term", "_m"])
                for k, value in zip(key, own, strict=True):
                    out[k] = value
                yield out[[*key, "block", "term", "_m"]]

    terms = rows.select(*key, "features", "_n").mapInPandas(terms_of, _kinds(each, key) + ", block int, term string, _m long").groupBy(*key, "block", "term").agg(F.sum("_m").alias("_m")).where(F.col("_m") >= LEAST_ROWS)
    held = terms.groupBy(*key).agg(F.collect_list(F.struct("block", "term", "_m")).alias("_terms"))
    heads = rows.groupBy(*key, "_parts").agg(F.sum("_n").alias("_total"), F.array_sort(F.collect_set("label")).alias("_labels")).where(F.size("_labels") >= 2)

    def begun(r) -> tuple:
        counts: list[Counter[str]] = [Counter() for _ in BLOCKS]
        for block, term, m in r["_terms"] or []:
            counts[block][term] = m
        return tuple(r[:width]), (r["_parts"], r["_total"], TextModel.begun(list(r["_labels"]), Vectors.of_counts(counts, r["_total"])))

    def sent(models: RDD) -> RDD:
        """Each model to the tasks that have its rows."""
        return models.flatMap(lambda m: [((m[0], i), m[1]) for i in range(m[1][0])]).partitionBy(n)

    def stepped(both: tuple) -> tuple:
        (parts, total, model), slopes = both
        model.step(*slopes)
        return parts, total, model

    models = heads.join(held, key, "left").rdd.map(begun).partitionBy(n).persist()
    texts = rows.rdd.map(lambda r: ((tuple(r[:width]), r["_part"]), (r["features"], r["label"], r["_n"]))).groupByKey(n)
    blocks = texts.join(sent(models), n).mapValues(lambda x: x[1][2].block(*map(list, zip(*sorted(x[0]), strict=True)), x[1][1])).persist()
    for i in range(rounds):
        light = models.mapValues(lambda m: (m[0], (m[2].weights, m[2].bias)))
        slopes = blocks.join(sent(light), n).map(lambda x: (x[0][0], x[1][0].slopes(*x[1][1][1]))).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), n)
        before, models = models, models.join(slopes, n).mapValues(stepped).persist()
        if i % _STEPS == _STEPS - 1:
            models.checkpoint()
        models.count()
        before.unpersist()

    def ended(m: tuple) -> tuple:
        m[1][2].end()
        return (*m[0], bytearray(pickle.dumps(m[1][2])))

    out = cut(spark.createDataFrame(models.map(ended), _kinds(each, key) + ", model binary"))
    models.unpersist()
    blocks.unpersist()
    return out


def classified(models: DataFrame, probes: DataFrame, key: list[str], most: int = PROBES) -> DataFrame:
    """Probes (key, ord, features) of keys with a model, with label, probability and ranked labels."""
    probes = probes.select(*key, "ord", _plain())
    return probes.join(answers(models, probes, key, most), [*key, "features"]).select(*key, "ord", "label", "probability", "ranked")


def _plain() -> Column:
    """Null and empty texts are answered alike."""
    return F.coalesce("features", F.lit("")).alias("features")


def answers(models: DataFrame, probes: DataFrame, key: list[str], most: int = PROBES) -> DataFrame:
    """(key, features) of probes with label, probability and ranked labels. Each text of a key is answered once; a task has one model and about ``most`` texts."""
    ship(probes.sparkSession)
    texts = cut(probes.select(*key, "features").distinct())
    sizes = texts.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts"))
    asked = texts.join(sizes, key).withColumn("_part", F.pmod(F.xxhash64("features"), F.col("_parts")).cast("int")).select(*key, "_part", "features")
    known = models.join(sizes, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "model")

    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = [*key, "features", "label", "probability", "ranked"]
        if asked.empty or known.empty:
            return pd.DataFrame({c: [] for c in columns}, dtype=object)
        model = pickle.loads(known["model"].iloc[0])
        p = model.predict(asked["features"].tolist())
        ranked = (-p).argsort(1, kind="stable")
        out = asked[[*key, "features"]].reset_index(drop=True)
        out["ranked"] = [[model.labels[i] for i in r] for r in ranked]
        out["label"] = [r[0] for r in out["ranked"]]
        out["probability"] = p.max(1)
        # as Python's own values: a column of strings in pandas may be in several pieces, which Arrow batches can't take
        return out[columns].astype(object)

    schema = _kinds(probes, key) + ", features string, label string, probability double, ranked array<string>"
    at = [*key, "_part"]
    return few(asked.groupBy(*at).cogroup(known.groupBy(*at)).applyInPandas(run, schema))


def predicted(examples: DataFrame, probes: DataFrame, period: str | None = None) -> DataFrame:
    """Probes (client_id, ord, text, direction, financial_account, amount) of clients with approved examples -> client_id, ord, counterpart, p, source, standard_history, hp, hsource, combined.

    ``combined`` is the smaller of the two heads' probabilities, or the first where the client's examples have no standard history. Probes without an account or a text get no row.
    """
    rows = head_rows(examples, period)
    # memory asks how rows differ, majority and the classifiers how often they occur as well
    each = cut(rows.groupBy("client_id", "head", "label", "features", "features_text").agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("ord")))
    asked = probes.where(F.col("financial_account").isNotNull() & (normalized(F.col("text")) != ""))
    made = lambda amount: local_features(F.col("text"), F.col("direction"), F.col("financial_account"), amount)
    asked = asked.select("client_id", "ord", made(F.abs("amount")).alias("features"), made(None).alias("features_text"))
    heads = majority(each, F.col("_n"))
    asked = cut(asked.join(heads, "client_id"))
    first = memory(each, "features").withColumnRenamed("label", "_with")
    second = memory(each, "features_text").withColumnsRenamed({"features": "features_text", "label": "_without"})
    known = asked.join(first, ["client_id", "head", "features"], "left").join(second, ["client_id", "head", "features_text"], "left").withColumn("_memory", F.coalesce("_with", "_without"))
    key = ["client_id", "head"]
    open_ = known.where("_memory is null").select(*key, "ord", "features")
    told = classified(classifiers(each.select(*key, "features", "label", "_n"), key), open_, key).select(*key, "ord", F.col("label").alias("_told"), "probability")
    found = known.join(told, [*key, "ord"], "left").select(
        *key, "ord", F.coalesce("_memory", "_told", "majority").alias("label"), F.when(F.col("_memory").isNotNull(), 1.0).otherwise(F.coalesce("probability", F.lit(0.0))).alias("p"),
        F.when(F.col("_memory").isNotNull(), "exact_memory").when(F.col("_told").isNotNull(), "client_tfidf").otherwise("client_majority").alias("source"),
    )
    of = lambda head: F.max(F.when(F.col("head") == head, F.struct("label", "p", "source")))
    both = found.groupBy("client_id", "ord").agg(of("account").alias("a"), of("history").alias("h"))
    return both.select(
        "client_id", "ord", F.col("a.label").alias("counterpart"), "a.p", "a.source", F.col("h.label").alias("standard_history"), F.col("h.p").alias("hp"), F.col("h.source").alias("hsource"),
        F.least("a.p", F.coalesce("h.p", F.lit(1.0))).alias("combined"),
    )


def without_each(rows: DataFrame) -> DataFrame:
    """Leaving each client out: rows (client_id, ord, date, features, label) of several clients -> client_id, ord, actual, seen, label, probability, ranked.

    A client's model is trained on all rows of all other clients before the client's last month, equal rows being one that weighs as much as they
    are; models are rows of a table, trained side by side. Clients without two labels to learn from have no rows.
    """
    each = cut(rows.groupBy("client_id", period_of(F.col("date")).alias("month"), _plain(), "label").agg(F.count(F.lit(1)).alias("_n")))
    last = each.groupBy("client_id").agg(F.max("month").alias("last"))
    # what there is before a month is added up once for all clients that end in it, and what is a client's own taken off
    months = each.groupBy("month", "features", "label").agg(F.sum("_n").alias("_n"))
    before = months.join(F.broadcast(last.select("last").distinct()), F.col("month") < F.col("last")).groupBy("last", "features", "label").agg(F.sum("_n").alias("_all"))
    own = each.join(last, "client_id").where("month < last").groupBy("client_id", "features", "label").agg(F.sum("_n").alias("_own"))
    folds = last.join(before, "last").join(own, ["client_id", "features", "label"], "left").withColumn("_n", F.col("_all") - F.coalesce("_own", F.lit(0))).where("_n > 0")
    folds = cut(folds.select("client_id", "features", "label", "_n"))
    known = folds.select("client_id", F.col("label").alias("actual"), F.lit(True).alias("_seen")).distinct()
    asked = rows.select("client_id", "ord", _plain(), F.col("label").alias("actual"))
    told = asked.join(answers(classifiers(folds, ["client_id"]), asked, ["client_id"]), ["client_id", "features"]).join(few(known), ["client_id", "actual"], "left")
    return told.select("client_id", "ord", "actual", F.coalesce("_seen", F.lit(False)).alias("seen"), "label", "probability", "ranked")


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """client_id, rows, top_1, top_3, seen, mean_confidence of the rows that without_each() gives."""
    right: Column = F.col("actual") == F.col("label")
    return predictions.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(right.cast("int")).alias("top_1"), F.avg(F.array_contains(F.slice("ranked", 1, 3), F.col("actual")).cast("int")).alias("top_3"),
        F.avg(F.col("seen").cast("int")).alias("seen"), F.avg("probability").alias("mean_confidence"),
    )
