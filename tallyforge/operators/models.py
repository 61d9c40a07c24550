"""Text models for account choice: TF-IDF, linear classifier, memory, arbitration, thresholds and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, NGram, RegexTokenizer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.feature import Binarizer, ElementwiseProduct, HashingTF, IDF, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import period_of
from tallyforge.lineage import cut, spread

# The confidences a gate may choose from.
GATES = (0.80, 0.85, 0.90, 0.95, 0.98, 1.00)


def word_ngrams(text: Column) -> Column:
    """Words of two or more word characters, and pairs of neighbours."""
    ws = F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), F.lit(0))
    pairs = F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1)))
    return F.concat(ws, pairs)


def char_ngrams(text: Column, shortest: int = 3, longest: int = 5) -> Column:
    """Character n-grams within words, each word between blanks."""
    padded = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_length(n: int) -> Column:
        windows = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        # a word shorter than n gives itself, and once only
        return F.flatten(F.transform(F.filter(padded, lambda w: (F.length(w) >= n) | F.lit(n == shortest)), windows))

    grams = [of_length(n) for n in range(shortest, longest + 1)]
    return F.concat(*grams)


def tfidf(rows: DataFrame, key: str, terms: Column, least: int = 2, most: int | None = None) -> DataFrame:
    """key, term, weight: sublinear tf times smoothed idf, unit length per key. Terms in fewer than ``least`` rows go.

    ``most`` keeps the terms with the highest total frequency (ties by term).
    """
    n = rows.count()
    counts = rows.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    document = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least)
    if most:
        document = document.orderBy(F.desc("total"), "term").limit(most)
    weight = (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    weighted = counts.join(document, "term").select(key, "term", weight.alias("weight"))
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return weighted.join(norm, key).select(key, "term", (F.col("weight") / F.col("_norm")).alias("weight"))


#: Terms a block of the clients' common model keeps at most (fixed values): words and pairs, character grams.
MOST_WORDS, MOST_GRAMS = 12_000, 16_000


def union_tfidf(rows: DataFrame, key: str, text: Column, most_words: int | None = MOST_WORDS, most_grams: int | None = MOST_GRAMS) -> DataFrame:
    """key, block, term, weight: words and pairs in one block, character grams in another, each of unit length per key.

    Each block's vocabulary is exact: the terms of two rows or more with the highest total frequency, ties by term; no term shares a place with another.
    """
    blocks = (("word", word_ngrams(text), most_words), ("char", char_ngrams(text), most_grams))
    word, char = (tfidf(rows, key, terms, most=most).select(key, F.lit(name).alias("block"), "term", "weight") for name, terms, most in blocks)
    return word.unionByName(char)


def classifier(features: int = 1 << 15, regularisation: float = 1e-5) -> Pipeline:
    """Word 1-2-grams by TF-IDF into a multinomial logistic regression; character grams come in as ``grams``."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label", outputCol="_label", stringOrderType="frequencyDesc"),
            RegexTokenizer(inputCol="features_text", outputCol="_words", pattern=r"\b\w\w+\b", gaps=False),
            NGram(n=2, inputCol="_words", outputCol="_pairs"),
            HashingTF(inputCol="_words", outputCol="_tf1", numFeatures=features),
            HashingTF(inputCol="_pairs", outputCol="_tf2", numFeatures=features),
            HashingTF(inputCol="grams", outputCol="_tf3", numFeatures=features),
            VectorAssembler(inputCols=["_tf1", "_tf2", "_tf3"], outputCol="_tf"),
            IDF(inputCol="_tf", outputCol="_idf", minDocFreq=2),
            Normalizer(inputCol="_idf", outputCol="_x"),
            LogisticRegression(featuresCol="_x", labelCol="_label", regParam=regularisation, maxIter=60, probabilityCol="_p", predictionCol="_best"),
        ]
    )


def fit(rows: DataFrame, features: int = 1 << 12) -> PipelineModel:
    """Rows (features_text, label); labels seen once are left out, and two labels must remain.

    A text is read once, however often it occurs: its vector is made once, and each of its labels is one row that weighs as much as there are rows of
    both. Document frequencies are sums of these weights; the penalty is adjusted as Spark's deviation of weighted rows is larger by one factor than that of single rows.
    """
    each = rows.groupBy("features_text", "label").agg(F.count(F.lit(1)).alias("_n"))
    texts = cut(spread(each.groupBy("features_text").agg(F.collect_list(F.struct("label", "_n")).alias("_labels"))))
    # as the indexer has them: by how many rows they have, equal ones by name
    sizes = texts.select(F.inline("_labels")).where("label is not null").groupBy("label").agg(F.sum("_n").alias("_n")).where("_n >= 2").collect()
    labels = [r.label for r in sorted(sizes, key=lambda r: (-r["_n"], r.label))]
    if len(labels) < 2:
        raise ValueError("at least two labels with two rows each are needed")
    _, tokens, pairs, *hashed, assembler, idf, unit, regression = classifier(features).getStages()
    counted = [tokens, pairs, *hashed, assembler]
    known = F.filter("_labels", lambda e: F.array_contains(F.array(*[F.lit(x) for x in labels]), e["label"]))
    vectors = texts.withColumn("_labels", known).where(F.size("_labels") > 0).withColumn("grams", char_ngrams(F.col("features_text")))
    for stage in counted:
        vectors = stage.transform(vectors)
    vectors = cut(vectors.select("_labels", F.aggregate("_labels", F.lit(0).cast("long"), lambda n, e: n + e["_n"]).cast("double").alias("_n"), "_tf"))
    present = Binarizer(threshold=0.0, inputCol="_tf", outputCol="_there").transform(vectors)
    total = present.agg(Summarizer.metrics("sum").summary(F.col("_there"), F.col("_n")).alias("s"), F.sum("_n").alias("n")).first()
    frequency = total.s["sum"].toArray()
    scale = np.where(frequency >= idf.getMinDocFreq(), np.log((total.n + 1) / (frequency + 1)), 0.0)
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="_tf", outputCol="_idf")
    indexer = StringIndexerModel.from_labels(labels, inputCol="label", outputCol="_label")
    weighted = indexer.transform(unit.transform(weigh.transform(vectors)).select("_x", F.inline("_labels")).withColumn("_n", F.col("_n").cast("double")))
    squares = weighted.agg(F.sum(F.col("_n") * F.col("_n"))).first()[0]
    spared = (total.n - squares / total.n) / (total.n - 1)
    regression = regression.copy({regression.weightCol: "_n", regression.regParam: regression.getRegParam() * spared})
    return PipelineModel([indexer, *counted, weigh, unit, regression.fit(weighted)])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds predicted, confidence and ranked (labels by probability, stable)."""
    labels = model.stages[0].labels
    named = F.array(*[F.lit(x) for x in labels])
    # an unseen label must not drop the row, so the indexer is left out
    out = rows.withColumn("grams", char_ngrams(F.col("features_text")))
    for stage in model.stages[1:]:
        out = stage.transform(out)
    out = IndexToString(inputCol="_best", outputCol="predicted", labels=labels).transform(out)
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array(F.col("_p"))
    ranked = F.transform(F.array_sort(F.zip_with(p, F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda q, i: F.struct((-q).alias("q"), i.alias("i")))), lambda s: F.get(named, s["i"]))
    return out.select(*rows.columns, "predicted", F.array_max(p).alias("confidence"), ranked.alias("ranked"))


def predict_texts(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """As predict(), each text once; rows are in no order."""
    return rows.join(predict(model, rows.select("features_text").distinct()), "features_text")


def metrics(predictions: DataFrame, label: str = "label", seen: Column | None = None) -> DataFrame:
    """One row: rows, top-1 and top-3 accuracy, share of labels seen in training, mean confidence."""
    seen = F.lit(True) if seen is None else seen
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col(label) == F.get("ranked", F.lit(0))).cast("int")).alias("top_1"),
        F.avg(F.array_contains(F.slice("ranked", 1, 3), F.col(label)).cast("int")).alias("top_3"), F.avg(seen.cast("int")).alias("seen"), F.avg("confidence").alias("mean_confidence"),
    )


def calibrated(observations: DataFrame, target: float, least: int = 20) -> DataFrame:
    """One row: the lowest confidence from which upwards precision reaches the target over at least ``least`` rows.

    Equal confidences are one step, so counts are summed per confidence first and accumulated over these.
    """
    steps = observations.groupBy("confidence").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("correct").cast("long")).alias("_right"))
    down = Window.orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("confidence", F.sum("_n").over(down).alias("accepted"), F.sum("_right").over(down).alias("_good"))
    ok = steps.where((F.col("accepted") >= least) & (F.col("_good") / F.col("accepted") >= target))
    best = F.min_by(F.struct("confidence", "accepted", (F.col("_good") / F.col("accepted")).alias("precision")), "confidence")
    total = observations.agg(F.count(F.lit(1)).alias("observations"))
    out = ok.agg(best.alias("b")).crossJoin(total)  # one row by one row
    return out.select(
        F.lit(target).alias("target_precision"), F.col("b.confidence").alias("threshold"), F.coalesce("b.accepted", F.lit(0)).alias("accepted"), F.col("b.precision").alias("precision"),
        F.when(F.col("observations") > 0, F.coalesce("b.accepted", F.lit(0)) / F.col("observations")).otherwise(0.0).alias("coverage"), "observations",
    )


def prequential_gates(observations: DataFrame, target: float = 0.92, least: int = 20, gates: tuple[float, ...] = GATES) -> DataFrame:
    """period, gate: for each period the smallest gate that months before it support, else 1.

    Months are summed per gate first; the windows then run over months only.
    """
    at = observations.withColumn("period", period_of(F.col("date")))
    each = at.select("period", "correct", "confidence", F.explode(F.array(*[F.lit(g) for g in gates])).alias("gate")).groupBy("period", "gate").agg(
        F.sum((F.col("confidence") >= F.col("gate")).cast("long")).alias("_n"), F.sum(((F.col("confidence") >= F.col("gate")) & F.col("correct")).cast("long")).alias("_right")
    )
    before = Window.partitionBy("gate").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    known = each.select("period", "gate", F.sum("_n").over(before).alias("_n"), F.sum("_right").over(before).alias("_right"))
    ok = F.when((F.col("_n") >= least) & (F.col("_right") / F.col("_n") >= target), F.col("gate"))
    return known.groupBy("period").agg(F.coalesce(F.min(ok), F.lit(1.0)).alias("gate"))


def training_rows(history: DataFrame, semantic: DataFrame, financial: DataFrame, before_period: str) -> DataFrame:
    """History rows with the reason each is rejected for, in this order, or null: the cutoff, not one financial side, an
    unknown counterpart, no text. Adds direction, counterpart and semantic_key.
    """
    from tallyforge.functions.text import normalized

    money = financial.select(F.col("reduced_code").alias("_f")).distinct()
    rows = history
    for side in ("debit", "credit"):
        rows = rows.join(money.withColumnRenamed("_f", f"_{side}"), F.col(f"{side}_account") == F.col(f"_{side}"), "left").withColumn(f"_{side}", F.col(f"_{side}").isNotNull())
    counterpart = F.when(F.col("_debit"), F.col("credit_account")).otherwise(F.col("debit_account"))
    rows = rows.withColumn("direction", F.when(F.col("_debit"), "inflow").otherwise("outflow")).withColumn("counterpart", counterpart)
    rows = rows.join(semantic.select(F.col("reduced_code").alias("counterpart"), "semantic_key"), "counterpart", "left")
    reason = (
        F.when(period_of(F.col("date")) >= before_period, "on_or_after_cutoff")
        .when(F.col("_debit") == F.col("_credit"), "not_single_financial_side")
        .when(F.col("semantic_key").isNull(), "counterpart_not_in_chart")
        .when(normalized(F.col("complement")) == "", "missing_text")
    )
    return rows.withColumn("reject", reason).drop("_debit", "_credit")


def training_audit(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reject", F.lit("eligible_rows")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def temporal_split(rows: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Training rows before the last month, test rows in it, and that month."""
    last = rows.agg(F.max(period_of(F.col("date")))).first()[0]
    return rows.where(period_of(F.col("date")) < last), rows.where(period_of(F.col("date")) == last), last


def leave_one_out(rows: DataFrame, client: str) -> tuple[DataFrame, DataFrame]:
    """Other clients' rows before the client's last month, and the client's rows."""
    own = rows.where(F.col("client_id") == client)
    last = own.agg(F.max(period_of(F.col("date")))).first()[0]
    return rows.where((F.col("client_id") != client) & (period_of(F.col("date")) < last)), own


def checked_cutoff(trained_before: str, period: str) -> None:
    """A model may only be used for periods it was trained before."""
    import re

    if not re.fullmatch(r"\d{4}-\d{2}", trained_before) or trained_before > period:
        raise ValueError(f"unsafe model cutoff {trained_before!r} for {period!r}")


def memory_choice(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (ord, features, features_text) answered from what was seen with one label only: with the amount first, then without."""
    from tallyforge.operators.accounts import exact_memory

    a = exact_memory(rows, "features", "label").select("features", F.col("label").alias("_a"))
    b = exact_memory(rows, "features_text", "label").select(F.col("features").alias("features_text"), F.col("label").alias("_b"))
    out = probes.join(a, "features", "left").join(b, "features_text", "left")
    return out.select("ord", F.coalesce("_a", "_b").alias("label")).where("label is not null")


def arbitrated(choices: DataFrame, local_threshold: float, global_threshold: float) -> DataFrame:
    """Of local (counterpart, probability) and global ones: local above its threshold, global above its, local, global."""
    def made(side: str, confidence: str) -> Column:
        return F.struct(F.col(side)["counterpart"].alias("counterpart"), F.col(side)["probability"].alias("probability"), F.lit(side).alias("source"), F.lit(confidence).alias("confidence"))

    local, far = F.col("local"), F.col("global")
    pick = (
        F.when(local["probability"] >= local_threshold, made("local", "Alta"))
        .when(far["probability"] >= global_threshold, made("global", "Alta"))
        .when(local["counterpart"].isNotNull(), made("local", "Baixa"))
        .when(far["counterpart"].isNotNull(), made("global", "Baixa"))
    )
    return choices.withColumn("choice", pick)


def dataset_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a digest of the sorted rows, taken over per-row digests so that no text is gathered."""
    line = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    # sums of digest words do not depend on the order and combine map-side; equal rows count as often as they occur
    words = [F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select("n", F.sha2(F.concat_ws(":", "n", *[F.coalesce(f"w{i}", F.lit(0)).cast("string") for i in range(8)]), 256).alias("digest"))
