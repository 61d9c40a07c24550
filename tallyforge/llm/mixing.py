"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key per epoch, from its id and its text. Within a source the keys are
range-sorted, prefix sums of the sizes are computed over several levels (ranges of ranges, ranges, rows of one
range), and the source is cut at its exact budget; budgets beyond the source's size go on into the next epoch with
fresh keys.

No window sees a whole source: a source of n rows is split into ceil(n / ROWS_PER_RANGE) key ranges, so a
source that holds a third of all rows is only more ranges. Equal rows are one row with a number until the
end. The table of sources has its running sums by range partitions, so it may be long as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh, table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Expected rows of one key range, the largest group any window sorts.
ROWS_PER_RANGE = 2_000


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """Adds ``_rank`` (from 0) and, for each name, the sum of what stands before a row. No two rows may be equal in the order.

    Rows are range-partitioned and written, so that the partitions stay; a window runs in each, another over one row a partition.
    """
    placed = written(df.repartitionByRange(*order).withColumn("_at", F.spark_partition_id()), label)
    ahead = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    each = placed.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(n) for n, c in sums.items()))
    each = each.select("_at", *(F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_before{i}") for i, n in enumerate(["_n", *sums])))
    within = Window.partitionBy("_at").orderBy(*order)
    rows = placed.join(F.broadcast(each), "_at")  # one row a partition
    out = rows.withColumn("_rank", F.row_number().over(within) - 1 + F.col("_before0"))
    for i, (n, c) in enumerate(sums.items()):
        out = out.withColumn(n, F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(f"_before{i + 1}"))
    return out.drop("_at", *(f"_before{i}" for i in range(len(sums) + 1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_rows, source_size) -> the same with target.

    Sources by code point, null last, take the weights in turn. Each target stops at ``most`` times the
    source's size and the excess is shared again by weight: the level at which the capped and the open
    targets add up to ``share`` of all sizes is found from prefix sums in the order of cap per weight.
    An empty input, or sources without words, give targets of 0.
    """
    ranked = running(sizes, [F.col("source").isNull(), F.col("source")], {}, "mix-sources").withColumnRenamed("_rank", "_source_rank")
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_source_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(most))
    ratio = F.col("_cap") / F.col("_weight")
    ranked = running(ranked, [ratio, F.col("_source_rank")], {"_caps": F.col("_cap"), "_weights": F.col("_weight")}, "mix-caps")
    whole = ranked.agg(F.sum("source_size"), F.sum("_weight")).first()
    level = (F.lit(float(whole[0] or 0) * float(share)) - F.col("_caps")) / (F.lit(float(whole[1] or 0)) - F.col("_weights"))
    ranked = ranked.withColumn("_level", level)
    # the sources before the first whose cap is not below the level are capped; that level holds for the rest
    found = ranked.agg(F.min(F.when(ratio >= F.col("_level"), F.struct("_rank", "_level")))).first()[0]
    target = F.col("_cap") if found is None else F.when(F.col("_rank") < found["_rank"], F.col("_cap")).otherwise(F.least(F.col("_cap"), F.lit(found["_level"]) * F.col("_weight")))
    return ranked.select("source", "source_rows", "source_size", target.cast("double").alias("target"))


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _key(doc_id: Column, digest: Column, epoch: int, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), digest, F.lit(str(epoch)), F.lit(str(seed))))


#: Ranges that a window over ranges sees at a time.
FAN = 1_000


def _ahead(sums: DataFrame, epoch: str | None = None) -> DataFrame:
    """(source, _part, _sum) -> with the sum over the source's parts before: over parts of one stretch, and over stretches. With the name of an epoch's column, of each epoch."""
    stretch = F.floor(F.col("_part") / FAN)
    rows = sums.withColumn("_stretch", stretch)
    own = ["source", *([epoch] if epoch else [])]
    of = lambda *keys: Window.partitionBy(*own, *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    high = rows.groupBy(*own, "_stretch").agg(F.sum("_sum").alias("_high")).withColumn("_high", F.coalesce(F.sum("_high").over(of("_stretch")), F.lit(0)))
    high = high.select(F.col("source").alias("_source"), F.col("_stretch").alias("_of"), "_high", *([F.col(epoch).alias("_of_epoch")] if epoch else []))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_stretch") == F.col("_of"))
    same = same & (F.col(epoch) == F.col("_of_epoch")) if epoch else same
    both = rows.withColumn("_low", F.coalesce(F.sum("_sum").over(of("_stretch", "_part")), F.lit(0))).join(high, same)
    return both.select(*own, "_part", (F.col("_low") + F.col("_high")).alias("_ahead"))


def planned(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int, rows_per_range: int) -> DataFrame:
    """A row for each distinct (doc_id, source, size, digest of the text): _copies, source_size, target and, for each epoch, _key{e} and the words taken of all copies, _taken{e}."""
    # the text is read once: everything after this works on ids, sources, sizes and digests
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _digest(F.col("text")).alias("_digest"))
    # copies are counted with map-side combining: a row that is there a million times is one row
    sized = written(sized.groupBy("doc_id", "source", "size", "_digest").agg(F.count(F.lit(1)).alias("_copies")), "mix-sizes")
    words = F.col("size") * F.col("_copies")
    per_source = sized.groupBy("source").agg(F.sum("_copies").alias("source_rows"), F.sum(words).alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    of = written(targets(per_source.drop("_rows"), weights, share, most), "mix-targets")
    known = sized.join(of, sized["source"].eqNullSafe(of["source"])).drop(of["source"])
    ranges = F.ceil(F.col("source_rows") / F.lit(rows_per_range))
    for epoch in range(most):
        known = known.withColumn(f"_key{epoch}", _key(F.col("doc_id"), F.col("_digest"), epoch, seed))
        known = known.withColumn(f"_part{epoch}", F.floor(F.conv(F.substring(f"_key{epoch}", 1, 8), 16, 10).cast("double") / 2**32 * ranges).cast("long"))
    # the ranges of all epochs in one pass, a row each. They are written, as sums from the rows within a plan of the rows would triple that plan with each epoch
    parts = F.inline(F.array(*[F.struct(F.lit(e).alias("_epoch"), F.col(f"_part{e}").alias("_part")) for e in range(most)]))
    sums = known.select("source", words.alias("_words"), parts).groupBy("source", "_epoch", "_part").agg(F.sum("_words").alias("_sum"))
    ahead = written(_ahead(written(sums, "mix-ranges"), "_epoch"), "mix-ahead")
    for epoch in range(most):
        before = ahead.where(F.col("_epoch") == epoch).select(F.col("source").alias("_source"), F.col("_part").alias("_at"), "_ahead")
        known = known.join(before, known["source"].eqNullSafe(before["_source"]) & (known[f"_part{epoch}"] == before["_at"]))
        within = Window.partitionBy("source", f"_part{epoch}").orderBy(f"_key{epoch}", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        # budgets are whole words: what the target leaves for this epoch, at most the source's size
        budget = F.least(F.greatest(F.floor("target") - F.col("source_size") * epoch, F.lit(0)), F.col("source_size"))
        start = F.col("_ahead") + F.coalesce(F.sum(words).over(within), F.lit(0))
        known = known.withColumn(f"_taken{epoch}", F.least(F.greatest(budget - start, F.lit(0)), words).cast("long")).drop(f"_part{epoch}", "_source", "_at", "_ahead")
    return known


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = 42, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Documents (doc_id, source, text) -> (doc_id, source, size, source_size, target, taken_epochs, taken), a row per input row.

    ``taken_epochs`` holds the words taken in each epoch; they are ``size`` except for the one document a
    budget ends in, and 0 after it. Nulls: a null text has size 0, null sources form one source (the last),
    null doc_ids are keyed like the text "null" with the text's digest. Repeated rows are separate rows; equal rows are
    interchangeable, so reruns return the same multiset. An empty table gives an empty result.
    """
    plan = planned(docs, weights, share, most, seed, rows_per_range)
    # copies are spread again in runs, and only the runs are dealt out, so no task makes all copies of one row
    runs = plan.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / rows_per_range))))
    runs = runs.repartition("doc_id", "_digest", "_run")
    copies = runs.withColumn("_copy", F.explode(F.sequence(F.col("_run") * rows_per_range, F.least(F.col("_copies"), (F.col("_run") + 1) * rows_per_range) - 1)))
    # the first copies get what is taken of all
    taken = [F.least(F.greatest(F.col(f"_taken{e}") - F.col("_copy") * F.col("size"), F.lit(0)), F.col("size")).cast("long") for e in range(most)]
    total = sum(taken[1:], taken[0])
    return copies.select("doc_id", "source", "size", "source_size", "target", F.array(*taken).alias("taken_epochs"), total.alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = 42, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The mix as documents: a row for each epoch a document is taken in, all columns as they are.

    The document a budget ends in keeps as many of its first words as the budget has left. Texts are not
    shuffled: each source's cut is the largest key taken, and a document compares its own key with it. Documents
    without words are taken where the whole epoch is, or their key is below the cut. A null text counts as an empty one and stays
    null; null doc_ids and sources are values. Of equal rows (id, source and text) at a cut as many are taken as the budget has room
    for, the last in part. An empty table gives no rows; columns may have any names.
    """
    plan = planned(docs, weights, share, most, seed, rows_per_range)
    each = F.array(*[F.struct(F.lit(e).alias("_epoch"), F.col(f"_key{e}").alias("key"), F.col(f"_taken{e}").alias("_words")) for e in range(most)])
    cuts = plan.select("source", "size", "_copies", "source_size", "target", F.inline(each))
    last = F.max(F.when(F.col("_words") > 0, F.struct("key", F.col("_words").alias("words"), F.col("size").alias("size"), F.col("_copies").alias("copies"))))
    whole = F.max(F.col("target")) >= F.max(F.col("source_size")) * (F.col("_epoch") + 1)
    cuts = cuts.groupBy("source", "_epoch").agg(last.alias("_last"), whole.alias("_whole"))
    own, at, of = (fresh(docs.columns, n) for n in ("_mix_source", "_mix_cuts", "_mix_words"))
    cuts = written(cuts.groupBy(F.col("source").alias(own)).agg(F.map_from_entries(F.collect_list(F.struct("_epoch", F.struct("_last", "_whole")))).alias(at)), "mix-cuts")
    held = docs.join(cuts, F.col("source").eqNullSafe(F.col(own)))
    # -1: the whole text; -2: one of several equal rows at the cut, decided by its number; else so many words
    rows = []
    for epoch in range(most):
        cut, key = F.col(at)[epoch], _key(F.col("doc_id"), _digest(F.col("text")), epoch, seed)
        end = cut["_last"]
        of_cut = F.when(end["words"] == end["size"] * end["copies"], F.lit(-1)).when(end["copies"] > 1, F.lit(-2)).otherwise(end["words"])
        rows.append(F.struct(F.lit(epoch).alias("epoch"), F.when(cut["_whole"] | (key < end["key"]), F.lit(-1)).when(key == end["key"], of_cut).cast("long").alias("words")))
    held = held.withColumn(of, F.explode(F.filter(F.array(*rows), lambda x: x["words"].isNotNull())))
    several = F.exists(F.map_values(at), lambda c: (c["_last"]["copies"] > 1) & (c["_last"]["words"] < c["_last"]["size"] * c["_last"]["copies"]))
    if cuts.where(several).isEmpty():
        held = held.withColumn(of, F.col(f"{of}.words"))
    else:
        held = held.where(F.col(f"{of}.words") != -2).withColumn(of, F.col(f"{of}.words")).unionByName(_at_cuts(held.where(F.col(f"{of}.words") == -2), own, at, of))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col(of) < 0, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col(of).cast("int")), " "))
    held = held.withColumn("text", text)
    if "n_chars" in docs.columns:
        held = held.withColumn("n_chars", F.when(F.col(of) < 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return held.select(*docs.columns)


def _at_cuts(rows: DataFrame, own: str, at: str, of: str, salts: int = 64) -> DataFrame:
    """Equal rows at a cut with the words each keeps: numbered within salts, and the salts' counts added up before."""
    salt, number = fresh(rows.columns, "_mix_salt"), fresh(rows.columns, "_mix_number")
    rows = written(rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts))), "mix-at-cuts")
    keys = [F.col(own), F.col(f"{of}.epoch")]
    each = rows.groupBy(*(k.alias(f"_g{i}") for i, k in enumerate(keys)), F.col(salt).alias("_g2")).agg(F.count(F.lit(1)).alias("_g3"))
    each = each.withColumn("_g3", F.coalesce(F.sum("_g3").over(Window.partitionBy("_g0", "_g1").orderBy("_g2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = rows.withColumn(number, F.row_number().over(Window.partitionBy(*keys, salt).orderBy(salt)) - 1)
    both = numbered.join(each, keys[0].eqNullSafe(F.col("_g0")) & (keys[1] == F.col("_g1")) & (F.col(salt) == F.col("_g2")))
    last = F.col(at)[F.col(f"{of}.epoch")]["_last"]
    left = last["words"] - (F.col(number) + F.col("_g3")) * last["size"]
    kept = F.when(left >= last["size"], F.lit(-1)).when(left > 0, left).cast("long")
    return both.withColumn(of, kept).where(F.col(of).isNotNull()).drop("_g0", "_g1", "_g2", "_g3", salt, number)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
         ([5.0, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM sized GROUP BY source
), level(step, value) AS (
  SELECT 0, (SELECT 1.5 * sum(source_size) / sum(weight) FROM sources)
  UNION ALL
  SELECT step + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (2 * source_size < value * weight), 0)) / nullif(sum(weight) FILTER (2 * source_size >= value * weight), 0) FROM sources)
  FROM level WHERE step < 100 AND value IS NOT NULL
), targets AS (
  SELECT source, source_size, least(2 * source_size, weight * coalesce((SELECT value FROM level WHERE step = 100), 1e300)) AS target FROM sources
), placed AS (
  SELECT doc_id, d.source, size, CAST(source_size AS BIGINT) AS source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest || ':0:42'), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_at,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest || ':1:42'), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS second_at
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(greatest(least(greatest(floor(target), 0), source_size) - first_at, 0), size)
            + least(greatest(least(greatest(floor(target) - source_size, 0), source_size) - second_at, 0), size) AS BIGINT) AS taken
FROM placed
"""
