"""One running number over all rows, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.lineage import cut

#: A partition's number stands above the row's place in it: what monotonically_increasing_id() gives (a fixed value).
_PLACES = 33


def numbered(rows: DataFrame, order: Sequence[str], name: str = "ord", partitions: int | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the given order, then by all other columns that can be ordered, so equal keys are spread as well.

    Rows are dealt to ranges of the order and sorted there; a row's number is its place plus the rows of the ranges before, of which there is
    one sum a partition. The ranges are cut from their lineage once, as another sample would deal rows anew. Nulls come first; an empty table stays empty.
    """
    spark = rows.sparkSession
    sortable = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant") and f.name not in order]
    # a hash before the other columns spreads rows whose keys are equal
    keys = [*(F.col(c) for c in order), *([F.xxhash64(*sortable)] if sortable else []), *(F.col(c) for c in sortable)]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = cut(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACES)
    # a row for each partition: their number is bounded by the session's setting
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    out = at.withColumn("_part", part).join(F.broadcast(before), "_part")
    place = F.col("_at") - F.shiftleft(F.col("_part"), _PLACES)
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + place + 1).drop("_at", "_part", "_before")
