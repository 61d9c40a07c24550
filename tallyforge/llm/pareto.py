"""Pareto frontier layers by efficient non-dominated sort.

Distinct vectors of costs (smaller is better) are layered within a scope (one part type, or all). A vector's layer is one more than the longest
chain of vectors that dominate one another down to it; layers beyond ``LAYERS`` are 0.

* ``fronts`` is the sort itself: vectors in lexicographic order, so that only earlier ones can dominate, each put into the first front that has no
  dominator of it. Fronts are nested: who has no dominator in the last front has one in none beyond, so most vectors meet the last front alone.
* Pruning: a scope's vectors are dealt into parts of about ``BLOCK``, each is sorted, and who is beyond the last layer in a part is so in the whole
  scope and goes. Survivors are dealt and sorted again while that thins them out.
* A scope that still has several parts is cut into blocks in lexicographic order. Layers found so far are lower bounds; pairs of blocks, of which one's best
  corner may dominate the other's worst, raise the later block's bounds, and blocks sort themselves again, until nothing changes. A task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_map, dropped, split_join, table, written

#: Layers that are told apart, and vectors of a part.
LAYERS, BLOCK = 12, 65_536
#: Vectors that are compared with the fronts at once.
CHUNK = 256
#: Survivors are dealt again while less than this share of them stays.
WORTH = 0.8


class _Front:
    """The vectors of a front, columns without the first: order has seen to that."""

    def __init__(self, width: int):
        self.size, self.rows = 0, np.empty((64, width), np.int64)

    def add(self, more: np.ndarray) -> None:
        while self.size + len(more) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.size : self.size + len(more)] = more
        self.size += len(more)

    def dominates(self, vectors: np.ndarray) -> np.ndarray:
        """Which of the vectors (later in the order) have a dominator here."""
        own = self.rows[: self.size]
        out = np.zeros(len(vectors), bool)
        for a in range(0, self.size, 4096):
            if out.all():
                break
            part, open_ = own[a : a + 4096], np.flatnonzero(~out)
            below = np.ones((len(open_), len(part)), bool)
            for j in range(own.shape[1]):
                below &= part[:, j][None, :] <= vectors[open_, j][:, None]
            out[open_] = below.any(1)
        return out


def fronts(vectors: np.ndarray, bound: np.ndarray, layers: int = LAYERS) -> np.ndarray:
    """The layers of distinct vectors in lexicographic order, each at least its bound; layers + 1 stands for all beyond."""
    n, out = len(vectors), np.empty(len(vectors), np.int64)
    rest = vectors[:, 1:]
    held = [_Front(rest.shape[1]) for _ in range(layers)]
    for start in range(0, n, CHUNK):
        stop = min(n, start + CHUNK)
        layer = bound[start:stop].copy()
        layer[layer <= layers] = np.where(held[-1].dominates(rest[start:stop][layer <= layers]), layers + 1, layer[layer <= layers])
        live = np.flatnonzero(layer <= layers)
        for k in range(layers - 1, 0, -1):
            # who has a dominator in front k is beyond it; from the last front down, as fronts are nested
            ask = live[layer[live] <= k]
            layer[ask[held[k - 1].dominates(rest[start:stop][ask])]] = k + 1
        own = rest[start:stop][live]
        below = np.ones((len(live), len(live)), bool)
        for j in range(own.shape[1]):
            below &= own[:, j][None, :] <= own[:, j][:, None]
        mine = layer[live]
        for i in range(1, len(live)):
            before = mine[:i][below[i, :i]]
            if len(before):
                mine[i] = max(mine[i], before.max() + 1)
        layer[live] = np.minimum(mine, layers + 1)
        for k in range(layers):
            held[k].add(rest[start:stop][layer == k + 1])
        out[start:stop] = layer
    return out


def raised(vectors: np.ndarray, bound: np.ndarray, other: np.ndarray, layer: np.ndarray, layers: int = LAYERS) -> np.ndarray:
    """The bounds of vectors, raised by the layers of others that come before them in the order."""
    out = bound.copy()
    for k in range(layers, 0, -1):
        ask = np.flatnonzero(out <= k)
        front = _Front(other.shape[1] - 1)
        front.add(other[layer == k][:, 1:])
        if len(ask) and front.size:
            out[ask[front.dominates(vectors[ask][:, 1:])]] = k + 1
    return out


def _runs(batches: Iterable[pa.RecordBatch], key: Sequence[str]) -> Iterator[pa.Table]:
    """Of batches sorted by a key, the rows of each key, over the ends of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        edge = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            now = tuple(k[a] for k in keys)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _numbers(t: pa.Table, columns: Sequence[str]) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in columns], 1)


def _sorted_fronts(vectors: DataFrame, group: Sequence[str], costs: Sequence[str], layers: int) -> DataFrame:
    """Each group's vectors (scope, group, costs, layer as a bound) with their layers in the group; those beyond the last go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches, group):
            layer = fronts(_numbers(own, costs), own.column("layer").to_numpy().astype(np.int64), layers)
            keep = pa.array(layer <= layers)
            out = own.set_column(own.schema.get_field_index("layer"), "layer", pa.array(layer, pa.int32())).filter(keep)
            yield from out.to_batches()

    return arrow_map(vectors.sortWithinPartitions(*group, *costs), run, vectors.schema)


def _dealt(vectors: DataFrame, costs: Sequence[str], block: int) -> tuple[DataFrame, int, int]:
    """The vectors with their scope's number of parts; the vectors and the largest number of parts."""
    sizes = vectors.groupBy("scope").count().withColumn("parts", F.ceil(F.col("count") / block).cast("int"))
    sizes = written(sizes, "pareto-scopes")
    total, parts = sizes.agg(F.sum("count"), F.max("parts")).first()
    if not total:
        return vectors.withColumn("parts", F.lit(1)), 0, 1
    return split_join(vectors, sizes, "scope", "count", total).drop("count"), total, parts


def layered(vectors: DataFrame, costs: Sequence[str], layers: int = LAYERS, block: int = BLOCK) -> DataFrame:
    """Distinct vectors (scope long, costs long) -> those within the first layers, with their layer.

    Vectors of a scope must be distinct and without nulls. An empty table gives no rows.
    """
    state = vectors.select("scope", *costs, F.lit(1).alias("layer"))
    columns = state.columns
    before = None
    while True:
        dealt, total, parts = _dealt(state, costs, block)
        if before is not None and (parts == 1 or total > WORTH * before):
            break
        # a part is a group of the scope's vectors by hash; parts of one scope are sorted in several tasks
        part = F.pmod(F.xxhash64(*costs), F.col("parts")).cast("int").alias("part")
        grouped = dealt.select("scope", part, *costs, "layer").repartition("scope", "part")
        state = written(_sorted_fronts(grouped, ["scope", "part"], costs, layers).select(*columns), "pareto-survivors")
        if parts == 1:
            return state
        before = total
    if parts == 1:
        # every scope is in one part now, but not every bound is a layer yet
        grouped = dealt.select("scope", F.lit(0).alias("part"), *costs, "layer").repartition("scope", "part")
        return written(_sorted_fronts(grouped, ["scope", "part"], costs, layers).select(*columns), "pareto-layers")
    return _over_blocks(state, total, costs, layers, block)


def _over_blocks(state: DataFrame, total: int, costs: Sequence[str], layers: int, block: int) -> DataFrame:
    """Layers of scopes that one task can't hold, from lower bounds, by rounds over pairs of blocks."""
    columns = state.columns
    ranged = state.repartitionByRange(max(1, -(-2 * total // block)), "scope", *costs).select(*columns, F.spark_partition_id().alias("block"))
    state = written(ranged, "pareto-blocks")
    own = ["scope", "block"]
    state = written(_sorted_fronts(state.repartition(*own), own, costs, layers), "pareto-blocks")
    while True:
        corners = state.groupBy(*own).agg(*(F.min(c).alias(f"least_{c}") for c in costs), *(F.max(c).alias(f"most_{c}") for c in costs))
        a = corners.select("scope", F.col("block").alias("a"), *(f"least_{c}" for c in costs))
        b = corners.select("scope", F.col("block").alias("b"), *(f"most_{c}" for c in costs))
        may = F.col("a") < F.col("b")
        for c in costs:
            may &= F.col(f"least_{c}") <= F.col(f"most_{c}")
        pairs = a.join(b, "scope").where(may).select("scope", "a", "b")
        first = state.withColumnRenamed("block", "a").join(pairs, ["scope", "a"]).withColumn("side", F.lit(0))
        second = state.withColumnRenamed("block", "b").join(pairs, ["scope", "b"]).withColumn("side", F.lit(1))
        both = first.unionByName(second).repartition("scope", "b", "a").sortWithinPartitions("scope", "b", "a", "side", *costs)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pair in _runs(batches, ["scope", "b", "a"]):
                later = pair.column("side").to_numpy() == 1
                x, layer = _numbers(pair, costs), pair.column("layer").to_numpy().astype(np.int64)
                up = raised(x[later], layer[later], x[~later], layer[~later], layers)
                moved = np.flatnonzero(up > layer[later])
                rows = pair.filter(pa.array(later)).take(pa.array(moved)).select(["scope", "b", *costs])
                yield from rows.append_column("up", pa.array(up[moved], pa.int32())).to_batches()

        ups = arrow_map(both, run, f"scope long, b int, {', '.join(f'{c} long' for c in costs)}, up int").withColumnRenamed("b", "block")
        ups = written(ups.groupBy(*own, *costs).agg(F.max("up").alias("up")), "pareto-raised")
        if ups.isEmpty():
            return state.select(*columns)
        bounds = state.join(ups, [*own, *costs], "left").withColumn("layer", F.greatest("layer", F.coalesce("up", "layer"))).select(*columns, "block")
        last, state = state, written(_sorted_fronts(bounds.repartition(*own), own, costs, layers), "pareto-blocks")
        dropped(last)
        dropped(ups)


# ---- offers

_CENTS = 1e13  # beyond this, in either direction, a number of money or a rate counts as missing
NULL_COST = -(1 << 62)
MEASURES = ("price", "discount", "delay", "quantity")


def hundredths(x: Column) -> Column:
    """floor(100 * x + 0.5) of a double; null where x is null, not finite or too large."""
    return F.when(F.abs(x) < _CENTS, F.floor(100 * x + 0.5).cast("long"))


def floored(a: Column, b: Column) -> Column:
    """floor(a / b) of whole decimals, exactly; null where b is 0 or null."""
    a, b = F.when(b < 0, -a).otherwise(a), F.when(b != 0, F.abs(b))
    return ((a - F.pmod(a, b)) / b).cast("long")


def offers(lines: DataFrame, sales: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, vendor_id, part_type, price, discount, delay, quantity: a row for each pair of them in the lines.

    An item or sale there twice counts as its row with the smallest values.
    """
    whole = "decimal(20,0)"
    sold = sales.where("sale_id is not null").groupBy("sale_id").agg(F.min(F.to_date("sold_at")).alias("_sold"))
    item = items.where("item_id is not null").groupBy("item_id").agg(F.min(F.struct(F.col("brand").alias("b"), hundredths(F.col("price").cast("double")).alias("p"))).alias("_item"))
    line = lines.where("item_id is not null and vendor_id is not null").select(
        "item_id", "vendor_id", "sale_id", F.col("quantity").cast("long").alias("q"), hundredths(F.col("amount").cast("double")).alias("c"), hundredths(F.col("discount").cast("double")).alias("d"), F.to_date("shipped_at").alias("_shipped")
    )
    # written first, so that both sides of the joins are plain shuffles, of which Spark splits a hot sale's or item's part
    sold, item = written(sold, "pareto-sales"), written(item, "pareto-items")
    line = line.join(sold, "sale_id", "left").withColumn("_days", F.datediff("_shipped", "_sold"))
    priced = F.col("c").isNotNull() & F.col("d").isNotNull() & F.col("q").isNotNull()
    sums = line.groupBy("item_id", "vendor_id").agg(
        F.sum(F.when(priced, F.col("c").cast(whole) * (100 - F.col("d")).cast("decimal(17,0)"))).alias("_paid"), F.sum(F.when(priced, F.col("q")).cast(whole)).alias("_sold"),
        F.sum(F.col("d").cast(whole)).alias("_d"), F.count("d").alias("_nd"), F.sum("_days").alias("_days"), F.count("_days").alias("_ndays"), F.max("q").alias("quantity"),
    )
    joined = sums.join(item, "item_id", "left")
    p = F.col("_item.p")
    return joined.select(
        "item_id", "vendor_id", F.col("_item.b").alias("part_type"),
        F.when(p >= 1, floored(F.col("_paid").cast("decimal(38,0)"), (p.cast("decimal(16,0)") * F.col("_sold").cast("decimal(21,0)")).cast("decimal(38,0)"))).alias("price"),
        floored(F.col("_d").cast("decimal(38,0)"), F.col("_nd").cast("decimal(20,0)")).alias("discount"), floored(F.col("_days").cast("decimal(20,0)"), F.col("_ndays").cast("decimal(20,0)")).alias("delay"), "quantity",
    )


#: Costs: smaller is better, null is best.
COSTS = ("c0", "c1", "c2", "c3")


def _costs() -> list[Column]:
    of = lambda c, sign: F.coalesce(sign * F.col(c), F.lit(NULL_COST)).cast("long")
    return [of("price", 1).alias("c0"), of("discount", -1).alias("c1"), of("delay", 1).alias("c2"), of("quantity", -1).alias("c3")]


def offer_layers(lines: DataFrame, sales: DataFrame, items: DataFrame, layers: int = LAYERS, block: int = BLOCK) -> DataFrame:
    """Offers with type_layer (among the offers of their part type), global_layer and n_equal (offers of any type with these measures).

    Lines without an item or a vendor make no offer; null, not finite and huge numbers are missing inputs; repeated lines all count; offers of items without
    a brand (or without a row) are one type. Equal offers share a layer. Empty lines give no rows, other columns are not read.
    """
    made = written(offers(lines, sales, items).select("item_id", "vendor_id", "part_type", *MEASURES, *_costs()), "pareto-offers")
    # a type's number: its hash, another for none; 0 stands for all types
    scope = F.when(F.col("part_type").isNull(), F.lit(1)).otherwise(F.xxhash64("part_type"))
    typed = written(made.groupBy(scope.alias("scope"), *COSTS).agg(F.count(F.lit(1)).alias("n")), "pareto-typed")
    every = written(typed.groupBy(*COSTS).agg(F.sum("n").alias("n_equal")), "pareto-vectors")
    found = layered(typed.select("scope", *COSTS).unionByName(every.select(F.lit(0).cast("long").alias("scope"), *COSTS)), COSTS, layers, block)
    own = found.where("scope != 0").withColumnRenamed("layer", "type_layer").hint("merge")
    all_ = found.where("scope = 0").drop("scope").withColumnRenamed("layer", "global_layer").hint("merge")
    every = every.join(all_, [*COSTS], "left").hint("merge")
    numbers = typed.join(own, ["scope", *COSTS], "left").join(every, [*COSTS]).select("scope", *COSTS, "type_layer", "global_layer", "n_equal").hint("merge")
    layer = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return made.withColumn("scope", scope).join(numbers, ["scope", *COSTS]).select("item_id", "vendor_id", "part_type", *MEASURES, layer("type_layer"), layer("global_layer"), "n_equal")


def op11_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer_layers(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "sales"), table(spark, sf_dir, "items"))


def _sql() -> str:
    cents = lambda x: f"CAST(floor(100 * {x} + 0.5) AS HUGEINT)"
    floor_of = lambda a, b: f"CAST(({a} - ((({a}) % ({b}) + ({b})) % ({b}))) // ({b}) AS BIGINT)"
    steps = [
        f"""line AS (SELECT l.item_id, l.vendor_id, i.brand, {cents("i.price")} AS p, CAST(l.quantity AS HUGEINT) AS q, {cents("l.amount")} AS c, {cents("l.discount")} AS d,
  date_diff('day', CAST(s.sold_at AS DATE), CAST(l.shipped_at AS DATE)) AS days
FROM sale_lines l LEFT JOIN items i ON l.item_id = i.item_id LEFT JOIN sales s ON l.sale_id = s.sale_id WHERE l.item_id IS NOT NULL AND l.vendor_id IS NOT NULL)""",
        """sums AS (SELECT item_id, vendor_id, any_value(brand) AS part_type, any_value(p) AS p, sum(c * (100 - d)) FILTER (c IS NOT NULL AND d IS NOT NULL AND q IS NOT NULL) AS paid,
  nullif(any_value(p) * sum(q) FILTER (c IS NOT NULL AND d IS NOT NULL AND q IS NOT NULL), 0) AS list_price, CAST(sum(d) AS HUGEINT) AS sd, nullif(count(d), 0) AS nd, CAST(sum(days) AS HUGEINT) AS sdays, nullif(count(days), 0) AS ndays, max(q) AS q FROM line GROUP BY item_id, vendor_id)""",
        f"""offer AS MATERIALIZED (SELECT item_id, vendor_id, part_type, CASE WHEN p >= 1 THEN {floor_of("CAST(paid AS HUGEINT)", "CAST(list_price AS HUGEINT)")} END AS price, {floor_of("sd", "nd")} AS discount, {floor_of("sdays", "ndays")} AS delay, CAST(q AS BIGINT) AS quantity FROM sums)""",
        f"""vector AS MATERIALIZED (SELECT DISTINCT coalesce('type ' || part_type, 'none') AS scope, coalesce(price, {NULL_COST}) AS a, coalesce(-discount, {NULL_COST}) AS b, coalesce(delay, {NULL_COST}) AS c, coalesce(-quantity, {NULL_COST}) AS d FROM offer)""",
        "r1 AS MATERIALIZED (SELECT * FROM vector UNION SELECT 'all', a, b, c, d FROM vector)",
    ]
    for k in range(1, LAYERS + 1):
        steps.append(f"k{k} AS MATERIALIZED (SELECT * FROM r{k} v WHERE NOT EXISTS (SELECT 1 FROM r{k} w WHERE w.scope = v.scope AND w.a <= v.a AND w.b <= v.b AND w.c <= v.c AND w.d <= v.d AND (w.a < v.a OR w.b < v.b OR w.c < v.c OR w.d < v.d)))")
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} EXCEPT SELECT * FROM k{k})")
    steps.append("layer AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT *, {k} AS layer FROM k{k}" for k in range(1, LAYERS + 1)) + ")")
    key = lambda t: f"{t}.a = coalesce(o.price, {NULL_COST}) AND {t}.b = coalesce(-o.discount, {NULL_COST}) AND {t}.c = coalesce(o.delay, {NULL_COST}) AND {t}.d = coalesce(-o.quantity, {NULL_COST})"
    return f"""WITH {", ".join(steps)}
SELECT o.*, CAST(coalesce(t.layer, 0) AS BIGINT) AS type_layer, CAST(coalesce(g.layer, 0) AS BIGINT) AS global_layer, count(*) OVER (PARTITION BY o.price, o.discount, o.delay, o.quantity) AS n_equal
FROM offer o LEFT JOIN layer t ON t.scope = coalesce('type ' || o.part_type, 'none') AND {key("t")} LEFT JOIN layer g ON g.scope = 'all' AND {key("g")}"""


SQL = _sql()
