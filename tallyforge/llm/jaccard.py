"""N-gram Jaccard join with a count-vector R-tree.

A text is the set of its distinct word shingles. Two sets link when 100 * |A and B| >= percent * |A or B|,
which is the same as |A and B| >= a, a = ceil(percent * (|A| + |B|) / (100 + percent)).

1. Shingles are hashed into ``BUCKETS`` groups and counted over all texts. The counts, one fixed array,
   order shingles from rare to common.
2. Each distinct set (equal sets collapse to the smallest id first) keeps its first n - ceil(t * n) + 1
   shingles in that order. Two linked sets share one of them, so documents meet in the cells of these
   shingles. Common passages come last in the order and open no cells unless a text has little else.
3. Each set is a point: its shingles hashed into groups and counted (see groups_for()). The summed minima of
   two points' coordinates bound their overlap from above. An R-tree over points, packed in the order of
   size, prunes nodes by the same bound with their upper corners.
4. Contraction: every set goes to one home, the most shared of its cells, in blocks of ``BLOCK``. The tree's
   pairs in a block are verified on the exact sets; of what they join one set a block goes on to the next
   round. So a large group of near copies becomes one class with each set read about once.
5. Completion: a cell whose members are of one class, or of one block, is done. In the others the tree finds the
   pairs of different classes that the bound can't tell from links; the classes these join are clusters, and in each
   the pairs of different classes are verified on the exact sets. With 4 that finds every link between classes, and
   the components of all verified links are the result.

In 5 the members of the most frequent class of a cell or cluster meet only the others, and both are dealt into blocks
whose pairs are tasks of their own: no group is collected into one task, none is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_map, shingle_sets, slices, split_join, table, texts_of, written
from tallyforge.llm.components import components

WIDTH, PERCENT = 4, 85
#: Groups of the order of shingles (one array of this length).
BUCKETS = 1 << 18
#: Groups of the count vectors: as many as keep this many shingles in one, and no fewer than that.
PER_GROUP, LEAST_GROUPS = 8, 64
#: Members of a block, and shingles a block of sets may hold on average.
BLOCK, BLOCK_SHINGLES = 500, 500_000
LEAF = 16
#: Rows a task holds before it passes them on; one pair of blocks may go beyond.
MOST_ROWS = 100_000
#: Rows up to which a set of ids is broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def overlap_needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bucket_counts(docs: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How often shingles of each group occur, over all texts; a task sends each group at most once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 2048):
                every = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(texts_of(part), width)])
                count += np.bincount((every & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["bucket", "n"])

    rows = arrow_map(docs.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    found = rows.toArrow()  # at most ``buckets`` rows
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def groups_for(n: int) -> int:
    """Groups of a set's count vector: a power of two with at most PER_GROUP shingles a group on average.

    The bound tells unrelated sets apart as long as counts stay small: two sets of n shingles in g groups differ
    by about 1.1 * sqrt(n * g) summed over the groups, and linked ones by at most 0.16 * n (at 85 per cent).
    """
    return 1 << max(LEAST_GROUPS.bit_length() - 1, int(-(-n // PER_GROUP) - 1).bit_length())


def _vector(s: np.ndarray) -> np.ndarray:
    # the upper bits, so that the groups are independent of the buckets
    groups = groups_for(len(s))
    return np.bincount((s >> np.uint64(32)).astype(np.int64) & (groups - 1), minlength=groups)


def _packed(vector: np.ndarray) -> bytes:
    """A byte a group, or four where a group has more than 255."""
    return vector.astype("u1" if vector.max() < 256 else "<u4").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "u1" if len(data) == groups_for(n) else "<u4").astype(np.int32)


def _folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The count vector over fewer groups: those equal in their lower bits are added up."""
    return vector.reshape(-1, groups).sum(0)


SKETCH = "doc_id long, n_shingles long, set_hash string, prefix array<long>, vector binary"


def sketches(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    buckets = len(counts)
    # ranks fit 4 bytes however large the counts are
    rank = np.unique(counts, return_inverse=True)[1].astype(np.int32)
    held = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        for batch in (part for whole in batches for part in slices(whole, 1024)):
            n, keys, prefixes, vectors = [], [], [], []
            for s in shingle_sets(texts_of(batch), width):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                k = prefix_length(len(s), percent) if len(s) else 0
                first = s[np.lexsort((s, order[(s & np.uint64(buckets - 1)).astype(np.int64)]))[:k]]
                prefixes.append(first.view(np.int64))
                vectors.append(_packed(_vector(s)) if len(s) else b"")
            offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(vectors, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "prefix", "vector"],
            )

    return arrow_map(docs.select("doc_id", "text"), run, SKETCH)


class Tree:
    """An R-tree over count vectors, packed in the order of size; a node's corners are the minima and maxima below it."""

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        # sizes first; among close sizes the largest coordinates, so that like points share leaves
        self.order = np.lexsort((*vectors.T[:3], sizes))
        self.sizes, self.vectors, self.leaf = sizes[self.order], vectors[self.order], leaf
        self.levels = []
        top, low, high = self.vectors, self.sizes, self.sizes
        while True:
            starts = np.arange(0, len(top), leaf)
            top, low, high = np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((top, low, high))
            if len(top) <= 1:
                break

    def near(self, vector: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Places of the points whose overlap with this one may reach what linking needs."""
        least, most = -(-percent * size // 100), 100 * size // percent
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            nodes = nodes[(high[nodes] >= least) & (low[nodes] <= most)]
            bound = np.minimum(top[nodes], vector).sum(1)
            nodes = nodes[bound >= overlap_needed(np.maximum(low[nodes], least), size, percent)]
            if not len(nodes):
                return nodes
            below = len(self.levels[depth - 1][0]) if depth else len(self.sizes)
            nodes = (nodes[:, None] * self.leaf + np.arange(self.leaf)).ravel()
            nodes = nodes[nodes < below]
        nodes = nodes[(self.sizes[nodes] >= least) & (self.sizes[nodes] <= most)]
        bound = np.minimum(self.vectors[nodes], vector).sum(1)
        return self.order[nodes[bound >= overlap_needed(self.sizes[nodes], size, percent)]]


class Forest:
    """Union-find over places; keeps the links that joined two trees. Places of one class, where classes are given, are joined at first."""

    def __init__(self, n: int, classes: np.ndarray | None = None):
        self.parent = np.arange(n)
        if classes is not None:
            _, first, of = np.unique(classes, return_index=True, return_inverse=True)
            self.parent = first[of].astype(np.int64)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = int(p[i])
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def stars(self) -> list[tuple[int, int]]:
        """The ends of the links, each with its root: the same trees, and no deeper than one step."""
        return [(r, i) for i in sorted({i for link in self.links for i in link}) if (r := self.root(i)) != i]

    def roots(self, some: np.ndarray) -> np.ndarray:
        """Of several places at once."""
        r = self.parent[some]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        return r


Apart = Callable[[int, np.ndarray], np.ndarray]


def _near_pairs(sizes: np.ndarray, vectors: list[np.ndarray], percent: int, apart: Apart | None = None, ask: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Each point with the earlier ones that the bound can't tell from a link; ``apart`` takes from these what is not wanted.

    Where ``ask`` marks points, only these search, and what they meet are the earlier ones of them and all others.

    Points are indexed by the number of groups of their vectors. Sizes that can link differ by less than a factor of
    two, so a tree over g groups takes those of g and, folded, those of 2g.
    """
    own = np.array([len(v) for v in vectors])
    for groups in np.unique(own).tolist():
        some = np.flatnonzero((own == groups) | (own == 2 * groups))
        low = own[some] == groups
        if len(some) < 2:
            continue
        folded = np.stack([_folded(vectors[i], groups) for i in some])
        tree = Tree(sizes[some], folded)
        for at, i in enumerate(some.tolist()):
            if ask is not None and not ask[i]:
                continue
            near = tree.near(folded[at], int(sizes[i]), percent)
            if not low[at]:
                near = near[low[near]]  # two of 2g groups meet in their own tree
            near = some[near]
            # among points of different groups either may come first, and the pair is met from both
            near = near[near < i] if ask is None else near[(near < i) | ~ask[near]]
            if apart is not None:
                near = apart(i, near)
            if len(near):
                yield i, near


def verified_forest(sets: list[np.ndarray], percent: int, classes: np.ndarray | None = None, every: bool = False, apart: Apart | None = None, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """What true links join, each with the first of its tree (places of one class, where given, are joined at first); or every link.

    For a forest, pairs within a tree need no check.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    forest = Forest(len(sets), classes)
    out: list[tuple[int, int]] = []
    vocabulary, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(vocabulary), bool)
    for i, near in _near_pairs(sizes, [_vector(s) for s in sets], percent, apart, ask):
        if not every:
            near = near[forest.roots(near) != forest.root(i)]
        if not len(near):
            continue
        own = place[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        lengths = sizes[near]
        # the members of all candidates in one row; sums over each one's stretch are the overlaps
        at = np.repeat(starts[near] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        overlap = np.add.reduceat(mark[place[at]].astype(np.int64), np.cumsum(lengths) - lengths)
        mark[own] = False
        found = near[overlap >= overlap_needed(lengths, int(sizes[i]), percent)].tolist()
        if every:
            out.extend((i, j) for j in found)
            continue
        for j in found:
            forest.join(i, j)
    return out if every else forest.stars()


def meeting(sizes: np.ndarray, vectors: list[np.ndarray], percent: int, classes: np.ndarray, apart: Apart, ask: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that survive the bound: so many that each point with one is in a pair, and that they join all classes which the surviving pairs join."""
    forest, seen, out = Forest(len(sizes), classes), np.zeros(len(sizes), bool), []
    for i, near in _near_pairs(sizes, vectors, percent, apart, ask):
        roots = forest.roots(near)
        picked = np.zeros(len(near), bool)
        picked[np.unique(roots, return_index=True)[1]] = True
        picked &= roots != forest.root(i)
        picked |= ~seen[near]
        if not seen[i] and not picked.any():
            picked[0] = True
        for j in near[picked].tolist():
            forest.join(i, j)
            out.append((i, j))
        seen[i] = True
        seen[near[picked]] = True
    return out


def grouped(rows: DataFrame, key: str | list[str], function: Callable[[dict[str, list]], list[tuple]], partitions: int, schema: str) -> DataFrame:
    """Applies a function to each group of equal keys and returns its rows of whole numbers. A group is held at a time.

    Most groups are tiny, so they are found as runs in sorted partitions and not as groups of their own.
    """
    keys = [key] if isinstance(key, str) else key
    names = rows.columns
    columns_out = [f.split()[0] for f in schema.split(", ")]
    dealt = rows.repartition(partitions, *keys).sortWithinPartitions(*keys)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=columns_out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        out: list[tuple] = []

        def flush() -> None:
            if len(held["doc_id"]) > 1:
                out.extend(function(held))
            for n in names:
                held[n] = []

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(n).to_pylist() for n in names}
            key = list(zip(*(columns[k] for k in keys), strict=True))
            starts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for a, b in zip(starts, starts[1:], strict=False):
                if key[a] != last:
                    flush()
                    last = key[a]
                    if len(out) >= MOST_ROWS:
                        yield made(out)
                        out.clear()
                for n in names:
                    held[n].extend(columns[n][a:b])
            if out:
                yield made(out)
                out.clear()
        flush()
        if out:
            yield made(out)

    return arrow_map(dealt, run, schema)


def sets_of(docs: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """The texts of placed ids (doc_id and more) as sets: placed's columns and the set, as bytes. Repeated rows count once a task."""
    names = placed.columns
    if placed.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    picked = docs.select("doc_id", "text").join(placed, "doc_id").select(*names, "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in (part for whole in batches for part in slices(whole, 512)):
            sets = [s.tobytes() for s in shingle_sets(texts_of(batch), width)]
            keys = [(i, xxhash.xxh3_64_intdigest(s)) for i, s in zip(batch.column("doc_id").to_pylist(), sets, strict=True)]
            first = [bool(s) and k not in seen and not seen.add(k) for k, s in zip(keys, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sets, pa.binary())], names=[*names, "set"]).filter(pa.array(first, pa.bool_()))

    return arrow_map(picked, run, ", ".join([*(f"{n} {placed.schema[n].dataType.simpleString()}" for n in names), "set binary"]))


def _sets(held: dict[str, list]) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in held["set"]]


def _points(held: dict[str, list]) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.array(held["n_shingles"], np.int64), [_unpacked(v, n) for v, n in zip(held["vector"], held["n_shingles"], strict=True)]


def in_blocks(rows: DataFrame, key: str, blocks: Column, others: Column) -> DataFrame:
    """Rows with a key -> a row for each pair of blocks (_a, _b) a row takes part in; two rows meet where one is _resident and the other a _visitor.

    All are dealt into ``blocks`` as residents, and those that are not of the most frequent class (``_main`` is false) into
    ``others`` as visitors: two of the most frequent class never meet, every other pair does.
    """
    deal = lambda seed, n: F.pmod(F.xxhash64("doc_id", F.lit(seed)), n).cast("int")
    dealt = rows.withColumns({"_blocks": blocks.cast("int"), "_others": F.greatest(others.cast("int"), F.lit(1))}).withColumns({"_own": deal(5, F.col("_blocks")), "_as": deal(5, F.col("_others"))})
    upto = lambda n: F.when(n == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1))
    living = F.transform(upto(F.col("_others")), lambda b: F.struct(F.col("_own").alias("a"), b.alias("b")))
    visiting = F.when(F.col("_main"), F.array().cast("array<struct<a:int,b:int>>")).otherwise(F.transform(upto(F.col("_blocks")), lambda a: F.struct(a.alias("a"), F.col("_as").alias("b"))))
    dealt = dealt.withColumn("_at", F.explode(F.array_union(living, visiting)))
    names = [c for c in rows.columns if c != "_main"]
    return dealt.select(*names, F.col("_at.a").alias("_a"), F.col("_at.b").alias("_b"), (F.col("_at.a") == F.col("_own")).alias("_resident"), (~F.col("_main") & (F.col("_at.b") == F.col("_as"))).alias("_visitor"))


def _apart(held: dict[str, list], classes: np.ndarray | None) -> Apart:
    """Of those near a row the ones it meets in this pair of blocks, of another class, that no home's block held with it."""
    resident, visitor, at = np.array(held["_resident"]), np.array(held["_visitor"]), np.array(held["at"]) if "at" in held else None

    def apart(i: int, near: np.ndarray) -> np.ndarray:
        ok = (visitor[near] if resident[i] else False) | (resident[near] if visitor[i] else False)
        if classes is not None:
            ok &= (classes[near] != classes[i]) & (at[near] != at[i])
        return near[ok]

    return apart


def shared_cells(distinct: DataFrame) -> DataFrame:
    """doc_id, cell and the cell's number of sets, of the cells that several sets share."""
    cells = distinct.select("doc_id", F.explode("prefix").alias("cell"))
    total = distinct.agg(F.sum(F.size("prefix"))).first()[0] or 0
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return split_join(cells, counts, "cell", "_n", total, "jaccard-counts")


def contracted(docs: DataFrame, distinct: DataFrame, cells: DataFrame, width: int, percent: int, block: int, partitions: int) -> tuple[DataFrame, DataFrame]:
    """The home of each set that shares a cell (doc_id, cell, _n, at; ``at`` tells cell and block), and the classes (doc_id, component) that true links in blocks of homes join."""
    home = cells.groupBy("doc_id").agg(F.max(F.struct("_n", F.xxhash64("cell").alias("_h"), "cell")).alias("_b")).select("doc_id", "_b.cell", "_b._n")
    placed = lambda n, seed: F.xxhash64("cell", F.lit(seed), F.pmod(F.xxhash64("doc_id", F.lit(5 + seed)), F.ceil(n / block)))
    home = written(home.withColumn("at", placed(F.col("_n"), 0)), "jaccard-homes")

    def near(held: dict[str, list]) -> list[tuple]:
        sizes, vectors = _points(held)
        marked = np.zeros(len(sizes), bool)
        for i, js in _near_pairs(sizes, vectors, percent):
            marked[i] = True
            marked[js] = True
        return [(held["doc_id"][i], held["at"][i]) for i in np.flatnonzero(marked)]

    points = home.select("doc_id", "at").join(distinct.select("doc_id", "n_shingles", "vector"), "doc_id")
    involved = written(grouped(points, "at", near, partitions, "doc_id long, at long").distinct(), "jaccard-near")

    def linked(held: dict[str, list]) -> list[tuple]:
        ids = held["doc_id"]
        own = np.array(held["class"]) if "class" in held else None
        return [(ids[i], ids[j]) for i, j in verified_forest(_sets(held), percent, own)]

    found = grouped(sets_of(docs, involved, width), "at", linked, partitions, "a long, b long")
    classes = components(found).select(F.col("node").alias("doc_id"), "component")
    large = cells.where(F.col("_n") > block)
    before, seed = None, 0
    while True:
        # of each class in a cell of several blocks some sets meet those of the other classes, a block of them in all
        seed += 1
        rows = large.join(classes, "doc_id", "left").select("doc_id", "cell", F.coalesce("component", "doc_id").alias("class")).withColumn("_key", F.xxhash64("cell", "class"))
        rows = written(rows, "jaccard-rows")  # read by the counts and by the choice
        each = rows.groupBy("cell", "class", "_key").agg(F.count(F.lit(1)).alias("_m"))
        several = each.groupBy("cell").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
        known = written(each.join(several, "cell").groupBy("_key").agg(F.max("_m").alias("_m"), F.max("_c").alias("_c"), F.first("class").alias("_class")), "jaccard-large")
        left = known.select("_class").distinct().count()
        # a round that does not do much leaves the rest to the completion
        if not left or before is not None and 10 * left > 7 * before:
            return home, classes
        before = left
        some = F.greatest(F.lit(1), F.floor(block / F.col("_c")))
        few = split_join(rows, known, "_key", "_m", known.agg(F.sum("_m")).first()[0]).where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("_m") / some)) == 0)
        few = few.select("doc_id", "class", placed(F.col("_c") * some, seed).alias("at"))
        found = grouped(sets_of(docs, few, width), "at", linked, partitions, "a long, b long")
        classes = components(found.union(classes)).select(F.col("node").alias("doc_id"), "component")


def completed(docs: DataFrame, distinct: DataFrame, cells: DataFrame, home: DataFrame, classes: DataFrame, width: int, percent: int, block: int, block_shingles: int, partitions: int) -> DataFrame | None:
    """The links that are still wanting between classes, by the cells that hold several of them; None where there are none."""
    label = written(home.select("doc_id", "at").join(classes, "doc_id", "left").select("doc_id", "at", F.coalesce("component", "doc_id").alias("class")), "jaccard-classes")
    rows = cells.select("doc_id", "cell").join(label, "doc_id")
    open_ = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), *(f(c).alias(f"_{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("class", "at")))
    open_ = written(open_.where("_low_class < _high_class and _low_at < _high_at").select("cell", "_n"), "jaccard-open")
    if open_.isEmpty():
        return None
    # the most frequent class matters where a cell is dealt into several blocks
    large = open_.where(F.col("_n") > block)
    each = rows.join(large.select("cell"), "cell", "left_semi").groupBy("cell", "class").agg(F.count(F.lit(1)).alias("_m"))
    main = each.groupBy("cell").agg(F.max_by("class", "_m").alias("_most"), F.max("_m").alias("_m"))
    known = open_.join(main, "cell", "left")
    total = open_.agg(F.sum("_n")).first()[0]
    members = split_join(rows, known, "cell", "_n", total, "jaccard-known")
    points = members.join(distinct.select("doc_id", "n_shingles", "vector"), "doc_id").withColumn("_main", F.coalesce(F.col("class") == F.col("_most"), F.lit(False)))
    dealt = in_blocks(points, "cell", F.ceil(F.col("_n") / block), F.ceil((F.col("_n") - F.coalesce("_m", F.lit(0))) / block)).drop("_n", "_m", "_most")

    def candidates(held: dict[str, list]) -> list[tuple]:
        ids, own = held["doc_id"], np.array(held["class"])
        sizes, vectors = _points(held)
        if len(ids) == 2:  # most cells
            if not len(_apart(held, own)(1, np.zeros(1, np.int64))):
                return []
            g = min(map(len, vectors))
            if np.minimum(_folded(vectors[0], g), _folded(vectors[1], g)).sum() < overlap_needed(int(sizes[0]), int(sizes[1]), percent):
                return []
            return [(ids[0], ids[1], int(own[0]), int(own[1]))]
        return [(ids[i], ids[j], int(own[i]), int(own[j])) for i, j in meeting(sizes, vectors, percent, own, _apart(held, own), np.array(held["_visitor"]))]

    pairs = written(grouped(dealt, ["cell", "_a", "_b"], candidates, partitions, "a long, b long, ca long, cb long").distinct(), "jaccard-candidates")
    if pairs.isEmpty():
        return None
    clusters = components(pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    # the sets of a class that meet another class
    ends = F.array(*[F.struct(F.col(i).alias("doc_id"), F.col(c).alias("class")) for i, c in (("a", "ca"), ("b", "cb"))])
    some = written(pairs.select(F.inline(ends)).distinct(), "jaccard-some")
    per_class = some.groupBy("class").agg(F.count(F.lit(1)).alias("_m")).join(clusters, "class")
    sizes = distinct.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    some = split_join(some, per_class, "class", "_m", some.count(), "jaccard-per-class").join(label.select("doc_id", "at"), "doc_id").join(sizes, "doc_id")
    some = written(some, "jaccard-some")
    of_cluster = some.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s"), F.max(F.struct("_m", "class")).alias("_most"))
    some = split_join(some.drop("_m"), of_cluster, "cluster", "_n", some.count(), "jaccard-of-cluster")
    part = lambda n: F.greatest(F.ceil(n / block), F.ceil(F.col("_s") * n / F.col("_n") / block_shingles))
    some = some.select("doc_id", "class", "cluster", "at", (F.col("class") == F.col("_most.class")).alias("_main"), part(F.col("_n")).alias("_k"), part(F.col("_n") - F.col("_most._m")).alias("_o"))
    dealt = in_blocks(sets_of(docs, some, width), "cluster", F.col("_k"), F.col("_o")).drop("_k", "_o")

    def linked(held: dict[str, list]) -> list[tuple]:
        ids, own = held["doc_id"], np.array(held["class"])
        return [(ids[i], ids[j]) for i, j in verified_forest(_sets(held), percent, own, apart=_apart(held, own), ask=np.array(held["_visitor"]))]

    return grouped(dealt, ["cluster", "_a", "_b"], linked, partitions, "a long, b long")


def _components(docs: DataFrame, width: int, percent: int, buckets: int, block: int, block_shingles: int, partitions: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sketches, those with an id and words, the distinct sets of these, and links (a, b) whose components are those of all links."""
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    sketched = written(sketches(docs, bucket_counts(docs, width, buckets), width, percent), "jaccard-sketches")
    nodes = sketched.where("doc_id is not null and n_shingles > 0")
    # equal sets: the smallest id stands for all; grouped with map-side combining, so copies never meet as rows
    distinct = nodes.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_copies"), *(F.first(c).alias(c) for c in ("n_shingles", "prefix", "vector")))
    distinct = written(distinct, "jaccard-sets")
    cells = written(shared_cells(distinct), "jaccard-cells")
    home, classes = contracted(docs, distinct, cells, width, percent, block, partitions)
    links = completed(docs, distinct, cells, home, classes, width, percent, block, block_shingles, partitions)
    return sketched, nodes, distinct, classes.toDF("a", "b") if links is None else links.union(classes)


def join_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, buckets: int = BUCKETS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, partitions: int | None = None) -> DataFrame:
    """Documents (doc_id, text) -> every link (a, b), a < b, between distinct sets, once; the smallest id stands for a set.

    A component of m sets has up to m * (m - 1) / 2 of them. Two sets that one id stands for are one node and have no row.
    """
    docs = docs.select("doc_id", "text")
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _, _, distinct, links = _components(docs, width, percent, buckets, block, block_shingles, partitions)
    of = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    some = written(of.join(distinct.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id"), "jaccard-some")
    of_cluster = some.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s"))
    some = split_join(some.drop("n_shingles"), of_cluster, "cluster", "_n", some.count(), "jaccard-of-cluster")
    some = some.select("doc_id", "cluster", F.lit(False).alias("_main"), F.greatest(F.ceil(F.col("_n") / block), F.ceil(F.col("_s") / block_shingles)).alias("_k"))
    dealt = in_blocks(sets_of(docs, some, width), "cluster", F.col("_k"), F.col("_k")).drop("_k")

    def linked(held: dict[str, list]) -> list[tuple]:
        ids = held["doc_id"]
        return [(ids[i], ids[j]) for i, j in verified_forest(_sets(held), percent, every=True, apart=_apart(held, None), ask=np.array(held["_visitor"]))]

    found = grouped(dealt, ["cluster", "_a", "_b"], linked, partitions, "a long, b long")
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, buckets: int = BUCKETS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, partitions: int | None = None) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, n_shingles, component_id, a row per row.

    A-Z count as a-z. Null, empty and blank texts have no shingles and link with nothing. Rows of one doc_id
    are one node: they are joined with whatever any of them links to. Rows of a null doc_id
    link with nothing and have no component. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketched, nodes, distinct, links = _components(docs, width, percent, buckets, block, block_shingles, partitions)
    # copies follow the id that stands for their set; only ids with several sets are links themselves
    total = nodes.count()
    stands = distinct.select("set_hash", F.col("doc_id").alias("_rep"), "_copies")
    member = split_join(nodes.select("doc_id", "set_hash"), stands, "set_hash", "_copies", total).select("doc_id", "_rep")
    member = member.groupBy("doc_id").agg(F.min("_rep").alias("_rep"), F.max("_rep").alias("_other"))
    several = member.where("_rep <> _other or _rep <> doc_id and _other = doc_id").select("doc_id")
    several = split_join(nodes.join(several, "doc_id", "left_semi").select("doc_id", "set_hash").distinct(), stands, "set_hash", "_copies", total).select(F.col("doc_id").alias("a"), F.col("_rep").alias("b"))
    found = written(components(links.union(several)), "jaccard-found")
    per_node = member.groupBy("_rep").agg(F.count(F.lit(1)).alias("_n")).join(found, F.col("_rep") == F.col("node"), "left").select("_rep", F.coalesce("component", "_rep").alias("component"), "_n")
    member = split_join(member, per_node, "_rep", "_n", total, "jaccard-per-node").select(F.col("doc_id").alias("_member"), "component")
    out = sketched.select("doc_id", "n_shingles").join(member, F.col("doc_id") == F.col("_member"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents with the smallest doc_id of each component, all columns as they are.

    Of several rows of one doc_id one stays. Rows without words, or without a doc_id, all stay (the former once a doc_id).
    """
    found = written(join_components(docs, **options).where("doc_id is not null"), "jaccard-components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        again = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(again)
    return kept


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM words WHERE len(ws) > 0)
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM shared JOIN sized a ON a.doc_id = x JOIN sized b ON b.doc_id = y WHERE 100 * shared.n >= 85 * (a.n + b.n - shared.n)
), ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sized UNION SELECT reach.doc_id, y FROM reach JOIN ways ON other = x
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""
