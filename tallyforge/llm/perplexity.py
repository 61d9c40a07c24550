"""Language-model scores of whole documents: a smoothed unigram base, and the gated recurrent model of ``recurrent``.

1. Counts. Words of the training documents (all but one in ``FOLDS``) are counted on the executors. At most ``LOOKUP``, all from some count on, go to all tasks with
   their counts, the first ``WORDS`` of these have a symbol of their own. The others belong to one of ``GROUPS`` groups by their letters (the
   nearest centre of letter-pair profiles, which are fitted to the frequent words).
2. Reading. Every document's words become symbols once, which training and scoring share.
3. Training. All training documents are cut into stretches of symbols. A hash deals every stretch to one round, which reads its stretches in shards, all from
   the same weights, and the shards' weights are averaged in a tree.
4. Scoring. Every document's symbols are scored with the state carried from window to window. Rare words are no symbols: their documents meet their counts
   in a join by the word's hash, for the base and for a word's share of its group (an unseen word has what Witten and Bell's estimate leaves for it, by group).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import recurrent
from tallyforge.llm.common import CACHE_WORDS, arrow_map, dropped, mix64, portions, table, texts_of, written

FOLDS = 10
#: Words with a symbol, words whose counts all tasks hold, groups of the other words, and output classes of the symbols.
WORDS, LOOKUP, GROUPS, CLASSES = 2048, 65_536, 16, 40
#: Rounds of training, which share all stretches, and symbols of a shard.
ROUNDS, SHARD = 4, 1 << 20
#: Stretches that are trained together: an eighth of a shard's, between these.
LEAST_STREAMS, STREAMS = 64, 1024
#: Bytes of symbols that are scored at once; a longer text is scored alone.
PORTION = 8 << 20
#: Added to every count of the base.
ADDED = 0.1
#: Values of hashed pairs of bytes.
_PROFILE = 256


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def counted(docs: DataFrame) -> DataFrame:
    """word (its bytes), n: over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for whole in batches:
            for batch in portions(whole):
                for text in texts_of(batch):
                    counts.update(text.lower().split())
                if len(counts) > 2 * CACHE_WORDS:
                    yield flush()
        yield flush()

    return arrow_map(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least count from which on there are at most ``most`` words. Counts are grouped exactly below 1,024 and by 64 steps to a doubling beyond."""
    n = F.col("n")
    step = F.when(n < 1024, n).otherwise(1024 + F.floor(F.log2(n.cast("double")) * 64)).cast("long")
    found, held = 1, 0
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"), F.max("n").alias("top")).collect()
    for r in sorted(sizes, key=lambda r: -r.step):
        held += r.words
        if held > most:
            return r.top + 1
        found = r.least
    return found


# ---- groups of words by their letters


def _pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed pairs of neighbouring bytes of all words, ends included, and where each word's begin."""
    flat = np.frombuffer(b"\x00" + b"\x00".join(words) + b"\x00", np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return (flat[:-1] * 31 + flat[1:] * 7) % _PROFILE, np.cumsum(sizes) - sizes


def profiles(words: list[bytes]) -> np.ndarray:
    """Counts of the pairs of each word, of length 1."""
    pairs, starts = _pairs(words)
    rows = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(pairs))))
    out = np.bincount(rows * _PROFILE + pairs, minlength=len(words) * _PROFILE).reshape(len(words), _PROFILE).astype(np.float32)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-6)


def centres_of(words: list[bytes], counts: np.ndarray, groups: int = GROUPS, rounds: int = 12, seed: int = 2) -> np.ndarray:
    """Centres of the words' profiles (spherical k-means, words weighed by the root of their counts)."""
    if not words:
        return np.zeros((groups, _PROFILE), np.float32)
    x, weight = profiles(words), np.sqrt(np.asarray(counts, np.float32))[:, None]
    centres = x[np.random.default_rng(seed).permutation(len(x))[np.arange(groups) % len(x)]]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x * weight)
        some = np.abs(sums).sum(1) > 0
        centres[some] = sums[some] / np.sqrt((sums[some] ** 2).sum(1, keepdims=True))
    return centres


def groups_of(words: list[bytes], centres: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """The nearest centre of each word: the largest sum of its pairs' values, whatever the length of its profile."""
    if not words:
        return np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    of, out, start = np.ascontiguousarray(centres.T), [], 0
    while start < len(words):  # by a bounded number of bytes at once, a word at least
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        pairs, starts = _pairs(words[start:stop])
        out.append(np.add.reduceat(of[pairs], starts, axis=0).argmax(1))
        start = stop
    return np.concatenate(out)


def word_hash(word: bytes) -> int:
    """Spark's xxhash64 of the word."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


class Lexicon:
    """What all tasks know: the frequent words with their counts, in order, and the centres of groups."""

    def __init__(self, words: list[bytes], counts: list[int], centres: np.ndarray, own: int):
        self.words, self.counts, self.centres = words, counts, centres
        self.own = min(own, len(words))
        self.symbols = 1 + self.own + len(centres)
        #: Symbols as they are written.
        self.kind = np.uint16 if self.symbols <= 1 << 16 else np.uint32

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Turns words into codes: those of frequent words are their places, 0 and up, those of others -1 and down, with a hash and a group each."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.fixed = {w: i for i, w in enumerate(lexicon.words)}
        groups = groups_of(lexicon.words[lexicon.own :], lexicon.centres)
        self.symbol_of = np.concatenate([np.arange(1, 1 + lexicon.own), 1 + lexicon.own + groups])
        self._reset()

    def _reset(self) -> None:
        self.held, self.hashes, self.groups = dict(self.fixed), [], np.zeros(4096, np.int64)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.held]
        if len(self.held) + len(new) > CACHE_WORDS + len(self.fixed):
            self._reset()
            new = [w for w in words if w not in self.held]
        if new:
            n = len(self.hashes)
            self.hashes += map(word_hash, new)
            while len(self.hashes) > len(self.groups):  # room is doubled, so that words are not copied with each text
                self.groups = np.concatenate([self.groups, np.zeros_like(self.groups)])
            self.groups[n : n + len(new)] = groups_of(new, self.lexicon.centres)
            self.held.update(zip(new, range(-n - 1, -n - len(new) - 1, -1), strict=True))

    def read(self, words: list[bytes]) -> np.ndarray:
        """The code of each word."""
        return np.fromiter(map(self.held.__getitem__, words), np.int64, len(words))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.int64)
        common = codes >= 0
        out[common] = self.symbol_of[codes[common]]
        out[~common] = 1 + self.lexicon.own + self.groups[-codes[~common] - 1]
        return out


# ---- training

STRETCH = recurrent.WINDOW * recurrent.WINDOWS


def stretches(parts: DataFrame, kind: type, number: int, rounds: int = ROUNDS) -> DataFrame:
    """key, symbols: the stretches of documents (key, symbols) that one of the rounds reads. Each stretch is read in one round."""
    size = STRETCH * np.dtype(kind).itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("symbols").to_pylist()
            n = np.array([-(-len(t) // size) for t in texts], np.int64)
            first = np.cumsum(n) - n
            of = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(of)) - first[of]
            # a number in [0, 2^53) for each stretch, which says its round and its place among others
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            u = (mix64(place.astype(np.uint64) + keys[of]) >> np.uint64(11)).astype(np.int64)
            own = np.flatnonzero(u * rounds >> 53 == number)
            pieces = [texts[i][j * size : (j + 1) * size] for i, j in zip(of[own].tolist(), place[own].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(u[own], pa.int64()), pa.array(pieces, pa.binary())], names=["key", "symbols"])

    return arrow_map(parts.select("key", "symbols"), run, "key long, symbols binary")


def trained(parts: DataFrame, kind: type, classes: recurrent.Classes, p: dict[str, np.ndarray], shards: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of training on shards, each from the mean of the shards' weights after the last, weighed by what they read."""
    spark = parts.sparkSession
    seen = recurrent.fresh_squares(p)
    add = lambda a, b: b if a is None else a if b is None else {k: a[k] + b[k] for k in a}
    for r in range(rounds):
        held = spark.sparkContext.broadcast((p, seen, classes))
        own = stretches(parts, kind, r, rounds).repartition(shards, "key")

        def run(part: Iterable, held=held) -> Iterator[dict[str, np.ndarray]]:
            p, seen, classes = held.value
            # a shard's stretches in an order of their own, however they came
            own = [np.frombuffer(s, kind) for _, s in sorted((row.key, bytes(row.symbols)) for row in part)]
            if own:
                p, seen, n = recurrent.train(p, seen, classes, own, min(STREAMS, max(LEAST_STREAMS, len(own) // 8)))
                yield {"n": np.float64(n)} | {"p " + k: v * np.float32(n) for k, v in p.items()} | {"s " + k: v * np.float32(n) for k, v in seen.items()}

        # as many shards as asked for, even where Spark was told to deal to more partitions: each gives back a whole set of weights
        sums = own.rdd.coalesce(shards).mapPartitions(run).treeAggregate(None, add, add, 2)
        held.unpersist()
        if sums is not None:
            p = {k: (sums["p " + k] / sums["n"]).astype(np.float32) for k in p}
            seen = {k: (sums["s " + k] / sums["n"]).astype(np.float32) for k in seen}
    return p


# ---- the model


class Model:
    """Counts and weights. ``group_tokens``, ``group_words``: of each group's words without a symbol, how often they occur and how many there are."""

    def __init__(self, lexicon: Lexicon, total: int, distinct: int, ends: int, weights: dict[str, np.ndarray], classes: recurrent.Classes, group_tokens: list[int], group_words: list[int]):
        self.lexicon, self.total, self.distinct, self.ends, self.weights, self.classes = lexicon, total, distinct, ends, weights, classes
        self.group_tokens, self.group_words = group_tokens, group_words
        self.base_size = math.log10(total + ADDED * (distinct + 1))

    def unseen(self, group: int) -> float:
        """What is left for words that the group has not shown yet."""
        return (self.group_words[group] + 0.5) / (self.group_tokens[group] + self.group_words[group] + 1)


def fit(docs: DataFrame, words: int = WORDS, lookup: int = LOOKUP, groups: int = GROUPS, least: int = SHARD, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of all training documents, and the counts of their words (hash, n, group; without those with a symbol). ``least``: symbols of a shard."""
    model, rest, parts = _fitted(docs, words, lookup, groups, least, rounds)
    dropped(parts)
    return model, rest


def _fitted(docs: DataFrame, words: int = WORDS, lookup: int = LOOKUP, groups: int = GROUPS, least: int = SHARD, rounds: int = ROUNDS) -> tuple[Model, DataFrame, DataFrame]:
    """What fit() gives, and the documents as they were read for it."""
    spark = docs.sparkSession
    learnt = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    counts = written(counted(learnt), "lm-counts")
    ends = learnt.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    # the words from some count on, as many as fit: a top-k would bring as many rows from every task to the driver
    least_n = frequent_from(counts, lookup)
    top = sorted(counts.where(F.col("n") >= least_n).collect(), key=lambda r: (-r.n, bytes(r.word)))
    names, numbers = [bytes(r.word) for r in top], [r.n for r in top]
    lexicon = Lexicon(names, numbers, centres_of(names[:words], np.array(numbers[:words])), words)
    held = spark.sparkContext.broadcast(lexicon)

    def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        own = frozenset(known.words[: known.own])
        for batch in batches:
            names = batch.column("word").to_pylist()
            of = pa.array(groups_of(names, known.centres), pa.int32())
            out = pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), of], names=["word", "n", "group"])
            yield out.filter(pa.array([w not in own for w in names], pa.bool_()))

    rest = arrow_map(counts, grouped, "word binary, n long, group int").select(F.xxhash64("word").alias("hash"), "n", "group")
    rest = written(rest, "lm-words")
    tokens, kinds = [0] * groups, [0] * groups
    for r in rest.groupBy("group").agg(F.sum("n").alias("n"), F.count("n").alias("kinds")).collect():
        tokens[r["group"]], kinds[r["group"]] = r.n, r.kinds
    symbol_counts = np.array([ends, *numbers[: lexicon.own], *tokens], np.float64)
    classes = recurrent.Classes(symbol_counts[: 1 + lexicon.own], groups, CLASSES)
    size = total + ends
    model = Model(lexicon, size, distinct + (ends > 0), ends, recurrent.initial(classes, symbol_counts), classes, tokens, kinds)
    dropped(counts)
    parts = written(_parts(docs, model), "lm-parts")
    model.weights = trained(parts.where(~held_out(F.col("doc_id"))), lexicon.kind, classes, model.weights, max(1, math.ceil(size / rounds / least)), rounds)
    return model, rest, parts


# ---- scores

_PARTS = "row long, doc_id long, key long, n_tokens long, n_known long, base double, score double, hashes array<long>, counts array<int>, groups array<int>, symbols binary"
_SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _parts(docs: DataFrame, model: Model) -> DataFrame:
    """Of each document its symbols, what its frequent words give, and its other words by hash."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        reader = m.lexicon.reader()
        frequent = np.array(m.lexicon.counts, np.float64)
        base_of = np.log10(frequent + ADDED)
        own = m.lexicon.own
        # a frequent word without a symbol has its share of its group
        within = np.zeros(len(frequent))
        of_group = reader.symbol_of[own:] - 1 - own
        left = np.array([1 - m.unseen(g) for g in range(len(m.group_tokens))])
        within[own:] = np.log10(left[of_group] * frequent[own:] / np.maximum(1, m.group_tokens)[of_group])
        end = math.log10(m.ends + ADDED)
        row = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        for whole in batches:
            for batch in portions(whole):
                texts = [t.lower().split() for t in texts_of(batch)]
                n = len(texts)
                sizes = np.array([len(t) for t in texts], np.int64)
                words = [w for t in texts for w in t]
                reader.learn(set(words))
                codes = reader.read(words)
                of = np.repeat(np.arange(n), sizes)
                symbols = np.zeros(len(codes) + n, m.lexicon.kind)  # each text's end is 0
                symbols[np.arange(len(codes)) + of] = reader.symbols(codes)
                common = codes >= 0
                per_text = lambda values: np.bincount(of[common], values, n)  # noqa: E731, B023
                # a text's other words, each once
                distinct, times = np.unique(of[~common] * (1 << 32) - codes[~common] - 1, return_counts=True)
                text_of, word_of = distinct >> 32, distinct & ((1 << 32) - 1)
                offsets = pa.array(np.searchsorted(text_of, np.arange(n + 1)), pa.int32())
                lists = lambda values: pa.ListArray.from_arrays(offsets, values)  # noqa: E731, B023
                ends = np.append(0, np.cumsum(sizes + 1)).astype(np.int32) * np.int32(symbols.itemsize)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n), pa.int64()), batch.column("doc_id").cast(pa.int64()), batch.column("_key"), pa.array(sizes + 1, pa.int64()), pa.array(np.bincount(of[common], minlength=n) + (m.ends > 0), pa.int64()),
                        pa.array(per_text(base_of[codes[common]]) + end, pa.float64()), pa.array(per_text(within[codes[common]]), pa.float64()),
                        lists(pa.array([reader.hashes[i] for i in word_of.tolist()], pa.int64())), lists(pa.array(times, pa.int32())), lists(pa.array(reader.groups[word_of], pa.int32())),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(symbols)]),
                    ],
                    names=_names(_PARTS),
                )
                row += n

    return arrow_map(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key")), run, _PARTS)


def _scored(parts: DataFrame, model: Model) -> DataFrame:
    """The parts with what the recurrent model gives to their symbols added to the score."""
    held = parts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for batch in portions(whole, PORTION, "symbols"):
                symbols = [np.frombuffer(s, m.lexicon.kind) for s in batch.column("symbols").to_pylist()]
                score = recurrent.scores(m.weights, m.classes, symbols) / math.log(10) + batch.column("score").to_numpy()
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _names(_SCORED)[:-1]), pa.array(score, pa.float64())], names=_names(_SCORED))

    return arrow_map(parts.select(*_names(_SCORED), "symbols"), run, _SCORED)


def score(docs: DataFrame, fitted: tuple[Model, DataFrame] | None = None) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are their end alone. A null doc_id is not held out. Repeated rows count each in training and get a row each;
    whole texts are read; an empty table gives no rows, and without training documents every token is unseen. Other columns are not read.
    """
    if fitted:
        model, words = fitted
        parts = written(_parts(docs, model), "lm-parts")
    else:
        model, words, parts = _fitted(docs)
    pairs = parts.select("row", F.explode(F.arrays_zip("hashes", "counts", "groups")).alias("w")).select("row", F.col("w.hashes").alias("hash"), F.col("w.counts").alias("times"), F.col("w.groups").alias("group"))
    found = pairs.join(words.select("hash", "n"), "hash", "left").select("row", "times", "group", F.coalesce("n", F.lit(0)).alias("n"))
    group = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("group") + 1)
    groups = range(len(model.group_tokens))
    seen = [math.log10((1 - model.unseen(g)) / max(1, model.group_tokens[g])) for g in groups]
    unseen = [math.log10(model.unseen(g)) for g in groups]
    within = F.when(F.col("n") > 0, group(seen) + F.log10(F.col("n").cast("double"))).otherwise(group(unseen))
    sums = found.repartition("row").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(ADDED))).alias("_base"), F.sum(F.col("times") * within).alias("_score")
    )
    rows = _scored(parts, model).join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + zero("_known")).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("_base") - F.col("n_tokens") * F.lit(model.base_size)).alias("base_score"), (F.col("score") + zero("_score")).alias("score"),
    )


def op12_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
