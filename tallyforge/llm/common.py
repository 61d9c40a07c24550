"""Shared pieces of the training-data operators: tables, Arrow maps, cut lineage, word hashing.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is what ``bytes.split``
without an argument yields on UTF-8 text. A null text counts as an empty one throughout.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.shipping import ship

#: Bounds the per-worker word cache; it is emptied when full, so results never depend on it.
CACHE_WORDS = 150_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH, _BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def let_go() -> None:
    """Gives a worker's freed memory back to the system; workers live on and serve other tasks, stages and jobs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with the package on the executors and memory given back after each task."""
    spark = df.sparkSession
    ship(spark)
    # where the size of Arrow batches was left as it is, they shrink: a task then holds a few MB of texts at once, not 64
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            let_go()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; nulls become empty."""
    return [t or b"" for t in batch.column(name).cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def portions(batch: pa.RecordBatch, most: int = 1 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``most`` bytes at most; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Only a session without executors of its own may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes a Parquet table in the shared folder and reads it back. The application's end removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, system = _hadoop(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table that written() made, once nothing reads it any more."""
    target, system = _hadoop(df.sparkSession, df.kept_at)
    system.delete(target, True)


#: Keys that may count as hot at most, and the rows of a key up to which it never does.
HOT_KEYS, LEAST_HOT = 50_000, 100


def split_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int, label: str | None = None) -> DataFrame:
    """Inner join with a table of one row a key, which says in ``count`` how many of left's ``total`` rows have it.

    Keys with more than total / HOT_KEYS rows are hot. There are fewer than HOT_KEYS of them, so they are broadcast;
    of the others, which are shuffled, no key brings a task more rows than that. A table that has to be computed is written first under a
    label, as it is looked at for hot keys before it is joined.
    """
    right = written(right, label) if label else right
    limit = max(LEAST_HOT, total // HOT_KEYS)
    hot = right.where(F.col(count) > limit)
    if hot.isEmpty():
        return left.join(right, key)
    hot, cold = F.broadcast(hot), right.where(F.col(count) <= limit)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (the splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A value for each byte: none for blanks, and A-Z like a-z.
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_RANDOM[65:91] = _RANDOM[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM[_BLANK] = 0
#: Bytes of text hashed at once.
SLAB = 1 << 20
_powers = np.cumprod(np.full(256, _MULTIPLIER))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of a text's bytes: sums over the bytes' values times powers of a multiplier, mixed."""
    global _powers
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    longest = int((ends - starts).max())
    if longest > len(_powers):
        _powers = np.cumprod(np.full(longest, _MULTIPLIER))
    first = int(starts[0])
    at = np.arange(first, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    sums = np.zeros(len(data) - first + 1, np.uint64)
    np.cumsum(_RANDOM[data[first:]] * _powers[np.minimum(at, len(_powers) - 1)], out=sums[1:])
    return starts, mix64(sums[ends - first] - sums[starts - first] + (ends - starts).astype(np.uint64))


def _long_word_hashes(text: bytes) -> np.ndarray:
    """Of one long text, a slab at a time, cut at blanks."""
    out, at = [], 0
    while at < len(text):
        end = at + SLAB
        if end < len(text):
            # to the next blank; a word longer than a slab is taken whole
            found = _NEXT_BLANK.search(text, end)
            end = found.start() if found else len(text)
        out.append(_word_hashes(np.frombuffer(text[at:end], np.uint8))[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_NEXT_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of words."""
    n = len(hashes) - width + 1
    h = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for i in range(width):
            h = (h + hashes[i : i + n]) * _MULTIPLIER
    return mix64(h)


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _one_set(hashes: np.ndarray, width: int) -> np.ndarray:
    if 0 < len(hashes) < width:
        return mix64(_combined(hashes, len(hashes)) + np.uint64(len(hashes)))
    return _distinct(_combined(hashes, width))


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The distinct word shingles of each text, as sorted 64-bit hashes; A-Z count as a-z.

    Fewer words than a shingle make one shingle of them all; no words make none. Texts are hashed
    together in slabs, so the cost a text is small, and long texts in several.
    """
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        ends = np.cumsum([len(t) + 1 for t in held])
        starts, hashes = _word_hashes(np.frombuffer(b" ".join(held), np.uint8))
        bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
        windows = _combined(hashes, width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield _distinct(windows[a : b - width + 1]) if b - a >= width else _one_set(hashes[a:b], width)

    for text in texts:
        if len(text) > SLAB:
            if held:
                yield from flush()
                held, size = [], 0
            yield _one_set(_long_word_hashes(text), width)
            continue
        held.append(text)
        size += len(text) + 1
        if size > SLAB:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()
