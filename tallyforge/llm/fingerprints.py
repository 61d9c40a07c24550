"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest 64-bit hashes of a text's distinct word shingles, in order. Sketches of
parts merge into the sketch of the whole, and two sketches estimate resemblance, containment and the
number of distinct shingles. Below k shingles a sketch is the whole set and the estimates are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyforge.llm.common import arrow_map, portions, shingle_sets, table, texts_of

K = 128
WIDTH = 5
#: Bytes of texts that are held at once; a longer text is held alone.
PORTION = 1 << 20
_SPAN = 2.0**64


def sketches(texts: list[bytes], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """Of each text; A-Z count as a-z. Texts without words have an empty sketch."""
    return [s[:k] for s in shingle_sets(texts, width)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what a and b were made from."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPAN / float(a[k - 1])


def _both(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    union = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)), len(union)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A or B|; 1 for two empty sketches."""
    shared, union = _both(a, b, k)
    return shared / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A|; 1 for an empty A."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprint(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, fingerprint; a row per row, nulls as empty texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(s) for s in sketches(texts_of(batch), k, width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string")


def merged(docs: DataFrame, group: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, group) -> group (of its own type), fingerprint and n_shingles of all its texts.

    Each task merges what it reads of a group before the shuffle, so a group however large sends one
    sketch a task; a second merge, salted by task, and a third bring them together. A null group is a group, null texts
    are empty, repeated rows change nothing, an empty table gives no rows.
    """
    kind = docs.schema[group].dataType
    schema = StructType([StructField("_group", kind), StructField("fingerprint", StringType())])
    arrow = to_arrow_type(kind)

    def rows(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), arrow), pa.array([encode(s) for s in held.values()], pa.string())], names=["_group", "fingerprint"])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for g, s in zip(batch.column("_group").to_pylist(), sketches(texts_of(batch), k, width), strict=True):
                held[g] = merge(held[g], s, k) if g in held else s
            if len(held) > 10_000:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = None, None
        for batch in batches:
            out = {}
            for g, f in zip(batch.column("_group").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                if s is not None and g != last[0]:
                    out[last[0]] = s
                    s = None
                s = decode(f) if s is None else merge(s, decode(f), k)
                last = (g,)
            if out:
                yield rows(out)
        if s is not None:
            yield rows({last[0]: s})

    parts = arrow_map(docs.select(F.col(group).alias("_group"), "text"), partial, schema)
    parts = parts.withColumn("_salt", F.spark_partition_id() % 64).repartition("_group", "_salt").sortWithinPartitions("_group")
    parts = arrow_map(parts.select("_group", "fingerprint"), combine, schema)
    whole = arrow_map(parts.repartition("_group").sortWithinPartitions("_group"), combine, schema)

    def sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [distinct(decode(f), k) for f in batch.column("fingerprint").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.float64())], names=["_group", "fingerprint", "n_shingles"])

    return arrow_map(whole, sized, StructType([*schema.fields, StructField("n_shingles", DoubleType())])).withColumnRenamed("_group", group)


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, text) -> the same rows, each partition sorted by doc_id and followed by the row after its last.

    The order is by doc_id with nulls last, then by text; after the last row comes the first. Partitions
    are ranges of doc_id between quantiles of the column, which is read alone for that. The first id of
    each range goes to the range before as well, with ``_own`` false, so only one shuffle moves texts.
    The edges and first ids, two numbers a partition, travel with a function of the ids and not as a part of the plan.
    """
    edges = docs.agg(F.percentile_approx("doc_id", [i / partitions for i in range(1, partitions)], 10_000)).first()[0] if partitions > 1 else None
    edges = np.array(sorted(set(edges or [])), np.int64)
    n = len(edges)

    def parts_of(ids: pd.Series) -> np.ndarray:
        known = ids.notna().to_numpy()
        return np.where(known, np.searchsorted(edges, ids.fillna(0).to_numpy(np.int64), "right"), n).astype(np.int32)

    part = F.pandas_udf(lambda ids: pd.Series(parts_of(ids)), "int")
    heads = {r._part: r.head for r in docs.select("doc_id", part("doc_id").alias("_part")).groupBy("_part").agg(F.min("doc_id").alias("head")).collect()}
    order = sorted(heads)
    before = np.full(n + 1, -1, np.int32)  # the range before each, and before the first the last
    for i, p in enumerate(order):
        before[p] = order[i - 1]
    first = np.array([heads.get(p) if heads.get(p) is not None else 0 for p in range(n + 1)], np.int64)
    only_null = None in heads.values()  # a range of null ids alone

    def copies_of(ids: pd.Series) -> pd.DataFrame:
        at = parts_of(ids)
        known = ids.notna().to_numpy()
        is_head = (known & (ids.fillna(0).to_numpy(np.int64) == first[at])) | (~known & only_null & (at == n))
        return pd.DataFrame({"to": at, "again": np.where(is_head, before[at], -1).astype(np.int32)})

    spot = F.pandas_udf(copies_of, "to int, again int")
    dealt = docs.select("doc_id", "text", spot("doc_id").alias("_spot"))
    own, again = F.struct(F.col("_spot.to").alias("_to"), F.lit(True).alias("_own")), F.struct(F.col("_spot.again").alias("_to"), F.lit(False).alias("_own"))
    dealt = dealt.select("doc_id", "text", F.inline(F.when(F.col("_spot.again") >= 0, F.array(own, again)).otherwise(F.array(own))))
    return dealt.repartitionById(n + 1, "_to").sortWithinPartitions(~F.col("_own"), F.col("doc_id").isNull(), "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, k: int = K, width: int = WIDTH, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (its second half replaced by the start of the next document).

    Null texts are empty. A single document is followed by itself. Rows of equal doc_id are ordered by text,
    rows with a null doc_id come last. Texts are held in portions of about a megabyte, a longer one alone.
    Rows of one doc_id, and all rows of none, stay in one partition, as their texts decide their order. An empty table gives no rows; other columns are not read.
    """
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bool, object, str, np.ndarray]]:
            for whole in batches:
                for batch in portions(whole, PORTION):
                    texts = [t or "" for t in batch.column("text").to_pylist()]
                    yield from zip(batch.column("_own").to_pylist(), batch.column("doc_id").to_pylist(), texts, sketches([t.encode() for t in texts], k, width), strict=True)

        def pairs() -> Iterator[tuple]:
            held = None
            for own, i, t, s in rows():
                if held is not None:
                    yield *held, t, s
                    held = None
                if not own:
                    return
                held = (i, t, s)

        def done(held: list[tuple]) -> pa.RecordBatch:
            edited = sketches([data for *_, data, _ in held], k, width)
            return batch_of([(i, n, hashlib.sha256(data).hexdigest(), encode(s), encode(e), resemblance(s, e, k), resemblance(s, next_s, k)) for (i, n, s, data, next_s), e in zip(held, edited, strict=True)])

        out: list[tuple] = []
        size = 0
        for i, t, s, next_t, next_s in pairs():
            half = len(t) // 2
            out.append((i, len(t), s, (t[: len(t) - half] + next_t[:half]).encode(), next_s))
            size += len(out[-1][3])
            if size >= PORTION or len(out) >= 4096:
                yield done(out)
                out, size = [], 0
        if out:
            yield done(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return arrow_map(with_next(docs.select("doc_id", "text"), partitions), run, SCHEMA)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
