"""Packed binary output: best-fit-decreasing packing with a segment tree over remaining capacities.

Documents longer than a row are split losslessly into full rows and a rest. The pieces of a stretch of
documents are placed in order of decreasing length, each into the open row with the smallest remaining
capacity that holds it; a segment tree over the capacities finds it in O(log length).

A stretch becomes one matrix: padded ids, cumulative segment lengths per row and position ids that
restart with each segment. Stretches are bounded, so memory is too, and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import arrow_map, table
from tallyforge.llm.tokens import encoded, vocabulary_path

LENGTH = 2048
STRETCH = 1_000_000
PAD_ID = 0

MATRICES = "matrix_id long, n_rows int, length int, ids binary, position_ids binary, cu_seqlens array<array<int>>, doc_ids array<array<long>>, starts array<array<long>>"
ROWS = "sequence_id long, n_tokens long, n_segments long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids_crc32 long, positions_crc32 long, ids binary, position_ids binary"


class CapacityTree:
    """Open rows by remaining capacity; the tree counts them, so the smallest sufficient capacity is found top-down."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def best(self, need: int) -> int | None:
        """Takes out a row of the smallest capacity >= need and returns that capacity and the row."""
        i = need + self.leaves
        if not self.count[i]:
            # up to the first ancestor with something to the right, then down to its leftmost leaf
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        row = self.rows[capacity].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity * (1 << 32) + row


def best_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, offset) of each piece and the number of rows; pieces of equal length keep their order."""
    tree, n_rows = CapacityTree(length), 0
    row, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.best(need)
        if found is None:
            capacity, r = length, n_rows
            n_rows += 1
        else:
            capacity, r = divmod(found, 1 << 32)
        row[i], offset[i] = r, length - capacity
        if capacity > need:
            tree.add(capacity - need, r)
    return row, offset, n_rows


def split(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of these lengths."""
    n = -(-lengths // length)
    doc = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
    return doc, start, np.minimum(length, lengths[doc] - start)


def _matrices(batches: Iterable[pa.RecordBatch], path: str, length: int, stretch: int) -> Iterator[dict]:
    partition, made = TaskContext.get().partitionId(), 0
    held: list[tuple[object, np.ndarray]] = []
    ids_held = 0

    def flush() -> dict:
        doc, start, size = split(np.array([len(x) for _, x in held], np.int64), length)
        row, offset, n_rows = best_fit(size, length)
        ids = np.full((n_rows, length), PAD_ID, "<u4")
        positions = np.zeros((n_rows, length), "<u4")
        order = np.lexsort((offset, row))
        cu, doc_ids, starts = ([[0] for _ in range(n_rows)], [[] for _ in range(n_rows)], [[] for _ in range(n_rows)])
        for d, s, n, r, o in np.stack([doc, start, size, row, offset], 1)[order].tolist():
            ids[r, o : o + n] = held[d][1][s : s + n]
            positions[r, o : o + n] = np.arange(n)
            cu[r].append(o + n)
            doc_ids[r].append(held[d][0])
            starts[r].append(s)
        return {"matrix_id": (partition << 40) + made, "n_rows": n_rows, "length": length, "ids": ids, "position_ids": positions, "cu_seqlens": cu, "doc_ids": doc_ids, "starts": starts}

    for row in encoded(batches, path):
        held.append(row)
        ids_held += len(row[1])
        if ids_held >= stretch:
            m = flush()
            yield m
            made += m["n_rows"]
            held, ids_held = [], 0
    if held:
        yield flush()


def packed_matrices(docs: DataFrame, path: str | None = None, length: int = LENGTH, stretch: int = STRETCH) -> DataFrame:
    """Documents (doc_id, text) -> a row per matrix (MATRICES); ids and position_ids are little-endian uint32, row by row.

    The matrix's rows are the sequences matrix_id, matrix_id + 1, ... Null and empty texts are the end id
    alone; long texts lose nothing; repeated rows stay apart; a null doc_id stays null; an empty table
    gives no matrix; other columns are not read.
    """
    path = path or vocabulary_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _matrices(batches, path, length, stretch):
            types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64()))]
            m = m | {"ids": m["ids"].tobytes(), "position_ids": m["position_ids"].tobytes()}
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(m.values(), types, strict=True)], names=list(m))

    return arrow_map(docs.select("doc_id", "text"), run, MATRICES)


def packed_rows(docs: DataFrame, path: str | None = None, length: int = LENGTH, stretch: int = STRETCH) -> DataFrame:
    """The same packing, a row per sequence (ROWS): the rows of the matrices, little-endian uint32, and their checksums.

    Nulls, empty and long texts, repeated rows and empty tables as in packed_matrices().
    """
    path = path or vocabulary_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _matrices(batches, path, length, stretch):
            n = m["n_rows"]
            columns = [
                pa.array(range(m["matrix_id"], m["matrix_id"] + n), pa.int64()),
                pa.array([c[-1] for c in m["cu_seqlens"]], pa.int64()),
                pa.array([len(c) - 1 for c in m["cu_seqlens"]], pa.int64()),
                pa.array(m["doc_ids"], pa.list_(pa.int64())),
                pa.array(m["starts"], pa.list_(pa.int64())),
                pa.array(m["cu_seqlens"], pa.list_(pa.int32())),
                pa.array([zlib.crc32(r) for r in m["ids"]], pa.int64()),
                pa.array([zlib.crc32(r) for r in m["position_ids"]], pa.int64()),
                pa.array([r.tobytes() for r in m["ids"]], pa.binary()),
                pa.array([r.tobytes() for r in m["position_ids"]], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ROWS.split(", ")])

    return arrow_map(docs.select("doc_id", "text"), run, ROWS)


def write_packed(docs: DataFrame, target: str, **options) -> None:
    """Writes the matrices as Parquet; Spark's committer leaves whole files only."""
    packed_matrices(docs, **options).write.parquet(target)


def read_packed(spark: SparkSession, target: str) -> Iterator[dict]:
    """The matrices of a folder, one at a time, as numpy arrays."""
    for m in spark.read.parquet(target).orderBy("matrix_id").toLocalIterator():
        shape = (m.n_rows, m.length)
        yield m.asDict() | {"ids": np.frombuffer(m.ids, "<u4").reshape(shape), "position_ids": np.frombuffer(m.position_ids, "<u4").reshape(shape)}


def op3_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"))
