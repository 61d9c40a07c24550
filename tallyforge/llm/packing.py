"""Order-preserving packing by dynamic programming over window cuts.

The documents of a partition form one stream of ids in their order. A window is a stretch of at most
``length`` ids; cuts may fall at the end of a document (free), at the end of a sentence (a small
penalty) or, inside a long stretch without either, at any id (a larger penalty). The program minimises
the padding of all windows plus the penalties of their cuts.

With cut positions c, f[j] = pen[j] + length - c[j] + min(f[i] + c[i]) over the i within ``length`` ids
before j, so a monotone queue gives each transition in amortised constant time. Windows whose length is a
power of two need no padding; these transitions are looked up besides.

There is no shuffle: a partition of the scan is packed where it is read, in stretches of
``stretch`` ids, so memory is bounded whatever the partition holds. Each stretch ends in one
window that may be short.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import arrow_map, table
from tallyforge.llm.tokens import encoded, encoder, vocabulary_path

LENGTH = 2048
#: Penalties in ids of padding: for a document truncated at a sentence's end, and elsewhere.
SENTENCE_PENALTY = 4.0
INSIDE_PENALTY = 24.0
#: Stretches without a sentence end get cuts inside, this far apart.
SPACING = 32
STRETCH = 2_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidates(lengths: np.ndarray, ends: np.ndarray, spacing: int, sentence_penalty: float, inside_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in a stream of documents (0 first) and their penalties. ``ends``: positions after sentence ends."""
    docs = np.cumsum(lengths)
    total = int(docs[-1])
    # every sentence end, and the starts of the blocks of ``spacing`` ids that hold none
    inside = np.arange(0, total, spacing)
    empty = np.bincount(np.minimum(ends, total - 1) // spacing, minlength=len(inside)) == 0
    chosen = np.concatenate([docs, ends, inside[empty], [0]])
    penalty = np.concatenate([np.zeros(len(docs)), np.full(len(ends), sentence_penalty), np.full(int(empty.sum()), inside_penalty), [0.0]])
    order = np.lexsort((penalty, chosen))
    chosen, penalty = chosen[order], penalty[order]
    first = np.concatenate([[True], chosen[1:] != chosen[:-1]])
    return chosen[first], penalty[first]


def cuts(positions: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The cheapest cuts: positions of window ends, from 0 to the last. Neighbouring positions are at most ``length`` apart."""
    c, pen = positions.tolist(), penalties.tolist()
    at = {p: i for i, p in enumerate(c)}
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    f, back = [0.0] * len(c), [0] * len(c)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(c)):
        here = c[j]
        while here - c[queue[0][1]] > length:
            queue.popleft()
        best, i = queue[0]
        best += length - here
        for p in powers:
            k = at.get(here - p)
            if k is not None and f[k] < best:
                best, i = f[k], k
        f[j], back[j] = best + pen[j], i
        value = f[j] + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [c[-1]], len(c) - 1
    while j:
        j = back[j]
        out.append(c[j])
    return np.array(out[::-1], np.int64)


def pieces(lengths: np.ndarray, ends: np.ndarray, length: int = LENGTH, spacing: int = SPACING, sentence_penalty: float = SENTENCE_PENALTY, inside_penalty: float = INSIDE_PENALTY) -> np.ndarray:
    """Rows (document, start in it, length, window, offset in it), in order."""
    windows = cuts(*candidates(lengths, ends, spacing, sentence_penalty, inside_penalty), length)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    edges = np.union1d(windows, bounds)
    start, size = edges[:-1], np.diff(edges)
    doc = np.searchsorted(bounds, start, "right") - 1
    window = np.searchsorted(windows, start, "right") - 1
    return np.stack([doc, start - bounds[doc], size, window, start - windows[window]], 1)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, spacing: int = SPACING, sentence_penalty: float = SENTENCE_PENALTY, inside_penalty: float = INSIDE_PENALTY, stretch: int = STRETCH) -> DataFrame:
    """Documents (doc_id, text) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of the end id alone; very long texts are cut into as many pieces as
    they need and no id is lost; repeated rows and equal ids are packed each on their own; a null doc_id
    stays null. An empty table gives no rows. Other columns are not read.
    """
    path = path or vocabulary_path()
    if spacing > length:
        raise ValueError("cuts must not be farther apart than a window is long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, windows = TaskContext.get().partitionId(), 0
        held: list[tuple[object, np.ndarray]] = []
        ids_held = 0
        ends_sentence = encoder(path).ends_sentence

        def flush() -> pa.RecordBatch:
            nonlocal windows
            lengths = np.array([len(x) for _, x in held], np.int64)
            stream = np.concatenate([x for _, x in held])
            rows = pieces(lengths, np.flatnonzero(ends_sentence[np.minimum(stream, len(ends_sentence) - 1)]) + 1, length, spacing, sentence_penalty, inside_penalty)
            crc = [zlib.crc32(held[d][1][s : s + n].astype("<u4", copy=False).tobytes()) for d, s, n in rows[:, :3].tolist()]
            sequence = (partition << 40) + windows + rows[:, 3]
            windows += int(rows[-1, 3]) + 1
            columns = [pa.array([held[d][0] for d in rows[:, 0].tolist()], pa.int64()), rows[:, 1], rows[:, 2], pa.array(crc, pa.int64()), lengths[rows[:, 0]], sequence, rows[:, 4]]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in columns], names=names)

        for row in encoded(batches, path):
            held.append(row)
            ids_held += len(row[1])
            if ids_held >= stretch:
                yield flush()
                held, ids_held = [], 0
        if held:
            yield flush()

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
