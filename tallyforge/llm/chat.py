"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation once per turn, each log a prefix of the next. A rolling hash over the turns
gives every prefix of every conversation an identity; a conversation whose whole hash is a proper prefix of
another is dropped by an anti-join, equal conversations keep the smallest id, and what is left is rendered.

Hashes are made distinct before they are compared, so a first turn or a conversation that a third of all
logs share is one row on either side of the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tallyforge.llm.common import arrow_map, table, written

START, END = "<|im_start|>", "<|im_end|>"


def rolling(roles: list[str | None], texts: list[str | None]) -> list[str]:
    """The hashes of all prefixes of a conversation's turns, shortest first: each of the one before and the turn."""
    out, before = [], ""
    for role, text in zip(roles, texts, strict=True):
        role, text = role or "", text or ""
        # the length keeps (role, text) pairs with equal concatenations apart
        before = hashlib.md5(f"{before}{len(role)}:{role}:{text}".encode("utf-8", "surrogatepass")).hexdigest()
        out.append(before)
    return out


def hashed(gathered: DataFrame) -> DataFrame:
    """Adds hashes to rows with turns; linear in the turns of a conversation, which an expression that appends to an array isn't."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column("turns")
            flat, ends = turns.flatten(), turns.offsets.to_pylist()
            roles, texts = flat.field("role").to_pylist(), flat.field("text").to_pylist()
            first = ends[0] if ends else 0
            hashes = [rolling(roles[a - first : b - first], texts[a - first : b - first]) for a, b in zip(ends, ends[1:], strict=False)]
            yield batch.append_column("hashes", pa.array(hashes, pa.list_(pa.string())))

    return arrow_map(gathered, run, StructType([*gathered.schema.fields, StructField("hashes", ArrayType(StringType()))]))


def gathered(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> conv_id, turns, hashes. Each conversation is one row, as it is when rendered.

    A row of a null conv_id belongs to no other: it is a conversation of one turn, and such rows are never brought together.
    """
    turn = F.struct("turn", "role", "text")
    known = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    alone = conversations.where("conv_id is null").select("conv_id", F.array(turn).alias("turns"))
    return hashed(known.unionByName(alone))


def maximal(conversations: DataFrame) -> DataFrame:
    """The conversations that are no prefix of another: conv_id (the smallest of equal ones, null if none has one), turns, n_copies, n_turns, chat_hash."""
    # three branches read this: gathered once, it is not made again for each
    held = written(gathered(conversations), "chat-turns")
    held = held.select("conv_id", "turns", "hashes", F.size("turns").cast("long").alias("n_turns"), F.try_element_at("hashes", F.lit(-1)).alias("chat_hash"))
    kept = held.groupBy("chat_hash", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = held.select(F.posexplode(F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - 1, F.lit(0)))).alias("_at", "_hash")).select((F.col("_at") + 1).cast("long").alias("_n"), "_hash").distinct()
    kept = kept.join(proper, (kept["chat_hash"] == proper["_hash"]) & (kept["n_turns"] == proper["_n"]), "left_anti")
    keys = kept.where("conv_id is not null").select("conv_id", "n_copies")
    named = held.where("conv_id is not null").drop("hashes").join(keys, "conv_id").select("conv_id", "turns", "n_turns", "chat_hash", "n_copies")
    # of equal rows without an id one stays, found with map-side combining
    nameless = kept.where("conv_id is null").select(F.col("chat_hash").alias("_hash"), "n_copies")
    one = held.where("conv_id is null").groupBy("chat_hash").agg(F.min("turns").alias("turns"))
    alone = one.join(nameless, one["chat_hash"] == nameless["_hash"]).select(F.lit(None).cast(held.schema["conv_id"].dataType).alias("conv_id"), "turns", F.lit(1).cast("long").alias("n_turns"), "chat_hash", "n_copies")
    return named.unionByName(alone)


def rendered(turns: Column, start: str = START, end: str = END) -> Column:
    each = F.transform(turns, lambda t: F.concat(F.lit(start), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(end + "\n")))
    return F.array_join(each, "")


def chats(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> conv_id, n_turns, n_copies, chat_hash, rendered for each maximal conversation.

    Turns are ordered by turn, then role and text, nulls first; null roles and texts count as empty ones. A row of a
    null conv_id is a conversation of its own, of one turn. A repeated row is a repeated turn. An empty table gives no rows; other
    columns are not read.
    """
    return maximal(conversations).select("conv_id", "n_turns", "n_copies", "chat_hash", rendered(F.col("turns")).alias("rendered"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH numbered AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
), turns AS (
  SELECT conv_id, coalesce(alone, 0) AS alone, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts
  FROM numbered GROUP BY ALL
), prefixes AS (
  SELECT conv_id, alone, len(ts) AS n_turns, unnest(range(1, len(ts) + 1)) AS n, ts FROM turns
), hashed AS (
  SELECT conv_id, alone, n_turns, n, list_reduce(list_prepend('', list_transform(ts[1:n], lambda t: length(t.role) || ':' || t.role || ':' || t.text)), lambda a, t: md5(a || t)) AS h FROM prefixes
), whole AS (
  SELECT h AS chat_hash, n_turns, min(conv_id) AS conv_id, CASE WHEN min(conv_id) IS NULL THEN min(alone) ELSE 0 END AS alone, count(*) AS n_copies FROM hashed WHERE n = n_turns GROUP BY ALL
)
SELECT w.conv_id, CAST(w.n_turns AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, chat_hash,
       array_to_string(list_transform(ts, lambda t: '{START}' || t.role || chr(10) || t.text || '{END}' || chr(10)), '') AS rendered
FROM whole w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.alone = t.alone
WHERE NOT EXISTS (SELECT 1 FROM hashed p WHERE p.h = w.chat_hash AND p.n = w.n_turns AND p.n < p.n_turns)
"""
