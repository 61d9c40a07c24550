"""Quality rules as a short-circuit cascade.

Each rule is a predicate over a text's view. A sample estimates every rule's cost and the share it rejects;
the rules then run in decreasing order of rejection per cost, and a document stops at the first that
rejects it. The order changes what is spent, never what is kept: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import hashlib
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_map, table, texts_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED = 50
#: Rows the order of the rules is estimated on; it never decides what is kept.
SAMPLE_ROWS = 2_000


class View:
    """A text's features, each computed when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode())

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.split()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that occur twice or more."""
        w = self.words
        if len(w) < 4:
            return 0
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        count = Counter(windows)
        many = np.fromiter((count[x] > 1 for x in windows), bool, len(windows))
        covered = np.zeros(len(w), bool)
        for i in range(3):
            covered[i : i + len(windows)] |= many
        return int(covered.sum())

    @cached_property
    def n_upper(self) -> int:
        """Words with letters, none of them lower-case; bytes beyond ASCII count as neither."""
        return sum(map(bytes.isupper, self.words))

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))


Rule = Callable[[View], bool]

#: Each says whether a text is rejected. Only whole numbers are compared.
BASE: dict[str, Rule] = {
    "few_words": lambda v: v.n_words < MIN_WORDS,
    "repeated_words": lambda v: 100 * v.n_repeat_words > MOST_REPEATED * v.n_words,
}
RULES: dict[str, Rule] = {
    "symbols": lambda v: 10 * v.n_symbols > 3 * v.n_words,
    "upper_case": lambda v: 2 * v.n_upper > v.n_words,
    "duplicate_lines": lambda v: v.n_dup_lines > 3 and 5 * v.n_dup_lines > 2 * len(v.lines),
    "word_length": lambda v: v.word_chars < 2 * v.n_words or v.word_chars > 20 * v.n_words,
    "few_distinct": lambda v: 100 * v.n_distinct < 3 * v.n_words,
}


def ranked(costs: dict[str, float], rejected: dict[str, float]) -> list[str]:
    """Rules by rejections per cost; ties, as among rules that reject nothing, by cost and name."""
    return sorted(costs, key=lambda r: (-rejected[r] / max(costs[r], 1e-9), costs[r], r))


#: Files the sample is read from, where the documents are files.
SAMPLE_FILES = 16


def sampled(docs: DataFrame, sample_rows: int) -> DataFrame:
    """About so many texts. Of documents that are files some files are read, chosen by a hash of their names; of others a share of all rows."""
    files = sorted(docs.inputFiles(), key=lambda f: hashlib.sha256(f.encode()).digest())
    rows = docs.count()
    share = min(1.0, sample_rows / max(1, rows))
    if len(files) > SAMPLE_FILES:
        try:
            # the reader prunes files by this column; the share grows by the files that are not read
            few = docs.where(F.col("_metadata.file_path").isin(files[:SAMPLE_FILES]))
            return few.select("text").sample(min(1.0, share * len(files) / SAMPLE_FILES), seed=7)
        except AnalysisException:  # not read from files directly
            pass
    return docs.select("text").sample(share, seed=7)


def estimated_order(docs: DataFrame, rules: dict[str, Rule], sample_rows: int = SAMPLE_ROWS, before: dict[str, Rule] | None = None, known: tuple[str, ...] = ()) -> list[str]:
    """Measures each rule's seconds and rejections on a sample, on the executors; the sums come back, not the rows.

    Only texts that pass the rules ``before`` count, as only they reach these. What a rule costs is what it adds: the features in
    ``known``, which a text's row has anyway, are there already, and each rule is timed on a view that holds these alone.
    """
    sample = sampled(docs, sample_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, rejected = dict.fromkeys(rules, 0), dict.fromkeys(rules, 0)
        for batch in batches:
            for text in texts_of(batch):
                v = View(text)
                if any(rule(v) for rule in (before or {}).values()):
                    continue
                held = {name: getattr(v, name) for name in known}
                for name, rule in rules.items():
                    alone = View(text)
                    alone.__dict__.update(held)
                    began = time.perf_counter_ns()
                    found = rule(alone)
                    cost[name] += time.perf_counter_ns() - began
                    rejected[name] += found
        yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(list(cost.values()), pa.int64()), pa.array(list(rejected.values()), pa.int64())], names=["rule", "cost", "rejected"])

    sums = arrow_map(sample, run, "rule string, cost long, rejected long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()
    found = {r.rule: r for r in sums}
    return ranked({r: float(found[r].cost) if r in found else 0.0 for r in rules}, {r: float(found[r].rejected) if r in found else 0.0 for r in rules})


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def cascade(docs: DataFrame, rules: dict[str, Rule] | None = None, order: list[str] | None = None) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, rejected_by: the rule that stopped each, null for those kept.

    ``rejected_by`` may depend on the order, whether it is null does not. Null and empty texts are texts without words, repeated
    rows are judged alike unless two rules reject them, a null doc_id stays null, texts are read whole, an empty table gives no rows.
    """
    rules = rules or BASE | RULES
    order = order or estimated_order(docs, rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [next((name for v in [View(t)] for name in order if rules[name](v)), None) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "rejected_by"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, rejected_by string")


def quality(docs: DataFrame, rules: dict[str, Rule] | None = None, order: list[str] | None = None) -> DataFrame:
    """Documents (doc_id, text) -> the base counts of each whole text, base_failed, and kept: what the cascade says of the rest.

    Null and empty texts have no words, so base_failed. Repeated rows are judged alike; a null doc_id stays
    null; very long texts are counted whole; an empty table gives no rows; other columns are not read.
    """
    rules = RULES if rules is None else rules
    order = order or estimated_order(docs, rules, before=BASE, known=("words", "n_words", "word_chars", "n_symbols", "lines", "n_dup_lines", "n_repeat_words"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in texts_of(batch):
                v = View(text)
                counts = (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words)
                failed = any(rule(v) for rule in BASE.values())
                kept = not failed and not any(rules[name](v) for name in order)
                out.append((*counts, failed, kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(list_distinct(ws)) AS n_distinct,
         len(list_filter(ws, lambda w: regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) AS n_upper
  FROM words
), judged AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM counted LEFT JOIN repeated USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_upper > n_words OR (n_dup_lines > 3 AND 5 * n_dup_lines > 2 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_distinct < 3 * n_words) AS kept
FROM judged
"""
