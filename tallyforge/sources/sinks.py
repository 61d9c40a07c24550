"""Outputs: entries and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVIEW = 20


def write_entries(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines, one file set per write; Spark's committer makes it whole or nothing."""
    entries.write.mode("overwrite").json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Texts of pages, in folders by document and page."""
    pages.select("doc", "page", F.col("text").alias("value")).write.mode("overwrite").partitionBy("doc", "page").text(path)


def without_timings(payload: dict) -> dict:
    """A result without its durations, for comparing two runs."""
    return {k: without_timings(v) if isinstance(v, dict) else [without_timings(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in payload.items() if not k.endswith("duration_ms")}


def report(entries: DataFrame, audit: dict, period: str) -> str:
    """A short Markdown report: the audit, the first rows, and the review queue by reason."""
    rows = entries.orderBy("date", "source_rows", "amount", "ord").limit(PREVIEW).collect()
    queue = entries.where("status <> 'LANCAR'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("_first")).orderBy(F.desc("n"), "_first").collect()
    lines = [f"# Entries of {period}", "", *(f"- {k}: {json.dumps(v, ensure_ascii=False)}" for k, v in sorted(audit.items())), "", "| date | debit | credit | amount | status | confidence |", "|---|---|---|---:|---|---|"]
    lines += [f"| {r.date} | {r.debit_account or ''} | {r.credit_account or ''} | {r.amount} | {r.status} | {r.confidence} |" for r in rows]
    return "\n".join([*lines, "", "## Review", "", *(f"- {r.reason}: {r.n}" for r in queue)]) + "\n"
