"""Golden-file regression as joins: inventory, expectations, field checks, coverage, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inventory(files: DataFrame) -> DataFrame:
    """Files (path, sha256) -> a row per content: the first path in case-folded order, all paths, how many."""
    paths = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("path").alias("k"), "path"))), lambda p: p["path"])
    held = files.groupBy("sha256").agg(paths.alias("paths"))
    return held.select("sha256", F.get("paths", F.lit(0)).alias("path"), "paths", F.size("paths").alias("copies"))


def located(manifest: DataFrame, stock: DataFrame) -> DataFrame:
    """Manifest rows with the path of their content, null where it is missing."""
    return manifest.join(stock.select("sha256", "path", "copies"), "sha256", "left")


def duplicates(stock: DataFrame) -> DataFrame:
    return stock.where("copies > 1").select("sha256", "paths")


def untracked(stock: DataFrame, manifest: DataFrame, extensions: tuple[str, ...] = ("pdf", "xml", "xlsx", "xls", "csv")) -> DataFrame:
    """Paths whose content no manifest row names."""
    known = F.lower(F.substring_index("path", ".", -1)).isin(*extensions)
    return stock.where(known).join(manifest.select("sha256").distinct(), "sha256", "left_anti").select("path").distinct()


def manifest_issues(manifest: DataFrame) -> DataFrame:
    """Ids or hashes that repeat, and hashes that are none."""
    twice = lambda c, code: manifest.groupBy(c).count().where("count > 1").select(F.lit(code).alias("issue"), F.col(c).cast("string").alias("value"))
    bad = manifest.where(~F.col("sha256").rlike("^[0-9a-f]{64}$")).select(F.lit("invalid_sha256").alias("issue"), F.col("sha256").alias("value"))
    return twice("id", "duplicate_id").unionByName(twice("sha256", "duplicate_sha256")).unionByName(bad)


def field_checks(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected (id, field, value) against found: a missing field differs from a null one."""
    have = found.select("id", "field", F.col("value").alias("found"), F.lit(True).alias("_present"))
    both = expected.select("id", "field", F.col("value").alias("expected")).join(have, ["id", "field"], "left")
    present = F.coalesce("_present", F.lit(False))
    return both.select("id", "field", "expected", "found", present.alias("present"), (present & F.col("expected").eqNullSafe(F.col("found"))).alias("matches"))


def unpivoted(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row per field of each row, values as text."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(F.col(key).alias("id"), F.inline(pairs))


def coverage(documents: DataFrame, checks: DataFrame) -> DataFrame:
    """Counts by document type, and by type and field, in one relation (field null for the type's own row)."""
    types = documents.groupBy("document_type").agg(
        F.lit(None).cast("string").alias("field"), F.count(F.lit(1)).alias("expected"), F.count_if(F.col("found_type") == F.col("document_type")).alias("found"),
        F.count_if("passed").alias("matched"), F.lit(0).cast("long").alias("missing"), F.lit(0).cast("long").alias("mismatched"),
    )
    typed = checks.join(documents.select("id", "document_type"), "id")
    fields = typed.groupBy("document_type", "field").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if("present").alias("found"), F.count_if("matches").alias("matched"), F.count_if(~F.col("present")).alias("missing"),
        F.count_if(F.col("present") & ~F.col("matches")).alias("mismatched"),
    )
    return types.unionByName(fields)


def summary(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("success")
    )


def digest(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """count, digest of the ordered rows' canonical JSON, first and last row, per key. Rows of one document are a bounded group."""
    row = F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})
    held = rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct("ord", row.alias("row")))).alias("_rows"))
    texts = F.transform("_rows", lambda r: r["row"])
    return held.select(key, "count", F.sha2(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")), 256).alias("sha256"), F.get(texts, F.lit(0)).alias("first"), F.element_at(texts, -1).alias("last"))


def cross_validated(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id) of documents that should tell the same, with the path of each."""
    a = documents.select(F.col("id").alias("left_id"), F.col("path").alias("left_path"))
    b = documents.select(F.col("id").alias("right_id"), F.col("path").alias("right_path"))
    return pairs.join(a, "left_id", "left").join(b, "right_id", "left")


def dotted(payload: Column, path: str) -> Column:
    """The value of a JSON text at a dotted path, as text."""
    return F.get_json_object(payload, "$." + path)


def expectation_checks(fixtures: DataFrame, results: DataFrame, fields: list[str]) -> DataFrame:
    """A row per fixture and expected field: expected, found, matches. A fixture without a result has found nothing.

    Fields are those both sides have under the same name; an expectation of null is one (the type of an unclassified file).
    """
    expected = unpivoted(fixtures, "id", fields).select("id", "field", F.col("value").alias("expected"))
    found = unpivoted(results, "id", fields).select("id", "field", F.col("value").alias("found"), F.lit(True).alias("_there"))
    both = expected.join(found, ["id", "field"], "left")
    return both.select("id", "field", "expected", "found", (F.coalesce("_there", F.lit(False)) & F.col("expected").eqNullSafe(F.col("found"))).alias("matches"))


def verdicts(checks: DataFrame) -> DataFrame:
    """id, passed, failed_fields."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("matches"), F.col("field"))))
    return checks.groupBy("id").agg(F.bool_and("matches").alias("passed"), failed.alias("failed_fields"))


def report(documents: DataFrame, fields: DataFrame) -> str:
    """Markdown of the coverage by type and by field (fields: coverage()'s rows), a row a line; one line a document that failed."""
    head = documents.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("ok")).first()
    lines = ["# Regression", "", f"- documents: {head.n}", f"- passed: {head.ok}", "", "| type | field | expected | found | matched | missing | mismatched |", "|---|---|---:|---:|---:|---:|---:|"]
    rows = fields.orderBy("document_type", F.col("field").asc_nulls_first()).collect()
    lines += [f"| {r.document_type} | {r.field or ''} | {r.expected} | {r.found} | {r.matched} | {r.missing} | {r.mismatched} |" for r in rows]
    bad = documents.where("not passed").select("id").orderBy("id").collect()
    return "\n".join([*lines, "", *(f"- failed: {r.id}" for r in bad)]) + "\n"
