"""Command line: ``python -m tallyforge ingest|query|report|compare ...``; prints JSON, exits with 1 on failed files or differences."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession


def _session() -> SparkSession:
    return SparkSession.builder.appName("tallyforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rows(df: DataFrame, most: int) -> list[dict]:
    return [json.loads(r) for r in df.limit(most).toJSON().collect()]


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyforge", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="read a folder, print the summary and the issues, write the records")
    ingest.add_argument("path")
    ingest.add_argument("--output", help="a folder for the records of each family")
    ingest.add_argument("--issues", type=int, default=1000, help="issues to print; issues_total counts all")
    query = commands.add_parser("query", help="run a named query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("--rows", type=int, default=20, help="rows to print; --output writes all")
    query.add_argument("--output")
    compare = commands.add_parser("compare", help="compare the cash ledgers below two folders position by position")
    compare.add_argument("left")
    compare.add_argument("right")
    asked = parser.parse_args(arguments)
    spark = _session()

    if asked.command == "ingest":
        from tallyforge.plans import ingestion

        got = ingestion.ingest(spark, asked.path)
        if asked.output:
            for family in ("statements", "transactions", "daily_balances", "ledger_entries", "accounts", "history", "invoices", "issues"):
                getattr(got, family).write.mode("overwrite").parquet(f"{asked.output}/{family}")
        summary = ingestion.batch_summary(got).first().asDict()
        print(json.dumps(summary | {"issues": _rows(got.issues, asked.issues), "issues_total": got.issues.count()}, ensure_ascii=False, sort_keys=True))
        return 0 if summary["success"] else 1

    if asked.command == "query":
        from tallyforge.plans import catalogue, catalogue_forms, catalogue_models, catalogue_more  # noqa: F401

        if asked.name not in catalogue.QUERIES:
            parser.error(f"no such query; there are {', '.join(sorted(catalogue.QUERIES))}")
        out = catalogue.QUERIES[asked.name](spark, asked.folder)
        if asked.output:
            out.write.mode("overwrite").parquet(asked.output)
        print(json.dumps(_rows(out, asked.rows), ensure_ascii=False))
        return 0

    from tallyforge.operators import matching
    from tallyforge.plans import ingestion

    # each folder's ledgers count as one, in the order of their files
    sides = [ingestion.ingest(spark, p).ledger_entries for p in (asked.left, asked.right)]
    different = matching.compared(*sides, ["date", "document", "counterparty", "notes", "inflow", "outflow", "balance"], [])
    counts = matching.count_mismatch(*sides, [])
    result = {"differences": _rows(different, 1000), "counts": _rows(counts, 1)}
    print(json.dumps(result, ensure_ascii=False))
    return 1 if result["differences"] or result["counts"] else 0


if __name__ == "__main__":
    sys.exit(main())
