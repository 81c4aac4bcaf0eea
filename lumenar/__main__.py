"""Command line: run, extract, evaluate a configured dataset; validate, list or query one."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lumenar import engine
from lumenar.sources import datasets


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenar", description="Query text collections as tables.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "extract", "evaluate"):
        c = sub.add_parser(name)
        c.add_argument("config")
        c.add_argument("--query", action="append", default=[], help="a query id; may be repeated")
    for name in ("validate", "queries"):
        sub.add_parser(name).add_argument("root")
    sql = sub.add_parser("sql")
    sql.add_argument("root")
    sql.add_argument("text")
    return p


def main(arguments: list[str] | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("lumenar").getOrCreate()
    if args.command in ("run", "extract", "evaluate"):
        config = engine.load_config(args.config)
        if args.command != "run":
            config.stages = [args.command]
        config.query_ids = args.query or config.query_ids
        for report in engine.run(spark, config):
            print(json.dumps(report), file=out)
        return 0
    data = datasets.from_manifest(spark, args.root)
    if args.command == "queries":
        for q in data.queries:
            print(json.dumps(q), file=out)
        return 0
    if args.command == "sql":
        records = datasets.records_of(data.ground_truth)
        rows = engine.answers.answer(records, args.text, engine.columns_by_table(data.schema))
        print("\n".join(rows.toJSON().take(1000)), file=out)
        return 0
    errors = datasets.contract_errors(data.documents, data.ground_truth, data.schema, data.queries).orderBy("error", "subject")
    found = errors.limit(1000).collect()
    for r in found:
        print(f"{r['error']}: {r['subject']}", file=out)
    return 1 if found else 0


if __name__ == "__main__":
    sys.exit(main())
