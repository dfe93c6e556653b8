"""Command line: ``python -m quillspark transform|chunk|index|compile|document|coverage|epub|docx PROJECT INPUT OUTPUT``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.engine import Engine
from quillspark.operators import documents, sites
from quillspark.plans.rules import CHANNELS
from quillspark.sources.markup import write_json_lines

#: Entries of a report that are shown, and errors, unless all are asked for.
SHOWN, ERRORS = 20, 10


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark")
    parser.add_argument("command", choices=["transform", "chunk", "index", "compile", "document", "coverage", "epub", "docx"])
    parser.add_argument("project")
    parser.add_argument("input", nargs="?", default="./data")
    parser.add_argument("output", nargs="?", default="./out")
    parser.add_argument("--channel", default="web", choices=sorted(CHANNELS))
    parser.add_argument("--rules", help="rule document to use instead of the project's")
    parser.add_argument("--recursive", action="store_true")
    parser.add_argument("--strict", action="store_true", help="fail if a predicate can't be evaluated or a document is malformed")
    parser.add_argument("--all", action="store_true", help="show all entries of a report")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    engine = Engine.load(spark, args.project, args.rules)
    if args.command == "compile":
        engine.check() if args.strict else None
        write_json_lines(engine.rules.channel(args.channel).table(spark, engine.config.setup.variables), args.output)
        return 0
    try:
        docs = engine.read(args.input, args.recursive)
    except ValueError as why:
        parser.error(str(why))
    if args.command != "coverage":
        wrong = engine.errors(docs).orderBy("where").limit(ERRORS + 1).collect()
        for e in wrong[: None if args.all else ERRORS]:
            print(f"{e['where']}: {e['message']}")
        if wrong and args.strict:
            return 1
    if args.command == "transform" and args.channel.startswith("json"):
        documents.record_trees(docs, engine.rules, args.channel.removeprefix("json-") if "-" in args.channel else "web", engine.config.setup).write.mode("overwrite").parquet(args.output)
    elif args.command == "transform":
        engine.page(docs, channel=args.channel).write.mode("overwrite").parquet(args.output)
    elif args.command == "index":
        write_json_lines(engine.passages(docs), args.output)
    elif args.command == "chunk":
        engine.site(docs, args.output, args.channel).show(SHOWN, truncate=False)
    elif args.command in ("epub", "docx"):
        made = engine.epub(docs) if args.command == "epub" else engine.docx(docs)
        sites.write_files(made.select(F.concat(F.regexp_replace("doc_id", r"[/\\]", "-"), F.lit(f".{args.command}")).alias("path"), F.col(args.command).alias("content")), args.output)
    elif args.command == "document":
        write_json_lines(engine.rules.table(spark, engine.config.setup.variables).orderBy("element", "ordinal"), args.output)
    else:
        for name, table in engine.coverage(docs, args.channel).items():
            write_json_lines(table, f"{args.output}/{name}")
            if name in ("unmatched", "dropped", "unused", "errors"):
                print(name)
                table.orderBy(F.desc("n"), "key").show(1000 if args.all else SHOWN, truncate=False) if "n" in table.columns else table.show(1000 if args.all else SHOWN, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
