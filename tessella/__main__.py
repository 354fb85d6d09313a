"""Command line: python -m tessella [--root R] [--collection C] [--config FILE] ingest|ask|documents|delete|serve|eval ..."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession

from tessella.config import Pipeline, Settings


def parser(settings: Settings) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", description="Questions over document collections.")
    p.add_argument("--root", default=settings.data_dir, help="folder of the collections, shared by all executors")
    p.add_argument("--collection", default=settings.collection)
    p.add_argument("--config", default=settings.pipeline_config, help="pipeline settings (YAML)")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest", help="documents of a file or folder")
    c.add_argument("path")
    c.add_argument("--force", action="store_true", help="take unchanged documents too")
    c = sub.add_parser("ask", help="one question")
    c.add_argument("question")
    c.add_argument("--k", type=int)
    c.add_argument("--json", action="store_true")
    sub.add_parser("documents", help="the collection's documents")
    c = sub.add_parser("delete", help="a document")
    c.add_argument("doc_id")
    c = sub.add_parser("serve", help="HTTP service")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8000)
    c = sub.add_parser("eval", help="evaluation: validate, run, gate")
    c.add_argument("what", choices=["validate", "run", "gate"])
    c.add_argument("--documents", required=True, help="folder of documents")
    c.add_argument("--gold", required=True, help="gold questions (JSON lines)")
    c.add_argument("--spec", help="grid (YAML)")
    c.add_argument("--thresholds", help="JSON object of metric to threshold")
    c.add_argument("--out", default="results")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=print) -> int:
    settings = Settings.read()
    args = parser(settings).parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else settings.log_level)
    from tessella import experiments as X
    from tessella.engine import Engine
    from tessella.sources import documents as sources

    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    engine = Engine(spark, args.root, args.collection, Pipeline.load(args.config) if args.config else Pipeline())
    if args.command == "ingest":
        out(json.dumps(engine.ingest_path(args.path, args.force)))
    elif args.command == "ask":
        made = engine.ask(args.question, args.k)
        out(json.dumps(made, ensure_ascii=False) if args.json else made["answer"] + "".join(f"\n  {s['location'] or s['chunk_id']}" for s in made["sources"]))
    elif args.command == "documents":
        for r in engine.list_documents().toLocalIterator():
            out(f"{r.doc_id}\t{r.title}\t{r.chunks}")
    elif args.command == "delete":
        gone = engine.delete_document(args.doc_id)
        out("deleted" if gone else "no such document")
        return 0 if gone else 1
    elif args.command == "serve":
        from tessella import service

        service.serve(engine, args.host, args.port, settings)
    else:
        documents, gold = sources.load_path(spark, args.documents), X.load_gold(spark, args.gold)
        if args.what == "validate":
            problems = X.validated(gold, documents).collect()
            for p in problems:
                out(f"{p.level}: {p.query_id}: {p.problem}")
            for r in X.counts(gold).orderBy("split", "category").collect():
                out(f"{r.split}\t{r.category}\t{r.questions}")
            return int(any(p.level == "error" for p in problems))
        spec = X.Spec.load(args.spec) if args.spec else X.Spec("baseline")
        if args.what == "run":
            X.save(X.run(spec, spark, args.root, documents, gold, say=out), args.out)
        else:
            rows = X.gate(spec, json.loads(args.thresholds or "{}"), spark, args.root, documents, gold).collect()
            for r in rows:
                out(f"{'ok  ' if r.passed else 'FAIL'} {r.metric}: {r.value} ({r.threshold})")
            return int(not all(r.passed for r in rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
