"""Command line: build, search, aggregate, fuzzy, passage, stats, connections and glossary over a stored corpus; JSON lines on stdout."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .corpus import Corpus
from .plans.query import QueryError


def folder(text: str) -> tuple[str, str]:
    category, _, path = text.partition("=")
    if not path:
        raise argparse.ArgumentTypeError("expected CATEGORY=FOLDER")
    return category, path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill")
    p.add_argument("corpus", help="folder of the stored corpus")
    commands = p.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", aliases=["index"])
    build.add_argument("--html", type=folder, action="append", default=[])
    build.add_argument("--markdown", type=folder, action="append", default=[])
    build.add_argument("--graph", help="folder of claims.json and relationships/result.json")
    for name, many in (("search", False), ("aggregate", True), ("fuzzy", False)):
        c = commands.add_parser(name, aliases=["search-many"] if many else [])
        c.add_argument("query", nargs="+" if many else None)
        c.add_argument("--source", default="default")
        c.add_argument("--limit", type=int, default=10)
        if name == "search":
            c.add_argument("--context", type=int, default=220)
            c.add_argument("--book")
            c.add_argument("--title")
        else:
            c.add_argument("--per-query-limit", type=int, default=10)
            c.add_argument("--max-per-document", type=int, default=1)
        if name == "fuzzy":
            c.add_argument("--per-token-limit", type=int, default=3)
            c.add_argument("--max-distance", type=int)
    c = commands.add_parser("passage")
    c.add_argument("citation")
    c.add_argument("--context-passages", type=int, default=4)
    commands.add_parser("stats")
    commands.add_parser("graph-stats")
    c = commands.add_parser("connections")
    c.add_argument("--query")
    c.add_argument("--claim-id")
    c.add_argument("--source", default="all")
    c.add_argument("--limit", type=int, default=10)
    for name in ("glossary-lookup", "glossary-search"):
        c = commands.add_parser(name)
        c.add_argument("file")
        c.add_argument("term")
        c.add_argument("--limit", type=int, default=10)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    corpus = Corpus(spark or SparkSession.builder.appName("lexmill").getOrCreate(), a.corpus)
    try:
        if a.command in ("build", "index"):
            out = corpus.build(dict(a.html), dict(a.markdown), a.graph)
        elif a.command == "search":
            out = corpus.search(a.query, where=a.source, limit=a.limit, context=a.context, book=a.book, title=a.title)
        elif a.command in ("aggregate", "search-many"):
            out = corpus.aggregate(a.query, where=a.source, limit=a.limit, per_query_limit=a.per_query_limit, max_per_document=a.max_per_document)
        elif a.command == "fuzzy":
            out = corpus.fuzzy(a.query, a.source, a.per_token_limit, a.max_distance, limit=a.limit, per_query_limit=a.per_query_limit, max_per_document=a.max_per_document)
        elif a.command == "passage":
            out = corpus.passage(a.citation, a.context_passages)
        elif a.command == "stats":
            out = corpus.stats()
        elif a.command == "graph-stats":
            out = corpus.graph_stats()
        elif a.command == "connections":
            out = corpus.connections(a.query, a.source, a.claim_id, a.limit)
        else:
            out = (corpus.glossary_lookup if a.command == "glossary-lookup" else corpus.glossary_search)(a.file, a.term, a.limit)
        for line in out.toJSON().toLocalIterator():
            print(line)
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
