"""Command line: search a folder of tables, or answer requests line by line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .docinfo import months
from .docinfo.analyze import Analyst
from .operators import index
from .plans import settings, wire
from .sources import formats, tables


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="siftstone", description="Search files by name and content.")
    p.add_argument("--tables", default=".", help="folder with documents.parquet")
    p.add_argument("--config", help="settings file")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("name", "content", "both", "list", "largest"):
        q = sub.add_parser(verb)
        if verb not in ("list", "largest"):
            q.add_argument("words", nargs="+")
        q.add_argument("-n", "--limit", type=int, default=50)
        q.add_argument("--offset", type=int, default=0)
        q.add_argument("--under")
        q.add_argument("-e", "--ext", action="append")
        q.add_argument("--mime", action="append")
        q.add_argument("--kind", choices=["file", "folder"])
    for verb in ("count", "status", "capabilities", "serve"):
        sub.add_parser(verb)
    i = sub.add_parser("info", help="what a file's text says: kind, date, owner, title, sentences, a name")
    i.add_argument("file")
    i.add_argument("--name", action="store_true", help="only the suggested name")
    c = sub.add_parser("config")
    c.add_argument("action", choices=["show", "preset"])
    c.add_argument("preset", nargs="?")
    return p.parse_args(argv)


def query_line(a: argparse.Namespace) -> str:
    """The request that a search verb stands for."""
    filter_ = {"under": a.under, "ext": a.ext, "mime": a.mime, "kind": a.kind}
    return json.dumps({"cmd": "query", "q": " ".join(getattr(a, "words", [])), "mode": a.verb, "filter": filter_, "page": {"offset": a.offset, "limit": a.limit}})


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout, lines=sys.stdin) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    text = None
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            text = f.read()
    said = settings.read(text)
    if a.verb == "config":
        if a.action == "preset":
            said = settings.with_preset(said, a.preset or "balanced")
        print(settings.write(said), end="", file=out)
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    if a.verb == "info":
        with open(a.file, "rb") as f:
            ext = a.file.rsplit(".", 1)[-1].lower() if "." in a.file.rsplit("/", 1)[-1][1:] else ""
            text, declared = formats.describe(f.read(), ext)
        got = Analyst(months.by_name(spark)).analyze(text, ext, declared)
        print(got["suggested_name"] if a.name else json.dumps(got, ensure_ascii=False), file=out)
        return 0
    files = tables.files(spark, a.tables, True)
    service = wire.Service(index.of(files, tables.read(spark, a.tables, "documents")), said)
    if a.verb == "serve":
        for line in lines:
            print(wire.reply(service, line), file=out, flush=True)
    elif a.verb == "count":
        print(wire.count(service), file=out)
    elif a.verb in ("status", "capabilities"):
        got = json.loads(wire.reply(service, '{"cmd": "status"}'))
        print(json.dumps(got if a.verb == "status" else got["capabilities"]), file=out)
    else:
        got = json.loads(wire.reply(service, query_line(a)))
        for hit in got.get("hits", []):
            print(hit["path"], file=out)
        return 0 if got["ok"] else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
