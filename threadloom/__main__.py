"""Command line: ``python -m threadloom sync | index | search | recent | doctor | config``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from threadloom.config import Config, env_text, load
from threadloom.operators.sessions import enclosing_repo
from threadloom.operators.store import Store
from threadloom.plans import admin
from threadloom.plans.query import iso, parse_query
from threadloom.plans.search import Context, follow_index, recent, search, stored_corpus
from threadloom.plans.sync import run_sync
from threadloom.schemas import PROVIDERS
from threadloom.sources.embedding_services import ready_embedder


def expand_home(path: str) -> str:
    return os.path.expanduser(path) if path.startswith("~") else path


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="threadloom")
    p.add_argument("--config", help="a settings file, in place of $THREADLOOM_CONFIG or ~/.config/threadloom/config.json")
    p.add_argument("--store", default=env_text("THREADLOOM_STORE") or "~/.local/share/threadloom", help="where the tables lie")
    for provider in PROVIDERS:
        p.add_argument(f"--{provider}-root", action="append", help=f"a folder of {provider} transcripts, in place of the usual ones")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("sync", "take in what changed"), ("index", "take in what changed, or all with --full")):
        c = sub.add_parser(name, help=text)
        c.add_argument("--provider", choices=PROVIDERS)
        c.add_argument("--full", action="store_true")
        c.add_argument("--json", action="store_true")
    c = sub.add_parser("search", help="find sessions")
    c.add_argument("query", nargs="*")
    c.add_argument("--prefilter", action="store_true", help="filter before candidates are taken")
    r = sub.add_parser("recent", help="the latest sessions")
    for one in (c, r):
        one.add_argument("--limit", type=int, help="how many at most")
        one.add_argument("--json", action="store_true")
    sub.add_parser("doctor", help="what the store holds")
    sub.add_parser("config", help="the settings")
    return p.parse_args(argv)


def roots_of(args: argparse.Namespace, config: Config) -> dict[str, list[str]]:
    return {p: [expand_home(r) for r in getattr(args, f"{p}_root") or config.roots[p]] for p in PROVIDERS}


def usable(config: Config):
    """The embedding client, or none and a line that says why."""
    if not config.embeddings.enabled:
        return None
    embedder, why = ready_embedder(config.embeddings, env_text("THREADLOOM_EMBEDDING_ENDPOINT"))
    if why:
        print(why, file=sys.stderr)
    return embedder


def current_repo(cwd: str) -> str | None:
    """The folder around this one that holds .git, by its name; else this one's."""
    at = cwd
    while at != os.path.dirname(at):
        if os.path.exists(os.path.join(at, ".git")):
            return os.path.basename(at)
        at = os.path.dirname(at)
    return os.path.basename(cwd) or None


def show(results: DataFrame, as_json: bool) -> None:
    rows = results.orderBy("position").collect()  # a page, bounded by its limit
    if as_json:
        print(json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2))
        return
    for r in rows:
        where = " ".join(x for x in (r["provider"], r["repo"], r["branch"], r["updated_at"]) if x)
        print(f"{r['position']}. {r['title']}\n   {where}\n   {r['snippet']}\n   {r['resume_cmd']}")


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    config = load(args.config)
    if args.command == "config":
        print(json.dumps(config.shown(), indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("threadloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, now = Store(spark, expand_home(args.store)), datetime.now(UTC)
    admin.migrate(store, iso(now))
    if args.command in ("sync", "index"):
        embedder = usable(config)

        def tell(step: str) -> None:
            print(step, file=sys.stderr)

        out = run_sync(spark, store, roots_of(args, config), iso(now), config, embedder, args.full, args.provider, enclosing_repo(os.path.exists), tell)
        tell("indexing")
        follow_index(store)
        print(json.dumps(asdict(out)) if args.json else "\n".join(f"{k}: {v}" for k, v in asdict(out).items()))
    elif args.command == "doctor":
        for r in admin.report(store, config, usable(config)).collect():
            print(f"{r['item']}: {r['value']}")
    else:
        corpus = stored_corpus(store)
        cwd = os.getcwd()
        context = Context(now, current_repo(cwd), cwd)
        limit = max(1, args.limit if args.limit is not None else config.default_limit)
        if args.command == "recent":
            show(recent(corpus, limit, context), args.json)
        else:
            parsed = parse_query(" ".join(args.query), now, config.include_subagents)
            for warning in parsed.warnings:
                print(warning, file=sys.stderr)
            vector, why = admin.query_vector(store, usable(config) if parsed.free_text else None, parsed.free_text, config.embeddings.redact_before_send)
            if why:
                print(why, file=sys.stderr)
            show(search(corpus, parsed, context, limit, vector, args.prefilter), args.json)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
