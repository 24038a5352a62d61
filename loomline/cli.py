"""Command line: analyze, derive-insights, brief and ask."""

from __future__ import annotations

import argparse
import importlib
import json
from dataclasses import replace
from datetime import datetime, timezone

from loomline.plans import analyze, api, brief
from loomline.session import local_session
from loomline.sources.config import load_config
from loomline.sources.providers import embedder_of
from loomline.sources.store import Store


def models_of(name: str | None) -> analyze.Models:
    """The models named as module:attribute. Without a provider nothing is analyzed or derived."""
    if not name or ":" not in name:
        raise SystemExit("--models module:attribute is needed: an object of loomline.plans.analyze.Models")
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomline")
    parser.add_argument("--store", required=True)
    parser.add_argument("--models", help="module:attribute with the models to use")
    parser.add_argument("--root", help="the session files, for questions on them")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("transcripts")
    for name in ("--label", "--project", "--session", "--briefs", "--date", "--spot-checks"):
        a.add_argument(name)
    a.add_argument("--force", action="store_true")
    a.add_argument("--dry-run", action="store_true")
    d = sub.add_parser("derive-insights")
    for name in ("project", "session", "label"):
        d.add_argument(name)
    b = sub.add_parser("brief")
    b.add_argument("date")
    b.add_argument("folder")
    q = sub.add_parser("ask")
    q.add_argument("endpoint", choices=sorted(api.ENDPOINTS))
    q.add_argument("params", nargs="*", help="name=value")
    args = parser.parse_args(argv)
    store, now = Store(local_session(), args.store), datetime.now(timezone.utc)
    if args.command == "analyze":
        use = None if args.dry_run else models_of(args.models)
        config = load_config()
        if use is not None and use.embedder is None:
            use = replace(use, embedder=embedder_of(config))
        done = analyze.analyze(store, args.transcripts, now, config, use, args.label, args.force, args.project, args.session, args.dry_run, args.spot_checks)
        print(json.dumps(done.__dict__))
        if args.briefs and not args.dry_run:
            for day in [args.date] if args.date else sorted({now.date().isoformat(), *done.dates}):
                print(brief.write_brief(store.tables(), day, args.briefs))
    elif args.command == "derive-insights":
        print(analyze.derive_run(store, args.project, args.session, args.label, models_of(args.models).deriver, now))
    elif args.command == "brief":
        print(brief.write_brief(store.tables(), args.date, args.folder))
    else:
        if args.endpoint in api.OF_FILES and not args.root:
            parser.error(f"{args.endpoint} needs --root")
        tables = {**store.tables(), **(api.file_tables(store.spark, args.root) if args.root else {})}
        for row in api.ask(args.endpoint, tables, dict(p.split("=", 1) for p in args.params), now.date().isoformat()).toJSON().toLocalIterator():
            print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
