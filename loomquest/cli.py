"""Command line: python -m loomquest.cli "a topic" [options]."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from loomquest.functions import goals
from loomquest.models import clients
from loomquest.plans import campaign, census, report
from loomquest.plans.engine import Engine
from loomquest.sources import backends as B
from loomquest.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomquest", description="Research campaigns over keyless search, on Spark.")
    p.add_argument("seed", nargs="*", help="topic to expand, or literal queries with --raw")
    p.add_argument("--file", help="queries from a file, one a line")
    p.add_argument("--raw", action="store_true", help="take the arguments as queries")
    p.add_argument("--slug")
    p.add_argument("--goal")
    p.add_argument("--queries", type=int, default=24)
    p.add_argument("--per-backend", type=int, default=6)
    p.add_argument("--workers", type=int, default=6, help="hosts asked at a time")
    p.add_argument("--backends", default="web", help="web, academic, tech, all, or a list of: " + ",".join(B.BACKENDS))
    for flag in ("extract", "synth", "deepread", "discover"):
        p.add_argument(f"--no-{flag}", action="store_true")
    p.add_argument("--waves", action="store_true", help="ask queries in waves, not as a stream")
    p.add_argument("--scope", choices=["auto", *goals.SCOPES], default="auto")
    p.add_argument("--out", default="out")
    p.add_argument("--dry-run", action="store_true", help="show the queries and stop")
    return p


def inputs(args, client) -> tuple[list[str], str, str]:
    """queries, goal and slug of a call."""
    if args.file:
        queries = [ln.strip() for ln in Path(args.file).read_text(encoding="utf-8").splitlines() if ln.strip() and not ln.startswith("#")]
        return queries, args.goal or (queries[0] if queries else ""), args.slug or goals.slug(Path(args.file).stem)
    if args.raw:
        return args.seed, args.goal or " / ".join(args.seed[:2]), args.slug or goals.slug(args.seed[0] if args.seed else "raw")
    seed = " ".join(args.seed).strip()
    if not seed:
        raise SystemExit("give a topic, or use --file or --raw")
    from loomquest.models import tasks

    return goals.facet_queries(seed, args.queries, tasks.expanded(client, seed, args.queries)), args.goal or seed, args.slug or goals.slug(seed)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    client = clients.client()
    queries, goal, slug = inputs(args, client)
    scope = goals.scope(goal, None if args.scope == "auto" else args.scope)
    counting = scope != "quick" and goals.suits_census(goal)
    print(f"== {slug} ==\nEngine:   {client.label}")
    if counting:
        print(f"Mode:     census (scope={scope})   Entity: {goals.entity(goal)}")
    else:
        print("\n".join(f"  {i:>2}. {q}" for i, q in enumerate(queries, 1)))
    if args.dry_run:
        return
    from pyspark.sql import SparkSession

    folder = files.output_dir(os.path.abspath(args.out))
    say = lambda text: print(f"   {text}", file=sys.stderr, flush=True)
    engine = Engine(SparkSession.builder.appName("loomquest").getOrCreate(), folder, client=client, model=clients.setting("EXTRACT_MODEL") or None, cache_path=f"{folder}/cache", workers=args.workers, say=say)
    names = B.resolve([b.strip() for b in args.backends.split(",") if b.strip()])
    report.paths(folder, slug)["done"].unlink(missing_ok=True)
    try:
        if counting:
            corpus = census.run(engine, goal, slug, scope, names)
        else:
            corpus = campaign.run(engine, goal, slug, queries, goal, names, args.queries, args.per_backend, not args.no_extract, not args.no_synth, not args.no_deepread, not args.no_discover, not args.waves)
    except BaseException as e:
        report.mark_done(folder, slug, e)
        raise
    report.mark_done(folder, slug)
    print(report.spoken(corpus, corpus["top"]))


if __name__ == "__main__":
    main()
