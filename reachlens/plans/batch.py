"""The batch jobs: verdicts and consensus out of captured files, signatures out of jump functions, and all of them out of the
messages that a stream captured.

    python -m reachlens.plans.batch merge OUT --deps FILE ... [--dlsym FILE ...] [--force FILE ...] [--class-mode]
    python -m reachlens.plans.batch signatures OUT --base FILE --jfunc FILE ...
    python -m reachlens.plans.batch restart OUT --captured TABLE [--class-mode]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlens.operators import classify, closure, consensus
from reachlens.runtime import materialize
from reachlens.schema import World
from reachlens.sources import render, text
from reachlens.streaming import ingest


def merge(spark: SparkSession, deps: list[str], dlsym: list[str] = (), force: list[str] = (), hidden_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(verdict texts, consensus texts) of captured module files, lookups and force files."""
    return merged(text.world_of(text.read_modules(spark, list(deps)), text.read_modules(spark, list(force)) if force else None, text.read_lookups(spark, list(dlsym)) if dlsym else None), hidden_only)


def merged(world: World, hidden_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(verdict texts, consensus texts) of a world."""
    found = materialize(classify.verdicts(world))
    agreed = consensus.consensus(found, consensus.source_totals(world.objects), hidden_only)
    return render.verdict_texts(found, world.modules), render.consensus_texts(agreed, world.objects)


def signatures(spark: SparkSession, base: str, jfunc: list[str]) -> DataFrame:
    return closure.signature_closure(text.read_signatures(spark, base), text.read_jumps(spark, list(jfunc)))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="reachlens")
    jobs = parser.add_subparsers(dest="job", required=True)
    a, b, c = jobs.add_parser("merge"), jobs.add_parser("signatures"), jobs.add_parser("restart")
    for p in (a, b, c):
        p.add_argument("out")
    a.add_argument("--deps", nargs="+", required=True)
    a.add_argument("--dlsym", nargs="*", default=[])
    a.add_argument("--force", nargs="*", default=[])
    for p in (a, c):
        p.add_argument("--class-mode", action="store_true")
    c.add_argument("--captured", required=True)
    b.add_argument("--base", required=True)
    b.add_argument("--jfunc", nargs="+", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("reachlens").getOrCreate()
    if args.job != "signatures":
        if args.job == "merge":
            verdicts, agreed = merge(spark, args.deps, args.dlsym, args.force, not args.class_mode)
        else:
            messages = ingest.stored(spark, args.captured)
            verdicts, agreed = merged(ingest.world(messages), not args.class_mode)
            render.signature_lines(ingest.signatures(messages)).write.text(f"{args.out}/sign")
        for texts, name, most in ((verdicts, "merged.vis", render.FILE_BLOCKS), (agreed, "merged.vis.gcc", render.FILE_SOURCES)):
            render.write_blocks(texts, f"{args.out}/{name}", most)
    else:
        render.signature_lines(signatures(spark, args.base, args.jfunc)).write.text(args.out)


if __name__ == "__main__":
    main()
