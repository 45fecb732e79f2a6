"""Command line: ``python -m filigree STAGE|TOOL [options]``."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import replace

from filigree.plans.manifest import STAGES, Manifest, StageError
from filigree.settings import Settings

TOOLS = ("find_word", "word_senses", "word_edges", "edge_info", "semantic_search", "graph_stats", "holdout", "recall")
USAGE = f"""usage: python -m filigree COMMAND --root FOLDER [options]

stages: build (all that are not done), {", ".join(STAGES)}
checks: preflight
tools:  {", ".join(TOOLS)}
"""


def _options(command: str, rest: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog=f"filigree {command}")
    p.add_argument("--root", required=True, help="folder of the graph's tables, reached by all executors")
    if command in TOOLS:
        if command in ("find_word", "word_senses", "word_edges", "semantic_search"):
            p.add_argument("query")
        if command == "edge_info":
            p.add_argument("query", type=int)
        p.add_argument("--pos")
        p.add_argument("--doc-type", default="baryedge")
        p.add_argument("--top-k", type=int, default=10)
        p.add_argument("--fraction", type=float, default=0.1)
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--recall-k", type=int, default=20)
        p.add_argument("--max-pairs", type=int)
        p.add_argument("--pairs", help="JSON lines that holdout wrote, or will write")
    else:
        p.add_argument("--source", help="JSON lines of records")
        p.add_argument("--state", help="local folder of the stages' states")
        p.add_argument("--limit", type=int)
        p.add_argument("--batch-size", type=int)
        for flag in ("--reset", "--force", "--dry-run", "--resume"):
            p.add_argument(flag, action="store_true")
    return p.parse_args(rest)


def _answer(g, command: str, o: argparse.Namespace):
    from filigree.plans import tools

    if command == "word_edges":
        return tools.word_edges(g, o.query, o.pos)
    if command == "semantic_search":
        return tools.semantic_search(g, o.query, o.doc_type, o.top_k)
    if command == "holdout":
        return tools.holdout(g, o.fraction, o.seed)
    if command == "recall":
        if not o.pairs:
            raise StageError("recall needs --pairs")
        pairs = g.spark.read.schema("word_a string, gloss_a string, word_b string").json(o.pairs)
        pairs = pairs if o.max_pairs is None else pairs.orderBy("word_a", "word_b").limit(o.max_pairs)
        return tools.recall(g, pairs, o.recall_k)
    if command == "graph_stats":
        return tools.graph_stats(g)
    return getattr(tools, command)(g, o.query)


def main(argv: list[str] | None = None) -> int:
    """Exit status: 0 done or help asked, 1 nothing asked or a stage may not run, 2 unknown command."""
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] in ("-h", "--help", "help"):
        print(USAGE)
        return 0 if argv else 1
    command, rest = argv[0], argv[1:]
    if command not in (*STAGES, *TOOLS, "build", "preflight"):
        print(f"unknown command {command!r}\n{USAGE}", file=sys.stderr)
        return 2
    o = _options(command, rest)

    from pyspark.sql import SparkSession

    from filigree.plans import build, tools

    spark = SparkSession.builder.appName("filigree").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = Settings.load()
    logging.basicConfig(level=getattr(logging, settings.log_level.upper(), logging.INFO), format="%(asctime)s %(levelname)s [%(name)s] %(message)s", stream=sys.stderr)
    if getattr(o, "batch_size", None):
        settings = replace(settings, embed_batch_size=o.batch_size)
    g = build.Graph(spark, o.root, settings, source=getattr(o, "source", None), limit=getattr(o, "limit", None), resume=getattr(o, "resume", False))
    try:
        if command in TOOLS:
            answer = tools.as_json(_answer(g, command, o))
            if command == "holdout" and o.pairs:
                answer.write.mode("overwrite").text(o.pairs)
            else:
                for row in answer.toLocalIterator():
                    print(row["json"])
            return 0
        manifest = Manifest(o.state or f"{o.root}/_state")
        if command == "preflight":
            from filigree.plans.preflight import preflight

            report = preflight(g, manifest)
            for name, passed, detail in report:
                print(f"{'ok' if passed else 'FAILED'}\t{name}\t{detail}")
            return 0 if all(passed for _, passed, _ in report) else 1
        if command == "build":
            if o.reset:
                manifest.reset(STAGES[0])
            done = build.build(g, manifest)
        else:
            done = {command: build.run_stage(g, manifest, command, reset=o.reset, force=o.force, dry_run=o.dry_run)}
        for stage, n in done.items():
            print(f"{stage}\t{n}")
        return 0
    except StageError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
