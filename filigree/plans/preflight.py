"""Checks before a build: session, folders, source, embedding service and stage state."""

from __future__ import annotations

from collections.abc import Callable

from filigree.plans.build import Graph
from filigree.plans.manifest import Manifest
from filigree.sources.tables import ping


def preflight(g: Graph, manifest: Manifest) -> list[tuple[str, bool, str]]:
    """(check, passed, detail) of each check; none of them raises."""

    def session() -> str:
        if not ping(g.spark):
            raise RuntimeError("a job gave a wrong count")
        return f"Spark {g.spark.version}"

    def checkpoints() -> str:
        context = g.spark.sparkContext
        named = g.spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set on a cluster")
        return named or "a local folder"

    def folder() -> str:
        g.spark.range(1).write.mode("overwrite").parquet(f"{g.root}/_preflight")
        if g.read("_preflight").count() != 1:
            raise RuntimeError("a written row was not read back")
        return g.root

    def records() -> str:
        if g.source is None:
            raise RuntimeError("no source named")
        if g.spark.read.text(g.source).isEmpty():
            raise RuntimeError(f"{g.source} is empty")
        return g.source

    def vectors() -> str:
        found = len(g.embedder(["test"])[0])
        if found != g.settings.embed_dim:
            raise RuntimeError(f"{found} dimensions, not {g.settings.embed_dim}")
        return f"{found} dimensions"

    def state() -> str:
        return ", ".join(s for s in manifest.stages if manifest.is_done(s)) or "no stage done"

    checks: tuple[Callable[[], str], ...] = (session, checkpoints, folder, records, vectors, state)
    out = []
    for check in checks:
        try:
            out.append((check.__name__, True, check()))
        except Exception as e:  # a report names every failure
            out.append((check.__name__, False, f"{type(e).__name__}: {e}".splitlines()[0]))
    return out
