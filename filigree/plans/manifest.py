"""Stage order, committed state and guards of a pipeline run, on the driver."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone
from pathlib import Path

STAGES = ("parse", "embed", "nodes", "sense_edges", "word_vectors", "word_edges", "reentry", "triads", "index")


log = logging.getLogger("filigree.stages")


class StageError(RuntimeError):
    """A stage may not run now."""


@dataclass(frozen=True)
class State:
    stage: str
    last_id: str | None = None
    processed: int = 0
    total: int | None = None
    done: bool = False
    completed_at: str | None = None
    updated_at: str | None = None


class Manifest:
    """One JSON file per stage; a file is replaced in one step."""

    def __init__(self, folder: str | os.PathLike, stages: tuple[str, ...] = STAGES):
        self.folder, self.stages = Path(folder), stages

    def _path(self, stage: str) -> Path:
        if stage not in self.stages:
            raise StageError(f"unknown stage {stage!r}")
        return self.folder / f"{stage}.json"

    def load(self, stage: str) -> State:
        path = self._path(stage)
        return State(**json.loads(path.read_text())) if path.exists() else State(stage)

    def save(self, state: State) -> State:
        state = replace(state, updated_at=datetime.now(timezone.utc).isoformat())
        path = self._path(state.stage)
        self.folder.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_text(json.dumps(asdict(state)))
        os.replace(part, path)
        return state

    def reset(self, stage: str) -> None:
        """Forget a stage and all behind it, whose inputs change with it."""
        for s in self.stages[self.stages.index(stage) :]:
            self._path(s).unlink(missing_ok=True)

    def is_done(self, stage: str) -> bool:
        return self.load(stage).done

    def run(self, stage: str, work: Callable[[], int], *, reset: bool = False, force: bool = False, again: bool = False, dry_run: bool = False) -> int:
        """Run a stage whose predecessors are done, and record it as done.

        A done stage runs again only after a reset or by force; force also lets a stage
        run whose predecessors are not done, with a warning.  ``again`` lets a done stage
        go on from its tables.  A dry run records nothing.
        """
        self._path(stage)
        before = self.stages[: self.stages.index(stage)]
        if missing := [s for s in before if not self.is_done(s)]:
            if not force:
                raise StageError(f"{stage} needs {', '.join(missing)} first")
            log.warning("%s runs by force though %s are not done", stage, ", ".join(missing))
        if reset:
            self.reset(stage)
        if self.is_done(stage) and not (force or again):
            raise StageError(f"{stage} is done")
        log.info("%s begins", stage)
        n = work()
        if not dry_run:
            now = datetime.now(timezone.utc).isoformat()
            # The work may have noted how far it came.
            self.save(replace(self.load(stage), processed=n, total=n, done=True, completed_at=now))
        log.info("%s is done: %d rows", stage, n)
        return n
