"""What a run came from, and its summary."""

from __future__ import annotations

import json
import platform
import subprocess
import sys
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.sources.jsonl import write_atomic

LIBRARIES = ("pyspark", "pyarrow", "numpy")


def git(repo: Path, *arguments: str) -> str | None:
    """What git says, or None if it can't."""
    try:
        done = subprocess.run(["git", "-C", str(repo), *arguments], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def version(library: str) -> str | None:
    try:
        return metadata.version(library)
    except metadata.PackageNotFoundError:
        return None


def provenance(repo: str | Path | None = None) -> dict[str, Any]:
    """Commit, state of the tree and machine. Where the commit or the state can't be told, or the
    tree has changes, the run is scratch, and scratch_reason says why."""
    repo = Path(repo) if repo else Path(__file__).resolve().parent
    commit, status = git(repo, "rev-parse", "HEAD"), git(repo, "status", "--porcelain", "--untracked-files=all")
    unknown = commit is None or status is None
    reason = "git is missing or this is no repository" if unknown else "the working tree has changes" if status else None
    return {
        "commit": commit,
        "dirty": unknown or bool(status),
        "scratch": reason is not None,
        "scratch_reason": reason,
        "branch": git(repo, "rev-parse", "--abbrev-ref", "HEAD"),
        "hostname": platform.node(),
        "platform": platform.platform(),
        "python": platform.python_version(),
        "executable": sys.executable,
        "versions": {x: version(x) for x in LIBRARIES},
    }


def summary(log: DataFrame, facts: dict[str, Any], resumed_from: int | None = None) -> dict[str, Any]:
    """A run's facts with the mean training loss, the change of the evaluation loss and the history of its log.

    log: (step, loss, eval_loss), nulls where a line doesn't have a value; a run's log is
    small, a line for some steps. Of a resumed run the figures cover the resumed part only.
    """
    kept = log if resumed_from is None else log.where(F.col("step") > resumed_from)
    train = kept.agg(F.avg("loss").alias("loss"), F.max("step").alias("step")).first()
    moved = metrics.change(kept.withColumn("run", F.lit(0)), ["run"], "eval_loss").first()
    out = facts | {
        "train_loss": train.loss,
        "steps": train.step,
        "eval_loss_before": moved["first"] if moved else None,
        "eval_loss_after": moved["last"] if moved else None,
        "log_history": [r.asDict() for r in kept.orderBy("step").toLocalIterator()],
    }
    if resumed_from is not None:
        out |= {"resumed_from": resumed_from, "resumed_segment_only": True}
    return out


def share(part: int, whole: int) -> float | None:
    """In percent, to three places."""
    return round(100 * part / whole, 3) if whole else None


def write_summary(path: str | Path, found: dict[str, Any]) -> None:
    write_atomic(path, json.dumps(found, indent=1) + "\n")
