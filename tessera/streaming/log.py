"""A resumable log of batches: Structured Streaming appends, manifests guard, plain functions decide.

Every batch is a folder of its own, written whole and again under the same name if
a batch is repeated, so a crash neither loses nor doubles records.
"""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class StaleCache(RuntimeError):
    """The log was made with other settings."""


def fingerprint(key: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(key, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def decide(saved: dict[str, Any] | None, key: dict[str, Any], refuse: bool, size: str = "n_prompts") -> str:
    """What to do with a saved log: fresh, resume or regenerate.

    A larger `size` extends a log, a smaller one is refused. On any other difference
    the log is made again, or refused if that is the policy.
    """
    if saved is None:
        return "fresh"
    rest = lambda k: {x: v for x, v in k.items() if x != size}
    if rest(saved) != rest(key):
        if refuse:
            raise StaleCache("the log was made with other settings: " + ", ".join(sorted(k for k in saved.keys() | key.keys() if saved.get(k) != key.get(k))))
        return "regenerate"
    if saved.get(size, 0) > key.get(size, 0):
        raise StaleCache(f"the log has {size} {saved.get(size)}, more than the {key.get(size)} asked for")
    return "resume"


def usable_prefix(matching: int, wanted: int, batch: int) -> int:
    """Records to keep: all if complete, else whole batches of the matching ones."""
    return matching if matching >= wanted else matching // batch * batch


def matching_prefix(records: DataFrame, plan: DataFrame) -> DataFrame:
    """One row, n: plan entries before the first that has no equal record; both have index and prompt_key."""
    given = records.select(F.col("index").alias("j"), F.col("prompt_key").alias("given"))
    joined = plan.join(given, F.col("index") == F.col("j"), "left")
    wrong = F.min(F.when(~F.col("prompt_key").eqNullSafe(F.col("given")), F.col("index")))
    return joined.agg(F.coalesce(wrong, F.count("*")).alias("n"))


def remaining(plan: DataFrame, done: DataFrame) -> DataFrame:
    """The work that is left."""
    return plan.join(done.select("index"), "index", "left_anti")


def append(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, transform=None, files: int | None = None) -> None:
    """Process the files that are new in source, each batch into out/batch_id=N; returns when all are done."""
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        made = transform(batch) if transform else batch
        made.write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest_checkpoint(folder: str | Path, marker: str) -> Path | None:
    """checkpoint-N with the largest N that holds the marker file of a complete one."""
    numbered = [(int(m[1]), p) for p in Path(folder).glob("checkpoint-*") if (m := re.fullmatch(r"checkpoint-(\d+)", p.name)) and (p / marker).exists()]
    return max(numbered, default=(0, None), key=lambda x: x[0])[1]


def may_start(checkpoints: bool, complete: bool, resume: bool) -> None:
    """A fresh start must not run over checkpoints; a resumed one needs a complete one."""
    if not resume and checkpoints:
        raise RuntimeError("checkpoints of another run are there: resume it or choose another folder")
    if resume and not complete:
        raise RuntimeError("no complete checkpoint to resume from")


def check_drift(saved: dict[str, Any], now: dict[str, Any], scratch: bool, keys: tuple[str, ...] = ("commit", "tree", "config")) -> bool:
    """Whether the record is tainted: a changed commit, tree or configuration is refused unless scratch."""
    changed = [k for k in keys if saved.get(k) != now.get(k)]
    if changed and not scratch:
        raise RuntimeError("changed since the run began: " + ", ".join(changed))
    return bool(changed) or bool(saved.get("scratch"))
