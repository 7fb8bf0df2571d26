"""Step plans of training runs, as plain arithmetic."""

from __future__ import annotations

import math


def sft_steps(n: int, batch: int, accumulate: int, epochs: float, warmup_ratio: float) -> dict[str, int]:
    per_epoch = max(1, n // (batch * accumulate))
    return {"steps_per_epoch": per_epoch, "warmup_steps": int(warmup_ratio * per_epoch * epochs)}


def preference_steps(n: int, batch: int, accumulate: int, epochs: float, warmup_ratio: float, save: int | None = None) -> dict[str, int]:
    """Updates as a trainer counts them; a checkpoint about every fifth of the run, two at least; warm-up from ten steps on."""
    updates = max(1, -(-(-(-n // batch)) // accumulate))
    total = math.ceil(updates * epochs)
    every = max(1, round(total / 5)) if save is None else save
    every = max(1, total // 2) if every >= total else every
    warmup = int(warmup_ratio * total)
    return {"total_steps": total, "save_steps": every, "warmup_steps": max(1, warmup) if total >= 10 else warmup}
