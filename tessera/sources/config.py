"""Settings from YAML into frozen dataclasses."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, is_dataclass
from pathlib import Path
from typing import Any, TypeVar, get_args, get_origin, get_type_hints

import yaml

T = TypeVar("T")


def build(cls: type[T], values: dict[str, Any] | None) -> T:
    """Nested dataclasses and tuples are built too; unknown keys are ignored, absent ones keep their defaults."""
    hints = get_type_hints(cls)
    given = {f.name: convert(hints[f.name], values[f.name]) for f in fields(cls) if values and f.name in values}
    return cls(**given)


def convert(kind: Any, value: Any) -> Any:
    if is_dataclass(kind) and isinstance(value, dict):
        return build(kind, value)
    if get_origin(kind) is tuple and isinstance(value, list):
        inner = get_args(kind)
        return tuple(convert(inner[0] if inner else Any, v) for v in value)
    return value


def load(path: str | Path, cls: type[T]) -> T:
    return build(cls, yaml.safe_load(Path(path).read_text()) or {})


def to_dict(config: Any) -> dict[str, Any]:
    return asdict(config)


# How answers may be decoded, and the least token budget that tells a long answer from one that never stops.
DECODINGS = ("greedy", "sample")
LEAST_TOKENS = 384


@dataclass(frozen=True)
class Sampling:
    """How answers were sampled; settings that contradict one another are refused."""

    decoding: str = "greedy"
    samples: int = 1
    temperature: float = 1.0
    top_p: float = 1.0
    top_k: int = 0
    seed: int = 0
    batch_size: int = 16
    max_new_tokens: int = LEAST_TOKENS

    def __post_init__(self) -> None:
        if self.decoding not in DECODINGS:
            raise ValueError(f"decoding {self.decoding!r} is neither of {DECODINGS}")
        if self.samples < 1 or self.batch_size < 1:
            raise ValueError("samples and batch_size must be positive")
        if self.decoding == "greedy" and self.samples != 1:
            raise ValueError(f"greedy decoding has one answer, not {self.samples}")
        if self.max_new_tokens < LEAST_TOKENS:
            raise ValueError(f"max_new_tokens is {self.max_new_tokens}, below {LEAST_TOKENS}: a long answer looks like one that never stops")
