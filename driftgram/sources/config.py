"""Configuration: TOML files, environment, built-in defaults, in rising precedence from the last."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from ..operators.pruning import Pruning

#: What a first visit shows.
LAUNCH = {"phrases": ["rust", "python"], "since": "2011", "granularity": "month", "smoothing": 3}
#: Comparisons offered to visitors.
SUGGESTED = (
    ("neural network", "deep learning", "LLM"),
    ("NFT", "GPT", "agent"),
    ("Snowden", "NSA", "PRISM"),
    ("remote", "hybrid", "return to office"),
    ("self-driving", "FSD", "robotaxi"),
    ("Wirth", "Knuth", "Stallman"),
    ("Atom", "VSCode"),
    ("MongoDB", "PostgreSQL"),
    ("TensorFlow", "PyTorch"),
)
GRANULARITIES = ("daily", "monthly", "yearly")


@dataclass(frozen=True)
class BuildConfig:
    start: str = "2006-10"
    end: str | None = None
    output: str = "parquet"
    max_n: int = 3
    bucket_granularity: str = "daily"
    pruning: Pruning = field(default_factory=Pruning)

    def __post_init__(self) -> None:
        if self.bucket_granularity not in GRANULARITIES:
            raise ValueError(f"bucket_granularity is one of {', '.join(GRANULARITIES)}")
        if not 1 <= self.max_n <= 5:
            raise ValueError("max_n is 1 to 5")


def load(path: str | None = None, environment: dict[str, str] | None = None, **arguments) -> BuildConfig:
    """From ``[process]`` of a TOML file, overlaid with the environment's thresholds and with arguments
    that aren't None. Settings of other engines' memory and threads are accepted and have no effect."""
    section = tomllib.loads(Path(path).read_text()).get("process", {}) if path else {}
    pruning = Pruning()
    for n, t in section.get("prune", {}).items():
        pruning = pruning.with_threshold(int(n), t.get("min_global"), t.get("min_bucket"), t.get("min_flush"))
    known = {f.name for f in fields(BuildConfig)} - {"pruning"}
    config = BuildConfig(**{k: v for k, v in section.items() if k in known}, pruning=pruning.with_environment(environment))
    return replace(config, **{k: v for k, v in arguments.items() if v is not None})


def is_suggested(phrases: list[str]) -> bool:
    """Whether the phrases are one of the suggested sets, whatever their order and case."""
    key = lambda ps: sorted(p.strip().lower() for p in ps)
    return key(phrases) in [key(list(s)) for s in SUGGESTED]
