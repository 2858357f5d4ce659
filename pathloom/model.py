"""Schemas, settings and the tier table."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

ATTRS = "array<struct<key:string,value:string,type:string>>"
NODES = f"ord long, id string, attrs {ATTRS}"
EDGES = f"ord long, src string, dst string, attrs {ATTRS}"
QA = "question string, answer string, difficulty string"
RESPONSES = "draw_id long, prompt string, raw string, prompt_tokens long, completion_tokens long, status string"

#: Prices in dollars per thousand tokens.
INPUT_PRICE, OUTPUT_PRICE = 0.0004, 0.0016


def env_lines(path: str) -> dict[str, str]:
    """The NAME=value lines of a file, without quotes around values; none if there is no such file."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as lines:
        pairs = [line.strip().removeprefix("export ").partition("=") for line in lines if "=" in line and not line.lstrip().startswith("#")]
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}


def _within(name: str, value: float, least: float, most: float) -> None:
    if not least <= value <= most:
        raise ValueError(f"{name} must lie between {least} and {most}, not be {value}")


@dataclass(frozen=True)
class BackendConfig:
    """Where a remote text generator is reached; the offline backend needs none of it."""

    api_key: str = ""
    endpoint: str = ""
    deployment: str = ""
    api_version: str = "2024-02-15-preview"
    max_retries: int = 3
    retry_delay: float = 1.0
    input_price: float = INPUT_PRICE
    output_price: float = OUTPUT_PRICE
    #: Prompts under way at a time in each task, and the number of tasks (0: as the prompts come).
    concurrency: int = 8
    partitions: int = 0

    @classmethod
    def from_env(cls, prefix: str = "PATHLOOM_", env_file: str | None = None, **more: object) -> BackendConfig:
        """Settings of the environment, and where it lacks them those of a file of NAME=value lines, if it is there."""
        names = ("api_key", "endpoint", "deployment")
        known = env_lines(env_file) if env_file else {}
        return cls(**{n: os.environ.get(prefix + n.upper()) or known.get(prefix + n.upper(), "") for n in names}, **more)

    def missing(self) -> list[str]:
        """The settings that a remote backend would still need."""
        return [n for n in ("api_key", "endpoint", "deployment") if not getattr(self, n)]


@dataclass(frozen=True)
class ExtractionConfig:
    max_paths: int = 100
    max_hop_depth: int = 999
    dedup_threshold: float = 0.95
    sampling: str = "frequency_weighted"
    seed: int = 42

    def __post_init__(self) -> None:
        if self.sampling not in ("frequency_weighted", "random"):
            raise ValueError(f"unknown sampling strategy: {self.sampling}")
        if self.max_paths < 0 or self.max_hop_depth < 0:
            raise ValueError("max_paths and max_hop_depth must not be negative")


@dataclass(frozen=True)
class ValidationConfig:
    quality_threshold: float = 0.7
    min_length: int = 20
    max_length: int = 500

    def __post_init__(self) -> None:
        _within("quality_threshold", self.quality_threshold, 0, 1)


@dataclass(frozen=True)
class GenerationConfig:
    count: int = 100
    domain: str = "generic"
    temperature: float = 0.7
    max_tokens: int = 500

    def __post_init__(self) -> None:
        _within("count", self.count, 0, float("inf"))
        _within("temperature", self.temperature, 0, 2)


@dataclass(frozen=True)
class Tier:
    number: int
    quality_threshold: float
    dedup_threshold: float
    temperature: float
    sampling: str
    description: str

    @property
    def min_length(self) -> int:
        return 10 if self.quality_threshold < 0.5 else 20

    def warnings(self) -> list[str]:
        """What this tier gives up against the first one."""
        found = []
        if self.quality_threshold < 0.7:
            found.append(f"quality threshold {self.quality_threshold:.1f} instead of 0.7")
        if self.dedup_threshold < 0.95:
            found.append(f"dedup threshold {self.dedup_threshold:.2f} instead of 0.95: more paths count as duplicates")
        if self.temperature > 0.7:
            found.append(f"temperature {self.temperature:.1f} instead of 0.7")
        if self.sampling == "random":
            found.append("uniform instead of degree-weighted sampling")
        return found


#: Quality threshold, dedup threshold, temperature and sampling of each tier.
TIERS = (
    Tier(0, 0.7, 0.95, 0.7, "frequency_weighted", "defaults"),
    Tier(1, 0.7, 0.70, 0.7, "frequency_weighted", "stricter dedup"),
    Tier(2, 0.5, 0.70, 0.7, "frequency_weighted", "lower quality threshold"),
    Tier(3, 0.5, 0.60, 0.9, "frequency_weighted", "higher temperature"),
    Tier(4, 0.5, 0.50, 0.9, "random", "uniform sampling"),
    Tier(5, 0.3, 0.30, 1.0, "random", "least quality, greatest yield"),
)


@dataclass
class TierResult:
    tier: Tier
    generated: int = 0
    rejected: int = 0
    avg_quality: float = 0.0
    warnings: list[str] = field(default_factory=list)
