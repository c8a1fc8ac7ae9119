"""Configuration of a detector project: dataclasses, read from YAML, checked before any work starts."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields, is_dataclass
from enum import Enum
from typing import get_type_hints


class Size(str, Enum):
    """Model sizes."""

    tiny = "tiny"
    small = "small"
    medium = "medium"
    large = "large"


#: Classes that a batch may draw from.
CLASSES = ("positive", "adversarial_negative", "ambient_noise", "background_noise")


@dataclass
class Augmentation:
    rounds: int = 1
    snr_low_db: float = 5.0
    snr_high_db: float = 15.0
    jitter_samples: int = 3200
    eq_probability: float = 0.25
    distortion_probability: float = 0.25
    response_probability: float = 0.5
    context_probability: float = 0.0
    near_miss_context_probability: float = 0.0
    split_probability: float = 0.0
    context_gap_samples: list[int] = field(default_factory=lambda: [0, 6400])
    split_gap_samples: list[int] = field(default_factory=lambda: [1600, 8000])

    def check(self) -> None:
        within("augmentation.rounds", self.rounds, 1, 100)
        for name in ("eq_probability", "distortion_probability", "response_probability", "context_probability", "near_miss_context_probability", "split_probability"):
            within(f"augmentation.{name}", getattr(self, name), 0, 1)
        if self.snr_low_db > self.snr_high_db:
            raise ValueError("augmentation.snr_low_db is over snr_high_db")


@dataclass
class Streaming:
    threshold: float = 0.5
    debounce_seconds: float = 2.0
    consecutive: int = 1
    tail_hops: int = 1
    gap_seconds: float = 3.0
    target_fa_per_hour: float = 0.5
    verifier_threshold: float = 0.5
    snr_db: float = 10.0

    def check(self) -> None:
        within("streaming.threshold", self.threshold, 0, 1)
        within("streaming.consecutive", self.consecutive, 1, 1000)
        if self.gap_seconds <= self.tail_hops * 0.08:
            raise ValueError("streaming.gap_seconds must be longer than the detection window, so that windows never overlap")


@dataclass
class Config:
    name: str = "detector"
    phrases: list[str] = field(default_factory=list)
    size: Size = Size.small
    seed: int = 7
    n_train: int = 1000
    n_test: int = 200
    holdout: float = 0.2
    custom_negatives: list[str] = field(default_factory=list)
    swap_share: float = 0.0
    custom_share: float = 0.0
    partial_share: float = 1.0
    word_share: float = 0.2
    smoothing: float = 0.0
    mixup: float = 0.0
    unmixed: list[str] = field(default_factory=list)
    verifier_recall: float = 0.9
    shares: dict[str, float] = field(default_factory=dict)
    batch: dict[str, int] = field(default_factory=lambda: {"positive": 50, "adversarial_negative": 50, "ambient_noise": 50})
    steps: int = 1000
    augmentation: Augmentation = field(default_factory=Augmentation)
    streaming: Streaming = field(default_factory=Streaming)

    def check(self) -> Config:
        if not self.phrases:
            raise ValueError("phrases: one at least is needed")
        within("n_train", self.n_train, 0, 10**9)
        within("holdout", self.holdout, 0, 1)
        for name in ("swap_share", "custom_share", "partial_share", "word_share", "verifier_recall", "smoothing", "mixup"):
            within(name, getattr(self, name), 0, 1)
        if self.swap_share + self.custom_share > 1 + 1e-9:
            raise ValueError("swap_share and custom_share add up to more than 1")
        if sum(self.shares.values()) > 1 + 1e-9:
            raise ValueError("shares add up to more than 1")
        for name in set(self.batch) - set(CLASSES):
            warnings.warn(f"batch: unknown class {name}", stacklevel=2)
        self.augmentation.check()
        self.streaming.check()
        return self


def within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} is {value}; it must lie in {low} … {high}")


def build(kind: type, raw: dict):
    """A dataclass from nested dictionaries; unknown keys are errors."""
    hints, known = get_type_hints(kind), {f.name for f in fields(kind)}
    if extra := set(raw) - known:
        raise ValueError(f"unknown keys: {', '.join(sorted(extra))}")
    values = {}
    for key, value in raw.items():
        hint = hints[key]
        values[key] = build(hint, value or {}) if is_dataclass(hint) else hint(value) if isinstance(hint, type) and issubclass(hint, Enum) else value
    return kind(**values)


def load_config(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return build(Config, yaml.safe_load(f) or {}).check()
