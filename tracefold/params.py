"""Options of the conformance checker."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from tracefold.functions.ties import STRATEGIES


@dataclass(frozen=True)
class Params:
    min_decay: int = 3
    multiplier: float = 0.3  # share of the expected remaining trace for which a state is kept; floor when adaptable
    alpha: float = 0.005  # weight of the newest out-of-order flag
    event_time_aware: bool = True
    adaptable: bool = True  # without event time there is nothing to adapt to
    order: str = "none"  # what to do with equal timestamps
    max_pattern: int = 10
    discounted: bool = True  # False keeps states for min_decay events

    def __post_init__(self):
        if self.order != "none" and self.order not in STRATEGIES:
            raise ValueError(f"order must be none or one of {sorted(STRATEGIES)}")
        if self.min_decay < 1:
            raise ValueError("min_decay must be at least 1")

    @property
    def adapts(self) -> bool:
        return self.adaptable and self.event_time_aware

    def as_dict(self) -> dict:
        return asdict(self)
