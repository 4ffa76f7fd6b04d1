"""Parameters of the elastic measures, validated once and carried into kernels."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

INNER = ("squared euclidean", "euclidean")


@dataclass(frozen=True)
class DistanceSettings:
    """window: None or 0 means no band. max_length_diff: None is off, 0 asks for equal lengths.

    psi: how many points may be skipped at (begin of first, end of first, begin of second,
    end of second); one number stands for all four. window_type: `diagonal`, or `slanted`
    for a band around the line of slope len(second) / len(first).
    """

    window: int | None = None
    max_dist: float | None = None
    max_step: float | None = None
    max_length_diff: int | None = None
    penalty: float = 0.0
    psi: int | tuple[int, int, int, int] = 0
    inner: str = "squared euclidean"
    use_pruning: bool = False
    window_type: str = "diagonal"

    def __post_init__(self) -> None:
        if self.inner not in INNER and not callable(self.inner):
            raise ValueError(f"inner is one of {INNER}")
        if self.window_type not in ("diagonal", "slanted"):
            raise ValueError("window_type is diagonal or slanted")
        if isinstance(self.psi, list):
            object.__setattr__(self, "psi", tuple(self.psi))
        if not isinstance(self.psi, int) and len(self.psi) != 4:
            raise ValueError("psi is one number or four")
        for name in ("penalty", "max_dist", "max_step"):
            if (x := getattr(self, name)) is not None and x < 0:
                raise ValueError(f"{name} isn't negative")

    @property
    def psi4(self) -> tuple[int, int, int, int]:
        return (self.psi,) * 4 if isinstance(self.psi, int) else self.psi

    @property
    def squared(self) -> bool:
        return self.inner == "squared euclidean"

    def to_cost(self, distance: float) -> float:
        return distance * distance if self.squared else distance

    @property
    def lower_bound_holds(self) -> bool:
        """The envelope bound is below the distance only if no end may be skipped."""
        return self.psi4 == (0, 0, 0, 0)

    @property
    def upper_bound_holds(self) -> bool:
        """The Euclidean distance is a valid path's cost only without penalty and step limit."""
        return self.penalty == 0 and self.max_step is None

    def with_(self, **changes) -> DistanceSettings:
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> DistanceSettings:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in known})


@dataclass(frozen=True)
class ConcurrenceSettings:
    """Parameters of local concurrences: see operators.search."""

    gamma: float = 1.0
    tau: float = 0.0
    delta: float = 0.0
    delta_factor: float = 1.0
    penalty: float = 0.0
    window: int | None = None
    only_triu: bool = False
    steps: str = "typeI"

    @property
    def penalty_in_series(self) -> float:
        """The difference between two values whose affinity is 1 - penalty."""
        import math

        return math.sqrt(-math.log(1 - self.penalty) / self.gamma)

    def with_penalty_in_series(self, difference: float) -> ConcurrenceSettings:
        import math

        return replace(self, penalty=1 - math.exp(-self.gamma * difference**2))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ConcurrenceSettings:
        return cls(**json.loads(text))
