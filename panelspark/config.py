"""Settings of a study: defaults, a JSON file over them, checks, and a digest that names a run."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class StudyConfig:
    """Bars and shares as the study's operators take them."""

    horizon: int = 5
    embargo_pct: float = 0.01
    train: int = 756
    validation: int = 126
    refit: int = 126
    alpha: float = 0.1
    cost_bps: float = 10.0
    seeds: tuple[int, ...] = (0, 1, 2)

    def __post_init__(self) -> None:
        wrong = [n for n in ("horizon", "train", "validation", "refit") if getattr(self, n) < 1]
        wrong += [n for n, low, high in (("embargo_pct", 0, 0.5), ("alpha", 0, 1)) if not low <= getattr(self, n) < high]
        if self.cost_bps < 0:
            wrong.append("cost_bps")
        if not self.seeds:
            wrong.append("seeds")
        if wrong:
            raise ValueError(f"settings out of range: {', '.join(wrong)}")

    def digest(self) -> str:
        """Twelve hexadecimal digits, alike for equal settings in any order."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


def load(text: str) -> StudyConfig:
    """Settings from JSON over the defaults; a name that is not known is an error."""
    given = json.loads(text or "{}")
    unknown = set(given) - {f.name for f in fields(StudyConfig)}
    if unknown:
        raise ValueError(f"settings not known: {', '.join(sorted(unknown))}")
    if "seeds" in given:
        given["seeds"] = tuple(given["seeds"])
    return replace(StudyConfig(), **given)
