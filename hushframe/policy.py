"""Protection levels and the disclosure-control measures that each turns on."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Level(str, Enum):
    PUBLIC = "public"
    PROTECTED = "protected"
    SENSITIVE = "sensitive"


class Profile(str, Enum):
    """Both names run the private facade; OPEN is kept for callers that ask for it."""

    OPEN = "open"
    STRICT = "strict"


@dataclass(frozen=True)
class Suppression:
    min_n: int = 5
    round_to: int | None = None
    min_population: int | None = None
    winsorize: tuple[float, float] | None = None
    count_noise: int | None = None
    #: Secret that fixes the noise; without it the environment's.
    noise_key: str | None = field(default=None, repr=False)
    max_low_cell_share: float | None = None
    min_edit_units: int | None = None
    min_descriptive_n: int | None = None
    percentile_sig_figs: int | None = None
    intercept_k_anon: int | None = None
    microaggregate: bool = False

    @property
    def descriptive_n(self) -> int:
        """Least number of rows behind a mean, a deviation or a percentile."""
        return max(self.min_n, self.min_descriptive_n or 0, self.min_population or 0)

    def floor(self, stat: str) -> int:
        return self.min_n if stat in ("count", "size", "sum") else self.descriptive_n


_STANDARD = dict(min_n=5, round_to=10, winsorize=(0.01, 0.99), max_low_cell_share=0.5, min_edit_units=10, min_descriptive_n=10, percentile_sig_figs=3, intercept_k_anon=5)

PRESETS = {
    "off": Suppression(min_n=1),
    "light": Suppression(min_n=5),
    "standard": Suppression(**_STANDARD),
    "microdata": Suppression(**_STANDARD, min_population=1000, count_noise=2),
}

_PRESET_OF = {Level.PUBLIC: "off", Level.PROTECTED: "standard", Level.SENSITIVE: "microdata"}


@dataclass(frozen=True)
class Policy:
    level: Level
    suppression: Suppression
    profile: Profile = Profile.STRICT

    @property
    def min_n(self) -> int:
        return self.suppression.min_n

    @property
    def round_to(self) -> int | None:
        return self.suppression.round_to


def resolve_policy(levels=None, *, suppression: Suppression | str | None = None) -> Policy:
    """The most restrictive source wins; ``suppression`` (a preset or an object) overrides it."""
    if isinstance(levels, (str, Level)):
        levels = [levels]
    order = list(Level)
    level = max((Level(x) for x in levels or [Level.PROTECTED]), key=order.index)
    if isinstance(suppression, str):
        if suppression not in PRESETS:
            raise ValueError(f"unknown suppression preset: {suppression!r}")
        suppression = PRESETS[suppression]
    return Policy(level, suppression or PRESETS[_PRESET_OF[level]])
