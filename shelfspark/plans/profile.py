"""Settings of a collection as typed values: limits are kept, unknown and unusable values fall back to the defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

SECRETS = ("api_key", "secret", "token")


@dataclass(frozen=True)
class Video:
    """How videos are cut; the longest chunk is never shorter than the usual one."""

    chunk_seconds: int = 30
    longest_seconds: int = 60
    fps: int = 2
    width: int = 1280
    most_segments: int = 240

    def __post_init__(self) -> None:
        object.__setattr__(self, "longest_seconds", max(self.longest_seconds, self.chunk_seconds))


@dataclass(frozen=True)
class Profile:
    """One embedding set-up."""

    model: str = ""
    dimension: int = 4096
    input_style: str = "auto"
    endpoint: str = ""
    api_key: str = ""
    rerank_candidates: int = 20
    most_assets: int = 400
    most_files: int = 100_000
    video: Video = field(default_factory=Video)

    @classmethod
    def load(cls, text: str) -> Profile:
        """From JSON; what is missing or of another type takes its default."""
        try:
            given = json.loads(text)
        except ValueError:
            given = {}
        return cls().updated(given if isinstance(given, dict) else {})

    def updated(self, given: dict[str, Any]) -> Profile:
        """With the given values of the right type; numbers must be positive, a blank secret keeps the old one."""
        known: dict[str, Any] = {}
        for name, old in asdict(self).items():
            value = given.get(name)
            if name == "video" and isinstance(value, dict):
                known[name] = Video(**{k: int(v) if _positive(v := value.get(k)) else o for k, o in old.items()})
            elif isinstance(old, int) and _positive(value):
                known[name] = int(value)
            elif isinstance(old, str) and isinstance(value, str) and (value or name not in SECRETS):
                known[name] = value
        return replace(self, **known)

    def public(self) -> dict[str, Any]:
        """Without secrets."""
        return {k: ("" if k in SECRETS else v) for k, v in asdict(self).items()}


def _positive(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and 0 < value < 1e12


def with_path(values: dict[str, Any], path: str, text: str) -> dict[str, Any]:
    """A copy of nested values with one dotted path set; true, false and numbers are read as such."""
    head, _, rest = path.partition(".")
    inner = values.get(head)
    return values | {head: with_path(inner if isinstance(inner, dict) else {}, rest, text) if rest else _typed(text)}


def _typed(text: str) -> Any:
    if text in ("true", "false"):
        return text == "true"
    try:
        return int(text) if text.lstrip("-").isdigit() else float(text)
    except ValueError:
        return text
