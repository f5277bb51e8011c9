"""Options of a run: defaults, ranges and the document that describes them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from measura.functions.music import TUNINGS

# The ranges that options may take.
RANGES = {"max_duration_s": (1, 7200), "max_fret": (12, 30), "max_polyphony": (1, 6), "least_confidence": (0.0, 1.0)}
CHOICES = {"lyrics": ("auto", "file", "sidecar", "embedded", "captions", "transcribe"), "audio_source": ("auto", "vocals", "mix"), "model": ("tiny", "base", "small", "medium", "large-v3"), "device": ("auto", "cpu", "cuda")}


@dataclass(frozen=True)
class EngineConfig:
    language: str = "auto"
    lyrics: str = "auto"
    audio_source: str = "auto"
    model: str = "base"
    device: str = "auto"
    max_duration_s: int = 1800
    max_fret: int = 20
    max_polyphony: int = 4
    least_confidence: float = 0.5
    tuning: str | tuple[int, ...] = "standard"
    rights_confirmed: bool = False

    def __post_init__(self) -> None:
        for name, (low, high) in RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie within {low} and {high}")
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        self.pitches()

    def pitches(self) -> tuple[int, ...]:
        """The open strings: a named tuning, or six distinct ascending pitches within 0..127."""
        t = TUNINGS.get(self.tuning) if isinstance(self.tuning, str) else tuple(self.tuning)
        if t is None or len(t) != 6 or any(not 0 <= p <= 127 for p in t) or list(t) != sorted(set(t)):
            raise ValueError("a tuning is a known name or six distinct ascending pitches within 0..127")
        return t

    def merged(self, **changes) -> EngineConfig:
        """This configuration with the options that are given (not None)."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def describe() -> list[dict]:
    """Each option with its type, default, range and choices."""
    defaults = asdict(EngineConfig())
    return [{"name": f.name, "type": type(defaults[f.name]).__name__, "default": defaults[f.name], "range": RANGES.get(f.name), "choices": CHOICES.get(f.name)} for f in fields(EngineConfig)]
