"""Settings: a frozen tree of dataclasses, merged section by section with a YAML file."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml


@dataclass(frozen=True)
class Input:
    alerts_path: str = "/var/ossec/logs/alerts/alerts.json"
    session_minutes: int = 60


@dataclass(frozen=True)
class Paths:
    models_dir: str = "models/"
    data_dir: str = "data/"
    alert_output: str = "/var/log/anomaly_alerts.json"


@dataclass(frozen=True)
class Behavior:
    sensitive_path: str = "C:\\Sensitive\\"
    work_hour_start: int = 9
    work_hour_end: int = 18


@dataclass(frozen=True)
class Detection:
    contamination: float = 0.05
    ae_latent_dim: int = 4
    ae_threshold_sigma: float = 3.0
    ensemble_threshold: int = 2


@dataclass(frozen=True)
class Daemon:
    poll_seconds: int = 30
    history_size: int = 500


@dataclass(frozen=True)
class Logging:
    level: str = "INFO"


@dataclass(frozen=True)
class Config:
    input: Input = field(default_factory=Input)
    paths: Paths = field(default_factory=Paths)
    behavior: Behavior = field(default_factory=Behavior)
    detection: Detection = field(default_factory=Detection)
    daemon: Daemon = field(default_factory=Daemon)
    logging: Logging = field(default_factory=Logging)


def merged(given: dict[str, Any] | None, aliases: dict[str, str] | None = None) -> Config:
    """Defaults with the given sections laid over them; ``aliases`` names sections that a file calls otherwise.

    Unknown sections and settings are refused.
    """
    config = Config()
    for section, values in (given or {}).items():
        name = (aliases or {}).get(section, section)
        if name not in {f.name for f in dataclasses.fields(config)}:
            raise ValueError(f"unknown section {section!r}")
        try:
            part = dataclasses.replace(getattr(config, name), **(values or {}))
        except TypeError as e:
            raise ValueError(f"section {section!r}: {e}") from e
        config = dataclasses.replace(config, **{name: part})
    return config


def find(start: str | Path) -> Path | None:
    """config/config.yaml in a folder or the nearest one above it."""
    here = Path(start).resolve()
    return next((p for d in (here, *here.parents) if (p := d / "config" / "config.yaml").is_file()), None)


def load(path: str | Path | None = None, start: str | Path = ".", aliases: dict[str, str] | None = None) -> Config:
    """Settings from ``path``, or from the nearest config file at or above ``start``, or the defaults."""
    file = Path(path) if path else find(start)
    if file is None or not file.exists():
        return Config()
    return merged(yaml.safe_load(file.read_text(encoding="utf-8")), aliases)
