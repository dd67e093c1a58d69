"""Settings of a run, as nested dataclasses with defaults, from YAML or JSON text."""

from __future__ import annotations

import dataclasses
import json
import typing
from dataclasses import dataclass, field


@dataclass
class Preprocessing:
    ground_only: bool = True
    classes: list[int] | None = None


@dataclass
class Coordinates:
    local: bool = True
    origin: str = "min_bounds"
    include_z: bool = False


@dataclass
class Clipping:
    enabled: bool = False
    boundary: str | None = None
    feature: str | None = None


@dataclass
class Coarse:
    enabled: bool = False
    method: str = "centroid"
    phase_cell: float = 2.0


@dataclass
class Multiscale:
    enabled: bool = False
    points: int = 20_000
    iterations: int = 30
    reach: float = 5.0


@dataclass
class Icp:
    enabled: bool = True
    iterations: int = 100
    tolerance: float = 1e-6
    reach: float = 1.0
    points: int = 50_000
    shift_eps: float = 1e-4
    turn_eps_degrees: float = 0.1


@dataclass
class Dod:
    enabled: bool = True
    cell: float = 1.0
    aggregate: str = "mean"


@dataclass
class C2c:
    enabled: bool = True
    mode: str = "euclidean"
    reach: float | None = 10.0
    radius: float | None = None
    k: int = 20
    least: int = 6


@dataclass
class M3c2:
    enabled: bool = True
    core_percent: float = 10.0
    core_count: int | None = None
    autotune: bool = True
    neighbors: int = 16
    depth_factor: float = 1.0
    least_radius: float = 1.0
    most_radius: float = 20.0
    radius: float = 1.0
    depth: float = 1.0


@dataclass
class Settings:
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    coordinates: Coordinates = field(default_factory=Coordinates)
    clipping: Clipping = field(default_factory=Clipping)
    coarse: Coarse = field(default_factory=Coarse)
    multiscale: Multiscale = field(default_factory=Multiscale)
    icp: Icp = field(default_factory=Icp)
    dod: Dod = field(default_factory=Dod)
    c2c: C2c = field(default_factory=C2c)
    m3c2: M3c2 = field(default_factory=M3c2)
    seed: int = 0


def _build(cls, values: object, where: str):
    if not isinstance(values, dict):
        raise ValueError(f"{where or 'settings'} must be a mapping")
    hints = typing.get_type_hints(cls)
    unknown = values.keys() - hints.keys()
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(f'{where}{k}' for k in sorted(unknown))}")
    out = {}
    for k, v in values.items():
        if dataclasses.is_dataclass(hints[k]):
            out[k] = _build(hints[k], v or {}, f"{where}{k}.")
        else:
            kinds = typing.get_args(hints[k]) or (hints[k],)
            plain = {int: (int,), float: (int, float), str: (str,), bool: (bool,), type(None): (type(None),)}
            allowed = [t for kind in kinds for t in plain.get(kind, (list,))]
            if not isinstance(v, tuple(allowed)) or (isinstance(v, bool) and bool not in kinds):
                raise ValueError(f"{where}{k}: {v!r} doesn't fit")
            out[k] = v
    return cls(**out)


def parse_settings(text: str | None) -> Settings:
    """Settings of a text; None and empty texts have the defaults. ValueError for unknown names and values that don't fit."""
    if not text or not text.strip():
        return Settings()
    try:
        values = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("not JSON, and no YAML reader is installed") from e
        try:
            values = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"settings can't be read: {e}") from e
    return _build(Settings, values or {}, "")
