"""Settings of a cohort: strict keys, defaults, and a stable hash."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Discovery:
    backend: str = "glob"
    bold_glob: str = "sub-*/func/*_bold.nii.gz"
    mask_glob: str | None = None
    include_tasks: tuple[str, ...] = ()
    exclude_tasks: tuple[str, ...] = ("localizer", "retinotopy", "rest")
    subject_pattern: str = r"sub-([A-Za-z0-9]+)"
    task_pattern: str = r"task-([A-Za-z0-9]+)"


@dataclass(frozen=True)
class Confounds:
    format: str = "none"
    strategy: str = "none"
    columns: tuple[str, ...] = ()
    censor_glob: str | None = None
    dilate_tr: int = 1


@dataclass(frozen=True)
class Filtering:
    already_applied: bool = True
    bandpass: tuple[float, float] | None = (0.01, 1.0)
    detrend: bool = False
    standardize: bool = False


@dataclass(frozen=True)
class Runs:
    """Accepted and hashed; nothing reads them."""

    mode: str = "concat"
    drop_boundary_windows: bool = False


@dataclass(frozen=True)
class Trim:
    column: str | None = None
    unit: str = "seconds"
    mode: str = "end"


@dataclass(frozen=True)
class Stimulus:
    durations_s: dict[str, float] = field(default_factory=dict)
    timing_source: str = "identity"
    unit_of_analysis: str = "run"
    isc_gate_tr: float = 1.0


@dataclass(frozen=True)
class Windows:
    sizes_s: tuple[float, ...] = (30.0, 60.0, 120.0, 300.0)
    n_overlaps: int = 5
    drop_incomplete: bool = True
    min_n_tr_effective: int = 2
    edge_column_threshold: int = 20_000


SECTIONS = {"discovery": Discovery, "confounds": Confounds, "filtering": Filtering, "runs": Runs, "trim": Trim, "stimulus": Stimulus, "windows": Windows}
REQUIRED = ("cohort", "tr", "derivatives_root", "output_root")


@dataclass(frozen=True)
class CohortConfig:
    cohort: str
    tr: float
    derivatives_root: str
    output_root: str
    space: str = "MNI152NLin2009cAsym"
    smoothing_fwhm: float | None = None
    denoising_method: str | None = None
    participants: str | None = None
    atlases: tuple[str, ...] = ("harvardoxford", "yeo7", "networks")
    atlas_params: dict[str, dict] = field(default_factory=dict)
    discovery: Discovery = field(default_factory=Discovery)
    confounds: Confounds = field(default_factory=Confounds)
    filtering: Filtering = field(default_factory=Filtering)
    runs: Runs = field(default_factory=Runs)
    trim: Trim = field(default_factory=Trim)
    stimulus: Stimulus = field(default_factory=Stimulus)
    windows: Windows = field(default_factory=Windows)

    def __post_init__(self):
        if not isinstance(self.tr, (int, float)) or self.tr <= 0:
            raise ConfigError(f"tr must be a positive number, not {self.tr!r}")
        if not self.atlases:
            raise ConfigError("at least one atlas is needed")
        if self.trim.column is not None and self.trim.unit not in ("seconds", "tr"):
            raise ConfigError(f"trim.unit must be seconds or tr, not {self.trim.unit!r}")

    def window_tr(self, window_s: float) -> int:
        if window_s <= 0:
            raise ConfigError("window must be positive")
        return int((window_s / self.tr + 0.5) // 1)

    def stimulus_duration_s(self, task: str, fallback: float | None = None) -> float:
        found = self.stimulus.durations_s.get(task, fallback)
        if found is None:
            raise ConfigError(f"no stimulus duration for task {task!r}; set stimulus.durations_s")
        return float(found)

    def to_dict(self) -> dict:
        return json.loads(json.dumps(dataclasses.asdict(self), default=str))

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:16]


def _make(kind: type, values: dict, where: str):
    if not isinstance(values, dict):
        raise ConfigError(f"{where} must be a mapping")
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ConfigError(f"unknown keys in {where}: {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def config_from_dict(data: dict) -> CohortConfig:
    if missing := [k for k in REQUIRED if k not in data]:
        raise ConfigError(f"missing keys: {', '.join(missing)}")
    values = {k: _make(SECTIONS[k], v or {}, k) if k in SECTIONS else v for k, v in data.items()}
    return _make(CohortConfig, values, "the configuration")


def load_config(path: str | Path) -> CohortConfig:
    import yaml

    return config_from_dict(yaml.safe_load(Path(path).read_text()) or {})
