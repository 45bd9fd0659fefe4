"""Settings of all operators, in one place, and where they are read from."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    #: Grouping.
    tau: float = 0.6
    min_doc_freq: int = 2
    node_fraction: float = 0.02
    node_floor: int = 3
    node_floor_cap: int = 25
    ambiguous_low: float = 0.45
    ambiguous_high: float = 0.75
    user_fraction: float = 0.05
    linkage_points: int = 4000
    stable_fraction: float = 0.9
    #: Similarity weights (prompt, user, tools, shape, format), plain and for thin prompts.
    weights: tuple[float, ...] = (0.60, 0.20, 0.25, 0.10, 0.05)
    thin_weights: tuple[float, ...] = (0.24, 0.40, 0.45, 0.20, 0.10)
    thin_lines: int = 3
    veto: float = 0.50
    #: Chains.
    link_seconds: int = 1800
    retry_seconds: int = 5
    continuation: int = 3
    orphan_alarm: float = 0.30
    orphan_partial: float = 0.05
    #: Registry and lookup.
    reidentify: float = 0.70
    containment: float = 0.80
    margin: float = 0.10
    common_fraction: float = 0.02
    anchors: int = 6
    #: Rows of an app that the loader keeps.
    rows_per_app: int = 1000
    cache_minimum: int = 1024
    gate: float = 0.8


@dataclass(frozen=True)
class Mapping:
    """Names of an export's columns. app_id_paths: dotted, the head is a column, the rest keys of its JSON."""

    request: str = "request_payload"
    response: str = "response_payload"
    request_id: str = "request_id"
    timestamp: str = "startTime"
    model: str = "model"
    call_type: str = "call_type"
    chat_types: tuple[str, ...] = ("completion", "acompletion")
    app_id_paths: tuple[str, ...] = ("request_payload.labels.vz_key_name", "client_metadata.headers.x-subject", "client_metadata.team_id")
    options: dict = field(default_factory=dict)

    def needed(self) -> list[str]:
        own = {self.request, self.response, self.request_id, self.timestamp, self.model, self.call_type, *(p.split(".")[0] for p in self.app_id_paths)}
        return sorted(c for c in own if c)


def resolve(base: Settings = Settings(), **overrides: object) -> Settings:
    """Settings with overrides; None and unknown names are ignored."""
    known = {f.name for f in fields(Settings)}
    return replace(base, **{k: v for k, v in overrides.items() if v is not None and k in known})


def load_mapping(path: str | Path) -> Mapping:
    """A mapping from YAML: columns, app_id_paths, options."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    columns = {k: v for k, v in (raw.get("columns") or {}).items() if k in {f.name for f in fields(Mapping)}}
    more = {"app_id_paths": tuple(raw["app_id_paths"])} if raw.get("app_id_paths") else {}
    options = raw.get("options") or {}
    if "chat_call_types" in options:
        more["chat_types"] = tuple(options["chat_call_types"] or ())
    return Mapping(**columns, **more, options=options)


def secret(names: tuple[str, ...] = ("LLM_KEY", "OPENAI_API_KEY"), env_file: str = ".env") -> str | None:
    """The first set environment variable, else the same name in an env file."""
    for name in names:
        if os.environ.get(name):
            return os.environ[name]
    path = Path(env_file)
    if path.exists():
        found = dict(line.split("=", 1) for line in path.read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
        for name in names:
            if found.get(name, "").strip():
                return found[name].strip().strip("'\"")
    return None
