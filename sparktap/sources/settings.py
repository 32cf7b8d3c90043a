"""Settings of an agent: from a file, from the environment, and the plan of sinks that command-line flags add to.

They are a small dictionary on the driver; `sinks.build` makes sinks of the plan.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

PREFIX = "SPARKTAP_"


@dataclass(frozen=True)
class Settings:
    kafka_brokers: str = "localhost:9092"
    kafka_topic: str = "api-events"
    agent_key: str = ""
    capture_tls: bool = True
    capture_ssl_content: bool = True
    capture_proc_events: bool = True
    ssl_binary_paths: tuple[str, ...] = ()
    log_level: str = "INFO"
    ports: tuple[int, ...] = ()
    pids: tuple[int, ...] = ()
    outputs: tuple[dict, ...] = field(default_factory=tuple)


def _as(default: Any, value: Any) -> Any:
    """A text from the environment in the type of the setting; values that a file has typed stay, lists become tuples."""
    if isinstance(default, tuple):
        parts = [p.strip() for p in value.split(",") if p.strip()] if isinstance(value, str) else list(value or ())
        return tuple(int(p) if isinstance(p, str) and p.isdigit() else p for p in parts)
    if isinstance(default, bool) and isinstance(value, str):
        return value.strip().lower() == "true"
    return value


def _with(base: Settings, values: Mapping[str, Any]) -> Settings:
    known = {f.name for f in fields(Settings)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return replace(base, **{k: _as(getattr(base, k), v) for k, v in values.items()})


def from_env(env: Mapping[str, str] | None = None) -> Settings:
    """Settings from variables with the prefix alone."""
    env = os.environ if env is None else env
    return _with(Settings(), {k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)})


def from_file(path: str, env: Mapping[str, str] | None = None) -> Settings:
    """Settings of a YAML file, with variables over them; a file that isn't there, or is empty, leaves the defaults.

    Where there is no file, variables are left aside too: `from_env` reads them.
    """
    if not Path(path).exists():
        return Settings()
    import yaml

    base = _with(Settings(), yaml.safe_load(Path(path).read_text()) or {})
    env = os.environ if env is None else env
    return _with(base, {k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)})


def sink_plan(outputs: list[dict], stdout: bool = True, file: str | None = None, brokers: str | None = None, topic: str | None = None) -> list[dict]:
    """The sinks of a file's outputs and of flags: stdout comes first unless it is there or switched off, a file and a
    topic (which needs both its flags) come last. Made for `sinks.build`."""
    plan = [dict(o) for o in outputs if stdout or o.get("type") != "stdout"]
    if stdout and all(o.get("type") != "stdout" for o in plan):
        plan.insert(0, {"type": "stdout"})
    if file:
        plan.append({"type": "file", "path": file})
    if brokers and topic:
        plan.append({"type": "kafka", "servers": ",".join(b.strip() for b in brokers.split(",")), "topic": topic})
    return plan
