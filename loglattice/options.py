"""Options of the collector, its parser, sink and metrics: defaults, loading from file, environment and flags, checks."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import socket
import tomllib
from dataclasses import dataclass, field
from typing import Any

# Names of strategies and modes, and the preset for Java stack traces.
CHECKSUM, CHECKSUM_SEPARATOR, DEVICE_AND_INODE = "checksum", "checksumSeparator", "deviceAndInode"
CONTINUE_PAST, CONTINUE_THROUGH, HALT_BEFORE, HALT_WITH = "continuePast", "continueThrough", "haltBefore", "haltWith"
JAVA = {"mode": CONTINUE_THROUGH, "start_pattern": r"^(ERROR|WARN|INFO|Exception)", "condition_pattern": r"^(\s|at\s|Caused by:)", "timeout": 0.5}
SINK_TYPES = ("", "console", "file", "clickhouse", "opensearch")


class OptionError(ValueError):
    """An option has a value that cannot work."""


@dataclass
class MultilineOptions:
    mode: str = ""
    start_pattern: str = ""
    condition_pattern: str = ""
    timeout: float = 0.0
    java: bool = False

    def __post_init__(self):
        if self.java:
            for name, value in JAVA.items():
                if not getattr(self, name):
                    setattr(self, name, value)

    def validate(self) -> None:
        for name, value in (("start pattern", self.start_pattern), ("condition pattern", self.condition_pattern)):
            if not value:
                raise OptionError(f"multiline {name} must be set")
            try:
                re.compile(value)
            except re.error as e:
                raise OptionError(f"multiline {name} is no regular expression: {e}") from e
        if self.timeout <= 0:
            raise OptionError("multiline timeout must be greater than 0")


@dataclass
class CollectorOptions:
    workers: int = 1
    separator: str = "\n"
    poll_interval: float = 0.1
    fingerprint_strategy: str = DEVICE_AND_INODE
    fingerprint_size: int = 0
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    db_path: str = "collector.db"
    store_offsets: bool = True
    #: Most bytes of a stream's batch, 0 for no bound; and of one file in it, where its lines are grouped by one task.
    max_batch_bytes: int = 0
    max_file_bytes: int = 256 << 20
    multiline: MultilineOptions | None = None

    def default_fingerprint(self) -> None:
        self.fingerprint_strategy, self.fingerprint_size = CHECKSUM, 1024

    def validate(self) -> None:
        if self.multiline:
            self.multiline.validate()
        if self.fingerprint_strategy not in (CHECKSUM, CHECKSUM_SEPARATOR, DEVICE_AND_INODE):
            raise OptionError(f"unsupported fingerprint strategy: {self.fingerprint_strategy}")
        if self.fingerprint_strategy != DEVICE_AND_INODE and self.fingerprint_size <= 0:
            raise OptionError("fingerprint size must be greater than 0")
        if self.fingerprint_strategy == CHECKSUM_SEPARATOR and not self.separator:
            raise OptionError("fingerprint separator must be set for checksumSeparator strategy")


@dataclass
class ParserOptions:
    type: str = ""
    format: str = "json"
    drop_non_matching: bool = False


@dataclass
class SinkOptions:
    type: str = "console"
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    batch_size: int = 200
    batch_interval: float = 2.0
    host: str = ""
    labels: dict[str, str] = field(default_factory=dict)
    console: dict[str, Any] = field(default_factory=lambda: {"stream": "stdout"})
    file: dict[str, Any] = field(default_factory=dict)
    clickhouse: dict[str, Any] = field(default_factory=dict)
    opensearch: dict[str, Any] = field(default_factory=dict)

    def host_name(self) -> str:
        return self.host or socket.gethostname()

    def validate(self) -> None:
        if self.type not in SINK_TYPES:
            raise OptionError(f"invalid sink.type: {self.type}")
        if not self.type:
            return
        if self.batch_size <= 0:
            raise OptionError("sink.batch-size must be > 0")
        if self.batch_interval <= 0:
            raise OptionError("sink.batch-interval must be > 0")
        if self.type == "console" and self.console.get("stream", "") not in ("", "stdout", "stderr"):
            raise OptionError("sink.console.stream must be stdout or stderr")
        need = {"file": ("path",), "clickhouse": ("addr", "table"), "opensearch": ("url", "index")}.get(self.type, ())
        for name in need:
            if not getattr(self, self.type).get(name):
                raise OptionError(f"sink.{self.type}.{name} must be set")


@dataclass
class PrometheusOptions:
    enable: bool = False
    addr: str = ":2112"


@dataclass
class Options:
    collector: CollectorOptions = field(default_factory=lambda: CollectorOptions(poll_interval=2.0, fingerprint_strategy=CHECKSUM, fingerprint_size=64))
    sink: SinkOptions = field(default_factory=SinkOptions)
    parser: ParserOptions = field(default_factory=ParserOptions)
    prometheus: PrometheusOptions = field(default_factory=PrometheusOptions)

    def validate(self) -> None:
        self.sink.validate()
        if self.prometheus.enable and not self.prometheus.addr:
            raise OptionError("prometheus.addr must be set when prometheus.enable is true")
        try:
            self.collector.validate()
        except OptionError as e:
            raise OptionError(f"invalid collector config: {e}") from e


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(value: Any) -> float:
    """Seconds of a number or of a text such as 500ms or 1m30s."""
    if isinstance(value, (int, float)):
        return float(value)
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", value)
    if not parts or "".join(a + b for a, b in parts) != value:
        raise OptionError(f"no duration: {value}")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def _fill(target: Any, values: dict[str, Any]) -> None:
    """Sets the fields of a dataclass from a mapping whose keys may be written with - or _."""
    fields = {f.name: f for f in dataclasses.fields(target)}
    for key, value in values.items():
        name = key.replace("-", "_").lower()
        name = {"worker_count": "workers"}.get(name, name)
        if name not in fields:
            continue
        current, kind = getattr(target, name), str(fields[name].type)
        if name == "multiline" and isinstance(value, dict):
            if any(value.values()):
                clean = {k.replace("-", "_"): v for k, v in value.items()}
                clean["timeout"] = seconds(clean.get("timeout", 0))
                known = {f.name for f in dataclasses.fields(MultilineOptions)}
                target.multiline = MultilineOptions(**{k: v for k, v in clean.items() if k in known})
        elif dataclasses.is_dataclass(current):
            _fill(current, value)
        elif kind.startswith("list"):
            setattr(target, name, value.split(",") if isinstance(value, str) else list(value))
        elif kind.startswith("dict"):
            setattr(target, name, json.loads(value) if isinstance(value, str) else {**current, **value})
        elif kind == "bool":
            setattr(target, name, value.lower() in ("1", "true", "yes", "on") if isinstance(value, str) else bool(value))
        elif kind == "float":
            setattr(target, name, seconds(value))
        elif kind == "int":
            setattr(target, name, int(value))
        else:
            setattr(target, name, value)


def _yaml(f) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as e:
        raise OptionError("PyYAML is needed to read a YAML file") from e
    return yaml.safe_load(f) or {}


def load(path: str | None = None, env: dict[str, str] | None = None, flags: dict[str, Any] | None = None, prefix: str = "LOGLATTICE") -> Options:
    """Defaults, then the file (TOML, JSON, or YAML where PyYAML is installed), then the environment, then flags; later ones win.

    PREFIX_SINK__BATCH_SIZE and PREFIX_SINK_BATCH_SIZE both name sink.batch-size; PREFIX_CONFIG names the file. Flags
    are fields of the collector, or names with a dot such as prometheus.addr.
    """
    env = dict(os.environ if env is None else env)
    out, path = Options(), path or env.get(f"{prefix}_CONFIG")
    if path:
        with open(path, "rb") as f:
            _fill(out, json.load(f) if path.endswith(".json") else _yaml(f) if path.endswith((".yaml", ".yml")) else tomllib.load(f))
    for section in dataclasses.fields(out):
        start = f"{prefix}_{section.name.upper()}_"
        found = {k[len(start) :].lstrip("_").lower(): v for k, v in env.items() if k.startswith(start)}
        _fill(getattr(out, section.name), found)
    for name, value in (flags or {}).items():
        section, _, key = name.rpartition(".")
        _fill(getattr(out, section or "collector"), {key: value})
    return out
