"""Settings of the engine, loaded from a mapping, a JSON or YAML file, or the environment, and applied to a session."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from pyspark.sql import SparkSession

from tarnbeck.errors import EngineError

PREFIX = "TARNBECK_"


@dataclass(frozen=True)
class Config:
    """What a session needs to know about its cluster; None leaves Spark's own value."""

    shuffle_partitions: int | None = None
    max_partition_bytes: int | None = None
    broadcast_bytes: int | None = None
    adaptive: bool = True
    ansi: bool = True
    time_zone: str = "UTC"
    memory_fraction: float | None = None

    def __post_init__(self):
        for name in ("shuffle_partitions", "max_partition_bytes"):
            value = getattr(self, name)
            if value is not None and value < 1:
                raise EngineError("config", f"{name} must be positive")
        if self.memory_fraction is not None and not 0 < self.memory_fraction < 1:
            raise EngineError("config", "memory_fraction must lie between 0 and 1")

    def with_values(self, **values) -> Config:
        known = {f.name for f in fields(self)}
        for name in values:
            if name not in known:
                raise EngineError("config", "no such setting", name)
        return replace(self, **values)

    @classmethod
    def from_file(cls, path: str | Path) -> Config:
        text = Path(path).read_text()
        if str(path).endswith((".yml", ".yaml")):
            return cls().with_values(**_yaml(text))
        return cls().with_values(**_flat(json.loads(text)))

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        return cls().with_values(**{f.name: _parse(env[key]) for f in fields(cls) if (key := PREFIX + f.name.upper()) in env})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def spark_conf(self) -> dict[str, str]:
        """Settings that a running session accepts."""
        out = {"spark.sql.adaptive.enabled": str(self.adaptive).lower(), "spark.sql.ansi.enabled": str(self.ansi).lower(), "spark.sql.session.timeZone": self.time_zone}
        for key, value in (("spark.sql.shuffle.partitions", self.shuffle_partitions), ("spark.sql.files.maxPartitionBytes", self.max_partition_bytes), ("spark.sql.autoBroadcastJoinThreshold", self.broadcast_bytes)):
            if value is not None:
                out[key] = str(value)
        return out

    def tuned(self, input_bytes: int, cores: int, partition_bytes: int = 128 << 20) -> Config:
        """With partition counts and sizes for an input: shuffled partitions of about partition_bytes, three for each core at least, and scans that keep all cores busy."""
        if input_bytes < 0 or cores < 1:
            raise EngineError("config", "input_bytes must not be negative, and cores at least 1")
        shuffled = max(3 * cores, -(-input_bytes // partition_bytes))
        scanned = min(partition_bytes, max(4 << 20, input_bytes // (2 * cores)))
        return self.with_values(shuffle_partitions=shuffled, max_partition_bytes=scanned)

    def apply(self, spark: SparkSession) -> SparkSession:
        for key, value in self.spark_conf().items():
            spark.conf.set(key, value)
        return spark


def _parse(text: str):
    text = text.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("", "null", "none", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("'\"")


def _flat(values: dict) -> dict:
    """Settings of nested sections, by their own names; sections only group them."""
    out = {}
    for name, value in values.items():
        out |= _flat(value) if isinstance(value, dict) else {name: value}
    return out


def _yaml(text: str) -> dict:
    """`name: value` lines, in sections by indentation or not; a name without a value that is followed by deeper lines is a section. Comments and blank lines are skipped."""
    lines = []
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if line.strip():
            name, colon, value = line.strip().partition(":")
            if not colon:
                raise EngineError("config", f"not a setting: {line.strip()}")
            lines.append((len(line) - len(line.lstrip()), name.strip(), value.strip()))
    out = {}
    for k, (depth, name, value) in enumerate(lines):
        section = not value and k + 1 < len(lines) and lines[k + 1][0] > depth
        if not section:
            out[name] = _parse(value)
    return out
