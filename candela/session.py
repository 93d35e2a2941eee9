"""Sessions and settings."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

DEFAULTS: dict[str, Any] = {"warehouse": "candela-warehouse", "min_bars": 260, "coverage_ready": 0.95, "shuffle_partitions": 200}


def settings(path: str | None = None, **overrides) -> dict[str, Any]:
    """Settings by precedence: arguments, ``CANDELA_*`` variables, top-level keys of a TOML file, defaults."""
    out = dict(DEFAULTS)
    if path and Path(path).exists():
        import tomllib

        out |= {k: v for k, v in tomllib.loads(Path(path).read_text()).items() if not isinstance(v, dict)}
    for key, default in DEFAULTS.items():
        if (value := os.environ.get(f"CANDELA_{key.upper()}")) is not None:
            out[key] = type(default)(value)
    return out | {k: v for k, v in overrides.items() if v is not None}


def session(app: str = "candela", **conf) -> SparkSession:
    """A session with what the engine relies on: adaptive execution, Arrow transfer, UTC, and RocksDB state for streams."""
    builder = SparkSession.builder.appName(app)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
