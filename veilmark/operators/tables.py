"""Tabular sinks: what a run made, as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tables(path: str, mode: str = "errorifexists", **tables: DataFrame) -> dict[str, str]:
    """Each table under its name in path; a mapping may be kept away by not passing it. The paths by name."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(out[name])
    return out
