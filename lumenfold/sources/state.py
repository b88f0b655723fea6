"""State tables as Parquet: append history, read the latest, write versioned snapshots; and configuration files."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.queue import latest_per

_ENTROPY_BITS, _COUNTER_BITS = 16, 6


class StateStore:
    """Named tables under one folder. Nothing is updated in place: a newer row or version takes an older one's place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def append(self, table: str, rows: DataFrame, partition_by: Sequence[str] = ("run_id",)) -> None:
        own = [c for c in partition_by if c in rows.columns]
        rows.write.mode("append").partitionBy(*own).parquet(self.path(table))

    def read(self, table: str, **equal) -> DataFrame:
        """The table's rows where the given columns have the given values; partition columns prune files."""
        df = self.spark.read.parquet(self.path(table))
        for column, value in equal.items():
            df = df.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(column) == value)
        return df

    def latest(self, table: str, keys: Sequence[str], order: Sequence[str], **equal) -> DataFrame:
        """What an upsert table would hold: the last row of each key."""
        return latest_per(self.read(table, **equal), keys, [F.desc(c) for c in order])

    def snapshot(self, table: str, rows: DataFrame, json_columns: Sequence[str], partition_by: Sequence[str] = ("run_id",)) -> None:
        """Appends snapshots whose ``json_columns`` are kept as VARIANT, so that paths of them can be read without a schema."""
        self.append(table, rows.withColumns({c: F.parse_json(c) for c in json_columns}), partition_by)

    def checkpoint(self, table: str, rows: DataFrame, key: str = "run_id") -> None:
        """Replaces the rows of the keys that ``rows`` has, and no others."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(self.path(table))


def batch_ids(millis: Column, entropy: Column, counter: Column) -> Column:
    """Sortable ids: time, then a writer's entropy, then its counter."""
    high = F.shiftleft(millis.cast("bigint"), _ENTROPY_BITS + _COUNTER_BITS)
    low = F.shiftleft(F.pmod(entropy, F.lit(1 << _ENTROPY_BITS)).cast("bigint"), _COUNTER_BITS)
    return high.bitwiseOR(low).bitwiseOR(F.pmod(counter, F.lit(1 << _COUNTER_BITS)).cast("bigint"))


def merge_config(base: dict, overlay: dict) -> dict:
    """``overlay`` over ``base``: tables merge, everything else replaces."""
    out = dict(base)
    for key, value in overlay.items():
        out[key] = merge_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load_run_config(path: str, defaults: str | None = None) -> dict:
    spec = tomllib.loads(Path(path).read_text())
    refused = {"point_spec", "domain"} & spec.keys()
    if refused:
        raise ValueError(f"the domain follows from the integrand; remove {sorted(refused)}")
    return merge_config(tomllib.loads(Path(defaults).read_text()), spec) if defaults else spec


def load_template(folder: str, name: str) -> str:
    if "/" in name or "\\" in name or not name.endswith(".toml"):
        raise ValueError(f"not a template name: {name!r}")
    return (Path(folder) / name).read_text()


LEVELS = ("trace", "debug", "info", "warn", "error")


def log_rows(events: DataFrame, least: str = "info", sources: dict[str, str] | None = None) -> DataFrame:
    """Log events (id, source, level, span, fields: maps of strings) as rows to append: a span's fields with the event's over them.

    ``sources`` names other least levels for some sources; levels are taken in any case, unknown ones as info.
    """
    number = lambda level: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)), F.lit(3))
    wanted = F.lit(least)
    for source, level in (sources or {}).items():
        wanted = F.when(F.col("source") == source, F.lit(level)).otherwise(wanted)
    none = F.create_map().cast("map<string,string>")
    span, own = F.coalesce("span", none), F.coalesce("fields", none)
    over = F.map_concat(F.map_filter(span, lambda k, v: ~F.map_contains_key(own, k)), own)
    level = F.lower("level")
    return events.where(number(level) >= number(wanted)).withColumns({"level": level, "fields": over}).drop("span")
