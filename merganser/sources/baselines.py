"""Named baselines as Parquet: filter state by key, with what it was made under."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merganser.operators.novelty import weight

SETTINGS = ("channel_set", "projection", "seed", "cells", "time_base", "sparsity", "rate")


class Incompatible(ValueError):
    """A baseline was made under other settings."""


class Baselines:
    """A folder of baselines: state/name=<name>/version=<n>, and beside each version a row of settings. A save writes a new version and never changes one that is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/settings")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                return None
            raise

    def _latest(self, name: str):
        v = self._versions()
        row = v.filter(F.col("name") == name).orderBy(F.desc("version")).first() if v is not None else None
        if row is None:
            raise KeyError(f"no baseline {name!r}; known: {', '.join(self.names()) or 'none'}")
        return row

    def names(self) -> list[str]:
        v = self._versions()
        return [r.name for r in v.select("name").distinct().orderBy("name").collect()] if v is not None else []

    def save(self, name: str, state: DataFrame, settings: dict, now: float) -> None:
        """`state` is (key, cell, touches, log, weight). The time of creation stays that of the first version."""
        try:
            old = self._latest(name)
            version, created = old.version + 1, old.created
        except KeyError:
            version, created = 1, now
        state.write.parquet(f"{self.path}/state/name={name}/version={version}")
        row = [(name, version, created, now, json.dumps(settings, sort_keys=True))]
        self.spark.createDataFrame(row, "name string, version int, created double, updated double, settings string").coalesce(1).write.mode("append").parquet(f"{self.path}/settings")

    def load(self, name: str, settings: dict) -> DataFrame:
        """The state, if it was made under these settings; otherwise `Incompatible` says which differ."""
        row = self._latest(name)
        had = json.loads(row.settings)
        differ = [k for k in SETTINGS if had.get(k) != settings.get(k) and not (k == "seed" and had.get("projection") == "connectome")]
        if differ:
            raise Incompatible(f"{name!r} differs in " + ", ".join(f"{k}: {had.get(k)!r} not {settings.get(k)!r}" for k in differ))
        return self.spark.read.parquet(f"{self.path}/state/name={name}/version={row.version}")

    def describe(self, name: str) -> DataFrame:
        """keys, touches and saturation by stored weights of the latest version."""
        row = self._latest(name)
        state = self.spark.read.parquet(f"{self.path}/state/name={name}/version={row.version}")
        return state.agg(F.countDistinct("key").alias("keys"), F.sum("touches").alias("touches")).withColumns({"version": F.lit(row.version), "created": F.lit(row.created), "updated": F.lit(row.updated)})


def updated(old: DataFrame, new: DataFrame) -> DataFrame:
    """States added up: touches and logarithms of equal key and cell are summed."""
    both = old.select("key", "cell", "touches", "log").unionByName(new.select("key", "cell", "touches", "log"))
    return both.groupBy("key", "cell").agg(F.sum("touches").alias("touches"), F.sum("log").alias("log")).withColumn("weight", weight(F.col("log")))
