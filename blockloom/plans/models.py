"""Stored model sets: versions under a folder, of which only those with a manifest row count, and their reuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockloom.functions.columns import AsOf, moment
from blockloom.operators import patterns
from blockloom.operators.forecast import FEES
from blockloom.operators.series import needs_retrain
from blockloom.sources import readers, tables

MANIFEST = "kind string, number bigint, model_name string, fee_type string, trained_at timestamp"


class ModelStore:
    """Model sets by kind. A set is a table of models, one row for each lookback and fee, under ``models/kind=k/version=n``.

    The manifest names the models of a version and when they were trained, and is written last: a version that a lost job left without it
    is never read, and the next one takes its number.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self, kind: str) -> DataFrame:
        return readers.read_table(self.spark, f"{self.path}/manifest", MANIFEST).where(F.col("kind") == kind)

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/models/kind={kind}/version={number}"

    def _latest(self, kind: str) -> int:
        return self.manifest(kind).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]

    def save(self, kind: str, models: DataFrame, trained_at: AsOf) -> int:
        """Store a set as the next version of its kind."""
        number = self._latest(kind) + 1
        models.write.mode("overwrite").parquet(self._folder(kind, number))
        # One row without names stands for the version itself, which may hold no model.
        names = self.spark.read.parquet(self._folder(kind, number)).select("model_name", "fee_type").unionByName(
            self.spark.range(1).select(F.lit(None).cast("string").alias("model_name"), F.lit(None).cast("string").alias("fee_type")))
        names.select(F.lit(kind).alias("kind"), F.lit(number).cast("bigint").alias("number"), "model_name", "fee_type",
                     moment(trained_at).alias("trained_at")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/commit={kind}-{number}")
        return number

    def load(self, kind: str, number: int | None = None) -> DataFrame | None:
        """A stored set, the newest one by default; None where there is none."""
        number = number or self._latest(kind)
        return self.spark.read.parquet(self._folder(kind, number)) if number else None

    def gate(self, kind: str, as_of: AsOf, hours: int = 24, fees: list[str] = FEES) -> DataFrame:
        """Per lookback of the newest set: when it was trained, whether it is complete, and whether it must be trained again."""
        log = self.manifest(kind)
        newest = log.where((F.col("number") == log.agg(F.max("number")).scalar()) & F.col("model_name").isNotNull())
        return needs_retrain(newest, as_of, hours, fees)

    def current(self, kind: str, train: Callable[[], DataFrame], as_of: AsOf, hours: int = 24, fees: list[str] = FEES,
                names: list[str] | None = None) -> tuple[DataFrame, bool]:
        """The newest set if it is young and complete (with all ``names``, if given), else a new one, stored and read back; and whether it was trained now."""
        state = {row["model_name"]: row["retrain"] for row in self.gate(kind, as_of, hours, fees).collect()}  # a row for each lookback
        wanted = names if names is not None else list(state)
        if state and all(not state.get(name, True) for name in wanted) and not any(state.values()):
            return self.load(kind), False
        self.save(kind, train(), as_of)
        return self.load(kind), True


class PatternStore:
    """Versions of the pattern model under a folder; a version counts once its manifest row is written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> DataFrame:
        return readers.read_table(self.spark, f"{self.path}/manifest", "number bigint, trained_at timestamp")

    def save(self, model: patterns.PatternModel, trained_at: AsOf) -> int:
        number = self.versions().agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
        model.save(f"{self.path}/version={number}")
        mark = self.spark.range(1).select(F.lit(number).cast("bigint").alias("number"), moment(trained_at).alias("trained_at"))
        tables.write_keyed(mark.coalesce(1), f"{self.path}/manifest", "commit", number)
        return number

    def load(self) -> patterns.PatternModel | None:
        number = self.versions().agg(F.max("number")).first()[0]
        return patterns.PatternModel.load(self.spark, f"{self.path}/version={number}") if number else None
