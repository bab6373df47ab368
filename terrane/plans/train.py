"""Training of the duration model from the history, and its registry."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from terrane.operators.duration import DurationModel, evaluate_kfold, fit, tune_alpha
from terrane.operators.history import MODELS_SCHEMA, latest_model


def train_and_save(records: DataFrame, path: str) -> DurationModel:
    """Fit with the default alpha and save."""
    model = fit(records)
    model.save(records.sparkSession, path)
    return model


@dataclass(frozen=True)
class ModelRegistry:
    """Append-only table of trained models; the artifacts lie next to it."""

    spark: SparkSession
    path: str

    def models(self) -> DataFrame:
        return self.spark.read.schema(MODELS_SCHEMA).parquet(f"{self.path}/registry")

    def latest(self) -> DurationModel | None:
        """The model with the highest id, loaded; None before the first training."""
        try:
            rows = latest_model(self.models()).collect()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return DurationModel.load(self.spark, rows[0]["artifact_path"]) if rows else None

    def train(self, records: DataFrame, tunings: dict | None = None) -> tuple[DurationModel, dict]:
        """Tune unless tunings are given, fit with the best alpha, evaluate, save, register.

        The artifact is written before its registry row, so a listed model always loads.
        """
        tunings = tunings or tune_alpha(records)
        alpha = float(tunings["best_alpha"])
        model = fit(records, alpha)
        metrics = evaluate_kfold(records, alpha)
        now = datetime.now(UTC)
        name = f"ExportDurationRidge_{now:%Y%m%d_%H%M%S_%f}"
        artifact = f"{self.path}/models/{name}"
        model.save(self.spark, artifact)
        row = {
            "id": int(now.timestamp() * 1_000_000),
            "created_at": now,
            "model_name": name,
            "model_type": "ridge",
            "parameters": {"alpha": str(alpha)},
            "metrics": {key: str(value) for key, value in metrics.items()},
            "artifact_path": artifact,
        }
        self.spark.createDataFrame([row], MODELS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/registry")
        return model, metrics
