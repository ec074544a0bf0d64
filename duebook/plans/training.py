"""Training: raw invoices to an evaluated and saved model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook import schema
from duebook.operators.cleaning import clean_invoices, impute_history
from duebook.operators.forecast import forecast_holdout, forecast_per_reference_date
from duebook.operators.metrics import (calibration_bins, classification_report, confusion_counts, confusion_matrix,
                                       data_summary, metric_terms)
from duebook.operators.models import score, train_classifier
from duebook.operators.search import backtest_summary, walk_forward
from duebook.operators.snapshots import build_snapshots
from duebook.operators.splits import time_split
from duebook.session import materialise
from duebook.sources.writers import save_model, stamp, write_history, write_metrics


@dataclass
class TrainingRun:
    """What a training run leaves behind; every table is a DataFrame."""

    model: PipelineModel
    snapshots: DataFrame
    metrics: DataFrame
    per_reference_date: DataFrame
    report: DataFrame
    confusion: DataFrame
    calibration: DataFrame
    summary: DataFrame
    backtest: DataFrame
    backtest_summary: DataFrame


def train(raw: DataFrame, classifier: Estimator | None = None, backtest_classifier: Estimator | None = None) -> TrainingRun:
    """Clean, snapshot, split by time, fit, evaluate on the holdout and by walk-forward backtests.

    The clean table and the snapshot table have many readers, so each is written once to the shared folder.
    """
    clean = materialise(clean_invoices(raw), "clean")
    # Cutoffs and splits read a range of dates each.
    snapshots = materialise(impute_history(build_snapshots(clean)), "snapshots", partition_by="reference_date")
    parts = time_split(snapshots)
    fit_part, test_part = parts.where("part = 'train'"), parts.where("part = 'test'")
    model = train_classifier(fit_part, classifier)
    scored = materialise(score(model, test_part.drop("part")), "holdout")
    metrics = forecast_holdout(scored, means=metric_terms())
    folds = materialise(walk_forward(snapshots, backtest_classifier or classifier), "backtest")
    return TrainingRun(
        model=model, snapshots=snapshots, metrics=metrics,
        per_reference_date=forecast_per_reference_date(scored),
        report=classification_report(confusion_counts(scored)), confusion=confusion_matrix(scored),
        calibration=calibration_bins(scored), summary=data_summary(fit_part, test_part, schema.MODEL_FEATURES),
        backtest=folds, backtest_summary=backtest_summary(folds))


def save_run(run: TrainingRun, root: str, name: str | None = None) -> str:
    """Write metrics, reports and the model of a run; returns the run's name."""
    name = name or stamp()
    tables = {"metrics": run.metrics, "per_reference_date": run.per_reference_date, "report": run.report,
              "confusion": run.confusion, "calibration": run.calibration, "summary": run.summary,
              "backtest": run.backtest, "backtest_summary": run.backtest_summary}
    for table, df in tables.items():
        write_metrics(df, f"{root}/{table}", name)
    save_model(run.model, f"{root}/models", name)
    return name


def refresh_history(raw: DataFrame, as_of: Column, path: str) -> None:
    """Rewrite the history table from the raw invoices, features as of a date."""
    write_history(clean_invoices(raw), raw.dropDuplicates(), F.to_date(as_of), path)
