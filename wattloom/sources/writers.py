"""Sinks for the feature table and for fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DAY, ID


def write_features(df: DataFrame, path: str, mode: str = "overwrite", files_per_month: int | None = None) -> None:
    """Parquet by calendar month, rows clustered by household inside the files.

    Rebalancing by month cuts a month that holds more than the advisory partition size into as many
    tasks as its rows need, each a part of the households if the rows come dealt by household. So
    what a task sorts does not grow with the table, and the rows are not sampled (made twice) for
    bounds. With `files_per_month` as many ranges of (month, household) are written instead.
    """
    out = df.withColumn("month_start", F.trunc(DAY, "MM"))
    if files_per_month:
        out = out.repartitionByRange(files_per_month, "month_start", ID, DAY)
    else:
        out = out.hint("rebalance", "month_start")
    out = out.sortWithinPartitions("month_start", ID, DAY)
    out.write.mode(mode).partitionBy("month_start").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
