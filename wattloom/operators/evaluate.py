"""Forecast metrics: every figure is one aggregate over the long prediction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import ratio, rows
from ..schema import DAY, ID
from ..session import with_scalars
from .quantiles import pct_rank_true, quantiles

Y, P = "y_true", "y_pred"


def _err() -> Column:
    return F.col(P) - F.col(Y)


def mae() -> Column:
    return F.avg(F.abs(_err()))


def mse() -> Column:
    return F.avg(_err() * _err())


def rmse() -> Column:
    return F.sqrt(mse())


def r2(eps: float = 0.0) -> Column:
    """1 - SSE/SST over rows with a prediction; NULL for a constant target unless eps is given."""
    y = F.when(F.col(P).isNotNull(), F.col(Y))
    return 1 - ratio(F.sum(_err() * _err()), F.var_pop(y) * F.count(y) + F.lit(eps))


def bias() -> Column:
    return F.avg(_err())


def mape(min_actual: float | None = None) -> Column:
    """Mean |error / actual| in % over actuals that are not 0 (or at least `min_actual`)."""
    use = F.col(Y) != 0 if min_actual is None else F.col(Y) >= min_actual
    return F.avg(F.when(use, ratio(F.abs(_err()), F.abs(Y)))) * 100


def smape() -> Column:
    """Mean |error| over the mean magnitude in %, zero denominators left out."""
    return F.avg(ratio(F.abs(_err()), (F.abs(Y) + F.abs(P)) / 2)) * 100


def mape_floor(floor: float = 1e-6) -> Column:
    return F.avg(F.abs(_err()) / F.greatest(F.col(Y), F.lit(floor))) * 100


def forecast_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE, R2 and bias by keys."""
    return df.groupBy(*keys).agg(
        mae().alias("mae"),
        rmse().alias("rmse"),
        mape().alias("mape"),
        r2().alias("r2"),
        bias().alias("bias"),
    )


def metrics_by_split(df: DataFrame) -> DataFrame:
    return forecast_metrics(df, ["split"])


def metrics_by_cluster(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(
        F.round(mae(), 4).alias("mae"),
        F.round(rmse(), 4).alias("rmse"),
        F.round(r2(), 4).alias("r2"),
        F.round(mape(0.1), 2).alias("mape"),
        F.round(smape(), 2).alias("smape"),
        rows().alias("samples"),
    )


def peak_metrics(df: DataFrame, percentile: float = 90.0, approx: bool = False) -> DataFrame:
    """Metrics on rows whose actual reaches the percentile of all actuals."""
    cut = quantiles(df, Y, [percentile / 100], approx=approx).select(F.col("q")[0].alias("threshold"))
    peak = with_scalars(df, cut).where(F.col(Y) >= F.col("threshold"))
    return peak.groupBy("threshold").agg(
        rows().alias("n_samples"),
        mae().alias("mae"),
        rmse().alias("rmse"),
        mape().alias("mape"),
        r2().alias("r2"),
        bias().alias("bias"),
    )


def residual_rows(df: DataFrame, rank: bool = True) -> DataFrame:
    """Residual, its size, % error (NULL at 0) and the percentile rank of the actual."""
    out = df.withColumns(
        {
            "residual": _err(),
            "abs_residual": F.abs(_err()),
            "pct_error": F.abs(ratio(_err(), F.col(Y))) * 100,
        }
    )
    return pct_rank_true(out, Y) if rank else out


def residual_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    res = residual_rows(df, rank=False)
    basic = res.agg(
        F.avg("residual").alias("mean_residual"),
        F.stddev_pop("residual").alias("std_residual"),
        F.avg("abs_residual").alias("mean_abs_residual"),
        F.avg("pct_error").alias("mean_pct_error"),
    )
    q = quantiles(res, "residual", [0.05, 0.5, 0.95], approx=approx).select(
        F.col("q")[0].alias("p5_residual"),
        F.col("q")[1].alias("median_residual"),
        F.col("q")[2].alias("p95_residual"),
    )
    a = quantiles(res, "abs_residual", [0.5], approx=approx).select(
        F.col("q")[0].alias("median_abs_residual")
    )
    return basic.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(a))


def driver_performance(df: DataFrame) -> DataFrame:
    """Metrics by split plus variance explained, mean actual and relative error in %."""
    return df.groupBy("split").agg(
        mae().alias("mae"),
        rmse().alias("rmse"),
        r2().alias("r2"),
        mape().alias("mape"),
        (r2() * 100).alias("variance_explained"),
        F.avg(Y).alias("avg_consumption"),
        (ratio(mae(), F.avg(Y)) * 100).alias("relative_error"),
    )


def model_quality_label(df: DataFrame, r2_col: str = "r2") -> DataFrame:
    r = F.col(r2_col)
    label = F.when(r > 0.95, "EXCELLENT").when(r > 0.80, "GOOD").otherwise("FAIR")
    return df.withColumn("model_quality", label)


def compare_models(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return forecast_metrics(df, by)


def bias_correction(df: DataFrame, on: str = "val") -> DataFrame:
    """Subtract the mean error of one split from every prediction."""
    shift = df.where(F.col("split") == on).agg(F.avg(_err()).alias("__b"))
    corrected = F.col(P) - F.coalesce("__b", F.lit(0.0))
    return with_scalars(df, shift).withColumn("y_pred_corrected", corrected).drop("__b")


def aggregate_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics on the daily sums over all households."""
    daily = df.groupBy(*keys, DAY).agg(F.sum(Y).alias(Y), F.sum(P).alias(P))
    return forecast_metrics(daily, keys)


def actual_vs_predicted(df: DataFrame, n: int = 3) -> DataFrame:
    """Ordered series of n sampled households with the residual."""
    from .splits import sample_households

    ids = sample_households(df, n)
    out = df.join(F.broadcast(ids), ID, "left_semi").withColumn("residual", _err())
    return out.orderBy(ID, DAY)
