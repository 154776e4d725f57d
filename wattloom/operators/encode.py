"""Encoders, scalers and NULL handling for model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import nan_to_null, ratio
from ..schema import ID
from ..session import with_scalars
from .quantiles import rank_values


def label_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): sorted distinct non-NULL values numbered from 0, as int at every size.

    Numbered by ordered bins, with no single-task sort; more values than an int holds raise.
    """
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    return rank_values(values, [col]).select(col, F.col("code").cast("int").alias(out))


def encode_labels(df: DataFrame, col: str, out: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Add the code of each value, learnt on `fit_on` or on the table itself."""
    return df.join(label_codes(df if fit_on is None else fit_on, col, out), col, "left")


def encode_category_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sorted category codes in place, NULL -> -1."""
    for c in cols:
        out = f"{c}_code"
        df = encode_labels(df, c, out).withColumn(out, F.coalesce(out, F.lit(-1)))
    return df


def fit_apply_encoder(
    train: DataFrame, other: DataFrame, col: str, out: str, unseen: str = "error"
) -> DataFrame:
    """Codes learnt on `train`, applied to `other`: an unseen value raises, or gets the next
    code (unseen="keep")."""
    codes = label_codes(train, col, out)
    joined = other.join(codes, col, "left")
    if unseen == "keep":
        size = codes.agg(F.count(F.lit(1)).cast("int").alias("__k"))
        return with_scalars(joined, size).withColumn(out, F.coalesce(out, "__k")).drop("__k")
    bad = F.col(out).isNull() & F.col(col).isNotNull()
    message = F.concat(F.lit(f"unseen value in {col}: "), F.col(col).cast("string"))
    return joined.withColumn(out, F.when(bad, F.raise_error(message).cast("int")).otherwise(F.col(out)))


def scale_standard(df: DataFrame, cols: Sequence[str], fit_on=None) -> DataFrame:
    """z-scores with the mean and population std of the fitted rows (constant column -> 0)."""
    src = df if fit_on is None else df.where(fit_on)
    stats = src.agg(
        *[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols]
    )
    scaled = {
        f"{c}_z": (F.col(c) - F.col(f"__m_{c}"))
        / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))
        for c in cols
    }
    helper = [f"__{x}_{c}" for x in "ms" for c in cols]
    return with_scalars(df, stats).withColumns(scaled).drop(*helper)


def unscale_standard(df: DataFrame, col: str, reference: DataFrame, ref_col: str, out: str) -> DataFrame:
    """Back from z-scores with the statistics of `ref_col` in `reference`."""
    stats = reference.agg(F.avg(ref_col).alias("__m"), F.stddev_pop(ref_col).alias("__s"))
    s = F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    return with_scalars(df, stats).withColumn(out, F.col(col) * s + F.col("__m")).drop("__m", "__s")


def scale_robust(df: DataFrame, col: str, by: str = ID) -> DataFrame:
    """(x - median) / IQR per series, as a window: a series is no longer than the calendar, so
    the plain percentile is bounded here."""
    p = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = F.col("__q")
    return (
        df.withColumn("__q", F.percentile(col, p).over(Window.partitionBy(by)))
        .withColumn(f"{col}_robust", ratio(F.col(col) - q[1], q[2] - q[0]))
        .drop("__q")
    )


def log_target(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in cols})


def invert_log(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.expm1(c) for c in cols})


def dropna_any(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which all of `cols` are known (neither NULL nor NaN).

    One test per column: na.drop makes a single test of all columns, and where that is pushed below
    a projection of many columns Catalyst's constraints double with each of them.
    """
    kinds = dict(df.dtypes)
    for c in cols:
        x = F.col(f"`{c}`")
        df = df.where(x.isNotNull() & ~F.isnan(x) if kinds[c] in ("double", "float") else x.isNotNull())
    return df


def dropna_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows before and after dropping, in one pass."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(whole).alias("rows_after"))


def cast_numeric_coerce(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text -> double; what does not parse becomes NULL."""
    return df.withColumns({c: nan_to_null(F.col(c).try_cast("double")) for c in cols})
