"""Date, household and hash splits; sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DAY, ID
from ..session import with_scalars


def _labelled(df: DataFrame, val: Column, test: Column) -> DataFrame:
    return df.withColumn("split", F.when(test, "test").when(val, "val").otherwise("train"))


def split_by_date(df: DataFrame, val_days: int = 30, test_days: int = 90, day: str = DAY) -> DataFrame:
    """Cutoffs counted back from the last day; a cutoff day belongs to the earlier split."""
    cut = df.agg(F.max(day).alias("__m")).select(
        F.date_sub("__m", test_days).alias("__t"), F.date_sub("__m", test_days + val_days).alias("__v")
    )
    out = with_scalars(df, cut)
    return _labelled(out, F.col(day) > F.col("__v"), F.col(day) > F.col("__t")).drop("__t", "__v")


def split_by_date_halfopen(df: DataFrame, val_start: str, test_start: str, day: str = DAY) -> DataFrame:
    """train < val_start <= val < test_start <= test."""
    d = F.col(day)
    return _labelled(df, d >= F.to_date(F.lit(val_start)), d >= F.to_date(F.lit(test_start)))


def _calendar(df: DataFrame, day: str = DAY) -> DataFrame:
    """One row with the sorted distinct days: no longer than the calendar."""
    return df.agg(F.sort_array(F.collect_set(day)).alias("__days"))


def split_by_date_position(
    df: DataFrame, val_days: int = 30, test_days: int = 90, day: str = DAY
) -> DataFrame:
    """Cutoffs by position among the distinct days."""
    days = F.col("__days")
    cut = _calendar(df, day).select(
        F.get(days, F.size(days) - test_days).alias("__t"),
        F.get(days, F.size(days) - test_days - val_days).alias("__v"),
    )
    out = with_scalars(df, cut)
    return _labelled(out, F.col(day) >= F.col("__v"), F.col(day) >= F.col("__t")).drop("__t", "__v")


def split_per_household(df: DataFrame, val_days: int = 60, test_days: int = 90) -> DataFrame:
    """Each household's own cutoffs: its test_days-th and (test_days+val_days)-th last day.

    Households with fewer distinct days are left out.
    """
    w = Window.partitionBy(ID)
    r = F.dense_rank().over(w.orderBy(F.desc(DAY)))
    out = df.withColumn("__r", r).withColumn("__n", F.max("__r").over(w))
    total = val_days + test_days
    kept = out.where(F.col("__n") >= total)
    return _labelled(kept, F.col("__r") < total, F.col("__r") < test_days).drop("__r", "__n")


def hash_bucket(cols: Sequence[str], seed: int, buckets: int) -> Column:
    """Stable pseudo-random bucket of a key: the same for every run and partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets


def split_random(
    df: DataFrame, test_share: float = 0.2, seed: int = 42, keys: Sequence[str] = (ID, DAY)
) -> DataFrame:
    b = hash_bucket(keys, seed, 1000)
    return df.withColumn("split", F.when(b < int(test_share * 1000), "test").otherwise("train"))


def rolling_origin_folds(df: DataFrame, n_splits: int = 5, gap: int = 7, day: str = DAY) -> DataFrame:
    """Time-ordered folds: each row with fold and role.

    The days are cut into n_splits + 1 equal runs; fold i tests on run i + 1 and trains on
    the days before it, `gap` days left out. A row appears once per fold it takes part in.
    """
    days = F.col("__days")
    size = F.floor(F.size(days) / (n_splits + 1)).cast("int")
    folds = F.transform(
        F.sequence(F.lit(0), F.lit(n_splits - 1)),
        lambda i: F.struct(
            (i + 1).cast("int").alias("fold"),
            F.get(days, (F.size(days) - (n_splits - i) * size - gap).cast("int")).alias("train_end"),
            F.get(days, (F.size(days) - (n_splits - i) * size).cast("int")).alias("test_start"),
            F.get(days, (F.size(days) - (n_splits - i - 1) * size).cast("int")).alias("test_end"),
        ),
    )
    bounds = _calendar(df, day).select(folds.alias("__f"))
    out = with_scalars(df, bounds).select(*df.columns, F.explode("__f").alias("__b"))
    d, b = F.col(day), F.col("__b")
    role = F.when(d < b["train_end"], "train").when(
        (d >= b["test_start"]) & (b["test_end"].isNull() | (d < b["test_end"])), "test"
    )
    return out.select(*df.columns, b["fold"].alias("fold"), role.alias("role")).where("role is not null")


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(ID).alias("households"),
        F.min(DAY).alias("first_day"),
        F.max(DAY).alias("last_day"),
    )


# --- sampling ------------------------------------------------------------------


def select_scope(df: DataFrame, scope: str | Sequence[str] | DataFrame | None = None) -> DataFrame:
    """All households, one id, a list of ids, or the ids of a frame."""
    if scope is None:
        return df
    if isinstance(scope, DataFrame):
        return df.join(scope.select(ID), ID, "left_semi")
    ids = [scope] if isinstance(scope, str) else list(scope)
    return df.where(F.col(ID).isin(ids))


def sample_households(df: DataFrame, n: int) -> DataFrame:
    """n distinct ids, the same on every run: smallest hashes, kept map-side."""
    return df.select(ID).distinct().orderBy(F.md5(ID), ID).limit(n)


def sample_households_per_cluster(df: DataFrame, n: int, cluster: str = "cluster") -> DataFrame:
    """Up to n households per cluster. Spark prunes each task to n rows per cluster before
    the exchange, so a big cluster is not gathered."""
    pairs = df.select(cluster, ID).distinct()
    w = Window.partitionBy(cluster).orderBy(F.md5(ID), ID)
    return pairs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def sample_rows(df: DataFrame, n: int, keys: Sequence[str] = (ID, DAY)) -> DataFrame:
    """Exactly n rows (or all): smallest key hashes."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    return df.orderBy(F.md5(text), *keys).limit(n)
