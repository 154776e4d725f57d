"""The forecasting job: text inputs encoded by what the train rows hold, a log target, boosted
trees, and scores back in kWh. Everything fitted is kept together and can be saved and loaded."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluate as ev
from ..operators.quantiles import rank_values
from ..schema import DAY, ID
from ..session import cut_lineage, scratch_path, settings, stored
from .feature_table import Prepared
from .training import boost

CODES = "value string, code int"
# how tables of many inputs are written, and how much of them a task reads: it sorts half a million rows or so
COMPACT = {"compression": "zstd", "maxRecordsPerFile": 500_000}
SHORT_TASKS = {"spark.sql.files.maxPartitionBytes": "16m"}
# how partitions are put together depends on which stage ends first; files are the same in each run without
SAME_FILES = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}


def text_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if isinstance(kinds[c], T.StringType)]


def as_vector(df: DataFrame) -> DataFrame:
    """The inputs in `__x` as `features`; a missing one is NaN."""
    return df.withColumn("features", array_to_vector(F.transform("__x", lambda v: F.coalesce(v, F.lit(float("nan"))))))


def fit_codes(train: DataFrame, cols: Sequence[str], path: str) -> dict[str, int]:
    """Sorted distinct values of each text column numbered from 0, one small table per column under
    `path`; returns how many each has. All columns are counted in one scan, and numbered by ordered
    bins, so a column may have as many values as there are households."""
    if not cols:
        return {}
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols]
    values = train.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).distinct()
    codes = rank_values(values, ["value"], ["column"])
    codes.select("column", "value", F.col("code").cast("int").alias("code")).write.partitionBy("column").parquet(path)
    spark = train.sparkSession
    found = spark.read.schema(f"{CODES}, column string").parquet(path).groupBy("column").count().collect()
    return {c: 0 for c in cols} | {r["column"]: r["count"] for r in found}


@dataclass
class ForecastModel:
    """A fitted forecaster. `codes` is the folder of its encoders, `sizes` how many values each has,
    `fills` what stands for a missing numeric input (none: such rows get no prediction)."""

    trees: GBTRegressionModel | None
    features: list[str]
    sizes: dict[str, int]
    codes: str
    log: bool
    fills: dict[str, float] = field(default_factory=dict)

    def encoded(self, df: DataFrame) -> DataFrame:
        """`df` with its inputs in one array, `__x`: text by its code, -1 for NULL, the next free code
        for a value that the train rows do not have. Code tables are files, so Catalyst knows their
        size and broadcasts the small ones; a table of many households is shuffled.

        One array and not a column per input: a test on many aliased columns makes Catalyst's
        constraints grow with two to the power of their number.
        """
        spark = df.sparkSession
        coded, helpers = [], []
        for i, c in enumerate(self.features):
            if c not in self.sizes:
                x = F.col(c).cast("double")
                coded.append(F.coalesce(x, F.lit(self.fills[c])) if c in self.fills else x)
                continue
            code = F.lit(None)
            if self.sizes[c]:
                table = spark.read.schema(CODES).parquet(f"{self.codes}/column={c}")
                table = table.select(F.col("value").alias(f"__value{i}"), F.col("code").alias(f"__code{i}"))
                df = df.join(table, F.col(c) == F.col(f"__value{i}"), "left")
                helpers += table.columns
                code = F.col(f"__code{i}")
            known = F.when(F.col(c).isNull(), -1).otherwise(F.coalesce(code, F.lit(self.sizes[c])))
            coded.append(known.cast("double"))
        return df.withColumn("__x", F.array(*coded)).drop(*helpers)

    def transform(self, df: DataFrame) -> DataFrame:
        """Every row of `df` with `prediction` in kWh, NULL where a numeric input is missing and
        nothing stands for it."""
        out = self.trees.transform(as_vector(self.encoded(df)))
        p = F.expm1("prediction") if self.log else F.col("prediction")
        return out.withColumn("prediction", F.when(F.forall("__x", lambda v: v.isNotNull()), p)).drop("features", "__x")

    def score(self, df: DataFrame, label: str, keys: Sequence[str] = (ID, DAY, "split")) -> DataFrame:
        """Keys, y_true and y_pred of every row; what is unknown is NULL."""
        out = self.transform(df)
        return out.select(*keys, F.col(label).cast("double").alias("y_true"), F.col("prediction").alias("y_pred"))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.trees.write().overwrite().save(f"{path}/trees")
        facts = json.dumps({"features": self.features, "sizes": self.sizes, "log": self.log, "fills": self.fills})
        spark.range(1).select(F.lit(facts).alias("value")).write.mode("overwrite").text(f"{path}/facts")
        for c, n in self.sizes.items():
            if n:
                table = spark.read.schema(CODES).parquet(f"{self.codes}/column={c}")
                table.write.mode("overwrite").parquet(f"{path}/codes/column={c}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForecastModel:
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        return ForecastModel(GBTRegressionModel.load(f"{path}/trees"), facts["features"], facts["sizes"], f"{path}/codes", facts["log"], facts["fills"])


def fit_forecaster(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    params: dict | None = None,
    rounds: int = 20,
    log: bool = True,
    seed: int = 42,
    early_stopping: bool = True,
    missing: str = "mean",
    compact: bool = False,
) -> ForecastModel:
    """Encoders on the train rows, then trees on train with the val rows for early stopping and a
    refit on both (boost), on log1p of the label unless `log` is off.

    The training rows are written once, in key order and as vectors, so that all boosting passes read
    the same rows, none makes the vectors again, and a second run gives the same trees. They are dealt
    to tasks by household and checkpointed. `compact` is for many inputs: the rows stay in the tasks that
    read them, without an exchange, and are written as compressed Parquet, about a third of the
    checkpoint. Boosting draws rows by task, so the two give trees of other draws. A missing numeric input
    counts as the mean of the train rows (0 if none has a value); with missing="null" such rows are not
    learnt from and get no prediction.
    """
    if missing not in ("mean", "null"):
        raise ValueError("missing must be 'mean' or 'null'")
    features = list(features)
    text = text_columns(df, features)
    codes = scratch_path(df.sparkSession, "codes")
    sizes = fit_codes(df.where("split = 'train'"), text, codes)
    model = ForecastModel(None, features, sizes, codes, log)
    if missing == "mean":
        numbers = [c for c in features if c not in sizes]
        means = df.where("split = 'train'").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numbers]).first() if numbers else {}
        model.fills = {c: means[c] if means[c] is not None else 0.0 for c in numbers}
    y = F.col(label).cast("double")
    rows = model.encoded(df.where(F.col("split").isin("train", "val")))
    rows = rows.select(ID, DAY, "split", "__x", (F.log1p(y) if log else y).alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.forall("__x", lambda v: v.isNotNull()))
    dealt = rows if compact else rows.repartition(ID)
    vectors = as_vector(dealt.sortWithinPartitions(ID, DAY)).select("split", "label", "features")
    if not compact:
        model.trees = boost(cut_lineage(vectors), params, rounds, seed, early_stopping)
        return model
    with settings(df.sparkSession, SHORT_TASKS):
        model.trees = boost(stored(vectors, "vectors", **COMPACT), params, rounds, seed, early_stopping)
    return model


def forecast(prepared: Prepared, household: bool = True, **fit) -> tuple[ForecastModel, DataFrame]:
    """Fit on a prepared table and score all its rows: (model, keys + split + y_true + y_pred). The
    household's code is an input unless `household` is off.

    The table is written once to the shared folder: encoders, means, training rows and scores all
    read it, so its windows and joins run once. It has many inputs: it and the training rows are
    written compactly (see fit_forecaster).
    """
    with settings(prepared.data.sparkSession, SAME_FILES):
        rows = stored(prepared.data, "prepared", **COMPACT)
    inputs = [*prepared.features, ID] if household else list(prepared.features)
    model = fit_forecaster(rows, inputs, prepared.target, **{"compact": True, **fit})
    return model, model.score(rows, prepared.target)


def per_cluster(
    df: DataFrame, features: Sequence[str], label: str, clusters: Sequence, cluster: str = "cluster", **fit
) -> DataFrame:
    """Predictions of one model per cluster and of one global model on all rows. The global model
    has the household's and the cluster's code among its inputs, a cluster's model the household's.

    The columns in use are written once to the shared folder: every model's encoders, means, training
    rows and scores read them, so the windows of `df` do not run again for each.
    """
    keys = [ID, DAY, "split", cluster]
    own = [c for c in features if c not in (ID, cluster)]
    df = stored(df.select(*dict.fromkeys([*keys, *own, label])), "clusters")
    coded = df.withColumn("__c", F.col(cluster).cast("string"))
    whole = fit_forecaster(coded, [*own, ID, "__c"], label, **fit)
    out = whole.score(coded, label, keys).withColumn("model", F.lit("global"))
    for c in clusters:
        part = df.where(F.col(cluster) == c)
        model = fit_forecaster(part, [*own, ID], label, **fit)
        out = out.unionByName(model.score(part, label, keys).withColumn("model", F.lit(f"cluster_{c}")))
    return out


def against_lag(scored: DataFrame, lagged: DataFrame, lag: Column) -> DataFrame:
    """RMSE and MAE by split of a forecast and of a lag taken as forecast, over the rows both know."""
    both = scored.join(lagged.select(ID, DAY, lag.alias("__lag")), [ID, DAY])
    known = both.where("y_true is not null and y_pred is not null and __lag is not null")
    runs = [F.struct(F.lit(m).alias("model"), F.col(c).alias("y_pred")) for m, c in (("trees", "y_pred"), ("lag", "__lag"))]
    long = known.select("split", "y_true", F.inline(F.array(*runs)))
    return long.groupBy("split", "model").agg(ev.rmse().alias("rmse"), ev.mae().alias("mae"), F.count(F.lit(1)).alias("rows"))
