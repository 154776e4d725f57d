"""Training, tuning and scoring with Spark ML. All fits are distributed; the driver holds
parameters and a handful of scores only."""

from __future__ import annotations

import logging
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import combinations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import masked_corr
from ..operators import evaluate as ev
from ..operators.drivers import (
    contributions,
    global_driver_ranking,
    group_importance,
    importance_rank,
)
from ..operators.encode import dropna_any
from ..operators.panel import by_day
from ..operators.quantiles import quantiles
from ..operators.splits import hash_bucket, rolling_origin_folds
from ..schema import DAY, ID, PROFILE, SLOTS
from ..session import cut_lineage, stored, with_scalars

log = logging.getLogger(__name__)

# search space of the random draw
SPACE = {
    "maxDepth": [3, 4, 5, 6],
    "stepSize": [0.05, 0.1, 0.2, 0.3],
    "subsamplingRate": [0.6, 0.8, 1.0],
    "minInstancesPerNode": [1, 5, 10],
    "featureSubsetStrategy": ["all", "0.8", "0.6"],
}
ROWS_AT_ONCE = 40_000_000  # train rows of the trials of a search that run side by side
DEFAULTS = {"maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 1}


# --- load archetypes -----------------------------------------------------------------


def kmeans_load_shapes(df: DataFrame, k: int = 8, seed: int = 42, hh: str = PROFILE) -> tuple[DataFrame, float]:
    """Cluster households by their mean daily profile: (LCLid, cluster) and the silhouette."""
    means = df.groupBy(ID).agg(*[F.expr(f"avg(get({hh}, {i}))").alias(f"s{i}") for i in range(SLOTS)])
    filled = [F.expr(f"coalesce(s{i}, 0D)") for i in range(SLOTS)]
    return _kmeans(means.select(ID, array_to_vector(F.array(*filled)).alias("raw")), ID, k, seed)


def kmeans_vectors(df: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> tuple[DataFrame, float]:
    """As kmeans_load_shapes for rows that already hold one array per key."""
    return _kmeans(df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw")), key, k, seed)


def _kmeans(vectors: DataFrame, key: str, k: int, seed: int) -> tuple[DataFrame, float]:
    model = Pipeline(
        stages=[
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"),
        ]
    ).fit(vectors)
    labelled = model.transform(vectors)
    score = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(labelled)
    return labelled.select(key, "cluster"), score


# --- boosted trees -------------------------------------------------------------------


def _assembled(features: Sequence[str], regressor) -> Pipeline:
    """Rows with a NULL input pass through as NaN: fits drop them first, predicted() marks them."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assemble, regressor])


@dataclass
class LinearScorer:
    """A linear model with given coefficients, as one column expression."""

    coefs: dict[str, float]
    intercept: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        total = F.lit(float(self.intercept))
        for c, b in self.coefs.items():
            total = total + F.lit(float(b)) * F.col(c)
        return df.withColumn("prediction", total)


def inputs_of(model) -> list[str]:
    return list(model.coefs) if isinstance(model, LinearScorer) else list(model.stages[0].getInputCols())


def predicted(model, df: DataFrame) -> DataFrame:
    """`df` with `prediction`, NULL where an input is missing. No row is lost."""
    out = model.transform(df)
    if isinstance(model, LinearScorer):
        return out
    known = F.lit(True)
    for c in inputs_of(model):
        known = known & F.col(c).isNotNull()
    return out.withColumn("prediction", F.when(known, F.col("prediction"))).drop("features")


def fit_boosted_trees(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    params: dict | None = None,
    rounds: int = 20,
    seed: int = 42,
    early_stopping: bool = True,
) -> PipelineModel:
    """Boosting on train with the val rows for early stopping, then a refit on both with the
    number of trees that was kept. Only the training rows and columns are kept, in the shared folder,
    so that all passes read them there and the memory is left to the trees."""
    used = df.select(*features, F.col(label).cast("double").alias("label"), "split")
    used = dropna_any(used.where(F.col("split").isin("train", "val")), [*features, "label"])
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    rows = cut_lineage(assemble.transform(used).select("features", "label", "split"))
    trees = boost(rows, params, rounds, seed, early_stopping)
    return PipelineModel(stages=[assemble, trees])


def boost(rows: DataFrame, params: dict | None = None, rounds: int = 20, seed: int = 42, early_stopping: bool = True) -> GBTRegressionModel:
    """fit_boosted_trees on rows that hold `features`, `label` and `split` (train, val)."""
    p = {**DEFAULTS, **(params or {})}
    if early_stopping:
        trial = GBTRegressor(labelCol="label", seed=seed, maxIter=rounds, validationIndicatorCol="is_val", **p)
        rounds = trial.fit(rows.withColumn("is_val", F.col("split") == "val")).getNumTrees
    return GBTRegressor(labelCol="label", seed=seed, maxIter=rounds, **p).fit(rows)


def tune_boosted_trees(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    n_trials: int = 10,
    rounds: int = 20,
    folds: int = 2,
    gap: int = 7,
    seed: int = 42,
    parallel: int = 4,
) -> tuple[dict, list[dict]]:
    """Seeded random search with successive halving: the best parameters and all trials.

    `n_trials` draws start with a quarter of `rounds` on the last of `folds` time-ordered folds of
    the train and val rows. The better half goes on with twice the rounds, and so on; the last
    race has all rounds and all folds. A trial is fitted before a fold's test days, less
    `gap` days, and scored by RMSE on them. The folds are written once as vectors. What a trial reads
    again and again, a fold's train or test rows, is kept on the executors' disks in the partitions of
    those files, so that no pass unpacks the rows of other folds and the memory is left to the trees.
    Trials of a race run side by side, `parallel` at a time, fewer where the train rows they keep in
    memory would pass ROWS_AT_ONCE: large folds fill the cores one by one.
    A trial that fails is logged and leaves the search; if all fail the first error is raised.
    """
    draw = random.Random(seed)
    used = df.where(F.col("split").isin("train", "val"))
    used = dropna_any(used.select(ID, DAY, *features, F.col(label).cast("double").alias("label")), [*features, "label"])
    used = rolling_origin_folds(used, folds, gap).repartition("fold", ID).sortWithinPartitions("fold", ID, DAY)
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    used = cut_lineage(assemble.transform(used).select("fold", "role", "label", "features"))
    largest = used.where("role = 'train'").groupBy("fold").count().agg(F.max("count")).first()[0] or 0
    parallel = max(1, min(parallel, ROWS_AT_ONCE // max(largest, 1)))
    trials = [{"trial": i, "params": {k: draw.choice(v) for k, v in SPACE.items()}, "rounds": 0, "rmse": None} for i in range(n_trials)]
    kept: dict[tuple[int, str], DataFrame] = {}

    def race(trial: dict, n: int, on: Sequence[int]) -> None:
        try:
            errors = []
            for fold in on:
                tree = GBTRegressor(labelCol="label", seed=seed, maxIter=n, **trial["params"])
                model = tree.fit(kept[fold, "train"])
                scored = model.transform(kept[fold, "test"])
                scored = scored.select(F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
                errors.append(scored.agg(ev.rmse()).first()[0])
            trial.update(rounds=n, rmse=sum(errors) / len(errors))
        except Exception as e:  # one failed trial must not stop the search
            log.warning("trial %s failed: %s", trial["params"], e)
            trial.update(rounds=n, rmse=None, error=e)

    steps = max(1, rounds // 4), max(1, rounds // 2), rounds
    running = trials
    try:
        with ThreadPoolExecutor(parallel) as pool:
            for i, n in enumerate(steps):
                on = range(1, folds + 1) if n == rounds else [folds]
                for fold in on:
                    for role in ("train", "test"):
                        if (fold, role) not in kept:
                            part = used.where((F.col("fold") == fold) & (F.col("role") == role))
                            kept[fold, role] = part.select("label", "features").persist(StorageLevel.DISK_ONLY)
                list(pool.map(lambda t: race(t, n, on), running))  # noqa: B023
                good = sorted((t for t in running if t["rmse"] is not None), key=lambda t: (t["rmse"], t["trial"]))
                if not good:
                    raise RuntimeError("every trial failed") from running[0]["error"]
                running = good if i == len(steps) - 1 else good[: max(1, len(good) // 2)]
    finally:
        for part in kept.values():
            part.unpersist()
    return running[0]["params"], trials


def fit_tuned(df: DataFrame, features: Sequence[str], label: str, rounds: int = 20, seed: int = 42, **search) -> tuple[PipelineModel, dict]:
    """The best parameters of the search refitted on train and val: (model, parameters)."""
    best, _ = tune_boosted_trees(df, features, label, rounds=rounds, seed=seed, **search)
    return fit_boosted_trees(df, features, label, best, rounds, seed), best


def score_splits(
    model: PipelineModel, df: DataFrame, label: str, keys: Sequence[str] = (ID, DAY, "split")
) -> DataFrame:
    """Actual and predicted beside the keys, one row for each row of `df`. A row with a missing
    input has a NULL y_pred, one without label a NULL y_true; the metrics leave both out."""
    out = predicted(model, df)
    return out.select(*keys, F.col(label).cast("double").alias("y_true"), F.col("prediction").alias("y_pred"))


def feature_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], top_n: int = 15) -> DataFrame:
    """Gain ranking with feature names: one small row per input column."""
    gains = model.stages[-1].featureImportances.toArray().tolist()
    rows = [F.struct(F.lit(f).alias("feature"), F.lit(float(g)).alias("importance")) for f, g in zip(features, gains)]
    table = df.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return importance_rank(table, "importance").where(F.col("rank") <= top_n)


# --- linear driver model ---------------------------------------------------------------


def fit_linear(df: DataFrame, features: Sequence[str], label: str, reg: float = 0.0) -> tuple[PipelineModel, dict, float]:
    used = dropna_any(df.select(*features, F.col(label).cast("double").alias("label")), [*features, "label"])
    model = _assembled(features, LinearRegression(labelCol="label", regParam=reg)).fit(used)
    lin = model.stages[-1]
    return model, dict(zip(features, lin.coefficients.toArray().tolist())), float(lin.intercept)


def driver_report(
    df: DataFrame, features: Sequence[str], target: str, groups: dict, scorer: LinearScorer | None = None
) -> DataFrame:
    """One row: quality of a linear driver model (fitted here, or given), its top driver and its top
    group. The rows are written once to the shared folder; the fit, the scores and the contributions
    read them there."""
    known = stored(dropna_any(df.select(*dict.fromkeys([ID, DAY, "split", *features, target])), [*features, target]), "drivers")
    if scorer is None:
        model, coefs, intercept = fit_linear(known.where("split = 'train'"), features, target)
    else:
        model, coefs, intercept = scorer, scorer.coefs, scorer.intercept
    scored = score_splits(model, known, target)
    test = ev.model_quality_label(ev.driver_performance(scored).where("split = 'test'"))
    contrib = contributions(known.where("split = 'test'"), coefs, intercept)
    top = global_driver_ranking(contrib).where("rank = 1").select(F.col("feature").alias("top_driver"))
    group = group_importance(contrib, groups).where("rank = 1").select(F.col("group").alias("top_group"))
    return (
        test.crossJoin(F.broadcast(top))
        .crossJoin(F.broadcast(group))
        .withColumn("total_features", F.lit(len(features)))
        .withColumn("feature_groups", F.lit(len([g for g, cs in groups.items() if cs])))
    )


# --- model studies -----------------------------------------------------------------------


def partial_dependence(
    model, df: DataFrame, features: str | Sequence[str], grid: int = 10, low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """(feature, grid_index, grid_value, mean_prediction): the average prediction when one feature is
    set to each of `grid` values between two of its quantiles, for several features in one pass.

    The quantiles of all features come from one long table. Each row is then expanded to one row
    per feature and grid value, which are averaged with map-side combination.
    """
    names = [features] if isinstance(features, str) else list(features)
    inputs = inputs_of(model)
    values = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in names]
    q = quantiles(df.select(F.inline(F.array(*values))), "v", [low, high], ["feature"])
    step = (F.col("q")[1] - F.col("q")[0]) / (grid - 1)
    points = F.transform(
        F.sequence(F.lit(0), F.lit(grid - 1)),
        lambda i: F.struct("feature", i.alias("grid_index"), (F.col("q")[0] + i * step).alias("grid_value")),
    )
    # one row with features x grid points
    table = q.select(points.alias("p")).agg(F.flatten(F.collect_list("p")).alias("__points"))
    rows = with_scalars(df.select(*inputs), table).select(*inputs, F.explode("__points").alias("__at"))
    at = F.col("__at")
    rows = rows.withColumns({f: F.when(at["feature"] == f, at["grid_value"]).otherwise(F.col(f)) for f in names})
    return (
        predicted(model, rows)
        .groupBy(at["feature"].alias("feature"), at["grid_index"].alias("grid_index"))
        .agg(F.first(at["grid_value"]).alias("grid_value"), F.avg("prediction").alias("mean_prediction"))
    )


def shuffled_neighbour(df: DataFrame, cols: Sequence[str], seed: int = 42, bins: int | None = None) -> DataFrame:
    """Each row with `__donor`, the struct of `cols` of another row.

    Rows are dealt to bins by a hash of their key and stand in hash order there; the donor is the
    next row of the bin, the bin's last row takes its first. That is a permutation of all rows in
    which none keeps its own values (but in a bin of one row), made with one exchange.
    """
    bins = bins or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (ID, DAY)])
    df = df.withColumns({"__hash": F.md5(text), "__bin": hash_bucket([ID, DAY], seed, bins)})
    w = Window.partitionBy("__bin").orderBy("__hash", ID, DAY)
    own = F.struct(*cols)
    start = F.first(own).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("__donor", F.coalesce(F.lead(own).over(w), start)).drop("__hash", "__bin")


def permutation_importance(
    model,
    df: DataFrame,
    features: Sequence[str],
    label: str,
    shuffle: Sequence[str] | None = None,
    seed: int = 42,
    bins: int | None = None,
) -> DataFrame:
    """(feature, rmse, rmse_rise): the rise of RMSE when one input column (each of `shuffle`, all
    inputs by default) is exchanged among the rows.

    One mapping of donors serves all features: a donor's inputs stand beside the row, and each row is
    expanded to itself and one row per feature. So the number of exchanges does not depend on the
    number of features. Rows with a missing input or label are left out.
    """
    names = list(shuffle or features)
    base = dropna_any(df.select(ID, DAY, *features, F.col(label).cast("double").alias("__y")), [*features, "__y"])
    rows = shuffled_neighbour(base, names, seed, bins)
    rows = rows.select("*", F.explode(F.array(F.lit(""), *[F.lit(f) for f in names])).alias("__swap"))
    rows = rows.withColumns({f: F.when(F.col("__swap") == f, F.col("__donor")[f]).otherwise(F.col(f)) for f in names})
    error = F.col("prediction") - F.col("__y")
    scored = predicted(model, rows).groupBy("__swap").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    # one row per feature: put together in one row and taken apart again
    plain = F.max(F.when(F.col("__swap") == "", F.col("rmse"))).alias("base")
    whole = scored.agg(plain, F.collect_list(F.struct(F.col("__swap").alias("feature"), "rmse")).alias("all"))
    out = whole.select("base", F.inline("all")).where("feature <> ''")
    return out.select("feature", "rmse", (F.col("rmse") - F.col("base")).alias("rmse_rise"))


def recent_values(history: DataFrame, n: int, target: str) -> DataFrame:
    """(household, last day, recent): each household's last `n` values, oldest first, NULLs in place
    and in front of a shorter history. Tasks keep n rows per household before the exchange."""
    newest = Window.partitionBy(ID).orderBy(F.desc(DAY))
    last = history.select(ID, DAY, F.col(target).cast("double").alias("v"), F.row_number().over(newest).alias("r")).where(F.col("r") <= n)
    rows = last.groupBy(ID).agg(F.max(DAY).alias(DAY), F.sort_array(F.collect_list(F.struct(DAY, "v"))).alias("s"))
    values = F.transform("s", lambda x: x["v"])
    blank = F.array_repeat(F.lit(None).cast("double"), F.lit(n) - F.size("s"))
    return rows.select(ID, DAY, F.concat(blank, values).alias("recent"))


def recursive_forecast(model, history: DataFrame, horizon: int, target: str = "total_kwh") -> DataFrame:
    """(household, day, step, y_pred): day-ahead predictions fed back as readings for `horizon` steps.

    The model's inputs are lag1/lag7/lag14 and the 7/14-row means of the target (over the known
    values), refreshed each step from a ring of the household's last 14 values. Every household
    comes back at every step; y_pred is NULL where the model needs a lag that is not known. The
    lineage is cut each step so the plan does not grow with the horizon.
    """
    state = recent_values(history, 14, target)
    known = inputs_of(model)
    out = None
    for step in range(1, horizon + 1):
        tail = F.col("recent")

        def mean(n: int) -> Column:
            values = F.filter(F.slice(tail, 15 - n, n), lambda x: x.isNotNull())
            return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))

        fresh = {
            "lag1_total": F.get(tail, F.lit(13)),
            "lag7_total": F.get(tail, F.lit(7)),
            "lag14_total": F.get(tail, F.lit(0)),
            "roll7_total_mean": mean(7),
            "roll14_total_mean": mean(14),
        }
        inputs = state.withColumns({c: v for c, v in fresh.items() if c in known})
        scored = predicted(model, inputs).select(
            ID,
            F.date_add(DAY, 1).alias(DAY),
            F.concat(F.slice("recent", 2, 13), F.array("prediction")).alias("recent"),
            F.col("prediction").alias("y_pred"),
        )
        scored = cut_lineage(scored)
        one = scored.select(ID, DAY, F.lit(step).alias("step"), "y_pred")
        out = one if out is None else out.unionByName(one)
        state = scored.select(ID, DAY, "recent")
    return out


def pair_correlations(df: DataFrame, features: Sequence[str], at_once: int = 300) -> DataFrame:
    """(a, b, rows, r) of each pair of columns, in the order of `features`: Pearson's r over the rows
    that know both. A row is expanded to one row per pair that it knows, and the moments are combined
    map-side by the pair's number: one short aggregate, whose compiled code does not grow with the
    number of pairs. More than `at_once` pairs take a further scan for each so many. r is NULL where a
    column does not vary."""
    out = None
    pairs = list(combinations(features, 2))
    for i in range(0, len(pairs), at_once):
        part = pairs[i : i + at_once]
        long = [F.struct(F.lit(k).alias("k"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for k, (a, b) in enumerate(part)]
        known = df.select(F.inline(F.array(*long))).where("x is not null and y is not null")
        found = known.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), masked_corr("x", "y").alias("r"))
        # one row of moments by pair: a pair that no row knows is not among them
        one = found.agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("rows", "r")))).alias("m"))
        at = [F.try_element_at("m", F.lit(k)) for k in range(len(part))]
        rows = [
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(m["rows"], F.lit(0)).alias("rows"), m["r"].alias("r"))
            for m, (a, b) in zip(at, part, strict=True)
        ]
        table = one.select(F.inline(F.array(*rows)))
        out = table if out is None else out.unionByName(table)
    return out


def prune_correlated(df: DataFrame, features: Sequence[str], bound: float = 0.95) -> tuple[list[str], DataFrame]:
    """Columns kept after dropping the later one of each pair with |r| above `bound`, and those pairs
    (kept, dropped, r). A NULL in one column does not take the row from the other pairs."""
    r = {(x["a"], x["b"]): x["r"] for x in pair_correlations(df, features).collect()}
    dropped, pairs = set(), []
    for a, b in combinations(features, 2):
        if a not in dropped and r[a, b] is not None and abs(r[a, b]) > bound:
            dropped.add(b)
            pairs.append((a, b, float(r[a, b])))
    schema = "kept string, dropped string, r double"
    return [f for f in features if f not in dropped], df.sparkSession.createDataFrame(pairs, schema)


# --- decomposition -----------------------------------------------------------------------


def seasonal_decompose(df: DataFrame, value: str = "total_kwh", key: str = ID) -> DataFrame:
    """Additive weekly decomposition per key: centred 7-row mean, weekday effect centred to
    zero, remainder.

    All windows start with the key, so one exchange serves them; a key has at most one row
    per day.
    """
    whole = Window.partitionBy(key)
    weekday = Window.partitionBy(key, "dow")
    out = df.select(
        key,
        DAY,
        F.col(value).alias("observed"),
        F.avg(value).over(by_day(key).rowsBetween(-3, 3)).alias("trend"),
        F.weekday(DAY).alias("dow"),
    )
    out = out.select(
        "*",
        F.avg(F.col("observed") - F.col("trend")).over(weekday).alias("__e"),
        (1 / F.count(F.lit(1)).over(weekday)).alias("__w"),  # weights each weekday once
    )
    centre = F.sum(F.col("__e") * F.col("__w")).over(whole) / F.sum("__w").over(whole)
    out = out.withColumn("seasonal", F.col("__e") - centre)
    rest = F.col("observed") - F.col("trend") - F.col("seasonal")
    return out.select(key, DAY, "observed", "trend", "seasonal", rest.alias("remainder"))
