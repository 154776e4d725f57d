"""Cleaning, gap filling and the dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import let
from ..functions.profile import missing_slots
from ..schema import (
    DAY,
    HOLIDAY_CATEGORY,
    ID,
    PROFILE,
    REGULAR_DAY,
    SLOTS,
    WEATHER_VALUES,
)
from ..session import with_scalars

MISSING_SHARE, MIN_DAYS = 0.2, 30


# --- readings and profiles -----------------------------------------------------


def pack_readings(
    df: DataFrame, ts: str = "ts", value: str = "kwh", fill: float | None = None, by: str = ID
) -> DataFrame:
    """Long readings -> one row per household and day with the 48-slot array.

    Sums are combined map-side on (household, day, slot); the second grouping gets at most
    48 rows per household and day, so a busy meter does not grow a group.
    """
    from ..functions.profile import slot_of

    t = F.col(ts)
    slots = df.groupBy(by, F.to_date(t).alias(DAY), slot_of(t).alias("slot")).agg(F.sum(value).alias("v"))
    return pack_slots(slots, [by, DAY], fill)


def pack_slots(df: DataFrame, keys: list[str], fill: float | None = None) -> DataFrame:
    """(keys, slot, v), unique by slot -> keys + array of 48.

    Partitioned by the keys first, so the long rows are what travels and the 48-wide hash
    aggregate is partial and final in one stage. collect_list would be sort-based here.
    """
    default = "NULL" if fill is None else repr(float(fill))
    slots = [F.expr(f"max(CASE WHEN slot = {i} THEN v END)").alias(f"__{i}") for i in range(SLOTS)]
    wide = df.repartition(*keys).groupBy(*keys).agg(*slots)
    hh = ", ".join(f"coalesce(__{i}, CAST({default} AS DOUBLE))" for i in range(SLOTS))
    return wide.select(*keys, F.expr(f"array({hh})").alias(PROFILE))


def unpack_profile(df: DataFrame, hh: str = PROFILE) -> DataFrame:
    """48-slot array -> one row per slot with its HH:MM label."""
    from ..functions.profile import slot_label

    return df.select(
        *[c for c in df.columns if c != hh], F.posexplode(hh).alias("slot", "kwh")
    ).withColumn("label", slot_label(F.col("slot")))


def drop_sparse_days(df: DataFrame, share: float = MISSING_SHARE, hh: str = PROFILE) -> DataFrame:
    """Keep days whose missing share is strictly below `share`."""
    return df.where(missing_slots(F.col(hh)) / SLOTS < share)


def keep_active_households(df: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """Keep households with at least `min_days` rows.

    A window, not a semi join: the later per-household windows need the same partitioning,
    so the whole chain has one exchange of the readings.
    """
    w = Window.partitionBy(ID)
    return df.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") >= min_days).drop("__n")


def filter_complete_profiles(
    df: DataFrame, seasons: list[str] | None = None, hh: str = PROFILE
) -> DataFrame:
    out = df.where(F.forall(hh, lambda x: x.isNotNull()))
    return out.where(F.col("season").isin(seasons)) if seasons else out


def interpolated(hh: Column) -> Column:
    """Array with gaps filled linearly by slot; edge gaps copy the nearest known slot."""

    def fill(known: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            near = F.struct(
                F.array_max(F.filter(known, lambda k: k < i)).alias("lo"),
                F.array_min(F.filter(known, lambda k: k > i)).alias("hi"),
            )

            def blend(s: Column) -> Column:
                vlo, vhi = F.get(hh, s["lo"]), F.get(hh, s["hi"])
                share = (i - s["lo"]) / (s["hi"] - s["lo"])
                return F.coalesce(vlo + (vhi - vlo) * share, vlo, vhi)

            return F.coalesce(x, let(near, blend))

        return F.transform(hh, at)

    slots = F.sequence(F.lit(0), F.size(hh) - 1)
    known = F.filter(slots, lambda i: F.get(hh, i).isNotNull())
    return F.when(F.exists(hh, lambda x: x.isNull()), let(known, fill)).otherwise(hh)


def interpolate_profile(df: DataFrame, hh: str = PROFILE) -> DataFrame:
    return df.withColumn(hh, interpolated(F.col(hh)))


# --- dimensions --------------------------------------------------------------


def select_household_cols(df: DataFrame) -> DataFrame:
    return df.select(ID, "Acorn", "Acorn_grouped", "stdorToU")


def select_weather_cols(df: DataFrame) -> DataFrame:
    return df.select(F.to_date("time").alias(DAY), "time", *WEATHER_VALUES)


def normalize_day(df: DataFrame, source: str, out: str = DAY) -> DataFrame:
    """Timestamp or ISO text -> date."""
    rest = [c for c in df.columns if c not in (source, out)]
    return df.select(F.to_date(source).alias(out), *rest)


def dedup_weather_days(df: DataFrame, order: str = "time") -> DataFrame:
    """The earliest record of each day, as a min over a struct: combined map-side, so a day
    with any number of records needs no sort."""
    values = [c for c in df.columns if c not in (DAY, order)]
    return df.groupBy(DAY).agg(F.min(F.struct(order, *values)).alias("s")).select(
        DAY, *[F.col(f"s.{c}").alias(c) for c in values]
    )


def report_duplicate_days(df: DataFrame, day: str = DAY) -> DataFrame:
    return (
        df.groupBy(day)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .orderBy(F.desc("n"), day)
    )


def interpolate_weather_time(
    df: DataFrame, cols: list[str] | None = None, station: str | None = None
) -> DataFrame:
    """Linear in time between known days, then the nearest known day at the edges.

    One row per day (and station), so the window holds a calendar, not the readings.
    """
    cols = cols or WEATHER_VALUES
    part = f"PARTITION BY {f'`{station}`' if station else 0} ORDER BY {DAY}"
    so_far = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    keep = [c for c in df.columns if c not in cols]
    near, filled = [], []
    for c in cols:
        b, a = f"`__b_{c}`", f"`__a_{c}`"
        known = f"CASE WHEN `{c}` IS NOT NULL THEN struct({DAY} AS d, `{c}` AS v) END"
        near.append(f"last({known}, true) OVER ({part} {so_far}) AS {b}")
        # looking ahead is the same growing frame in reverse order: a frame to UNBOUNDED
        # FOLLOWING would be rescanned for every row
        near.append(f"last({known}, true) OVER ({part} DESC {so_far}) AS {a}")
        share = f"try_divide(datediff({DAY}, {b}.d), datediff({a}.d, {b}.d))"
        filled.append(f"coalesce(`{c}`, {b}.v + ({a}.v - {b}.v) * {share}, {b}.v, {a}.v) AS `{c}`")
    return df.selectExpr("*", *near).selectExpr(*[f"`{c}`" for c in keep], *filled)


def map_holiday_category(df: DataFrame, type_col: str = "Type", day_col: str = "Bank holidays") -> DataFrame:
    """day, holiday_type, holiday_category; an unmapped type is a regular day."""
    pairs = [F.lit(x) for kv in HOLIDAY_CATEGORY.items() for x in kv]
    mapped = F.try_element_at(F.create_map(*pairs), F.col(type_col))
    return df.select(
        F.to_date(day_col).alias(DAY),
        F.col(type_col).alias("holiday_type"),
        F.coalesce(mapped, F.lit(REGULAR_DAY)).alias("holiday_category"),
    )


def unique_days(df: DataFrame) -> DataFrame:
    """One row per day: the smallest by its columns in order, combined map-side."""
    rest = [c for c in df.columns if c != DAY]
    return df.groupBy(DAY).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__s")).select(
        DAY, *[F.col("__s").getField(c).alias(c) for c in rest]
    )


def unique_holidays(df: DataFrame) -> DataFrame:
    """One holiday per day (lowest category, then type), so the join cannot copy readings."""
    return df.groupBy(DAY).agg(F.min(F.struct("holiday_category", "holiday_type")).alias("s")).select(
        DAY, "s.holiday_type", "s.holiday_category"
    )


# --- joins -------------------------------------------------------------------


def join_household(df: DataFrame, household: DataFrame) -> DataFrame:
    """Left join on the household. No hint: a table whose files are small is broadcast by Catalyst,
    a bigger one is shuffled, and AQE may still change that by the bytes it sees."""
    return df.join(household, ID, "left")


def join_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join on day, each day once (see unique_days), so doubled weather rows copy no readings.
    What is broadcast has one row per calendar day whatever is passed in."""
    return df.join(F.broadcast(unique_days(weather)), DAY, "left")


def join_holiday(df: DataFrame, holiday: DataFrame) -> DataFrame:
    return df.join(F.broadcast(unique_holidays(holiday)), DAY, "left")


def fill_holiday_default(df: DataFrame) -> DataFrame:
    return df.withColumn("holiday_category", F.coalesce("holiday_category", F.lit(REGULAR_DAY)))


def merge_all(df: DataFrame, household: DataFrame, weather: DataFrame, holiday: DataFrame) -> DataFrame:
    """Readings with the three dimensions."""
    out = join_holiday(join_weather(join_household(df, household), weather), holiday)
    return fill_holiday_default(out)


def semi_join_ids(df: DataFrame, ids: DataFrame, on: str = ID) -> DataFrame:
    """Rows whose id is in `ids`. A semi join copies nothing, so `ids` may repeat."""
    return df.join(ids.select(on), on, "left_semi")


def join_back_stats(df: DataFrame, value: str = "total_kwh", by: str = ID) -> DataFrame:
    """Household mean, sample std, max and min on each row, as windows (no self join)."""
    w = Window.partitionBy(by)
    return df.select(
        "*",
        F.avg(value).over(w).alias("hh_avg_consumption"),
        F.stddev_samp(value).over(w).alias("hh_std_consumption"),
        F.max(value).over(w).alias("hh_max_consumption"),
        F.min(value).over(w).alias("hh_min_consumption"),
    )


def join_stats_to_dim(stats: DataFrame, dim: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Per-household statistics with household attributes, one row per household."""
    one = dim.groupBy(ID).agg(F.min(F.struct(*cols)).alias("s"))
    return stats.join(one.select(ID, *[f"s.{c}" for c in cols]), ID, how)


def join_forecast_actuals(forecast: DataFrame, actual: DataFrame, how: str = "inner") -> DataFrame:
    return forecast.join(actual, ["unique_id", "ds"], how)


# --- values ------------------------------------------------------------------


def cap_at_quantile(df: DataFrame, col: str, p: float = 0.95, approx: bool = False) -> DataFrame:
    from .quantiles import quantiles

    q = quantiles(df, col, [p], approx=approx).select(F.col("q")[0].alias("__cap"))
    c = F.col(col)
    capped = F.when(c > F.col("__cap"), F.col("__cap")).otherwise(c)
    return with_scalars(df, q).withColumn(col, capped).drop("__cap")


def inf_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """+-infinity and NaN -> NULL in `cols`."""
    bad = [F.lit(float("inf")), F.lit(float("-inf"))]
    return df.withColumns(
        {c: F.when(~F.isnan(c) & ~F.col(c).isin(bad), F.col(c)) for c in cols}
    )


def cleaning_report(
    df: DataFrame,
    household: DataFrame,
    weather: DataFrame,
    holiday: DataFrame,
    share: float = MISSING_SHARE,
    min_days: int = MIN_DAYS,
    hh: str = PROFILE,
) -> DataFrame:
    """Rows and households left after each cleaning step and matched by each join, in order.

    One pass groups the readings by household and day flags; the counts come from that.
    """
    dense = (missing_slots(F.col(hh)) / SLOTS < share).alias("dense")
    wx = F.broadcast(weather.select(DAY).distinct().withColumn("wx", F.lit(1)))
    hol = F.broadcast(holiday.select(DAY).distinct().withColumn("hol", F.lit(1)))
    dim = household.select(ID).distinct().withColumn("dim", F.lit(1))
    base = df.select(ID, DAY, dense).join(wx, DAY, "left").join(hol, DAY, "left")
    n = F.count(F.lit(1))
    per = base.groupBy(ID).agg(
        n.alias("rows"),
        F.count_if("dense").alias("dense_rows"),
        F.count_if(F.col("dense") & F.col("wx").isNotNull()).alias("wx_rows"),
        F.count_if(F.col("dense") & F.col("hol").isNotNull()).alias("hol_rows"),
    )
    per = per.join(dim, ID, "left")
    active = F.col("dense_rows") >= min_days
    steps = [
        ("1 input", F.lit(True), "rows"),
        ("2 dense days", F.col("dense_rows") > 0, "dense_rows"),
        ("3 active households", active, "dense_rows"),
        ("4 household matched", active & F.col("dim").isNotNull(), "dense_rows"),
        ("5 weather matched", active & (F.col("wx_rows") > 0), "wx_rows"),
        ("6 holiday matched", active & (F.col("hol_rows") > 0), "hol_rows"),
    ]
    aggs = []
    for i, (_, cond, c) in enumerate(steps):
        aggs.append(F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).alias(f"r{i}"))
        aggs.append(F.count_if(cond).alias(f"h{i}"))
    row = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.col(f"r{i}").alias("rows"), F.col(f"h{i}").alias("households"))
            for i, (s, _, _) in enumerate(steps)
        ]
    )
    return per.agg(*aggs).select(F.inline(row))
