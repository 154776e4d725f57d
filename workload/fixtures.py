"""The given tables seen as meter data: lazy frames, one method per domain table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions import calendar as cal
from wattloom.functions import profile as prof
from wattloom.functions import weather as wx
from wattloom.operators import clean, drivers, panel, splits
from wattloom.plans.feature_table import clean_weather, day_counts, feature_table
from wattloom.schema import DAY, ID
from wattloom.session import stored

# fixed coefficients of the linear driver model used by the contribution queries
COEFS = {"lag1_total": 0.3, "lag7_total": 0.2, "roll7_total_mean": 0.25, "is_weekend": -1.5, "month": 0.1}
INTERCEPT = 2.0


_SCANS: dict[tuple[str, str, str], DataFrame] = {}


def mac(key: Column) -> Column:
    return F.concat(F.lit("MAC"), F.lpad(key.cast("string"), 6, "0"))


def three_way(total: Column, low: float, high: float) -> Column:
    return F.when(total < low, 0).when(total < high, 1).otherwise(2)


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """The scan of one table; its footer is read once per session."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _SCANS:
            _SCANS[key] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return _SCANS[key]

    def meter(self) -> DataFrame:
        """Daily totals: supplier = household, shipped quantity = kWh. Key is unique.

        Grouped by the integer key; the text id is made once per group."""
        days = self.table("lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias(DAY)).agg(
            F.sum("l_quantity").alias("total_kwh")
        )
        return days.select(mac(F.col("l_suppkey")).alias(ID), DAY, "total_kwh")

    def _nations(self) -> DataFrame:
        """nation has 25 rows and region 5 at every scale."""
        n, r = self.table("nation"), self.table("region")
        return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)

    def household(self) -> DataFrame:
        s, n = self.table("supplier"), self._nations()
        return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
            mac(F.col("s_suppkey")).alias(ID),
            F.col("n_name").alias("Acorn"),
            F.col("r_name").alias("Acorn_grouped"),
            F.when(F.col("s_acctbal") < 2000, "ToU").otherwise("Std").alias("stdorToU"),
        )

    def weather_raw(self) -> DataFrame:
        n, keys, cust = F.count(F.lit(1)), F.sum("o_orderkey"), F.sum("o_custkey")
        base = F.lit(25) - F.abs(F.dayofyear("o_orderdate") - 200) / F.lit(10.0)
        hours = F.make_dt_interval(F.lit(0), F.col("odd").cast("int"))
        out = (
            self.table("orders")
            .groupBy("o_orderdate", (F.col("o_orderkey") % 2).alias("odd"))
            .agg(n.alias("n"), keys.alias("k"), cust.alias("c"))
        )
        hi = base + F.col("n") % 5
        return out.select(
            (F.col("o_orderdate") + hours).alias("time"),
            hi.alias("temperatureMax"),
            (hi - 4 - F.col("n") % 4).alias("temperatureMin"),
            F.when(F.col("k") % 13 != 0, F.lit(0.2) + (F.col("k") % 80) / F.lit(100.0)).alias("humidity"),
            ((F.col("c") % 100) / F.lit(10.0)).alias("windSpeed"),
            F.when(F.col("c") % 11 != 0, (F.col("c") % 11) / F.lit(10.0)).alias("cloudCover"),
        )

    def weather_days(self) -> DataFrame:
        return clean.dedup_weather_days(clean.select_weather_cols(self.weather_raw()))

    def weather(self) -> DataFrame:
        return clean_weather(self.weather_raw())

    def holiday_raw(self) -> DataFrame:
        md = F.date_format("o_orderdate", "MM-dd")
        kind = (
            F.when(md == "12-25", "Christmas Day")
            .when(md == "12-26", "Boxing Day")
            .when(md == "01-01", "New Year?s Day")
            .when(md == "05-01", "Early May bank holiday")
            .when(md == "04-29", "Royal Wedding")
        )
        out = self.table("orders").select(F.to_date("o_orderdate").alias("Bank holidays"), kind.alias("Type"))
        return out.where(F.col("Type").isNotNull()).distinct()

    def holiday(self) -> DataFrame:
        return clean.map_holiday_category(self.holiday_raw())

    def with_dims(self, df: DataFrame) -> DataFrame:
        return self.with_days(clean.join_household(df, self.household()))

    def with_days(self, df: DataFrame) -> DataFrame:
        """The dimensions by day; no row is copied."""
        out = clean.join_holiday(clean.join_weather(df, self.weather()), self.holiday())
        return cal.season_of_month(cal.month_of_day(clean.fill_holiday_default(out)))

    def merged(self) -> DataFrame:
        return self.with_dims(self.meter())

    def feature_table(self) -> DataFrame:
        """All features; global statistics come from the readings' day counts."""
        return feature_table(self.merged(), days=day_counts(self.meter(), self.weather()))

    def calendar(self) -> DataFrame:
        return cal.holiday_flags(cal.season_flags(cal.calendar_basic(self.merged())))

    def features(self) -> DataFrame:
        return self._day_features(self.merged())

    @staticmethod
    def _day_features(df: DataFrame) -> DataFrame:
        return wx.temp_features(cal.holiday_flags(cal.season_flags(cal.calendar_basic(df))))

    def clusters(self) -> DataFrame:
        return self.meter().withColumn("cluster", three_way(F.col("total_kwh"), 20, 35))

    def feature_clusters(self) -> DataFrame:
        return self.features().withColumn("cluster", three_way(F.col("total_kwh"), 20, 35))

    def lagged(self) -> DataFrame:
        """features with lags and rolling means. The household windows run before the joins by day,
        which copy no row, so they sort short rows: what a task holds is a fraction of the features."""
        homes = clean.join_household(self.meter(), self.household())
        windows = panel.panel_safe(homes)
        new = [c for c in windows.columns if c not in homes.columns]
        out = self._day_features(self.with_days(windows))
        return out.select(*[c for c in out.columns if c not in new], *new)

    def readings(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").cast("string").alias(ID), "ts", F.col("value").alias("kwh"))

    def slots(self) -> DataFrame:
        """Long slot values per region and month. Summed per supplier first, so the join sees
        at most 48 rows per supplier and month."""
        li = self.table("lineitem")
        slot = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 48).cast("int")
        part = li.groupBy("l_suppkey", F.trunc("l_shipdate", "MM").alias(DAY), slot.alias("slot")).agg(
            F.sum("l_quantity").alias("v")
        )
        n = F.broadcast(self.table("nation"))
        s = self.table("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
        return (
            part.join(s, part.l_suppkey == s.s_suppkey)
            .groupBy(mac(F.col("n_regionkey")).alias(ID), DAY, "slot")
            .agg(F.sum("v").alias("v"))
        )

    def supplier_profiles(self) -> DataFrame:
        """Profiles per supplier and year: as many households as there are suppliers, so this grows
        with the tables."""
        slot = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 48).cast("int")
        year = F.trunc("l_shipdate", "YEAR").alias(DAY)
        li = self.table("lineitem").groupBy(mac(F.col("l_suppkey")).alias(ID), year, slot.alias("slot"))
        return clean.pack_slots(li.agg(F.sum("l_quantity").alias("v")), [ID, DAY])

    def profiles_raw(self) -> DataFrame:
        return clean.pack_slots(self.slots(), [ID, DAY])

    def profiles(self) -> DataFrame:
        return clean.interpolate_profile(clean.drop_sparse_days(self.profiles_raw()))

    def profile_features(self) -> DataFrame:
        """Profiles with their totals, calendar, dimensions and a cluster label: the third of the day
        that holds the peak, so every size of the tables has three clusters."""
        df = cal.calendar_basic(self.with_dims(self.profiles()))
        return prof.consumption_features(df).withColumn("cluster", three_way(F.col("peak_hour"), 16, 32))

    def predictions(self) -> DataFrame:
        """Lag-1 and lag-7 baselines beside the actual, both models."""
        w = panel.by_day()
        lags = self.clusters().select(
            ID, DAY, "cluster", F.col("total_kwh").alias("y_true"), *[F.lag("total_kwh", k).over(w).alias(f"lag{k}") for k in (1, 7)]
        )
        models = [F.struct(F.col(m).alias("y_pred"), F.lit(m).alias("model")) for m in ("lag1", "lag7")]
        base = lags.select(ID, DAY, "cluster", "y_true", F.inline(F.array(*models)))
        return splits.split_by_date(base.where(F.col("y_pred").isNotNull()), 30, 90)

    def prediction1(self) -> DataFrame:
        """The lag-1 baseline alone."""
        base = self.clusters().select(
            ID, DAY, "cluster", F.col("total_kwh").alias("y_true"), F.lag("total_kwh", 1).over(panel.by_day()).alias("y_pred")
        )
        return splits.split_by_date(base.where(F.col("y_pred").isNotNull()), 30, 90)

    def contribution_input(self) -> DataFrame:
        df = self.lagged().where(F.col("lag7_total").isNotNull())
        return df.withColumn("cluster", three_way(F.col("total_kwh"), 20, 35))

    def stored_input(self) -> DataFrame:
        """The keys, inputs and target of contribution_input, written once: for what reads them often."""
        return stored(self.contribution_input().select(ID, DAY, *COEFS, "total_kwh"), "contribution-input")

    def contributions(self) -> DataFrame:
        return drivers.contributions(self.contribution_input(), COEFS, INTERCEPT, (ID, DAY, "cluster"))
