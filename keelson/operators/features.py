"""Leakage-safe features on a supplier-month history."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from keelson.session import cut_lineage, require_columns

# The names and order of the features, and the columns that must be there.
TIME_FEATURES = [
    "avg_delay_days",
    "risk_score",
    "on_time_delivery_rate",
    "quality_defect_rate",
    "external_event_severity",
    "delay_lag_1m",
    "delay_rolling_mean_3m",
    "delay_rolling_std_3m",
    "delay_trend_3m",
    "on_time_rolling_mean_3m",
    "defect_rolling_mean_3m",
    "external_event_max_3m",
    "risk_rolling_mean_3m",
    "month_sin",
    "month_cos",
]
REQUIRED = (
    "supplier_id",
    "observation_date",
    "avg_delay_days",
    "risk_score",
    "on_time_delivery_rate",
    "quality_defect_rate",
    "external_event_severity",
)
REACH = 3


def _feature_columns(in_order: WindowSpec) -> dict:
    """All features read the previous rows only; one window definition, one sort."""
    previous = in_order.rowsBetween(-REACH, -1)

    def rolling(aggregate, name: str):
        return F.when(F.count(name).over(previous) >= 2, aggregate(name).over(previous))

    def lag(n: int):
        return F.lag("avg_delay_days", n).over(in_order)

    angle = F.month("observation_date") * (2 * math.pi) / 12
    return {
        "delay_lag_1m": lag(1),
        "delay_rolling_mean_3m": rolling(F.avg, "avg_delay_days"),
        "delay_rolling_std_3m": rolling(F.stddev_samp, "avg_delay_days"),
        "delay_trend_3m": lag(1) - lag(3),
        "on_time_rolling_mean_3m": rolling(F.avg, "on_time_delivery_rate"),
        "defect_rolling_mean_3m": rolling(F.avg, "quality_defect_rate"),
        "external_event_max_3m": rolling(F.max, "external_event_severity"),
        "risk_rolling_mean_3m": rolling(F.avg, "risk_score"),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    }


def _with_ranges(data: DataFrame) -> DataFrame:
    """Deal the rows by ranges of supplier and time and give every range what it looks back to.

    A supplier with a long history is spread over several ranges. Each of them also gets the last
    ``REACH`` rows before it, marked ``_before``.
    """
    order = ["supplier_id", "observation_date", "_order"]
    ranged = cut_lineage(
        data.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    )
    columns = [c for c in ranged.columns if c != "_range"]
    # Of each supplier, at most REACH rows per range: as few rows as there are ranges, times REACH.
    newest_first = Window.partitionBy("supplier_id", "_range").orderBy(
        F.desc("observation_date"), F.desc("_order")
    )
    tails = ranged.withColumn("_nth", F.row_number().over(newest_first)).filter(
        F.col("_nth") <= REACH
    )
    in_order = Window.partitionBy("supplier_id").orderBy("observation_date", "_order")
    oldest = Window.partitionBy("supplier_id", "_range")
    halo = (
        tails.join(_in_several_ranges(ranged), "supplier_id", "left_semi")
        .withColumn(
            "_rows", F.collect_list(F.struct(*columns)).over(in_order.rowsBetween(-REACH, -1))
        )
        .withColumn("_first", F.col("_nth") == F.max("_nth").over(oldest))
        .filter("_first")
        .select("_range", F.explode("_rows").alias("_row"))
        .select("_row.*", "_range", F.lit(True).alias("_before"))
    )
    return ranged.withColumn("_before", F.lit(False)).unionByName(halo)


def _in_several_ranges(ranged: DataFrame) -> DataFrame:
    return (
        ranged.groupBy("supplier_id")
        .agg(F.min("_range").alias("a"), F.max("_range").alias("b"))
        .filter("a < b")
        .select("supplier_id")
    )


def add_time_aware_features(history: DataFrame, order: str | None = None) -> DataFrame:
    """Lags, rolling statistics and seasonality known at each observation date.

    Windows count rows, not months, and never include the current row. ``order`` names a column
    that says which of a supplier's rows with equal dates comes first; without it a hash of the
    row decides, the same in every run. A supplier's rows are spread over as many tasks as their
    number needs.
    """
    require_columns(history, REQUIRED, "history")
    data = history
    if dict(history.dtypes)["observation_date"] == "string":
        data = data.withColumn("observation_date", F.to_timestamp("observation_date"))
    tie = F.col(order) if order else F.xxhash64(*history.columns)
    in_order = Window.partitionBy("supplier_id", "_range").orderBy("observation_date", "_order")
    return (
        _with_ranges(data.withColumn("_order", tie))
        .withColumns(_feature_columns(in_order))
        .filter(~F.col("_before"))
        .drop("_before", "_range", "_order")
    )
