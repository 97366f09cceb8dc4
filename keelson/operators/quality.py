"""Supplier table checks: duplicates, number casts, defaults, medians, ranges."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.quantiles import exact_quantiles, profile
from keelson.session import clip, cut_lineage, require_columns

REQUIRED = (
    "supplier_id",
    "supplier_name",
    "location",
    "avg_delay_days",
    "risk_score",
    "daily_revenue_exposure",
)
NUMERIC = (
    "avg_delay_days",
    "risk_score",
    "on_time_delivery_rate",
    "quality_defect_rate",
    "daily_revenue_exposure",
    "expected_delay_days",
    "backup_capacity_pct",
)
DEFAULTS = {
    "on_time_delivery_rate": 0.85,
    "quality_defect_rate": 0.02,
    "expected_delay_days": 7.0,
    "backup_capacity_pct": 0.0,
}
RANGES = {
    "risk_score": (0.0, 100.0),
    "on_time_delivery_rate": (0.0, 1.0),
    "quality_defect_rate": (0.0, 1.0),
    "backup_capacity_pct": (0.0, 100.0),
    "daily_revenue_exposure": (0.0, None),
    "expected_delay_days": (1.0, None),
}
REPORT_SCHEMA = "check string, column string, n long, value double"


class SupplierQuality(NamedTuple):
    data: DataFrame
    report: DataFrame


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row per key, with ``_copies`` counted.

    An aggregate, not a window: each task first reduces its own rows to one per key, so a key
    with very many copies costs no more than any other.
    """
    if order not in df.columns:
        raise ValueError(f"An order column {order!r} is needed to know which row is the last.")
    return (
        df.groupBy(F.col(key).alias("_key"))
        .agg(
            F.max_by(F.struct(*df.columns), order).alias("_last"),
            F.count("*").alias("_copies"),
        )
        .select("_last.*", "_copies")
    )


def to_number(column: Column) -> Column:
    """Text to double; what is no number, and NaN, become null."""
    text = F.trim(column.cast("string"))
    usable = text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$") | F.lower(
        text
    ).rlike("^[+-]?inf(inity)?$")
    return F.when(usable, text.try_cast("double"))


def _is_missing(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    if dict(df.dtypes)[name] in ("double", "float"):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def validate_suppliers(
    suppliers: DataFrame, order: str = "row_pos"
) -> SupplierQuality:
    """Clean a supplier table and report what was changed.

    The last row of every supplier is written once; the report, the medians and the cleaned
    table, a projection, all read that.
    """
    require_columns(suppliers, REQUIRED, "required")
    latest = keep_last(suppliers, "supplier_id", order)
    present = [c for c in NUMERIC if c in suppliers.columns]
    casted = latest.withColumns(
        {
            **{f"_missing_{c}": _is_missing(latest, c) for c in present},
            **{c: to_number(F.col(c)) for c in present},
        }
    )
    casted = cut_lineage(casted)
    stats = (
        casted.agg(
            F.coalesce(F.sum("_copies"), F.lit(0)).alias("received"),
            F.count("*").alias("kept"),
            *[
                F.count_if(F.col(c).isNull() & ~F.col(f"_missing_{c}")).alias(f"invalid_{c}")
                for c in present
            ],
            *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present],
            *profile(casted, present),
        )
        .first()
        .asDict()
    )
    if not stats["received"]:
        raise ValueError("Supplier data is empty.")
    with_nulls = [c for c in present if stats[f"null_{c}"]]
    medians = exact_quantiles(casted, {c: [0.5] for c in with_nulls}, known=stats)
    fills = {c: medians[c][0] for c in with_nulls}
    fills = {c: DEFAULTS.get(c, 0.0) if v is None else v for c, v in fills.items()}

    report = []
    if stats["received"] > stats["kept"]:
        report.append(("duplicates_removed", "supplier_id", stats["received"] - stats["kept"], None))
    report += [
        ("invalid_to_missing", c, stats[f"invalid_{c}"], None)
        for c in present
        if stats[f"invalid_{c}"]
    ]
    absent = {c: v for c, v in DEFAULTS.items() if c not in suppliers.columns}
    report += [("default_added", c, stats["kept"], v) for c, v in absent.items()]
    report += [("missing_filled", c, stats[f"null_{c}"], fills[c]) for c in with_nulls]

    filled = casted.drop("_copies", *[f"_missing_{c}" for c in present]).withColumns(
        {
            **{c: F.lit(v) for c, v in absent.items()},
            **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()},
        }
    )
    data = filled.withColumns({c: clip(F.col(c), *limits) for c, limits in RANGES.items()})
    spark = suppliers.sparkSession
    return SupplierQuality(data, spark.createDataFrame(report, REPORT_SCHEMA))


def warning_texts(report: DataFrame) -> DataFrame:
    """The report as sentences."""
    n, column, value = F.col("n").cast("string"), F.col("column"), F.col("value")
    sentence = (
        F.when(
            F.col("check") == "duplicates_removed",
            F.concat(F.lit("Removed "), n, F.lit(" duplicate supplier IDs.")),
        )
        .when(
            F.col("check") == "invalid_to_missing",
            F.concat(
                F.lit("Converted "), n, F.lit(" invalid values in "), column, F.lit(" to missing.")
            ),
        )
        .when(
            F.col("check") == "default_added",
            F.concat(
                F.lit("Added "), column, F.lit(" using default value "), value.cast("string"), F.lit(".")
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Filled "),
                n,
                F.lit(" missing values in "),
                column,
                F.lit(" with "),
                F.format_string("%.2f", value),
                F.lit("."),
            )
        )
    )
    return report.select("check", "column", sentence.alias("warning"))


def table_problems(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``check, column``: each required column that is not there, and whether there is no row.

    What ``validate_suppliers`` and the other guards refuse, as rows instead of an error.
    """
    missing = [("missing_column", c) for c in sorted(set(required) - set(df.columns))]
    columns = df.sparkSession.createDataFrame(missing, "check string, column string")
    # Counts one row at most, so large tables are not read.
    rows = df.select(F.lit(1)).limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    return columns.unionByName(
        rows.select(F.lit("empty").alias("check"), F.lit(None).cast("string").alias("column"))
    )


def group_problems(
    df: DataFrame, group: str, groups: Sequence[str], target: str | None = None
) -> DataFrame:
    """``group, rows, classes, problem`` of each named group, in the order of the names.

    The problem is ``missing`` without rows, ``one class`` if the target has fewer than two values,
    else null. Without a target, classes are null and only rows count.
    """
    spark = df.sparkSession
    named = spark.createDataFrame([(g, i) for i, g in enumerate(groups)], "_group string, _at int")
    classes = F.count_distinct(target) if target else F.lit(None).cast("long")
    counted = (
        df.filter(F.col(group).isin(list(groups)))
        .groupBy(F.col(group).alias("_group"))
        .agg(F.count("*").alias("rows"), classes.alias("classes"))
    )
    problem = F.when(F.col("rows").isNull(), "missing").when(F.col("classes") < 2, "one class")
    none = F.lit(0).cast("long")
    return (
        named.join(counted, "_group", "left")
        .orderBy("_at")
        .select(
            F.col("_group").alias("group"),
            F.coalesce("rows", none).alias("rows"),
            (F.coalesce("classes", none) if target else F.col("classes")).alias("classes"),
            problem.alias("problem"),
        )
    )


def _refused(problems: DataFrame) -> list[str]:
    """Names of groups with a problem; there is one row per named group."""
    return [r["group"] for r in problems.filter(F.col("problem").isNotNull()).collect()]


def require_both_classes(df: DataFrame, group: str, target: str, groups: list[str]) -> None:
    """Every named group must be there and hold both target classes."""
    for name in _refused(group_problems(df, group, groups, target)):
        raise ValueError(f"The {name} split must contain both target classes.")


def require_splits(df: DataFrame, group: str, groups: list[str], what: str) -> None:
    """Every named split must have rows."""
    missing = _refused(group_problems(df, group, groups))
    if missing:
        raise ValueError(f"{what} requires {' and '.join(missing)} rows.")
