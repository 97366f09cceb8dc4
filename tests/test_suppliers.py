import pytest
from pyspark.sql import functions as F

from keelson.operators import quality, scoring
from keelson.sources import tables

REQUIRED = {
    "supplier_id": "S1",
    "supplier_name": "Acme",
    "location": "Mumbai, India",
    "avg_delay_days": "4",
    "risk_score": "50",
    "daily_revenue_exposure": "1000",
}


def frame(spark, rows, columns=tuple(REQUIRED)):
    schema = ", ".join(f"{c} string" for c in columns) + ", row_pos long"
    return spark.createDataFrame(
        [tuple({**REQUIRED, **r}.get(c) for c in columns) + (i,) for i, r in enumerate(rows)], schema
    )


def test_missing_required_column_is_rejected(spark):
    with pytest.raises(ValueError, match="location"):
        quality.validate_suppliers(frame(spark, [{}]).drop("location"))


def test_empty_table_is_rejected(spark):
    with pytest.raises(ValueError, match="empty"):
        quality.validate_suppliers(frame(spark, [{}]).limit(0))


def test_defaults_are_added(spark):
    result = quality.validate_suppliers(frame(spark, [{}]))
    row = result.data.first()
    assert (row.on_time_delivery_rate, row.expected_delay_days) == (0.85, 7.0)
    assert result.report.filter("check = 'default_added'").count() == 4
    sentences = [r.warning for r in quality.warning_texts(result.report).collect()]
    assert "Added on_time_delivery_rate using default value 0.85." in sentences


def test_last_duplicate_stays(spark):
    result = quality.validate_suppliers(frame(spark, [{}, {"risk_score": "80"}]))
    assert [r.risk_score for r in result.data.collect()] == [80.0]
    assert result.report.filter("check = 'duplicates_removed'").first().n == 1


def test_bad_numbers_medians_and_ranges(spark):
    columns = (*REQUIRED, "quality_defect_rate")
    rows = [
        {"supplier_id": "a", "risk_score": "10", "avg_delay_days": "1"},
        {"supplier_id": "b", "risk_score": "250", "avg_delay_days": "x"},
        {"supplier_id": "c", "risk_score": None, "avg_delay_days": "3"},
        {"supplier_id": "d", "risk_score": "-5", "avg_delay_days": "10"},
        {"supplier_id": "e", "risk_score": "NaN", "avg_delay_days": "2", "daily_revenue_exposure": "-1"},
    ]
    result = quality.validate_suppliers(frame(spark, rows, columns))
    got = {r.supplier_id: r for r in result.data.collect()}
    # The median is taken before the limits: of -5, 10, 250.
    assert [got[k].risk_score for k in "abcde"] == [10, 100, 10, 0, 10]
    assert got["b"].avg_delay_days == 2.5
    assert got["e"].daily_revenue_exposure == 0
    assert got["a"].quality_defect_rate == 0.02  # nothing there at all: the default
    report = {(r.check, r.column): r.n for r in result.report.collect()}
    assert report[("invalid_to_missing", "risk_score")] == 1
    assert report[("missing_filled", "risk_score")] == 2
    assert report[("invalid_to_missing", "avg_delay_days")] == 1


RISK_ROW = {
    "supplier_id": "S1",
    "avg_delay_days": 10.0,
    "risk_score": 70.0,
    "on_time_delivery_rate": 0.75,
    "quality_defect_rate": 0.04,
    "daily_revenue_exposure": 40_000.0,
    "expected_delay_days": 10.0,
    "backup_capacity_pct": 20.0,
}


def risk(spark, severity=0.0, confidence=0.0, **changes):
    row = {**RISK_ROW, **changes}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    return scoring.score_suppliers(df, F.lit(severity), F.lit(confidence)).first()


def test_event_raises_and_backup_lowers_the_loss(spark):
    plain, event = risk(spark), risk(spark, 0.9, 0.9)
    assert event.disruption_probability > plain.disruption_probability
    assert event.expected_loss > plain.expected_loss
    assert risk(spark, backup_capacity_pct=100.0).expected_loss < plain.expected_loss


def test_priorities_follow_unrounded_values(spark):
    assert risk(spark, 1.0, 1.0).priority == "Critical"
    low = risk(spark, daily_revenue_exposure=0.0, avg_delay_days=0.0, risk_score=0.0)
    assert (low.priority, low.recommended_action) == ("Low", "Continue routine monitoring")


SUMMARY = "supplier_id string, supplier_name string, priority string, expected_loss double, top_event_type string, recommended_action string"


def test_summary_texts(spark):
    rows = [
        ("1", "Acme", "Critical", 300_000.0, "Port disruption", "Activate backup"),
        ("2", "Beta", "Low", 1_000.0, "No event", "Monitor"),
    ]
    df = spark.createDataFrame(rows, SUMMARY)
    text = scoring.executive_summary(df).first().summary
    assert "Acme" in text and "$301,000" in text and text.startswith("1 supplier(s)")
    calm = scoring.executive_summary(df.filter("priority = 'Low'")).first().summary
    assert calm.startswith("No high-priority") and "$1,000" in calm
    assert scoring.executive_summary(df.limit(0)).first().summary == "No suppliers were analyzed."


def test_queue_order(spark):
    rows = [("1", "a", "Low", 9.0, "", ""), ("2", "b", "High", 1.0, "", ""), ("3", "c", "High", 5.0, "", "")]
    ordered = scoring.by_priority(spark.createDataFrame(rows, SUMMARY)).collect()
    assert [r.supplier_id for r in ordered] == ["3", "2", "1"]


def test_csv_round_trip_and_missing_texts(spark, tmp_path):
    rows = [("S1", "Acme, Inc", "NA", "4"), ("S2", 'The "Best"', "Rome", "n/a")]
    df = spark.createDataFrame(rows, "supplier_id string, supplier_name string, location string, risk_score string")
    tables.write_report(df, str(tmp_path / "out"), fmt="csv")
    back = tables.read_csv_table(spark, str(tmp_path / "out"), df.columns)
    got = {r.supplier_id: r for r in back.collect()}
    assert got["S1"].supplier_name == "Acme, Inc" and got["S1"].location is None
    assert got["S2"].supplier_name == 'The "Best"' and got["S2"].risk_score is None
    assert "row_pos" in back.columns


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('supplier_name,supplier_id\n"Two\nLines",S2\nAcme,S1\n')
    back = tables.read_csv_table(spark, str(tmp_path / "a.csv"), ["supplier_id", "supplier_name"], multi_line=True)
    assert {(r.supplier_id, r.supplier_name) for r in back.collect()} == {("S2", "Two\nLines"), ("S1", "Acme")}
    with pytest.raises(ValueError, match="location"):
        tables.read_csv_table(spark, str(tmp_path / "a.csv"), ["supplier_id", "location"])


def test_reports_lose_no_column(spark, tmp_path):
    df = spark.sql("select 1 as a, named_struct('x', 2) as s, array(3) as arr, named_struct('f', 'p') as row_pos")
    tables.write_report(df, str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.a, row.s.x, row.arr) == (1, 2, [3]) and "row_pos" not in row.asDict()
    with pytest.raises(ValueError, match="s, arr"):
        tables.write_report(df, str(tmp_path / "csv"), fmt="csv")


def test_equal_losses_name_the_least_id(spark):
    rows = [("2", "b", "High", 5.0, "Storm", "act"), ("1", "a", "High", 5.0, "Storm", "act")]
    summary = scoring.executive_summary(spark.createDataFrame(rows, SUMMARY)).first().summary
    assert "The highest priority is a because" in summary
