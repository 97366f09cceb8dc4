import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from keelson.functions import events, text
from tests.brute import similarity


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, value, column):
    return values(spark, [(value,)], "x string", column)[0][0]


def test_token_set(spark):
    assert sorted(one(spark, "Port-strike, PORT 24h é!", text.token_set(F.col("x")))) == [
        "24h",
        "port",
        "strike",
    ]
    assert one(spark, None, text.token_set(F.col("x"))) == []


def test_negated_risk(spark):
    signal = text.has_risk_signal(F.col("x"))
    cases = {
        "Factories report normal operations and no material shortage.": False,
        "Factories report a severe material shortage and delays.": True,
        "No delay today": False,
        "no delays and no shortage, then a strike": True,
        "delays everywhere": False,
        "enclosed": False,
        "casino disruption": True,
        "without disruption": False,
        None: False,
    }
    for body, expected in cases.items():
        assert one(spark, body, signal) is expected, body


def test_parse_instant(spark):
    def micros(*parts):
        return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1_000_000)

    cases = {
        "2026-08-28T09:00:00+00:00": micros(2026, 8, 28, 9),
        "2026-08-28T09:00:00Z": micros(2026, 8, 28, 9),
        "2026-08-28T09:00:00+02:00": micros(2026, 8, 28, 7),
        "2026-08-28T09:00": micros(2026, 8, 28, 9),
        "2026-08-28 09:00:00.250": micros(2026, 8, 28, 9) + 250_000,
        "2026-08-28": micros(2026, 8, 28),
        "20260828": micros(2026, 8, 28),
        "20260828T0930": micros(2026, 8, 28, 9, 30),
        "20260828T093000+0200": micros(2026, 8, 28, 7, 30),
        "2026-W36": micros(2026, 8, 31),
        "2026-W36-3": micros(2026, 9, 2),
        "2026": None,
        "2 days ago": None,
        "": None,
        None: None,
        "2026-13-40": None,
    }
    for written, expected in cases.items():
        got = one(spark, written, F.unix_micros(text.parse_instant(F.col("x"))))
        assert got == expected, written


def test_names(spark):
    assert one(spark, "Orion Components Ltd.", text.normalized_name(F.col("x"))) == "orion components"
    variants = values(
        spark,
        [("Acme", " A-1 | |Acme Co"), ("Acme", None)],
        "name string, aliases string",
        text.name_variants(F.col("name"), F.col("aliases")),
    )
    assert variants == [(["Acme", "A-1", "Acme Co"],), (["Acme"],)]


def test_name_similarity_order_matters(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("Orion Co", "Orion Ltd"), ("", ""), (None, "a")]
    got = values(
        spark, pairs, "a string, b string", text.name_similarity(F.col("a"), F.col("b"))
    )
    assert [g[0] for g in got] == [similarity(a, b) for a, b in pairs]
    assert got[0][0] == 0.25 and got[1][0] == 0.5


def test_sets_and_durations(spark):
    overlap = text.location_overlap(F.col("a"), F.col("b"))
    rows = [("Shenzhen, China", "China"), ("Houston", ""), ("Cairo, Egypt", "Egypt Lima")]
    assert [r[0] for r in values(spark, rows, "a string, b string", overlap)] == [1.0, 0.0, 0.5]
    sets = [("a b", "a b"), ("", ""), ("a b", "b c"), ("a", "")]
    similar = text.jaccard(text.token_set(F.col("a")), text.token_set(F.col("b")))
    assert [r[0] for r in values(spark, sets, "a string, b string", similar)] == [1, 1, 1 / 3, 0]
    share = text.duration_share(F.lower("x"))
    expected = {"for 14 days": 14 / 30, "2 weeks": 14 / 30, "3Months": 1.0, "soon": 0.0}
    for body, value in expected.items():
        assert one(spark, body, share) == value


def test_exact_round_is_pythons(spark):
    random.seed(7)
    numbers = [2.675, 0.125, 1.005, 0.285, 2.5, 0.03125, -0.125, -2.675, 365903.555, 1e9 + 0.005, 0.0]
    numbers += [random.uniform(-1e6, 1e6) for _ in range(2000)]
    numbers += [round(random.uniform(0, 1000), 3) for _ in range(2000)]
    df = spark.createDataFrame([(n,) for n in numbers], "x double")
    for digits in (1, 2, 4):
        got = df.select("x", text.exact_round(F.col("x"), digits)).collect()
        assert all(r[1] == round(r[0], digits) for r in got)


def test_dollars(spark):
    rows = [(301_000.5,), (0.5,), (1.5,), (1234567.0,)]
    got = values(spark, rows, "x double", text.dollars(F.col("x")))
    assert [g[0] for g in got] == [f"${r[0]:,.0f}" for r in rows]


@pytest.mark.parametrize(
    ("body", "label"),
    [
        ("A severe flood warning may close factories for seven days.", "Extreme weather"),
        ("An unusual event was reported.", "Other disruption"),
        ("A flood closed the port.", "Port or transport disruption"),
        ("A supplier filed for bankruptcy.", "Financial distress"),
        ("raw material scarcity", "Material shortage"),
        (None, "Other disruption"),
    ],
)
def test_event_types(spark, body, label):
    event = one(spark, body, events.classify_event(F.col("x")))
    assert event.event_type == label and event.backend == "keyword"
    assert (event.confidence == 0.35) == (label == "Other disruption")


def test_severity(spark):
    severity = events.severity(F.col("x"))
    assert one(spark, "severe warning", severity) == 0.85
    assert one(spark, "disclosed", severity) == 0.8  # parts of words count
    assert one(spark, "lasting 20 days", severity) == round(20 / 30, 3)
    assert one(spark, "quiet", severity) == 0.35
    assert math.isclose(one(spark, "critical", severity), 1.0)


def test_keywords_with_signs_are_plain_text(spark):
    keywords = {"Trade": ("u.s.", "semi-conductor", "c++ (old)"), "Other": ("tariff",)}
    rows = [("New u.s. rules",), ("the semi-conductor plant",), ("uxsx semi conductor",), ("in c++ (old) style",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.e.event_type for r in df.select(events.classify_event(F.col("t"), keywords).alias("e")).collect()]
    assert got[0] == got[1] == got[3] == "Trade" and got[2] not in keywords


def test_rounding_of_the_sql_is_pythons():
    import duckdb

    from keelson.plans.oracles import py_round

    db = duckdb.connect()
    values = [45.1499999999999986, 0.125, 0.375, 2.675, 0.285, 1.005, 2.5, 301000.5, -0.25, 365903.555]
    for digits in range(5):
        for value in values:
            found = db.execute(f"SELECT {py_round('CAST(? AS DOUBLE)', digits)}", [value]).fetchone()[0]
            assert found == round(value, digits)
