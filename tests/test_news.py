import json

import pytest
from pyspark.sql import functions as F

from keelson import run_risk_pipeline
from keelson.operators import matching, news, scoring
from keelson.sources import tables
from keelson.streaming import news_stream

AS_OF = "2026-09-10"


def articles(spark, *rows):
    """Title, published_at and, if given, the full text."""
    full = [(i, r[0], r[1], r[2] if len(r) > 2 else "") for i, r in enumerate(rows)]
    return spark.createDataFrame(
        full, "article_pos long, title string, published_at string, full_text string"
    )


def test_filter_removes_old_and_irrelevant(spark):
    df = articles(
        spark,
        ("Port strike causes delay", "2026-09-01T00:00:00+00:00"),
        ("Football results", "2026-09-01T00:00:00+00:00"),
        ("Old factory shutdown", "2020-01-01T00:00:00+00:00"),
        ("Undated flood", ""),
        ("Unreadable storm date", "2 days ago"),
        ("Fire on the last day", "2026-07-12T00:00:00Z"),
        ("Fire a second too early", "2026-07-11T23:59:59Z"),
        ("Future recall", "2027-01-01"),
    )
    kept = news.filter_recent_risk_news(df, AS_OF, 60).select("article_pos").collect()
    assert sorted(r[0] for r in kept) == [0, 3, 4, 5, 7]


def test_days_may_be_fractions(spark):
    df = articles(spark, ("fire", "2026-09-09T12:00:00Z"), ("fire", "2026-09-09T11:59:59Z"))
    assert news.recent_news(df, AS_OF, 0.5).count() == 1


def test_relevance_gate_is_strict(spark):
    suppliers = spark.createDataFrame(
        [("S1", "Acme", "Mumbai"), ("S2", "Other", "")], "supplier_id string, supplier_name string, location string"
    )
    df = articles(
        spark,
        ("Acme factory shutdown in Mumbai", "", "Major delay"),
        ("Port delay in Hamburg", "", "Cargo strike"),
        ("Acme picnic", ""),
    )
    got = {(r.supplier_id, r.article_pos): r.relevance_score for r in matching.rank_for_suppliers(suppliers, df).collect()}
    # Risk words alone reach 0.2 at most, which is not enough.
    assert got == {("S1", 0): 1.0, ("S1", 2): 0.5}


@pytest.mark.parametrize(
    ("text", "name", "location", "aliases", "expected"),
    [
        ("Orion Electronics faces a port delay.", "Orion Components", "Shenzhen, China", "Orion Electronics|Orion Components Ltd", True),
        ("A major factory shutdown was reported in Houston.", "Delta Chemicals", "Houston", "", True),
        ("Finance news", "Acme", "Paris", None, False),
        ("Orion Componentz", "Orion Components", "", "", True),
        ("Orion Components", "Componentz Orion", "", "", False),
        ("China news", "Acme", "Shenzhen, China", "", False),
    ],
)
def test_identity(spark, text, name, location, aliases, expected):
    row = spark.createDataFrame(
        [(text, name, location, aliases)],
        "body string, supplier_name string, location string, aliases string",
    )
    assert matching.with_supplier_match(row, F.col("body")).first().matches is expected


SUPPLIERS = [
    ("A", "Acme Steel", "Acme Works|AS", "Mumbai, India", 12.0, 80.0, 50_000.0),
    ("B", "Borealis Foods", "", "Oslo, Norway", 2.0, 10.0, 5_000.0),
    ("C", "Cobalt Parts", None, "Houston, USA", 6.0, 50.0, 20_000.0),
]


def supplier_frame(spark):
    rows = [(*r, i) for i, r in enumerate(SUPPLIERS)]
    return spark.createDataFrame(
        rows,
        "supplier_id string, supplier_name string, aliases string, location string, "
        "avg_delay_days double, risk_score double, daily_revenue_exposure double, row_pos long",
    )


def test_whole_queue(spark):
    feed = articles(
        spark,
        ("Severe port strike hits Acme Steel exports", "2026-09-01", "The strike in Mumbai may last 3 weeks."),
        ("Port strike hits severe Acme Steel exports", "2026-09-02", "Same words."),
        ("Critical fire at Acme Steel", "2026-09-03", "Mumbai"),
        ("Flood in Houston USA closes roads", "2026-09-03", "storm"),
        ("Shortage of berries", "2020-01-01", "Oslo"),
        ("Quarterly results", "2026-09-01", "Nothing else."),
    )
    result = run_risk_pipeline(supplier_frame(spark), feed, as_of=AS_OF)
    rows = {r.supplier_id: r for r in result.suppliers.collect()}
    assert list(rows)[0] == "A" and len(rows) == 3
    assert rows["A"].matched_articles == 2
    # fire 1.0 x 0.62 against strike 0.85 x 0.74
    assert rows["A"].top_event_title == "Severe port strike hits Acme Steel exports"
    assert rows["C"].top_event_type == "Extreme weather"
    assert rows["B"].top_event_type == "No relevant external event" and rows["B"].external_risk == 0
    counts = result.counts.first()
    assert (counts.articles_received, counts.articles_processed) == (6, 3)
    assert result.evidence.columns == scoring.EVIDENCE and result.evidence.count() == 3
    assert result.report.filter("check = 'default_added'").count() == 4


def test_queue_without_news_keeps_its_columns(spark):
    result = run_risk_pipeline(supplier_frame(spark), articles(spark, ("calm", "")), as_of=AS_OF)
    assert result.evidence.columns == scoring.EVIDENCE and result.evidence.count() == 0
    assert result.suppliers.count() == 3


def test_best_few_are_chosen_before_the_identity_check(spark):
    suppliers = spark.createDataFrame(
        [("S", "Acme North", "", "Rome", 1.0, 1.0, 1.0, 0)],
        "supplier_id string, supplier_name string, aliases string, location string, "
        "avg_delay_days double, risk_score double, daily_revenue_exposure double, row_pos long",
    )
    feed = articles(
        spark,
        ("acme strike fire one", ""),
        ("acme strike fire two", ""),
        ("acme strike fire three", ""),
        ("acme north picnic with a delay", ""),
        ("acme strike fire four", ""),
    )
    one = run_risk_pipeline(suppliers, feed, as_of=AS_OF, max_articles_per_supplier=1)
    assert one.evidence.first().title == "acme north picnic with a delay"
    far = feed.filter("article_pos <> 3")
    none = run_risk_pipeline(suppliers, far, as_of=AS_OF).suppliers.first()
    assert none.matched_articles == 0


def test_tie_between_events_goes_to_the_better_rank(spark):
    classified = spark.createDataFrame(
        [("S", "x", "t2", "u", 0.5, 0.8, 2), ("S", "y", "t1", "u", 0.8, 0.5, 1)],
        "supplier_id string, event_type string, title string, url string, "
        "event_confidence double, event_severity double, article_rank int",
    )
    top = scoring.top_events(classified).first()
    assert top.top_event_title == "t1" and top.matched_articles == 2


def test_json_array_keeps_order_and_fills_gaps(spark, tmp_path):
    feed = [{"title": "b", "url": "u"}, {"title": None, "snippet": "s"}]
    (tmp_path / "news.json").write_text(json.dumps(feed, indent=1))
    got = tables.read_news_json(spark, str(tmp_path / "news.json")).orderBy("article_pos").collect()
    assert [(r.title, r.snippet, r.url) for r in got] == [("b", "", "u"), ("", "s", "")]


def payload(n):
    items = [{"title": f"t{i}", "link": f"l{i}", "snippet": f"s{i}", "date": "2026-09-01"} for i in range(n)]
    return {"news": [{**items[0], "source": "Wire"}, *items[1:]]}


def test_payloads_in_batch_and_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text(json.dumps(payload(7)))
    (landing / "b.json").write_text(json.dumps(payload(2)))
    batch = tables.read_payloads(spark, str(landing), limit=5)
    assert batch.count() == 7 == batch.select("article_pos").distinct().count()
    first = batch.filter("title = 't0'").first()
    assert (first.source, first.full_text, first.url) == ("Wire", "s0", "l0")
    assert batch.filter("title = 't1'").first().source == "Web"
    stream = news_stream.stream_articles(spark, str(landing), limit=5)
    query = news_stream.land_articles(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    landed = spark.read.parquet(str(tmp_path / "out"))
    assert landed.count() == 7
    assert {r.article_pos for r in landed.collect()} == {r.article_pos for r in batch.collect()}


def test_payloads_over_several_lines(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text(json.dumps(payload(3), indent=2))
    batch = tables.read_payloads(spark, str(landing), multi_line=True)
    stream = news_stream.stream_articles(spark, str(landing), multi_line=True)
    news_stream.land_articles(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert batch.count() == spark.read.parquet(str(tmp_path / "out")).count() == 3
