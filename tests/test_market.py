"""Trades are attributed to matches by whole names in any of their texts; pages give all links and their whole text."""

from touchline.operators import market
from touchline.sources import pages


def test_trades_by_whole_names(spark):
    trades = spark.createDataFrame([
        ("a", "Exact Score: T1 v T12 on 2026-06-14", "x", None), ("b", "Exact Score: T12 v T2", "s-2026-06-14", None),
        ("c", "", "fifwc-ivory-coast-usa-2026-06-14-exact-score-0-0", "e"), ("d", "Exact score t1 t2 t12 2026-06-14", "", None),
        ("e", "T1 v T2 2026-06-14", "", None)], "trade_id string, title string, slug string, eventSlug string")
    games = spark.createDataFrame([
        ("m1", "2026-06-14", "T1", "T2"), ("m2", "2026-06-14", "T1", "T12"), ("m3", "2026-06-14", "T12", "T2"),
        ("m4", "2026-06-14", "Ivory Coast", "United States"), ("m5", "2026-06-15", "T1", "T2")],
        "match_key string, date string, home_team string, away_team string")
    aliases = spark.createDataFrame([("United States", "USA"), ("United States", "us")], "team string, alias string")
    got = {(r.trade_id, r.match_key) for r in market.attribute_trades(trades, games, aliases=aliases).collect()}
    assert got == {("a", "m2"), ("b", "m3"), ("c", "m4"), ("d", "m1"), ("d", "m2"), ("d", "m3")}
    assert ("c", "m4") not in {(r.trade_id, r.match_key) for r in market.attribute_trades(trades, games).collect()}


def test_names_of_any_length(spark):
    long = "Democratic Republic of the Congo"
    trades = spark.createDataFrame([
        ("a", f"Exact Score: {long} vs Ivory Coast 2026-06-14", "", None), ("b", "Exact Score: Republic of the Congo vs Ivory Coast 2026-06-14", "", None),
        ("c", "Exact score", "x", "the-united-kingdom-of-great-britain-and-northern-ireland-ivory-coast-2026-06-14"), ("d", "Exact Score " + "word " * 3000 + long, "2026-06-14", "ivory coast")],
        "trade_id string, title string, slug string, eventSlug string")
    games = spark.createDataFrame([("m1", "2026-06-14", long, "Ivory Coast"), ("m2", "2026-06-14", "UK", "Ivory Coast")],
                                  "match_key string, date string, home_team string, away_team string")
    aliases = spark.createDataFrame([("UK", "The United Kingdom of Great Britain and Northern Ireland"), ("UK", "  ")], "team string, alias string")
    got = {(r.trade_id, r.match_key) for r in market.attribute_trades(trades, games, aliases=aliases).collect()}
    assert got == {("a", "m1"), ("c", "m2"), ("d", "m1")}


def test_page_links(spark):
    html = "<p>" + "".join(f"<a href='/player/{i}/jo-doe/'>x</a> {'words ' * 20}</p>" for i in range(8)) + " 87 Overall rating " + "z " * 900
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    rows = pages.page_candidates(df, r"/player/\d+/[^/']+/", "page_id", "html").collect()
    assert [r.position for r in rows] == list(range(8)) and all(r.overall == 87 and r.snippet.endswith("z z") for r in rows)
    near = pages.page_candidates(df, r"/player/\d+/[^/']+/", "page_id", "html", first=5, around=(10, 300), snippet=60).collect()
    assert len(near) == 5 and near[0].overall is None and all(len(r.snippet) <= 60 for r in near)


def test_yes_no_signals_read_and_parse_each_payload_once(spark, small):
    from touchline.operators.dispersion import yes_no_signals
    from touchline.plans.sources import market_rows

    plan = yes_no_signals(market_rows(spark, small))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(id") == 1 and plan.count("parquet") == 1


def test_yes_no_signals_drop_rows_without_a_market(spark):
    from touchline.operators.dispersion import yes_no_signals

    rows = [("m", "Yes"), ("m", "No"), ("n", "Yes"), ("o", "Yes"), ("o", "No"), ("o", None), ("p", "T1"), (None, "Yes")]
    df = spark.createDataFrame([(*r, "k", 1.0, 1.0) for r in rows], "market_id string, outcome string, signal_type string, volume double, liquidity double")
    got = sorted((r.market_id, r.outcome or "") for r in yes_no_signals(df).collect())
    assert got == [("m", "Yes"), ("n", "Yes"), ("o", "Yes"), ("p", "T1")]
