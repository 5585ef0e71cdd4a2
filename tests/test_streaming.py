"""Streams replayed from files give the rows of their batch twins."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import market
from touchline.plans import carriers as c
from touchline.plans.markets import event_games
from touchline.sources import versions
from touchline.streaming import alerts


def replay(spark, df, path, files, order):
    """Write ``df`` as time-ordered files and read them back one per micro-batch."""
    part = F.ntile(files).over(Window.orderBy(order))
    rows = df.withColumn("_n", part).persist()
    for n in range(1, files + 1):
        rows.where(F.col("_n") == n).drop("_n").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, df, name, checkpoint):
    query = (df.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", checkpoint).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def closing_row(rows, at="2030-01-01"):
    """A row far in the future, so that the watermark passes all others."""
    return rows.limit(1).withColumns({
        "event_id": F.lit(-1).cast(rows.schema["event_id"].dataType), "match_id": F.lit("none"), "fetched_at": F.lit(at).cast("timestamp")})


def write_files(parts, path):
    """One file per part, in this order."""
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/{n:03d}")


@pytest.mark.parametrize("shuffled", [False, True])
def test_odds_changes_equal_batch(spark, small, tmp_path, shuffled):
    rows = c.snapshots(spark, small).select("event_id", "match_id", "pool_code", "outcome", "fetched_at", "odds").persist()
    order = F.xxhash64("event_id") if shuffled else F.col("fetched_at")
    placed = rows.withColumn("_n", F.ntile(3).over(Window.orderBy(order))).persist()
    write_files([*[placed.where(f"_n = {n}").drop("_n") for n in (1, 2, 3)], closing_row(rows)], str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    alerts_ = alerts.odds_change_alerts(stream, lateness="60 days" if shuffled else "1 hour", keep_days=400)
    got = drain(spark, alerts_, f"odds_moves_{shuffled}", str(tmp_path / "cp"))
    want = market.successive_changes(rows)
    key = lambda df: sorted((r.event_id, round(r.previous_odds, 9), round(r.odds_change, 9)) for r in df.collect())
    assert key(got) == key(want) and got.count() > 100


def test_late_rows_and_forgotten_keys(spark, tmp_path):
    schema = "event_id bigint, match_id string, pool_code string, outcome string, fetched_at timestamp, odds double"
    row = lambda event, at, odds: (event, "m", "had", "home", pd.Timestamp(at).to_pydatetime(), odds)
    batches = [
        [row(1, "2026-06-01 10:00", 2.0), row(3, "2026-06-01 10:20", 3.0)],
        [row(2, "2026-06-01 10:10", 2.5), row(4, "2026-06-01 12:00", 3.5)],  # event 2 is late but within the hour
        [row(5, "2026-06-01 10:30", 9.0), row(6, "2026-06-01 12:10", 4.0)],  # event 5 comes before the watermark is moved
        [row(11, "2026-06-01 10:05", 8.0), row(7, "2026-06-09 10:00", 5.0)],  # event 11 is too late; after two quiet days the key is forgotten
        [(8, "none", "had", "home", pd.Timestamp("2030-01-01").to_pydatetime(), 1.0)],
        [row(9, "2030-01-01 00:10", 7.0)], [(10, "none", "had", "home", pd.Timestamp("2031-01-01").to_pydatetime(), 1.0)],
    ]
    write_files([spark.createDataFrame(b, schema) for b in batches], str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = drain(spark, alerts.odds_change_alerts(stream, lateness="1 hour", keep_days=2), "late_moves", str(tmp_path / "cp"))
    assert sorted((r.event_id, r.previous_odds, r.odds) for r in got.collect()) == [
        (2, 2.0, 2.5), (3, 2.5, 3.0), (4, 9.0, 3.5), (5, 3.0, 9.0), (6, 3.5, 4.0)]


def test_large_buys_equal_batch(spark, small, tmp_path):
    rows = c.trades(spark, small)
    stream = replay(spark, rows, str(tmp_path / "in"), 2, "ts")
    got = drain(spark, alerts.large_buy_alerts(stream, 300.0, "40 days"), "buys", str(tmp_path / "cp"))
    want = market.large_buys(rows, 300.0)
    assert sorted(r.trade_id for r in got.collect()) == sorted(r.trade_id for r in want.collect())
    assert want.count() > 0


def test_match_buys_join_static_matches(spark, small, tmp_path):
    rows = c.trades(spark, small)
    games = event_games(spark, small)
    stream = replay(spark, rows, str(tmp_path / "in"), 2, "ts")
    got = drain(spark, alerts.match_buy_alerts(stream, games, 300.0).select("trade_id", "match_key"), "match_buys", str(tmp_path / "cp"))
    want = market.attribute_trades(market.large_buys(rows, 300.0), games)
    pairs = lambda df: sorted((r.trade_id, r.match_key) for r in df.collect())
    assert pairs(got) == pairs(want) and len(pairs(want)) > 0


def test_history_keeps_live_rows_once(spark, small, tmp_path):
    rows = c.snapshots(spark, small)
    stream = replay(spark, rows, str(tmp_path / "in"), 2, "fetched_at")
    for _ in range(2):  # the second start finds nothing new
        query = alerts.history_append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.where("snapshot_source = 'live'").count()


RESULTS = "date date, home_team string, away_team string, home_score double, away_score double, tournament string, neutral string"


def results(spark, rows, seq=False):
    rows = [(dt.date.fromisoformat(r[0]), *r[1:5], None, None, *r[5:]) for r in rows]
    return spark.createDataFrame(rows, RESULTS + (", seq bigint" if seq else ""))


def test_upsert_stream_keeps_versions(spark, tmp_path):
    base = [("2026-06-11", "A", "B", None, None), ("2026-06-11", "C", "D", None, None), ("2026-06-12", "A", "C", None, None)]
    results(spark, base).write.parquet(str(tmp_path / "base"))
    root = str(tmp_path / "out")
    batches = [[("2026-06-11", "A", "B", 1.0, 0.0, 1), ("2026-06-11", "A", "B", 2.0, 0.0, 2)], [("2026-06-12", "A", "C", 3.0, 3.0, 3), ("2026-06-13", "E", "F", 0.0, 0.0, 4)]]
    write_files([results(spark, b, True) for b in batches], str(tmp_path / "in"))
    stream = spark.readStream.schema(RESULTS + ", seq bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = alerts.upsert_stream(stream, str(tmp_path / "base"), root, str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()

    def scores(version=None):
        return {(str(r.date), r.home_team): r.home_score for r in versions.read(spark, root, version).collect()}

    assert scores(-1) == {("2026-06-11", "A"): None, ("2026-06-11", "C"): None, ("2026-06-12", "A"): None}
    # The later update of a key wins, the other one is kept aside; it does not stop the stream.
    assert scores(0) == {**scores(-1), ("2026-06-11", "A"): 2.0}
    assert [r.home_score for r in spark.read.parquet(f"{root}/rejects/0").collect()] == [1.0]
    assert scores() == scores(1) == {**scores(0), ("2026-06-12", "A"): 3.0, ("2026-06-13", "E"): 0.0}
    assert {r.tournament for r in versions.read(spark, root).where("home_score is not null").collect()} == {"FIFA World Cup"}
    # Only the days that a batch touches are written.
    days = lambda v: sorted(p.parent.name for p in (tmp_path / "out" / "data").glob(f"day=*/version={v}"))
    assert days(0) == ["day=2026-06-11"] and days(1) == ["day=2026-06-12", "day=2026-06-13"]
    # A repeated batch changes nothing, nor does one that never committed.
    files = lambda: sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "out" / "data").rglob("*.parquet"))
    before = files()
    versions.upsert(results(spark, [("2026-06-11", "C", "D", 9.0, 9.0, 9)], True), root, 1)
    assert files() == before
    versions._write(results(spark, [("2026-06-11", "C", "D", 9.0, 9.0)]), root, 2)
    assert scores() == scores(1)
    # Old versions go; what the newest one still names stays.
    assert versions.drop_before(spark, root, 1) == ["2026-06-11/-1", "2026-06-12/-1"]
    assert scores() == {("2026-06-11", "A"): 2.0, ("2026-06-11", "C"): None, ("2026-06-12", "A"): 3.0, ("2026-06-13", "E"): 0.0}
