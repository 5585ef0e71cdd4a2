"""Appends and snapshots that are repeated, or fail half-way, change nothing that a reader sees."""

import pytest

from touchline.sources import sinks

SCHEMA = "match_id string, match_date string, odds double, snapshot_source string"


def snapshot(spark, odds):
    return spark.createDataFrame([("m", "2026-06-01", odds, "live"), ("n", None, odds, "live"), ("m", "2026-06-01", 9.0, "cached")], SCHEMA)


def test_a_repeated_append_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "history")
    with pytest.raises(ValueError):
        sinks.read_history(spark, path)
    assert sinks.append_history(snapshot(spark, 1.5), path, "2026-06-01T10")
    assert not sinks.append_history(snapshot(spark, 7.0), path, "2026-06-01T10")
    assert sinks.append_history(snapshot(spark, 1.6), path, "2026-06-01T11")
    rows = lambda: sorted((r.batch, r.match_id, r.odds) for r in sinks.read_history(spark, path).collect())
    want = [("2026-06-01T10", "m", 1.5), ("2026-06-01T10", "n", 1.5), ("2026-06-01T11", "m", 1.6), ("2026-06-01T11", "n", 1.6)]
    assert rows() == want
    # A writer that died before its marker: its files are not read, and the next try replaces them.
    sinks.live_rows(snapshot(spark, 3.0)).write.parquet(f"{path}/batch=2026-06-01T12")
    (tmp_path / "history" / "batch=2026-06-01T12" / "_SUCCESS").unlink()
    assert rows() == want
    assert sinks.append_history(snapshot(spark, 1.7), path, "2026-06-01T12")
    assert rows() == want + [("2026-06-01T12", "m", 1.7), ("2026-06-01T12", "n", 1.7)]


def test_snapshot_versions(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    sinks.write_snapshot(snapshot(spark, 1.0), root, "2")
    sinks.write_snapshot(snapshot(spark, 2.0), root, "10")
    sinks.write_snapshot(snapshot(spark, 5.0), root, "2")
    assert {r.odds for r in sinks.read_snapshot(spark, root, "2").collect()} == {1.0, 9.0}
    assert sinks.read_snapshot(spark, root, "10").count() == 3
    assert sinks.read_snapshot(spark, root).count() == 3
    snapshot(spark, 4.0).write.parquet(f"{root}/version=11")
    (tmp_path / "snapshots" / "version=11" / "_SUCCESS").unlink()
    with pytest.raises(ValueError):
        sinks.read_snapshot(spark, root, "11")
    assert 4.0 not in {r.odds for r in sinks.read_snapshot(spark, root).collect()}
