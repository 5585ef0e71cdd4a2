"""Per-team statistics of match events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.numbers import safe_ratio

STATS = ["sb_events", "sb_shots", "sb_xg", "sb_passes", "sb_completed_passes", "sb_pressures", "sb_carries",
         "sb_pass_completion_rate", "sb_xg_per_shot"]


def event_team_stats(teams: DataFrame, events: DataFrame) -> DataFrame:
    """Counts, expected goals and ratios per (match, team); a team without events gets a zero row.

    ``teams`` lists (match_id, date, team), or (match_id, date, home_team, away_team).
    """
    if "team" not in teams.columns:
        teams = teams.select("match_id", "date", F.explode(F.array("home_team", "away_team")).alias("team"))
    kind = lambda name: F.col("type") == name
    counted = events.groupBy("match_id", "team").agg(
        F.count("*").alias("sb_events"),
        F.count_if(kind("Shot")).alias("sb_shots"),
        F.sum(F.when(kind("Shot"), F.coalesce("xg", F.lit(0.0)))).alias("sb_xg"),
        F.count_if(kind("Pass")).alias("sb_passes"),
        F.count_if(kind("Pass") & F.col("pass_outcome").isNull()).alias("sb_completed_passes"),
        F.count_if(kind("Pressure")).alias("sb_pressures"),
        F.count_if(kind("Carry")).alias("sb_carries"),
    )
    out = teams.join(counted, ["match_id", "team"], "left").fillna(0, subset=STATS[:7])
    return out.withColumns({
        "sb_pass_completion_rate": safe_ratio(F.col("sb_completed_passes"), F.col("sb_passes")),
        "sb_xg_per_shot": safe_ratio(F.col("sb_xg"), F.col("sb_shots")),
    })
