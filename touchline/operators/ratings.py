"""Ratings and rankings attached to matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.dates import parse_mixed_dates
from touchline.functions.numbers import safe_ratio, to_number
from touchline.operators.asof import as_of_sides
from touchline.operators.scan import keep_one


def clean_ratings(ratings: DataFrame) -> DataFrame:
    """Trimmed names, numeric ratings; rows without a team, rating or (when dated) readable date go."""
    out = ratings.withColumns({"team": F.trim("team"), "elo": to_number("elo")}).dropna(subset=["team", "elo"])
    if "date" in out.columns:
        out = out.withColumn("date", parse_mixed_dates("date")).dropna(subset=["date"])
    return out


def elo_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "elo_diff": F.col("home_elo") - F.col("away_elo"),
        "elo_abs_diff": F.abs(F.col("home_elo") - F.col("away_elo")),
        "elo_ratio": safe_ratio(F.col("home_elo"), F.col("away_elo")),
    })


def static_elo(matches: DataFrame, ratings: DataFrame, seq: str = "seq") -> DataFrame:
    """Undated ratings: the last row per team."""
    last = keep_one(ratings.select("team", "elo", seq), ["team"], [seq], "last")
    out = matches
    for side in ("home", "away"):
        out = out.join(
            last.select(F.col("team").alias(f"{side}_team"), F.col("elo").alias(f"{side}_elo")), f"{side}_team", "left"
        )
    return out


def dated_elo(matches: DataFrame, ratings: DataFrame, seq: str = "seq", strict: bool = True) -> DataFrame:
    return as_of_sides(matches, ratings, ["elo"], [seq], strict)


def elo_features(matches: DataFrame, ratings: DataFrame, seq: str = "seq") -> DataFrame:
    """Dated ratings when the table has dates, else static ones; differences and ratio."""
    rated = dated_elo(matches, ratings, seq) if "date" in ratings.columns else static_elo(matches, ratings, seq)
    return elo_columns(rated)


def ranking_features(matches: DataFrame, rankings: DataFrame, seq: str = "seq") -> DataFrame:
    """Rank and points before the match; a lower rank is better, so the rank difference is away - home."""
    known = rankings.dropna(subset=["date", "team", "fifa_rank", "fifa_points"])
    return as_of_sides(matches, known, ["fifa_rank", "fifa_points"], [seq]).withColumns({
        "fifa_rank_diff": F.col("away_fifa_rank") - F.col("home_fifa_rank"),
        "fifa_points_diff": F.col("home_fifa_points") - F.col("away_fifa_points"),
    })


def squad_differences(matches: DataFrame, team_features: DataFrame) -> DataFrame:
    """Team features of both sides with prefixes, and home - away for every numeric one."""
    columns = [c for c in team_features.columns if c != "team"]
    numeric = [f.name for f in team_features.schema if f.name != "team" and f.dataType.simpleString() != "string"]
    out = matches
    for side in ("home", "away"):
        out = out.join(
            team_features.select(
                F.col("team").alias(f"{side}_team"), *[F.col(c).alias(f"{side}_squad_{c}") for c in columns]
            ),
            f"{side}_team", "left",
        )
    return out.withColumns(
        {f"squad_{c}_diff": F.col(f"home_squad_{c}") - F.col(f"away_squad_{c}") for c in numeric}
    )


