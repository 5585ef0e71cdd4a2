"""Cleaning and labelling of match rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.dates import parse_mixed_dates
from touchline.functions.numbers import to_number

# Source column names of landed match files and their names here.
SOURCE_COLUMNS = {
    "Date": "date",
    "Div": "league",
    "HomeTeam": "home_team",
    "AwayTeam": "away_team",
    "FTHG": "home_score",
    "FTAG": "away_score",
    "B365H": "opening_home_odds",
    "B365D": "opening_draw_odds",
    "B365A": "opening_away_odds",
    "B365CH": "closing_home_odds",
    "B365CD": "closing_draw_odds",
    "B365CA": "closing_away_odds",
    "AHh": "opening_handicap_line",
    "AHCh": "closing_handicap_line",
}
# Spellings of "yes" in the neutral-venue column.
TRUE_WORDS = ["true", "1", "yes"]
RESULT_KEYS = ["date", "home_team", "away_team", "home_score", "away_score"]


def standard_names(df: DataFrame, names: dict[str, str] = SOURCE_COLUMNS) -> DataFrame:
    """Rename source columns unless the standard name is already taken.

    Spark compares names without case, so ``Date`` counts as a source name, not as ``date`` itself.
    """
    present = set(df.columns)
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in present and new not in present})


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def result_label(home: Column | str = "home_score", away: Column | str = "away_score") -> Column:
    """0 home win, 1 draw, 2 away win."""
    home, away = (F.col(c) if isinstance(c, str) else c for c in (home, away))
    return F.when(home > away, 0).when(home < away, 2).otherwise(1)


def label_results(df: DataFrame) -> DataFrame:
    scored = df.withColumns({"home_score": to_number("home_score"), "away_score": to_number("away_score")})
    return scored.dropna(subset=["home_score", "away_score"]).withColumn("result", result_label())


def clean_matches(df: DataFrame) -> DataFrame:
    """Standard names, parsed day, numeric scores and the label; unscored rows go."""
    df = standard_names(df)
    require(df, ["home_score", "away_score"])
    if "date" in df.columns:
        df = df.withColumn("date", parse_mixed_dates("date"))
    return label_results(df)


def match_flags(df: DataFrame) -> DataFrame:
    def contains(word: str) -> Column:
        if "tournament" not in df.columns:
            return F.lit(0)
        return F.coalesce(F.lower("tournament").contains(word).cast("int"), F.lit(0))

    neutral = F.lit(0)
    if "neutral" in df.columns:
        neutral = F.coalesce(F.lower(F.col("neutral").cast("string")).isin(TRUE_WORDS).cast("int"), F.lit(0))
    return df.withColumns(
        {"is_neutral": neutral, "is_world_cup": contains("world cup"), "is_friendly": contains("friendly")}
    )


def latest_years(df: DataFrame, years: int) -> DataFrame:
    """Rows of the last ``years`` years before the newest day."""
    newest = df.agg(F.add_months(F.max("date"), -12 * years))
    return df.where(F.col("date") >= newest.scalar())


def both_sides_allowed(matches: DataFrame, teams: DataFrame, first_day: str = "1990-01-01") -> DataFrame:
    out = matches.dropna(subset=["date", "home_score", "away_score"]).where(F.col("date") >= F.lit(first_day).cast("date"))
    allowed = teams.select("team").distinct()
    for side in ("home_team", "away_team"):
        out = out.join(allowed.withColumnRenamed("team", side), side, "left_semi")
    return out


def clean_completed(results: DataFrame) -> DataFrame:
    """Finished matches: midnight dates, trimmed names, numeric scores; incomplete rows go."""
    if any(c not in results.columns for c in RESULT_KEYS):
        return results.limit(0)
    return results.withColumns({
        "date": parse_mixed_dates("date"),
        "home_team": F.trim("home_team"), "away_team": F.trim("away_team"),
        "home_score": to_number("home_score"), "away_score": to_number("away_score"),
    }).dropna(subset=RESULT_KEYS)
