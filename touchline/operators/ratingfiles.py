"""Landed rating and squad files brought to one layout."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.aliases import canonical_team
from touchline.functions.numbers import mean_available, to_number
from touchline.functions.text import normalize_person_legacy, simplify_position

ATTRIBUTES = ["pace", "shooting", "passing", "dribbling", "defending", "physicality"]
# Detailed attributes averaged into each card attribute.
CAREER_PARTS = {
    "pace": ["Acceleration", "Sprint speed"],
    "shooting": ["Finishing", "Shot power", "Long shots", "Volleys", "Penalties"],
    "passing": ["Crossing", "Short passing", "Long passing", "Vision", "Curve", "Free kick accuracy"],
    "dribbling": ["Dribbling", "Ball control", "Agility", "Balance", "Reactions"],
    "defending": ["Marking", "Standing tackle", "Sliding tackle", "Interceptions"],
    "physicality": ["Strength", "Stamina", "Jumping", "Aggression"],
}
CARD_COLUMNS = ["PACE", "SHOOTING", "PASSING", "DRIBBLING", "DEFENDING", "PHYSICAL"]
MODERN_COLUMNS = ["PAC", "SHO", "PAS", "DRI", "DEF", "PHY"]


def _layout(df: DataFrame, year: int, team: Column, name: str, position: str, club: str, attributes: dict[str, Column], overall: str) -> DataFrame:
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return df.select(
        "seq", F.lit(year).alias("worldcup_year"), F.coalesce(canonical_team(team, "ratings"), F.lit("")).alias("team_name"),
        text(F.col(name)).alias("player_name"), simplify_position(position, "rating").alias("simplified_position"),
        text(F.col(club)).alias("club_name"), *[F.coalesce(v, F.lit(0.0)).alias(a) for a, v in attributes.items()],
        F.coalesce(to_number(overall), F.lit(0.0)).alias("overall"),
        normalize_person_legacy(text(F.col(name))).alias("name_key"),
    ).where("player_name <> ''")


def standard_ratings(files: dict[str, DataFrame]) -> DataFrame:
    """``cards`` (ready attributes, no team), ``career`` (detailed attributes) and ``modern`` files;
    all-time special cards of the modern file are left out."""
    parts = []
    if "cards" in files:
        attrs = {a: to_number(c) for a, c in zip(ATTRIBUTES, CARD_COLUMNS)}
        parts.append(_layout(files["cards"], 2010, F.lit(""), "NAME", "POSITION", "CLUB", attrs, "RATING"))
    if "career" in files:
        df = files["career"]
        # Backticks: source names hold blanks.
        quoted = {a: [f"`{c}`" for c in cols if c in df.columns] for a, cols in CAREER_PARTS.items()}
        attrs = {a: mean_available([*cols], cols) for a, cols in quoted.items()}
        parts.append(_layout(df, 2018, F.col("Nationality"), "Name", "Preferred Positions", "Club", attrs, "Overall"))
    if "modern" in files:
        df = files["modern"]
        special = F.lower(F.coalesce("Version", F.lit(""))).rlike("icon|hero") | F.lower(F.coalesce("Club", F.lit(""))).contains("icon")
        attrs = {a: to_number(c) for a, c in zip(ATTRIBUTES, MODERN_COLUMNS)}
        parts.append(_layout(df.where(~special), 2022, F.col("Country"), "Name", "Position", "Club", attrs, "Ratings"))
    return reduce(DataFrame.unionByName, parts)


def squad_rows(squads: DataFrame, extra: Sequence[str], years: Sequence[int] = (2010, 2014, 2018, 2022)) -> DataFrame:
    """Distinct squad members of the chosen tournaments with a name key."""
    year = F.regexp_extract("tournament_name", r"(\d{4})", 1).try_cast("int")
    given, family = F.trim(F.coalesce("given_name", F.lit(""))), F.trim(F.coalesce("family_name", F.lit("")))
    rows = squads.where(F.col("tournament_name").rlike("FIFA.*World Cup")).withColumn("worldcup_year", year)
    rows = rows.where(F.col("worldcup_year").isin(list(years))).withColumn("player_name", F.trim(F.concat_ws(" ", given, family)))
    return rows.select("worldcup_year", *extra, "player_name", normalize_person_legacy("player_name").alias("name_key")).distinct()


def team_year_key(rows: DataFrame) -> DataFrame:
    """Year-specific team keys, so that squads of different years never mix."""
    return rows.withColumns({
        "team_key": F.concat_ws("__", "team_name", F.col("worldcup_year").cast("string")), "real_team_name": F.col("team_name")})
