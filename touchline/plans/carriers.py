"""Match, rating, market and player tables derived from the driver's star schema.

Every carrier is a plain projection (or key join) of the given tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.tables import table

MATCH_ID = """concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    unix_date(to_date(l_shipdate)), cast(round(l_extendedprice * 100) as bigint))"""
TOURNAMENT = """case l_returnflag when 'R' then 'FIFA World Cup'
    when 'A' then 'friendly match' else 'Qualifier' end"""


def _lineitem_matches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").where("l_suppkey % 100 <> l_partkey % 100")


def matches(spark: SparkSession, folder: str) -> DataFrame:
    return _lineitem_matches(spark, folder).selectExpr(
        f"{MATCH_ID} as match_id",
        "to_date(l_shipdate) as date",
        "concat('T', l_suppkey % 100) as home_team",
        "concat('T', l_partkey % 100) as away_team",
        "cast(floor(l_quantity) % 5 as int) as home_score",
        "cast((l_partkey + l_linenumber) % 4 as int) as away_score",
        f"{TOURNAMENT} as tournament",
        "case l_linestatus when 'O' then 'TRUE' else 'no' end as neutral",
    )


def raw_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The match table as it is landed: source column names, text dates and scores."""
    return _lineitem_matches(spark, folder).selectExpr(
        f"{MATCH_ID} as match_id",
        """case l_linenumber % 3 when 0 then date_format(l_shipdate, 'yyyy-MM-dd')
           when 1 then date_format(l_shipdate, 'dd/MM/yyyy')
           else date_format(l_shipdate, 'yyyy/MM/dd') end as Date""",
        "concat(' T', l_suppkey % 100) as HomeTeam",
        "concat('T', l_partkey % 100, ' ') as AwayTeam",
        "case when l_linenumber = 7 then '' else cast(floor(l_quantity) % 5 as string) end as FTHG",
        "case when l_linenumber = 6 then 'n/a' else cast((l_partkey + l_linenumber) % 4 as string) end as FTAG",
        "l_discount + 1.5 as B365CH",
    )


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "concat('T', o_custkey % 100) as team",
        "to_date(o_orderdate) as date",
        "o_totalprice as elo",
        "o_orderkey as seq",
    )


def rankings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "concat('T', o_custkey % 100) as team",
        "to_date(o_orderdate) as date",
        "cast(o_orderkey % 200 + 1 as double) as fifa_rank",
        "o_totalprice / 100 as fifa_points",
        "o_orderkey as seq",
    )


def static_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "concat('T', s_suppkey % 100) as team", "s_acctbal as elo", "s_suppkey as seq"
    )


def text_dates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        """case o_orderkey % 5 when 0 then date_format(o_orderdate, 'yyyy-MM-dd')
           when 1 then date_format(o_orderdate, 'yyyy/M/d')
           when 2 then date_format(o_orderdate, 'dd/MM/yyyy')
           when 3 then date_format(o_orderdate, 'yyyy-MM-dd 12:30:00')
           else 'to be confirmed' end as text""",
    )


def model_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Four component models' 1X2 probabilities with the true label (0 home, 1 draw, 2 away)."""
    base = table(spark, folder, "lineitem").selectExpr(
        f"{MATCH_ID} as match_id",
        "to_date(l_shipdate) as date",
        f"{TOURNAMENT} as tournament",
        """case when floor(l_quantity) % 5 > (l_partkey + l_linenumber) % 4 then 0
           when floor(l_quantity) % 5 = (l_partkey + l_linenumber) % 4 then 1 else 2 end as label""",
        "1 + l_linenumber + l_extendedprice / 7654321D as a",
        "1 + l_partkey % 7 + l_extendedprice / 17654321D as b",
        "1 + l_suppkey % 5 + l_extendedprice / 27654321D as c",
    )
    def shares(*weights):
        total = weights[0] + weights[1] + weights[2]
        return tuple(w / total for w in weights)

    x, y, z = F.col("a"), F.col("b"), F.col("c")
    parts = {"gbm": shares(x * x * x, y * y * y, z * z * z), "rf": shares(y * y, z * z, x * x), "logistic": shares(z, x, y),
             "poisson": shares(F.lit(1.0), F.lit(1.0), F.lit(1.0))}
    return base.select(
        "match_id", "date", "tournament", "label",
        *[part[i].alias(f"{name}_{i}") for name, part in parts.items() for i in range(3)],
    )


def closing_odds(spark: SparkSession, folder: str) -> DataFrame:
    """Odds whose date may be a day off the match date; two in three are listed under a home team that plays no match."""
    return _lineitem_matches(spark, folder).selectExpr(
        f"{MATCH_ID} as seq",
        "date_add(to_date(l_shipdate), cast(l_orderkey % 3 - 1 as int)) as date",
        "date_add(to_date(l_shipdate), cast(l_partkey % 2 as int)) as shanghai_date",
        "concat(if((l_orderkey + l_linenumber) % 3 = 0, 'T', 'U'), l_suppkey % 100) as home_team",
        "concat('T', l_partkey % 100) as away_team",
        "1.2 + l_discount * 10 as closing_home_odds",
        "2.5 + l_tax * 10 as closing_draw_odds",
        "case when l_linenumber = 1 then null else 1.5 + l_quantity / 10 end as closing_away_odds",
    )


def bookmaker_odds(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").selectExpr("o_orderkey", "o_orderdate", "o_custkey")
    return (
        table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .selectExpr(
            "l_orderkey as event_id",
            "o_orderdate as commence_time",
            "concat('T', o_custkey % 100) as home_team",
            "concat('T', (o_custkey + 7) % 100) as away_team",
            "concat('B', l_suppkey % 3) as bookmaker",
            "case l_linenumber % 3 when 0 then 'home' when 1 then 'draw' else 'away' end as outcome",
            "0.9 + l_quantity / 10 as odds",
            f"{MATCH_ID} as seq",
        )
    )


def team_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "to_date(ts) as match_id",
        "to_date(ts) as date",
        "concat('T', user_id % 100) as team",
        """case event_type when 'purchase' then 'Shot' when 'view' then 'Pass' when 'click' then 'Pass'
           when 'error' then 'Pressure' else 'Carry' end as type""",
        "case when event_type = 'purchase' then value / 370.1237 end as xg",
        """case when event_type in ('view', 'click') and cast(get_json_object(props, '$.k') as int) % 2 = 1
           then 'Incomplete' end as pass_outcome""",
    )


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    away = nation.selectExpr("n_nationkey as away_key", "n_name as away_name")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(home, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(away, F.expr("(n_nationkey + 5) % 25 = away_key"))
        .selectExpr(
            "o_orderkey as fixture_id",
            "to_date(o_orderdate) as date",
            "concat(r_name, date_format(o_orderdate, 'yyyyMM')) as worldcup_group",
            "cast(1 + floor((day(o_orderdate) - 1) / 10) as int) as worldcup_matchday",
            "cast(o_orderdate as timestamp) + make_dt_interval(0, cast(o_orderkey % 24 as int)) as local_kickoff",
            "n_name as home_team",
            "away_name as away_team",
            "case when o_orderstatus <> 'O' then cast(o_orderkey % 4 as double) end as home_score",
            "case when o_orderstatus <> 'O' then cast(o_custkey % 3 as double) end as away_score",
        )
    )


# Name tokens with accents, dotless letters and hyphens.
FIRST_NAMES = ["José", "Łukasz", "Edin", "Nuri", "Øyvind", "André", "Zlatan", "Kaká", "Mário", "Iker", "Đorđe"]
LAST_NAMES = ["Müller", "García López", "Džeko", "Şahin", "Sánchez", "O'Neill", "Núñez", "Souza-Cruz",
              "Ibrahimović", "Peña", "Yıldız", "van der Meer", "Kovač"]


def _pick(words: list[str], index: str) -> str:
    listed = ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)
    return f"element_at(array({listed}), cast({index} % {len(words)} as int) + 1)"


def players(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    return (
        table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .selectExpr(
            "c_custkey as player_id",
            "n_name as team",
            f"{_pick(FIRST_NAMES, 'c_custkey')} as first_names",
            f"{_pick(LAST_NAMES, 'floor(c_custkey / 3)')} as last_names",
            "date_add(date'1980-01-01', cast(c_custkey % 200 as int)) as birthdate",
            "concat(c_mktsegment, c_custkey % 20) as club",
            "case when c_custkey % 9 <> 0 then c_acctbal end as value",
            "element_at(array('GK', 'DF', 'MID', 'FW'), cast(c_custkey % 4 as int) + 1) as position",
            *[f"cast(c_custkey * {prime} % 60 + 40 as double) as {attr}"
              for attr, prime in zip(ATTRIBUTES, (7, 11, 13, 17, 19, 23))],
        )
        .withColumn("display_name", F.concat_ws(" ", "first_names", "last_names"))
    )


ATTRIBUTES = ["pace", "shooting", "passing", "dribbling", "defending", "physicality"]


def player_source(spark: SparkSession, folder: str) -> DataFrame:
    """A second source of the same people: reversed names, missing dates, changed tokens, copies."""
    base = players(spark, folder).withColumnsRenamed({"first_names": "f", "last_names": "l"})
    shaped = base.selectExpr(
        "player_id as seq", "team as nationality", "player_id % 5 as shape", "player_id % 11 as copy",
        """case player_id % 5 when 1 then l when 3 then concat(f, ' Jr') else f end as first_name""",
        "case player_id % 5 when 1 then f else l end as last_name",
        "case when player_id % 5 = 4 then concat(f, ' ', l) end as common_name",
        "case when player_id % 5 <> 2 then birthdate end as birthdate",
        "club", "value", "position", "pace + shooting as overall",
    )
    copies = shaped.where("copy = 0").withColumns(
        {"seq": F.col("seq") + 1_000_000_000, "overall": F.col("overall") + 1}
    )
    return shaped.unionByName(copies).drop("shape", "copy")


def appearances(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderdate")
    return (
        table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .selectExpr(
            "l_orderkey as game_id",
            "o_custkey as player_id",
            "to_date(l_shipdate) as date",
            "year(o_orderdate) as season",
            "l_returnflag as competition_id",
            "cast(l_quantity + 40 as int) as minutes_played",
            "cast(l_linenumber % 3 as int) as goals",
            "cast(l_partkey % 2 as int) as assists",
            "cast(l_suppkey % 4 = 0 as int) as yellow_cards",
            "cast(l_suppkey % 25 = 0 as int) as red_cards",
            "case l_linestatus when 'O' then 'Starting_lineup' else 'substitutes' end as type",
        )
    )


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    k = "cast(get_json_object(props, '$.k') as int)"
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "concat('M', user_id % 50) as match_id",
        "case when event_type in ('view', 'click', 'error') then 'had' else 'hhad' end as pool_code",
        f"case {k} % 3 when 0 then 'home_win' when 1 then 'draw' else 'away_win' end as outcome",
        "1.01 + value / 100 as odds",
        "case when event_type in ('view', 'click', 'error') then '' else '-1' end as handicap_line",
        "cast(ts as timestamp) as fetched_at",
        "case when event_type = 'error' then 'cached_latest' else 'live' end as snapshot_source",
    )


def trades(spark: SparkSession, folder: str) -> DataFrame:
    k = "cast(get_json_object(props, '$.k') as int)"
    base = table(spark, folder, "events").selectExpr(
        "event_id",
        "concat_ws('|', event_id, user_id, event_type) as trade_id",
        "case when event_type in ('purchase', 'click') then 'buy' else 'SELL' end as side",
        "value * 20 as size",
        f"{k} / 100 as price",
        f"""case when {k} % 2 = 0 then concat('FIFA World Cup Exact Score: T', user_id % 100, ' v T', {k} % 100,
            ' on ', date_format(ts, 'yyyy-MM-dd'), '?') else 'Song contest winner' end as title""",
        "concat('slug-', event_id) as slug",
        "cast(ts as timestamp) as ts",
    )
    repeats = base.where("event_id % 10 = 0")
    return base.unionByName(repeats)


def goal_rates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        f"{MATCH_ID} as match_id",
        "0.2 + l_quantity / 20 + l_extendedprice / 7654321D as home_lambda",
        "0.2 + l_linenumber / 3 as away_lambda",
        "cast(l_partkey % 5 - 2 as double) / 2 as handicap_line",
    )


#: Bytes of files whose matches one task lists and sorts, and the most tasks.
TASK_BYTES, MOST_TASKS = 2 << 20, 5000


def market_matches(spark: SparkSession, folder: str, together: bool = False) -> DataFrame:
    """One row per match with both pools' odds and probabilities, strength and mood signals.

    ``together`` deals the rows out by match before anything is made of them. What is grouped, joined or windowed by match
    after that moves no rows, however many are listed of a match. Tasks are as many as the files have ``TASK_BYTES``.
    """
    lines = table(spark, folder, "lineitem")
    if together:
        size = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        tasks = max(spark.sparkContext.defaultParallelism, min(MOST_TASKS, size // TASK_BYTES + 1))
        lines = lines.repartition(tasks, F.expr(MATCH_ID))
    rows = lines.selectExpr(
        f"{MATCH_ID} as match_id", "to_date(l_shipdate) as day",
        "1 + l_linenumber + l_extendedprice / 7654321D as a", "cast(1 + l_partkey % 7 as double) as b", "cast(1 + l_suppkey % 5 as double) as c",
        "1.1 + l_discount * 20 + l_extendedprice / 7654321D as home_odds", "2.6 + l_tax * 10 + l_extendedprice / 7654321D as draw_odds", "1.2 + l_quantity / 12 + l_extendedprice / 7654321D as away_odds",
        "cast(l_partkey % 5 - 2 as double) / 2 as line",
        *[f"1.3 + ((l_partkey + {i}) % 20) / 8 + l_extendedprice / 7654321D as hhad_{s}_odds" for i, s in enumerate(("home", "draw", "away"))],
        *[f"((l_suppkey + {i}) % 7 - 3) / 20 as signal_{i}" for i in range(6)],
        "case when l_partkey % 4 > 0 then (l_partkey % 13 - 6) / 2 end as sentiment_diff",
        "case when l_linenumber % 3 = 0 then l_quantity * 40 - 1000 end as elo_diff",
        "case when l_linenumber % 2 = 0 then l_extendedprice / 100 - 500 end as fifa_points_diff",
        "l_quantity - 25 as rating_diff", "l_extendedprice * 100 as home_value", "(l_partkey % 50) * 100000D as away_value",
        "case when l_linenumber > 4 then 1.5D end as closing_home_odds",
        "case when l_linenumber > 4 then 3.5D end as closing_draw_odds",
        "case when l_linenumber > 5 then 4.5D end as closing_away_odds",
        "case when l_linenumber < 7 then (l_partkey % 11) / 10 end as home_pressure", "(l_suppkey % 11) / 10 as away_pressure",
        "0.2 + l_quantity / 20 + l_extendedprice / 7654321D as home_lambda", "0.2 + l_linenumber / 3 as away_lambda",
        "l_partkey", "l_suppkey", "l_linenumber",
    )
    total = F.col("a") + F.col("b") + F.col("c")
    named = dict(zip(("home_prob", "draw_prob", "away_prob", "hhad_away_prob", "hhad_home_prob", "hhad_draw_prob"), "abcabc"))
    rows = rows.withColumns({n: F.col(v) / total for n, v in named.items()})
    best = F.greatest("home_prob", "draw_prob", "away_prob")
    pick = F.when(F.col("home_prob") == best, "主胜").when(F.col("draw_prob") == best, "平局").otherwise("客胜")
    return rows.withColumn("model_pick", pick).drop("a", "b", "c")


def selections(spark: SparkSession, folder: str) -> DataFrame:
    return selections_of(market_matches(spark, folder))


def selections_of(games: DataFrame) -> DataFrame:
    """Six selections per match (1X2, then handicap), with the match's own columns beside them."""
    names = [("HAD 胜平负", s, label, f"{s}_prob", f"{s}_odds") for s, label in zip(("home", "draw", "away"), ("主胜", "平局", "客胜"))]
    names += [("HHAD 让球胜平负", s, label, f"hhad_{s}_prob", f"hhad_{s}_odds") for s, label in zip(("home", "draw", "away"), ("让胜", "让平", "让负"))]
    items = F.array(*[
        F.struct(
            F.lit(i).alias("pos"), F.lit(pool).alias("pool"), F.lit(label).alias("selection"), F.col(prob).alias("probability"),
            F.col(odds).alias("odds"), F.col(f"signal_{i}").alias("signal"),
            ((F.col("model_pick") == label) if i < 3 else F.lit(False)).alias("is_model_pick"))
        for i, (pool, _, label, prob, odds) in enumerate(names)])
    return games.select("*", F.inline(items))


def listed_scores(matches_: DataFrame) -> DataFrame:
    """Five exact-score prices per match; a third of the matches list only far-fetched scores."""
    labels = """element_at(array(array('1-0', '2-1', '0-0', '1-1', '0-1'), array('2-0', '0-0', '1-2', 'home_other', '0-2'),
        array('6-6', '5-6', '6-0', '0-6', '5-5')), cast(l_partkey % 3 as int) + 1)"""
    return matches_.selectExpr("*", f"posexplode({labels}) as (pos, label)").withColumn(
        "odds", F.expr("0.9 + ((l_partkey + 3 * pos) % 30) / 2"))
