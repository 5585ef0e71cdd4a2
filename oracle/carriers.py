"""The carrier views as plain SQL over the raw tables (kept apart from the Spark code)."""

LI_MATCH = "l_suppkey % 100 <> l_partkey % 100"
MATCH_ID = """concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)), CAST(round(l_extendedprice * 100) AS BIGINT))"""
TOUR = "CASE l_returnflag WHEN 'R' THEN 'FIFA World Cup' WHEN 'A' THEN 'friendly match' ELSE 'Qualifier' END"
K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"

FIRST = "['José','Łukasz','Edin','Nuri','Øyvind','André','Zlatan','Kaká','Mário','Iker','Đorđe']"
LAST = """['Müller','García López','Džeko','Şahin','Sánchez','O''Neill','Núñez','Souza-Cruz',
 'Ibrahimović','Peña','Yıldız','van der Meer','Kovač']"""

CTE = {
    "c_matches": f"""SELECT {MATCH_ID} AS match_id, CAST(l_shipdate AS DATE) AS date,
        'T' || (l_suppkey % 100) AS home_team, 'T' || (l_partkey % 100) AS away_team,
        CAST(floor(l_quantity) AS INTEGER) % 5 AS home_score,
        CAST((l_partkey + l_linenumber) % 4 AS INTEGER) AS away_score, {TOUR} AS tournament,
        CASE l_linestatus WHEN 'O' THEN 'TRUE' ELSE 'no' END AS neutral
      FROM lineitem WHERE {LI_MATCH}""",
    "c_history": """SELECT match_id, date, home_team AS team, away_team AS opponent, 0 AS side,
        home_score AS gf, away_score AS ga FROM c_matches
      UNION ALL SELECT match_id, date, away_team, home_team, 1, away_score, home_score FROM c_matches""",
    "c_sides": """SELECT match_id, date, 'home' AS side, home_team AS team FROM c_matches
      UNION ALL SELECT match_id, date, 'away', away_team FROM c_matches""",
    "c_raw": f"""SELECT {MATCH_ID} AS match_id, CAST(l_shipdate AS DATE) AS true_date,
        ' T' || (l_suppkey % 100) AS HomeTeam, 'T' || (l_partkey % 100) || ' ' AS AwayTeam,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(floor(l_quantity) AS INTEGER) % 5 END AS hs,
        CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST((l_partkey + l_linenumber) % 4 AS INTEGER) END AS aws,
        l_discount + 1.5 AS B365CH
      FROM lineitem WHERE {LI_MATCH}""",
    "c_ratings": """SELECT 'T' || (o_custkey % 100) AS team, CAST(o_orderdate AS DATE) AS date,
        o_totalprice AS elo, o_orderkey AS seq FROM orders""",
    "c_rankings": """SELECT 'T' || (o_custkey % 100) AS team, CAST(o_orderdate AS DATE) AS date,
        CAST(o_orderkey % 200 + 1 AS DOUBLE) AS fifa_rank, o_totalprice / 100 AS fifa_points, o_orderkey AS seq
      FROM orders""",
    "c_static": "SELECT 'T' || (s_suppkey % 100) AS team, s_acctbal AS elo, s_suppkey AS seq FROM supplier",
    "c_probs": f"""SELECT match_id, date, tournament, label,
        a*a*a/(a*a*a+b*b*b+c*c*c) AS gbm_0, b*b*b/(a*a*a+b*b*b+c*c*c) AS gbm_1, c*c*c/(a*a*a+b*b*b+c*c*c) AS gbm_2,
        b*b/(a*a+b*b+c*c) AS rf_0, c*c/(a*a+b*b+c*c) AS rf_1, a*a/(a*a+b*b+c*c) AS rf_2,
        c/(a+b+c) AS logistic_0, a/(a+b+c) AS logistic_1, b/(a+b+c) AS logistic_2,
        CAST(1 AS DOUBLE)/3 AS poisson_0, CAST(1 AS DOUBLE)/3 AS poisson_1, CAST(1 AS DOUBLE)/3 AS poisson_2
      FROM (SELECT {MATCH_ID} AS match_id, CAST(l_shipdate AS DATE) AS date, {TOUR} AS tournament,
          CASE WHEN CAST(floor(l_quantity) AS INTEGER) % 5 > (l_partkey + l_linenumber) % 4 THEN 0
               WHEN CAST(floor(l_quantity) AS INTEGER) % 5 = (l_partkey + l_linenumber) % 4 THEN 1 ELSE 2 END AS label,
          1 + l_linenumber + l_extendedprice / CAST(7654321 AS DOUBLE) AS a, 1 + l_partkey % 7 + l_extendedprice / CAST(17654321 AS DOUBLE) AS b,
          1 + l_suppkey % 5 + l_extendedprice / CAST(27654321 AS DOUBLE) AS c FROM lineitem)""",
    "c_odds": f"""SELECT {MATCH_ID} AS seq, CAST(l_shipdate AS DATE) + CAST(l_orderkey % 3 - 1 AS INTEGER) AS date,
        CAST(l_shipdate AS DATE) + CAST(l_partkey % 2 AS INTEGER) AS shanghai_date,
        CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 'T' ELSE 'U' END || (l_suppkey % 100) AS home_team, 'T' || (l_partkey % 100) AS away_team,
        CAST(1.2 AS DOUBLE) + l_discount * 10 AS closing_home_odds,
        CAST(2.5 AS DOUBLE) + l_tax * 10 AS closing_draw_odds,
        CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(1.5 AS DOUBLE) + l_quantity / 10 END AS closing_away_odds
      FROM lineitem WHERE {LI_MATCH}""",
    "c_bookmaker": f"""SELECT l_orderkey AS event_id, o_orderdate AS commence_time,
        'T' || (o_custkey % 100) AS home_team, 'T' || ((o_custkey + 7) % 100) AS away_team,
        'B' || (l_suppkey % 3) AS bookmaker,
        CASE l_linenumber % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS outcome,
        CAST(0.9 AS DOUBLE) + l_quantity / 10 AS odds, {MATCH_ID} AS seq
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "c_team_events": f"""SELECT CAST(ts AS DATE) AS match_id, CAST(ts AS DATE) AS date,
        'T' || (user_id % 100) AS team,
        CASE event_type WHEN 'purchase' THEN 'Shot' WHEN 'view' THEN 'Pass' WHEN 'click' THEN 'Pass'
          WHEN 'error' THEN 'Pressure' ELSE 'Carry' END AS type,
        CASE WHEN event_type = 'purchase' THEN value / CAST(370.1237 AS DOUBLE) END AS xg,
        (event_type IN ('view','click') AND {K} % 2 = 0) AS completed
      FROM events""",
    "c_fixtures": """SELECT o_orderkey AS fixture_id, CAST(o_orderdate AS DATE) AS date,
        r_name || strftime(o_orderdate, '%Y%m') AS worldcup_group,
        1 + (day(o_orderdate) - 1) // 10 AS worldcup_matchday,
        o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS kickoff,
        h.n_name AS home_team, a.n_name AS away_team,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderkey % 4 AS DOUBLE) END AS home_score,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(o_custkey % 3 AS DOUBLE) END AS away_score
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation h ON c_nationkey = h.n_nationkey
        JOIN region ON h.n_regionkey = r_regionkey JOIN nation a ON a.n_nationkey = (h.n_nationkey + 5) % 25""",
    "c_players": f"""SELECT *, first_names || ' ' || last_names AS display_name FROM (
      SELECT c_custkey AS player_id, n_name AS team,
        {FIRST}[CAST(c_custkey % 11 AS INTEGER) + 1] AS first_names,
        {LAST}[CAST((c_custkey // 3) % 13 AS INTEGER) + 1] AS last_names,
        DATE '1980-01-01' + CAST(c_custkey % 200 AS INTEGER) AS birthdate,
        c_mktsegment || (c_custkey % 20) AS club,
        CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS value,
        ['GK','DF','MID','FW'][CAST(c_custkey % 4 AS INTEGER) + 1] AS position,
        CAST(c_custkey * 7 % 60 + 40 AS DOUBLE) AS pace, CAST(c_custkey * 11 % 60 + 40 AS DOUBLE) AS shooting,
        CAST(c_custkey * 13 % 60 + 40 AS DOUBLE) AS passing, CAST(c_custkey * 17 % 60 + 40 AS DOUBLE) AS dribbling,
        CAST(c_custkey * 19 % 60 + 40 AS DOUBLE) AS defending,
        CAST(c_custkey * 23 % 60 + 40 AS DOUBLE) AS physicality
      FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "c_source_base": """SELECT player_id AS seq, team AS nationality, player_id % 11 AS copy,
        CASE player_id % 5 WHEN 1 THEN last_names WHEN 3 THEN first_names || ' Jr' ELSE first_names END AS first_name,
        CASE player_id % 5 WHEN 1 THEN first_names ELSE last_names END AS last_name,
        CASE WHEN player_id % 5 = 4 THEN first_names || ' ' || last_names END AS common_name,
        CASE WHEN player_id % 5 <> 2 THEN birthdate END AS birthdate, club, value, position,
        pace + shooting AS overall FROM c_players""",
    "c_player_source": """SELECT seq, nationality, first_name, last_name, common_name, birthdate, club, value,
        position, overall FROM c_source_base
      UNION ALL SELECT seq + 1000000000, nationality, first_name, last_name, common_name, birthdate, club, value,
        position, overall + 1 FROM c_source_base WHERE copy = 0""",
    "c_appearances": """SELECT l_orderkey AS game_id, o_custkey AS player_id, CAST(l_shipdate AS DATE) AS date,
        year(o_orderdate) AS season, l_returnflag AS competition_id, CAST(l_quantity AS INTEGER) + 40 AS minutes_played,
        l_linenumber % 3 AS goals, l_partkey % 2 AS assists, CAST(l_suppkey % 4 = 0 AS INTEGER) AS yellow_cards,
        CAST(l_suppkey % 25 = 0 AS INTEGER) AS red_cards,
        CASE l_linestatus WHEN 'O' THEN 'Starting_lineup' ELSE 'substitutes' END AS type
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "c_snapshots": f"""SELECT event_id, 'M' || (user_id % 50) AS match_id,
        CASE WHEN event_type IN ('view','click','error') THEN 'had' ELSE 'hhad' END AS pool_code,
        CASE {K} % 3 WHEN 0 THEN 'home_win' WHEN 1 THEN 'draw' ELSE 'away_win' END AS outcome,
        CAST(1.01 AS DOUBLE) + value / 100 AS odds,
        CASE WHEN event_type IN ('view','click','error') THEN '' ELSE '-1' END AS handicap_line,
        ts AS fetched_at, CASE WHEN event_type = 'error' THEN 'cached_latest' ELSE 'live' END AS snapshot_source
      FROM events""",
    "c_trades_base": f"""SELECT event_id, concat_ws('|', event_id, user_id, event_type) AS trade_id,
        CASE WHEN event_type IN ('purchase','click') THEN 'buy' ELSE 'SELL' END AS side,
        value * 20 AS size, CAST({K} AS DOUBLE) / 100 AS price,
        CASE WHEN {K} % 2 = 0 THEN 'FIFA World Cup Exact Score: T' || (user_id % 100) || ' v T' || ({K} % 100)
          || ' on ' || strftime(ts, '%Y-%m-%d') || '?' ELSE 'Song contest winner' END AS title,
        'slug-' || event_id AS slug, ts FROM events""",
    "c_trades": "SELECT * FROM c_trades_base UNION ALL SELECT * FROM c_trades_base WHERE event_id % 10 = 0",
    "c_lambdas": f"""SELECT {MATCH_ID} AS match_id, CAST(0.2 AS DOUBLE) + l_quantity / 20 + l_extendedprice / CAST(7654321 AS DOUBLE) AS home_lambda,
        CAST(0.2 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 3 AS away_lambda,
        CAST(l_partkey % 5 - 2 AS DOUBLE) / 2 AS handicap_line FROM lineitem""",
}
