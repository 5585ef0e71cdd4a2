"""Oracle SQL of the payload, source and text queries."""

from oracle.carriers import MATCH_ID
from oracle.sql import q, r
from touchline.plans import payload_text as p

ODDS_ALIAS = """MAP {'Cabo Verde':'Cape Verde','Bosnia & Herzegovina':'Bosnia and Herzegovina','Cote d''Ivoire':'Ivory Coast',
 'Czechia':'Czech Republic','Congo DR':'DR Congo','IR Iran':'Iran','Korea Republic':'South Korea','USA':'United States'}"""


def alias(name: str, table: str) -> str:
    return f"coalesce({table}[trim({name})], trim({name}))"


BOOK_TYPE = """{"id":"VARCHAR","commence_time":"VARCHAR","home_team":"VARCHAR","away_team":"VARCHAR","sport_key":"VARCHAR",
 "bookmakers":[{"key":"VARCHAR","title":"VARCHAR","markets":[{"key":"VARCHAR","outcomes":[{"name":"VARCHAR","price":"DOUBLE","point":"DOUBLE"}]}]}]}"""
BOOK = {
    "ev": f"SELECT e.* FROM (SELECT from_json({p.BOOKMAKER}, '{BOOK_TYPE}') AS e FROM part)",
    "bk": "SELECT id, commence_time, home_team, away_team, unnest(bookmakers) AS b FROM ev",
}
WIDE_STEP = """SELECT id AS event_id, b.key AS bookmaker, home_team, away_team,
  [m FOR m IN b.markets IF m.key = 'h2h'][1].outcomes AS h2h, [m FOR m IN b.markets IF m.key = 'spreads'][1].outcomes AS sp,
  [m FOR m IN b.markets IF m.key = 'totals'][1].outcomes AS tot FROM bk"""
WIDE = {
    "closing_home_odds": "[o FOR o IN h2h IF o.name = home_team][1].price",
    "closing_draw_odds": "[o FOR o IN h2h IF o.name = 'Draw'][1].price",
    "closing_away_odds": "[o FOR o IN h2h IF o.name = away_team][1].price",
    "closing_handicap_line": "[o FOR o IN sp IF o.name = home_team][1].point",
    "closing_home_handicap_odds": "[o FOR o IN sp IF o.name = home_team][1].price",
    "closing_away_handicap_line": "[o FOR o IN sp IF o.name = away_team][1].point",
    "closing_away_handicap_odds": "[o FOR o IN sp IF o.name = away_team][1].price",
    "closing_over_under_line": "[o FOR o IN tot IF o.name = 'Over'][1].point",
    "closing_over_odds": "[o FOR o IN tot IF o.name = 'Over'][1].price",
    "closing_under_odds": "[o FOR o IN tot IF o.name = 'Under'][1].price",
}
HAFU = """MAP {'hh':'胜/胜','hd':'胜/平','ha':'胜/负','dh':'平/胜','dd':'平/平','da':'平/负','ah':'负/胜','ad':'负/平','aa':'负/负'}"""
POOL_STEPS = {
    "doc": f"SELECT CAST({p.POOL} AS JSON) AS j FROM part",
    "pool": " UNION ALL ".join(f"""SELECT j, '{code}' AS pool_code, j->'{code}' AS o, unnest(json_keys(j->'{code}')) AS k FROM doc"""
                               for code in ("had", "hhad", "crs", "ttg", "hafu")),
    "cell": "SELECT *, o->>k AS v, regexp_extract(k, '^s(\\d{2})s(\\d{2})$', ['h','a']) AS sc FROM pool",
    "named": f"""SELECT *, CASE
        WHEN pool_code IN ('had','hhad') THEN MAP {{'h':'home_win','d':'draw','a':'away_win'}}[k]
        WHEN k LIKE '%f' OR k IN ('goalLine','goalLineValue','updateDate','updateTime') THEN NULL
        WHEN pool_code = 'crs' THEN coalesce(MAP {{'s1sh':'home_other','s1sd':'draw_other','s1sa':'away_other'}}[k],
          CASE WHEN sc.h <> '' THEN CAST(sc.h AS INTEGER) || '-' || CAST(sc.a AS INTEGER) END)
        WHEN pool_code = 'ttg' THEN CASE WHEN k = 's7' THEN '7+' ELSE replace(k, 's', '') END
        ELSE {HAFU}[k] END AS outcome, TRY_CAST(v AS DOUBLE) AS odds FROM cell""",
}
KINDS = """CASE WHEN t LIKE '%win the 2026 fifa world cup%' OR t LIKE '%world cup winner%' THEN 'tournament_winner'
  WHEN t LIKE '%golden boot%' THEN 'golden_boot' WHEN t LIKE '%advance%' OR t LIKE '%qualify%' THEN 'advance_or_qualify'
  WHEN t LIKE '%beat%' OR t LIKE '% vs %' OR t LIKE '%match%' THEN 'match_related' ELSE 'other_worldcup' END"""


def subject(text: str) -> str:
    patterns = [r"^Will (.+?) win the 2026 FIFA World Cup\?", r"^Will (.+?) win the World Cup\?", "^Will (.+?) advance", "^Will (.+?) qualify"]
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({text}, '(?i){x}', 1)), '')" for x in patterns) + ", '')"


EVENT_TEST = """(t LIKE '%world cup%' AND NOT (regexp_matches(t, 'opening ceremony|song|perform|halftime') AND t NOT LIKE '%winner%')
  AND regexp_matches(t, 'fifa|soccer|football|national team|golden boot|winner'))"""
MARKET_TYPE = """{"id":"VARCHAR","title":"VARCHAR","description":"VARCHAR","slug":"VARCHAR","markets":[{"id":"VARCHAR",
 "question":"VARCHAR","outcomes":"VARCHAR","outcomePrices":"VARCHAR","clobTokenIds":"VARCHAR","bestBid":"VARCHAR",
 "volume":"VARCHAR","liquidity":"VARCHAR"}]}"""


def text_list(col: str) -> str:
    return f"CASE WHEN json_valid({col}) AND json_type({col}) = 'ARRAY' THEN from_json({col}, '[\"VARCHAR\"]') ELSE [] END"


MARKET_STEPS = {
    "ev": f"SELECT e.* FROM (SELECT from_json({p.MARKETS}, '{MARKET_TYPE}') AS e FROM part)",
    "kept": f"SELECT * FROM (SELECT *, lower(concat_ws(' ', title, description, slug, '')) AS t FROM ev) WHERE {EVENT_TEST}",
    "mk": "SELECT id AS event_id, title, unnest(markets) AS m FROM kept",
    "lists": f"""SELECT event_id, m.id AS market_id, m.question AS question, lower(m.question || ' ' || title) AS t,
        {text_list('m.outcomes')} AS outs, {text_list('m.outcomePrices')} AS prices, {text_list('m.clobTokenIds')} AS tokens,
        TRY_CAST(m.bestBid AS DOUBLE) AS best_bid, TRY_CAST(m.volume AS DOUBLE) AS volume, TRY_CAST(m.liquidity AS DOUBLE) AS liquidity FROM mk""",
    "rows_": f"""SELECT event_id, market_id, outs[i + 1] AS outcome, tokens[i + 1] AS token_id, {KINDS} AS signal_type,
        {subject('question')} AS subject, TRY_CAST(prices[i + 1] AS DOUBLE) AS probability, best_bid, volume, liquidity, i AS position
      FROM (SELECT *, unnest(range(len(outs))) AS i FROM lists)""",
}

QUESTION = """['Will Spain win the 2026 FIFA World Cup?', 'will France win the world cup?', 'Will T9 advance?',
  'Will Kane win the Golden Boot', 'Will Peru QUALIFY for the finals', 'Can T1 beat T2?', 'Exact Score: T1 2 - 1 T2?',
  'Any Other Score', 'goals 3 - 3', 'nothing'][p_partkey % 10 + 1]"""
TITLE = "['World Cup Winner', 'A vs B', 'other', 'song of the world cup'][p_size % 4 + 1]"
TEXTS = f"SELECT p_partkey, {QUESTION} AS question, {TITLE} AS title, lower({QUESTION} || ' ' || {TITLE}) AS t FROM part"


def person(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


FILES = """SELECT split_part(match_id, '-', 1) AS mid, match_id AS seq, CAST(split_part(match_id, '-', 2) AS INTEGER) AS line,
   trim(HomeTeam) AS plain, trim(AwayTeam) AS away_team, hs, aws, ['韩国','美国','Peru','沙特'] AS zh,
   ['South Korea','United States','Peru','Saudi Arabia'] AS en FROM c_raw"""
FILE_ROWS = """SELECT *, f, 'round' || f || '.csv' AS source_file,
   CASE WHEN line % 2 = 0 THEN zh[line % 4 + 1] ELSE plain END AS home_team_original,
   CASE WHEN line % 2 = 0 THEN en[line % 4 + 1] ELSE plain END AS home_team
 FROM files JOIN (VALUES (0,1),(0,2),(0,3),(1,3),(1,4),(1,5),(2,5),(2,6),(2,7)) v(f, l) ON line = l"""

RESULTS_ALIAS = """MAP {'USA':'United States','Korea Republic':'South Korea','Türkiye':'Turkey','Cote d''Ivoire':'Ivory Coast','Congo DR':'DR Congo','IR Iran':'Iran'}"""
NATION_ALIAS = """MAP {'USA':'United States','Korea Republic':'South Korea','Türkiye':'Turkey','Cote d''Ivoire':'Ivory Coast','Congo DR':'DR Congo','IR Iran':'Iran','Korea, South':'South Korea'}"""
CLUB_ALIAS = "MAP {'USA':'United States','Korea Republic':'South Korea','Congo DR':'DR Congo','IR Iran':'Iran'}"

RAW_POSITION = """CASE WHEN c_custkey % 14 = 13 THEN '' ELSE ['Goalkeeper','Centre-Back','LB, CM','CDM','Second Striker','st','RW/LW','Keeper',
  'Sweeper','DEFENDER LEFT','SW','LWB',' Midfielder '][c_custkey % 14 + 1] END"""
SIMPLE = """SELECT c_custkey, trim(raw) AS raw, upper(trim(raw)) AS u, regexp_split_to_array(upper(trim(raw)), '[,/ ]+')[1] AS f
  FROM (SELECT c_custkey, """ + RAW_POSITION + """ AS raw FROM customer)"""

#: The entities that the pages of the test tables hold, with some more.
ENTITY = "regexp_replace(replace(replace(replace(replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;?', '&', 'g')"


def strip(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({ENTITY.format(x)}, '[\\s\\pZ]+', ' ', 'g'))"


LATEST = """SELECT match_id, pool_code, outcome, arg_max(odds, fetched_at) AS odds FROM c_snapshots GROUP BY ALL"""
D = ["home", "draw", "away"]
DISPERSION_STEPS = {
    "sides": "SELECT event_id, home_team, away_team, bookmaker, " + ", ".join(
        f"arg_min(odds, seq) FILTER (outcome = '{s}') AS {s}" for s in D) + " FROM c_bookmaker WHERE odds > 1 GROUP BY ALL",
    "probs": "SELECT *, " + ", ".join(f"(1 / {s}) / (1 / home + 1 / draw + 1 / away) AS {s}_p" for s in D)
    + " FROM sides WHERE home IS NOT NULL AND draw IS NOT NULL AND away IS NOT NULL",
    "agg": "SELECT event_id, home_team, away_team, count(DISTINCT bookmaker) AS n, " + ", ".join(
        f"""avg({s}) AS {s}_om, stddev_pop({s}) AS {s}_os, stddev_pop({s}) / avg({s}) AS {s}_oc, avg({s}_p) AS {s}_pm,
        stddev_pop({s}_p) AS {s}_ps, max({s}_p) - min({s}_p) AS {s}_pr""" for s in D) + " FROM probs GROUP BY ALL",
}
CELL = {"odds_mean": "om", "odds_std": "os", "odds_cv": "oc", "prob_mean": "pm", "prob_std": "ps", "prob_range": "pr"}

ORACLE = {
    "flatten_bookmaker_long": q(f"""SELECT id AS event_id, coalesce(strftime(ts, '%Y-%m-%d'), '') AS date,
        coalesce(strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d'), '') AS shanghai_date, h AS home_team, a AS away_team, bookmaker_key,
        CASE WHEN n = h THEN 'home' WHEN n = a THEN 'away' WHEN lower(n) IN ('draw','tie') THEN 'draw' END AS outcome_key,
        o.name AS outcome_name, {r('o.price')} AS odds
      FROM (SELECT *, {alias('o.name', ODDS_ALIAS)} AS n FROM outs)
      WHERE n = h OR n = a OR lower(n) IN ('draw','tie')""", **BOOK,
        mk="""SELECT id, TRY_CAST(replace(commence_time, 'Z', '') AS TIMESTAMP) AS ts, home_team, away_team, b.key AS bookmaker_key, unnest(b.markets) AS m FROM bk""",
        outs=f"""SELECT id, ts, {alias('home_team', ODDS_ALIAS)} AS h, {alias('away_team', ODDS_ALIAS)} AS a, bookmaker_key, unnest(m.outcomes) AS o
          FROM mk WHERE m.key = 'h2h'"""),
    "flatten_bookmaker_wide": q("SELECT event_id, bookmaker, home_team, away_team, " + ", ".join(
        f"{r(v)} AS {k}" for k, v in WIDE.items()) + " FROM wide", **BOOK, wide=WIDE_STEP),
    "odds_consensus": q("SELECT home_team, away_team, count(DISTINCT bookmaker) AS bookmaker_count, " + ", ".join(
        f"{r(f'avg({v})')} AS {k}" for k, v in WIDE.items()) + " FROM wide GROUP BY home_team, away_team", **BOOK, wide=WIDE_STEP),
    "odds_dispersion": q(f"""SELECT event_id, home_team, away_team, {r('n')} AS odds_api_bookmaker_count,
        {r('(home_ps + draw_ps + away_ps) / 3')} AS odds_api_prob_dispersion_mean, {r('greatest(home_ps, draw_ps, away_ps)')} AS odds_api_prob_dispersion_max,
        {r('(home_pr + draw_pr + away_pr) / 3')} AS odds_api_prob_range_mean, {r('greatest(home_pr, draw_pr, away_pr)')} AS odds_api_prob_range_max,
        {r('draw_ps + draw_oc')} AS odds_api_draw_disagreement_score, """ + ", ".join(
        f"{r(f'{s}_{short}')} AS odds_api_{s}_{long}" for s in D for long, short in CELL.items()) + " FROM agg", **DISPERSION_STEPS),
    "flatten_pool_odds": q(f"""SELECT j->>'matchId' AS match_id, j->>'matchDate' AS match_date,
        coalesce(j->>'homeTeamAllName', j->>'homeTeamAbbName') AS home_team, pool_code, k AS outcome_key, outcome,
        CASE WHEN pool_code IN ('had','hhad') THEN coalesce(o->>'goalLine', '') ELSE '' END AS handicap_line,
        trim(concat_ws(' ', o->>'updateDate', o->>'updateTime')) AS update_time, {r('odds')} AS odds
      FROM named WHERE outcome IS NOT NULL AND odds IS NOT NULL AND (j->>'leagueAbbName' LIKE '%World Cup%' OR j->>'leagueAbbName' LIKE '%世界杯%')""",
        **POOL_STEPS),
    "flatten_prediction_markets": q(f"""SELECT event_id, market_id, outcome, token_id, signal_type, subject, {r('probability')} AS probability,
        {r('best_bid')} AS best_bid, {r('volume')} AS volume, {r('liquidity')} AS liquidity, position FROM rows_""", **MARKET_STEPS),
    "yes_no_signals": q(f"""SELECT market_id, outcome, signal_type, {r('volume')} AS volume, {r('liquidity')} AS liquidity FROM rows_ x
      WHERE outcome = 'Yes' OR list_sort((SELECT list(DISTINCT y.outcome) FROM rows_ y WHERE y.market_id = x.market_id)) <> ['No','Yes']""", **MARKET_STEPS),
    "flatten_match_events": q("""SELECT CAST(j->>'match_id' AS BIGINT) AS match_id, j->>'match_date' AS date, j->'home_team'->>'home_team_name' AS home_team,
        j->'away_team'->>'away_team_name' AS away_team, CAST(j->>'home_score' AS BIGINT) AS home_score, CAST(j->>'away_score' AS BIGINT) AS away_score,
        j->'competition_stage'->>'name' AS competition_stage, j->'stadium'->>'name' AS stadium, j->'referee'->>'name' AS referee,
        j->>'match_status_360' AS match_status_360 FROM doc""", doc=f"SELECT CAST({p.MATCH} AS JSON) AS j FROM part"),
    "flatten_sentiment": q("SELECT p_partkey, '' AS off_field_reasoning, " + r("coalesce(CAST(j->>'confidence' AS DOUBLE), 0)") + " AS off_field_confidence, "
        + ", ".join(f"coalesce(CAST(j->>'{n}' AS BIGINT), 0) AS off_field_{n}" for n in ("home_overall", "away_overall", "diff"))
        + ", " + ", ".join(f"coalesce(CAST(j->'{s}_dimensions'->>'{d}' AS BIGINT), 0) AS off_field_{s}_{d}" for s in ("home", "away")
                           for d in ("morale", "external", "media", "motivation"))
        + ", CAST(coalesce(CASE WHEN json_type(j->'news') = 'ARRAY' THEN json_array_length(j->'news') END, 0) AS BIGINT) AS off_field_news_count FROM doc",
        doc=f"SELECT p_partkey, CAST({p.SENTIMENT} AS JSON) AS j FROM part"),
    "flatten_rating_items": q("""SELECT id, CAST(j->>'rank' AS INTEGER) AS rank, CAST(j->>'overallRating' AS INTEGER) AS overallRating,
        j->>'firstName' AS firstName, j->>'lastName' AS lastName, j->>'commonName' AS commonName, CAST(j->>'height' AS INTEGER) AS height,
        j->'nationality'->>'label' AS nationality, j->'team'->>'label' AS team, j->'position'->>'shortLabel' AS position,
        CAST(j->'stats'->'pac'->>'value' AS INTEGER) AS pac, CAST(j->'stats'->'def'->>'value' AS INTEGER) AS def,
        CAST(j->'stats'->'phy'->>'value' AS INTEGER) AS phy
      FROM (SELECT p_partkey % 1500 AS id, arg_min(j, p_partkey) AS j FROM doc GROUP BY p_partkey % 1500)""",
        doc=f"SELECT p_partkey, CAST({p.RATING} AS JSON) AS j FROM part"),
    "explode_groups": "SELECT DISTINCT unnest(['T' || (c_custkey % 90), 'U' || c_nationkey]) AS team FROM customer",
    "static_rating_table": q(f"""SELECT team, {r('elo')} AS elo FROM allowed LEFT JOIN rated USING (team)""",
        allowed="SELECT DISTINCT unnest(['United States','Peru','Curacao','Peru ' || c_nationkey,'T' || (c_custkey % 50)]) AS team FROM customer",
        rated="""SELECT coalesce(MAP {'USA':'United States','Czechia':'Czech Republic','Korea Republic':'South Korea','Curaçao':'Curacao'}[k], k) AS team,
          arg_max(c_acctbal, c_custkey) AS elo FROM (SELECT c_custkey, c_acctbal, ['USA','Czechia','Korea Republic','Peru','Curaçao'][c_custkey % 5 + 1]
            || CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_nationkey ELSE '' END AS k FROM customer) GROUP BY 1"""),
    "scan_union_files": q(f"""SELECT mid AS match_id, seq, source_file, home_team, home_team_original, away_team, {r('hs')} AS home_score, {r('aws')} AS away_score
      FROM (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY f, seq) AS n FROM listed) WHERE n = 1 AND hs IS NOT NULL AND aws IS NOT NULL""",
        files=FILES, listed=FILE_ROWS),
    "scan_union_years": q(f"""SELECT CAST(2014 + 4 * f AS INTEGER) AS worldcup_year, mid AS match_id, seq,
        CASE home_team WHEN 'South Korea' THEN 'Korea Republic' WHEN 'United States' THEN 'USA' WHEN 'Iran' THEN 'IR Iran' ELSE home_team END AS home_team, home_team_original,
        {r('hs')} AS home_score, {r('aws')} AS away_score
      FROM (SELECT *, row_number() OVER (PARTITION BY f, mid ORDER BY seq) AS n FROM listed) WHERE n = 1 AND hs IS NOT NULL AND aws IS NOT NULL""",
        files=FILES, listed=FILE_ROWS),
    "scan_keyed_large": q("""SELECT game_id, player_id, competition_id, CAST(minutes_played AS BIGINT) AS minutes_played, CAST(goals AS BIGINT) AS goals
      FROM c_appearances WHERE game_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-01')
        AND player_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""),
    "canonical_team": q(f"""SELECT c_custkey, {alias('raw', RESULTS_ALIAS)} AS results, CASE trim(raw) WHEN 'côte d''ivoire' THEN 'Ivory Coast' WHEN 'T rkiye' THEN 'Turkey' ELSE {alias('raw', NATION_ALIAS)} END AS nationality,
        coalesce({alias('raw', CLUB_ALIAS)}, '') AS club_stats, {alias('raw', ODDS_ALIAS)} AS odds FROM spelled""",
        spelled="""SELECT c_custkey, CASE WHEN c_custkey % 11 < 10 THEN ['USA',' Korea Republic ','Türkiye','Cote d''Ivoire','Congo DR','Brazil','Korea, South','IR Iran','côte d''ivoire','T rkiye'][c_custkey % 11 + 1] END AS raw FROM customer"""),
    "normalize_person": q(f"SELECT player_id, {person('display_name')} AS name_key FROM c_players"),
    "normalize_person_legacy": q("""SELECT player_id, trim(regexp_replace(translate(lower(display_name), 'øıđ', 'oid'), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM c_players"""),
    "normalize_subject": "SELECT p_partkey, ['usa','usa','ir iran','korea republic','spain'][p_partkey % 5 + 1] AS subject_key FROM part",
    "candidate_names": q(f"""SELECT player_id, CAST(row_number() OVER (PARTITION BY player_id ORDER BY min(i)) - 1 AS INTEGER) AS position, name_key
      FROM (SELECT player_id, 1 AS i, {person("first_names || ' ' || last_names")} AS name_key FROM c_players
        UNION ALL SELECT player_id, 2, {person("last_names || ' ' || first_names")} FROM c_players
        UNION ALL SELECT player_id, 3, {person('last_names')} FROM c_players) GROUP BY player_id, name_key"""),
    "simplify_position": q("""SELECT c_custkey,
        coalesce(MAP {'Goalkeeper':'GK','Centre-Back':'DF','Second Striker':'FW','Midfielder':'MID'}[raw],
          CASE WHEN regexp_matches(u, 'GK|KEEPER') THEN 'GK' WHEN regexp_matches(u, 'CB|LB|RB|BACK|DEF') THEN 'DF'
            WHEN regexp_matches(u, 'CM|DM|AM|MID') THEN 'MID' WHEN regexp_matches(u, 'ST|CF|LW|RW|FW|WINGER|FORWARD') THEN 'FW' ELSE '' END) AS squad,
        CASE WHEN u = 'GK' THEN 'GK' WHEN u IN ('CB','LB','RB','LWB','RWB','DF') THEN 'DF' WHEN u IN ('CM','CDM','CAM','LM','RM','MID') THEN 'MID'
          WHEN u IN ('ST','CF','LW','RW','LF','RF','FW') THEN 'FW' WHEN u LIKE '%GOALKEEPER%' THEN 'GK' WHEN u LIKE '%DEFENDER%' THEN 'DF'
          WHEN u LIKE '%MIDFIELDER%' THEN 'MID' WHEN u LIKE '%FORWARD%' THEN 'FW' ELSE '' END AS layout,
        CASE WHEN f = 'GK' THEN 'GK' WHEN f IN ('CB','LB','RB','LWB','RWB','SW') THEN 'DF' WHEN f IN ('CM','CDM','CAM','LM','RM') THEN 'MID'
          WHEN f IN ('ST','CF','LW','RW','LF','RF') THEN 'FW' ELSE '' END AS rating FROM s""", s=SIMPLE),
    "classify_signal": q(f"SELECT p_partkey, {KINDS} AS signal_type FROM x", x=TEXTS),
    "extract_subject": q(f"SELECT p_partkey, {subject('question')} AS subject FROM x", x=TEXTS),
    "topic_filter": q(f"""SELECT p_partkey, CAST({EVENT_TEST} AS INTEGER) AS is_event, CAST(t LIKE '%world cup%' OR t LIKE '%fifwc%' AS INTEGER) AS is_trade,
        CAST((question || ' ' || title) LIKE '%World Cup%' AS INTEGER) AS is_league FROM x""", x=TEXTS),
    "parse_score_label": q("""SELECT p_partkey, CASE p_partkey % 10 WHEN 6 THEN '2-1' WHEN 8 THEN '3-3' WHEN 7 THEN '其他比分' ELSE question END AS label,
        CASE p_partkey % 10 WHEN 6 THEN 'home_win' WHEN 8 THEN 'draw' END AS outcome FROM x""", x=TEXTS),
    "clamp_score": q(f"""SELECT p_partkey, h AS home_overall, a AS away_overall,
        coalesce(CASE WHEN p_partkey % 3 = 0 THEN least(greatest(CAST(round_even(p_size / 2 - 12, 0) AS INTEGER), -6), 6) END, least(greatest(h - a, -6), 6)) AS diff,
        {r('CASE WHEN p_size % 7 = 0 THEN 0 ELSE least(p_size / 40, 1) END')} AS confidence FROM s""",
        s="""SELECT p_partkey, p_size, CASE WHEN p_partkey % 9 >= 7 THEN 0 ELSE least(greatest(CAST(round_even((p_size - 25) / 4, 0) AS INTEGER), -3), 3) END AS h,
          least(greatest(CAST(round_even(p_partkey % 11 - 5.5, 0) AS INTEGER), -3), 3) AS a FROM part"""),
    "extract_page_candidates": q(f"""SELECT page_id, CAST(n - 1 AS INTEGER) AS position, url, '' AS slug_name,
        coalesce(TRY_CAST(regexp_extract(w, '(?i)(\\d{{2}})\\s+Overall rating', 1) AS INTEGER), TRY_CAST(regexp_extract(w, '(?i)overall rating is\\s+(\\d{{2}})', 1) AS INTEGER),
          TRY_CAST(regexp_extract(w, '(?i)(\\d{{2}})\\s+Overall', 1) AS INTEGER)) AS overall,
        CAST(length(w) AS INTEGER) AS snippet_length
      FROM ranked JOIN text_ USING (page_id)""",
        doc=f"SELECT page_id, {ENTITY.format('html')} AS doc FROM pages",
        text_=f"SELECT page_id, {strip('doc')} AS w FROM doc",
        found="SELECT page_id, doc, unnest(regexp_extract_all(doc, '/[A-Za-z]{3,}')) AS url, generate_subscripts(regexp_extract_all(doc, '/[A-Za-z]{3,}'), 1) AS i FROM doc",
        ranked="""SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) AS n
          FROM found WHERE NOT contains(url, '/customized') GROUP BY page_id, url"""),
    "avg_available": f"""SELECT {MATCH_ID} AS match_id, {r('CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE (l_quantity + l_linenumber) / 2 END')} AS pace,
        CAST(0 AS DOUBLE) AS none FROM lineitem""",
    "implied_prob": q(f"""SELECT match_id, pool_code, outcome, {r('CASE WHEN odds > 1 THEN 1 / odds END')} AS implied,
        {r('(1 / odds) / sum(1 / odds) OVER (PARTITION BY match_id, pool_code)')} AS probability FROM latest""", latest=LATEST),
    "equivalent_odds": q(f"SELECT match_id, {r('1 / gbm_0')} AS closing_home_odds, {r('1 / gbm_1')} AS closing_draw_odds, {r('1 / gbm_2')} AS closing_away_odds FROM c_probs"),
    "market_pick": q("""SELECT match_id, pool_code, arg_min(outcome, (odds, CASE outcome WHEN 'home_win' THEN 0 WHEN 'draw' THEN 1 ELSE 2 END)) AS pick
      FROM latest GROUP BY ALL""", latest=LATEST),
}
