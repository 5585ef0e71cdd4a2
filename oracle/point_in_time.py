"""Oracle SQL of the match-history queries."""

from oracle.sql import q, r

FORM = ["matches", "win_rate", "draw_rate", "points_avg", "goals_for_avg", "goals_against_avg", "goal_diff_avg"]
STATS = ["sb_events", "sb_shots", "sb_xg", "sb_passes", "sb_completed_passes", "sb_pressures", "sb_carries",
         "sb_pass_completion_rate", "sb_xg_per_shot"]
SENTIMENT = ["home_overall", "away_overall", "diff", "confidence", "home_morale", "away_morale", "home_external",
             "away_external", "home_media", "away_media", "home_motivation", "away_motivation"]

TEXT_DATE = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate)
  WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 12:30:00'
  ELSE 'to be confirmed' END"""
TEXT_DAY = "CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END"
MONEY = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"

# The last rating before each match: states and questions in one order per team, the last state seen is the answer.
def two_sided(state: str, columns: list[str], strict: str = ">") -> dict[str, str]:
    seen = ", ".join(f"{c} := {c}" for c in columns)
    # Of one day, states come before a question only if that day counts.
    state_first, asked_first = (0, 1) if strict == ">=" else (1, 0)
    return {
        "both_": f"""SELECT team, date, {state_first} AS turn, NULL AS match_id, NULL AS side, struct_pack({seen}) AS known FROM ({state})
          UNION ALL SELECT team, date, {asked_first}, match_id, side, NULL FROM c_sides""",
        "latest": """SELECT match_id, side, last_value(known IGNORE NULLS) OVER (PARTITION BY team ORDER BY date, turn
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM both_ QUALIFY match_id IS NOT NULL""",
        "wide": "SELECT match_id, " + ", ".join(
            f"max(CASE WHEN side = '{side}' THEN known.{c} END) AS {side}_{c}" for c in columns for side in ("home", "away"))
        + " FROM latest GROUP BY match_id",
    }


RATED = "SELECT team, date, arg_max(elo, seq) AS elo FROM c_ratings GROUP BY team, date"
RANKED = """SELECT team, date, arg_max(fifa_rank, seq) AS fifa_rank, arg_max(fifa_points, seq) AS fifa_points
  FROM c_rankings GROUP BY team, date"""

# Trailing five by position numbers: rows before the match are 1..k, the last five are k-4..k.
FORM_STEPS = {
    "numbered": """SELECT team, date, gf, ga, row_number() OVER (PARTITION BY team ORDER BY date, side, match_id) AS n
      FROM c_history""",
    "rolled": """SELECT team, date, n, CAST(count(*) OVER w AS DOUBLE) AS matches, avg(CASE WHEN gf > ga THEN 1.0 ELSE 0 END) OVER w AS win_rate,
        avg(CASE WHEN gf = ga THEN 1.0 ELSE 0 END) OVER w AS draw_rate, avg(CASE WHEN gf > ga THEN 3.0 WHEN gf = ga THEN 1 ELSE 0 END) OVER w AS points_avg,
        avg(gf) OVER w AS goals_for_avg, avg(ga) OVER w AS goals_against_avg, avg(gf - ga) OVER w AS goal_diff_avg
      FROM numbered WINDOW w AS (PARTITION BY team ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "days_": "SELECT team, date, max(n) AS n FROM numbered GROUP BY team, date",
    # A match day asks for the last row of the days before it.
    "asked": "SELECT team, date, max(n) OVER (PARTITION BY team ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM days_",
    "form": "SELECT a.team, a.date, r.* EXCLUDE (team, date, n) FROM asked a JOIN rolled r ON a.team = r.team AND a.n = r.n",
}

EVENT_COUNTS = """SELECT match_id, team, count(*) AS sb_events, count(*) FILTER (type = 'Shot') AS sb_shots,
   coalesce(sum(xg) FILTER (type = 'Shot'), 0) AS sb_xg, count(*) FILTER (type = 'Pass') AS sb_passes,
   count(*) FILTER (completed) AS sb_completed_passes, count(*) FILTER (type = 'Pressure') AS sb_pressures,
   count(*) FILTER (type = 'Carry') AS sb_carries FROM c_team_events GROUP BY match_id, team"""
EVENT_RATIOS = """SELECT *, sb_completed_passes / nullif(sb_passes, 0) AS sb_pass_completion_rate,
   sb_xg / nullif(sb_shots, 0) AS sb_xg_per_shot FROM counted"""
PRIOR = "SELECT a.team, a.date, CAST(count(*) AS DOUBLE) AS prior_matches, " + ", ".join(
    f"avg(b.{s}) AS {s}_prior_mean" for s in STATS
) + " FROM stats a JOIN stats b ON a.team = b.team AND b.date <= a.date GROUP BY a.team, a.date"
PRIOR_COLUMNS = ["prior_matches", *[f"{s}_prior_mean" for s in STATS]]

COMPLETED = """SELECT o.o_orderkey AS seq, CAST(o_orderdate AS DATE) AS date,
   CASE WHEN o_orderkey % 8 = 0 THEN away_team ELSE home_team END AS home_team,
   CASE WHEN o_orderkey % 8 = 0 THEN home_team ELSE away_team END AS away_team,
   CAST(o_orderkey % 6 AS DOUBLE) AS home_score, CAST(o_orderkey % 3 AS DOUBLE) AS away_score,
   CASE WHEN o_orderkey % 12 = 0 THEN 'Qualifier' ELSE 'FIFA World Cup' END AS tournament
 FROM orders o JOIN c_fixtures f ON o.o_orderkey = f.fixture_id WHERE o_orderkey % 20 <> 0"""

# Standings from running sums per group and team, asked at every kickoff of the group.
STANDING_STEPS = {
    "games": "SELECT *, worldcup_group AS grp FROM c_fixtures",
    "played": """SELECT grp, kickoff, home_team AS team, home_score AS gf, away_score AS ga FROM games WHERE home_score IS NOT NULL
      UNION ALL SELECT grp, kickoff, away_team, away_score, home_score FROM games WHERE home_score IS NOT NULL""",
    "members": "SELECT DISTINCT grp, unnest([home_team, away_team]) AS team FROM games",
    "moments": "SELECT DISTINCT grp, kickoff FROM games",
    "won": """SELECT grp, team, kickoff, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 WHEN gf < ga THEN 0 END AS pts, gf, ga, 0 AS asked FROM played
      UNION ALL SELECT o.grp, team, kickoff, 0, 0, 0, 1 FROM moments o JOIN members e ON o.grp = e.grp""",
    "daily": "SELECT grp, team, kickoff, sum(pts) AS pts, sum(gf) AS gf, sum(ga) AS ga, max(asked) AS asked FROM won GROUP BY grp, team, kickoff",
    "tab": """SELECT grp, team, kickoff, asked, coalesce(sum(pts) OVER w, 0) AS pts, coalesce(sum(gf) OVER w, 0) AS gf, coalesce(sum(gf - ga) OVER w, 0) AS gd
      FROM daily WINDOW w AS (PARTITION BY grp, team ORDER BY kickoff ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY grp, kickoff ORDER BY pts DESC, gd DESC, gf DESC, team) AS rnk FROM tab WHERE asked = 1",
    "rounds": """SELECT grp, worldcup_matchday, kickoff, coalesce(sum(n) OVER (PARTITION BY grp, worldcup_matchday ORDER BY kickoff
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known
      FROM (SELECT grp, worldcup_matchday, kickoff, count(home_score) AS n FROM games GROUP BY ALL)""",
    "flat": """SELECT g.fixture_id, g.worldcup_matchday AS md, known, h.pts AS hp, a.pts AS ap, h.gd AS hg, a.gd AS ag,
        h.rnk AS hr, a.rnk AS ar, coalesce(s.pts, 0) AS sp, coalesce(s.gd, 0) AS sg
      FROM games g JOIN rounds r ON r.grp = g.grp AND r.worldcup_matchday = g.worldcup_matchday AND r.kickoff = g.kickoff
      JOIN ranked h ON h.grp = g.grp AND h.kickoff = g.kickoff AND h.team = g.home_team
      JOIN ranked a ON a.grp = g.grp AND a.kickoff = g.kickoff AND a.team = g.away_team
      LEFT JOIN ranked s ON s.grp = g.grp AND s.kickoff = g.kickoff AND s.rnk = 2""",
    "gaps": """SELECT *, greatest(0.0, sp - hp) AS hdef, greatest(0.0, sp - ap) AS adef,
        greatest(0.0, sg - hg + 1) AS hch, greatest(0.0, sg - ag + 1) AS ach FROM flat""",
}


def _pressure(rank: str, deficit: str, chase: str) -> str:
    return f"""least(1.0, (CASE WHEN {rank} > 2 THEN 0.25 ELSE 0 END)
      + (CASE WHEN md >= 2 THEN least(0.30, {deficit} * 0.12) + least(0.20, {chase} * 0.04) ELSE 0 END)
      + (CASE WHEN md >= 3 AND {rank} > 2 THEN 0.25 ELSE 0 END)
      + (CASE WHEN known > 0 THEN 0.12 + (CASE WHEN {rank} > 2 OR {deficit} > 0 OR {chase} >= 2 THEN 0.13 ELSE 0 END) ELSE 0 END))"""


PRESSED = f"""SELECT *, {_pressure('hr', 'hdef', 'hch')} AS hpr, {_pressure('ar', 'adef', 'ach')} AS apr FROM gaps"""
ODDS = ["closing_home_odds", "closing_draw_odds", "closing_away_odds"]


def _pass(number: int, day: str) -> str:
    cols = ", ".join(f"arg_min(struct_pack(v := {c}), (rk, seq)).v AS p{number}_{c}" for c in ODDS)
    spread = " UNION ALL ".join(
        f"SELECT {day} + {d} AS date, home_team, away_team, seq, {rank} AS rk, {', '.join(ODDS)} FROM c_odds"
        for rank, d in enumerate((0, -1, 1)))
    return f"SELECT date, home_team, away_team, {cols} FROM ({spread}) GROUP BY ALL"


ORACLE = {
    "rename_map": q(f"""SELECT match_id, CASE l_line WHEN 0 THEN strftime(true_date, '%Y-%m-%d')
        WHEN 1 THEN strftime(true_date, '%d/%m/%Y') ELSE strftime(true_date, '%Y/%m/%d') END AS date,
        HomeTeam AS home_team, AwayTeam AS away_team,
        coalesce(CAST(hs AS VARCHAR), '') AS home_score, coalesce(CAST(aws AS VARCHAR), 'n/a') AS away_score,
        {r('B365CH')} AS closing_home_odds
      FROM (SELECT *, CAST(split_part(match_id, '-', 2) AS INTEGER) % 3 AS l_line FROM c_raw)"""),
    "parse_mixed_dates": f"SELECT o_orderkey, {TEXT_DATE} AS text, CAST({TEXT_DAY} AS VARCHAR) AS day FROM orders",
    "coerce_numeric": f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN {r('o_totalprice')} WHEN 2 THEN 12.5 END AS number
      FROM orders""",
    "result_label": q("""SELECT match_id, CASE sign(home_score - away_score) WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS result
      FROM c_matches"""),
    "clean_matches": q(f"""SELECT match_id, CAST(true_date AS VARCHAR) AS date, HomeTeam AS home_team, AwayTeam AS away_team,
        CASE sign(hs - aws) WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS result, {r('hs')} AS home_score,
        {r('aws')} AS away_score, {r('B365CH')} AS closing_home_odds FROM c_raw WHERE hs IS NOT NULL AND aws IS NOT NULL"""),
    "clean_ratings": f"""SELECT o_orderkey AS seq, 'T' || (o_custkey % 100) AS team, CAST({TEXT_DAY} AS VARCHAR) AS date,
        {r('o_totalprice')} AS elo FROM orders WHERE o_orderkey % 5 < 4 AND o_orderkey % 7 <> 0""",
    "match_flags": q("""SELECT match_id, CAST(lower(neutral) IN ('true','1','yes') AS INTEGER) AS is_neutral,
        CAST(tournament ILIKE '%world cup%' AS INTEGER) AS is_world_cup,
        CAST(tournament ILIKE '%friendly%' AS INTEGER) AS is_friendly FROM c_matches"""),
    "recency_filter": q("""SELECT match_id, CAST(date AS VARCHAR) AS date FROM c_matches
      WHERE date >= (SELECT max(date) - INTERVAL 4 YEAR FROM c_matches)"""),
    "both_sides_allowed": q("""SELECT match_id, CAST(date AS VARCHAR) AS date, home_team, away_team FROM c_matches
      WHERE date >= DATE '1990-01-01' AND home_team IN (SELECT team FROM c_static WHERE elo > 2000)
        AND away_team IN (SELECT team FROM c_static WHERE elo > 2000)"""),
    "static_lookup": q(f"""SELECT match_id, {r('h.elo')} AS home_elo, {r('a.elo')} AS away_elo FROM c_matches
      LEFT JOIN s h ON home_team = h.team LEFT JOIN s a ON away_team = a.team""",
        s="SELECT team, arg_max(elo, seq) AS elo FROM c_static GROUP BY team"),
    "asof_elo": q(f"SELECT match_id, {r('home_elo')} AS home_elo, {r('away_elo')} AS away_elo FROM wide",
                  **two_sided(RATED, ["elo"])),
    "elo_features": q(f"""SELECT match_id, {r('home_elo - away_elo')} AS elo_diff, {r('abs(home_elo - away_elo)')} AS elo_abs_diff,
        {r('home_elo / nullif(away_elo, 0)')} AS elo_ratio FROM wide""", **two_sided(RATED, ["elo"])),
    "asof_ranking": q("SELECT match_id, " + ", ".join(
        f"{r(c)} AS {c}" for c in ("home_fifa_rank", "away_fifa_rank", "home_fifa_points", "away_fifa_points"))
        + f""", {r('away_fifa_rank - home_fifa_rank')} AS fifa_rank_diff,
        {r('home_fifa_points - away_fifa_points')} AS fifa_points_diff FROM wide""",
        **two_sided(RANKED, ["fifa_rank", "fifa_points"])),
    "asof_inclusive_latest": q(f"SELECT match_id, {r('home_elo')} AS home_elo, {r('away_elo')} AS away_elo FROM wide",
                               **two_sided(RATED, ["elo"], ">=")),
    "event_team_stats": q("SELECT CAST(t.match_id AS VARCHAR) AS match_id, t.team, " + ", ".join(
        f"{r(f'coalesce({s}, 0)') if i < 7 else r(s)} AS {s}" for i, s in enumerate(STATS))
        + " FROM t LEFT JOIN stats USING (match_id, team)",
        counted=EVENT_COUNTS, stats=EVENT_RATIOS,
        t="""SELECT match_id, unnest(['T' || (count(*) % 100), min(team)]) AS team FROM c_team_events GROUP BY match_id"""),
    "expanding_prior": q("SELECT team, CAST(date AS VARCHAR) AS date, " + ", ".join(f"{r(x)} AS {x}" for x in PRIOR_COLUMNS)
        + " FROM prior", counted=EVENT_COUNTS, stats="SELECT *, match_id AS date FROM (" + EVENT_RATIOS + ")", prior=PRIOR),
    "asof_event_prior": q("SELECT event_id, " + ", ".join(
        [f"{r(f'{p}.{x}')} AS {n}_{x}" for x in PRIOR_COLUMNS[:4] for p, n in (("h", "home"), ("a", "away"))]
        + [f"{r(f'h.{x} - a.{x}')} AS {x}_diff" for x in PRIOR_COLUMNS])
        + """ FROM ev ASOF LEFT JOIN prior h ON home = h.team AND ev.date > h.date
              ASOF LEFT JOIN prior a ON away = a.team AND ev.date > a.date""",
        counted=EVENT_COUNTS, stats="SELECT *, match_id AS date FROM (" + EVENT_RATIOS + ")", prior=PRIOR,
        ev="""SELECT event_id, CAST(ts AS DATE) AS date, 'T' || (user_id % 100) AS home,
              'T' || regexp_extract(props, '[0-9]+') AS away FROM events"""),
    "recent_form": q("SELECT m.match_id, " + ", ".join(
        [f"{r(f'h.{f}')} AS home_recent5_{f}, {r(f'a.{f}')} AS away_recent5_{f}, {r(f'h.{f} - a.{f}')} AS recent5_{f}_diff"
         for f in FORM]) + """ FROM c_matches m LEFT JOIN form h ON m.home_team = h.team AND m.date = h.date
              LEFT JOIN form a ON m.away_team = a.team AND m.date = a.date""", **FORM_STEPS),
    "team_history": q("""SELECT match_id, CAST(date AS VARCHAR) AS date, team, CAST(gf AS DOUBLE) AS goals_for,
        CAST(ga AS DOUBLE) AS goals_against, CAST(gf - ga AS DOUBLE) AS goal_diff, CAST(gf > ga AS BIGINT) AS win,
        CAST(gf = ga AS BIGINT) AS draw, CAST(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS BIGINT) AS points
      FROM c_history"""),
    "h2h": q(f"""SELECT m.match_id, CASE WHEN count(p.match_id) > 0 THEN CAST(count(p.match_id) AS DOUBLE) END AS h2h_matches_10y,
        {r('avg(CASE WHEN p.gf = p.ga THEN 1.0 WHEN p.gf IS NOT NULL THEN 0 END)')} AS h2h_draw_rate_10y,
        {r('avg(CASE WHEN p.gf > p.ga THEN 1.0 WHEN p.gf IS NOT NULL THEN 0 END)')} AS h2h_home_team_win_rate_10y,
        {r('avg(CASE WHEN p.gf < p.ga THEN 1.0 WHEN p.gf IS NOT NULL THEN 0 END)')} AS h2h_away_team_win_rate_10y,
        {r('avg(p.gf - p.ga)')} AS h2h_goal_diff_avg_10y
      FROM c_matches m LEFT JOIN c_history p ON p.team = m.home_team AND p.opponent = m.away_team
        AND p.date < m.date AND p.date >= m.date - INTERVAL 10 YEAR GROUP BY m.match_id"""),
    "standings_before": q(f"""SELECT fixture_id, {r('hp')} AS home_group_points_before, {r('ap')} AS away_group_points_before,
        {r('hp - ap')} AS group_points_diff_before, {r('hg')} AS home_group_goal_diff_before,
        {r('ag')} AS away_group_goal_diff_before, {r('hg - ag')} AS group_goal_diff_diff_before,
        {r('hr')} AS home_group_rank_before, {r('ar')} AS away_group_rank_before,
        {r('known')} AS group_known_prior_same_round_matches FROM flat""",
        **{k: v for k, v in STANDING_STEPS.items() if k != "gaps"}),
    "group_pressure": q(f"""SELECT fixture_id, {r('hpr')} AS home_group_pressure, {r('apr')} AS away_group_pressure,
        {r('hpr - apr')} AS group_pressure_diff,
        {r('CAST(md >= 3 AND hr > 2 AND hdef >= 1 AS INTEGER)')} AS home_needs_win_flag,
        {r('CAST(md >= 3 AND ar > 2 AND adef >= 1 AS INTEGER)')} AS away_needs_win_flag,
        {r('CASE WHEN known > 0 OR md >= 3 THEN hch ELSE 0 END')} AS home_goal_diff_chase,
        {r('CASE WHEN known > 0 OR md >= 3 THEN ach ELSE 0 END')} AS away_goal_diff_chase FROM pressed""",
        **STANDING_STEPS, pressed=PRESSED),
    "clean_completed": q("""SELECT seq, CAST(date AS VARCHAR) AS date, home_team, away_team, home_score, away_score FROM done""",
                         done=COMPLETED),
    "score_overlay": q("""SELECT fixture_id, coalesce(u.hs, f.home_score) AS home_score, coalesce(u.aws, f.away_score) AS away_score
      FROM c_fixtures f LEFT JOIN u ON f.date = u.date AND f.home_team = u.h AND f.away_team = u.a""",
        done=COMPLETED,
        u="""SELECT date, h, a, arg_max(hs, seq) AS hs, arg_max(aws, seq) AS aws FROM (
          SELECT date, seq, home_team AS h, away_team AS a, home_score AS hs, away_score AS aws FROM done
          UNION ALL SELECT date, seq, away_team, home_team, away_score, home_score FROM done) GROUP BY date, h, a"""),
    "upsert_results": q("""SELECT CAST(date AS VARCHAR) AS date, home_team, away_team, worldcup_group, NULL AS tournament,
        NULL AS neutral, home_score, away_score FROM c_fixtures f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.date = f.date
          AND u.home_team = f.home_team AND u.away_team = f.away_team)
      UNION ALL SELECT CAST(date AS VARCHAR), home_team, away_team, NULL, tournament, 'TRUE', home_score, away_score FROM u""",
        done=COMPLETED,
        u="""SELECT date, home_team, away_team, arg_max(tournament, seq) AS tournament, arg_max(home_score, seq) AS home_score,
          arg_max(away_score, seq) AS away_score FROM done GROUP BY date, home_team, away_team"""),
    "union_align": q(f"""SELECT team, CAST(date AS VARCHAR) AS date, {r('elo')} AS elo, CAST(NULL AS DOUBLE) AS fifa_rank FROM c_ratings
      UNION ALL SELECT team, CAST(date AS VARCHAR), NULL, {r('fifa_rank')} FROM c_rankings"""),
    "distinct_teams": q("SELECT DISTINCT year(date) AS year, team FROM c_sides"),
    "key_difference": q("""SELECT CAST(date AS VARCHAR) AS date, home_team, away_team FROM (
      SELECT date, home_team, away_team FROM c_matches EXCEPT SELECT date, home_team, away_team FROM c_odds)"""),
    "odds_exact_join": q("SELECT match_id, " + ", ".join(f"{r(c)} AS {c}" for c in ODDS)
        + " FROM c_matches LEFT JOIN o USING (date, home_team, away_team)",
        o="""SELECT DISTINCT ON (date, home_team, away_team) * FROM (SELECT * FROM c_odds ORDER BY seq)
             ORDER BY date, home_team, away_team, seq"""),
    "sentiment_join": q("SELECT match_id, " + ", ".join(f"CAST(s{i} AS BIGINT) AS off_field_{n}" for i, n in enumerate(SENTIMENT, 1))
        + " FROM c_matches LEFT JOIN o USING (date, home_team, away_team)",
        o="SELECT date, home_team, away_team, " + ", ".join(
            f"arg_min(CAST(floor(closing_home_odds * {i} + closing_draw_odds) AS BIGINT) % 7 - 3, seq) AS s{i}"
            for i in range(1, 13)) + " FROM c_odds GROUP BY date, home_team, away_team"),
    "tolerant_date_join": q("SELECT match_id, " + ", ".join(f"{r(f'coalesce(p0_{c}, p1_{c})')} AS {c}" for c in ODDS)
        + """ FROM c_matches LEFT JOIN pass_a USING (date, home_team, away_team)
              LEFT JOIN pass_b USING (date, home_team, away_team)""", pass_a=_pass(0, "date"), pass_b=_pass(1, "shanghai_date")),
    "squad_join_diff": q(f"""SELECT match_id, {r('h.m')} AS home_squad_rating_mean, {r('a.m')} AS away_squad_rating_mean,
        {r('h.m - a.m')} AS squad_rating_mean_diff, {r('h.x - a.x')} AS squad_rating_max_diff, {r('h.n - a.n')} AS squad_player_count_diff
      FROM c_matches LEFT JOIN t h ON home_team = h.team LEFT JOIN t a ON away_team = a.team""",
        t="SELECT team, count(*) AS n, avg(elo) AS m, max(elo) AS x FROM c_ratings GROUP BY team"),
    "dedupe_keep": q(f"""SELECT team, CAST(date AS VARCHAR) AS date, min(seq) AS first_seq, max(seq) AS last_seq,
        {r('arg_min(elo, seq)')} AS first_elo, {r('arg_max(elo, seq)')} AS last_elo FROM c_ratings GROUP BY team, date"""),
    "time_split": q("""SELECT match_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split_80_20,
        CASE WHEN k <= floor(n * 0.7) THEN 'subtrain' WHEN k <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split_70_10_20
      FROM (SELECT match_id, row_number() OVER (ORDER BY date, match_id) AS k, count(*) OVER () AS n FROM c_matches)"""),
    "sequence_id": q("SELECT fixture_id, row_number() OVER (ORDER BY date, fixture_id) AS sequence FROM c_fixtures"),
    "stratified_split": q("""SELECT match_id, y AS year, CASE WHEN k <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM (
      SELECT match_id, year(date) AS y, row_number() OVER (PARTITION BY year(date) ORDER BY md5('42|' || match_id)) AS k,
        count(*) OVER (PARTITION BY year(date)) AS n FROM c_matches)"""),
    "value_distribution": q("""SELECT 'result' AS feature, CASE sign(home_score - away_score) WHEN 1 THEN '0' WHEN 0 THEN '1' ELSE '2' END AS value,
        count(*) AS rows FROM c_matches GROUP BY ALL UNION ALL SELECT 'tournament', tournament, count(*) FROM c_matches GROUP BY ALL
      UNION ALL SELECT 'neutral', neutral, count(*) FROM c_matches GROUP BY ALL"""),
    "incremental_uncached": q("""SELECT match_id, CAST(date AS VARCHAR) AS date FROM c_matches m
      WHERE date >= DATE '1996-01-01' AND tournament ILIKE '%world cup%' AND NOT EXISTS (SELECT 1 FROM c_odds o
        WHERE o.date = m.date AND lower(o.home_team) = lower(m.home_team) AND lower(o.away_team) = lower(m.away_team))"""),
    "key_coverage_missing": q("""SELECT DISTINCT CAST(date AS VARCHAR) AS date, lower(home_team) AS home, lower(away_team) AS away
      FROM c_matches m WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-01-01' + 3650 AND NOT EXISTS (SELECT 1 FROM c_odds o
        WHERE o.home_team = m.home_team AND o.away_team = m.away_team AND abs(date_diff('day', o.shanghai_date, m.date)) <= 1)"""),
    "coverage_filter": q("""SELECT 'covered' AS kind, match_id AS key FROM c_matches WHERE home_team IN (SELECT team FROM s)
        AND away_team IN (SELECT team FROM s)
      UNION ALL SELECT DISTINCT 'missing_' || side, team FROM c_sides WHERE team NOT IN (SELECT team FROM s)""",
        s="SELECT team FROM c_static WHERE elo > 2000"),
}
