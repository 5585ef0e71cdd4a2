"""Oracle SQL of the player, squad and rating queries; resolution by brute force inside blocks."""

from oracle.sources import person
from oracle.sql import q, r

ATTRS = ["pace", "shooting", "passing", "dribbling", "defending", "physicality"]
LEFT = f"""SELECT player_id, team, birthdate, {person('last_names')} AS last_norm, {person('display_name')} AS n1,
  {person("last_names || ' ' || first_names")} AS n2 FROM c_players"""
NAMES = "SELECT player_id, team, birthdate, 0 AS pos, n1 AS name FROM people UNION ALL SELECT player_id, team, birthdate, 1, n2 FROM people"
RIGHT = f"""SELECT seq, nationality AS nat, birthdate AS dob, overall, {person("first_name || ' ' || last_name")} AS nm,
  CASE WHEN common_name IS NOT NULL THEN {person('common_name')} END AS cm, {person('last_name')} AS ln FROM c_player_source"""
BASE = {"people": LEFT, "nms": NAMES, "src": RIGHT}


def rung(rule: int, stage: int, method: str, cond: str, last: bool = True) -> str:
    """All pairs of one rule with its priority; the last (or first) source row of a key counts."""
    sign = "-seq" if last else "seq"
    return f"SELECT player_id, '{method}' AS method, {stage} AS st, pos, {rule} AS ru, {sign} AS o, seq, overall FROM nms JOIN src ON {cond}"


LASTRUNG = "SELECT player_id, '{m}' AS method, {s} AS st, 0 AS pos, 9 AS ru, seq AS o, seq, overall FROM people JOIN src ON last_norm = ln AND birthdate = dob AND team = nat"
PICK = "SELECT * FROM ({}) QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY st, pos, ru, o) = 1"
LADDER = PICK.format(" UNION ALL ".join([
    rung(0, 1, "name_dob", "name = nm AND birthdate = dob"), rung(1, 1, "common_name_dob", "name = cm AND birthdate = dob"),
    rung(2, 2, "name_nationality", "name = nm AND team = nat"), rung(3, 2, "common_name_nationality", "name = cm AND team = nat"),
    LASTRUNG.format(m="last_name_dob_nationality", s=3)]))
EXACT = PICK.format(" UNION ALL ".join([rung(0, 1, "name_dob_country", "name = nm AND birthdate = dob AND team = nat"),
                                         LASTRUNG.format(m="last_dob_country", s=2)]))
OUT = f"player_id, method, {r('overall')} AS overall, seq"
REST = """SELECT *, list_distinct(string_split(n1, ' ') || string_split(n2, ' ')) AS toks FROM people WHERE player_id NOT IN (SELECT player_id FROM exact)"""
TOKEN = """SELECT player_id, 'dob_country_token' AS method, seq, overall FROM (
  SELECT player_id, seq, overall, len(list_intersect(toks, list_distinct(string_split(nm, ' ')))) AS sc FROM rest JOIN src ON birthdate = dob AND team = nat)
  WHERE sc >= 1 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY sc DESC, seq) = 1"""
FUZZY = """SELECT player_id, 'fuzzy' AS method, sc AS match_score, fl, seq, overall FROM (
  SELECT *, greatest(ov / least(nl, nr), CASE WHEN contains(a, b) OR contains(b, a) THEN 0.92 ELSE 0 END) AS sc, least(nl, nr) AS fl FROM (
    SELECT n.player_id, pos, seq, overall, len(list_intersect(list_distinct(string_split(name, ' ')), list_distinct(string_split(nm, ' ')))) AS ov,
      len(list_distinct(string_split(name, ' '))) AS nl, len(list_distinct(string_split(nm, ' '))) AS nr, replace(name, ' ', '') AS a, replace(nm, ' ', '') AS b
    FROM nms n JOIN src ON birthdate = dob AND team = nat WHERE n.player_id NOT IN (SELECT player_id FROM exact)))
  WHERE sc > 0 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY sc DESC, seq, pos) = 1"""

CLUB = f"""SELECT p.team AS team_norm, {person('display_name')} AS player_norm, CAST(minutes_played AS DOUBLE) AS minutes, CAST(a.goals AS DOUBLE) AS goals,
   CASE WHEN minutes_played > 45 THEN minutes_played / 30 END AS xg, club AS club_name, CASE WHEN competition_id = 'A' THEN competition_id END AS source,
   game_id || '-' || competition_id || '-' || minutes_played || '-' || club || '-' || a.goals || '-' || a.date AS seq
 FROM c_appearances a JOIN c_players p ON a.player_id = p.player_id"""
MERGED = """SELECT team_norm, player_norm, sum(minutes) AS minutes, sum(goals) AS goals, coalesce(sum(xg), 0) AS xg, arg_min(club_name, seq) AS club_name,
   arg_min(source, seq) FILTER (source IS NOT NULL) AS source FROM club GROUP BY ALL"""
SEASON = "SELECT a.* FROM c_appearances a WHERE season >= 1998 AND player_id % 3 > 0 AND player_id IN (SELECT player_id FROM c_players)"
TOTALS = """SELECT player_id, count(DISTINCT game_id) AS appearances, CAST(sum(minutes_played) AS BIGINT) AS minutes, CAST(sum(goals) AS BIGINT) AS goals,
   CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(yellow_cards) AS BIGINT) AS yellow_cards, CAST(sum(red_cards) AS BIGINT) AS red_cards,
   CAST(min(date) AS VARCHAR) AS first_match_date, CAST(max(date) AS VARCHAR) AS last_match_date,
   string_agg(DISTINCT competition_id, ',' ORDER BY competition_id) AS competitions, count(*) FILTER (type ILIKE '%starting%') AS starts FROM season_ GROUP BY player_id"""
CLUB_TABLE = """SELECT p.player_id, p.team, display_name AS player_name, CASE WHEN p.player_id % 4 = 0 THEN 'squad club' ELSE club END AS club_name, t.competitions AS competition,
   value, t.* EXCLUDE (player_id) FROM c_players p LEFT JOIN tot t ON p.player_id = t.player_id WHERE p.player_id % 3 > 0"""
TOP = """SELECT team, count(value) AS n, max(value) AS t1, sum(value) FILTER (k <= 3) AS s3, avg(value) FILTER (k <= 3) AS m3, sum(value) AS s11, avg(value) AS m11
  FROM (SELECT team, value, row_number() OVER (PARTITION BY team ORDER BY value DESC, player_id) AS k FROM c_players WHERE value IS NOT NULL) WHERE k <= 11 GROUP BY team"""
FORM = {
    "fp": """SELECT player_id, team, CASE WHEN n % 3 > 0 THEN value END AS v, CASE WHEN n % 2 = 0 THEN pace END AS ov,
        coalesce(CASE WHEN player_id % 4 > 0 AND n % 7 > 0 THEN shooting * 20 END, CASE WHEN player_id % 3 = 0 THEN 900 END) AS mi,
        CASE WHEN player_id % 5 > 0 THEN passing / 10 END AS g, dribbling / 20 AS a, CASE WHEN n % 4 > 0 THEN pace / CAST(12.3 AS DOUBLE) END AS xg,
        defending AS sh, physicality AS ta, pace AS it
      FROM (SELECT *, CAST(substr(team, 8) AS INTEGER) AS n FROM c_players)""",
    "rk": """SELECT *, CASE WHEN count(v) OVER t > 0 THEN coalesce(v, -1) WHEN count(ov) OVER t > 0 THEN coalesce(ov, -1)
        WHEN count(mi) OVER t > 0 THEN coalesce(mi, -1) ELSE -1 END AS rv FROM fp WINDOW t AS (PARTITION BY team)""",
    "tp": "SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY team ORDER BY rv DESC, player_id) <= 11",
    "ag": """SELECT team, count(*) AS n, count(mi) AS mc, nullif(sum(mi), 0) AS m, avg(mi) AS mm, sum(g) FILTER (mi IS NOT NULL) AS g, sum(a) FILTER (mi IS NOT NULL) AS a,
        sum(xg) FILTER (mi IS NOT NULL) AS xg, sum(sh) FILTER (mi IS NOT NULL) AS sh, sum(ta) FILTER (mi IS NOT NULL) + sum(it) FILTER (mi IS NOT NULL) AS di FROM tp GROUP BY team""",
}


def per90(x: str) -> str:
    return r(f"{x} / m * 90")


WEIGHTS = {"fw": [1.1, 1.3, .9, 1.1, .1, .9], "mid": [1.0, .9, 1.3, 1.2, .9, 1.0], "df": [1.0, .2, .8, .7, 1.4, 1.2], "gk": [.5, .1, .5, .5, 1.5, 1.0]}
POWER = "CASE lower(position) " + " ".join(
    f"WHEN '{p}' THEN " + " + ".join(f"{a} * CAST({w} AS DOUBLE)" for a, w in zip(ATTRS, ws)) for p, ws in WEIGHTS.items()) + " END"
LINES = {
    "pl": f"SELECT 'T' || (player_id % 60) AS t, lower(position) AS ps, CASE WHEN player_id % 6 = 0 THEN '' ELSE club END AS cl, {POWER} AS pw FROM c_players",
    "mates": "SELECT t, max(n) AS mx FROM (SELECT t, cl, count(*) AS n FROM pl WHERE cl <> '' GROUP BY t, cl) GROUP BY t",
    "tl": """SELECT t, CASE WHEN mx >= 3 THEN 1 + mx * 0.015 ELSE 1 END AS ch, coalesce(sum(pw) FILTER (ps = 'fw'), 0) AS at_, coalesce(sum(pw) FILTER (ps = 'mid'), 0) AS mi,
        coalesce(sum(pw) FILTER (ps IN ('df','gk')), 0) AS de, count(*) AS n FROM pl LEFT JOIN mates USING (t) GROUP BY t, mx""",
}
LEGACY = "trim(regexp_replace(translate(lower({}), 'øıđ', 'oid'), '[^a-z0-9]+', ' ', 'g'))"
YEARLY = f"""SELECT player_id, CAST(2010 + player_id % 4 * 4 AS INTEGER) AS y, 'T' || (player_id % 60) AS t, pace + passing AS ov,
   {LEGACY.format('display_name')} AS nk FROM c_players"""
FALLBACK = {
    "yr": YEARLY,
    "need": "SELECT DISTINCT y, t FROM yr UNION ALL SELECT DISTINCT y, 'X' || (player_id % 5) FROM yr",
    "a": "SELECT y, t, count(*) AS n, sum(ov) AS s FROM (SELECT * FROM yr WHERE player_id % 7 > 4 QUALIFY row_number() OVER (PARTITION BY y, t ORDER BY ov DESC, player_id) <= 11) GROUP BY y, t",
    "b": """SELECT y, t, count(*) AS n, sum(ov) AS s FROM (SELECT * FROM (SELECT * FROM yr QUALIFY row_number() OVER (PARTITION BY y, t, nk ORDER BY ov DESC, player_id) = 1)
        QUALIFY row_number() OVER (PARTITION BY y, t ORDER BY ov DESC, player_id) <= 11) GROUP BY y, t""",
    "j": "SELECT need.y, need.t, coalesce(a.n, 0) AS an, coalesce(b.n, 0) AS bn, a.s AS sa, b.s AS sb FROM need LEFT JOIN a USING (y, t) LEFT JOIN b USING (y, t)",
}
STANDARD = f"""SELECT player_id AS seq, 2010 AS worldcup_year, '' AS team_name, display_name AS player_name, 'DF' AS simplified_position, club AS club_name, pace, shooting, 0 AS overall
   FROM c_players WHERE player_id % 3 = 0 AND player_id % 12 > 0
 UNION ALL SELECT player_id, 2018, CASE WHEN player_id % 2 = 0 THEN 'IR Iran' ELSE team END, display_name, 'FW', club, (pace + shooting) / 2, passing, pace + 1 FROM c_players WHERE player_id % 3 = 1
 UNION ALL SELECT player_id, 2022, team, display_name, CASE WHEN position = 'GK' THEN 'GK' ELSE '' END, club, pace, shooting, pace + 2 FROM c_players
   WHERE player_id % 3 = 2 AND player_id % 13 > 0 AND player_id % 10 > 0"""

ORACLE = {
    "er_ratings_ladder": q(f"SELECT {OUT} FROM lad", **BASE, lad=LADDER),
    "er_local_stats": q(f"SELECT {OUT} FROM lad", **BASE, lad=PICK.format(rung(0, 1, "team_name", "team = nat AND name = nm"))),
    "er_player_id": q(f"SELECT {OUT} FROM exact UNION ALL SELECT {OUT} FROM tok", **BASE, exact=EXACT, rest=REST, tok=TOKEN),
    "er_profile": q(f"""SELECT player_id, {r('overall')} AS overall, seq FROM (SELECT player_id, overall, seq FROM exact
        UNION ALL SELECT player_id, overall, seq FROM sole UNION ALL SELECT player_id, overall, seq FROM tok WHERE player_id NOT IN (SELECT player_id FROM sole))""",
        **BASE, exact=EXACT, rest=REST, tok=TOKEN,
        sole="SELECT player_id, min(overall) AS overall, min(seq) AS seq FROM rest JOIN src ON birthdate = dob AND team = nat GROUP BY player_id HAVING count(*) = 1"),
    "er_ratings_fuzzy": q(f"""SELECT player_id, method, CAST(1 AS DOUBLE) AS match_score, {r('overall')} AS overall, seq FROM exact
        UNION ALL SELECT player_id, method, round(match_score, 2), {r('overall')}, seq FROM fz""", **BASE,
        exact=PICK.format(rung(0, 1, "exact", "name = nm AND birthdate = dob AND team = nat")),
        fz="SELECT * EXCLUDE (fl) FROM (" + FUZZY + ") WHERE match_score >= 0.67 AND fl >= 2"),
    "er_supplement": q(f"SELECT {OUT} FROM sup", **BASE, exact=EXACT,
        ext=f"""SELECT player_id AS seq, team AS nat, {person("last_names || ', ' || first_names")} AS nm, shooting AS overall, CASE WHEN player_id % 2 = 0 THEN birthdate END AS dob FROM c_players""",
        left_="SELECT * FROM nms WHERE player_id NOT IN (SELECT player_id FROM exact)",
        sup=PICK.format("""SELECT player_id, 'name_dob_team' AS method, 1 AS st, pos, 0 AS ru, -seq AS o, seq, overall FROM left_ JOIN ext ON name = nm AND birthdate = dob AND team = nat
          UNION ALL SELECT player_id, 'name_team', 2, pos, 1, -seq, seq, overall FROM left_ JOIN ext ON name = nm AND team = nat""")),
    "player_stat_preagg": q(f"""SELECT team_norm, player_norm, club_name, source, {r('minutes')} AS minutes, {r('goals')} AS goals, {r('xg')} AS xg, CAST(0 AS DOUBLE) AS npxg FROM merged""",
        club=CLUB, merged=MERGED),
    "er_club_stats": q(f"SELECT player_id, {r('minutes')} AS minutes, {r('goals')} AS goals FROM hit", **{k: BASE[k] for k in ("people", "nms")}, club=CLUB, merged=MERGED,
        hit="SELECT * FROM nms JOIN merged ON team = team_norm AND name = player_norm QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY pos) = 1"),
    "appearance_agg": q("SELECT * EXCLUDE (starts) FROM tot", season_=SEASON, tot=TOTALS),
    "starts_agg": q("SELECT player_id, starts FROM tot", season_=SEASON, tot=TOTALS),
    "build_club_stats": q(f"""SELECT player_id, team, player_name, club_name, competition, {r('value')} AS market_value_eur, appearances, minutes, goals, assists, yellow_cards,
        red_cards, starts, CAST(1998 AS BIGINT) AS season FROM ct""", season_=SEASON, tot=TOTALS, ct=CLUB_TABLE),
    "coverage_report": q(f"""SELECT team, {r('m / n')} AS matched_rate, {r('coalesce(pa, 0) / n')} AS appearance_rate, n AS squad_players, m AS matched_players, pa AS players_with_appearances,
        CAST(tm AS BIGINT) AS total_minutes FROM (SELECT team, count(*) AS n, count(*) FILTER (player_id % 3 > 0) AS m FROM c_players GROUP BY team)
        LEFT JOIN (SELECT team, count(appearances) AS pa, sum(minutes) AS tm FROM ct GROUP BY team) USING (team)""", season_=SEASON, tot=TOTALS, ct=CLUB_TABLE),
    "unmatched_players": q("SELECT player_id, team FROM c_players WHERE player_id % 3 = 0 AND team <> 'NATION_0'"),
    "team_aggregates": q(f"""SELECT team, {r('avg(pace)')} AS pace_mean, {r('avg(shooting)')} AS shooting_mean, {r('avg(value)')} AS value_mean, {r('sum(pace)')} AS pace_sum,
        count(*) AS squad_player_count, count(*) FILTER (player_id % 3 > 0) AS matched_count FROM c_players GROUP BY team"""),
    "topk_team": q("SELECT team, " + ", ".join(f"{r(v)} AS squad_{n}" for n, v in {
        "top1_tm_value": "t1", "top3_tm_value_sum": "s3", "top3_tm_value_mean": "m3", "top11_tm_value_count": "coalesce(n, 0)", "top11_tm_value_sum": "s11",
        "top11_tm_value_mean": "m11"}.items()) + " FROM (SELECT DISTINCT team FROM c_players) LEFT JOIN top USING (team)", top=TOP),
    "coalesce_fallback": q(f"""SELECT player_id, CAST(mi IS NOT NULL AS INTEGER) AS matched, {r('mi')} AS player_club_minutes, {r('g')} AS player_club_goals, {r('sh')} AS player_club_shots FROM fp""",
        fp=FORM["fp"]),
    "club_form_top11": q(f"""SELECT team, {r('n')} AS squad_club_form_top11_count, {r('mc')} AS squad_club_form_top11_matched_count, {r('m')} AS squad_club_form_minutes_sum_top11,
        {r('mm')} AS squad_club_form_minutes_mean_top11, {per90('g')} AS squad_club_form_goals_per90_top11, {per90('a')} AS squad_club_form_assists_per90_top11,
        {per90('(g + a)')} AS squad_club_form_goal_contrib_per90_top11, {per90('xg')} AS squad_club_form_xg_per90_top11, CAST(NULL AS DOUBLE) AS squad_club_form_npxg_per90_top11,
        {per90('(g - xg)')} AS squad_club_form_goal_minus_xg_per90_top11, CAST(NULL AS DOUBLE) AS squad_club_form_xa_per90_top11, {per90('sh')} AS squad_club_form_shots_per90_top11,
        CAST(NULL AS DOUBLE) AS squad_club_form_key_passes_per90_top11, {per90('di')} AS squad_club_form_tackles_interceptions_per90_top11,
        {r('g / nullif(sh, 0)')} AS squad_club_form_goals_per_shot_top11 FROM ag""", **FORM),
    "team_line_power": q(f"""SELECT t AS team_name, {r('at_ * ch')} AS team_attack, {r('mi * ch')} AS team_midfield, {r('de * ch')} AS team_defense, {r('ch')} AS chemistry_bonus, n AS player_count FROM tl""", **LINES),
    "matchup_features": q(f"""SELECT match_id, {r('coalesce(h.at_ * h.ch, 0) - coalesce(a.de * a.ch, 0)')} AS feat_home_attack_vs_away_defense,
        {r('coalesce(a.at_ * a.ch, 0) - coalesce(h.de * h.ch, 0)')} AS feat_away_attack_vs_home_defense, {r('coalesce(h.mi * h.ch, 0) - coalesce(a.mi * a.ch, 0)')} AS feat_midfield_control_diff,
        {r('coalesce(h.ch, 1)')} AS feat_home_chemistry, {r('coalesce(a.ch, 1)')} AS feat_away_chemistry
      FROM c_matches LEFT JOIN tl h ON home_team = h.t LEFT JOIN tl a ON away_team = a.t""", **LINES),
    "rank_top11": q(f"""SELECT player_id, t AS team_name FROM (SELECT player_id, 'T' || (player_id % 60) AS t, pace + passing AS ov, {' + '.join(ATTRS)} AS sm FROM c_players WHERE player_id % 8 > 0)
        QUALIFY row_number() OVER (PARTITION BY t ORDER BY ov DESC, sm DESC, player_id) <= 11"""),
    "top11_with_fallback": q(f"""SELECT y AS worldcup_year, t AS team_name, CASE WHEN an < 8 AND bn > an THEN 'national_top11_fallback' WHEN an > 0 THEN 'official_squad_matched' ELSE 'missing' END AS selection_source,
        {r('CASE WHEN an < 8 AND bn > an THEN sb ELSE sa END')} AS overall, CASE WHEN an < 8 AND bn > an THEN bn ELSE an END AS selected_players FROM j""", **FALLBACK),
    "squads_to_ratings": q(f"""SELECT y AS worldcup_year, t AS team_name, nk AS name_key, player_id, {r('ov')} AS overall FROM (
        SELECT r.* FROM yr r WHERE player_id % 3 > 0 AND EXISTS (SELECT 1 FROM sq WHERE sq.y = r.y AND sq.t = r.t AND sq.nk = r.nk)
        UNION ALL SELECT r.player_id, r.y, sq.t, r.ov, r.nk FROM yr r JOIN sq ON sq.y = r.y AND sq.nk = r.nk WHERE r.player_id % 3 = 0)
      QUALIFY row_number() OVER (PARTITION BY y, t, nk ORDER BY ov DESC, player_id) = 1""", yr=YEARLY, sq="SELECT DISTINCT y, t, nk FROM yr WHERE player_id % 5 > 0"),
    "clean_squad": q("SELECT player_id, CASE WHEN player_id % 4 = 0 THEN ['Bosnia and Herzegovina','South Korea','iR irAN','Turkey','Nowhere'][player_id % 5 + 1] ELSE team END AS team_norm, CASE WHEN player_id % 9 > 0 THEN CAST(birthdate AS VARCHAR) END AS birthdate FROM c_players"),
    "squad_layout": q("SELECT player_id, t || '__' || y AS team_key, t AS real_team_name FROM yr", yr=YEARLY),
    "standardize_ratings": q(f"""SELECT seq, worldcup_year, team_name, player_name, simplified_position, club_name, {LEGACY.format('player_name')} AS name_key, {r('pace')} AS pace,
        {r('shooting')} AS shooting, {r('overall')} AS overall FROM st""", st=STANDARD),
    "squad_rows_by_year": f"""SELECT DISTINCT CAST(2006 + c_custkey % 6 * 4 AS INTEGER) AS worldcup_year, 'N' || c_nationkey AS team_name, nm AS player_name, {LEGACY.format('nm')} AS name_key
      FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'G' || (c_custkey % 17) || ' ' END || 'F' || (c_custkey % 23) AS nm FROM customer)
      WHERE c_custkey % 11 > 0 AND c_custkey % 6 IN (1, 2, 3, 4)""",
}
