"""Oracle SQL of the market, fixture, score-grid and selection queries."""

from oracle.carriers import CTE, K, MATCH_ID
from oracle.sources import MARKET_STEPS
from oracle.sql import q, r

CTE["c_market"] = f"""SELECT *, CASE WHEN home_prob >= draw_prob AND home_prob >= away_prob THEN '主胜' WHEN draw_prob >= away_prob THEN '平局' ELSE '客胜' END AS model_pick
  FROM (SELECT *, a/(a+b+c) AS home_prob, b/(a+b+c) AS draw_prob, c/(a+b+c) AS away_prob,
    b/(a+b+c) AS hhad_home_prob, c/(a+b+c) AS hhad_draw_prob, a/(a+b+c) AS hhad_away_prob
  FROM (SELECT {MATCH_ID} AS match_id, CAST(l_shipdate AS DATE) AS day,
    1 + l_linenumber + l_extendedprice / CAST(7654321 AS DOUBLE) AS a, CAST(1 + l_partkey % 7 AS DOUBLE) AS b, CAST(1 + l_suppkey % 5 AS DOUBLE) AS c,
    CAST(1.1 AS DOUBLE) + l_discount * 20 + l_extendedprice / CAST(7654321 AS DOUBLE) AS home_odds, CAST(2.6 AS DOUBLE) + l_tax * 10 + l_extendedprice / CAST(7654321 AS DOUBLE) AS draw_odds, CAST(1.2 AS DOUBLE) + l_quantity / 12 + l_extendedprice / CAST(7654321 AS DOUBLE) AS away_odds,
    CAST(l_partkey % 5 - 2 AS DOUBLE) / 2 AS line,
    {', '.join(f"CAST(1.3 AS DOUBLE) + ((l_partkey + {i}) % 20) / 8 + l_extendedprice / CAST(7654321 AS DOUBLE) AS hhad_{s}_odds" for i, s in enumerate(('home', 'draw', 'away')))},
    {', '.join(f"((l_suppkey + {i}) % 7 - 3) / 20 AS signal_{i}" for i in range(6))},
    CASE WHEN l_partkey % 4 > 0 THEN (l_partkey % 13 - 6) / 2 END AS sentiment_diff,
    CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * 40 - 1000 END AS elo_diff,
    CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 100 - 500 END AS fifa_points_diff,
    l_quantity - 25 AS rating_diff, l_extendedprice * 100 AS home_value, (l_partkey % 50) * CAST(100000 AS DOUBLE) AS away_value,
    (l_linenumber > 5) AS priced, CASE WHEN l_linenumber < 7 THEN (l_partkey % 11) / 10 END AS home_pressure, (l_suppkey % 11) / 10 AS away_pressure,
    CAST(0.2 AS DOUBLE) + l_quantity / 20 + l_extendedprice / CAST(7654321 AS DOUBLE) AS home_lambda, CAST(0.2 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 3 AS away_lambda,
    l_partkey, l_suppkey, l_linenumber FROM lineitem))"""


def _row(i: int, pool: str, label: str, prob: str, odds: str) -> str:
    pick = f"model_pick = '{label}'" if i < 3 else "false"
    return f"SELECT *, {i} AS pos, '{pool}' AS pool, '{label}' AS selection, {prob} AS probability, {odds} AS odds, signal_{i} AS signal, {pick} AS is_pick FROM c_market"


CTE["c_selections"] = " UNION ALL ".join(
    [_row(i, "HAD 胜平负", lab, f"{s}_prob", f"{s}_odds") for i, (s, lab) in enumerate(zip(("home", "draw", "away"), ("主胜", "平局", "客胜")))]
    + [_row(i + 3, "HHAD 让球胜平负", lab, f"hhad_{s}_prob", f"hhad_{s}_odds") for i, (s, lab) in enumerate(zip(("home", "draw", "away"), ("让胜", "让平", "让负")))])
CTE["c_grid"] = """SELECT match_id, i, j, exp(i * ln(home_lambda) - home_lambda) / factorial(CAST(i AS INTEGER)) * exp(j * ln(away_lambda) - away_lambda) / factorial(CAST(j AS INTEGER)) AS w
  FROM c_lambdas, range(7) x(i), range(7) y(j)"""
CTE["c_best_scores"] = """SELECT match_id, i, j, i || '-' || j AS score, p, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 12) DESC, i, j) AS n
  FROM (SELECT match_id, i, j, w / sum(w) OVER (PARTITION BY match_id) AS p FROM c_grid) QUALIFY n <= 8"""


def edge(p: str, o: str) -> str:
    return f"({p} * {o} - 1)"


def kelly(p: str, o: str) -> str:
    return f"(CASE WHEN {p} > 0 AND {o} > 1 AND {p} * {o} - 1 > 0 THEN ({p} * {o} - 1) / ({o} - 1) ELSE 0 END)"


HALVES = {
    "cur": """SELECT match_id, pool_code, outcome, arg_max(odds, fetched_at) AS odds FROM c_snapshots WHERE fetched_at >= TIMESTAMP '2024-01-16' GROUP BY ALL""",
    "prev": """SELECT match_id, pool_code, outcome, arg_max(odds, fetched_at) AS previous_odds FROM c_snapshots WHERE fetched_at < TIMESTAMP '2024-01-16' GROUP BY ALL""",
    "d": "SELECT *, odds - previous_odds AS ch FROM cur JOIN prev USING (match_id, pool_code, outcome) WHERE abs(odds - previous_odds) >= 0.02",
}
CHANGES = f"""{r('odds')} AS odds, {r('previous_odds')} AS previous_odds, {r('ch')} AS odds_change, {r('ch / previous_odds')} AS odds_change_pct"""


def lag_join(lag: int, at: str) -> str:
    return f"""ASOF LEFT JOIN c_snapshots s{lag} ON x.match_id = s{lag}.match_id AND x.pool_code = s{lag}.pool_code AND x.outcome = s{lag}.outcome
      AND {at} - INTERVAL {lag} MINUTE >= s{lag}.fetched_at"""


def move(c: str) -> str:
    return f"""(CASE WHEN {c} IS NULL THEN 0 WHEN {c} <= -0.10 THEN 0.16 WHEN {c} <= -0.05 THEN 0.10 WHEN {c} <= -0.02 THEN 0.05
      WHEN {c} >= 0.10 THEN -0.14 WHEN {c} >= 0.05 THEN -0.09 WHEN {c} >= 0.02 THEN -0.04 ELSE 0 END)"""


DECISION = {
    "cur": """SELECT *, max(fetched_at) OVER (PARTITION BY match_id) AS now FROM (
        SELECT match_id, pool_code, outcome, arg_max(odds, fetched_at) AS odds, max(fetched_at) AS fetched_at FROM c_snapshots GROUP BY ALL)""",
    "model": """SELECT *, CAST(1 + n % 5 AS DOUBLE) AS a, CAST(1 + n % 3 AS DOUBLE) AS b, CAST(1 + n % 7 AS DOUBLE) AS d
        FROM (SELECT *, CAST(substr(match_id, 2) AS INTEGER) AS n FROM cur)""",
    "priced": """SELECT x.match_id, x.pool_code, x.outcome, x.odds, 1 / x.odds AS mp,
        CASE x.pool_code || x.outcome WHEN 'hadhome_win' THEN a WHEN 'haddraw' THEN b WHEN 'hadaway_win' THEN d
          WHEN 'hhadhome_win' THEN b WHEN 'hhaddraw' THEN d ELSE a END / (a + b + d) AS p,
        x.odds - s10.odds AS c10, x.odds - s30.odds AS c30, x.odds - s120.odds AS c120
      FROM model x """ + " ".join(lag_join(m, "x.now") for m in (10, 30, 120)) + " WHERE x.odds > 1",
    "scored": f"SELECT *, p - mp AS ve, {move('c10')} + {move('c30')} + {move('c120')} AS mom FROM priced",
    "final": "SELECT *, least(greatest(ve, -0.3), 0.3) AS vs, least(greatest(ve, -0.3), 0.3) + mom AS fs FROM scored",
}

TRADE_FILTER = "lower(title || ' ' || slug) LIKE '%world cup%' AND upper(side) = 'BUY' AND size * price >= 500"
GAMES = f"""SELECT DISTINCT concat_ws('/', user_id % 100, {K}, strftime(ts, '%Y-%m-%d')) AS match_key, strftime(ts, '%Y-%m-%d') AS date,
   't' || (user_id % 100) AS h, 't' || {K} AS a FROM events"""
TOLD = """SELECT *, regexp_extract(title, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS day, string_split_regex(lower(title), '[^a-z0-9]+') AS w
   FROM c_trades_base WHERE contains(lower(title), 'exact score')"""
NAMED = "g.date = t.day AND list_contains(w, h) AND list_contains(w, a)"

CRS = f"""SELECT l_orderkey AS match_id, {MATCH_ID} AS seq,
   CASE WHEN l_partkey % 9 = 0 THEN 'home_other' ELSE (CAST(l_quantity AS INTEGER) % 4) || '-' || (l_linenumber % 3) END AS outcome,
   CAST(l_quantity AS INTEGER) % 4 AS h, l_linenumber % 3 AS a, l_extendedprice / 5000 + l_tax AS odds FROM lineitem"""

FIX = "SELECT fixture_id, date, home_team, away_team FROM c_fixtures"
REQUESTS = """SELECT fixture_id AS request_id, date + CAST(fixture_id % 3 AS INTEGER) AS date,
   CASE WHEN fixture_id % 4 = 0 THEN away_team ELSE home_team END AS home_team, CASE WHEN fixture_id % 4 = 0 THEN home_team ELSE away_team END AS away_team
 FROM c_fixtures"""
LISTED = "SELECT date + 1 AS day, request_id AS match_id, home_team, away_team FROM requests"
DAYS = """SELECT date + 1 AS day, * FROM c_fixtures UNION ALL SELECT date AS day, * FROM c_fixtures
   WHERE date NOT IN (SELECT date + 1 FROM c_fixtures)"""

LIVE = {
    "f": """SELECT fixture_id, date, home_team, away_team, CASE WHEN fixture_id % 4 = 0 THEN 1.5 + (fixture_id % 10) / 10 END AS ch,
        CASE WHEN fixture_id % 4 = 0 THEN 3.1 + (fixture_id % 10) / 10 END AS cd, CASE WHEN fixture_id % 4 = 0 THEN 2.2 + (fixture_id % 10) / 10 END AS ca FROM c_fixtures""",
    "l": "SELECT fixture_id, date + CAST(fixture_id % 2 AS INTEGER) AS date, home_team, away_team FROM c_fixtures",
    "had": """SELECT date, home_team, away_team, arg_min(1.2 + (fixture_id % 30) / 10, fixture_id) AS lh, arg_min(3.0 + (fixture_id % 7) / 10, fixture_id) AS ld,
        arg_min(2.0 + (fixture_id % 11) / 10, fixture_id) FILTER (fixture_id % 15 <> 0) AS la, 'live_sporttery_had' AS label, 0 AS src
      FROM l WHERE fixture_id % 3 = 0 GROUP BY date, home_team, away_team""",
    "crs": """SELECT date, home_team, away_team, (h + d + a) / h AS lh, (h + d + a) / d AS ld, (h + d + a) / a AS la, 'live_sporttery_crs_implied' AS label, 1 AS src FROM (
        SELECT date, home_team, away_team, sum(1 / (5 + fixture_id % 9)) AS h, sum(1.0 / 7) AS d, sum(1 / (9 + fixture_id % 4)) AS a
        FROM (SELECT *  REPLACE (CAST(fixture_id AS BIGINT) AS fixture_id) FROM l) WHERE fixture_id % 3 = 1 GROUP BY date, home_team, away_team)""",
    "both_": "SELECT *, 0 AS late FROM (SELECT * FROM had UNION ALL SELECT * FROM crs) UNION ALL SELECT * REPLACE (date - 1 AS date), 1 FROM (SELECT * FROM had UNION ALL SELECT * FROM crs)",
    "live": "SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY date, home_team, away_team ORDER BY late, src) = 1",
}

SCHEDULE = {
    "g": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN c_nationkey ELSE (c_nationkey + 5) % 25 END AS hid,
        CASE WHEN o_orderkey % 2 = 0 THEN (c_nationkey + 5) % 25 ELSE c_nationkey END AS aid, 'G' || (c_nationkey % 5) AS grp,
        CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 = 0 AS INTEGER) AS date, o_custkey % 100 AS sid,
        CASE WHEN o_orderkey % 4 = 0 THEN 'knockout' ELSE 'group' END AS kind,
        CASE WHEN o_orderkey % 7 > 0 THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 = 0 AS INTEGER) + 1, '%Y-%m-%d') || ' 02:30' END AS utc
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 > 0""",
    "named": """SELECT g.*, h.n_name AS home_team, a.n_name AS away_team, 'F' || hid AS hc, 'F' || aid AS ac, s_name, sn.n_name AS country, 'FIFA ' || s_name AS fifa, 'C' || (s_suppkey % 11) AS city,
        CAST(floor(abs(s_acctbal)) AS BIGINT) AS cap, 'R' || sn.n_regionkey AS reg FROM g
      JOIN nation h ON hid = h.n_nationkey JOIN nation a ON aid = a.n_nationkey LEFT JOIN supplier ON sid = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey""",
    "v": """SELECT date - sh AS date, home_team, away_team, hc, id, grp, kind, utc, sid, fifa, city, cap, reg, s_name, CAST(home_team = country AS INTEGER) AS hh,
          CAST(home_team = country OR away_team = country AS INTEGER) AS hm, 0 AS sw, sh * 2 AS rk FROM named, (VALUES (0), (1)) t(sh)
        UNION ALL SELECT date - sh, away_team, home_team, ac, id, grp, kind, utc, sid, fifa, city, cap, reg, s_name, CAST(away_team = country AS INTEGER),
          CAST(home_team = country OR away_team = country AS INTEGER), 1, sh * 2 + 1 FROM named, (VALUES (0), (1)) t(sh)""",
    "best": "SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY date, home_team, away_team ORDER BY rk, id) = 1",
}

GUARD = """SELECT *, CASE
   WHEN fav IS NULL THEN false
   WHEN pos < 3 THEN CASE WHEN fav = 'home' THEN selection <> '主胜' ELSE selection <> '客胜' END
   WHEN fav = 'home' AND line < 0 THEN selection <> '让胜' WHEN fav = 'away' AND line > 0 THEN selection <> '让负' ELSE false END AS bad
 FROM (SELECT *, CASE WHEN model_pick = '主胜' AND (home_prob >= 0.68 OR home_odds <= 1.45) THEN 'home'
   WHEN model_pick = '客胜' AND (away_prob >= 0.68 OR away_odds <= 1.45) THEN 'away' END AS fav FROM {src})"""
GUARDED = "SELECT *, CASE WHEN bad THEN greatest(0.001, probability * 0.55) ELSE probability END AS gp FROM g"
PRICED = f"SELECT *, {edge('gp', 'odds')} AS ev, {kelly('gp', 'odds')} AS kl, gp * odds AS ret FROM gg"

STRENGTH = {
    "s": """SELECT *, CASE WHEN elo_diff IS NOT NULL THEN least(greatest(elo_diff / 350, -1.2), 1.2) END AS s1,
        CASE WHEN fifa_points_diff IS NOT NULL THEN least(greatest(fifa_points_diff / 260, -0.8), 0.8) END AS s2,
        least(greatest(rating_diff / 24, -0.9), 0.9) AS s3,
        CASE WHEN home_value > 0 AND away_value > 0 THEN least(greatest((ln(1 + home_value) - ln(1 + away_value)) / 4, -0.9), 0.9) END AS s4 FROM c_market""",
    "t": """SELECT *, coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0) + coalesce(s4, 0) AS sc,
        (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT AS k FROM s""",
    "u": "SELECT *, NOT priced AND k >= 2 AND abs(sc) >= 1.15 AS live, least(0.16, 0.045 * abs(sc)) AS sh FROM t",
    "w": """SELECT *, greatest(0.001, home_prob + CASE WHEN sc > 0 THEN sh ELSE -0.45 * sh END) AS h, greatest(0.001, draw_prob - 0.55 * sh) AS d,
        greatest(0.001, away_prob + CASE WHEN sc > 0 THEN -0.45 * sh ELSE sh END) AS y FROM u""",
}
MOTIVE = {
    "m": "SELECT *, greatest(-1, least(1, home_pressure - away_pressure)) AS pd, greatest(0, least(home_pressure, away_pressure)) AS ps FROM c_market",
    "w": """SELECT *, greatest(0.01, home_prob + 0.04 * pd + 0.0125 * ps) AS h, greatest(0.01, draw_prob - 0.015 * abs(pd) - 0.025 * ps) AS d,
        greatest(0.01, away_prob - 0.04 * pd + 0.0125 * ps) AS y FROM m""",
}

SCORES = {
    "listed": """SELECT * FROM (SELECT *, CAST(0.9 AS DOUBLE) + ((l_partkey + 3 * pos) % 30) / 2 AS o FROM (
        SELECT *, unnest([['1-0','2-1','0-0','1-1','0-1'],['2-0','0-0','1-2','home_other','0-2'],['6-6','5-6','6-0','0-6','5-5']][l_partkey % 3 + 1]) AS label,
          unnest([0,1,2,3,4]) AS pos FROM c_market)) WHERE o > 1""",
    "joined": """SELECT l.*, b.p AS pp, b.n AS bn, CAST(split_part(label, '-', 1) AS VARCHAR) AS x, CASE WHEN label = 'home_other' THEN NULL
        ELSE sign(TRY_CAST(split_part(label, '-', 1) AS INTEGER) - TRY_CAST(split_part(label, '-', 2) AS INTEGER)) END AS sg
      FROM listed l LEFT JOIN c_best_scores b ON l.match_id = b.match_id AND l.label = b.score AND l.l_linenumber < 7""",
    "shares": """SELECT *, bool_or(pp IS NOT NULL) OVER (PARTITION BY match_id) AS has, (1 / o) / sum(CASE WHEN sg IS NOT NULL THEN 1 / o END) OVER (PARTITION BY match_id) AS share FROM joined""",
    "mass": "SELECT *, sum(CASE WHEN sg IS NOT NULL THEN share END) OVER (PARTITION BY match_id, sg) AS ms FROM shares",
    "cand": """SELECT *, CASE WHEN has THEN pp ELSE least(greatest(share * (CASE sg WHEN 1 THEN home_prob WHEN 0 THEN draw_prob ELSE away_prob END / ms), 0.001), 0.35) END AS p,
        CASE WHEN has THEN bn = 1 ELSE CASE sg WHEN 1 THEN '主胜' WHEN 0 THEN '平局' ELSE '客胜' END = model_pick END AS pick
      FROM mass WHERE (has AND pp IS NOT NULL) OR (NOT has AND sg IS NOT NULL)""",
}


GUARDED_SELECTIONS = {"g": GUARD.format(src="c_selections"), "gg": GUARDED, "pr": PRICED}
TOO_FEW_LEGS, NO_VALUE = "可用正期望选项不足 2 场，按中国体彩串关口径暂不建议强行组串。", "组合期望值不为正，不建议购买。"
TOO_FEW_MATCHES, LOW_VALUE = "可用选项不足 2 场，不强行组串。", "组合期望值偏低，属于娱乐型多串，不是严格价值投注。"


def package_steps(source: dict[str, str], minimum: float, aggressive: bool, cap: float | None, most: int = 3) -> dict[str, str]:
    """Options of every match as ``left_``; removal order and ticket counts by plain windows. ``source`` ends in ``pr``."""
    steps = {**source, "items": f"SELECT * FROM pr WHERE odds > 1 AND gp >= {minimum}"
             + ("" if aggressive else " AND NOT bad AND NOT (contains(selection, '平') AND ev < 0.03)")}
    if aggressive:
        steps["opt"] = f"""SELECT *, false AS same, row_number() OVER (PARTITION BY match_id ORDER BY signal DESC, round(ev, 9) DESC, round(ret, 9) DESC, odds DESC, gp DESC, pos) AS k FROM items QUALIFY k <= {most}"""
    else:
        # Every match names its model pick, so the direction is the pick's own.
        steps["dirs"] = """SELECT *, CASE model_pick WHEN '主胜' THEN selection IN ('主胜','让胜') WHEN '客胜' THEN selection IN ('客胜','让负') ELSE selection IN ('平局','让平') END AS same FROM items"""
        steps["fl"] = "SELECT * FROM (SELECT *, max(odds) OVER (PARTITION BY match_id) AS mo FROM dirs) WHERE odds >= CASE WHEN mo >= 1.5 THEN 1.5 ELSE 1.3 END"
        steps["kept"] = "SELECT *, same OR NOT bool_or(same) OVER (PARTITION BY match_id) AS kp FROM fl"
        steps["flags"] = """SELECT *, kp AND ev > 0 AS f1, kp AND ev >= -0.18 AND gp >= 0.35 AS f2, pos >= 3 AND ev >= 0.08 AND gp >= 0.25 AS f3 FROM kept"""
        steps["used"] = """SELECT *, bool_or(f1) OVER m AS a1, bool_or(f2) OVER m AS a2, min(CASE WHEN f3 THEN pos END) OVER m AS p3 FROM flags WINDOW m AS (PARTITION BY match_id)"""
        steps["opt"] = f"""SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY is_pick DESC, same DESC, signal DESC, round(ret, 9) DESC, round(kl, 9) DESC, round(ev, 9) DESC, pos) AS k
          FROM used WHERE CASE WHEN a1 THEN f1 WHEN a2 THEN f2 ELSE f3 AND pos = p3 END QUALIFY k <= {most}"""
    if cap is None:
        return {**steps, "left_": "SELECT * FROM opt"}
    steps["sized"] = """SELECT *, count(*) OVER (PARTITION BY match_id) AS n, ret * CASE WHEN same THEN 2 ELSE 1 END AS sc FROM opt"""
    steps["tick"] = "SELECT day, sum(ln(n)) AS lt FROM sized WHERE k = 1 GROUP BY day"
    steps["loose"] = "SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY sc, k) AS j FROM sized WHERE NOT is_pick QUALIFY j < n"
    steps["run"] = """SELECT day, match_id, k, coalesce(sum(ln((n - j) / (n - j + 1))) OVER (PARTITION BY day ORDER BY sc, match_id, k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM loose"""
    steps["gone"] = f"SELECT day, match_id, k FROM run JOIN tick USING (day) WHERE exp(lt + s) * 2 > {cap} + 1e-6"
    steps["left_"] = "SELECT * FROM sized s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.match_id = s.match_id AND g.k = s.k)"
    return steps


def package_sql(steps: dict[str, str], package: str = "") -> str:
    """A package per day; days that are not available have a reason and no numbers."""
    grp = """SELECT day, match_id, count(*) AS n, min(odds) AS lo, max(odds) AS hi, least(0.98, sum(gp)) AS hit, sum(ret) / count(*) AS rr, sum(kl) AS kl, sum(ev) AS ev
        FROM left_ GROUP BY day, match_id"""
    every = "SELECT day, count(DISTINCT match_id) AS every FROM pr GROUP BY day"
    told = f"""SELECT day, exp(sum(ln(rr))) AS back, {r('sum(ln(n)) + ln(2)')} AS log_total_cost, {r('sum(ln(hi)) + ln(2)')} AS log_theoretical_max_prize,
        {r('sum(ln(lo))')} AS log_min_combined_odds, {r('sum(ln(hi))')} AS log_max_combined_odds, {r('sum(ln(n))')} AS log_bet_count,
        {r('sum(ln(hit))')} AS log_package_hit_probability, {r('sum(kl) / sum(n)')} AS average_kelly, {r('sum(ev) / sum(n)')} AS average_option_ev,
        count(*) AS matches, CAST(sum(n) AS BIGINT) AS selected_count, count(*) || '串1' AS play_type FROM grp GROUP BY day"""
    numbers = ("log_total_cost", "log_theoretical_max_prize", "log_min_combined_odds", "log_max_combined_odds", "log_bet_count",
               "log_package_hit_probability", "average_kelly", "average_option_ev", "selected_count", "play_type")
    return q(f"""SELECT CAST(day AS VARCHAR) AS day, {package} CAST(coalesce(matches >= 2 AND back - 1 > -0.12, false) AS INTEGER) AS available,
        CASE WHEN coalesce(matches, 0) < 2 THEN '{TOO_FEW_MATCHES}' WHEN back <= 1 THEN '{LOW_VALUE}' ELSE '' END AS reason,
        {', '.join(f'CASE WHEN matches >= 2 THEN {c} END AS {c}' for c in numbers)}, coalesce(matches, 0) AS matches, every - coalesce(matches, 0) AS skipped
      FROM every LEFT JOIN told USING (day)""", **steps, grp=grp, every=every, told=told)


def parlay_sql(most: int, least: float, picks: bool) -> dict[str, str]:
    return {
        **GUARDED_SELECTIONS, "every": "SELECT DISTINCT day FROM pr",
        "one": f"""SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY kl DESC, ev DESC, gp DESC, pos) AS k
          FROM pr WHERE gp > 0 AND odds > 1 AND gp >= {least} {'AND is_pick' if picks else ''} QUALIFY k = 1""",
        "legs": f"SELECT *, row_number() OVER (PARTITION BY day ORDER BY kl DESC, ev DESC, gp DESC, match_id) AS leg FROM one QUALIFY leg <= {most}",
        "bet": """SELECT day, count(*) AS n, product(odds) AS co, product(gp) AS cp, string_agg(match_id || ':' || pos || ':' || selection, ',' ORDER BY leg) AS legs,
          string_agg(match_id || ':' || pos, ',' ORDER BY leg) AS places FROM legs GROUP BY day HAVING count(*) >= 2""",
        "v": f"SELECT day, n, co, cp, legs, places, cp * co - 1 AS v, {kelly('cp', 'co')} AS fk FROM every LEFT JOIN bet USING (day)",
    }


#: Handicap selections at their Poisson chances, moved by mood and market signal.
ADVICE = {
    "gh": """SELECT match_id, line, i, j, exp(i * ln(home_lambda) - home_lambda) / factorial(CAST(i AS INTEGER)) * exp(j * ln(away_lambda) - away_lambda) / factorial(CAST(j AS INTEGER)) AS w
      FROM c_market, range(9) x(i), range(9) y(j)""",
    "hp": """SELECT match_id, sum(w) FILTER (i + line - j > 1e-9) / sum(w) AS hp3, sum(w) FILTER (abs(i + line - j) <= 1e-9) / sum(w) AS hp4,
      sum(w) FILTER (i + line - j < -1e-9) / sum(w) AS hp5 FROM gh GROUP BY match_id""",
    "own": """SELECT * REPLACE (coalesce(CASE WHEN pos = 3 AND hp3 > 0 THEN hp3 WHEN pos = 4 AND hp4 > 0 THEN hp4 WHEN pos = 5 AND hp5 > 0 THEN hp5 END, probability) AS probability)
      FROM c_selections JOIN hp USING (match_id)""",
    "felt": """SELECT * REPLACE (CASE WHEN sentiment_diff IS NULL OR dir = 0 THEN probability
        ELSE greatest(0.001, least(0.98, probability * (1 + 0.035 * sentiment_diff * dir))) END AS probability)
      FROM (SELECT *, CASE WHEN selection IN ('主胜','让胜') THEN 1 WHEN selection IN ('客胜','让负') THEN -1 ELSE -0.25 * abs(sentiment_diff) END AS dir FROM own)""",
    "moved": """SELECT * REPLACE (greatest(0.001, least(0.98, probability * (1 + least(greatest(signal, -0.15), 0.18)))) AS probability) FROM felt""",
    "g": GUARD.format(src="moved"), "gg": GUARDED, "pr": PRICED,
}
SCORE_ADVICE = {
    **SCORES,
    "pr": f"""SELECT day, match_id, pos, label AS selection, p AS gp, o AS odds, {edge('p', 'o')} AS ev, {kelly('p', 'o')} AS kl, p * o AS ret, pick AS is_pick,
      model_pick, CAST(0 AS DOUBLE) AS signal, false AS bad FROM cand""",
}
DAILY = " UNION ALL ".join(f"SELECT * FROM ({package_sql(package_steps(*args), f"'{name}' AS package,")})" for name, args in {
    "wdl_conservative": (ADVICE, 0.15, False, 50, 3), "wdl_aggressive": (ADVICE, 0.12, True, 80, 3),
    "score_conservative": (SCORE_ADVICE, 0.06, False, None, 2), "score_aggressive": (SCORE_ADVICE, 0.02, True, None, 3)}.items())


ORACLE = {
    "snapshot_diff": q(f"SELECT match_id, pool_code, outcome, {CHANGES} FROM d", **HALVES),
    "largest_moves": q(f"SELECT match_id, pool_code, outcome, {r('ch')} AS odds_change FROM d", **HALVES),
    "stream_odds_changes": q(f"SELECT event_id, match_id, pool_code, outcome, {CHANGES} FROM d WHERE abs(ch) >= 0.02",
        d="""SELECT *, odds - previous_odds AS ch FROM (SELECT *, lag(odds) OVER (PARTITION BY match_id, pool_code, outcome ORDER BY fetched_at) AS previous_odds FROM c_snapshots)"""),
    "asof_lag_odds": q(f"SELECT x.event_id, {r('x.odds')} AS odds, " + ", ".join(f"{r(f's{m}.odds')} AS prior_{m}" for m in (10, 30, 120))
        + " FROM c_snapshots x " + " ".join(lag_join(m, "x.fetched_at") for m in (10, 30, 120))),
    "odds_move_score": f"SELECT event_id, {r(move('ch'))} AS score FROM (SELECT event_id, (event_id % 61 - 30) / 200 + value / 100000 AS ch FROM events)",
    "market_decision": q(f"""SELECT match_id, pool_code, outcome, CASE WHEN ve > 0.04 AND mom < -0.05 THEN '观望' WHEN fs >= 0.22 AND ve > 0 THEN '强信号'
        WHEN fs >= 0.10 THEN '可关注' WHEN fs <= -0.10 THEN '回避' ELSE '中性' END AS grade, {r('odds')} AS odds, {r('p')} AS model_probability,
        {r('mp')} AS market_probability, {r('ve')} AS value_edge, {r('c10')} AS odds_change_10m, {r('c30')} AS odds_change_30m, {r('c120')} AS odds_change_120m,
        {r('mom')} AS momentum_score, {r('vs')} AS value_score, {r('fs')} AS final_score FROM final""", **DECISION),
    "edge_report": q(f"""SELECT p_partkey, market_id, {r('mp')} AS model_probability, {r('probability')} AS market_probability, {r('mp - probability')} AS edge
      FROM pred LEFT JOIN one ON pred.subject = one.subject AND pred.signal_type = one.signal_type""", **MARKET_STEPS,
        one="""SELECT lower(subject) AS subject, signal_type, market_id, probability FROM rows_ x WHERE subject <> '' AND (outcome = 'Yes'
          OR list_sort((SELECT list(DISTINCT y.outcome) FROM rows_ y WHERE y.market_id = x.market_id)) <> ['No','Yes'])""",
        pred="""SELECT p_partkey, 't' || (p_partkey % 60) AS subject, ['tournament_winner','advance_or_qualify','match_related'][p_size % 3 + 1] AS signal_type,
          CASE WHEN p_size % 10 > 0 THEN p_size / 64 END AS mp FROM part"""),
    "stream_large_buys": q(f"""SELECT DISTINCT trade_id, side, {r('size * price')} AS notional, {r('size')} AS size, {r('price')} AS price FROM c_trades WHERE {TRADE_FILTER}"""),
    "trade_to_match": q(f"SELECT DISTINCT trade_id, match_key FROM told t JOIN games g ON {NAMED}", games=GAMES, told=TOLD),
    "match_large_buys": q(f"SELECT trade_id, match_key, {r('size * price')} AS notional FROM told t JOIN games g ON {NAMED} WHERE {TRADE_FILTER}", games=GAMES, told=TOLD),
    "signal_attach": q(f"""SELECT match_id, CASE WHEN pool_code = 'had' THEN 'HAD 胜平负' ELSE 'HHAD 让球胜平负' END AS pool,
        CASE pool_code || outcome WHEN 'hadhome_win' THEN '主胜' WHEN 'haddraw' THEN '平局' WHEN 'hadaway_win' THEN '客胜'
          WHEN 'hhadhome_win' THEN '让胜(-1)' WHEN 'hhaddraw' THEN '让平(-1)' ELSE '让负(-1)' END AS selection, {r('arg_min(odds, event_id)')} AS final_score
      FROM c_snapshots GROUP BY match_id, pool_code, outcome"""),
    "crs_implied": q(f"""SELECT match_id, {r('h / t')} AS home_prob, {r('d / t')} AS draw_prob, {r('w / t')} AS away_prob FROM (SELECT match_id,
        coalesce(sum(1 / odds) FILTER (h > a), 0) AS h, coalesce(sum(1 / odds) FILTER (h = a), 0) AS d, coalesce(sum(1 / odds) FILTER (h < a), 0) AS w,
        sum(1 / odds) AS t FROM crs WHERE outcome <> 'home_other' AND odds > 0 GROUP BY match_id)""", crs=CRS),
    "shortest_odds": q(f"""SELECT match_id, outcome || '#' || seq AS outcome, {r('odds')} AS odds, n AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY odds, outcome || '#' || seq) AS n FROM crs WHERE outcome <> 'home_other') WHERE n <= 3""", crs=CRS),
    "pool_board": q("""SELECT match_id, pool_code, CASE pool_code WHEN 'had' THEN 1 ELSE 2 END AS place, string_agg(outcome, ',' ORDER BY odds, outcome) AS options
      FROM (SELECT match_id, pool_code, outcome, arg_max(odds, fetched_at) AS odds FROM c_snapshots GROUP BY ALL) GROUP BY ALL"""),
    "pivot_outcomes": q("SELECT CAST(CAST(commence_time AS DATE) AS VARCHAR) AS date, home_team, away_team, " + ", ".join(
        r(f"arg_min(odds, seq) FILTER (outcome = '{s}')") + f" AS {s}_odds" for s in ("home", "draw", "away")) + " FROM c_bookmaker GROUP BY ALL"),
    "live_odds_overlay": q(f"""SELECT fixture_id, CASE WHEN lh IS NOT NULL AND ld IS NOT NULL AND la IS NOT NULL THEN label
        WHEN coalesce(lh, ch) IS NOT NULL AND coalesce(ld, cd) IS NOT NULL AND coalesce(la, ca) IS NOT NULL THEN 'historical_or_existing' ELSE 'missing' END AS odds_source,
        {r('coalesce(lh, ch)')} AS closing_home_odds, {r('coalesce(ld, cd)')} AS closing_draw_odds, {r('coalesce(la, ca)')} AS closing_away_odds
      FROM f LEFT JOIN live USING (date, home_team, away_team)""", **LIVE),
    "schedule_join": q("""SELECT fixture_id, grp AS worldcup_group, kind AS worldcup_match_type, utc, sid AS stadium_id, fifa AS stadium_fifa_name, city AS stadium_city,
        cap AS stadium_capacity, reg AS stadium_region, hc AS home_fifa_code, s_name AS stadium_name, id AS repo_match_id, CAST(sw AS BIGINT) AS repo_home_away_swapped,
        CASE WHEN id IS NOT NULL THEN CAST(coalesce(hh, 0) AS BIGINT) END AS is_home_host_country, CASE WHEN id IS NOT NULL THEN CAST(coalesce(hm, 0) AS BIGINT) END AS is_host_country_match,
        CASE WHEN id IS NOT NULL THEN 18 END AS kickoff_hour_local FROM fix LEFT JOIN best USING (date, home_team, away_team)""", fix=FIX, **SCHEDULE),
    "fixture_lookup": q("""SELECT request_id, fixture_id, CAST(sw AS BIGINT) AS swapped, CAST(fixture_id IS NOT NULL AS BIGINT) AS available FROM requests r LEFT JOIN LATERAL (
        SELECT fixture_id, sw FROM (SELECT fixture_id, 0 AS sw FROM t WHERE t.home_team = r.home_team AND t.away_team = r.away_team AND (t.date = r.date OR t.date = r.date - 1)
          UNION ALL SELECT fixture_id, 1 FROM t WHERE t.home_team = r.away_team AND t.away_team = r.home_team AND (t.date = r.date OR t.date = r.date - 1)) ORDER BY sw, fixture_id LIMIT 1) ON true""",
        requests=REQUESTS, t="SELECT * FROM c_fixtures WHERE fixture_id % 5 > 0"),
    "unlisted_fixtures": q("""SELECT CAST(day AS VARCHAR) AS day, fixture_id FROM days d WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.day = d.day
        AND ((lower(l.home_team) = lower(d.home_team) AND lower(l.away_team) = lower(d.away_team)) OR (lower(l.home_team) = lower(d.away_team) AND lower(l.away_team) = lower(d.home_team))))""",
        requests=REQUESTS, listed=LISTED, days=DAYS),
    "open_match_count": q("""SELECT CAST(day AS VARCHAR) AS day, CAST(CASE WHEN nxt - day <= 14 THEN nxt ELSE day END AS VARCHAR) AS next_day, scheduled, coalesce(opened, 0) AS open FROM (
        SELECT day, count(*) AS scheduled, (SELECT min(x.day) FROM days x WHERE x.day > d.day) AS nxt FROM days d GROUP BY day)
      LEFT JOIN (SELECT day, count(DISTINCT (match_id, home_team, away_team)) AS opened FROM listed GROUP BY day) USING (day)""", requests=REQUESTS, listed=LISTED, days=DAYS),
    "poisson_grid": q(f"""SELECT match_id, CASE WHEN h >= d AND h >= a THEN 'home_win' WHEN d >= a THEN 'draw' ELSE 'away_win' END AS pick,
        {r('h / t')} AS home_win_prob, {r('d / t')} AS draw_prob, {r('a / t')} AS away_win_prob FROM (
        SELECT match_id, sum(w) FILTER (i > j) AS h, sum(w) FILTER (i = j) AS d, sum(w) FILTER (i < j) AS a, sum(w) AS t FROM c_grid GROUP BY match_id)"""),
    "top_exact_scores": q(f"SELECT match_id, string_agg(score, ' ' ORDER BY n) AS scores, {r('sum(p)')} AS covered FROM c_best_scores GROUP BY match_id"),
    "poisson_handicap": q(f"""SELECT match_id, {r('sum(w) FILTER (i + handicap_line - j > 1e-9) / sum(w)')} AS handicap_home,
        {r('coalesce(sum(w) FILTER (abs(i + handicap_line - j) <= 1e-9), 0) / sum(w)')} AS handicap_draw,
        {r('sum(w) FILTER (i + handicap_line - j < -1e-9) / sum(w)')} AS handicap_away FROM g9 GROUP BY match_id""",
        g9="""SELECT match_id, handicap_line, i, j, exp(i * ln(home_lambda) - home_lambda) / factorial(CAST(i AS INTEGER)) * exp(j * ln(away_lambda) - away_lambda) / factorial(CAST(j AS INTEGER)) AS w
          FROM c_lambdas, range(9) x(i), range(9) y(j)"""),
    "selection_edge": q(f"""SELECT match_id, selection, {r('probability')} AS probability, {r('odds')} AS odds, {r(edge('probability', 'odds'))} AS expected_value,
        {r(kelly('probability', 'odds'))} AS kelly FROM c_selections"""),
    "strength_adjust": q("SELECT match_id, " + ", ".join(
        f"{r(f'CASE WHEN live THEN {x} / (h + d + y) ELSE {s}_prob END')} AS {s}_prob" for x, s in zip("hdy", ("home", "draw", "away"))) + " FROM w", **STRENGTH),
    "motivation_adjust": q("SELECT match_id, " + ", ".join(
        f"{r(f'CASE WHEN home_pressure IS NOT NULL THEN {x} / (h + d + y) ELSE {s}_prob END')} AS {s}_prob" for x, s in zip("hdy", ("home", "draw", "away"))) + " FROM w", **MOTIVE),
    "sentiment_diff": q(f"""SELECT match_id, {r('CASE WHEN h.m IS NOT NULL OR a.m IS NOT NULL THEN least(greatest(coalesce(h.m, 0) - coalesce(a.m, 0), -3), 3) END')} AS sentiment_diff
      FROM c_matches LEFT JOIN mood h ON home_team = h.team LEFT JOIN mood a ON away_team = a.team""",
        mood="SELECT team, (max(elo) / 1500 - 3) * ((max(seq) % 10) / 10) AS m FROM c_static WHERE elo > 0 GROUP BY team"),
    "sentiment_adjust": q(f"""SELECT match_id, selection, {r('''CASE WHEN sentiment_diff IS NULL OR dir = 0 THEN probability
        ELSE greatest(0.001, least(0.98, probability * (1 + 0.035 * sentiment_diff * dir))) END''')} AS probability
      FROM (SELECT *, CASE WHEN selection IN ('主胜','让胜') THEN 1 WHEN selection IN ('客胜','让负') THEN -1 ELSE -0.25 * abs(sentiment_diff) END AS dir FROM c_selections)"""),
    "market_signal_adjust": q(f"""SELECT match_id, selection, {r('p')} AS probability, {r(edge('p', 'odds'))} AS expected_value, {r(kelly('p', 'odds'))} AS kelly,
        {r('coalesce(fs, 0)')} AS market_signal_score FROM (SELECT *, CASE WHEN fs IS NULL THEN probability ELSE
          greatest(0.001, least(0.98, probability * (1 + least(greatest(fs, -0.15), 0.18)))) END AS p
        FROM (SELECT *, CASE WHEN l_suppkey % 3 > 0 THEN signal * 2 END AS fs FROM c_selections))"""),
    "favorite_guard": q(f"SELECT match_id, selection, CAST(bad AS INTEGER) AS conflict, {r('gp')} AS probability, {r('ev')} AS expected_value FROM pr",
        g=GUARD.format(src="c_selections"), gg=GUARDED, pr=PRICED),
    "exact_score_candidates": q(f"""SELECT match_id, count(*) AS candidates, count(*) FILTER (pick) AS picks, {r('sum(p)')} AS probability,
        {r(f"max({edge('p', 'o')})")} AS best_value, {r(f"sum({kelly('p', 'o')})")} AS kelly FROM cand GROUP BY match_id""", **SCORES),
    "parlay_plan": q(f"""SELECT CAST(day AS VARCHAR) AS day, CAST(coalesce(v > 0 AND least(0.05, 0.25 * fk) > 0, false) AS INTEGER) AS available, {r('co')} AS combined_odds, {r('cp')} AS combined_probability,
        {r('v')} AS expected_value, {r('CASE WHEN n IS NOT NULL THEN fk END')} AS full_kelly, {r('CASE WHEN n IS NOT NULL THEN least(0.05, 0.25 * fk) END')} AS stake_fraction, coalesce(n, 0) AS leg_count, coalesce(legs, '') AS legs,
        n || '串1' AS play_type, CASE WHEN n IS NULL THEN '{TOO_FEW_LEGS}' WHEN v > 0 THEN '' ELSE '{NO_VALUE}' END AS reason FROM v""", **parlay_sql(4, 0, False)),
    "parlay_plan_model_picks": q(f"""SELECT CAST(day AS VARCHAR) AS day, CAST(coalesce(v > 0 AND least(0.05, 0.25 * fk) > 0, false) AS INTEGER) AS available, {r('co')} AS combined_odds,
        {r('CASE WHEN n IS NOT NULL THEN least(0.05, 0.25 * fk) END')} AS stake_fraction, coalesce(places, '') AS legs,
        CASE WHEN n IS NULL THEN '{TOO_FEW_LEGS}' WHEN v > 0 THEN '' ELSE '{NO_VALUE}' END AS reason FROM v""", **parlay_sql(2, 0.3, True)),
    "package_legs": q("""SELECT CAST(day AS VARCHAR) AS day, match_id, coalesce(n, 0) AS n, coalesce(options, '') AS options FROM (SELECT DISTINCT day, match_id FROM pr) LEFT JOIN (
        SELECT match_id, count(*) AS n, string_agg(pos || ':' || selection, ',' ORDER BY k) AS options FROM left_ GROUP BY match_id) USING (match_id)""",
        **package_steps(GUARDED_SELECTIONS, 0.15, False, 50)),
    "daily_advice": DAILY,
    "betting_package": package_sql(package_steps(GUARDED_SELECTIONS, 0.15, False, 50)),
    "betting_package_aggressive": package_sql(package_steps(GUARDED_SELECTIONS, 0.12, True, 80)),
}
