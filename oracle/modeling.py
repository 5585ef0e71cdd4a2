"""Oracle SQL of the feature-table, evaluation and tuning queries."""

from oracle.carriers import MATCH_ID
from oracle.sql import q, r

FRAME = f"""SELECT {MATCH_ID} AS match_id, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS closing_home_odds, 3.5 AS closing_draw_odds,
   CASE WHEN l_linenumber <> 2 THEN l_linenumber / 2 - l_linenumber % 3 END AS handicap_change, l_quantity AS home_elo, CAST(l_linestatus = 'O' AS INTEGER) AS is_neutral,
   CASE WHEN l_quantity > 25 THEN l_discount END AS h2h_draw_rate_10y, l_suppkey AS away_squad_squad_top1_fc26 FROM lineitem"""
NAMES = ["closing_home_odds", "closing_draw_odds", "handicap_change", "home_elo", "is_neutral", "h2h_draw_rate_10y", "away_squad_squad_top1_fc26"]
MEDIAN = {
    "mf": f"""SELECT {MATCH_ID} AS match_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber < 6 THEN l_quantity END AS f_quantity,
        CASE WHEN l_linenumber > 2 THEN l_extendedprice END AS f_price, CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber AS DOUBLE) END AS f_text FROM lineitem""",
    "md": """SELECT quantile_cont(f_quantity, 0.5) AS f_quantity, quantile_cont(f_price, 0.5) AS f_price, quantile_cont(f_text, 0.5) AS f_text FROM (
        SELECT *, row_number() OVER (ORDER BY date, match_id) AS k, count(*) OVER () AS n FROM mf) WHERE k <= floor(n * 0.8)""",
}
MODELS = ["gbm", "rf", "logistic", "poisson"]


def mix(weights: list[str]) -> str:
    return ", ".join("(" + " + ".join(f"{w} * {m}_{i}" for w, m in zip(weights, MODELS)) + f") AS p{i}" for i in range(3))


BEST = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
BLEND = {"bl": f"SELECT *, {BEST} AS prediction FROM (SELECT match_id, tournament, label, {mix(['0.45', '0.20', '0.20', '0.15'])} FROM c_probs)"}
OWN = "CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END"
BRIER = "(p0 - (label = 0)::INT) ** 2 + (p1 - (label = 1)::INT) ** 2 + (p2 - (label = 2)::INT) ** 2"
HIT = "avg((prediction = label)::INT)"


def f1(i: int) -> str:
    return f"coalesce(2 * count(*) FILTER (label = {i} AND prediction = {i}) / nullif(count(*) FILTER (label = {i}) + count(*) FILTER (prediction = {i}), 0), 0)"


def recall(i: int) -> str:
    return f"coalesce(count(*) FILTER (label = {i} AND prediction = {i}) / nullif(count(*) FILTER (label = {i}), 0), 0)"


def precision(i: int) -> str:
    return f"coalesce(count(*) FILTER (label = {i} AND prediction = {i}) / nullif(count(*) FILTER (prediction = {i}), 0), 0)"


MACRO = f"({f1(0)} + {f1(1)} + {f1(2)}) / 3"
THRESH = {
    **BLEND,
    "tt": f"""SELECT t, label, CASE WHEN t IS NOT NULL AND p1 >= t THEN 1 ELSE prediction END AS prediction
      FROM bl, (SELECT NULL AS t UNION ALL SELECT round(0.20 + 0.01 * i, 2) FROM range(19) x(i))""",
    "sc": f"SELECT t, {HIT} AS acc, {MACRO} AS mf, {recall(1)} AS dr, count(*) FILTER (prediction = 1) AS dp FROM tt GROUP BY t",
}
ODDS_BASE = "CASE WHEN home_odds <= draw_odds AND home_odds <= away_odds THEN 0 WHEN draw_odds <= away_odds THEN 1 ELSE 2 END"
GRID = """SELECT row_number() OVER (ORDER BY extra, g, f, l) AS k, g, f, l, p FROM (
  SELECT 0 AS extra, a.i / 10 AS g, b.i / 10 AS f, c.i / 10 AS l, (10 - a.i - b.i - c.i) / 10 AS p FROM range(7) a(i), range(7) b(i), range(7) c(i)
    WHERE a.i >= 2 AND 10 - a.i - b.i - c.i BETWEEN 0 AND 4 UNION ALL SELECT 1, 0.45, 0.20, 0.20, 0.15)"""
TUNED = f"""SELECT k, g, f, l, p, avg(({BEST} = label)::INT) AS acc, avg(-ln({OWN})) AS ll, avg({BRIER}) AS br FROM (
  SELECT k, g, f, l, p, label, {mix(['g', 'f', 'l', 'p'])} FROM c_probs, grid) GROUP BY k, g, f, l, p"""

ORACLE = {
    "line_change": q(f"SELECT match_id, {r('handicap_change')} AS handicap_change FROM f", f=FRAME),
    "feature_projection": q("SELECT match_id, " + ", ".join(f"{r(n)} AS {n}" for n in NAMES) + " FROM f", f=FRAME),
    "missing_audit": q("SELECT match_id, CAST(len(m) AS INTEGER) AS missing_feature_count, array_to_string(m, ',') AS missing_features, 0 AS complete FROM (SELECT match_id, ["
        + "x FOR x IN [" + ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in NAMES) + ", 'away_elo'] IF x IS NOT NULL] AS m FROM f)", f=FRAME),
    "train_medians": q(f"SELECT {r('f_quantity')} AS f_quantity, {r('f_price')} AS f_price, {r('f_text')} AS f_text FROM md", **MEDIAN),
    "impute_apply": q("SELECT match_id, " + ", ".join(f"{r(f'coalesce(mf.{n}, md.{n})')} AS {n}" for n in ("f_quantity", "f_price", "f_text"))
        + ", CAST(0 AS DOUBLE) AS f_absent FROM mf, md", **MEDIAN),
    "blend": q(f"SELECT match_id, {r('p0')} AS p0, {r('p1')} AS p1, {r('p2')} AS p2 FROM bl", **BLEND),
    "decide": q("SELECT match_id, prediction, CASE WHEN p1 >= 0.33 THEN 1 ELSE prediction END AS with_threshold FROM bl", **BLEND),
    "tune_weights": q(f"""SELECT CAST(row_number() OVER (ORDER BY round(ll, 12), acc DESC, round(br, 12), k) = 1 AS INTEGER) AS best, {r('g')} AS w_gbm, {r('f')} AS w_rf, {r('l')} AS w_logistic,
        {r('p')} AS w_poisson, {r('acc')} AS accuracy, {r('ll')} AS log_loss, {r('br')} AS brier FROM tuned""", grid=GRID, tuned=TUNED),
    "tune_threshold": q(f"""SELECT CAST(k = 1 AS INTEGER) AS best, {r('t')} AS draw_threshold, {r('acc')} AS accuracy, {r('mf')} AS macro_f1, {r('dr')} AS draw_recall, dp AS draw_predictions
      FROM (SELECT *, row_number() OVER (ORDER BY acc >= (SELECT acc FROM sc WHERE t IS NULL) - 0.005 DESC, round(mf, 12) DESC, round(dr, 12) DESC, acc DESC,
        CASE WHEN t IS NULL THEN -999 ELSE -t END DESC) AS k FROM sc)""", **THRESH),
    "eval_metrics": q(f"SELECT {r(HIT)} AS accuracy, {r(f'avg(-ln({OWN}))')} AS log_loss, {r(f'avg({BRIER})')} AS brier, {r(MACRO)} AS macro_f1, " + ", ".join(
        f"{r(precision(i))} AS {n}_precision, {r(recall(i))} AS {n}_recall, {r(f1(i))} AS {n}_f1" for i, n in enumerate(("home", "draw", "away")))
        + ", count(*) AS rows, " + ", ".join(f"count(*) FILTER (label = {t} AND prediction = {p}) AS c{t}{p}" for t in range(3) for p in range(3)) + " FROM bl", **BLEND),
    "eval_by_segment": q(f"""SELECT CASE WHEN tournament ILIKE '%world cup%' THEN 'world_cup' WHEN tournament ILIKE '%friendly%' THEN 'friendly' ELSE 'other' END AS bucket,
        {r(HIT)} AS accuracy, {r(recall(1))} AS draw_recall, count(*) AS rows FROM bl GROUP BY 1""", **BLEND),
    "baseline_odds": q(f"SELECT match_id, {ODDS_BASE} AS baseline FROM c_market"),
    "confidence_buckets": q(f"""SELECT CASE WHEN c <= 0.45 THEN '(0.0, 0.45]' WHEN c <= 0.55 THEN '(0.45, 0.55]' WHEN c <= 0.65 THEN '(0.55, 0.65]' WHEN c <= 0.75 THEN '(0.65, 0.75]'
        WHEN c <= 0.85 THEN '(0.75, 0.85]' ELSE '(0.85, 1.0]' END AS bucket, {r(HIT)} AS hit_rate, {r('avg(c)')} AS avg_confidence, count(*) AS matches
      FROM (SELECT *, greatest(p0, p1, p2) AS c FROM bl) GROUP BY 1""", **BLEND),
    "strategy_audit": q(f"""SELECT CAST({HIT} > avg((baseline = label)::INT) AS INTEGER) AS beats_baseline, {r(HIT)} AS accuracy, {r('avg((baseline = label)::INT)')} AS baseline_accuracy,
        {r(f'avg(-ln({OWN}))')} AS log_loss, {r(f'avg({BRIER})')} AS brier, {r(recall(1))} AS draw_recall, {r(precision(1))} AS draw_precision, count(*) AS rows
      FROM bl JOIN (SELECT match_id, {ODDS_BASE} AS baseline FROM c_market) USING (match_id)""", **BLEND),
    "overfit_verdict": q(f"""SELECT tournament, year, CASE WHEN a - b >= 0.15 THEN 'clear_overfitting' WHEN a - b >= 0.08 THEN 'some_overfitting' ELSE 'no_clear_overfitting' END AS verdict,
        {r('a')} AS train, {r('b')} AS test FROM (SELECT tournament, year(date) AS year,
          avg((CASE WHEN gbm_0 >= gbm_1 AND gbm_0 >= gbm_2 THEN 0 WHEN gbm_1 >= gbm_2 THEN 1 ELSE 2 END = label)::INT) AS a,
          avg((CASE WHEN rf_0 >= rf_1 AND rf_0 >= rf_2 THEN 0 WHEN rf_1 >= rf_2 THEN 1 ELSE 2 END = label)::INT) AS b FROM c_probs GROUP BY ALL)"""),
}
