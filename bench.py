"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every result is
computed in full into the noop sink, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from touchline.plans import ALL_QUERIES, flagship
from touchline.session import get_spark

HEADLINE = [
    "clean_matches", "asof_elo", "asof_ranking", "recent_form", "h2h", "standings_before", "tolerant_date_join",
    "odds_dispersion", "flatten_bookmaker_long", "time_split", "train_medians", "asof_lag_odds", "stream_odds_changes",
    "market_decision", "poisson_grid", "top_exact_scores", "betting_package", "er_ratings_ladder", "er_ratings_fuzzy",
    "build_club_stats", "club_form_top11", "matchup_features", "tune_weights", "eval_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        # The bench tables are single small files: let several tasks share one.
        "spark.sql.files.openCostInBytes": "262144"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(query) -> float:
        started = time.time()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - started, 3)

    run(flagship)
    wanted = sys.argv[1:] or HEADLINE
    times = {name: run(ALL_QUERIES[name]) for name in wanted}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
