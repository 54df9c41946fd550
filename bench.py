"""Headline timings. Prints one JSON line.

Each step's time includes the stored tables it is the first to need, so the sum is the cost
of the whole run from the raw tables; nothing is prepared outside the clock.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fairline.plans import registry  # noqa: E402
from fairline.session import build_session  # noqa: E402

STEPS = (
    "match_table",              # mapping of the raw tables
    "closing_line_reliability",  # prices to bands, straight from the table
    "devig_power",
    "quotes_from_events",       # nested feed events to quotes
    "upcoming_fixtures",        # latest quote per fixture
    "long_card",                # 46 selections per match, graded
    "reliability_all_scopes",   # stores the graded selections and folds
    "expected_calibration_error",
    "recalibrate",              # walk-forward calibration of every selection
    "refit_schedule",
    "backtest_bets",            # ratio strengths, markets, edges
    "backtest_summary",         # with the bootstrap interval
    "insights",                 # all findings, three intervals among them
    "walk_forward_coverage",    # all likelihood refits and line fits
    "settle_picks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(4 * int(cpus)), "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")})
    queries = registry.queries()
    timings = {}
    for name in STEPS:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
