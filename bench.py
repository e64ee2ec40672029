"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from tidemark.plans.catalog import QUERIES, flagship
    from tidemark.session import session, ship

    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    ship(spark)
    from tidemark.plans import bench_queries

    names = ["win_rolling_std", "win_ewm_std", "win_shock_state", "cb_gap_fill", "lb_fade_success", "ft_volatility_volume", "join_asof_definition", "agg_multi_scope", "aud_threshold_grid", "wf_folds", "bt_equity", "ml_ridge"]
    work = {"flagship": flagship, **{n: QUERIES[n] for n in names}, **bench_queries.LOADS}
    work["flagship"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiled code and file listings
    took = {}
    for name, query in work.items():
        begin = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begin, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    sys.exit(main())
