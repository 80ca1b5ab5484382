"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f4_marginals",
    "f4_three_way",
    "f5_marginals_dense",
    "f10_product_histogram",
    "f14_maintained_counts",
    "e3_private_edges",
    "e10_quantile_grid",
    "c8_stratified_split",
    "g2_private_measurement",
    "g5_select_and_measure",
    "h1_random_table",
    "h6_score_edits",
    "h7_accept_sets",
    "h12_private_fit",
    "h14_synthesize",
]


def _private_fit(spark, sf_dir):
    from veiltab.plans.queries_synth import _fit

    fitted = _fit(spark, sf_dir)[0]
    return fitted.table, fitted.log


def _synthesize(spark, sf_dir):
    from veiltab.plans.queries_synth import synthesize

    s = synthesize(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return s.sample(), s.fitted.log


# The same work as the queries of these names, with the distance reached.
FITS = {"h12_private_fit": _private_fit, "h14_synthesize": _synthesize}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from veiltab.plans.catalog import QUERIES
    from veiltab.session import local_session

    spark = local_session(cores, max(8, int(cores) if cores.isdigit() else 8))
    QUERIES["d8_typed_rows"](spark, sf_dir).collect() if "d8_typed_rows" in QUERIES else None
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm-up
    seconds, distance = {}, {}
    for name in HEADLINE:
        start = time.time()
        if name in FITS:
            table, log = FITS[name](spark, sf_dir)
            table.write.format("noop").mode("overwrite").save()
            steps = sorted({(r[0], r[1]) for r in log})
            distance[name] = {"rounds": steps[-1][0], "of_start": round(steps[-1][1] / steps[0][1], 6)}
        else:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    out = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "distance": distance,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
