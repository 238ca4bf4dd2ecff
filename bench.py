"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` (default 8) against ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1).  Each query is fully executed into Spark's
``noop`` sink (no driver collect) after one untimed warm-up query, three times
with an empty cache, and counts with its median.  ``*_packed``, ``*_additive``
and ``*_dual`` are the same 64-feature fit by the three ridge plans;
``prediction_64`` is the prediction step alone (frames x 64 times 64 x series).
Prints ONE JSON line on stdout:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # response preparation, context text, enrichment, embedding
    "prepare_responses",
    "context_ws_16",
    "summary_input",
    "enrich_continuation",
    "embed_hash_mean",
    # model fitting: flagship (fused and by the path of a real model) and its variants
    "encode_baseline_k2",
    "encode_text_k2",
    "bootstrap_ridge_k2",
    "alpha_per_group_k2",
    "compare_windows_k2",
    "intersubject_k2",
    "pca_sweep",
    # wide fit: 64-feature stimulus, every series
    "ridge_wide_packed",
    "ridge_wide_additive",
    "ridge_wide_dual",
    "prediction_64",
]
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def _wide(plan):
    def q(spark, d):
        from voxlex.operators import ridge as rg
        from voxlex.sources import fixtures as fx
        p = rg.RidgeParams(chunklen=5, nboots=5, seed=42)
        return rg.bootstrap_ridge(fx.stim_frames(spark, d), fx.resp_mean(spark, d), ["voxel"], p, plan=plan)
    return q


_FITTED: dict = {}


def _prediction(spark, d):
    """Predictions of weights that were fitted and written before the clock starts."""
    from voxlex.operators import ridge as rg
    return rg.predict(*_FITTED["inputs"], ["voxel"])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from voxlex import get_session
    from voxlex.operators import ridge as rg
    from voxlex.plans.queries import QUERIES
    from voxlex.session import cut_lineage
    from voxlex.sources import fixtures as fx
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    qs = dict(QUERIES, ridge_wide_packed=_wide("packed"), ridge_wide_additive=_wide("additive"), ridge_wide_dual=_wide("dual"),
              prediction_64=_prediction)
    # Untimed warm-up: JVM start, JIT and Python worker launch are paid here,
    # so the timed numbers are steady-state query times.
    QUERIES["series_corr"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    if "prediction_64" in names:
        x = cut_lineage(fx.stim_frames(spark, sf_dir))
        _FITTED["inputs"] = x, cut_lineage(rg.ridge_weights(x, fx.resp_mean(spark, sf_dir), ["voxel"], 10.0))
    times = {}
    for name in names:
        runs = []
        for _ in range(REPEATS):
            spark.catalog.clearCache()
            t0 = time.time()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
