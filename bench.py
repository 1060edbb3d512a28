"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores. Every query is run
twice into the noop sink and the faster run counts, so JVM warm-up is left out.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["loso_centroid_retrieval", "block_epochs", "extract_bank", "band_powers", "cbsi", "trial_covariance", "zscore_subject",
            "ewm_standardize", "within_subject_sessions", "gather_aligned", "evaluate_folds", "bootstrap_ci", "temperature_fit",
            "aggregation_sweep", "retrieval_metrics", "robustness_grid", "balanced_batches", "shrinkage_lda", "noise_whitener",
            "riemannian_mean", "bootstrap_kappa", "zero_shot_transfer", "method_riemann", "method_fbcsp", "window_bank"]


def main() -> None:
    from trialframe.plans.catalog import QUERIES
    from trialframe.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            t0 = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        seconds[name] = round(min(runs), 3)
        print(name, [round(x, 2) for x in runs], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
