"""Times the headline queries, in an order in which shared tables and models
are built by the first query that needs them. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from crashgrade.plans.queries import QUERIES  # noqa: E402
from crashgrade.session import local_session  # noqa: E402

HEADLINE = [
    "road_features",
    "zone_infra",
    "weather",
    "accidents",
    "rush_hour_severity",
    "consolidate",
    "cell_statistics",
    "length_by_type",
    "dominant_type",
    "attach_infra",
    "attach_weather",
    "joined_features",
    "weather_at_place",
    "source_features",
    "outlier_bounds",
    "remove_outliers",
    "profile",
    "apply_scaler",
    "vif_trace",
    "split_audit",
    # Each fit by itself; the first one builds the training table.
    "fit_logistic",
    "fit_lda_all_features",
    "fit_forest",
    "fit_mlp_early_stop",
    "fit_boosted",
    "base_scores",
    "fit_stack",
    "tune_models",
    "threshold_sweep",
    "roc_auc",
    "compare_rules",
    "compare_models",
    "paired_auc_models",
    "accumulated_effects",
    "permutation_importance",
    "linear_shap",
    "risk_hotspots",
    "hypothesis_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench", **{"spark.driver.memory": "16g"})
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "accident severity, all headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
