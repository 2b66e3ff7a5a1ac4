"""Times the headline queries and one whole run; prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8);
BENCH_ALERTS: alerts of the generated whole run (default 1,000,000; 0 leaves it out)."""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

HEADLINE = (
    "scan_store_counts", "sql_sev_disp", "sql_grouping_sets", "quarantine_counts", "dedup_pk", "alert_durations", "repeat_running", "case_link", "asset_features", "entity_features", "entity_month",
    "peer_robust_z", "findings", "eg01", "eg02", "eg03", "eg04", "eg05", "eg06", "eg07", "eg08", "ns01", "ns02", "ns03", "ns04", "ns05", "ns06", "area_scores", "queue_full", "claim_compare", "feedback_weights", "checklist_score", "precision_at_k",
    "asof_last_event", "range_open_cases", "range_cases_on_asset", "sketch_periods", "feedback_merged",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    alerts = int(os.environ.get("BENCH_ALERTS", "1000000"))
    sys.path.insert(0, str(Path(__file__).parent))
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    scratch = tempfile.mkdtemp(prefix="sentrygrid-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sentrygrid.operators import generators
    from sentrygrid.plans import extended, pipeline, registry

    def timed(f) -> float:
        began = time.perf_counter()
        f()
        return round(time.perf_counter() - began, 3)

    registry.QUERIES["scan_store_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session
    queries = registry.QUERIES | extended.QUERIES | {"findings": registry.basic_findings}  # the step that scores, queues and reports read from
    times = {n: timed(lambda n=n: queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save()) for n in HEADLINE}
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(m[1]) if (m := re.search(r"sf([0-9.]+)", sf_dir)) else None}
    if alerts:
        store = f"{scratch}/in"
        for name, df in generators.scale_bundle(spark, alerts).tables().items():
            df.write.parquet(f"{store}/{name}.parquet")
        spent = timed(lambda: pipeline.run_all(spark, store, f"{scratch}/out"))
        out["whole_run"] = {"alerts": alerts, "seconds": spent, "alerts_per_second": round(alerts / spent)}
    print(json.dumps(out))
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)


if __name__ == "__main__":
    main()
