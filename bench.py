"""Benchmark: every registered report over the test data at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per report, default 5).  All reports are run once (``first_run``:
the load step, file listings and code generation count there), then each is timed
BENCH_RUNS times (plan construction, size checks and execution) with the ``noop`` sink,
which executes the full plan without moving rows to the driver.  Prints one JSON line;
``value`` is the sum of the per-report median seconds.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans import catalog  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402


def _sf(sf_dir: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", sf_dir)
    return float(m.group(1)) if m else sf_dir


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    only = [a for a in sys.argv[1:]] or [r.name for r in catalog.REPORTS]
    spark = local_session(cpus, app="ledgerlens-bench")
    timings: dict[str, float] = {}

    def once(name: str) -> float:
        t0 = time.perf_counter()
        df = catalog.run(spark, sf_dir, name, normalised=False)
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    first = {name: round(once(name), 4) for name in only}
    for name in only:
        timings[name] = round(statistics.median(once(name) for _ in range(runs)), 4)
    out = {"metric": "sum_of_median_report_seconds", "value": round(sum(timings.values()), 4),
           "unit": "sec", "queries": timings, "first_run_total": round(sum(first.values()), 4), "first_run": first,
           "sf": _sf(sf_dir), "cpus": cpus, "runs": runs, "spark": spark.version}
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
