"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from canonframe.plans import catalog
from canonframe.session import build_session

# The first two build the address space and the links, which the others read, as a corpus build does.
HEADLINE = [
    "wn04_dense_rank", "prj12_vote_tiers", "ag01_reference_heat", "tk01_most_referenced", "jn05_range_expansion", "jn06_overlap_join", "ag22_reference_totals",
    "gr04_page_rank", "jn10_unexplained_gaps", "jn03_interlinear", "ag03_inflected_forms", "ag20_dictionary_coverage",
    "tx01_inverted_index", "ag18_date_envelope", "gr09_margin_notes", "gr10_entity_details", "jn17_asof_lookup",
    "fn01_normalize_text", "fn10_reference_parsing", "ag27_fingerprint", "sm05_reading_progress",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", int(cpus), **{"spark.driver.memory": os.environ.get("BENCH_MEM", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    fns = catalog.callables()
    wanted = sys.argv[1:] or HEADLINE
    # One warm-up so that the first query does not pay for the JVM and the Python workers.
    fns["fn01_normalize_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        fns[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
