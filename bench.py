"""Bench: wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is materialized with a no-op write (full computation, no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "integrated_recommendation", "shipment_carrier_quotes", "route_choice", "vendor_stats",
    "transport_carbon", "early_warning_indicators", "defaults_by_package", "inference_ledger_totals",
    "model_country_pivot", "carbon_by_package", "risk_score", "pareto_frontier", "casp_ranking",
    "governance_recommendations", "extract_requests", "weather_cascade", "forecast_failures",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from cargolens.plans.catalog import load_all
    from cargolens.session import local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="cargolens-bench")
    qs = load_all()
    names = [n for n in HEADLINE if n in qs]
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_wall_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
