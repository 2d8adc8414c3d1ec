"""Every registered query with an oracle matches DuckDB on the sf0.001 tables (a fast subset here)."""

import math

import duckdb
import pytest

from tests.conftest import SF001

FAST = ["vendor_stats", "transport_carbon", "early_warning_indicators", "shipment_carrier_quotes", "route_choice",
        "integrated_recommendation", "risk_score", "pareto_frontier", "extract_requests", "weather_cascade",
        "lane_distance", "classification_report", "inference_ledger_totals", "defaults_by_package",
        "optimize_delivery", "risk_assessment", "distance_cascade", "cluster_profiles_by_vendor_id", "train_test_split",
        "cross_validation_folds", "impute_and_score", "pareto_frontier_points", "pareto_frontier_global_cost"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v
    return sorted(repr(tuple(n(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, name):
    from cargolens.plans.catalog import load_all, load_oracle
    df = load_all()[name](spark, SF001)
    con = duckdb.connect()
    for t in ["region", "nation", "supplier", "orders", "lineitem", "events", "customer", "part"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    cur = con.execute(load_oracle()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(cur.fetchall(), dcols)
