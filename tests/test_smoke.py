"""Every registered query of the library builds on the smallest tables; sinks and streams survive a rerun."""

import pytest
from pyspark.sql import functions as F

from cargolens.functions.ranking import grouped_row_number, prefix_min
from cargolens.operators import frontier
from cargolens.plans import catalog
from cargolens.sources import files
from cargolens.streaming import jobs

from .conftest import SF001

#: Fits of 100 trees while building: tests/test_models.py covers their operators with few trees.
FITS = {"gbt_regressors", "gbt_delay_classifier", "top_k_importance", "impute_and_score_predictions", "cross_validation"}


def test_every_query_builds(spark):
    broken = {}
    for name, query in catalog.load_all().items():
        if name not in FITS:
            try:
                assert query(spark, SF001).columns
            except Exception as e:  # noqa: BLE001
                broken[name] = str(e)[:200]
    assert not broken


def test_every_oracle_has_its_query():
    assert set(catalog.load_oracle()) <= set(catalog.load_all())


def test_a_stream_that_stops_between_batches_goes_on(spark, tmp_path, monkeypatch):
    schema = "inference_id long, model string, country string, num_inferences long, tokens long, measured_wh double"
    from cargolens.sources import views

    log = views.inference_log(spark, SF001)
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    log.where(F.col("inference_id") % 2 == 0).write.parquet(src)
    jobs.inference_ledger_stream(spark, src, out, ck, log.schema)
    half = files.read_version(spark, out).agg(F.sum("total_inferences")).first()[0]
    log.where(F.col("inference_id") % 2 == 1).write.mode("append").parquet(src)
    whole = log.agg(F.sum("num_inferences")).first()[0]

    write = files.write_version

    def stops(df, path, version, keep=2):
        # The data are there, the mark that completes the version is not.
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").mode("overwrite").parquet(f"{path}/version={version}")
        raise RuntimeError("stopped")

    monkeypatch.setattr(files, "write_version", stops)
    with pytest.raises(Exception, match="stopped"):
        jobs.inference_ledger_stream(spark, src, out, ck, log.schema)
    assert files.read_version(spark, out).agg(F.sum("total_inferences")).first()[0] == half
    monkeypatch.setattr(files, "write_version", write)
    jobs.inference_ledger_stream(spark, src, out, ck, log.schema)
    assert files.read_version(spark, out).agg(F.sum("total_inferences")).first()[0] == whole > half
    assert schema  # the log's own schema is used


def test_a_ledger_run_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, "india"), (2, "japan")], "id long, country string")
    path = str(tmp_path / "ledger")
    files.ledger_append(rows, path, "a")
    files.ledger_append(rows, path, "b")
    files.ledger_append(rows.where("id = 1"), path, "b")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("run", "id", "country").collect()) == [
        ("a", 1, "india"), ("a", 2, "japan"), ("b", 1, "india")]


def test_versions_are_read_when_complete_and_old_ones_go(spark, tmp_path):
    path = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        files.read_version(spark, path)
    for v in range(4):
        files.write_version(spark.range(v + 1), path, v)
    assert files.read_version(spark, path).count() == 4
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["version=2", "version=3"]


def test_prefix_minimum_and_rank_of_a_group_over_many_partitions(spark):
    rows = [("big" if i % 10 else "small", i * 7919 % 1009, float(i * 31 % 97)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, x long, v double").repartition(5)
    got = {(r["g"], r["x"]): r["b"] for r in prefix_min(df, "g", F.col("x").desc(), "v", "b", 6).collect()}
    for g in ("big", "small"):
        best = None
        for x, v in sorted(((x, v) for h, x, v in rows if h == g), reverse=True):
            assert got[g, x] == best
            best = v if best is None else min(best, v)
    ranks = {(r["g"], r["x"]): r["rank"] for r in grouped_row_number(df, "g", [F.col("x")], num_partitions=6).collect()}
    for g in ("big", "small"):
        assert [ranks[g, x] for x in sorted(x for h, x, _ in rows if h == g)] == list(range(1, 1 + sum(h == g for h, _, _ in rows)))


def test_frontier_by_hand(spark):
    rows = [(i, "p" if i % 3 else "q", float(i * 13 % 17), float(i * 7 % 23), float(i * 5 % 11)) for i in range(200)]
    points = spark.createDataFrame(rows, "shipment_id long, package_type string, service_level double, carbon_gco2 double, cost double")
    for group in ("package_type", None):
        for dim, at in (("carbon_gco2", 3), ("cost", 4)):
            want = set()
            for r in rows:
                same = [o for o in rows if group is None or o[1] == r[1]]
                if all(o[at] > r[at] for o in same if o[2] > r[2]) and r[at] == min(o[at] for o in same if o[2] == r[2]):
                    want.add(r[0])
            assert {r["shipment_id"] for r in frontier.frontier_points(points, group, dim=dim).collect()} == want
