import json

import pytest

from gristmill.operators.enrich import apply_client
from gristmill.operators.silver import upsert
from gristmill.schema import CANONICAL, COMPANY, LINEAGE, conform
from gristmill.sources.files import Store, adopt_ids, nested_export, ranked_export, read_run, write_json_array, write_snapshot
from gristmill.streaming.upserts import stream_snapshots, upsert_stream

FIELDS = {**CANONICAL, **LINEAGE}


def listings(spark, ids, **kw):
    return conform(spark.createDataFrame([(i, "wwr", f"t{i}") for i in ids], "id string, source_board string, title string"))


def test_snapshots_and_runs(spark, tmp_path):
    root = str(tmp_path)
    write_snapshot(listings(spark, ["1", "2"]), root, "wwr", "run1", "2026-08-01T000000Z")
    assert {r["id"] for r in read_run(spark, root, "run1").collect()} == {"1", "2"}
    with pytest.raises(FileNotFoundError):
        read_run(spark, root, "run2")
    with pytest.raises(Exception):
        write_snapshot(listings(spark, ["1"]), root, "wwr", "run1", "2026-08-01T000000Z")


def test_exports(spark, tmp_path):
    from pyspark.sql import functions as F

    jobs = conform(listings(spark, ["1"]), FIELDS).withColumn("is_active", F.lit(True)).withColumn("company_id", F.lit("c"))
    dim = conform(spark.createDataFrame([("c", "Acme")], "company_id string, display_name string"), COMPANY)
    flat = ranked_export(jobs, dim).first()
    assert len(flat) == 32 and flat["technologies"] == "" and flat["company_industry"] == ""
    nested = nested_export(jobs, dim)
    write_json_array(nested, str(tmp_path / "x.json"))
    data = json.loads((tmp_path / "x.json").read_text())
    assert data[0]["company_info"]["industry"] == [] and data[0]["company_info"]["name"] == "Acme" and data[0]["salary"] is None
    csv = spark.createDataFrame([("https://a/",), ("https://b",)], "apply_url string")
    known = spark.createDataFrame([("7", "https://a")], "id string, apply_url string")
    assert sorted(r["id"][:4] for r in adopt_ids(csv, known).collect()) == ["7", "http"]


def test_enrichment_leaves_failures_pending(spark):
    def client():
        def call(r):
            if r["title"] == "t2":
                raise ValueError
            return {"text": r["title"].upper()}

        return call

    got = apply_client(listings(spark, ["1", "2"]), client, ("id",), {"title": 3000}, {"text": "string"})
    assert [tuple(r) for r in got.collect()] == [("1", "T1")]


def test_stream_of_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write("jobs", conform(listings(spark, []), FIELDS))
    listings(spark, ["1", "2"]).write.json(str(tmp_path / "in" / "a"))
    src = stream_snapshots(spark, str(tmp_path / "in" / "*"))
    q = upsert_stream(src, store, "jobs", str(tmp_path / "ck"), "2026-08-01 00:00:00")
    q.awaitTermination(120)
    assert {r["id"] for r in store.read("jobs").collect()} == {"1", "2"}
    assert upsert(store.read("jobs"), listings(spark, ["1"]), "r", "2026-08-02").count() == 2


def test_pipeline_of_two_runs(spark, tmp_path):
    from gristmill import pipeline

    root = str(tmp_path)
    store = Store(spark, root + "/warehouse")
    write_snapshot(listings(spark, ["1", "2", "2"]), root, "wwr", "run1", "2026-08-01T000000Z")
    pipeline.run(spark, store, pipeline.Config(root, "run1", "2026-08-01 06:00:00"))
    write_snapshot(listings(spark, ["2", "3"]), root, "wwr", "run2", "2026-08-08T000000Z")
    views = pipeline.run(spark, store, pipeline.Config(root, "run2", "2026-08-08 06:00:00"))
    ids = lambda name: {r["id"] for r in views[name].collect()}
    assert ids("ranked") == {"2", "3"} and ids("new_this_run") == {"3"} and ids("disappeared_this_run") == {"1"}
    assert {r["active_jobs"] for r in spark.sql("select active_jobs from gold_weekly_snapshot").collect()} == {2}
    assert spark.read.option("header", True).csv(f"{root}/exports/jobs_ranked").count() == 2
