"""Queries over inline tables against their SQL, and parts that no query shows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gristmill.__main__ import settings
from gristmill.operators import enrich, silver
from gristmill.plans import parity
from gristmill.sources import boards, files

INLINE = sorted(k for k, sql in parity.SQL.items() if "(VALUES" in sql and not any(f" {t} " in f"{sql} " for t in ("jobs", "raw_faruse", "dim_company", "documents", "s", "events", "run_manifest")))


def plain(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", INLINE)
def test_inline(spark, name):
    df = parity.QUERIES[name](spark, "/nowhere")
    got = duckdb.sql("SET TimeZone='UTC'") or duckdb.sql(parity.SQL[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert plain(tuple(r[c] for c in got.columns) for r in df.collect()) == plain(got.fetchall())


def test_there_are_many():
    assert len(INLINE) > 35


def test_pages_without_anything(spark):
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "<p>unclosed <b>tags"), (4, "</div></div><h2>x")], "page int, html string")
    for reader in (boards.freework, boards.hellowork, boards.englishjobs, boards.datasciencejobs):
        assert reader(empty).count() == 0
    assert [r[0] for r in empty.select(boards.page_total(F.col("html"))).collect()] == [1] * 4 and [r[0] for r in empty.select(boards.button_pages(F.col("html"))).collect()] == [1] * 4


def test_migration(spark):
    rows = [
        ("1", "b", "Acme", ("ACME ", "private", None), "2026-01-01 00:00:00"), ("2", "b", "acme", ("Acme", None, "acme.com"), "2026-02-01 00:00:00"), ("3", "b", None, (None, "public", None), None), ("4", "c", "Acme", None, None),
    ]
    jobs = spark.createDataFrame(rows, "id string, source_board string, company string, company_info struct<name:string,org_type:string,homepage_url:string>, last_seen_at string").withColumn("last_seen_at", F.to_timestamp("last_seen_at"))
    full = jobs.withColumn("company_info", F.struct("company_info.*", *[F.lit(None).cast(t).alias(c) for c, t in silver.COMPANY.items() if c in ("industry", "size_employees", "year_founded", "hq_country", "stock_symbol", "stock_exchange", "latest_funding_type", "latest_funding_amount_usd")]))
    fact, firms = silver.migrate_company_info(full)
    assert "company_info" not in fact.columns and {r["id"]: r["company_id"] is None for r in fact.collect()} == {"1": False, "2": False, "3": True, "4": False}
    assert {(r["source_board"], r["name"], r["display_name"], r["org_type"], r["homepage_url"]) for r in firms.collect()} == {("b", "acme", "Acme", "private", "acme.com"), ("c", "acme", "Acme", None, None)}
    again, none = silver.migrate_company_info(fact)
    assert again.count() == 4 and none.count() == 0


def test_first_row_of_a_key(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, "a"), (2, None, "x")], "k int, at int, v string")
    assert {(r["k"], r["v"]) for r in silver.first_row(df, ["k"], [F.col("at")]).collect()} == {(1, "a"), (2, "x")}


def test_rate_and_waits():
    now, slept = [0.0], []

    def sleep(x):
        slept.append(round(x, 3))
        now[0] += x

    calls = []
    client = enrich.patient(lambda r: calls.append(now[0]) or r, enrich.Patience(per_minute=60), clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        client({})
    assert calls == [0.0, 1.0, 2.0]

    def busy(r):
        raise enrich.Refused(429, after=7)

    slept.clear()
    with pytest.raises(enrich.Refused):
        enrich.patient(busy, enrich.Patience(per_minute=1e9), clock=lambda: now[0], sleep=sleep)({})
    assert slept == [7, 7]


def test_settings_chain():
    assert settings({"root": "a"}, {"GRISTMILL_RUN_ID": "r", "GRISTMILL_ROOT": "b"}, {"now": "n", "run_id": "z"}) == {"root": "a", "run_id": "r", "now": "n"}
    with pytest.raises(SystemExit):
        settings({}, {}, {})


def test_store_keeps_what_is_committed(spark, tmp_path):
    store = files.Store(spark, str(tmp_path))
    assert store.version("t") == 0
    for k in range(3):
        store.write("t", spark.range(k + 1))
    (tmp_path / "t" / "v=9").mkdir()
    assert store.version("t") == 3 and store.read("t").count() == 3
    store.forget("t")
    assert store.versions("t") == [2, 3]
