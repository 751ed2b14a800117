"""Lineage, gates, dimensions and views, against a model of the rules in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import gold, silver
from gristmill.schema import CANONICAL, LINEAGE, conform

FIELDS = {**CANONICAL, **LINEAGE}


def jobs(spark, rows):
    names = ["id", "source_board", "title", "description_text", "description_language", "technologies", "engagement_type", "overall_score", "company_id", "first_seen_run", "first_seen_at", "last_seen_run", "last_seen_at", "is_active", "enriched_at", "enrichment_version"]
    kinds = ", ".join(f"{n} {'string' if n.endswith('_at') else FIELDS[n]}" for n in names)
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds)
    return conform(df, FIELDS)


def job(key, **given):
    base = {"id": key, "source_board": "freework", "title": "Engineer", "description_text": "text", "description_language": "en", "technologies": ["Python"], "engagement_type": "consulting", "overall_score": None, "company_id": "c", "is_active": True, "enrichment_version": 2}
    return {**base, **given}


def seen(key, first, last, **given):
    return job(key, first_seen_run=first, first_seen_at="2026-08-01 10:00:00", last_seen_run=last, last_seen_at=f"2026-08-0{last[-1]} 12:00:00", **given)


def test_upsert_keeps_and_replaces(spark):
    empty = jobs(spark, [])
    one = silver.upsert(empty, jobs(spark, [job("j1")]), "run1", "2026-08-01 00:00:00")
    r = one.first()
    assert (r["first_seen_run"], r["last_seen_run"], r["is_active"], r["enriched_at"], r["enrichment_version"]) == ("run1", "run1", True, None, silver.ENRICHMENT_VERSION)
    marked = silver.mark_enriched(one, "2026-08-01 01:00:00")
    two = silver.upsert(marked, jobs(spark, [job("j1", title="Other", technologies=["Rust"])]), "run2", "2026-08-02 00:00:00")
    r = two.first()
    assert (r["first_seen_run"], r["last_seen_run"], r["title"], r["technologies"]) == ("run1", "run2", "Engineer", ["Python"]) and r["enriched_at"] is not None
    full = silver.upsert(marked, jobs(spark, [job("j1", title="Other")]), "run2", "2026-08-02 00:00:00", full_replace=True).first()
    assert (full["first_seen_run"], full["title"], full["enriched_at"]) == ("run1", "Other", None)
    assert silver.upsert(empty, empty, "r", "2026-01-01").count() == 0


def test_upserts_match_a_model(spark):
    rng = random.Random(4)
    state, model = jobs(spark, []), {}
    for n in range(3):
        batch = [job(f"j{rng.randrange(8)}", title=f"t{n}") for _ in range(6)]
        state = silver.deactivate(silver.upsert(state, jobs(spark, batch), f"run{n}", f"2026-08-0{n + 1} 00:00:00"), f"run{n}")
        for b in batch:
            model.setdefault(b["id"], [f"run{n}", None, b["title"], True])[1] = f"run{n}"
        for v in model.values():
            v[3] = v[1] == f"run{n}"
        state = spark.createDataFrame(state.collect(), state.schema)
    assert {r["id"]: [r["first_seen_run"], r["last_seen_run"], r["title"], r["is_active"]] for r in state.collect()} == model


@pytest.mark.parametrize(
    "stage,rows,want",
    [
        ("translate", [job("a"), job("b", description_language="fr"), job("c", description_language="fr", description_text="  "), job("d", description_language="fr", description_text=None), job("e", description_language="fr", is_active=False)], {"b"}),
        ("tech", [job("a"), job("b", technologies=[]), job("c", technologies=None)], {"c"}),
        ("classify", [job("a", engagement_type=None), job("b", engagement_type=None, source_board="hiringcafe"), job("c")], {"a"}),
        ("score", [job("a"), job("b", overall_score=0.5)], {"a"}),
    ],
)
def test_gates(spark, stage, rows, want):
    assert {r["id"] for r in silver.gate(jobs(spark, rows), stage).collect()} == want


def test_reset_and_mark(spark):
    old = jobs(spark, [job("a", enrichment_version=1, overall_score=0.7), job("b", overall_score=0.7), job("c", enrichment_version=1, source_board="hiringcafe", engagement_type="direct")])
    by = lambda df, c: {r["id"]: r[c] for r in df.collect()}
    assert by(silver.reset_stale(old, "score"), "overall_score") == {"a": None, "b": 0.7, "c": None}
    assert by(silver.reset_stale(old, "translate"), "description_language") == {"a": "fr", "b": "en", "c": "fr"}
    assert by(silver.reset_stale(old, "classify"), "engagement_type") == {"a": None, "b": "consulting", "c": "direct"}
    assert by(silver.reset_stale(old, "tech"), "technologies") == {"a": None, "b": ["Python"], "c": None}
    assert by(silver.mark_enriched(old, "2026-08-01"), "overall_score") == {"a": None, "b": None, "c": None}
    assert by(silver.mark_enriched(old, "2026-08-01", keep_scores=True), "overall_score")["a"] == 0.7


def test_views(spark):
    df = jobs(spark, [seen("j1", "run1", "run1", is_active=False, overall_score=0.9), seen("j2", "run1", "run2", overall_score=0.6), seen("j3", "run2", "run2", overall_score=0.6)])
    dim = spark.createDataFrame([("c", "enterprise", None)], "company_id string, org_type string, stock_symbol string")
    assert gold.run_name(df) == "run2" and gold.run_name(df, before="run2") == "run1"
    assert [r["id"] for r in gold.top(gold.ranked(df, dim)).collect()] == ["j2", "j3"]
    assert {r["id"] for r in gold.new_in_run(df, "run2").collect()} == {"j3"}
    assert {r["id"] for r in gold.gone_since(df, "run1").collect()} == {"j1"} and gold.gone_since(df, None).count() == 0
    assert {r["id"]: r["days_active"] for r in gold.history(df).collect()} == {"j1": 0, "j2": 1, "j3": 1}
    assert gold.totals(df).first().asDict() == {"total": 3, "active": 2, "pending": 2}
    assert gold.totals(df.limit(0)).first()["total"] == 0 and gold.run_name(df.limit(0)) is None


def test_weekly_matches_the_interval_join(spark):
    rng = random.Random(1)
    rows = []
    for k in range(120):
        a = rng.choice([None, *range(60)])
        b = None if rng.random() < 0.1 else (a or 0) + rng.randrange(30)
        at = lambda d: None if d is None else f"2026-{1 + d // 28:02d}-{1 + d % 28:02d} 0{k % 9}:00:00"
        rows.append(job(f"j{k}", first_seen_at=at(a), last_seen_at=at(b), is_active=rng.random() < 0.3))
    df = jobs(spark, rows)
    df.createOrReplaceTempView("jobs_w")
    want = spark.sql("""with w as (select to_date(date_trunc('week', first_seen_at)) d from jobs_w where first_seen_at is not null union select to_date(date_trunc('week', last_seen_at)) from jobs_w where last_seen_at is not null)
      select d, count(*) n from w join jobs_w on to_date(first_seen_at) <= date_add(d, 6) and (is_active or to_date(last_seen_at) >= d) group by d""")
    assert {tuple(r) for r in gold.weekly(df).collect()} == {tuple(r) for r in want.collect()}


def test_companies(spark):
    dim = spark.createDataFrame([("a", "x", 5, "FR"), ("b", "y", None, None)], "company_id string, name string, size_employees bigint, hq_country string")
    new = spark.createDataFrame([("a", 9, None), ("c", 1, "DE")], "company_id string, size_employees bigint, hq_country string")
    from gristmill.schema import COMPANY

    got = {r["company_id"]: (r["size_employees"], r["hq_country"]) for r in silver.upsert_companies(conform(dim, COMPANY), new).collect()}
    assert got == {"a": (9, "FR"), "b": (None, None), "c": (1, "DE")}


def test_newest_value_of_each_field(spark):
    schema = "id string, source_board string, company_id string, last_seen_at timestamp, company_info " + CANONICAL["company_info"]

    info = lambda **k: tuple(k.get(f) for f in ("name", "industry", "size_employees", "year_founded", "hq_country", "org_type", "stock_symbol", "stock_exchange", "latest_funding_type", "latest_funding_amount_usd", "homepage_url"))
    import datetime as dt

    rows = spark.createDataFrame([("1", "b", "c", dt.datetime(2026, 1, 2), info(org_type="public", homepage_url="acme.com")), ("2", "b", "c", dt.datetime(2026, 1, 1), info(org_type="private", size_employees=200)), ("3", "b", "c", None, info(org_type="startup", hq_country="FR"))], schema)
    r = silver.merge_companies(rows).first()
    assert (r["org_type"], r["size_employees"], r["homepage_url"], r["hq_country"]) == ("public", 200, "acme.com", "FR")


def test_dim_date(spark):
    d = jobs(spark, []).select("id").unionByName(spark.createDataFrame([("1",)], "id string")).withColumn("date_posted", F.explode(F.array(*[F.lit(x) for x in ("2026-08-01", "2026-07-01", "yesterday", "2026-8-1", "2026-08-01T10:00")])))
    assert {(r["date_id"], r["quarter"], r["year"]) for r in silver.dim_date(d).collect()} == {("2026-08-01", 3, 2026), ("2026-07-01", 3, 2026)}
