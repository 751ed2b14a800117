import datetime as dt

from pyspark.sql import functions as F

from gristmill.functions import parse, text
from gristmill.functions.score import scored
from gristmill.operators import tailor
from gristmill.schema import CANONICAL, conform
from gristmill.sources import html_text, normalize


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_pay_forms(spark):
    pay = lambda f, v: (lambda r: r and (r["min_annual_eur"], r["max_annual_eur"], r["is_disclosed"]))(one(spark, v, f))
    assert pay(lambda c: parse.pay_or_rate(c, F.lit(None)), "40k-75k €") == (40000, 75000, True)
    assert pay(lambda c: parse.pay_or_rate(F.lit(None), c), "450-650 €") == (99000, 143000, True)
    assert pay(lambda c: parse.pay_or_rate(c, F.lit(None)), "on request") == (None, None, False)
    assert pay(parse.range_per_period, "5500-7200 USD/month") == (60720, 79488, True)
    assert pay(parse.range_per_period, "5500-7200 GBP/month") == (None, None, False)
    assert pay(parse.euro_figures, "45 000 € - 60 000 €") == (45000, 60000, True) and pay(parse.euro_figures, "n/a") is None
    assert pay(parse.code_and_range, "EUR 75000 - EUR 90000") == (75000, 90000, True) and pay(parse.code_and_range, "$100000 - $200000") == (92000, 184000, True)
    assert pay(parse.signed_amounts, "from $80,000 to $100k a year") == (73600, 92000, True) and pay(parse.signed_amounts, "$50 per hour") == (None, None, False)
    assert pay(parse.signed_amounts, "£50K") == (58500, None, True) and pay(parse.signed_amounts, None) == (None, None, False)


def test_dates(spark):
    now = F.lit("2026-08-10 05:00:00").cast("timestamp")
    french = lambda v: one(spark, v, lambda c: parse.french_posted(c, now))
    assert [french(v) for v in ("il y a 2 jours", "il y a 7 heures", "Aujourd'hui", "Hier", "il y a 1 mois", "04/08/2026", "", "soon")] == ["2026-08-08", "2026-08-09", "2026-08-10", "2026-08-09", "2026-07-11", "2026-08-04", None, None]
    day = lambda v: one(spark, v, lambda c: parse.month_day(c, F.lit(dt.date(2026, 8, 10))))
    assert [day(v) for v in ("August 4", "Dec 24", "February 30", "soon", None)] == ["2026-08-04", "2025-12-24", None, None, None]
    assert one(spark, "8/4/2026", parse.month_first) == "2026-08-04" and one(spark, "Tue, 04 Aug 2026 23:30:00 -0700", parse.mail_date) == "2026-08-04"
    assert one(spark, "yesterday", parse.iso_guarded) is None


def test_text(spark):
    assert one(spark, "  Acme  Consulting ", text.company_name_key) == "acme consulting"
    assert one(spark, "Acme: Data: Engineer", text.company_of_title) == "Acme" and one(spark, "Acme: ", text.company_of_title) is None
    assert one(spark, "https://x/y/z//", text.url_slug) == "z" and one(spark, None, text.url_slug) == ""
    assert one(spark, "Stage ou CDI, full-time", text.contracts) == ["internship", "full_time"] and one(spark, "éstage", text.contracts) == []
    assert one(spark, "We use SQLite and Airflow", lambda c: text.relevance(c, ["SQL", "Apache Airflow"])) == 0.5
    assert one(spark, "Hybrid remote", text.workplace) == "remote" and one(spark, "Télétravail partiel", text.workplace_fr) == "hybrid"
    assert one(spark, "## Technologies\n- Python\n- n/a\n## Other\n- x\n## Competencies\n- Lead", text.jd_terms) == ["Python", "Lead"]
    assert abs(one(spark, "Reduced cost by 40% across enterprise", text.impact) - 0.75) < 1e-9
    assert one(spark, "Mission chez notre client", lambda c: text.engagement(F.lit("Acme"), c)) == "consulting" and one(spark, None, lambda c: text.engagement(c, c)) == "direct"
    assert one(spark, ["Data", "payroll"], text.has_required_tag, "array<string>") is False and one(spark, None, text.has_required_tag, "array<string>") is False


def test_html(spark):
    assert html_text.strip_tags("<p>A &amp; B</p><b> c</b>") == "A & B c" and html_text.strip_tags(None) == ""
    page = '<script type="application/ld+json">[{"@type":"X"},{"@type":"JobPosting","description":"<p>Hi <b>you</b></p>"}]</script>'
    assert one(spark, page, html_text.job_posting_text) == "Hi you" and one(spark, "<p>", html_text.job_posting_text) is None
    assert one(spark, page.replace("description", "datePosted"), lambda c: html_text.job_posting_field(c, F.lit("datePosted"))) == "Hi you"


def test_scores(spark):
    row = {"id": "1", "title": "Lead Engineer", "company": "Acme", "engagement_type": "direct", "technologies": ["Python", "dbt"]}
    df = conform(spark.createDataFrame([tuple(row.values()), ("2", None, "Conseil X", None, None)], "id string, title string, company string, engagement_type string, technologies array<string>"))
    got = {r["id"]: r for r in scored(df).collect()}
    assert (got["1"]["scores"]["pay"], got["1"]["scores"]["low_responsibility"], got["1"]["scores"]["tech_match"], got["1"]["scores"]["company_quality"]) == (0.3, 0.25, 1.0, 0.7)
    assert got["2"]["scores"]["company_quality"] == 0.5 and got["2"]["recommendation_tier"] == "low"


def test_boards(spark):
    raw = spark.createDataFrame([("u", "T", ["Contractor", "odd"], "40k-50k €", None)], "url string, title string, contract_types array<string>, pay string, engagement_type string")
    r = normalize.freework(raw).first()
    assert (r["id"], r["contract_types"], r["salary"]["min_annual_eur"], r["engagement_type"], r["company_info"]["org_type"], r["description_language"]) == ("u", ["contract", "full_time"], 40000, None, None, "fr")
    hit = spark.read.json(spark.sparkContext.parallelize(['{"objectID":"9","v5_processed_job_data":{"yearly_min_compensation":100000,"commitment":["Full Time"],"seniority_level":"Mid Level"},"job_information":{"title":"X"},"enriched_company_data":{"organization_type":"public","industries":["A"]}}']))
    r = normalize.hiringcafe(hit).first()
    assert (r["id"], r["salary"]["min_annual_eur"], r["contract_types"], r["seniority_level"], r["company_info"]["org_type"], r["engagement_type"]) == ("9", 92000, ["full_time"], "mid", "public", "direct")
    raw = spark.createDataFrame([("1", "Dev", ["Python", "junk"], 0, 100000, "2026-08-01T00:00", "<b>x</b>"), (None, None, None, None, None, None, None)], "id string, position string, tags array<string>, salary_min long, salary_max long, date string, description string")
    r = normalize.remoteok(raw).collect()
    assert len(r) == 1 and (r[0]["technologies"], r[0]["salary"]["min_annual_eur"], r[0]["salary"]["max_annual_eur"], r[0]["date_posted"], r[0]["description_text"]) == (["Python"], None, 92000, "2026-08-01", "x")
    raw = spark.createDataFrame([("https://w/acme-dev", "Acme: Dev", "pay $80k", "Tue, 04 Aug 2026 00:00:00 +0000", "Full-Time", "Product")], "link string, title string, description string, pubDate string, type string, category string")
    r = normalize.wwr(raw).first()
    assert (r["id"], r["company"], r["title"], r["contract_types"], r["role_category"], r["salary"]["min_annual_eur"]) == ("acme-dev", "Acme", "Dev", ["full_time"], "product_manager", 73600)
    raw = spark.createDataFrame([("1", "CDI", "45 000 € /mois")], "id string, contract string, salary string")
    assert normalize.hellowork(raw, F.current_timestamp()).first()["contract_types"] == ["full_time"]
    assert normalize.englishjobs(raw.select("id"), F.current_date()).first()["engagement_type"] == "direct"
    assert normalize.datasciencejobs(raw.select("id")).first()["source_board"] == "datasciencejobs"
    assert normalize.union_boards(normalize.datasciencejobs(raw), normalize.englishjobs(raw, F.current_date())).count() == 2
    assert set(normalize.faruse(raw.select("id")).columns) == set(CANONICAL)


def test_tailoring(spark):
    new = spark.createDataFrame([(0, 0, "wrote docs"), (0, 1, "reduced cost by 40%"), (0, 2, "led platform")], "role int, pos int, line string")
    master = spark.createDataFrame([(0, "reduced cost"), (0, "led a platform team")], "role int, line string")
    assert {r["line"] for r in tailor.keep_highlights(new, master, [], k=2).collect()} == {"reduced cost by 40%", "led platform"}
    assert tailor.keep_highlights(new, master, [], k=3).count() == 3
    rows = spark.createDataFrame([("k", "Python, k8s, pipeline monitoring, Fortran", "python, kubernetes", "python work", "monitoring pipelines daily")], "key string, tailored string, master_skills string, master_text string, advert string")
    assert {r["skill"]: r["verdict"] for r in tailor.audit_skills(rows).collect()} == {"pipeline monitoring": "advert", "fortran": "hard"}
    assert one(spark, "cut cost by 30% and by 7 days", lambda c: tailor.claimed_figures(c, F.lit("7 things"))) == ["30"]
