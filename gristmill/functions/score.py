"""Five scores of a listing, their weighted sum and tier, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .parse import paid_pair
from .text import contains_any, engagement, text_list

# Weights, bounds and vocabularies of the scores.
WEIGHTS = {"pay": 0.30, "flexibility": 0.25, "low_responsibility": 0.20, "tech_match": 0.15, "company_quality": 0.10}
PAY_STEPS = ((90000, 1.0), (75000, 0.8), (60000, 0.6), (50000, 0.4), (40000, 0.2))
TIERS = ((0.70, "top"), (0.60, "high"), (0.50, "medium"))
HIGH_VALUE = (
    "aws", "gcp", "azure", "databricks", "snowflake", "dbt", "terraform", "apache airflow", "dagster", "prefect", "apache spark", "pyspark", "apache kafka", "apache flink", "python", "sql", "scala",
    "docker", "kubernetes", "ci/cd", "gitlab", "github actions", "bigquery", "redshift", "looker", "tableau", "dataiku", "clickhouse", "elasticsearch",
)
LEGACY = ("talend", "informatica", "ssis", "ssrs", "msbi", "cobol", "sas", "oracle forms", "crystal reports", "qlikview")
HEAVY_TITLE = ("lead", "architect", "manager", "head", "director", "chef de projet", "tech lead", "principal")
LIGHT_TITLE = ("junior", "support", "analyst", "analytics", "consultant")
TEAM_WORDS = ("manage a team", "lead a team", "mentor", "line management", "gérer une équipe", "management d'équipe")
ALERT_WORDS = ("on-call", "production incidents", "astreinte", "incident", "pager")


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def _step(when: Column, value: float) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), value).otherwise(0.0)


def pay_score() -> Column:
    pair = paid_pair(F.col("salary"))
    mean, out = (pair["low"] + pair["high"]) / 2, F.when(pair["low"] == 0, 0.3)
    for bound, value in PAY_STEPS:
        out = out.when(mean >= bound, value)
    return out.otherwise(0.1)


def flexibility_score() -> Column:
    place = _low("workplace_type")
    has_contract = F.array_contains(F.coalesce("contract_types", F.array().cast("array<string>")), "contract")
    return F.least(F.lit(0.5) + F.when(place == "remote", 0.3).when(place == "hybrid", 0.15).otherwise(0.0) + _step(has_contract, 0.2) + _step(contains_any(_low("contract_duration"), ("month", "mois")), 0.1), F.lit(1.0))


def low_responsibility_score() -> Column:
    words, level, role, text = _words(_low("title")), _low("seniority_level"), _low("role_category"), _low("description_text")
    return F.greatest(
        F.lit(0.5) - _step(F.arrays_overlap(words, text_list(HEAVY_TITLE)), 0.25) + _step(F.arrays_overlap(words, text_list(LIGHT_TITLE)), 0.15)
        + F.when(level.isin("lead", "manager"), -0.2).when(level == "senior", -0.05).when(level.isin("entry", "junior"), 0.1).otherwise(0.0)
        + F.when(role == "product_manager", -0.15).when(role == "data_analyst", 0.1).otherwise(0.0)
        - _step(contains_any(text, TEAM_WORDS), 0.2) - _step(contains_any(text, ALERT_WORDS), 0.1),
        F.lit(0.0),
    )


def tech_score() -> Column:
    listed = F.transform(F.coalesce("technologies", F.array().cast("array<string>")), lambda t: F.lower(t))
    have = F.when(F.size(listed) > 0, listed).otherwise(_words(_low("description_text")))
    count = lambda words: F.size(F.array_intersect(have, text_list(words)))
    high, old = count(HIGH_VALUE), count(LEGACY)
    return F.greatest(F.least((high - old * 0.5) / F.greatest(high + old, F.lit(4)) + 0.5, F.lit(1.0)), F.lit(0.0))


def company_score(dim: str | None = None) -> Column:
    """`dim`: a struct column with name, org_type, stock_symbol and latest_funding_amount_usd; without it only the listing speaks."""
    of = lambda f: F.col(f"{dim}.{f}") if dim else F.lit(None)
    told = _low("engagement_type")
    name = F.coalesce(F.nullif(of("name").cast("string"), F.lit("")), F.col("company"))
    kind = F.when(told.isin("direct", "consulting"), told).otherwise(engagement(name, F.col("description_text")))
    org = F.lower(F.coalesce(of("org_type").cast("string"), F.lit("")))
    known = (F.coalesce(of("stock_symbol").cast("string"), F.lit("")) != "") | F.coalesce(of("latest_funding_amount_usd").cast("double") > 50_000_000, F.lit(False))
    score = F.lit(0.5) + _step(kind == "direct", 0.2) - _step(_low("posting_company_type") == "esn", 0.05) + F.when(org == "enterprise", 0.1).when(org == "consulting_firm", -0.1).otherwise(0.0) + _step(known, 0.05)
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))


def tier(score: Column) -> Column:
    out = None
    for bound, name in TIERS:
        out = F.when(score >= bound, name) if out is None else out.when(score >= bound, name)
    return out.otherwise("low")


def scored(jobs: DataFrame, dim: str | None = None) -> DataFrame:
    """`jobs` with scores, overall_score (three places) and recommendation_tier computed anew."""
    parts = {"pay": pay_score(), "flexibility": flexibility_score(), "low_responsibility": low_responsibility_score(), "tech_match": tech_score(), "company_quality": company_score(dim)}
    df = jobs.withColumn("scores", F.struct(*[e.cast("double").alias(n) for n, e in parts.items()]))
    total = sum((F.col(f"scores.{n}") * w for n, w in WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("overall_score", F.round(total, 3)).withColumn("recommendation_tier", tier(F.col("overall_score")))
