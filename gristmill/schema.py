"""The canonical listing schema, its value lists, and fitting of any frame to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SALARY = "struct<min_annual_eur:double,max_annual_eur:double,currency_original:string,frequency_original:string,is_disclosed:boolean>"
COMPANY_INFO = "struct<name:string,industry:array<string>,size_employees:bigint,year_founded:bigint,hq_country:string,org_type:string,stock_symbol:string,stock_exchange:string,latest_funding_type:string,latest_funding_amount_usd:bigint,homepage_url:string>"
SCORES = "struct<pay:double,flexibility:double,low_responsibility:double,tech_match:double,company_quality:double>"

#: Fields of a canonical listing, in order.
CANONICAL = {
    "id": "string", "source_board": "string", "source_url": "string", "title": "string", "company": "string", "apply_url": "string",
    "location_raw": "string", "workplace_type": "string", "date_posted": "string", "salary": SALARY, "contract_types": "array<string>",
    "seniority_level": "string", "role_category": "string", "years_experience_min": "bigint", "technologies": "array<string>",
    "competencies": "array<string>", "description_text": "string", "description_language": "string", "company_info": COMPANY_INFO,
    "engagement_type": "string", "posting_company_type": "string", "end_client_name": "string", "end_client_sector": "string",
    "contract_duration": "string", "views": "bigint", "applications": "bigint", "is_expired": "boolean", "scores": SCORES,
    "overall_score": "double", "recommendation_tier": "string",
}
LINEAGE = {
    "company_id": "string", "first_seen_run": "string", "first_seen_at": "timestamp", "last_seen_run": "string", "last_seen_at": "timestamp",
    "is_active": "boolean", "enriched_at": "timestamp", "enrichment_version": "int", "created_at": "timestamp", "updated_at": "timestamp",
}
COMPANY = {
    "company_id": "string", "name": "string", "display_name": "string", "source_board": "string", "industry": "array<string>",
    "size_employees": "bigint", "year_founded": "bigint", "hq_country": "string", "org_type": "string", "stock_symbol": "string",
    "stock_exchange": "string", "latest_funding_type": "string", "latest_funding_amount_usd": "bigint", "homepage_url": "string",
    "enriched_at": "timestamp", "enrichment_version": "int",
}
# The boards and the value lists of the enumerated fields.
BOARDS = ("freework", "hiringcafe", "hellowork", "englishjobs", "faruse", "wwr", "remoteok", "datasciencejobs")
DOMAINS = {
    "workplace_type": ("remote", "hybrid", "onsite"),
    "contract_types": ("full_time", "part_time", "contract", "internship", "temporary", "seasonal", "volunteer"),
    "seniority_level": ("entry", "junior", "mid", "senior", "lead", "manager"),
    "engagement_type": ("direct", "consulting", "unknown"),
    "org_type": ("public", "private", "startup", "consulting_firm", "enterprise", "unknown"),
}


def conform(df: DataFrame, fields: dict[str, str] | None = None, keep_extra: bool = True) -> DataFrame:
    """`df` with every field of the schema, missing ones as typed NULLs; extra columns follow if kept."""
    fields = fields or CANONICAL
    have = set(df.columns)
    cols: list[Column] = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields.items()]
    return df.select(*cols, *([c for c in df.columns if c not in fields] if keep_extra else []))


def struct_type(fields: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in fields.items()))


def defaults(board: str) -> dict[str, Column]:
    """What a listing of a board has before its record is read."""
    text, none = F.lit(""), F.lit(None)
    return {
        "id": text, "source_board": F.lit(board), "source_url": none, "title": text, "company": text, "apply_url": none, "location_raw": text, "workplace_type": none, "date_posted": none,
        "salary": undisclosed(), "contract_types": F.array().cast("array<string>"), "seniority_level": none, "role_category": none, "years_experience_min": none,
        "technologies": F.array().cast("array<string>"), "competencies": F.array().cast("array<string>"), "description_text": text, "description_language": F.lit("en"),
        "company_info": company_info(), "engagement_type": F.lit("unknown"), "posting_company_type": none, "end_client_name": none, "end_client_sector": none, "contract_duration": none,
        "views": none, "applications": none, "is_expired": F.lit(False), "scores": none, "overall_score": none, "recommendation_tier": none,
    }


def listing(df: DataFrame, board: str, **given: Column) -> DataFrame:
    """Canonical listings of a board: the given columns over its defaults."""
    cols = {**defaults(board), **given}
    return df.select(*[cols[c].cast(t).alias(c) for c, t in CANONICAL.items()])


def salary(low: Column, high: Column, currency: Column | str = "EUR", frequency: Column | str = "yearly", disclosed: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    disclosed = low.isNotNull() | high.isNotNull() if disclosed is None else disclosed
    return F.struct(low.cast("double").alias("min_annual_eur"), high.cast("double").alias("max_annual_eur"), lit(currency).alias("currency_original"), lit(frequency).alias("frequency_original"), disclosed.alias("is_disclosed"))


def undisclosed(currency: str = "EUR") -> Column:
    return salary(F.lit(None).cast("double"), F.lit(None).cast("double"), currency, "yearly", F.lit(False))


def company_info(name: Column | None = None, **given: Column) -> Column:
    """The company struct; what is not given is empty, the organisation type unknown."""
    base = {"name": F.lit("") if name is None else F.coalesce(name, F.lit("")), "industry": F.array().cast("array<string>"), "org_type": F.lit("unknown")}
    fields = struct_type({"x": COMPANY_INFO})["x"].dataType.fields
    return F.struct(*[({**base, **given}.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in fields])
