"""One select a board: raw records to canonical listings. Lookup tables are fixed values of the boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parse, text
from ..schema import DOMAINS, company_info, listing, undisclosed

# What the boards call things, and what they are called here.
FREEWORK = {
    "remote": {"remote": "remote", "hybrid": "hybrid", "onsite": "onsite", "": "onsite"},
    "contract": {"contractor": "contract", "fixed-term": "contract", "fixed term": "contract", "permanent": "full_time", "internship": "internship", "temporary": "temporary"},
    "seniority": {"junior": "junior", "intermediate": "mid", "senior": "senior", "lead": "lead", "architect": "lead", "manager": "manager"},
    "role": {"data_engineer": "data_engineer", "data_analyst": "data_analyst", "data_scientist": "data_scientist", "ml_engineer": "ml_engineer", "analytics_engineer": "analytics_engineer", "data_platform_engineer": "platform_engineer", "devops_data": "devops_engineer", "data_product_manager": "product_manager"},
    "company": {"startup": "startup", "enterprise": "enterprise", "consulting_firm": "consulting_firm", "public_company": "public", "private_company": "private"},
}
HIRINGCAFE = {
    "role": {"Data and Analytics": "data_engineer", "Software Development": "software_engineer", "Engineering": "platform_engineer", "Information Technology": "other", "Project and Program Management": "product_manager"},
    "workplace": {"Remote": "remote", "Hybrid": "hybrid", "Onsite": "onsite"},
    "contract": {"Full Time": "full_time", "Part Time": "part_time", "Contract": "contract", "Internship": "internship", "Temporary": "temporary", "Seasonal": "seasonal", "Volunteer": "volunteer"},
    "seniority": {"No Prior Experience Required": "entry", "Entry Level": "entry", "Mid Level": "mid", "Senior Level": "senior"},
    "org": {"Public": "public", "Private": "private"},
}
FARUSE = {
    "contract": {"Full-time": "full_time", "Part-time": "part_time", "Contract": "contract", "Internship": "internship", "Temporary": "temporary", "Volunteer": "volunteer"},
    "seniority": {"Internship": "entry", "Entry level": "entry", "Associate": "mid", "Mid-Senior level": "senior", "Director": "manager", "Executive": "manager"},
    "workplace": {"Remote": "remote", "Hybrid": "hybrid"},
}
WWR = {
    "contract": {"full-time": "full_time", "part-time": "part_time", "contract": "contract", "freelance": "contract", "internship": "internship", "volunteer": "volunteer"},
    "role": {"full-stack programming": "software_engineer", "back-end programming": "software_engineer", "front-end programming": "software_engineer", "devops and sysadmin": "devops_engineer", "data science": "data_scientist", "data analysis": "data_analyst", "machine learning": "ml_engineer", "product": "product_manager"},
}
HELLOWORK_CONTRACT = {"CDI": "full_time", "CDD": "temporary", "Stage": "internship", "Alternance": "internship", "Freelance": "contract", "Intérim": "temporary"}
DATASCIENCEJOBS = {
    "contract": {"Full Time": "full_time", "Part Time": "part_time", "Contract": "contract", "Internship": "internship", "Temporary": "temporary"},
    "seniority": {"entry": "entry", "junior": "junior", "mid": "mid", "senior": "senior", "lead": "lead", "manager": "manager"},
}



def company_type(raw: Column) -> Column:
    """The kind of a firm as research names it; unknown for anything else, NULL included."""
    return text.mapped(F.lower(raw), {k: k for k in DOMAINS["org_type"]}, "unknown")


_EMPTY = lambda: F.array().cast("array<string>")


def _c(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column of a raw record, a typed NULL where the record lacks it."""
    head = name.split(".")[0]
    if head not in df.columns:
        return F.lit(None).cast(kind)
    if "." in name and name.split(".")[1] not in df.select(f"{head}.*").columns:
        return F.lit(None).cast(kind)
    return F.col(name).cast(kind)


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(_c(df, name), F.lit(""))


def _one(value: Column) -> Column:
    return F.filter(F.array(value), lambda x: x.isNotNull())


def _nonempty(*lists: Column) -> Column:
    """The first list that has elements, else an empty one."""
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], _EMPTY())


def freework(raw: DataFrame) -> DataFrame:
    """Firm type and engagement stay NULL where nobody has looked yet; the translated text stands for the original if there is one."""
    col, arr = lambda n: _c(raw, n), lambda n: _c(raw, n, "array<string>")
    translated = F.nullif(col("description_en"), F.lit(""))
    kind, engagement = F.nullif(col("company_stats.company_type"), F.lit("")), F.nullif(F.lower(col("engagement_type")), F.lit(""))
    return listing(
        raw, "freework", id=_text(raw, "url"), source_url=col("url"), apply_url=col("url"), title=_text(raw, "title"), company=_text(raw, "company"), location_raw=_text(raw, "location"),
        workplace_type=text.mapped(F.lower(_text(raw, "remote_type")), FREEWORK["remote"]), date_posted=parse.month_first(col("date_posted")), salary=parse.pay_or_rate(col("pay"), col("rate")),
        contract_types=text.mapped_list(F.transform(arr("contract_types"), lambda x: F.lower(x)), FREEWORK["contract"], "full_time"),
        seniority_level=text.mapped(F.lower(col("seniority_level")), FREEWORK["seniority"]), role_category=text.mapped(F.lower(_text(raw, "role_category")), FREEWORK["role"], "other"),
        technologies=_nonempty(arr("extracted_technologies"), arr("skills")), competencies=_nonempty(arr("competencies")),
        description_text=F.coalesce(translated, _text(raw, "description")), description_language=F.when(translated.isNotNull(), "en").otherwise("fr"),
        company_info=company_info(_text(raw, "company"), org_type=text.mapped(kind, FREEWORK["company"]), size_employees=_c(raw, "company_stats.employee_count", "bigint"), stock_symbol=col("company_stats.stock_symbol")),
        engagement_type=F.when(engagement.isin("direct", "consulting"), engagement), posting_company_type=col("posting_company_type"), end_client_name=col("end_client_name"), end_client_sector=col("end_client_sector"), contract_duration=col("duration"),
    )


def hiringcafe(raw: DataFrame) -> DataFrame:
    """Three nested structs of a hit; every firm hires for itself."""
    p, j, c = "v5_processed_job_data.", "job_information.", "enriched_company_data."
    col = lambda n: _c(raw, n)
    currency, period = F.upper(F.coalesce(F.nullif(col(p + "listed_compensation_currency"), F.lit("")), F.lit("USD"))), F.lower(F.coalesce(F.nullif(col(p + "listed_compensation_frequency"), F.lit("")), F.lit("yearly")))
    name = F.coalesce(F.nullif(col(c + "name"), F.lit("")), F.nullif(col(p + "company_name"), F.lit("")), F.lit(""))
    return listing(
        raw, "hiringcafe", id=F.coalesce(F.nullif(col("objectID"), F.lit("")), col("id"), F.lit("")), title=_text(raw, j + "title"), company=F.coalesce(F.nullif(col(p + "company_name"), F.lit("")), col(c + "name"), F.lit("")), apply_url=col("apply_url"),
        location_raw=_text(raw, p + "formatted_workplace_location"), workplace_type=text.mapped(_text(raw, p + "workplace_type"), HIRINGCAFE["workplace"]), date_posted=parse.before_t(col(p + "estimated_publish_date")),
        salary=parse.dollars(_c(raw, p + "yearly_min_compensation", "double"), _c(raw, p + "yearly_max_compensation", "double"), False, currency, period),
        contract_types=text.mapped_list(_c(raw, p + "commitment", "array<string>"), HIRINGCAFE["contract"], "full_time"), seniority_level=text.mapped(_text(raw, p + "seniority_level"), HIRINGCAFE["seniority"]), role_category=text.mapped(_text(raw, p + "job_category"), HIRINGCAFE["role"], "other"),
        years_experience_min=_c(raw, p + "min_industry_and_role_yoe", "bigint"), technologies=F.coalesce(_c(raw, p + "technical_tools", "array<string>"), _EMPTY()), competencies=F.coalesce(_c(raw, p + "role_activities", "array<string>"), _EMPTY()), description_text=_text(raw, p + "requirements_summary"),
        company_info=company_info(name, industry=F.coalesce(_c(raw, c + "industries", "array<string>"), _EMPTY()), size_employees=_c(raw, c + "nb_employees", "bigint"), year_founded=_c(raw, c + "year_founded", "bigint"), hq_country=col(c + "hq_country"), org_type=text.mapped(F.initcap(_text(raw, c + "organization_type")), HIRINGCAFE["org"], "unknown"), stock_symbol=col(c + "stock_symbol"), stock_exchange=col(c + "stock_exchange"), latest_funding_type=col(c + "latest_funding_type"), latest_funding_amount_usd=_c(raw, c + "latest_funding_amount", "bigint"), homepage_url=col(c + "homepage_uri")),
        engagement_type=F.lit("direct"), posting_company_type=F.lit("end_client"), views=_c(raw, j + "num_views", "bigint"), applications=_c(raw, j + "num_applies", "bigint"), is_expired=F.coalesce(_c(raw, "is_expired", "boolean"), F.lit(False)),
    )


def hellowork(raw: DataFrame, now: Column) -> DataFrame:
    """Relative dates count from `now`; figures keep their period, as the board gives them."""
    col = lambda n: _c(raw, n)
    label = F.nullif(col("contract"), F.lit(""))
    return listing(
        raw, "hellowork", id=_text(raw, "id"), source_url=col("url"), apply_url=col("url"), title=_text(raw, "title"), company=_text(raw, "company"), location_raw=_text(raw, "location"), company_info=company_info(_text(raw, "company")),
        workplace_type=text.workplace_fr(_text(raw, "workplace")), date_posted=parse.french_posted(_text(raw, "date_posted"), now), salary=F.coalesce(parse.euro_figures(_text(raw, "salary")), undisclosed()),
        contract_types=F.when(label.isNotNull(), F.array(text.mapped(label, HELLOWORK_CONTRACT, "full_time"))).otherwise(_EMPTY()), contract_duration=text.duration_fr(_text(raw, "duration")), description_text=col("description"), description_language=F.lit("fr"),
    )


def englishjobs(raw: DataFrame, today: Column) -> DataFrame:
    col = lambda n: _c(raw, n)
    card = F.concat_ws(" ", _text(raw, "title"), _text(raw, "details"))
    return listing(
        raw, "englishjobs", id=_text(raw, "id"), source_url=col("url"), apply_url=col("url"), title=_text(raw, "title"), company=_text(raw, "company"), location_raw=_text(raw, "location"), company_info=company_info(col("company")),
        workplace_type=text.workplace(card), contract_types=text.contracts(card), date_posted=parse.month_day(col("date_posted"), today), description_text=_text(raw, "description"), engagement_type=F.lit("direct"),
    )


def faruse(raw: DataFrame) -> DataFrame:
    """Records of the search interface; the slug of the address stands in for a missing id."""
    col = lambda n: _c(raw, n)
    body = F.trim(_text(raw, "description"))
    body = F.when(F.lower(body).startswith("description"), F.ltrim(F.substring(body, 12, 1 << 30))).otherwise(body)
    url = col("joburl")
    return listing(
        raw, "faruse", id=F.coalesce(F.nullif(col("jobid"), F.lit("")), text.url_slug(url)), source_url=url, title=_text(raw, "title"), company=F.trim(_text(raw, "companyname")), apply_url=col("applyurl"), location_raw=F.trim(_text(raw, "location")),
        workplace_type=text.mapped(_text(raw, "worktype"), FARUSE["workplace"]), date_posted=F.nullif(col("publishedat"), F.lit("")), salary=parse.range_per_period(F.coalesce(col("salary"), F.lit(""))),
        contract_types=_one(text.mapped(_text(raw, "contracttype"), FARUSE["contract"])), seniority_level=text.mapped(_text(raw, "experiencelevel"), FARUSE["seniority"]), role_category=text.role_of_title(_text(raw, "title")),
        description_text=body, company_info=company_info(F.trim(_text(raw, "companyname")), hq_country=F.nullif(F.trim(_text(raw, "country")), F.lit(""))), end_client_sector=col("sector"), applications=text.first_integer(_c(raw, "applicationscount").cast("string")),
    )


def wwr(raw: DataFrame) -> DataFrame:
    """RSS items: 'Firm: Title', an HTML description, pay only where it is yearly."""
    from .html_text import html_text

    col = lambda n: _c(raw, n)
    body = html_text(_text(raw, "description"))
    firm = text.company_of_title(_text(raw, "title"))
    return listing(
        raw, "wwr", id=text.url_slug(col("link")), source_url=col("link"), apply_url=col("link"), title=text.title_without_company(_text(raw, "title")), company=F.coalesce(firm, F.lit("")), company_info=company_info(firm), location_raw=_text(raw, "region"), workplace_type=F.lit("remote"),
        date_posted=parse.mail_date(col("pubDate")), salary=parse.signed_amounts(body), contract_types=_one(text.mapped(F.lower(F.trim(_text(raw, "type"))), WWR["contract"])), role_category=text.mapped(F.lower(F.trim(_text(raw, "category"))), WWR["role"]),
        technologies=F.filter(F.transform(F.split(_text(raw, "skills"), ","), lambda x: F.trim(x)), lambda x: x != ""), description_text=body,
    )


def remoteok(raw: DataFrame) -> DataFrame:
    """Records with id and position; the leading notice of the interface has neither. Zero pay is undisclosed."""
    from .html_text import html_text

    col, tags = lambda n: _c(raw, n), F.coalesce(_c(raw, "tags", "array<string>"), _EMPTY())
    rows = raw.where((F.coalesce(col("id"), F.lit("")) != "") & (F.coalesce(col("position"), F.lit("")) != ""))
    url, apply_ = F.coalesce(F.nullif(col("url"), F.lit("")), col("apply_url")), F.coalesce(F.nullif(col("apply_url"), F.lit("")), col("url"))
    return listing(
        rows, "remoteok", id=col("id"), source_url=url, apply_url=apply_, title=F.trim(_text(raw, "position")), company=F.trim(_text(raw, "company")), company_info=company_info(F.trim(_text(raw, "company"))), location_raw=F.regexp_replace(_text(raw, "location"), r"^[ \t,]+|[ \t,]+$", ""), workplace_type=F.lit("remote"),
        date_posted=parse.iso_or_epoch(F.trim(col("date")), col("epoch")), salary=parse.dollars(_c(raw, "salary_min", "double"), _c(raw, "salary_max", "double")),
        technologies=F.filter(tags, lambda t: F.lower(t).rlike(text.word_pattern(text.REQUIRED_TAGS))), description_text=html_text(_text(raw, "description")),
    )


def datasciencejobs(raw: DataFrame) -> DataFrame:
    col = lambda n: _c(raw, n)
    place = text.clean_location(_text(raw, "location"))
    return listing(
        raw, "datasciencejobs", id=_text(raw, "id"), source_url=col("detail_url"), title=_text(raw, "title"), company=_text(raw, "company"), company_info=company_info(col("company")), apply_url=col("apply_url"), location_raw=place, workplace_type=text.workplace(place), date_posted=col("date_posted"),
        salary=parse.code_and_range(_text(raw, "salary_text")), contract_types=_one(text.mapped(_text(raw, "contract_raw"), DATASCIENCEJOBS["contract"])), seniority_level=text.mapped(F.lower(_text(raw, "job_level")), DATASCIENCEJOBS["seniority"]),
        technologies=F.coalesce(_c(raw, "skills", "array<string>"), _EMPTY()), description_text=_text(raw, "description"), engagement_type=F.lit("direct"),
    )


def union_boards(*frames: DataFrame) -> DataFrame:
    """All listings of all boards, repetitions kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
