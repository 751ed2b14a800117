"""Queries of the general operators over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import parse, text
from ..functions.score import scored
from ..operators import gold, silver, tailor, units
from ..session import table
from ..sources import files, normalize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, and its SQL where there is one."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.wrong_pay(table(spark, d, "jobs"), table(spark, d, "pay_units"))


@query()
def p2_annual_pay(spark: SparkSession, d: str) -> DataFrame:
    return units.annual_pay(table(spark, d, "jobs"), table(spark, d, "pay_units"))


# The state: one row a listing and board, the one seen last.
_STATE = """s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, source_board ORDER BY last_seen_at DESC, updated_at DESC,
  coalesce(views, -1) DESC, coalesce(applications, -1) DESC) AS nth FROM jobs) WHERE nth = 1)"""
_DAY = "CAST({} AT TIME ZONE 'UTC' AS DATE)"


def state(spark: SparkSession, d: str) -> DataFrame:
    return silver.first_by(table(spark, d, "jobs"), silver.KEY, [F.desc("last_seen_at"), F.desc("updated_at"), F.desc(F.coalesce("views", F.lit(-1))), F.desc(F.coalesce("applications", F.lit(-1)))])


@query(f"WITH {_STATE} SELECT id, source_board, last_seen_run, title FROM s")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return state(spark, d).select("id", "source_board", "last_seen_run", "title")


@query(f"""WITH {_STATE} SELECT s.id, s.source_board, overall_score, recommendation_tier, c.org_type AS company_type, c.stock_symbol AS company_stock_symbol
FROM s LEFT JOIN dim_company c USING (company_id) WHERE is_active AND overall_score IS NOT NULL""")
def view_ranked(spark: SparkSession, d: str) -> DataFrame:
    return gold.ranked(state(spark, d), table(spark, d, "dim_company")).select("id", "source_board", "overall_score", "recommendation_tier", "company_type", "company_stock_symbol")


@query(f"WITH {_STATE} SELECT id, source_board, overall_score FROM s WHERE is_active AND overall_score IS NOT NULL ORDER BY overall_score DESC, id, source_board LIMIT 10")
def topk_ranked(spark: SparkSession, d: str) -> DataFrame:
    return gold.top(gold.ranked(state(spark, d), table(spark, d, "dim_company"))).select("id", "source_board", "overall_score")


@query(f"WITH {_STATE} SELECT end_client_sector, count(*) AS jobs FROM s WHERE is_active GROUP BY 1")
def agg_by_sector(spark: SparkSession, d: str) -> DataFrame:
    return gold.active_by(state(spark, d), "end_client_sector")


@query(f"WITH {_STATE} SELECT recommendation_tier, count(*) AS jobs FROM s WHERE is_active GROUP BY 1")
def agg_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return gold.active_by(state(spark, d), "recommendation_tier")


@query(f"WITH {_STATE} SELECT id, source_board, title, company, first_seen_run, last_seen_run, is_active, CAST(datediff('day', {_DAY.format('first_seen_at')}, {_DAY.format('last_seen_at')}) AS INT) AS days_active FROM s")
def view_history(spark: SparkSession, d: str) -> DataFrame:
    return gold.history(state(spark, d))


@query(f"""WITH {_STATE}, weeks AS (SELECT DISTINCT date_trunc('week', {_DAY.format('first_seen_at')})::DATE AS week_start FROM s WHERE first_seen_at IS NOT NULL
UNION SELECT DISTINCT date_trunc('week', {_DAY.format('last_seen_at')})::DATE FROM s WHERE last_seen_at IS NOT NULL)
SELECT week_start, count(*) AS active_jobs FROM weeks JOIN s ON {_DAY.format('first_seen_at')} <= week_start + INTERVAL 6 DAY AND (is_active OR {_DAY.format('last_seen_at')} >= week_start) GROUP BY 1""")
def agg_weekly(spark: SparkSession, d: str) -> DataFrame:
    return gold.weekly(state(spark, d))


_LATEST = "(SELECT last_seen_run FROM s WHERE last_seen_run IS NOT NULL GROUP BY 1 ORDER BY max(last_seen_at) DESC, 1 DESC LIMIT 1)"
_PREVIOUS = "(SELECT last_seen_run FROM s WHERE last_seen_run IS NOT NULL GROUP BY 1 ORDER BY max(last_seen_at) DESC, 1 DESC LIMIT 1 OFFSET 1)"


@query(f"WITH {_STATE} SELECT last_seen_run AS run_id FROM s WHERE last_seen_run IS NOT NULL GROUP BY 1 ORDER BY max(last_seen_at) DESC, 1 DESC LIMIT 1")
def agg_latest_run(spark: SparkSession, d: str) -> DataFrame:
    return gold.latest_run(state(spark, d)).select("run_id")


@query(f"WITH {_STATE} SELECT last_seen_run AS run_id FROM s WHERE last_seen_run IS NOT NULL GROUP BY 1 ORDER BY max(last_seen_at) DESC, 1 DESC LIMIT 1 OFFSET 1")
def agg_previous_run(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return gold.latest_run(s, before=gold.run_name(s)).select("run_id")


@query(f"WITH {_STATE} SELECT id, source_board FROM s WHERE first_seen_run = {_LATEST}")
def view_new_run(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return gold.new_in_run(s, gold.run_name(s)).select("id", "source_board")


@query(f"WITH {_STATE} SELECT id, source_board FROM s WHERE last_seen_run = {_PREVIOUS} AND NOT is_active")
def view_disappeared(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return gold.gone_since(s, gold.run_name(s, before=gold.run_name(s))).select("id", "source_board")


@query(f"WITH {_STATE} SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE is_active AND enriched_at IS NULL) AS pending FROM s")
def agg_totals(spark: SparkSession, d: str) -> DataFrame:
    return gold.totals(state(spark, d))


@query(f"WITH {_STATE} SELECT company_id, count(*) AS jobs, count(DISTINCT end_client_sector) AS sectors, round(avg(salary.min_annual_eur), 2) AS mean_min_pay FROM s GROUP BY 1")
def agg_company_profile(spark: SparkSession, d: str) -> DataFrame:
    return gold.company_profile(state(spark, d))


@query(f"WITH {_STATE} SELECT coalesce(nullif(trim(end_client_name), ''), nullif(trim(company), ''), 'unknown') AS target, count(*) AS jobs FROM s GROUP BY 1")
def agg_research_targets(spark: SparkSession, d: str) -> DataFrame:
    return gold.research_targets(state(spark, d))


@query("""SELECT event_type AS symbol, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, max(value) AS high, min(value) AS low,
round((arg_max(value, event_id) / nullif(arg_min(value, event_id), 0) - 1) * 100, 1) AS change FROM events WHERE value IS NOT NULL GROUP BY 1""")
def agg_stock_perf(spark: SparkSession, d: str) -> DataFrame:
    return gold.price_change(table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("day"), F.col("value").alias("close")))


def _gate(stage: str) -> None:
    if stage == "dim_company":
        sql = f"SELECT company_id FROM dim_company WHERE {silver.GATES[stage]}"
        run = lambda s, d: silver.gate(table(s, d, "dim_company"), stage).select("company_id")
    else:
        sql = f"WITH {_STATE} SELECT id, source_board FROM s WHERE {silver.GATES[stage]}"
        run = lambda s, d: silver.gate(state(s, d), stage).select("id", "source_board")
    QUERIES[f"pred_gate_{stage}"], SQL[f"pred_gate_{stage}"] = run, sql


for _stage in silver.GATES:
    _gate(_stage)


@query(f"WITH {_STATE} SELECT id, source_board FROM s WHERE {silver.DONE}")
def pred_done_all(spark: SparkSession, d: str) -> DataFrame:
    return state(spark, d).where(F.expr(silver.DONE)).select("id", "source_board")


# Two batches out of the listings: what the state was, and what a later run brings, among it known and new keys and repetitions.
_OLD, _NEW = "first_seen_run < 'run_20260401'", "last_seen_run >= 'run_20260320'"
_RUN, _NOW = "run_next", "2026-09-01 06:00:00"


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = state(spark, d).where(_OLD)
    new = table(spark, d, "jobs").where(_NEW).withColumn("title", F.upper("title")).drop("company_info")
    return old.drop("company_info"), new


_UPSERT = f"""WITH {_STATE}, o AS (SELECT * FROM s WHERE {_OLD}), n AS (SELECT DISTINCT id, source_board, upper(title) AS title, company FROM jobs WHERE {_NEW})
SELECT coalesce(o.id, n.id) AS id, coalesce(o.source_board, n.source_board) AS source_board, {{title}} AS title,
  CASE WHEN o.id IS NULL THEN '{_RUN}' ELSE first_seen_run END AS first_seen_run, CASE WHEN n.id IS NULL THEN last_seen_run ELSE '{_RUN}' END AS last_seen_run,
  CASE WHEN n.id IS NULL THEN is_active ELSE TRUE END AS is_active, {{enriched}} AS enriched
FROM o FULL JOIN n ON o.id = n.id AND o.source_board = n.source_board"""
_SHOWN = ["id", "source_board", "title", "first_seen_run", "last_seen_run", "is_active"]


@query(_UPSERT.format(title="CASE WHEN o.id IS NULL THEN n.title ELSE o.title END", enriched="o.id IS NOT NULL AND enriched_at IS NOT NULL"))
def dml_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = _batches(spark, d)
    return silver.upsert(old, new, _RUN, _NOW).select(*_SHOWN, F.col("enriched_at").isNotNull().alias("enriched"))


@query(_UPSERT.format(title="CASE WHEN n.id IS NULL THEN o.title ELSE n.title END", enriched="n.id IS NULL AND enriched_at IS NOT NULL"))
def dml_upsert_full(spark: SparkSession, d: str) -> DataFrame:
    old, new = _batches(spark, d)
    return silver.upsert(old, new, _RUN, _NOW, full_replace=True).select(*_SHOWN, F.col("enriched_at").isNotNull().alias("enriched"))


@query("""SELECT coalesce(o.company_id, n.company_id) AS company_id, CASE WHEN o.company_id IS NULL THEN n.hq_country ELSE coalesce(n.hq_country, o.hq_country) END AS hq_country,
CASE WHEN o.company_id IS NULL THEN n.size_employees + 1 ELSE coalesce(n.size_employees + 1, o.size_employees) END AS size_employees, coalesce(o.source_board, n.source_board) AS source_board
FROM (SELECT * FROM dim_company WHERE source_board <> 'wwr') o FULL JOIN (SELECT * FROM dim_company WHERE org_type IS NOT NULL) n USING (company_id)""")
def dml_upsert_dim(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "dim_company")
    new = dim.where("org_type is not null").withColumn("size_employees", F.col("size_employees") + 1)
    return silver.upsert_companies(dim.where("source_board <> 'wwr'"), new).select("company_id", "hq_country", "size_employees", "source_board")


@query(f"WITH {_STATE} SELECT id, source_board, CASE WHEN is_active AND last_seen_run <> {_LATEST} THEN FALSE ELSE is_active END AS is_active FROM s")
def dml_deactivate(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return silver.deactivate(s, gold.run_name(s)).select("id", "source_board", "is_active")


@query(f"""WITH {_STATE} SELECT id, source_board, coalesce(enriched_at IS NOT NULL OR ({silver.DONE}), FALSE) AS enriched,
CASE WHEN enriched_at IS NULL AND ({silver.DONE}) THEN NULL ELSE overall_score END AS overall_score,
CASE WHEN enriched_at IS NULL AND ({silver.DONE}) THEN {silver.ENRICHMENT_VERSION} ELSE enrichment_version END AS enrichment_version FROM s""")
def dml_mark_enriched(spark: SparkSession, d: str) -> DataFrame:
    return silver.mark_enriched(state(spark, d), _NOW).select("id", "source_board", F.col("enriched_at").isNotNull().alias("enriched"), "overall_score", "enrichment_version")


_STALE = f"coalesce(enrichment_version < {silver.ENRICHMENT_VERSION}, FALSE)"
_DIRECT = f"{_STALE} AND coalesce(source_board <> 'hiringcafe', FALSE)"


@query(f"""WITH {_STATE} SELECT id, source_board, CASE WHEN {_STALE} AND description_language = 'en' AND trim(description_text) <> '' THEN 'fr' ELSE description_language END AS description_language FROM s""")
def dml_reset_translate(spark: SparkSession, d: str) -> DataFrame:
    return silver.reset_stale(state(spark, d), "translate").select("id", "source_board", "description_language")


@query(f"""WITH {_STATE} SELECT id, source_board, CASE WHEN NOT ({_STALE}) THEN len(technologies) END AS technologies, CASE WHEN NOT ({_STALE}) THEN role_category END AS role_category FROM s""")
def dml_reset_tech(spark: SparkSession, d: str) -> DataFrame:
    return silver.reset_stale(state(spark, d), "tech").select("id", "source_board", F.size("technologies").cast("long").alias("technologies"), "role_category")


@query(f"WITH {_STATE} SELECT id, source_board, CASE WHEN NOT ({_DIRECT}) THEN engagement_type END AS engagement_type, CASE WHEN NOT ({_DIRECT}) THEN end_client_sector END AS end_client_sector FROM s")
def dml_reset_classify(spark: SparkSession, d: str) -> DataFrame:
    return silver.reset_stale(state(spark, d), "classify").select("id", "source_board", "engagement_type", "end_client_sector")


@query(f"SELECT company_id, CASE WHEN NOT ({_DIRECT}) THEN org_type END AS org_type, enriched_at IS NOT NULL AND NOT ({_DIRECT}) AS enriched FROM dim_company")
def dml_reset_company(spark: SparkSession, d: str) -> DataFrame:
    return silver.reset_stale(table(spark, d, "dim_company"), "company").select("company_id", "org_type", F.col("enriched_at").isNotNull().alias("enriched"))


@query(f"WITH {_STATE} SELECT id, source_board, CASE WHEN NOT ({_STALE}) THEN overall_score END AS overall_score FROM s")
def dml_reset_score(spark: SparkSession, d: str) -> DataFrame:
    return silver.reset_stale(state(spark, d), "score").select("id", "source_board", "overall_score")


@query("""WITH x AS (SELECT DISTINCT try_cast(substr(date_posted, 1, 10) AS DATE) AS d FROM jobs WHERE regexp_matches(date_posted, '^[0-9]{4}-[0-9]{2}-[0-9]{2}'))
SELECT strftime(d, '%Y-%m-%d') AS date_id, CAST(week(d) AS INT) AS iso_week, CAST(month(d) AS INT) AS month, CAST(quarter(d) AS INT) AS quarter, CAST(year(d) AS INT) AS year FROM x WHERE d IS NOT NULL""")
def dml_dim_date(spark: SparkSession, d: str) -> DataFrame:
    return silver.dim_date(table(spark, d, "jobs"))


@query(f"""WITH {_STATE}, t AS (SELECT *, coalesce(last_seen_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS seen FROM s)
SELECT company_id, max(seen) FILTER (WHERE company_info.hq_country IS NOT NULL) IS NOT NULL AS has_country, max(seen) FILTER (WHERE company_info.org_type IS NOT NULL) IS NOT NULL AS has_type FROM t GROUP BY 1""")
def agg_merge_company(spark: SparkSession, d: str) -> DataFrame:
    m = silver.merge_companies(state(spark, d))
    return m.select("company_id", F.col("hq_country").isNotNull().alias("has_country"), F.col("org_type").isNotNull().alias("has_type"))


@query("SELECT DISTINCT company, source_board, trim(regexp_replace(lower(coalesce(company, '')), '\\s+', ' ', 'g')) AS name, substr(sha1(source_board || '|' || trim(regexp_replace(lower(coalesce(company, '')), '\\s+', ' ', 'g'))), 1, 16) AS company_id FROM jobs")
def str_company_id(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("company")
    return table(spark, d, "jobs").select("company", "source_board", text.company_name_key(c).alias("name"), text.company_key(c, F.col("source_board")).alias("company_id")).distinct()


@query()
def score_full(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(files.with_company(state(spark, d), table(spark, d, "dim_company")), "dim")
    return rows.select("id", "source_board", "scores.*", "overall_score", "recommendation_tier")


@query(f"""WITH {_STATE}, p AS (SELECT id, source_board, CASE WHEN salary.is_disclosed THEN coalesce(nullif(salary.min_annual_eur, 0), nullif(salary.max_annual_eur, 0), 0) ELSE 0 END AS lo,
CASE WHEN salary.is_disclosed THEN coalesce(nullif(salary.max_annual_eur, 0), nullif(salary.min_annual_eur, 0), 0) ELSE 0 END AS hi FROM s)
SELECT id, source_board, CASE WHEN lo = 0 THEN 0.3 WHEN (lo + hi) / 2 >= 90000 THEN 1.0 WHEN (lo + hi) / 2 >= 75000 THEN 0.8 WHEN (lo + hi) / 2 >= 60000 THEN 0.6 WHEN (lo + hi) / 2 >= 50000 THEN 0.4 WHEN (lo + hi) / 2 >= 40000 THEN 0.2 ELSE 0.1 END::DOUBLE AS pay FROM p""")
def score_pay(spark: SparkSession, d: str) -> DataFrame:
    return scored(state(spark, d)).select("id", "source_board", F.col("scores.pay").alias("pay"))


@query(f"""WITH {_STATE} SELECT id, source_board, CASE WHEN regexp_matches(lower(company), '{"|".join(text.ESN_NAME)}') OR regexp_matches(lower(description_text), '{"|".join(text.ESN_TEXT)}') THEN 'consulting' ELSE 'direct' END AS engagement FROM s""")
def txt_engagement(spark: SparkSession, d: str) -> DataFrame:
    return state(spark, d).select("id", "source_board", text.engagement(F.col("company"), F.col("description_text")).alias("engagement"))


@query("""SELECT DISTINCT jobid, salary, CASE WHEN split_part(salary, '/', 2) = 'year' THEN 1 WHEN split_part(salary, '/', 2) = 'month' THEN 12 WHEN split_part(salary, '/', 2) = 'day' THEN 260 ELSE 2080 END
* CAST(regexp_extract(salary, '^([0-9.]+)-', 1) AS DOUBLE) AS low FROM raw_faruse WHERE regexp_matches(salary, '^[0-9]+(\\.[0-9]+)?-[0-9]+(\\.[0-9]+)? EUR/(year|month|day|hour)$')""")
def sal_faruse(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_faruse").where(F.col("salary").rlike(r"^[0-9]+(\.[0-9]+)?-[0-9]+(\.[0-9]+)? EUR/(year|month|day|hour)$"))
    return r.select("jobid", "salary", parse.range_per_period(F.col("salary"))["min_annual_eur"].alias("low")).distinct()


@query("SELECT DISTINCT jobid, string_split(rtrim(joburl, '/'), '/')[-1] AS slug FROM raw_faruse WHERE joburl IS NOT NULL")
def str_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_faruse").where("joburl is not null").select("jobid", text.url_slug(F.col("joburl")).alias("slug")).distinct()


@query("""SELECT DISTINCT location_raw, array_to_string(list_filter(list_transform(string_split(location_raw, ','), lambda x: trim(x)), lambda x: x <> ''), ', ') AS place FROM jobs WHERE location_raw IS NOT NULL""")
def str_clean_location(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("location_raw is not null").select("location_raw", text.clean_location(F.col("location_raw")).alias("place")).distinct()


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'remote') THEN 'remote' WHEN contains(lower(text), 'hybrid') THEN 'hybrid' WHEN regexp_matches(lower(text), 'on-site|onsite|on site') THEN 'onsite' END AS workplace FROM documents""")
def txt_workplace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.workplace(F.col("text")).alias("workplace"))


@query()
def txt_contracts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws("|", text.contracts(F.col("text"))).alias("contracts"))


def _role_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(title), '{'|'.join(w)}') THEN '{r}'" for r, w in text.ROLE_WORDS.items())
    return f"SELECT DISTINCT title, CASE {cases} ELSE 'other' END AS role FROM jobs WHERE title IS NOT NULL"


@query(_role_sql())
def txt_role(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("title is not null").select("title", text.role_of_title(F.col("title")).alias("role")).distinct()


@query("SELECT doc_id, len(list_intersect(string_split_regex(lower(coalesce(text, '')), '\\s+'), [" + ", ".join("'" + w.replace("'", "''") + "'" for w in text.FRENCH_WORDS) + "])) = 0 AS english FROM documents")
def txt_is_english(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.is_english(F.col("text")).alias("english"))


@query("""SELECT jobid FROM raw_faruse WHERE contains(lower(concat_ws(' ', title, description)), 'data') AND contains(lower(concat_ws(' ', title, description)), 'engineer') AND contains(lower(coalesce(country, '')), 'france')""")
def pred_rest_match(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_faruse")
    return r.where(text.all_words_in(F.concat_ws(" ", "title", "description"), "Data Engineer") & F.lower(F.coalesce("country", F.lit(""))).contains("france")).select("jobid")


@query("SELECT id FROM jobs WHERE contains(lower(title), 'data') OR contains(lower(title), 'analyst')")
def pred_title_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where(text.any_word_in(F.col("title"), "data analyst")).select("id")


@query("SELECT id FROM jobs WHERE contains(lower(concat_ws(' ', title, array_to_string(technologies, ' '), description_text)), 'spark') AND contains(lower(concat_ws(' ', title, array_to_string(technologies, ' '), description_text)), 'python')")
def pred_query_all(spark: SparkSession, d: str) -> DataFrame:
    whole = F.concat_ws(" ", "title", F.array_join("technologies", " "), "description_text")
    return table(spark, d, "jobs").where(text.all_words_in(whole, "spark python")).select("id")


@query()
def pred_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where(text.has_required_tag(F.col("technologies"))).select("id")


@query(f"""WITH {_STATE}, r AS (SELECT s.*, c.industry AS ci, c.size_employees AS cs, c.org_type AS ct FROM s LEFT JOIN dim_company c USING (company_id) WHERE is_active)
SELECT id, source_board, overall_score, scores.pay AS scores_pay, salary.min_annual_eur AS salary_min_annual_eur, coalesce(array_to_string(technologies, '|'), '') AS technologies, coalesce(array_to_string(ci, '|'), '') AS company_industry, cs AS company_size, ct AS company_type FROM r""")
def sink_ranked_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = files.with_company(state(spark, d).where("is_active"), table(spark, d, "dim_company"))
    wanted = {k: files.RANKED_COLUMNS[k] for k in ("overall_score", "source_board", "scores_pay", "salary_min_annual_eur", "technologies", "company_industry", "company_size", "company_type")}
    return files.flatten(rows, {"id": "id", **wanted})


@query(f"""WITH {_STATE} SELECT s.id, s.source_board, c.display_name AS company_name, len(coalesce(c.industry, [])) AS industries, c.hq_country AS hq_country FROM s LEFT JOIN dim_company c USING (company_id) WHERE is_active""")
def sink_merged_json(spark: SparkSession, d: str) -> DataFrame:
    x = files.nested_export(state(spark, d), table(spark, d, "dim_company"))
    return x.select("id", "source_board", F.col("company_info.name").alias("company_name"), F.size("company_info.industry").cast("long").alias("industries"), F.col("company_info.hq_country").alias("hq_country"))


@query("""SELECT DISTINCT jobid AS id, 'faruse' AS source_board, trim(coalesce(companyname, '')) AS company, CASE worktype WHEN 'Remote' THEN 'remote' WHEN 'Hybrid' THEN 'hybrid' END AS workplace_type,
CASE contracttype WHEN 'Full-time' THEN 'full_time' WHEN 'Part-time' THEN 'part_time' WHEN 'Contract' THEN 'contract' WHEN 'Internship' THEN 'internship' WHEN 'Temporary' THEN 'temporary' WHEN 'Volunteer' THEN 'volunteer' ELSE '' END AS contract_types,
nullif(trim(coalesce(country, '')), '') AS hq_country, applicationscount AS applications FROM raw_faruse""")
def norm_faruse(spark: SparkSession, d: str) -> DataFrame:
    x = normalize.faruse(table(spark, d, "raw_faruse"))
    return x.select("id", "source_board", "company", "workplace_type", F.concat_ws("|", "contract_types").alias("contract_types"), F.col("company_info.hq_country").alias("hq_country"), "applications").distinct()


@query("""SELECT source_board, count(*) AS listings FROM (SELECT source_board FROM jobs UNION ALL SELECT 'faruse' FROM raw_faruse) GROUP BY 1""")
def union_boards(spark: SparkSession, d: str) -> DataFrame:
    both = normalize.union_boards(table(spark, d, "jobs").select("id", "source_board"), normalize.faruse(table(spark, d, "raw_faruse")).select("id", "source_board"))
    return both.groupBy("source_board").agg(F.count("*").alias("listings"))


@query("SELECT DISTINCT date_posted, CASE WHEN regexp_matches(date_posted, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN strftime(try_cast(substr(date_posted, 1, 10) AS DATE), '%Y-%m-%d') END AS day FROM jobs WHERE date_posted IS NOT NULL")
def dt_try_cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("date_posted is not null").select("date_posted", F.date_format(parse.iso_guarded(F.col("date_posted")), "yyyy-MM-dd").alias("day")).distinct()


@query("SELECT m.board AS board_id, b.display_name, count(*) AS runs, sum(job_count) AS listings FROM run_manifest m LEFT JOIN dim_board b ON m.board = b.board_id GROUP BY 1, 2")
def src_manifest(spark: SparkSession, d: str) -> DataFrame:
    m, b = table(spark, d, "run_manifest"), table(spark, d, "dim_board")
    return m.join(F.broadcast(b), m.board == b.board_id, "left").groupBy(m.board.alias("board_id"), "display_name").agg(F.count("*").alias("runs"), F.sum("job_count").alias("listings"))


_TERMS = ["Apache Airflow", "dbt", "SQL", "Kafka"]


@query()
def txt_jd_relevance(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.relevance(c, _TERMS).alias("relevance"), text.impact(c).alias("impact"))


@query("""SELECT DISTINCT id, array_to_string(list_sort(list_filter(list_distinct(list_transform(technologies, lambda t: lower(t))), lambda t: t IN ('sql', 'python', 'dbt', 'git'))), ',') AS common FROM jobs WHERE technologies IS NOT NULL""")
def set_intersect_words(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").where("technologies is not null")
    have = F.array_intersect(F.transform("technologies", lambda t: F.lower(t)), text.text_list(["sql", "python", "dbt", "git"]))
    return j.select("id", F.array_join(F.array_sort(have), ",").alias("common")).distinct()


@query()
def txt_seq_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of each listing's title as typed and in lower case with single blanks, by distinct title."""
    t = table(spark, d, "jobs").where("title is not null").select("title").distinct()
    return t.select("title", tailor.sequence_ratio("title", text.company_name_key(F.col("title"))).alias("ratio"))


@query("SELECT o_orderstatus AS status, count(*) AS orders, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def agg_funnel(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"))
    return by.withColumn("share", F.round(F.col("orders") / F.sum("orders").over(Window.partitionBy()), 6))
