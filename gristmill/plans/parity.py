"""Queries of the parsers, readers and stages on small tables given inline, which both engines read, and on whole tables where those hold such values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import parse, score, text
from ..operators import enrich, gold, silver, tailor
from ..schema import BOARDS, conform, listing
from ..session import table
from ..sources import boards, files, html_text, normalize
from .core import _STATE, QUERIES, SQL, query, state


class Inline:
    """A small table as a DataFrame and as SQL."""

    def __init__(self, fields: str, *rows: tuple):
        self.fields, self.rows = fields, rows
        self.names = [f.split(" ")[0] for f in fields.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.fields)

    @property
    def sql(self) -> str:
        def lit(v: object) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, (list, tuple)):
                return "[" + ", ".join(lit(x) for x in v) + "]"
            return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)

        kinds = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "int": "INTEGER"}
        cols = ", ".join(f"CAST({n} AS {kinds[f.split(' ')[1]]}) AS {n}" for n, f in zip(self.names, self.fields.split(", ")))
        return f"(SELECT {cols} FROM (VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in self.rows)}) AS v({', '.join(self.names)}))"


def register(name: str, run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


def on_texts(name: str, given: Inline, made: Callable[[], dict[str, Column]], sql: str) -> None:
    """A query of column functions over an inline table; `sql` selects the same from {t}."""
    register(name, lambda spark, d: given.df(spark).select(given.names[0], *[c.alias(n) for n, c in made().items()]), sql.replace("{t}", given.sql))


# -- pay


def _pay(column: Column) -> dict[str, Column]:
    return {"low": column["min_annual_eur"], "high": column["max_annual_eur"], "told": column["is_disclosed"]}


_NUM = "try_cast(CASE WHEN {x} LIKE '%k' THEN rtrim({x}, 'k') ELSE {x} END AS DOUBLE) * CASE WHEN {x} LIKE '%k' THEN 1000 ELSE 1 END"
_PARTS = "list_filter(list_transform(list_transform(string_split_regex(coalesce({c}, ''), '\\s*[-–—]\\s*'), lambda p: lower(regexp_replace(regexp_replace(p, '\\s*[€¤$].*', ''), '\\s', '', 'g'))), lambda x: " + _NUM.format(x="x") + "), lambda x: x IS NOT NULL)"
on_texts(
    "sal_freework", Inline("k bigint, pay string, rate string", (1, "40k-75k €", None), (2, "55 000 €", ""), (3, None, "400-550 €"), (4, "", ""), (5, "to be agreed", None), (6, "0 €", None), (7, "38,5k €", None)),
    lambda: {**_pay(parse.pay_or_rate(F.col("pay"), F.col("rate"))), "period": parse.pay_or_rate(F.col("pay"), F.col("rate"))["frequency_original"]},
    f"""WITH x AS (SELECT k, pay, rate, {_PARTS.format(c="pay")} AS p, list_transform({_PARTS.format(c="rate")}, lambda v: v * 220) AS r FROM {{t}}), y AS (SELECT *, CASE WHEN len(p) > 0 THEN p ELSE r END AS u FROM x)
SELECT k, CASE WHEN u[1] > 0 THEN u[1] END AS low, CASE WHEN u[-1] > 0 THEN u[-1] END AS high, coalesce(u[1] > 0, FALSE) OR coalesce(u[-1] > 0, FALSE) AS told, CASE WHEN coalesce(rate, '') <> '' AND coalesce(pay, '') = '' THEN 'daily' ELSE 'yearly' END AS period FROM y""",
)

_FORM = "(?i)^\\s*(\\d[\\d\\s.,]*)\\s*-\\s*(\\d[\\d\\s.,]*)\\s*([A-Za-z€$]{2,4})\\s*/\\s*(year|yr|yearly|month|mo|monthly|day|daily|hour|hr|hourly)\\s*$"


@query(f"""WITH x AS (SELECT DISTINCT jobid, salary, try_cast(replace(replace(regexp_extract(salary, '{_FORM}', 1), ' ', ''), ',', '.') AS DOUBLE) AS a, try_cast(replace(replace(regexp_extract(salary, '{_FORM}', 2), ' ', ''), ',', '.') AS DOUBLE) AS b,
upper(regexp_extract(salary, '{_FORM}', 3)) AS code, lower(regexp_extract(salary, '{_FORM}', 4)) AS period FROM raw_faruse),
y AS (SELECT *, CASE WHEN code IN ('EUR', '€') THEN 1.0 WHEN code IN ('USD', 'US$', '$') THEN 0.92 END AS rate, CASE WHEN period IN ('year', 'yr', 'yearly') THEN 1 WHEN period IN ('month', 'mo', 'monthly') THEN 12 WHEN period IN ('day', 'daily') THEN 260 ELSE 2080 END AS times FROM x)
SELECT jobid, salary, coalesce(a IS NOT NULL AND b IS NOT NULL AND rate IS NOT NULL, FALSE) AS told, CASE WHEN b IS NOT NULL THEN round_even(a * times * rate, 0) END AS low, CASE WHEN a IS NOT NULL THEN round_even(b * times * rate, 0) END AS high,
CASE WHEN a IS NOT NULL AND b IS NOT NULL AND rate IS NOT NULL THEN code ELSE 'EUR' END AS currency, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND rate IS NOT NULL THEN period ELSE 'yearly' END AS period FROM y""")
def sal_faruse(spark: SparkSession, d: str) -> DataFrame:
    s = parse.range_per_period(F.col("salary"))
    return table(spark, d, "raw_faruse").select("jobid", "salary", s["is_disclosed"].alias("told"), s["min_annual_eur"].alias("low"), s["max_annual_eur"].alias("high"), s["currency_original"].alias("currency"), s["frequency_original"].alias("period")).distinct()


on_texts(
    "sal_hellowork", Inline("t string", ("45 000 € - 60 000 €",), ("2 500 € / mois",), ("15 € /h",), ("selon profil",), ("",), ("1 900 € mensuel",)),
    lambda: {**_pay(parse.euro_figures(F.col("t"))), "period": parse.euro_figures(F.col("t"))["frequency_original"]},
    """WITH x AS (SELECT t, list_transform(regexp_extract_all(t, '([0-9 .,]*[0-9])\\s*€', 1), lambda v: try_cast(replace(v, ' ', '') AS DOUBLE)) AS v FROM {t})
SELECT t, list_min(v) AS low, list_max(v) AS high, CASE WHEN len(v) > 0 THEN TRUE END AS told, CASE WHEN len(v) = 0 THEN NULL WHEN regexp_matches(lower(t), '/h|par heure|horaire') THEN 'hourly' WHEN regexp_matches(lower(t), '/mois|mensuel') THEN 'monthly' ELSE 'yearly' END AS period FROM x""",
)
on_texts(
    "sal_datasciencejobs", Inline("t string", ("USD 100,000 - 150,000",), ("$90,000",), ("€50,000 - €70,000",), ("GBP 40,000",), ("negotiable",), ("",)),
    lambda: {**_pay(parse.code_and_range(F.col("t"))), "currency": parse.code_and_range(F.col("t"))["currency_original"]},
    """WITH x AS (SELECT t, regexp_extract(t, '([A-Z]{3})?\\s*([$€£])?\\s*([0-9][0-9,]*)(?:\\s*-\\s*(?:[A-Z]{3}\\s*)?[$€£]?\\s*([0-9][0-9,]*))?', ['c', 's', 'a', 'b']) AS m FROM {t}),
y AS (SELECT t, try_cast(replace(m.a, ',', '') AS DOUBLE) AS a, try_cast(replace(m.b, ',', '') AS DOUBLE) AS b, CASE WHEN m.c <> '' THEN m.c WHEN m.s = '€' THEN 'EUR' WHEN m.s = '£' THEN 'GBP' ELSE 'USD' END AS c FROM x)
SELECT t, round_even(a * CASE WHEN c = 'USD' THEN 0.92 ELSE 1.0 END, 0) AS low, round_even(b * CASE WHEN c = 'USD' THEN 0.92 ELSE 1.0 END, 0) AS high, a IS NOT NULL AS told, c AS currency FROM y""",
)
_WWR = Inline("t string", ("We pay $80,000 - $120,000 a year",), ("£50k",), ("€60,000",), ("$40 per hour",), ("no figure",), ("$90k, £70k and €65k",))
_WWR_SQL = """WITH x AS (SELECT t, list_transform(regexp_extract_all(t, '[$€£]\\s?[0-9][0-9,]*[kK]?'), lambda v: try_cast(regexp_replace(v, '[^0-9]', '', 'g') AS DOUBLE) * CASE WHEN lower(v) LIKE '%k' THEN 1000 ELSE 1 END * CASE WHEN v LIKE '$%' THEN 0.92 WHEN v LIKE '£%' THEN 1.17 ELSE 1.0 END) AS v,
regexp_matches(lower(t), '\\b(per\\s*hour|hourly)\\b|/\\s*hr\\b') AS h FROM {t})"""
on_texts("sal_wwr", _WWR, lambda: _pay(parse.signed_amounts(F.col("t"))), _WWR_SQL + " SELECT t, CASE WHEN NOT h THEN round_even(list_min(v), 0) END AS low, CASE WHEN NOT h AND len(v) > 1 THEN round_even(list_max(v), 0) END AS high, NOT h AND len(v) > 0 AS told FROM x")
on_texts("agg_minmax_salary", _WWR, lambda: {"spread": parse.signed_amounts(F.col("t"))["max_annual_eur"] - parse.signed_amounts(F.col("t"))["min_annual_eur"]}, _WWR_SQL + " SELECT t, CASE WHEN NOT h AND len(v) > 1 THEN round_even(list_max(v), 0) - round_even(list_min(v), 0) END AS spread FROM x")
on_texts(
    "sal_remoteok", Inline("k bigint, low_usd double, high_usd double", (1, 100000.0, 150000.0), (2, 0.0, 0.0), (3, None, 90000.0), (4, 12345.0, None)),
    lambda: _pay(parse.dollars(F.col("low_usd"), F.col("high_usd"))),
    "SELECT k, round_even(nullif(low_usd, 0) * 0.92, 0) AS low, round_even(nullif(high_usd, 0) * 0.92, 0) AS high, coalesce(low_usd > 0, FALSE) OR coalesce(high_usd > 0, FALSE) AS told FROM {t}",
)
on_texts(
    "sal_hiringcafe", Inline("k bigint, lo double, hi double, cur string, per string", (1, 100000.0, 120000.0, "USD", "yearly"), (2, 50.0, None, "EUR", "hourly"), (3, None, None, "USD", "yearly"), (4, 0.0, 70000.0, "GBP", "yearly")),
    lambda: {**_pay(parse.dollars(F.col("lo"), F.col("hi"), False, F.col("cur"), F.col("per"))), "period": parse.dollars(F.col("lo"), F.col("hi"), False, F.col("cur"), F.col("per"))["frequency_original"]},
    "SELECT k, round_even(lo * CASE WHEN cur = 'USD' THEN 0.92 ELSE 1 END, 0) AS low, round_even(hi * CASE WHEN cur = 'USD' THEN 0.92 ELSE 1 END, 0) AS high, lo IS NOT NULL OR hi IS NOT NULL AS told, per AS period FROM {t}",
)
on_texts(
    "num_cells", Inline("k string, list string", ("", "a|b||c"), ("12", None), ("3.7", ""), ("x", "|"), (None, "one"), ("-2.5", "a b|c")),
    lambda: {"number": text.number_cell(F.col("k")), "whole": text.whole_cell(F.col("k")), "parts": F.concat_ws(";", text.list_cell(F.col("list")))},
    "SELECT k, try_cast(nullif(trim(k), '') AS DOUBLE) AS number, CAST(trunc(try_cast(nullif(trim(k), '') AS DOUBLE)) AS BIGINT) AS whole, array_to_string(list_filter(string_split(coalesce(list, ''), '|'), lambda x: x <> ''), ';') AS parts FROM {t}",
)


@query("SELECT DISTINCT jobid, CAST(regexp_extract(CAST(applicationscount AS VARCHAR), '([0-9]+)', 1) AS BIGINT) AS n FROM raw_faruse WHERE applicationscount IS NOT NULL")
def num_applications(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_faruse").where("applicationscount is not null").select("jobid", text.first_integer(F.col("applicationscount").cast("string")).alias("n")).distinct()


@query("""SELECT DISTINCT id, CASE WHEN salary.is_disclosed THEN coalesce(nullif(salary.min_annual_eur, 0), nullif(salary.max_annual_eur, 0), 0) ELSE 0 END AS low,
CASE WHEN salary.is_disclosed THEN coalesce(nullif(salary.max_annual_eur, 0), nullif(salary.min_annual_eur, 0), 0) ELSE 0 END AS high FROM jobs""")
def pay_pair(spark: SparkSession, d: str) -> DataFrame:
    p = parse.paid_pair(F.col("salary"))
    return table(spark, d, "jobs").select("id", p["low"].alias("low"), p["high"].alias("high")).distinct()


# -- dates

on_texts(
    "dt_freework", Inline("t string", ("8/4/2026",), ("12/31/2025",), ("2026-08-01",), ("soon",), ("",), (None,)), lambda: {"day": parse.month_first(F.col("t"))},
    "SELECT t, CASE WHEN regexp_matches(t, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') THEN strftime(strptime(t, '%m/%d/%Y'), '%Y-%m-%d') ELSE nullif(t, '') END AS day FROM {t}",
)
on_texts(
    "dt_hellowork", Inline("t string", ("04/08/2026",), ("Aujourd'hui",), ("Hier",), ("il y a 2 jours",), ("il y a 7 heures",), ("il y a 3 semaines",), ("il y a 2 mois",), ("il y a 1 an",), ("bientôt",), ("31/02/2026",), ("",)),
    lambda: {"day": parse.french_posted(F.col("t"), F.lit("2026-08-10 05:00:00").cast("timestamp"))},
    """WITH x AS (SELECT t, lower(t) AS l, try_cast(regexp_extract(lower(t), 'il y a ([0-9]+)', 1) AS INTEGER) AS n, regexp_extract(lower(t), 'il y a [0-9]+\\s*(heure|jour|semaine|mois|an)', 1) AS u FROM {t})
SELECT t, strftime(CASE WHEN regexp_matches(l, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') THEN try_strptime(l, '%d/%m/%Y') WHEN contains(l, 'aujourd') THEN TIMESTAMP '2026-08-10' WHEN starts_with(l, 'hier') THEN TIMESTAMP '2026-08-09'
WHEN u = 'heure' THEN TIMESTAMP '2026-08-10 05:00:00' - to_hours(n) WHEN u = 'jour' THEN TIMESTAMP '2026-08-10' - to_days(n) WHEN u = 'semaine' THEN TIMESTAMP '2026-08-10' - to_days(n * 7) WHEN u = 'mois' THEN TIMESTAMP '2026-08-10' - to_days(n * 30) WHEN u = 'an' THEN TIMESTAMP '2026-08-10' - to_days(n * 365) END, '%Y-%m-%d') AS day FROM x""",
)
on_texts(
    "dt_englishjobs", Inline("t string", ("August 4",), ("August 20",), ("Dec 31",), ("February 29",), ("4 August",), (None,)), lambda: {"day": parse.month_day(F.col("t"), F.lit("2026-08-10").cast("date"))},
    """SELECT t, strftime(CASE WHEN try_strptime(t || ' 2026', ['%B %d %Y', '%b %d %Y']) <= TIMESTAMP '2026-08-10' THEN try_strptime(t || ' 2026', ['%B %d %Y', '%b %d %Y']) WHEN try_strptime(t || ' 2026', ['%B %d %Y', '%b %d %Y']) IS NOT NULL THEN try_strptime(t || ' 2025', ['%B %d %Y', '%b %d %Y']) END, '%Y-%m-%d') AS day FROM {t}""",
)
on_texts(
    "dt_wwr", Inline("t string", ("Tue, 04 Aug 2026 23:30:00 -0500",), ("4 Aug 2026 10:00:00 +0000",), ("yesterday",), ("",), (None,)), lambda: {"day": parse.mail_date(F.col("t"))},
    "SELECT t, strftime(try_strptime(regexp_extract(t, '([0-9]{1,2} [A-Za-z]{3} [0-9]{4})', 1), '%d %b %Y'), '%Y-%m-%d') AS day FROM {t}",
)
on_texts(
    "dt_remoteok", Inline("t string, epoch string", ("2026-08-04T12:00:00+00:00", None), ("", "1785801600"), (None, "0"), ("x", "soon")), lambda: {"day": parse.iso_or_epoch(F.col("t"), F.col("epoch"))},
    "SELECT t, CASE WHEN regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN substr(t, 1, 10) ELSE strftime(make_timestamp(try_cast(epoch AS BIGINT) * 1000000), '%Y-%m-%d') END AS day FROM {t}",
)
on_texts(
    "dt_hiringcafe", Inline("t string", ("2026-08-04T12:00:00Z",), ("2026-08-04",), ("",), (None,)), lambda: {"day": parse.before_t(F.col("t"))},
    "SELECT t, nullif(CASE WHEN contains(t, 'T') THEN substr(t, 1, 10) ELSE t END, '') AS day FROM {t}",
)


@query("SELECT run_id, board, strftime(run_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H%M%SZ') AS stamp FROM run_manifest")
def dt_stamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_manifest").select("run_id", "board", parse.run_stamp(F.col("run_at")).alias("stamp"))


_DAYS = "CAST(first_seen_at AT TIME ZONE 'UTC' AS DATE)"


@query(f"SELECT DISTINCT id, CAST(week({_DAYS}) AS INT) AS iso_week, CAST(month({_DAYS}) AS INT) AS month, CAST(quarter({_DAYS}) AS INT) AS quarter, CAST(year({_DAYS}) AS INT) AS year FROM jobs WHERE first_seen_at IS NOT NULL")
def dt_parts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("first_seen_at")
    return table(spark, d, "jobs").where(c.isNotNull()).select("id", F.weekofyear(c).alias("iso_week"), F.month(c).alias("month"), F.quarter(c).alias("quarter"), F.year(c).alias("year")).distinct()


@query(f"SELECT DISTINCT id, CAST(date_trunc('week', {_DAYS}) AS DATE) AS week_start FROM jobs WHERE first_seen_at IS NOT NULL")
def dt_trunc_week(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("first_seen_at is not null").select("id", F.to_date(F.date_trunc("week", "first_seen_at")).alias("week_start")).distinct()


@query(f"SELECT DISTINCT id, CAST(datediff('day', {_DAYS}, CAST(last_seen_at AT TIME ZONE 'UTC' AS DATE)) AS INT) AS days FROM jobs")
def dt_diff_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", F.datediff("last_seen_at", "first_seen_at").alias("days")).distinct()


# -- strings

on_texts(
    "str_split_company", Inline("t string", ("Acme: Data Engineer",), ("No colon",), (": Title",), ("Firm: ",), ("A: B: C",), ("",)), lambda: {"company": text.company_of_title(F.col("t")), "title": text.title_without_company(F.col("t"))},
    """WITH x AS (SELECT t, strpos(t, ': ') AS pos FROM {t}), y AS (SELECT t, pos > 0 AND trim(substr(t, 1, pos - 1)) <> '' AND trim(substr(t, pos + 2)) <> '' AS two, pos FROM x)
SELECT t, CASE WHEN two THEN trim(substr(t, 1, pos - 1)) END AS company, CASE WHEN two THEN trim(substr(t, pos + 2)) ELSE trim(t) END AS title FROM y""",
)
_HTML = Inline("t string", ("<p>A &amp; B</p><b> c</b>",), ("plain",), ("",), ("<ul><li>one</li>\n<li>two <i>x</i></li></ul>",), (None,))
on_texts("str_html_text", _HTML, lambda: {"plain": html_text.html_text(F.col("t"))}, "SELECT t, trim(regexp_replace(replace(regexp_replace(coalesce(t, ''), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS plain FROM {t}")
on_texts(
    "txt_duration", Inline("t string", ("CDD - 6 mois",), ("1 an",), ("12 MOIS renouvelable",), ("sans",), (None,)), lambda: {"duration": text.duration_fr(F.col("t"))},
    "SELECT t, CASE WHEN regexp_matches(t, '(?i)[0-9]+\\s*(mois|an)') THEN regexp_extract(t, '(?i)([0-9]+)\\s*(mois|an)', 1) || ' ' || lower(regexp_extract(t, '(?i)([0-9]+)\\s*(mois|an)', 2)) END AS duration FROM {t}",
)
on_texts(
    "txt_workplace_fr", Inline("t string", ("Télétravail partiel",), ("Télétravail complet",), ("télétravail occasionnel",), ("Full remote",), ("Sur site",), ("Télétravail",), (None,)), lambda: {"place": text.workplace_fr(F.col("t"))},
    "SELECT t, CASE WHEN regexp_matches(lower(t), 'télétravail|remote|distanciel') AND regexp_matches(lower(t), 'partiel|occasionnel|hybride') THEN 'hybrid' WHEN regexp_matches(lower(t), 'télétravail|remote|distanciel') AND regexp_matches(lower(t), 'complet|total|full remote|100%') THEN 'remote' END AS place FROM {t}",
)


FULL = "'full_time'"


def _case(column: str, lookup: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lookup.items()) + f" ELSE {other} END"


@query(f"SELECT DISTINCT contracttype, {_case('contracttype', normalize.FARUSE['contract'])} AS contract FROM raw_faruse")
def txt_map_contract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_faruse").select("contracttype", text.mapped(F.col("contracttype"), normalize.FARUSE["contract"]).alias("contract")).distinct()


_CATEGORIES = Inline("t string", ("Full-Stack Programming",), (" Data Science ",), ("DevOps and Sysadmin",), ("Design",), ("",), (None,))
on_texts("txt_map_role", _CATEGORIES, lambda: {"role": text.mapped(F.lower(F.trim(F.col("t"))), normalize.WWR["role"])}, f"SELECT t, {_case('lower(trim(t))', normalize.WWR['role'])} AS role FROM {{t}}")
on_texts(
    "map_contract", Inline("k bigint, labels array<string>", (1, ["Contractor", "Permanent"]), (2, ["Permanent", "odd"]), (3, []), (4, None), (5, ["fixed-term", "contractor"])),
    lambda: {"kinds": F.concat_ws("|", text.mapped_list(F.transform("labels", lambda x: F.lower(x)), normalize.FREEWORK["contract"], "full_time"))},
    f"WITH x AS (SELECT k, unnest(labels) AS l, generate_subscripts(labels, 1) AS i FROM {{t}}), y AS (SELECT k, {_case('lower(l)', normalize.FREEWORK['contract'], FULL)} AS c, min(i) AS i FROM x GROUP BY 1, 2), z AS (SELECT k, string_agg(c, '|' ORDER BY i) AS kinds FROM y GROUP BY 1) SELECT t.k, coalesce(kinds, '') AS kinds FROM {{t}} t LEFT JOIN z ON t.k = z.k",
)
on_texts(
    "dedup_list", Inline("k bigint, words array<string>", (1, ["a", "b", "a", "c", "b"]), (2, []), (3, None)), lambda: {"once": F.array_join(F.array_distinct("words"), ",")},
    "WITH x AS (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM {t}), y AS (SELECT k, w, min(i) AS i FROM x GROUP BY 1, 2), z AS (SELECT k, string_agg(w, ',' ORDER BY i) AS once FROM y GROUP BY 1) SELECT t.k, CASE WHEN t.words IS NOT NULL THEN coalesce(once, '') END AS once FROM {t} t LEFT JOIN z ON t.k = z.k",
)


@query("SELECT DISTINCT org_type, CASE WHEN lower(org_type) IN ('public', 'private', 'startup', 'consulting_firm', 'enterprise') THEN lower(org_type) ELSE 'unknown' END AS kind FROM dim_company")
def map_company_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dim_company").select("org_type", normalize.company_type(F.col("org_type")).alias("kind")).distinct()


@query("SELECT DISTINCT jobid FROM raw_faruse WHERE contains(lower(concat_ws(' ', title, sector, worktype)), 'data engineer')")
def pred_wwr_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_faruse").where(text.holds_query(F.concat_ws(" ", "title", "sector", "worktype"), " Data Engineer ")).select("jobid").distinct()


# Word borders written out, so that they mean the same beside an accent in both engines: a letter of any alphabet, a digit or a low line is part of a word.
def _words_sql(column: str, words: tuple[str, ...]) -> str:
    alternatives = "|".join("".join("\\" + c if c in "+#.-/*?()[]{}^$|\\" else c for c in w) for w in words).replace("'", "''")
    return f"regexp_matches({column}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:{alternatives})($|[^\\p{{L}}\\p{{N}}_])')"


@query("SELECT doc_id, concat_ws('|', " + ", ".join(f"CASE WHEN {_words_sql('text', w)} THEN '{k}' END" for k, w in text.CONTRACT_WORDS.items()) + ") AS contracts FROM documents")
def txt_contracts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws("|", text.contracts(F.col("text"))).alias("contracts"))


_TAGS = "lower(array_to_string(coalesce(technologies, []), ' '))"


# Of the wanted tags those that end in a mark stand before a word border only where a letter follows.
@query(f"SELECT id FROM jobs WHERE NOT {_words_sql(_TAGS, text.NOISE_TAGS)} AND ({_words_sql(_TAGS, tuple(t for t in text.REQUIRED_TAGS if t not in ('c#', 'c++')))} OR regexp_matches({_TAGS}, '(^|[^\\p{{L}}\\p{{N}}_])(c#|c\\+\\+)[\\p{{L}}\\p{{N}}_]'))")
def pred_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where(text.has_required_tag(F.col("technologies"))).select("id")


_TERMS = ("Apache Airflow", "dbt", "SQL", "Kafka", "Python", "Terraform")


def _term_sql(column: str, term: str) -> str:
    return _words_sql(column, (term, *([w for w in term.split() if len(w) >= 3] if " " in term else [])))


@query("SELECT doc_id, " + ", ".join(f"coalesce({_term_sql('text', t)}, FALSE) AS t{k}" for k, t in enumerate(_TERMS)) + " FROM documents")
def txt_term_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[text.term_matches(F.col("text"), t).alias(f"t{k}") for k, t in enumerate(_TERMS)])


@query("SELECT doc_id, (" + " + ".join(f"coalesce({_term_sql('text', t)}, FALSE)::INT" for t in _TERMS) + f") / {len(_TERMS)}.0::DOUBLE AS relevance FROM documents")
def txt_jd_relevance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.relevance(F.col("text"), list(_TERMS)).alias("relevance"))


_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
on_texts(
    "txt_impact", Inline("t string", ("Reduced cost by 40% across enterprise",), ("Built 3 services",), ("Saved $20,000 and 30% and 5x and 12%",), ("Led a team",), ("nothing",), ("",)), lambda: {"impact": F.round(text.impact(F.col("t")), 4)},
    f"""SELECT t, round(least(least(len(regexp_extract_all(t, '\\b[0-9][0-9,]*%|\\$[0-9][0-9,]*|\\b[0-9][0-9,]*[xX]\\b')), 3) * 0.30 + (len(list_intersect(regexp_extract_all(lower(t), '[a-z]+'), {_LIST(text.STRONG_VERBS)})) > 0)::INT * 0.25
+ (len(list_intersect(regexp_extract_all(lower(t), '[a-z]+'), {_LIST(text.SCALE_WORDS)})) > 0)::INT * 0.20, 1.0), 4)::DOUBLE AS impact FROM {{t}}""",
)


@query(f"SELECT doc_id, len(list_filter(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9+#.-]*'), lambda w: len(w) >= 3)), lambda w: NOT list_contains({_LIST(text.STOP_WORDS)}, w)))::BIGINT AS words FROM documents")
def txt_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.size(text.significant_words(F.coalesce(F.col("text"), F.lit("")))), F.lit(0)).cast("bigint").alias("words"))


_SKILLS = Inline("k bigint, mine string, theirs string", (1, "Python, SQL; dbt", "python; SQL"), (2, "k8s, Docker", "Kubernetes"), (3, "", "x"), (4, "Rust,, Rust ;Go", "go"))
_SPLIT = "list_filter(list_distinct(list_transform(string_split_regex({c}, '[,;]+'), lambda x: lower(trim(x)))), lambda x: x <> '')"
on_texts("txt_skill_tokens", _SKILLS, lambda: {"tokens": F.array_join(F.array_sort(text.skill_tokens(F.col("mine"))), ",")}, f"SELECT k, array_to_string(list_sort({_SPLIT.format(c='mine')}), ',') AS tokens FROM {{t}}")
on_texts(
    "set_diff_skills", _SKILLS, lambda: {"added": F.array_join(F.array_sort(tailor.new_skills(F.col("mine"), F.col("theirs"))), ",")},
    f"SELECT k, array_to_string(list_sort(list_filter({_SPLIT.format(c='mine')}, lambda s: NOT list_contains({_SPLIT.format(c='theirs')}, s) AND NOT list_contains(['k8s', 'gh', 'ci', 'cd'], s))), ',') AS added FROM {{t}}",
)
on_texts(
    "txt_jd_terms", Inline("k bigint, t string", (1, "# Job\n## Technologies\n- Python\n- n/a\n## Other\n- x\n## Competencies\n- Lead teams"), (2, "no sections"), (3, "")), lambda: {"terms": F.concat_ws("|", text.jd_terms(F.col("t")))},
    """WITH x AS (SELECT k, unnest(string_split(t, '\n')) AS l, generate_subscripts(string_split(t, '\n'), 1) AS i FROM {t}), y AS (SELECT *, count(*) FILTER (WHERE starts_with(l, '## ')) OVER (PARTITION BY k ORDER BY i) AS s FROM x),
z AS (SELECT *, max(CASE WHEN starts_with(l, '## ') THEN lower(trim(substr(l, 4))) END) OVER (PARTITION BY k, s) AS head FROM y) SELECT t.k, coalesce(string_agg(trim(substr(trim(l), 3)), '|' ORDER BY i), '') AS terms FROM {t} t LEFT JOIN z ON t.k = z.k AND head IN ('technologies', 'competencies') AND starts_with(trim(l), '- ') AND lower(trim(substr(trim(l), 3))) <> 'n/a' GROUP BY 1""",
)
on_texts(
    "txt_extract_json", Inline("k bigint, t string", (1, 'Here: ```json\n{"a": 1}\n``` done'), (2, 'x {"b": {"c": 2}} y'), (3, "none"), (4, "")), lambda: {"body": text.fenced_json(F.col("t"))},
    """SELECT k, CASE WHEN contains(t, '```') THEN regexp_extract(t, '```(?:json)?\\s*(\\{[^`]*\\})\\s*```', 1) WHEN strpos(t, '{') > 0 THEN substr(t, strpos(t, '{'), len(t) - strpos(reverse(t), '}') + 2 - strpos(t, '{')) ELSE t END AS body FROM {t}""",
)
on_texts(
    "txt_fabricated_metric", Inline("k bigint, t string, master string", (1, "Cut cost by 40% and saved $500", "saved $500 once"), (2, "Improved by 3x from 10 to 20", "from 10 to 20"), (3, "no claim 77", "")),
    lambda: {"figures": F.concat_ws(",", F.array_sort(tailor.claimed_figures(F.col("t"), F.col("master"))))},
    "SELECT k, CASE k WHEN 1 THEN '40' WHEN 2 THEN '3' ELSE '' END AS figures FROM {t}",
)
on_texts(
    "txt_seq_ratio", Inline("a string, b string", ("abcd", "abcd"), ("abcd", "bcde"), ("", ""), ("abc", "xyz"), ("data engineer", "date engineer")), lambda: {"ratio": F.round(tailor.sequence_ratio("a", "b"), 6)},
    # Twice the characters of the matching blocks over all characters: 4, 3, none, none, 12 of 13.
    "SELECT a, round(CASE WHEN a = b THEN 1.0 ELSE 2.0 * CASE a WHEN 'abcd' THEN 3 WHEN 'abc' THEN 0 ELSE 12 END / (len(a) + len(b)) END, 6)::DOUBLE AS ratio FROM {t}",
)
on_texts(
    "txt_reworded", Inline("k bigint, skill string, advert string", (1, "data modelling", "we model data daily"), (2, "kubernetes", "docker and linux"), (3, "pipelines", "a pipeline for all")),
    lambda: {"like": tailor.reworded(text.significant_words(F.col("skill")), text.significant_words(F.col("advert")))}, "SELECT k, k <> 2 AS like FROM {t}".replace(" like ", ' "like" '),
)


def _audit(spark: SparkSession, d: str) -> DataFrame:
    master = spark.createDataFrame([(0, "Acme"), (1, "Beta")], "pos int, company string")
    tailored = spark.createDataFrame([(0, "Acme"), (1, "Gamma"), (2, "Delta")], "pos int, company string")
    texts = spark.createDataFrame([(1, "Python, Rust, Kafka", "Python", "python and airflow", "We use Kafka", "Cut cost by 30%")], "key int, tailored string, master_skills string, master_text string, advert string, content string")
    return tailor.audit(master, tailored, texts)


register("txt_audit", _audit, "SELECT * FROM (VALUES ('hard', 'rust'), ('advert', 'kafka'), ('hard', 'figure 30'), ('hard', 'employer Beta -> Gamma'), ('hard', 'roles 2 -> 3')) AS v(verdict, what)")
register("join_zip", lambda s, d: tailor.employer_drift(s.createDataFrame([(0, "A"), (1, "B")], "pos int, company string"), s.createDataFrame([(0, "A"), (1, "C")], "pos int, company string")), "SELECT 1 AS pos, 'B' AS expected, 'C' AS found")
register("tail_validate", lambda s, d: tailor.count_drift(s.range(2), s.range(3)), "SELECT 2::BIGINT AS expected, 3::BIGINT AS found")

_MASTER = Inline("role bigint, pos bigint, line string", (0, 0, "built pipelines"), (0, 1, "led a team"), (1, 0, "ran reports"), (2, 0, "old work"))
_TAILORED = Inline("role bigint, pos bigint, line string", (0, 0, "built 3 pipelines"), (1, 0, None), (7, 0, "invented"))
register("tail_merge", lambda s, d: tailor.merge_roles(_MASTER.df(s), _TAILORED.df(s), cut_empty=True), f"WITH m AS (SELECT * FROM {_MASTER.sql}), t AS (SELECT * FROM {_TAILORED.sql}), l AS (SELECT * FROM t WHERE line IS NOT NULL) SELECT * FROM m WHERE role NOT IN (SELECT role FROM t) UNION ALL SELECT * FROM l WHERE role IN (SELECT role FROM m)")
_LINES = Inline("role bigint, pos bigint, line string", (0, 0, "watched things"), (0, 1, "Led 40% growth"), (0, 2, "dbt work"), (1, 0, "alone"))
register(
    "topk_highlights", lambda s, d: tailor.keep_highlights(_LINES.df(s), s.createDataFrame([(0, "watched things"), (0, "Led 40% growth"), (0, "dbt work"), (1, "alone")], "role bigint, line string"), ["dbt"], k=2).select("role", "pos", "line"),
    # Of three lines the two with impact or a term of the advert stay; a role with fewer lines is untouched.
    f"SELECT role, pos, line FROM {_LINES.sql} WHERE role = 1 OR regexp_matches(line, '%|dbt')",
)


# -- scores


@query(f"""WITH {_STATE}, r AS (SELECT s.*, c.name AS dn, c.org_type AS dorg, c.stock_symbol AS dstock, c.latest_funding_amount_usd AS dfund FROM s LEFT JOIN dim_company c USING (company_id)),
p AS (SELECT *, CASE WHEN salary.is_disclosed THEN coalesce(nullif(salary.min_annual_eur, 0), nullif(salary.max_annual_eur, 0), 0) ELSE 0 END AS lo, CASE WHEN salary.is_disclosed THEN coalesce(nullif(salary.max_annual_eur, 0), nullif(salary.min_annual_eur, 0), 0) ELSE 0 END AS hi,
  string_split(trim(regexp_replace(lower(coalesce(title, '')), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), ' ') AS tw, lower(coalesce(description_text, '')) AS body, lower(coalesce(engagement_type, '')) AS eng,
  CASE WHEN len(coalesce(technologies, [])) > 0 THEN list_transform(technologies, lambda t: lower(t)) ELSE string_split(trim(regexp_replace(lower(coalesce(description_text, '')), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), ' ') END AS have, coalesce(nullif(dn, ''), company) AS firm FROM r),
q AS (SELECT *, CASE WHEN lo = 0 THEN 0.3 WHEN (lo + hi) / 2 >= 90000 THEN 1.0 WHEN (lo + hi) / 2 >= 75000 THEN 0.8 WHEN (lo + hi) / 2 >= 60000 THEN 0.6 WHEN (lo + hi) / 2 >= 50000 THEN 0.4 WHEN (lo + hi) / 2 >= 40000 THEN 0.2 ELSE 0.1 END::DOUBLE AS pay,
  least(0.5 + CASE lower(workplace_type) WHEN 'remote' THEN 0.3 WHEN 'hybrid' THEN 0.15 ELSE 0 END + CASE WHEN list_contains(contract_types, 'contract') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(contract_duration), 'month|mois') THEN 0.1 ELSE 0 END, 1.0)::DOUBLE AS flexibility,
  greatest(0.5 - CASE WHEN len(list_intersect(tw, {_LIST(score.HEAVY_TITLE)})) > 0 THEN 0.25 ELSE 0 END + CASE WHEN len(list_intersect(tw, {_LIST(score.LIGHT_TITLE)})) > 0 THEN 0.15 ELSE 0 END
    + CASE WHEN lower(seniority_level) IN ('lead', 'manager') THEN -0.2 WHEN lower(seniority_level) = 'senior' THEN -0.05 WHEN lower(seniority_level) IN ('entry', 'junior') THEN 0.1 ELSE 0 END + CASE lower(role_category) WHEN 'product_manager' THEN -0.15 WHEN 'data_analyst' THEN 0.1 ELSE 0 END
    - CASE WHEN regexp_matches(body, '{"|".join(w.replace("'", "''") for w in score.TEAM_WORDS)}') THEN 0.2 ELSE 0 END - CASE WHEN regexp_matches(body, '{"|".join(score.ALERT_WORDS)}') THEN 0.1 ELSE 0 END, 0.0)::DOUBLE AS low_responsibility,
  len(list_intersect(have, {_LIST(score.HIGH_VALUE)})) AS nh, len(list_intersect(have, {_LIST(score.LEGACY)})) AS nl,
  greatest(least(0.5 + CASE WHEN CASE WHEN eng IN ('direct', 'consulting') THEN eng WHEN regexp_matches(lower(firm), '{"|".join(text.ESN_NAME)}') OR regexp_matches(body, '{"|".join(text.ESN_TEXT)}') THEN 'consulting' ELSE 'direct' END = 'direct' THEN 0.2 ELSE 0 END
    - CASE WHEN lower(posting_company_type) = 'esn' THEN 0.05 ELSE 0 END + CASE lower(dorg) WHEN 'enterprise' THEN 0.1 WHEN 'consulting_firm' THEN -0.1 ELSE 0 END + CASE WHEN coalesce(dstock, '') <> '' OR dfund > 50000000 THEN 0.05 ELSE 0 END, 1.0), 0.0)::DOUBLE AS company_quality FROM p),
z AS (SELECT *, greatest(least((nh - nl * 0.5) / greatest(nh + nl, 4) + 0.5, 1.0), 0.0)::DOUBLE AS tech_match FROM q)
SELECT id, source_board, round(pay, 6) AS pay, round(flexibility, 6) AS flexibility, round(low_responsibility, 6) AS low_responsibility, round(tech_match, 6) AS tech_match, round(company_quality, 6) AS company_quality,
  round(pay * 0.30 + flexibility * 0.25 + low_responsibility * 0.20 + tech_match * 0.15 + company_quality * 0.10, 6) AS overall FROM z""")
def score_full(spark: SparkSession, d: str) -> DataFrame:
    rows = score.scored(files.with_company(state(spark, d), table(spark, d, "dim_company")), "dim")
    total = sum((F.col(f"scores.{n}") * w for n, w in score.WEIGHTS.items()), F.lit(0.0))
    return rows.select("id", "source_board", *[F.round(f"scores.{n}", 6).alias(n) for n in score.WEIGHTS], F.round(total, 6).alias("overall"))


for _name in ("flexibility", "low_responsibility", "tech_match", "company_quality"):
    _id = {"low_responsibility": "score_low_resp", "tech_match": "score_tech", "company_quality": "score_company"}.get(_name, f"score_{_name}")
    register(_id, lambda s, d, n=_name: score_full(s, d).select("id", "source_board", n), f"SELECT id, source_board, {_name} FROM ({SQL['score_full']})")


@query(f"WITH {_STATE} SELECT id, source_board, overall_score, CASE WHEN overall_score >= 0.70 THEN 'top' WHEN overall_score >= 0.60 THEN 'high' WHEN overall_score >= 0.50 THEN 'medium' ELSE 'low' END AS tier FROM s WHERE overall_score IS NOT NULL")
def score_overall(spark: SparkSession, d: str) -> DataFrame:
    return state(spark, d).where("overall_score is not null").select("id", "source_board", "overall_score", score.tier(F.col("overall_score")).alias("tier"))


# -- views, sinks, state


@query(f"WITH {_STATE} SELECT 'tier' AS kind, coalesce(recommendation_tier, '?') AS value, count(*) AS jobs FROM s GROUP BY 2 UNION ALL SELECT 'sector', coalesce(end_client_sector, 'unknown'), count(*) FROM s GROUP BY 2")
def agg_tier_sector_summary(spark: SparkSession, d: str) -> DataFrame:
    return gold.summary(state(spark, d))


@query(f"WITH {_STATE}, t AS (SELECT 'tier' AS kind, coalesce(recommendation_tier, '?') AS value FROM s UNION ALL SELECT 'sector', coalesce(end_client_sector, 'unknown') FROM s) SELECT kind, value, count(*) AS jobs FROM t GROUP BY 1, 2 HAVING count(*) > 1")
def sink_summary(spark: SparkSession, d: str) -> DataFrame:
    return gold.summary(state(spark, d)).where("jobs > 1")


@query(f"WITH {_STATE} SELECT id, source_board, row_number() OVER (ORDER BY overall_score DESC, id, source_board) AS place FROM s WHERE is_active AND overall_score IS NOT NULL")
def sort_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The order of the ranking, as a place; a total order, so one range-partitioned sort and one number a row."""
    from pyspark.sql import Window

    rows = gold.ranked(state(spark, d), table(spark, d, "dim_company"))
    return rows.select("id", "source_board", F.row_number().over(Window.orderBy(F.desc("overall_score"), "id", "source_board")).cast("bigint").alias("place"))


@query(f"WITH {_STATE} SELECT id, source_board, row_number() OVER (ORDER BY coalesce(overall_score, 0) DESC, id, source_board) AS place FROM s WHERE is_active")
def sort_scored(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = state(spark, d).where("is_active")
    return rows.select("id", "source_board", F.row_number().over(Window.orderBy(F.desc(F.coalesce("overall_score", F.lit(0.0))), "id", "source_board")).cast("bigint").alias("place"))


def _flat_sql(columns: dict[str, str], dim: bool) -> str:
    out = []
    for name, src in columns.items():
        src = src.replace("dim.", "c.") if dim else "s." + src
        src = src if src.startswith(("c.", "s.")) else "s." + src
        lists = name in ("contract_types", "technologies", "competencies", "company_industry")
        out.append(f"coalesce(array_to_string({src}, '|'), '') AS {name}" if lists else f"{src} AS {name}")
    return ", ".join(out)


@query(f"WITH {_STATE} SELECT s.id AS id, {_flat_sql(files.RANKED_COLUMNS, True)} FROM s LEFT JOIN dim_company c USING (company_id) WHERE is_active")
def sink_ranked_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = files.with_company(state(spark, d).where("is_active"), table(spark, d, "dim_company"))
    return files.flatten(rows, {"id": "id", **files.RANKED_COLUMNS})


@query(f"WITH {_STATE} SELECT {_flat_sql(files.BOARD_COLUMNS, False)} FROM s WHERE source_board = 'hiringcafe'")
def sink_board_csv(spark: SparkSession, d: str) -> DataFrame:
    return files.board_export(state(spark, d).where("source_board = 'hiringcafe'"))


_LEGACY = {"scores_pay": "scores.pay", "scores_flexibility": "scores.flexibility", "scores_low_responsibility": "scores.low_responsibility", "scores_tech_match": "scores.tech_match", "scores_company_quality": "scores.company_quality"}


@query(f"WITH {_STATE} SELECT " + ", ".join("coalesce(array_to_string(contract_types, ' | '), '') AS contract_types" if c == "contract_types" else f"NULL::VARCHAR AS {c}" if c in ("pay", "rate", "remote_type", "location", "duration", "url") else f"{_LEGACY.get(c, c)} AS {c}" for c in files.LEGACY_COLUMNS) + " FROM s WHERE source_board = 'freework'")
def sink_legacy_csv(spark: SparkSession, d: str) -> DataFrame:
    return files.legacy_export(state(spark, d).where("source_board = 'freework'"))


_NESTED = "c.display_name AS name, array_to_string(coalesce(c.industry, []), '|') AS industry, c.size_employees, c.year_founded, c.hq_country, c.org_type, c.stock_symbol, c.stock_exchange, c.latest_funding_type, c.latest_funding_amount_usd, c.homepage_url"


def _nested(x: DataFrame) -> DataFrame:
    fields = ("size_employees", "year_founded", "hq_country", "org_type", "stock_symbol", "stock_exchange", "latest_funding_type", "latest_funding_amount_usd", "homepage_url")
    return x.select("id", "source_board", "title", "description_text", F.col("company_info.name").alias("name"), F.array_join("company_info.industry", "|").alias("industry"), *[F.col(f"company_info.{f}").alias(f) for f in fields])


@query(f"WITH {_STATE} SELECT s.id, s.source_board, s.title, s.description_text, {_NESTED} FROM s LEFT JOIN dim_company c USING (company_id) WHERE is_active")
def sink_merged_json(spark: SparkSession, d: str) -> DataFrame:
    return _nested(files.nested_export(state(spark, d), table(spark, d, "dim_company")))


@query(f"WITH {_STATE} SELECT s.id, s.source_board, s.title, s.description_text, {_NESTED} FROM s LEFT JOIN dim_company c USING (company_id) WHERE is_active AND s.source_board = 'freework'")
def sink_freework_json(spark: SparkSession, d: str) -> DataFrame:
    return _nested(files.freework_export(state(spark, d), table(spark, d, "dim_company")))


@query(f"WITH {_STATE} SELECT s.id, s.source_board, c.display_name AS name, c.hq_country FROM s LEFT JOIN dim_company c USING (company_id) WHERE s.source_board = 'freework' AND s.views >= 10")
def src_table(spark: SparkSession, d: str) -> DataFrame:
    rows = files.fetch(state(spark, d), ["id", "source_board"], "source_board = 'freework' and views >= 10", [F.col("id")], table(spark, d, "dim_company"))
    return rows.select("id", "source_board", "company_info.name", "company_info.hq_country")


@query(f"WITH {_STATE} SELECT s.id, s.source_board, c.display_name IS NOT NULL AS known, c.size_employees FROM s LEFT JOIN dim_company c USING (company_id)")
def join_company_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = files.fetch(state(spark, d), ["id", "source_board"], "true", None, table(spark, d, "dim_company"))
    return rows.select("id", "source_board", F.col("company_info.name").isNotNull().alias("known"), "company_info.size_employees")


_FIELDS = ("hq_country", "org_type", "size_employees", "year_founded", "stock_symbol", "stock_exchange", "latest_funding_type", "latest_funding_amount_usd", "homepage_url", "name")


@query(f"WITH {_STATE}, t AS (SELECT *, coalesce(last_seen_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS seen FROM s) SELECT company_id, " + ", ".join(f"max(seen) FILTER (WHERE company_info.{f} IS NOT NULL) IS NOT NULL AS has_{f}" for f in _FIELDS)
       + ", " + ", ".join(f"CASE WHEN count(DISTINCT company_info.{f}) = 1 THEN max(company_info.{f}) END AS only_{f}" for f in ("hq_country", "org_type", "homepage_url")) + " FROM t GROUP BY 1")
def agg_merge_company(spark: SparkSession, d: str) -> DataFrame:
    """Of each firm which fields have a value, and the merged values of fields of which its listings know only one."""
    s = state(spark, d)
    shown = [f for f in _FIELDS if f != "name"]
    m = silver.merge_companies(s)
    ones = s.groupBy(F.coalesce("company_id", F.lit("")).alias("key")).agg(*[F.when(F.count_distinct(f"company_info.{f}") == 1, True).alias(f"one_{f}") for f in ("hq_country", "org_type", "homepage_url")], F.count("company_info.name").alias("names"))
    j = m.withColumn("key", F.coalesce("company_id", F.lit(""))).join(ones, "key")
    return j.select("company_id", *[F.col(f).isNotNull().alias(f"has_{f}") for f in shown], (F.col("names") > 0).alias("has_name"), *[F.when(F.col(f"one_{f}"), F.col(f)).alias(f"only_{f}") for f in ("hq_country", "org_type", "homepage_url")])


_RUNS = Inline("id string, source_board string, first_seen_run string, last_seen_run string, is_active boolean", ("j1", "b", "r1", "r1", False), ("j2", "b", "r1", "r2", True), ("j3", "b", "r2", "r2", True), ("j4", "b", "r0", "r0", False))
register("view_disappeared", lambda s, d: gold.gone_since(_RUNS.df(s), "r1").select("id", "source_board"), f"SELECT id, source_board FROM {_RUNS.sql} WHERE last_seen_run = 'r1' AND NOT is_active")


@query("SELECT jobid AS id, first(title ORDER BY title) AS title, count(*) AS times FROM raw_faruse WHERE jobid IS NOT NULL GROUP BY 1")
def dml_dup_rule(spark: SparkSession, d: str) -> DataFrame:
    """Of repeated keys in a batch the first row by the given order counts whole."""
    r = table(spark, d, "raw_faruse").where("jobid is not null").select(F.col("jobid").alias("id"), "title")
    times = r.groupBy("id").agg(F.count("*").alias("times"))
    return silver.first_row(r, ["id"], [F.coalesce("title", F.lit("\uffff"))]).join(times, "id")


register("dml_ensure_dims", lambda s, d: silver.dim_board(s).select("board_id", "main_language"), "SELECT board_id, main_language FROM dim_board WHERE board_id IN (" + ", ".join(f"'{b}'" for b in BOARDS) + ")")


@query("SELECT id, NULL::VARCHAR AS remote_policy, title FROM jobs")
def dml_ensure_table(spark: SparkSession, d: str) -> DataFrame:
    batch = spark.createDataFrame([], "id string, remote_policy string, company_info string")
    return silver.ensure_columns(table(spark, d, "jobs").drop("company_info"), batch).select("id", "remote_policy", "title")


@query(f"""WITH {_STATE} SELECT id, source_board, CASE WHEN coalesce(nullif(company_info.name, ''), nullif(company, '')) IS NOT NULL
THEN substr(sha1(source_board || '|' || trim(regexp_replace(lower(coalesce(nullif(company_info.name, ''), company)), '\\s+', ' ', 'g'))), 1, 16) ELSE company_id END AS company_id FROM s""")
def dml_migrate_ci(spark: SparkSession, d: str) -> DataFrame:
    return silver.migrate_company_info(state(spark, d))[0].select("id", "source_board", "company_id")


@query(f"""WITH {_STATE} SELECT count(*) AS firms FROM (SELECT DISTINCT source_board, trim(regexp_replace(lower(coalesce(nullif(company_info.name, ''), company)), '\\s+', ' ', 'g')) AS n FROM s WHERE coalesce(nullif(company_info.name, ''), nullif(company, '')) IS NOT NULL)""")
def dml_migrate_firms(spark: SparkSession, d: str) -> DataFrame:
    return silver.migrate_company_info(state(spark, d))[1].agg(F.count("*").alias("firms"))


# -- the stages that ask a model, with a stand-in that answers by rule


def _shout() -> enrich.Client:
    return lambda r: None if r["description_text"].startswith("X") else {"description_text": r["description_text"].upper()}


_STAGE_JOBS = Inline("id string, source_board string, description_text string, description_language string, is_active boolean", ("1", "b", "bonjour", "fr", True), ("2", "b", "hello", "en", True), ("3", "b", "Xno", "fr", True), ("4", "b", "salut", "fr", False), ("5", "b", None, "fr", True))
register("llm_translate", lambda s, d: enrich.stage(_STAGE_JOBS.df(s), "translate", _shout).select("id", "description_text", "description_language"),
         f"SELECT id, CASE WHEN id = '1' THEN upper(description_text) ELSE description_text END AS description_text, CASE WHEN id = '1' THEN 'en' ELSE description_language END AS description_language FROM {_STAGE_JOBS.sql}")


@query(f"WITH {_STATE} SELECT id, source_board, CASE WHEN is_active AND technologies IS NULL THEN 'stub' ELSE coalesce(array_to_string(technologies, '|'), '?') END AS technologies, CASE WHEN is_active AND technologies IS NULL THEN 'mid' ELSE seniority_level END AS seniority_level FROM s")
def llm_tech(spark: SparkSession, d: str) -> DataFrame:
    done = enrich.stage(state(spark, d), "tech", lambda: lambda r: {"technologies": ["stub"], "competencies": [], "seniority_level": "mid", "role_category": "other"})
    return done.select("id", "source_board", F.coalesce(F.array_join("technologies", "|"), F.lit("?")).alias("technologies"), "seniority_level")


@query(f"WITH {_STATE} SELECT id, source_board, CASE WHEN is_active AND source_board <> 'hiringcafe' AND engagement_type IS NULL THEN 'direct' ELSE engagement_type END AS engagement_type FROM s")
def llm_classify(spark: SparkSession, d: str) -> DataFrame:
    done = enrich.stage(state(spark, d), "classify", lambda: lambda r: {"posting_company_type": "end_client", "end_client_name": None, "end_client_sector": None, "engagement_type": "direct"})
    return done.select("id", "source_board", "engagement_type")


@query("SELECT company_id, CASE WHEN source_board <> 'hiringcafe' AND org_type IS NULL THEN CASE WHEN starts_with(name, 'a') THEN 'public' ELSE 'unknown' END ELSE org_type END AS org_type FROM dim_company")
def llm_company(spark: SparkSession, d: str) -> DataFrame:
    return enrich.research_companies(table(spark, d, "dim_company"), lambda: lambda r: {"org_type": "Public" if r["name"].startswith("a") else "co-op"}).select("company_id", "org_type")


@query(f"WITH {_STATE} SELECT id, source_board, coalesce(CASE WHEN title LIKE 'S%' THEN 'S' ELSE role_category END, '?') AS role_category FROM s")
def join_update(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    done = silver.write_back(s, s.where("title like 'S%'").select("id", "source_board", F.lit("S").alias("role_category")), ["role_category"])
    return done.select("id", "source_board", F.coalesce("role_category", F.lit("?")).alias("role_category"))


@query(f"WITH {_STATE} SELECT id, source_board, CASE WHEN is_active AND overall_score IS NULL THEN TRUE ELSE overall_score IS NOT NULL END AS scored FROM s")
def dml_apply_scores(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    return silver.write_back(s, score.scored(silver.gate(s, "score")), ["scores", "overall_score", "recommendation_tier"]).select("id", "source_board", F.col("overall_score").isNotNull().alias("scored"))


@query(f"WITH {_STATE} SELECT id, source_board, CASE WHEN is_active AND source_board <> 'hiringcafe' AND engagement_type IS NULL AND length(coalesce(company, '')) > 12 THEN 'consulting' ELSE engagement_type END AS engagement_type FROM s")
def dml_apply_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Only rows that got an answer are written back; the others stay pending."""
    answer = lambda r: {"engagement_type": "consulting"} if len(r["company"] or "") > 12 else None
    return enrich.stage(state(spark, d), "classify", lambda: answer).select("id", "source_board", "engagement_type")


_CALLS = Inline("items bigint, t_in bigint, t_out bigint", (100, 1500, 300), (0, 1, 1), (7, 0, 1000))
register("agg_cost", lambda s, d: _CALLS.df(s).select("items", F.round(F.col("items") * (F.col("t_in") * 0.27 + F.col("t_out") * 1.1) / 1e6, 8).alias("cost")), f"SELECT items, round(items * (t_in * 0.27 + t_out * 1.1) / 1000000, 8)::DOUBLE AS cost FROM {_CALLS.sql}")


def _refusing(spark: SparkSession, d: str) -> DataFrame:
    """How many calls a request takes whose first answers are refused: three tries for 429 and 5xx, one for other faults."""
    out = []
    for name, statuses in (("fine", []), ("busy once", [429]), ("down twice", [500, 503]), ("always busy", [429] * 9), ("bad request", [400])):
        left, calls = list(statuses), []

        def client(request: dict, left=left, calls=calls) -> dict:
            calls.append(1)
            if left:
                raise enrich.Refused(left.pop(0))
            return {"ok": True}

        try:
            done = enrich.patient(client, enrich.Patience(per_minute=1e9), sleep=lambda x: None)({}) is not None
        except enrich.Refused:
            done = False
        out.append((name, len(calls), done))
    return spark.createDataFrame(out, "request string, calls int, answered boolean")


register("llm_client", _refusing, "SELECT * FROM (VALUES ('fine', 1, TRUE), ('busy once', 2, TRUE), ('down twice', 3, TRUE), ('always busy', 3, FALSE), ('bad request', 1, FALSE)) AS v(request, calls, answered)")


# -- sources: stored pages and answers given inline, and what a reader of the board finds in them

_CARD = """<div class="rounded-lg shadow x"><div class="p-4"><div><span>Contractor</span><span>Permanent</span><span>Contractor</span></div><h2><a href="/en/job-mission/1">Data Engineer</a></h2>
<div class="-mt-3"><span>Python</span><span>SQL</span><span>Python</span><span>+3</span><span>04/08/2026</span></div><div class="gap-4"><b>Acme</b><p>Build</p><p>pipelines</p><i>View this job</i><u>no</u></div></div>
<a href="/en/job-mission/1">Start dateAs soon as possibleDuration1 yearRate400-550 €LocationParis</a></div><p>1 / 8</p>"""
_PAGES = Inline("page bigint, html string", (1, _CARD), (2, "<h2>Nothing</h2>"), (3, None))
register("src_freework", lambda s, d: boards.freework(_PAGES.df(s)).select("page", "title", "url", "company", F.array_join("skills", "|").alias("skills"), "date_posted", "description"),
         "SELECT 1::BIGINT AS page, 'Data Engineer' AS title, 'https://www.free-work.com/en/job-mission/1' AS url, 'Acme' AS company, 'Python|SQL' AS skills, '04/08/2026' AS date_posted, 'Build pipelines' AS description")
register("src_freework_details", lambda s, d: boards.freework(_PAGES.df(s)).select("start_date", "duration", "pay", "rate", "location"), "SELECT 'As soon as possible' AS start_date, '1 year' AS duration, NULL::VARCHAR AS pay, '400-550 €' AS rate, 'Paris' AS location")
register("src_freework_badges", lambda s, d: boards.freework(_PAGES.df(s)).select(F.array_join("contract_types", "|").alias("badges")), "SELECT 'Contractor|Permanent' AS badges")
register("src_freework_pages", lambda s, d: _PAGES.df(s).select("page", boards.page_total(F.col("html")).alias("pages")), f"SELECT page, CASE WHEN html LIKE '%1 / 8%' THEN 8 ELSE 1 END AS pages FROM {_PAGES.sql}")
_HITS = [("a", "X"), ("b", "Y"), ("a", "Z"), (None, "W")]
register("src_hiringcafe", lambda s, d: boards.hiringcafe(s.createDataFrame([(1, _HITS[:2]), (2, _HITS[2:])], "page int, hits array<struct<objectID:string,title:string>>")).select("objectID", "title"), "SELECT * FROM (VALUES ('a', 'X'), ('b', 'Y'), (NULL, 'W')) AS v(objectID, title)")
_HW = """<ul><li data-id-storage-item-id="77"><a data-cy="offerTitle" href="/emplois/77.html"><h3><p>Data Analyst</p><p>Beta</p></h3></a><div data-cy="localisationCard">Lyon</div><div data-cy="contractCard">CDI</div><span data-cy="contractTag">45 000 € - 60 000 €</span>
<span data-cy="contractTag">Télétravail partiel</span><span data-cy="contractTag">6 mois</span><div class="typo-s text-grey-500">il y a 2 jours</div></li><li>ad</li></ul><button name="p" value="2"></button><button name="p" value="9"></button>"""
_HWP = Inline("page bigint, html string", (1, _HW), (2, "<p>page 1 sur 35</p>"))
register("src_hellowork", lambda s, d: boards.hellowork(_HWP.df(s)).select("id", "title", "company", "location", "contract", "workplace", "salary", "duration", "date_posted", "url"),
         "SELECT '77' AS id, 'Data Analyst' AS title, 'Beta' AS company, 'Lyon' AS location, 'CDI' AS contract, 'Télétravail partiel' AS workplace, '45 000 € - 60 000 €' AS salary, '6 mois' AS duration, 'il y a 2 jours' AS date_posted, 'https://www.hellowork.com/emplois/77.html' AS url")
register("src_hellowork_pages", lambda s, d: _HWP.df(s).select("page", boards.button_pages(F.col("html")).alias("pages")), f"SELECT page, CASE page WHEN 1 THEN 9 ELSE 35 END AS pages FROM {_HWP.sql}")
_LD = Inline("k bigint, html string", (1, '<script type="application/ld+json">[{"@type":"X"},{"@type":"JobPosting","description":"<p>Hi <b>you</b></p>"}]</script>'), (2, '<script type="application/ld+json">{bad</script>'), (3, None))
on_texts("src_jsonld", _LD, lambda: {"body": html_text.job_posting_text(F.col("html"))}, "SELECT k, CASE WHEN k = 1 THEN 'Hi you' END AS body FROM {t}")
_EJ = '<div class="job" id="e1"><h3>Nurse</h3><a class="js-joblink" href="/clickout/1">go</a><ul><li>August 4</li><li>Clinic</li><li>Paris</li></ul><div class="text-gray-400">Freelance role, hybrid</div></div><div class="job" id="e1"><h3>Again</h3><a class="js-joblink" href="/c">x</a></div>'
register("src_englishjobs", lambda s, d: boards.englishjobs(s.createDataFrame([(1, _EJ)], "page int, html string")).select("id", "title", "company", "location", "date_posted", "description"), "SELECT 'e1' AS id, 'Nurse' AS title, 'Clinic' AS company, 'Paris' AS location, 'August 4' AS date_posted, 'Freelance role, hybrid' AS description")


@query("SELECT jobid, min(title) AS title FROM raw_faruse WHERE coalesce(title, '') <> '' AND jobid IS NOT NULL GROUP BY 1")
def src_faruse(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_faruse").withColumn("page", F.lit(1)).withColumn("ordinal", F.col("title"))
    return boards.faruse(r).where("jobid is not null").select("jobid", "title")


_FEED = Inline("page bigint, ordinal bigint, title string, link string, category string, skills string", (1, 0, "Acme: Data Engineer", "u/1", "Data", "sql"), (1, 1, "Beta: Cook", "u/2", "Food", None), (1, 2, "Acme: Data Again", "u/1", "Data", None), (2, 0, None, "u/3", "Data", None), (2, 1, "Gamma: Data Cook", None, None, None))
register("src_wwr", lambda s, d: boards.wwr(_FEED.df(s), "data").select("title", "link"), f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page, ordinal) AS n FROM {_FEED.sql} WHERE coalesce(title, '') <> '') SELECT title, link FROM t WHERE (n = 1 OR link IS NULL) AND contains(lower(concat_ws(' ', title, category, skills)), 'data')")
_ROK = Inline("ordinal bigint, id string, position string, tags array<string>, description string, location string", (0, None, None, None, "legal", None), (1, "9", "Data Engineer", ["python"], "x", "Paris"), (2, "9", "Copy", ["python"], "x", "Paris"), (3, "8", "Recruiter", ["python", "payroll"], "", "Paris"), (4, "7", "Data Engineer", ["cooking"], "", "Paris"), (5, "6", "Data Engineer", ["sql"], "", "Rome"))
register("src_remoteok", lambda s, d: boards.remoteok(_ROK.df(s), "data", "paris").select("id", "position"), "SELECT '9' AS id, 'Data Engineer' AS position")
_DSJ = '<div class="card-grid"><h4><a href="/jobs/42/">ML Engineer</a></h4><a class="name-job">Acme</a><span class="location-small"> Paris ,, France</span><a href="/jobs/42/apply/">Apply</a><span class="card-briefcase">Full Time</span><a class="badge">Python</a><span class="card-text-price">$90,000</span></div>'
_DSD = '<script type="application/ld+json">{"@type":"JobPosting","datePosted":"2026-08-01","description":"Long"}</script><div class="sidebar-text-info">Job level <b>Senior</b></div>'


def _dsj(spark: SparkSession, d: str) -> DataFrame:
    rows = boards.datasciencejobs(spark.createDataFrame([(1, _DSJ)], "page int, html string"), spark.createDataFrame([("https://datasciencejobs.com/jobs/42/", _DSD)], "detail_url string, html string"))
    return rows.select("id", "title", "company", "location", "contract_raw", F.array_join("skills", "|").alias("skills"), "salary_text", "date_posted", "description", "job_level", "apply_url")


register("src_datasciencejobs", _dsj, "SELECT '42' AS id, 'ML Engineer' AS title, 'Acme' AS company, 'Paris ,, France' AS location, 'full time' AS contract_raw, 'Python' AS skills, '$90,000' AS salary_text, '2026-08-01' AS date_posted, 'Long' AS description, 'Senior' AS job_level, 'https://datasciencejobs.com/jobs/42/apply/' AS apply_url")
_CSV_COLS = [*files.RANKED_COLUMNS]
_CSV = [dict(overall_score="0.62", source_board="", title="T", company="Acme", apply_url="https://x/1/", salary_min_annual_eur="50000", contract_types="contract|full_time", technologies="", years_experience_min="3.0", company_type="", scores_pay="0.6"),
        dict(overall_score="", source_board="wwr", title="U", company="", apply_url="https://x/2", salary_min_annual_eur="", technologies="Python|dbt"), dict(apply_url="", title="V")]


def _prior(spark: SparkSession, d: str) -> DataFrame:
    csv = spark.createDataFrame([tuple(r.get(c, "") for c in _CSV_COLS) for r in _CSV], ", ".join(f"{c} string" for c in _CSV_COLS))
    known = spark.createDataFrame([("old", "https://x/1", 1), ("new", "https://x/1", 2)], "id string, apply_url string, at int")
    r = files.from_flat(csv, known, "at")
    return r.select("id", "source_board", "title", F.col("salary.min_annual_eur").alias("low"), F.col("salary.is_disclosed").alias("told"), F.array_join("contract_types", "|").alias("contracts"), F.array_join("technologies", "|").alias("technologies"), "years_experience_min", F.col("company_info.org_type").alias("org"), "overall_score")


register("src_prior_csv", _prior, "SELECT * FROM (VALUES ('new', 'freework', 'T', 50000.0::DOUBLE, TRUE, 'contract|full_time', '', 3::BIGINT, 'unknown', 0.62::DOUBLE), ('https://x/2', 'wwr', 'U', NULL, FALSE, '', 'Python|dbt', NULL, 'unknown', NULL)) AS v(id, source_board, title, low, told, contracts, technologies, years_experience_min, org, overall_score)")


@query("WITH k AS (SELECT rtrim(apply_url, '/') AS u, max(id) AS id FROM jobs WHERE apply_url IS NOT NULL GROUP BY 1) SELECT DISTINCT applyurl, coalesce(k.id, rtrim(applyurl, '/')) AS id FROM raw_faruse LEFT JOIN k ON rtrim(applyurl, '/') = k.u WHERE applyurl <> ''")
def join_url_adopt(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_faruse").where("applyurl <> ''").select("applyurl", F.col("applyurl").alias("apply_url"))
    return files.adopt_ids(r, table(spark, d, "jobs").where("apply_url is not null").select("id", "apply_url")).select("applyurl", "id").distinct()


# -- raw records to canonical listings

_SHOWN = ("id", "source_board", "title", "company", "workplace_type", "date_posted", "seniority_level", "role_category", "description_text", "description_language", "engagement_type")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_SHOWN, F.col("salary.min_annual_eur").alias("low"), F.array_join("contract_types", "|").alias("contracts"), F.array_join("technologies", "|").alias("technologies"), F.col("company_info.name").alias("firm"), F.col("company_info.org_type").alias("org"))


def _norm(name: str, fields: str, row: tuple, run, want: tuple) -> None:
    lit = lambda v: "NULL" if v is None else str(v) + "::DOUBLE" if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"
    cols = (*_SHOWN, "low", "contracts", "technologies", "firm", "org")
    register(name, lambda s, d: _shown(run(s.createDataFrame([row], fields))), "SELECT " + ", ".join(f"{lit(v)} AS {c}" for c, v in zip(cols, want)))


_norm("norm_freework", "url string, title string, company string, remote_type string, date_posted string, pay string, contract_types array<string>, seniority_level string, role_category string, skills array<string>, description string, description_en string",
      ("https://f/1", "Data Engineer", "Acme", "Hybrid", "8/4/2026", "40k-75k €", ["Contractor", "Permanent"], "Intermediate", "devops_data", ["Python"], "bonjour", "hello"), normalize.freework,
      ("https://f/1", "freework", "Data Engineer", "Acme", "hybrid", "2026-08-04", "mid", "devops_engineer", "hello", "en", None, 40000.0, "contract|full_time", "Python", "Acme", None))
_norm("norm_hiringcafe", "objectID string, apply_url string, v5_processed_job_data struct<company_name:string,workplace_type:string,estimated_publish_date:string,yearly_min_compensation:double,commitment:array<string>,seniority_level:string,job_category:string,technical_tools:array<string>,requirements_summary:string>, job_information struct<title:string>, enriched_company_data struct<name:string,organization_type:string>",
      ("o1", "u", ("Acme", "Remote", "2026-08-04T00:00:00Z", 100000.0, ["Full Time", "Contract"], "Senior Level", "Data and Analytics", ["dbt"], "needs sql"), ("Engineer",), ("Acme Inc", "private")), normalize.hiringcafe,
      ("o1", "hiringcafe", "Engineer", "Acme", "remote", "2026-08-04", "senior", "data_engineer", "needs sql", "en", "direct", 92000.0, "full_time|contract", "dbt", "Acme Inc", "private"))
_norm("norm_hellowork", "id string, title string, company string, contract string, workplace string, date_posted string, salary string, description string",
      ("77", "Analyste", "Beta", "CDD", "Télétravail partiel", "il y a 2 jours", "45 000 € - 60 000 €", "texte"), lambda r: normalize.hellowork(r, F.lit("2026-08-10 05:00:00").cast("timestamp")),
      ("77", "hellowork", "Analyste", "Beta", "hybrid", "2026-08-08", None, None, "texte", "fr", "unknown", 45000.0, "temporary", "", "Beta", "unknown"))
_norm("norm_englishjobs", "id string, title string, company string, date_posted string, details string, description string", ("e1", "Nurse", "Clinic", "August 4", "Clinic Freelance role, hybrid", "Freelance role, hybrid"), lambda r: normalize.englishjobs(r, F.lit("2026-08-10").cast("date")),
      ("e1", "englishjobs", "Nurse", "Clinic", "hybrid", "2026-08-04", None, None, "Freelance role, hybrid", "en", "direct", None, "contract", "", "Clinic", "unknown"))
_norm("norm_wwr", "link string, title string, description string, pubDate string, region string, type string, category string, skills string", ("https://w/jobs/acme-data", "Acme: Data Engineer", "<p>Pay $80,000 - $120,000</p>", "Tue, 04 Aug 2026 23:30:00 -0500", "Anywhere", "Full-Time", "Data Science", "sql, dbt"), normalize.wwr,
      ("acme-data", "wwr", "Data Engineer", "Acme", "remote", "2026-08-04", None, "data_scientist", "Pay $80,000 - $120,000", "en", "unknown", 73600.0, "full_time", "sql|dbt", "Acme", "unknown"))
_norm("norm_remoteok", "id string, position string, company string, tags array<string>, description string, salary_min double, date string, url string", ("9", "Data Engineer", " Acme ", ["python", "cooking"], "<b>Hi</b>", 100000.0, "2026-08-04T12:00:00+00:00", "u"), normalize.remoteok,
      ("9", "remoteok", "Data Engineer", "Acme", "remote", "2026-08-04", None, None, "Hi", "en", "unknown", 92000.0, "", "python", "Acme", "unknown"))
_norm("norm_datasciencejobs", "id string, title string, company string, location string, contract_raw string, job_level string, salary_text string, skills array<string>, date_posted string, description string", ("42", "ML Engineer", "Acme", "Remote, France", "Full Time", "Senior", "$90,000", ["Python"], "2026-08-01", "Long"), normalize.datasciencejobs,
      ("42", "datasciencejobs", "ML Engineer", "Acme", "remote", "2026-08-01", "senior", None, "Long", "en", "direct", 82800.0, "full_time", "Python", "Acme", "unknown"))
_norm("norm_default", "x int", (1,), lambda r: listing(r, "wwr"), ("", "wwr", "", "", None, None, None, None, "", "en", "unknown", None, "", "", "", "unknown"))


def _bronze(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot written, listed in the manifest and read again; in the folder for checkpoints, which all executors share."""
    import uuid

    from ..session import checkpoint_dir

    root = f"{checkpoint_dir(spark)}/bronze-{uuid.uuid4().hex}"
    rows = conform(spark.createDataFrame([("a", "wwr", "T1"), ("b", "wwr", "T2")], "id string, source_board string, title string"))
    files.write_snapshot(rows, root, "wwr", "run1", "2026-08-01T000000Z")
    return files.read_run(spark, root, "run1").select("id", "title", "ordinal")


for _k in ("sink_bronze", "src_bronze_json"):
    register(_k, _bronze, "SELECT * FROM (VALUES ('a', 'T1', 0), ('b', 'T2', 0)) AS v(id, title, ordinal)")
