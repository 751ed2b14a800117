"""Warehouse state: upserts with run lineage, dimension upkeep, enrichment gates. Every operator is DataFrame to DataFrame.

An upsert is one full outer join on the key with a policy a column. Both sides are hash-partitioned by the key once; a source batch is
reduced to its first row a key before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.parse import iso_guarded
from ..functions.text import company_key, company_name_key
from ..schema import COMPANY

KEY = ("id", "source_board")
ENRICHMENT_VERSION = 2
# The boards with their names, main languages and addresses.
BOARD_ROWS = {
    "freework": ("Free-Work", "fr", "https://www.free-work.com"),
    "hiringcafe": ("HiringCafe", "en", "https://www.hiringcafe.com"),
    "hellowork": ("HelloWork", "fr", "https://www.hellowork.com"),
    "englishjobs": ("EnglishJobs", "en", "https://www.englishjobs.com"),
    "faruse": ("Faruse", "en", "https://www.faruse.com"),
    "wwr": ("We Work Remotely", "en", "https://weworkremotely.com"),
    "remoteok": ("RemoteOK", "en", "https://remoteok.com"),
    "datasciencejobs": ("DataScienceJobs", "en", "https://datasciencejobs.com"),
}
GATES = {
    "translate": "is_active AND description_language = 'fr' AND TRIM(description_text) <> ''",
    "tech": "is_active AND technologies IS NULL",
    "classify": "is_active AND source_board <> 'hiringcafe' AND engagement_type IS NULL",
    "score": "is_active AND overall_score IS NULL",
    "dim_company": "source_board <> 'hiringcafe' AND org_type IS NULL",
}
DONE = "NOT (description_language = 'fr' AND TRIM(description_text) <> '') AND technologies IS NOT NULL AND (source_board = 'hiringcafe' OR engagement_type IS NOT NULL)"


def gate(df: DataFrame, stage: str) -> DataFrame:
    """Rows a stage has still to work on, in three-valued logic: an unknown condition selects nothing."""
    return df.where(F.expr(GATES[stage]))


def first_by(df: DataFrame, keys: tuple[str, ...] | list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order. Ties in the order must be ties in the rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def first_row(df: DataFrame, keys: tuple[str, ...] | list[str], order: list[Column] | None = None) -> DataFrame:
    """The first row of each key by the columns of `order`, ascending, then by the hash of the whole row; an aggregate, so that repetitions go map-side."""
    by = F.struct(*(order or []), F.xxhash64(*df.columns))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), by).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, run_id: str, now: str, full_replace: bool = False, order: list[Column] | None = None) -> DataFrame:
    """State after a run. A new key comes in whole, first and last seen now; a known one keeps its content and is seen again.

    With `full_replace` a known key takes the new content but for its key, first sighting and creation, and waits for enrichment again.
    Repeated keys in the batch count once, the first by `order`, which is that of arrival if given; ties go by a hash of the row.
    """
    state = [c for c in old.columns if c not in KEY]
    content = [c for c in state if c in new.columns and c not in ("first_seen_run", "first_seen_at", "last_seen_run", "last_seen_at", "is_active", "enriched_at", "enrichment_version", "created_at", "updated_at")]
    batch = first_row(new, KEY, order).select(*KEY, *[F.col(c).alias(f"n_{c}") for c in content], F.lit(True).alias("_new"))
    have = old.withColumn("_old", F.lit(True))
    both = have.join(batch, list(KEY), "full")
    fresh, again, at = F.col("_old").isNull(), F.col("_new").isNotNull(), F.lit(now).cast("timestamp")
    seen = lambda c, value, kept: F.when(again, value).otherwise(kept).alias(c)
    out = {
        "first_seen_run": F.when(fresh, F.lit(run_id)).otherwise(F.col("first_seen_run")), "first_seen_at": F.when(fresh, at).otherwise(F.col("first_seen_at")),
        "last_seen_run": seen("last_seen_run", F.lit(run_id), F.col("last_seen_run")), "last_seen_at": seen("last_seen_at", at, F.col("last_seen_at")),
        "is_active": seen("is_active", F.lit(True), F.col("is_active")), "updated_at": seen("updated_at", at, F.col("updated_at")),
        "created_at": F.when(fresh, at).otherwise(F.col("created_at")), "enrichment_version": F.when(fresh, F.lit(ENRICHMENT_VERSION)).otherwise(F.col("enrichment_version")),
        "enriched_at": F.when(again & F.lit(full_replace), F.lit(None)).otherwise(F.col("enriched_at")),
    }
    for c in content:
        out[c] = F.when(fresh | (again & F.lit(full_replace)), F.col(f"n_{c}")).otherwise(F.col(c))
    return both.select(*KEY, *[out.get(c, F.col(c)).alias(c) for c in state])


def upsert_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Dimension after a run: new values fill and replace, NULLs never do; board, enrichment time and version of a known row stay."""
    fields = [c for c in COMPANY if c != "company_id"]
    batch = first_row(new, ["company_id"])
    batch = batch.select("company_id", *[(F.col(c) if c in new.columns else F.lit(None).cast(COMPANY[c])).alias(f"n_{c}") for c in fields], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(batch, "company_id", "full")
    fresh = F.col("_old").isNull()
    kept = ("source_board", "enriched_at", "enrichment_version")
    pick = lambda c: F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c) if c in kept else F.coalesce(f"n_{c}", c))
    return both.select("company_id", *[pick(c).cast(COMPANY[c]).alias(c) for c in fields])


def company_rows(jobs: DataFrame) -> DataFrame:
    """Dimension rows of a batch of listings, one a firm and board; listings without a firm give none."""
    ci = lambda c: F.col(f"company_info.{c}")
    name = F.coalesce(F.nullif(F.trim(ci("name")), F.lit("")), F.col("company"))
    rows = jobs.where(company_name_key(name) != "").select(
        company_key(name, F.col("source_board")).alias("company_id"), company_name_key(name).alias("name"), F.trim(name).alias("display_name"), "source_board",
        *[ci(c).alias(c) for c in COMPANY if c not in ("company_id", "name", "display_name", "source_board", "enriched_at", "enrichment_version")],
    )
    return first_row(rows, ["company_id"])


def merge_companies(jobs: DataFrame, floor: str = "1970-01-01 00:00:00") -> DataFrame:
    """Per company and field the newest value that is not NULL; rows without a time are the oldest. One aggregate, combined map-side."""
    fields = [c for c in COMPANY if c not in ("company_id", "name", "display_name", "source_board", "enriched_at", "enrichment_version")]
    at = F.coalesce("last_seen_at", F.lit(floor).cast("timestamp"))
    # Ties in time go to the smaller key, so that the result does not depend on the order of rows.
    newest = lambda c: F.max(F.when(F.col(f"company_info.{c}").isNotNull(), F.struct(at.alias("t"), F.xxhash64("id", "source_board").alias("k"), F.col(f"company_info.{c}").alias("v"))))["v"].alias(c)
    return jobs.groupBy("company_id").agg(*[newest(c) for c in fields])


def deactivate(df: DataFrame, run_id: str, boards: list[str] | None = None) -> DataFrame:
    """Rows that a run has not seen are active no more; `boards` limits that to boards the run covered."""
    gone = F.col("is_active") & (F.col("last_seen_run") != run_id)
    if boards is not None:
        gone = gone & F.col("source_board").isin(boards)
    return df.withColumn("is_active", F.when(F.coalesce(gone, F.lit(False)), False).otherwise(F.col("is_active")))


def mark_enriched(df: DataFrame, now: str, keep_scores: bool = False, run_id: str | None = None, version: int = ENRICHMENT_VERSION) -> DataFrame:
    """Rows with nothing left to do are marked; their score is due again unless kept."""
    done = F.col("enriched_at").isNull() & F.expr(DONE)
    if run_id is not None:
        done = done & (F.col("last_seen_run") == run_id)
    done = F.coalesce(done, F.lit(False))
    df = df.withColumn("_done", done)
    df = df.withColumn("enriched_at", F.when(F.col("_done"), F.lit(now).cast("timestamp")).otherwise(F.col("enriched_at"))).withColumn("enrichment_version", F.when(F.col("_done"), version).otherwise(F.col("enrichment_version")))
    if not keep_scores:
        df = df.withColumn("overall_score", F.when(~F.col("_done"), F.col("overall_score")))
    return df.drop("_done")


def reset_stale(df: DataFrame, stage: str, version: int = ENRICHMENT_VERSION, clear_marks: bool = False) -> DataFrame:
    """Results of a stage made by an older version are due again; `clear_marks` also lets such rows be marked anew."""
    stale = F.coalesce(F.col("enrichment_version") < version, F.lit(False))
    direct = stale & F.coalesce(F.col("source_board") != "hiringcafe", F.lit(False))
    undo = lambda d, when, cols: d.withColumns({c: F.when(~when, F.col(c)) for c in cols})
    if stage == "translate":
        text = stale & (F.col("description_language") == "en") & (F.trim("description_text") != "")
        out = df.withColumn("description_language", F.when(F.coalesce(text, F.lit(False)), "fr").otherwise(F.col("description_language")))
    elif stage == "tech":
        out = undo(df, stale, ["technologies", "competencies", "seniority_level", "role_category"])
    elif stage == "classify":
        out = undo(df, direct, ["posting_company_type", "end_client_name", "end_client_sector", "engagement_type"])
    elif stage == "company":
        out = undo(df, direct, ["org_type", "enriched_at"])
    else:
        out = undo(df, stale, ["overall_score"])
    return undo(out, stale, ["enriched_at"]) if clear_marks and stage != "company" else out


def dim_date(jobs: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """`date_id, iso_week, month, quarter, year` of the distinct posting dates; known ones stay as they are."""
    days = jobs.select(iso_guarded(F.col("date_posted")).alias("d")).where("d is not null").distinct()
    new = days.select(F.date_format("d", "yyyy-MM-dd").alias("date_id"), F.weekofyear("d").alias("iso_week"), F.month("d").alias("month"), F.quarter("d").alias("quarter"), F.year("d").alias("year"))
    return new if old is None else old.unionByName(new.join(old.select("date_id"), "date_id", "left_anti"))


def write_back(df: DataFrame, results: DataFrame, columns: list[str], key: tuple[str, ...] = KEY) -> DataFrame:
    """State with the results of a stage; keys without a result stay as they are."""
    got = results.select(*key, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("_got"))
    both = df.join(got, list(key), "left")
    return both.select(*[F.when(F.col("_got"), F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def ensure_columns(df: DataFrame, batch: DataFrame, skip: tuple[str, ...] = ("company_info", "_enrichment", "_source")) -> DataFrame:
    """State with a NULL column for each field of a batch that it lacks; columns it has keep their types."""
    kinds = dict(batch.dtypes)
    return df.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in batch.columns if c not in df.columns and c not in skip])


def dim_board(spark: SparkSession) -> DataFrame:
    """The eight boards."""
    return spark.createDataFrame([(k, *v) for k, v in BOARD_ROWS.items()], "board_id string, display_name string, main_language string, base_url string")


def migrate_company_info(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings with company_id and without company_info, the firms merged from it): for a state that still holds the firm in each listing.

    A listing without any name keeps the company_id it has, or gets NULL. Of each field the newest value that is not NULL counts, the name as the
    newest listing writes it.
    """
    if "company_info" not in jobs.columns:
        return jobs, jobs.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in COMPANY.items()])
    name = F.coalesce(F.nullif(F.col("company_info.name"), F.lit("")), F.nullif(F.col("company"), F.lit("")))
    old = F.col("company_id") if "company_id" in jobs.columns else F.lit(None).cast("string")
    keyed = jobs.withColumn("_name", name).withColumn("company_id", F.when(F.col("_name").isNotNull(), company_key(F.col("_name"), F.col("source_board"))).otherwise(old))
    named = keyed.where("_name is not null")
    at = F.coalesce("last_seen_at", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    newest = named.groupBy("company_id").agg(F.max_by("_name", F.struct(at, F.xxhash64("id", "source_board"))).alias("_last"), F.first("source_board").alias("source_board"))
    merged = merge_companies(named).join(newest, "company_id")
    shown = {"name": company_name_key(F.col("_last")), "display_name": F.trim("_last")}
    firms = merged.select(*[shown.get(c, F.col(c) if c in merged.columns else F.lit(None)).cast(t).alias(c) for c, t in COMPANY.items()])
    return keyed.drop("_name", "company_info"), firms
