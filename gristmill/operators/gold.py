"""Read views over the state: ranking, counts, history, weekly activity, differences between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def ranked(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Active scored listings with the kind and stock symbol of their firm. The join side is chosen at run time by its size."""
    dim = companies.select("company_id", F.col("org_type").alias("company_type"), F.col("stock_symbol").alias("company_stock_symbol"))
    return jobs.where("is_active and overall_score is not null").join(dim, "company_id", "left")


def top(df: DataFrame, k: int = 10) -> DataFrame:
    """The k best, ties by key: a partial sort a partition, never a full one."""
    return df.orderBy(F.desc("overall_score"), "id", "source_board").limit(k)


def active_by(jobs: DataFrame, column: str, alias: str = "jobs") -> DataFrame:
    """Active listings by a column, NULL a group of its own."""
    return jobs.where("is_active").groupBy(column).agg(F.count("*").alias(alias))


def history(jobs: DataFrame) -> DataFrame:
    """Lineage of each listing and the days between its first and last sighting, counted by dates."""
    return jobs.select("id", "source_board", "title", "company", "first_seen_run", "last_seen_run", "is_active", F.datediff("last_seen_at", "first_seen_at").alias("days_active"))


def weekly(jobs: DataFrame) -> DataFrame:
    """`week_start, active_jobs`: listings alive in each week in which some listing was first or last seen.

    As weeks start on Mondays, a listing is alive from the week of its first sighting to that of its last, or on if it is active. Instead of an
    inequality join, a listing adds one at its first week and takes one off after its last; running sums over the weeks give the counts. What is
    shuffled is one row a week and task.
    """
    week = lambda c: F.to_date(F.date_trunc("week", c))
    lives = jobs.where("first_seen_at is not null").select(week("first_seen_at").alias("a"), week("last_seen_at").alias("b"), "is_active")
    lives = lives.where("is_active or b is not null").where("is_active or b >= a")
    starts = lives.groupBy(F.col("a").alias("w")).agg(F.count("*").alias("n"))
    ends = lives.where("not is_active").groupBy(F.date_add("b", 7).alias("w")).agg((-F.count("*")).alias("n"))
    seen = jobs.select(week("first_seen_at").alias("w")).distinct().unionByName(jobs.select(week("last_seen_at").alias("w")).distinct()).where("w is not null").distinct().withColumn("seen", F.lit(True))
    steps = starts.unionByName(ends).groupBy("w").agg(F.sum("n").alias("n")).join(seen, "w", "full")
    # One row a week: years of data are some hundreds of rows.
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("w").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("active_jobs", running).where("seen and active_jobs > 0").select(F.col("w").alias("week_start"), "active_jobs")


def latest_run(jobs: DataFrame, before: str | None = None) -> DataFrame:
    """`run_id, seen_at` of the run seen last, or of the last other than `before`; ties by name."""
    runs = jobs.where("last_seen_run is not null").groupBy(F.col("last_seen_run").alias("run_id")).agg(F.max("last_seen_at").alias("seen_at"))
    if before is not None:
        runs = runs.where(F.col("run_id") != before)
    return runs.orderBy(F.desc("seen_at"), F.desc("run_id")).limit(1)


def run_name(jobs: DataFrame, before: str | None = None) -> str | None:
    row = latest_run(jobs, before).first()
    return row["run_id"] if row else None


def new_in_run(jobs: DataFrame, run_id: str) -> DataFrame:
    return jobs.where(F.col("first_seen_run") == run_id)


def gone_since(jobs: DataFrame, previous: str | None) -> DataFrame:
    """Listings that the previous run saw last; none if there was no previous run."""
    return jobs.where((F.col("last_seen_run") == previous) & ~F.col("is_active")) if previous else jobs.limit(0)


def totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("is_active")).alias("active"), F.count_if(F.col("is_active") & F.col("enriched_at").isNull()).alias("pending"))


def company_profile(jobs: DataFrame) -> DataFrame:
    """Listings, distinct sectors and mean minimum pay of each firm."""
    return jobs.groupBy("company_id").agg(F.count("*").alias("jobs"), F.count_distinct("end_client_sector").alias("sectors"), F.round(F.avg("salary.min_annual_eur"), 2).alias("mean_min_pay"))


def research_targets(jobs: DataFrame) -> DataFrame:
    """Listings by whom they are for: the end client, else the firm, else unknown."""
    who = F.coalesce(F.nullif(F.trim("end_client_name"), F.lit("")), F.nullif(F.trim("company"), F.lit("")), F.lit("unknown"))
    return jobs.groupBy(who.alias("target")).agg(F.count("*").alias("jobs"))


def price_change(prices: DataFrame) -> DataFrame:
    """Of `prices(symbol, day, close)`: first and last by day, highest and lowest, and the change in percent to one place."""
    by = prices.where("close is not null").groupBy("symbol").agg(F.min_by("close", "day").alias("first"), F.max_by("close", "day").alias("last"), F.max("close").alias("high"), F.min("close").alias("low"))
    return by.withColumn("change", F.round((F.col("last") / F.nullif(F.col("first"), F.lit(0.0)) - 1) * 100, 1))


def summary(jobs: DataFrame) -> DataFrame:
    """`kind, value, jobs`: listings by tier and by sector, no sector as unknown, no tier as '?'."""
    by = lambda kind, c, none: jobs.groupBy(F.lit(kind).alias("kind"), F.coalesce(F.col(c), F.lit(none)).alias("value")).agg(F.count("*").alias("jobs"))
    return by("tier", "recommendation_tier", "?").unionByName(by("sector", "end_client_sector", "unknown"))
