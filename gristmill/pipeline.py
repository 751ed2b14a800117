"""The stages in order: snapshots, state, scores, views and exports, each a commit to the store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.score import scored
from .functions.text import company_key
from .operators import gold, silver
from .operators.enrich import Client, research_companies, stage
from .schema import CANONICAL, COMPANY, LINEAGE, conform
from .sources.files import Store, nested_export, ranked_export, read_run, with_company

STATE = {k: t for k, t in {**CANONICAL, **LINEAGE}.items() if k != "company_info"}


@dataclass
class Config:
    """Where things are and when it is; nothing inside reads a clock."""

    root: str
    run_id: str
    now: str
    use_company_rows: bool = True


def ensure(spark: SparkSession, store: Store) -> None:
    """Empty tables where there are none yet."""
    for name, fields in (("jobs", STATE), ("companies", COMPANY), ("dates", {"date_id": "string", "iso_week": "int", "month": "int", "quarter": "int", "year": "int"})):
        if not store.version(name):
            store.write(name, conform(spark.createDataFrame([], "_ int"), fields, keep_extra=False))
    if not store.version("boards"):
        store.write("boards", silver.dim_board(spark))


def to_silver(spark: SparkSession, store: Store, cfg: Config, batch: DataFrame | None = None, full_replace: bool = False) -> DataFrame:
    """One run into the state: companies, listings, deactivation of what the run has not seen, dates."""
    ensure(spark, store)
    batch = read_run(spark, cfg.root, cfg.run_id) if batch is None else batch
    batch = conform(batch)
    store.write("companies", silver.upsert_companies(store.read("companies"), silver.company_rows(batch)))
    firm = F.coalesce(F.nullif(F.trim("company_info.name"), F.lit("")), F.col("company"))
    rows = batch.withColumn("company_id", company_key(firm, F.col("source_board"))).drop("company_info")
    # The first row of a key counts: files in the order of the manifest.
    order = [F.col("ordinal")] if "ordinal" in rows.columns else None
    state = silver.upsert(store.read("jobs"), rows, cfg.run_id, cfg.now, full_replace, order)
    store.write("jobs", silver.deactivate(state, cfg.run_id))
    store.write("dates", silver.dim_date(store.read("jobs"), store.read("dates")))
    return store.read("jobs")


def score(store: Store, cfg: Config) -> DataFrame:
    """Scores of the listings that wait for one; with the rows of their firms unless switched off."""
    jobs = silver.reset_stale(store.read("jobs"), "score")
    due = silver.gate(jobs, "score")
    due = scored(with_company(due, store.read("companies")), "dim") if cfg.use_company_rows else scored(due)
    store.write("jobs", silver.write_back(jobs, due, ["scores", "overall_score", "recommendation_tier"]))
    return store.read("jobs")


def enrich(store: Store, cfg: Config, clients: dict[str, Callable[[], Client]]) -> DataFrame:
    """The stages for which there is a client, in order, each written back; then what is complete is marked."""
    for name in ("translate", "tech", "classify"):
        if name in clients:
            store.write("jobs", stage(silver.reset_stale(store.read("jobs"), name), name, clients[name]))
    if "company" in clients:
        store.write("companies", research_companies(silver.reset_stale(store.read("companies"), "company"), clients["company"]))
    store.write("jobs", silver.mark_enriched(store.read("jobs"), cfg.now))
    return store.read("jobs")


def views(store: Store) -> dict[str, DataFrame]:
    """The gold views, registered for SQL under gold_<name>."""
    jobs, companies = store.read("jobs"), store.read("companies")
    run = gold.run_name(jobs)
    out = {
        "ranked": gold.ranked(jobs, companies), "by_sector": gold.active_by(jobs, "end_client_sector"), "by_tier": gold.active_by(jobs, "recommendation_tier"), "history": gold.history(jobs),
        "weekly_snapshot": gold.weekly(jobs), "new_this_run": gold.new_in_run(jobs, run) if run else jobs.limit(0), "disappeared_this_run": gold.gone_since(jobs, gold.run_name(jobs, before=run) if run else None),
    }
    for name, df in out.items():
        df.createOrReplaceTempView(f"gold_{name}")
    return out


def export(store: Store, path: str) -> None:
    """The ranked flat export and the nested one, as folders of parts in order: a file a partition, none gathered."""
    jobs, companies = store.read("jobs"), store.read("companies")
    ranked_export(jobs, companies).write.mode("overwrite").option("header", True).csv(f"{path}/jobs_ranked")
    nested_export(jobs, companies).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/jobs_merged")


def run(spark: SparkSession, store: Store, cfg: Config, batch: DataFrame | None = None) -> dict[str, DataFrame]:
    """All stages of a run."""
    to_silver(spark, store, cfg, batch)
    score(store, cfg)
    out = views(store)
    export(store, f"{cfg.root}/exports")
    return out
