"""Files in and out: snapshots with a manifest, versioned state, flat and nested exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import list_cell, number_cell, whole_cell
from ..schema import CANONICAL, company_info, conform, salary, struct_type


def write_snapshot(df: DataFrame, root: str, board: str, run_id: str, stamp: str) -> str:
    """An immutable snapshot of a board and run; a second one under the same name is an error. Returns its path."""
    path = f"{root}/bronze/{board}/{stamp}.json"
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    entry = df.sparkSession.createDataFrame([(run_id, board, stamp, path, df.count())], "run_id string, board string, timestamp string, file string, job_count bigint")
    entry.write.mode("append").parquet(f"{root}/manifest")
    return path


def read_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """All snapshots of a run, with `ordinal`, the place of a file in the manifest; an error if the run has none."""
    entries = spark.read.parquet(f"{root}/manifest").where(F.col("run_id") == run_id).orderBy("timestamp", "board").collect()
    if not entries:
        raise FileNotFoundError(f"no snapshot of run {run_id}")
    out = None
    for k, e in enumerate(entries):
        df = conform(spark.read.schema(struct_type(CANONICAL)).json(e["file"])).withColumn("ordinal", F.lit(k))
        out = df if out is None else out.unionByName(df)
    return out


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds one JSON array of records."""
    return spark.read.option("multiLine", True).json(path)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "item").load(path)


def adopt_ids(csv: DataFrame, known: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of a flat export with the id of the known listing of the same address, else the address itself; rows without either are dropped.

    Of known listings with equal addresses the last by `order` counts, or the greatest id.
    """
    key = lambda c: F.rtrim(F.coalesce(F.col(c), F.lit("")), F.lit("/"))
    last = known.groupBy(key("apply_url").alias("u")).agg((F.max("id") if order is None else F.max_by("id", order)).alias("known_id"))
    return csv.withColumn("u", key("apply_url")).join(last, "u", "left").withColumn("id", F.coalesce("known_id", F.nullif("u", F.lit("")))).where("id is not null").drop("u", "known_id")


def from_flat(csv: DataFrame, known: DataFrame, order: str | None = None) -> DataFrame:
    """Canonical listings of an earlier ranked export (all columns text): ids adopted, lists split, empty cells NULL."""
    col = lambda n: F.nullif(F.col(n), F.lit(""))
    low, high = number_cell(F.col("salary_min_annual_eur")), number_cell(F.col("salary_max_annual_eur"))
    url = F.nullif(F.rtrim("apply_url", F.lit("/")), F.lit(""))
    told = F.coalesce(low != 0, F.lit(False)) | F.coalesce(high != 0, F.lit(False))
    info = company_info(
        F.coalesce("company", F.lit("")), industry=list_cell(F.col("company_industry")), size_employees=whole_cell(F.col("company_size")), year_founded=whole_cell(F.col("company_founded")),
        org_type=F.coalesce(col("company_type"), F.lit("unknown")), stock_symbol=col("company_stock_symbol"),
    )
    cols = {
        "id": F.col("id"), "source_board": F.coalesce(col("source_board"), F.lit("freework")), "source_url": url, "apply_url": url, "salary": salary(low, high, disclosed=told), "company_info": info,
        "contract_types": list_cell(F.col("contract_types")), "technologies": list_cell(F.col("technologies")), "competencies": list_cell(F.col("competencies")), "years_experience_min": whole_cell(F.col("years_experience_min")),
        "description_text": F.lit(""), "scores": F.struct(*[number_cell(F.col(f"scores_{k}")).alias(k) for k in ("pay", "flexibility", "low_responsibility", "tech_match", "company_quality")]), "overall_score": number_cell(F.col("overall_score")),
        **{c: F.coalesce(c, F.lit("")) for c in ("title", "company", "location_raw")},
        **{c: col(c) for c in ("workplace_type", "date_posted", "seniority_level", "role_category", "engagement_type", "posting_company_type", "end_client_name", "end_client_sector", "contract_duration", "recommendation_tier")},
    }
    rows = adopt_ids(csv, known, order)
    return rows.select(*[cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in CANONICAL.items()])


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """`path, text`: files as whole texts."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def fetch(jobs: DataFrame, columns: list[str], where: str, order: list[Column] | None = None, companies: DataFrame | None = None) -> DataFrame:
    """Columns of the listings that a condition selects, in an order if one is given; with `companies`, the firm's row as `company_info`, NULL where there is none."""
    rows = jobs.where(F.expr(where))
    if companies is not None:
        fields = ("industry", "size_employees", "year_founded", "hq_country", "org_type", "stock_symbol", "stock_exchange", "latest_funding_type", "latest_funding_amount_usd", "homepage_url")
        dim = companies.select("company_id", F.struct(F.col("display_name").alias("name"), *fields).alias("company_info"))
        rows = rows.drop("company_info").join(dim, "company_id", "left")
    rows = rows.orderBy(*order) if order else rows
    return rows.select(*columns, *(["company_info"] if companies is not None else []))


class Store:
    """Named tables as parquet versions on any file system Spark can reach. A version counts once its write is committed, so readers never see half a write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return []
        found = [x.getPath() for x in self._fs.listStatus(at)]
        return sorted(int(x.getName()[2:]) for x in found if x.getName().startswith("v=") and self._fs.exists(self._path(x, "_SUCCESS")))

    def version(self, name: str) -> int:
        return max(self.versions(name), default=0)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v={self.version(name)}")

    def write(self, name: str, df: DataFrame) -> int:
        n = self.version(name) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={n}")
        return n

    def forget(self, name: str, keep: int = 2) -> None:
        """Delete all versions but the last `keep`."""
        for n in self.versions(name)[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{name}/v={n}"), True)


# The columns of the ranked flat export, in order.
RANKED_COLUMNS = {
    "overall_score": "overall_score", "recommendation_tier": "recommendation_tier", "source_board": "source_board", "scores_pay": "scores.pay", "scores_flexibility": "scores.flexibility",
    "scores_low_responsibility": "scores.low_responsibility", "scores_tech_match": "scores.tech_match", "scores_company_quality": "scores.company_quality", "title": "title", "company": "company",
    "apply_url": "apply_url", "location_raw": "location_raw", "workplace_type": "workplace_type", "date_posted": "date_posted", "salary_min_annual_eur": "salary.min_annual_eur", "salary_max_annual_eur": "salary.max_annual_eur",
    "seniority_level": "seniority_level", "role_category": "role_category", "years_experience_min": "years_experience_min", "contract_types": "contract_types", "contract_duration": "contract_duration",
    "technologies": "technologies", "competencies": "competencies", "engagement_type": "engagement_type", "posting_company_type": "posting_company_type", "end_client_name": "end_client_name", "end_client_sector": "end_client_sector",
    "company_industry": "dim.industry", "company_size": "dim.size_employees", "company_founded": "dim.year_founded", "company_type": "dim.org_type", "company_stock_symbol": "dim.stock_symbol",
}


def flatten(df: DataFrame, columns: dict[str, str], separator: str = "|") -> DataFrame:
    """Struct fields as columns and lists as joined strings; a NULL list is an empty string."""
    kinds = dict(df.select(*[F.col(src).alias(name) for name, src in columns.items()]).dtypes)
    return df.select(*[(F.concat_ws(separator, src) if kinds[name].startswith("array") else F.col(src)).alias(name) for name, src in columns.items()])


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Listings with their firm's row as the struct `dim`; all its fields NULL where there is none."""
    dim = companies.select("company_id", F.struct(*[c for c in companies.columns if c != "company_id"]).alias("dim"))
    return jobs.join(dim, "company_id", "left")


def ranked_export(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Active listings, flat, best first; no score counts as zero."""
    rows = with_company(jobs.where("is_active"), companies).orderBy(F.desc(F.coalesce("overall_score", F.lit(0.0))), "id", "source_board")
    return flatten(rows, RANKED_COLUMNS)


def nested_export(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Active listings with the company struct rebuilt from the dimension; no industry is an empty list."""
    fields = ("name", "industry", "size_employees", "year_founded", "hq_country", "org_type", "stock_symbol", "stock_exchange", "latest_funding_type", "latest_funding_amount_usd", "homepage_url")
    pick = {"name": F.col("dim.display_name"), "industry": F.coalesce("dim.industry", F.array().cast("array<string>"))}
    return with_company(jobs.where("is_active").drop("company_info"), companies).withColumn("company_info", F.struct(*[pick.get(f, F.col(f"dim.{f}")).alias(f) for f in fields])).drop("dim").orderBy("id", "source_board")


def freework_export(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """The nested export of one board's active listings, by id."""
    return nested_export(jobs.where("source_board = 'freework'"), companies).orderBy("id")


# The columns of a board's flat export, and of the older flat export.
BOARD_COLUMNS = {
    "id": "id", "source_board": "source_board", "title": "title", "company": "company", "apply_url": "apply_url", "location_raw": "location_raw", "workplace_type": "workplace_type", "date_posted": "date_posted",
    "salary_min_annual_eur": "salary.min_annual_eur", "salary_max_annual_eur": "salary.max_annual_eur", "salary_currency_original": "salary.currency_original", "salary_is_disclosed": "salary.is_disclosed",
    "contract_types": "contract_types", "contract_duration": "contract_duration", "seniority_level": "seniority_level", "role_category": "role_category", "years_experience_min": "years_experience_min",
    "technologies": "technologies", "competencies": "competencies", "description_language": "description_language", "company_industry": "company_info.industry", "company_size": "company_info.size_employees",
    "company_founded": "company_info.year_founded", "company_hq_country": "company_info.hq_country", "company_type": "company_info.org_type", "company_stock_symbol": "company_info.stock_symbol",
    "company_funding_type": "company_info.latest_funding_type", "company_funding_amount_usd": "company_info.latest_funding_amount_usd", "engagement_type": "engagement_type", "posting_company_type": "posting_company_type",
    "end_client_name": "end_client_name", "end_client_sector": "end_client_sector", "views": "views", "applications": "applications", "is_expired": "is_expired", "overall_score": "overall_score", "recommendation_tier": "recommendation_tier",
    "scores_pay": "scores.pay", "scores_flexibility": "scores.flexibility", "scores_low_responsibility": "scores.low_responsibility", "scores_tech_match": "scores.tech_match", "scores_company_quality": "scores.company_quality",
}
LEGACY_COLUMNS = (
    "overall_score", "recommendation_tier", "scores_pay", "scores_flexibility", "scores_low_responsibility", "scores_tech_match", "scores_company_quality", "title", "company", "end_client_sector", "end_client_name",
    "engagement_type", "seniority_level", "role_category", "contract_types", "pay", "rate", "remote_type", "location", "duration", "url",
)


def board_export(jobs: DataFrame) -> DataFrame:
    """Listings of a board, flat."""
    return flatten(jobs, BOARD_COLUMNS)


def legacy_export(scored: DataFrame) -> DataFrame:
    """The older flat export of scored raw records; columns they lack are NULL, lists joined by ' | '."""
    have = scored.columns
    of = lambda c: c.replace("scores_", "scores.") if c.startswith("scores_") else c
    return flatten(scored.select("*", *[F.lit(None).cast("string").alias(c) for c in LEGACY_COLUMNS if of(c).split(".")[0] not in have]), {c: of(c) for c in LEGACY_COLUMNS}, " | ")


def write_json_array(df: DataFrame, path: str) -> None:
    """A JSON array file, NULL fields kept: for bounded exports, streamed partition by partition through the driver."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for k, r in enumerate(rows):
            f.write((",\n" if k else "\n") + r["j"])
        f.write("\n]\n")
