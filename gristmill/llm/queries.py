"""Queries of this subpackage's operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, table
from . import entities, langid, mixing, names, neardup, packing, pii, terms, terms_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.map_terms(table(spark, d, "jobs"), table(spark, d, "ref_terms"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs_of_listings(table(spark, d, "jobs"))


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.group_listings(table(spark, d, "jobs"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled_lines(table(spark, d, "jobs"), table(spark, d, "documents"))


@query
def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.text_languages(table(spark, d, "jobs"), table(spark, d, "documents"))


@query
def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.segment_languages(table(spark, d, "jobs"), table(spark, d, "documents"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_data(table(spark, d, "documents"))


@query
def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_texts(table(spark, d, "documents"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "dim_company"))


@query
def p3_organisations(spark: SparkSession, d: str) -> DataFrame:
    return names.organisations(table(spark, d, "dim_company"))


@query
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


@query
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, d))


@query
def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(p8_mixed(spark, d), table(spark, d, "mix_targets"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matched(spark, d).select("id", "jobid")


@query
def p4_matched(spark: SparkSession, d: str) -> DataFrame:
    return entities.matched_openings(table(spark, d, "jobs"), table(spark, d, "raw_faruse"))


@query
def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing: every text with a word is in each kind of container, none is split that fits, and none overflows."""
    packed = p7_packed(spark, d)
    texts = packed.groupBy("container", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    by = texts.groupBy("container").agg(F.count("*").alias("texts"), F.count_if((F.col("n") <= F.col("capacity_tokens")) & (F.col("pieces") > 1)).alias("split"))
    fills = packed.groupBy("container", "capacity_tokens", "container_no").agg(F.sum("n_tokens").alias("n"))
    return by.join(fills.groupBy("container").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull")), "container")


@query
def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a mix: a source misses its share by less than two of the longest records, and uses no record more often than it may."""
    targets, mixed = table(spark, d, "mix_targets"), cut(p8_mixed(spark, d))
    slack = mixed.agg(2 * F.max("n_tokens") / F.sum("n_tokens")).first()[0] or 0.0
    rows = mixing.share_report(mixed, targets).join(targets.select("source", "max_repeats"), "source")
    return rows.select("source", "target_share", (F.abs(F.col("actual_share") - F.col("target_share")) <= slack).alias("near"), (F.col("most_copies") <= F.col("max_repeats")).alias("within"))


@query
def p6_segment_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many segments of each listing are judged."""
    return p6_segments(spark, d).groupBy("id").agg(F.count("*").alias("segments"))


SQL["p1_found"] = terms_sql.mapping_sql()
SQL["p7_whole"] = "SELECT container, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS texts, 0 AS split, 0 AS overfull FROM pack_sizes"
SQL["p8_near"] = "SELECT source, target_share, TRUE AS near, TRUE AS within FROM mix_targets"
SQL["p6_segment_counts"] = """WITH t AS (SELECT DISTINCT id, description_text FROM jobs WHERE id IS NOT NULL AND description_text IS NOT NULL), l AS (SELECT id, unnest(string_split(description_text, chr(10))) AS line FROM t)
SELECT id, count(*) AS segments FROM l WHERE length(trim(line, ' ' || chr(9) || chr(13))) >= 40 GROUP BY 1"""
