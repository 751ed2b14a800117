"""Ranking and audit of résumé lines against a master text and an advert."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import impact, relevance, significant_words, skill_tokens

# Short names of skills, and what a claimed figure looks like.
SKILL_NAMES = {"k8s": "kubernetes", "gh": "github", "ci": "ci/cd", "cd": "ci/cd"}
CLAIMS = (
    r"\bby\s+\d[\d,]*%", r"\bby\s+\$\d[\d,]*", r"\bby\s+\d[\d,]*x\b",
    r"\$\d[\d,]*[KMB]?\b",
    r"\d[\d,]*%\s*(?:of|reduction|improvement|increase|decrease|savings|cut|faster|less)",
    r"\d[\d,]*x\s*(?:faster|improvement|reduction)",
    r"\bby\s+\d[\d,]*\s*(?:hours|days|weeks|months|minutes|seconds)",
    r"reduc(?:ed|ing)\s+\w+\s+by\s+\d+", r"cut\s+\w+\s+by\s+\d+",
    r"sav(?:ed|ing)\s+\$\d+", r"\bfrom\s+\d[\d,]*\s+to\s+\d[\d,]*\b",
)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_ratio(text: pd.Series, others: pd.Series) -> pd.Series:
    """Greatest likeness of a text to any of a list; 0 for an empty list."""
    return pd.Series([max((difflib.SequenceMatcher(None, t or "", o).ratio() for o in (os if os is not None else [])), default=0.0) for t, os in zip(text, others)], dtype="float64")


def keep_highlights(new: DataFrame, master: DataFrame, terms: list[str], k: int = 5, impact_first: bool = True) -> DataFrame:
    """The k best lines of each role: those with a likeness in the master first, then by impact and relevance; all, in order, where there are k or fewer.

    `new(role, pos, line)`, `master(role, line)`.
    """
    known = master.groupBy("role").agg(F.collect_list("line").alias("known"))
    rows = new.join(known, "role", "left").withColumn("overlap", best_ratio("line", F.coalesce("known", F.array().cast("array<string>")))).drop("known")
    rows = rows.withColumn("impact", impact(F.col("line"))).withColumn("relevance", relevance(F.col("line"), terms)).withColumn("n", F.count("*").over(Window.partitionBy("role")))
    by = ["impact", "relevance"] if impact_first else ["relevance", "impact"]
    w = Window.partitionBy("role").orderBy(F.desc(F.col("overlap") > 0), *[F.desc(c) for c in by], F.desc("overlap"), "pos")
    rows = rows.withColumn("rank", F.when(F.col("n") <= k, F.col("pos") + 1).otherwise(F.row_number().over(w)))
    return rows.where((F.col("n") <= k) | (F.col("rank") <= k)).drop("n")


def new_skills(tailored: Column, master: Column) -> Column:
    """Skills named in the tailored text and not in the master's, short names counted as their long ones."""
    short, names = F.array(*[F.lit(k) for k in SKILL_NAMES]), F.create_map(*[F.lit(x) for kv in SKILL_NAMES.items() for x in kv])
    have = skill_tokens(master)
    return F.filter(F.array_except(skill_tokens(tailored), have), lambda s: ~F.array_contains(short, s) & ~F.coalesce(F.array_contains(have, names[s]), F.lit(False)))


@F.pandas_udf(T.BooleanType())
def reworded(skill_words: pd.Series, advert_words: pd.Series) -> pd.Series:
    """Whether half of a skill's words, or its only one, are like some word of the advert."""

    def one(a, b) -> bool:
        a, b = list(a if a is not None else []), list(b if b is not None else [])
        hits = sum(1 for x in a if any(x == y or difflib.SequenceMatcher(None, x, y).ratio() >= 0.6 for y in b))
        return bool(a) and (hits / len(a) >= 0.5 if len(a) > 1 else hits >= 1)

    return pd.Series([one(a, b) for a, b in zip(skill_words, advert_words)])


def claimed_figures(text: Column, master: Column) -> Column:
    """Figures of claims that the master text does not hold."""
    claims = F.regexp_extract_all(text, F.lit(f"(?i)({'|'.join(CLAIMS)})"), 1)
    figures = F.array_distinct(F.flatten(F.transform(claims, lambda c: F.regexp_extract_all(c, F.lit(r"(\d[\d,]*)"), 1))))
    return F.filter(figures, lambda n: ~F.coalesce(master.contains(n), F.lit(False)))


def audit_skills(rows: DataFrame) -> DataFrame:
    """`key, skill, verdict` for `rows(key, tailored, master_skills, master_text, advert)`: each new skill is in the master text (`known`), from the advert
    (`advert`), or made up (`hard`)."""
    each = rows.withColumn("skill", F.explode(new_skills(F.col("tailored"), F.col("master_skills"))))
    like = reworded(significant_words(F.col("skill")), significant_words(F.lower("advert")))
    verdict = F.when(F.lower("master_text").contains(F.col("skill")), "known").when(F.lower("advert").contains(F.col("skill")) | like, "advert").otherwise("hard")
    return each.select("key", "skill", verdict.alias("verdict"))


def merge_roles(master: DataFrame, tailored: DataFrame, cut_empty: bool = False) -> DataFrame:
    """Lines of each role: the tailored ones, or the master's where a role has none; with `cut_empty` a role named without lines is cut.

    `master(role, pos, line)`, `tailored(role, pos, line)`, where a NULL line names a role without lines.
    """
    lines = tailored.where("line is not null")
    cut_roles = tailored.select("role").distinct().join(lines.select("role").distinct(), "role", "left_anti")
    kept = master.join(lines.select("role").distinct(), "role", "left_anti")
    if cut_empty:
        kept = kept.join(cut_roles, "role", "left_anti")
    return kept.select("role", "pos", "line").unionByName(lines.join(master.select("role").distinct(), "role", "left_semi").select("role", "pos", "line"))


def employer_drift(master: DataFrame, tailored: DataFrame) -> DataFrame:
    """`pos, expected, found` of the positions at which the employers differ."""
    a, b = master.select("pos", F.col("company").alias("expected")), tailored.select("pos", F.col("company").alias("found"))
    return a.join(b, "pos", "full").where(~F.col("expected").eqNullSafe(F.col("found")))


def count_drift(master: DataFrame, tailored: DataFrame) -> DataFrame:
    """`expected, found`: one row if the numbers of employers differ, else none."""
    one = lambda df, here: df.select(F.lit(int(here)).alias("m"), F.lit(int(not here)).alias("t"))
    return one(master, True).unionByName(one(tailored, False)).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("expected"), F.coalesce(F.sum("t"), F.lit(0)).alias("found")).where("expected != found")


def audit(master: DataFrame, tailored: DataFrame, texts: DataFrame, merged: bool = False) -> DataFrame:
    """`verdict, what`: everything the tailored text claims that the master does not: skills, employers, their number, and figures.

    `master(pos, company)`, `tailored(pos, company)`, and one row of `texts(key, tailored, master_skills, master_text, advert, content)`. Verdicts: `hard` is
    made up, `advert` is a skill taken from the advert. With `merged` roles may be missing, but every employer must be the master's.
    """
    skills = audit_skills(texts).where("verdict != 'known'").select("verdict", F.col("skill").alias("what"))
    figures = texts.select(F.explode(claimed_figures(F.col("content"), F.col("master_text"))).alias("n")).select(F.lit("hard").alias("verdict"), F.concat(F.lit("figure "), "n").alias("what"))
    if merged:
        known = master.select(F.lower("company").alias("k")).distinct()
        drift = tailored.join(known, F.lower("company") == known.k, "left_anti").select(F.concat(F.lit("employer "), F.coalesce("company", F.lit(""))).alias("what"))
    else:
        drift = employer_drift(master, tailored).where("expected is not null and found is not null").select(F.concat(F.lit("employer "), "expected", F.lit(" -> "), "found").alias("what"))
        drift = drift.unionByName(count_drift(master, tailored).select(F.concat(F.lit("roles "), "expected", F.lit(" -> "), "found").alias("what")))
    return skills.unionByName(figures).unionByName(drift.select(F.lit("hard").alias("verdict"), "what"))
