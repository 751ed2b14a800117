"""Text, cards and embedded data of stored HTML, with the standard library's parser, in Arrow batches."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


class _Strings(HTMLParser):
    """Every non-blank string of a page in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.out.append(data.strip())


def strip_tags(html: str | None) -> str:
    """Strings joined by single blanks, each trimmed; '' for NULL."""
    if not html:
        return ""
    p = _Strings()
    p.feed(html)
    p.close()
    return " ".join(p.out)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(strip_tags)


def html_text_simple(html: Column) -> Column:
    """The same for markup without entities or comments, without Python."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", " "), r"\s+", " "))


def jsonld_bodies(html: Column) -> Column:
    """Bodies of the JSON-LD scripts of a page."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)


_SCRIPT = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)


def job_posting(page: str | None) -> dict:
    """The first JobPosting among a page's JSON-LD objects or lists; empty if there is none."""
    for body in _SCRIPT.findall(page or ""):
        try:
            data = json.loads(body)
        except ValueError:
            continue
        for item in data if isinstance(data, list) else [data]:
            if isinstance(item, dict) and item.get("@type") == "JobPosting":
                return item
    return {}


@F.pandas_udf(T.StringType())
def job_posting_text(html: pd.Series) -> pd.Series:
    """Description of a page's JobPosting as text; NULL if there is none."""
    return html.map(lambda page: strip_tags(str(d)) if (d := job_posting(page).get("description")) else None)


@F.pandas_udf(T.StringType())
def job_posting_field(html: pd.Series, field: pd.Series) -> pd.Series:
    """A field of a page's JobPosting as text; NULL if there is none."""
    return pd.Series([strip_tags(str(d)) if (d := job_posting(page).get(f)) else None for page, f in zip(html, field)], dtype=object)


def last_page(html: Column, pattern: str = r"/page/(\d+)/") -> Column:
    """Greatest page number that a pattern finds, 1 if none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), lambda x: x.try_cast("int"))), F.lit(1))


def glued_details(text: Column, labels: tuple[str, ...]) -> Column:
    """Struct of label to value from a string in which labels and values stand without separators."""
    any_label = "|".join(labels)
    return F.struct(*[F.nullif(F.trim(F.regexp_extract(text, rf"{label}\s*(.+?)(?=\s*(?:{any_label})|$)", 1)), F.lit("")).alias(label.lower().replace(" ", "_")) for label in labels])
