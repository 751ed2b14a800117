"""Readers of the boards' stored pages and answers: raw records out of HTML, JSON and feeds, as DataFrames.

Crawling is outside the engine: pages come as rows `page, html` in the order they were stored. HTML is parsed with the standard library in
Arrow batches, a page at a time; everything after that is columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from .html_text import job_posting_field

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class Node:
    """An element of a page."""

    __slots__ = ("tag", "attrs", "parent", "inner")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.inner = tag, attrs, parent, []

    def all(self) -> Iterator[Node]:
        """The elements within, in order."""
        for x in self.inner:
            if isinstance(x, Node):
                yield x
                yield from x.all()

    def strings(self) -> list[str]:
        out: list[str] = []
        for x in self.inner:
            out += x.strings() if isinstance(x, Node) else [x.strip()] if x.strip() else []
        return out

    def text(self, separator: str = "") -> str:
        return separator.join(self.strings())

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.all() if test(n)), None)

    def styled(self, part: str) -> bool:
        return part in self.attrs.get("class", "")


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inner.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.inner.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def read_pages(pages: DataFrame, reader: Callable[[Node], list[dict]], fields: dict[str, str]) -> DataFrame:
    """`page, ordinal` and the fields of each record that `reader` finds on each page(page, html); a NULL page has none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"page": p, "ordinal": k, **r} for p, html in zip(b["page"], b["html"]) for k, r in enumerate(reader(parse(html)))]
            yield pd.DataFrame(rows, columns=["page", "ordinal", *fields]).astype(object)

    kind = dict(pages.dtypes)["page"]
    return pages.select("page", "html").mapInPandas(read, f"page {kind}, ordinal int, " + ", ".join(f"{c} {t}" for c, t in fields.items()))


def _once(values: list[str]) -> list[str]:
    return list(dict.fromkeys(values))


FREEWORK_FIELDS = {"title": "string", "url": "string", "company": "string", "skills": "array<string>", "date_posted": "string", "description": "string", "contract_types": "array<string>", "details": "string"}
FREEWORK_ROOT, HELLOWORK_ROOT = "https://www.free-work.com", "https://www.hellowork.com"
# The badges of contracts, and the labels that stand in the details.
BADGES = {"contractor": "Contractor", "permanent": "Permanent", "fixed term": "Fixed Term", "fixed-term": "Fixed term"}
DETAILS = ("Start date", "Duration", "Pay", "Rate", "Remote type", "Location")


def absolute(href: str, root: str) -> str:
    return href if href.startswith("http") else root + "/" + href.lstrip("/")


def badges(box: Node) -> list[str]:
    """Contract badges, each once, in order."""
    return _once([BADGES[w] for n in box.all() if n.tag in ("span", "a", "div") and (w := n.text().lower()) in BADGES])


def freework_cards(root: Node) -> list[dict]:
    """Every heading stands in a card: the shadowed box among its six nearest ancestors, else the sixth."""
    out = []
    for h2 in [n for n in root.all() if n.tag == "h2"]:
        card = h2
        for _ in range(6):
            card = card.parent
            if card is None or (card.styled("rounded-lg") and card.styled("shadow")):
                break
        box = card and card.first(lambda n: n.tag == "div" and n.styled("p-4"))
        mission = lambda n: n.tag == "a" and "/job-mission/" in n.attrs.get("href", "")
        title = box and box.first(mission)
        if not title or not title.text():
            continue
        job = {"title": title.text(), "url": absolute(title.attrs["href"], FREEWORK_ROOT)}
        head = box.first(lambda n: n.tag == "div")
        job["contract_types"] = badges(head) if head else []
        skills = box.first(lambda n: n.tag == "div" and n.styled("-mt-3"))
        if skills:
            words = skills.strings()
            dates = [w for w in words if re.fullmatch(r"\d{2}/\d{2}/\d{4}", w)]
            job["date_posted"] = dates[-1] if dates else None
            job["skills"] = _once([w for w in words if w not in dates and not re.fullmatch(r"\+\d+", w)])
        info = box.first(lambda n: n.tag == "div" and n.styled("gap-4"))
        words = info.strings() if info else []
        if words:
            end = words.index("View this job", 1) if "View this job" in words[1:] else len(words)
            job["company"], job["description"] = words[0], " ".join(words[1:end])
        job["details"] = next((t for n in card.all() if mission(n) and "Start date" in (t := n.text())), None)
        out.append(job)
    return out


def freework(pages: DataFrame) -> DataFrame:
    """Raw records of the board's list pages, repeated ones kept; the glued details as columns."""
    from .html_text import glued_details

    rows = read_pages(pages, freework_cards, FREEWORK_FIELDS)
    clean = F.regexp_replace(F.col("details"), r"SVG\s*Image\s*", " ")
    return rows.withColumn("d", glued_details(clean, DETAILS)).select(*[c for c in rows.columns if c != "details"], "d.*")


def page_total(html: Column) -> Column:
    """The pages of a list that says '1 / 8': the first such total above one, else 1."""
    plain = F.regexp_replace(html, r"<[^>]*>", "")
    totals = F.transform(F.regexp_extract_all(plain, F.lit(r"\d+\s*/\s*(\d+)"), 1), lambda x: x.cast("int"))
    return F.coalesce(F.try_element_at(F.filter(totals, lambda n: n > 1), F.lit(1)), F.lit(1))


def button_pages(html: Column) -> Column:
    """The pages of a list with buttons named p, else the figure behind 'sur', else 1."""
    values = F.transform(F.regexp_extract_all(html, F.lit(r'<button[^>]*name="p"[^>]*value="(\d+)"'), 1), lambda x: x.cast("int"))
    other = F.regexp_extract(F.regexp_replace(html, r"<[^>]*>", ""), r"sur\s+(\d+)", 1).try_cast("int")
    return F.coalesce(F.array_max(values), other, F.lit(1))


def hellowork_cards(root: Node) -> list[dict]:
    out = []
    marked = lambda n, key, value: n.attrs.get(key) == value
    for card in [n for n in root.all() if n.tag == "li"]:
        key = card.attrs.get("data-id-storage-item-id") or card.attrs.get("data-hide-offer-item-id-value")
        link = card.first(lambda n: n.tag == "a" and marked(n, "data-cy", "offerTitle")) or card.first(lambda n: n.tag == "a" and "/emplois/" in n.attrs.get("href", ""))
        if not key or link is None:
            continue
        lines = [p.text() for h in link.all() if h.tag == "h3" for p in h.all() if p.tag == "p"]
        tags = [t for n in card.all() if marked(n, "data-cy", "contractTag") and (t := n.text())]
        of = lambda name: next((n.text() for n in card.all() if marked(n, "data-cy", name)), None)
        date = card.first(lambda n: n.tag == "div" and n.styled("text-grey-500") and n.styled("typo-s"))
        out.append({
            "id": key, "url": absolute(link.attrs.get("href", ""), HELLOWORK_ROOT), "title": (lines[0] if lines else "") or link.text() or link.attrs.get("title", ""), "company": lines[-1] if len(lines) > 1 else "",
            "location": of("localisationCard"), "contract": of("contractCard"), "tags": tags, "date_posted": (date or card).text(" "),
        })
    return out


def hellowork(pages: DataFrame) -> DataFrame:
    """Raw records of the board's cards; the first tag that tells of it gives workplace, pay and duration."""
    rows = read_pages(pages, hellowork_cards, {"id": "string", "url": "string", "title": "string", "company": "string", "location": "string", "contract": "string", "tags": "array<string>", "date_posted": "string"})
    first = lambda pattern: F.try_element_at(F.filter("tags", lambda t: t.rlike(pattern)), F.lit(1))
    told = F.try_element_at(F.filter("tags", lambda t: text.workplace_fr(t).isNotNull()), F.lit(1))
    return rows.withColumns({"workplace": told, "salary": first("€"), "duration": first(r"(?i)\d+\s*(mois|an)")}).drop("tags")


def englishjobs_cards(root: Node) -> list[dict]:
    """The whole listing is in the card; list items are told apart by what they say: a month and a day is the date, then firm, then place."""
    out = []
    month = re.compile(r"(?i)(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}$")
    for card in [n for n in root.all() if n.styled("job") and n.attrs.get("id")]:
        head = card.first(lambda n: n.tag == "h3")
        link = card.first(lambda n: n.tag == "a" and (n.styled("js-joblink") or "/clickout/" in n.attrs.get("href", "")))
        if head is None or link is None:
            continue
        items = [t for ul in card.all() if ul.tag == "ul" for n in ul.all() if n.tag == "li" and (t := n.text(" "))]
        dates = [t for t in items if month.match(t)][:1]
        rest = [t for t in items if t not in dates]
        body = card.first(lambda n: n.tag == "div" and n.styled("text-gray-400"))
        out.append({
            "id": card.attrs["id"], "title": head.text(" "), "url": absolute(link.attrs.get("href", ""), "https://englishjobs.fr"), "company": rest[0] if rest else None,
            "location": rest[1] if len(rest) > 1 else None, "date_posted": dates[0] if dates else None, "description": body.text(" ") if body else None,
        })
    return out


def englishjobs(pages: DataFrame) -> DataFrame:
    """Raw records of the board's cards, one an id, the first."""
    rows = read_pages(pages, englishjobs_cards, {c: "string" for c in ("id", "title", "url", "company", "location", "date_posted", "description")})
    return first_of(rows.withColumn("details", F.concat_ws(" ", "company", "description")), "id", ["page", "ordinal"])


def datasciencejobs_cards(root: Node) -> list[dict]:
    out = []
    for card in [n for n in root.all() if n.styled("card-grid")]:
        head = card.first(lambda n: n.tag == "h4")
        link = head.first(lambda n: n.tag == "a" and bool(n.attrs.get("href"))) if head else None
        if link is None:
            continue
        href, site = link.attrs["href"], "https://datasciencejobs.com"
        of = lambda tag, css: next((n.text(" ") for n in card.all() if n.tag == tag and n.styled(css)), None)
        apply_ = card.first(lambda n: n.tag == "a" and n.attrs.get("href", "").endswith("/apply/"))
        contract = of("span", "card-briefcase")
        out.append({
            "id": href.rstrip("/").split("/")[-1] or href, "title": link.text(" "), "company": of("a", "name-job"), "location": of("span", "location-small") or "", "detail_url": absolute(href, site),
            "apply_url": absolute(apply_.attrs["href"], site) if apply_ else None, "contract_raw": contract.lower() if contract else None,
            "skills": [n.text(" ") for n in card.all() if n.tag == "a" and n.styled("badge") and n.text(" ")], "salary_text": of("span", "card-text-price"),
        })
    return out


def datasciencejobs(pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Raw records of the board's cards, one an id, the first; `details(detail_url, html)` adds what the listing's own page says."""
    kinds = {**{c: "string" for c in ("id", "title", "company", "location", "detail_url", "apply_url", "contract_raw")}, "skills": "array<string>", "salary_text": "string"}
    rows = first_of(read_pages(pages, datasciencejobs_cards, kinds), "id", ["page", "ordinal"])
    if details is None:
        return rows
    level = F.nullif(F.trim(F.regexp_extract(F.regexp_replace(F.col("html"), r"<[^>]*>", " "), r"(?i)Job level\s+(\w+)", 1)), F.lit(""))
    more = details.select("detail_url", job_posting_field(F.col("html"), F.lit("datePosted")).alias("date_posted"), job_posting_field(F.col("html"), F.lit("description")).alias("description"), level.alias("job_level"))
    return rows.join(more, "detail_url", "left")


def first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without a key are kept, all of them."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth").unionByName(df.where(F.col(key).isNull()))


def hiringcafe(answers: DataFrame) -> DataFrame:
    """Hits of captured answers(page, hits ARRAY<STRUCT<objectID, ...>>), one an objectID, the first."""
    hits = answers.select("page", F.posexplode("hits").alias("ordinal", "hit"))
    return first_of(hits.select("page", "ordinal", "hit.*"), "objectID", ["page", "ordinal"])


def faruse(records: DataFrame, query: str = "", place: str = "") -> DataFrame:
    """Records(page, ordinal, ...) with a title, one an id, the first; with a query, those that hold its words and the place."""
    rows = records.where(F.coalesce("title", F.lit("")) != "")
    rows = rows.withColumn("jobid", F.coalesce(F.nullif("jobid", F.lit("")), text.url_slug(F.col("joburl"))))
    if query or place:
        where = F.lower(F.concat_ws(" ", "country", "location"))
        rows = rows.where(text.all_words_in(F.concat_ws(" ", "title", "description"), query) & where.contains(place.strip().lower()))
    return first_of(rows, "jobid", ["page", "ordinal"])


def wwr(items: DataFrame, query: str = "") -> DataFrame:
    """Feed items(page, ordinal, title, link, category, skills, ...) with a title, one a link, the first; then those that hold the query."""
    rows = first_of(items.where(F.coalesce("title", F.lit("")) != ""), "link", ["page", "ordinal"])
    return rows.where(text.holds_query(F.concat_ws(" ", "title", "category", "skills"), query))


def remoteok(records: DataFrame, query: str = "", place: str = "") -> DataFrame:
    """Records(ordinal, id, position, tags, description, location, ...) with a wanted tag that hold all words of the query and the place, one an id, the first."""
    rows = records.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("position", F.lit("")) != "") & text.has_required_tag(F.col("tags")))
    whole = F.concat_ws(" ", "position", F.array_join("tags", " "), "description")
    rows = rows.where(text.all_words_in(whole, query) & F.lower(F.coalesce("location", F.lit(""))).contains(place.strip().lower()))
    return first_of(rows, "id", ["ordinal"])
