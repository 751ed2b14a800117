"""Pay figures in different units: found by a multi-pattern automaton, converted with a table of factors.

A text is read once by an Aho-Corasick automaton that knows the phrases which open a statement of pay and every spelling of a
currency or a pay period. Overlapping hits are settled by length. Inside a statement the figure is the first number; its
currency is the alias nearest to it, its period the first one named. Where an alias can mean several units (a bare dollar
sign), the unit written in the listing's own columns decides. Factors are joined from a table afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import broadcast_if_small

# Spellings of units. A value with "?" has several meanings; the columns of the row decide, else the first.
CURRENCY_ALIASES = {
    "eur": "EUR", "euro": "EUR", "euros": "EUR", "€": "EUR", "k€": "EUR",
    "usd": "USD", "us$": "USD", "us dollar": "USD", "us dollars": "USD", "dollar us": "USD", "$": "USD?CAD", "dollar": "USD?CAD", "dollars": "USD?CAD",
    "gbp": "GBP", "£": "GBP", "pound": "GBP", "pounds": "GBP", "livres": "GBP", "pfund": "GBP", "libras": "GBP",
    "chf": "CHF", "sfr": "CHF", "fr.": "CHF", "francs suisses": "CHF", "schweizer franken": "CHF", "swiss francs": "CHF", "franken": "CHF",
    "cad": "CAD", "c$": "CAD", "ca$": "CAD", "can$": "CAD", "cdn$": "CAD", "canadian dollars": "CAD",
    "pln": "PLN", "zł": "PLN", "zloty": "PLN", "złoty": "PLN",
    "sek": "SEK", "kr": "SEK", "kr (se)": "SEK", "kronor": "SEK",
}
PERIOD_ALIASES = {
    "yearly": "yearly", "annual": "yearly", "annually": "yearly", "per year": "yearly", "a year": "yearly", "/year": "yearly", "per annum": "yearly", "p.a.": "yearly", "an": "yearly", "/an": "yearly", "par an": "yearly", "annuel": "yearly", "annuels": "yearly", "im jahr": "yearly", "pro jahr": "yearly", "jährlich": "yearly", "al año": "yearly", "anuales": "yearly", "anual": "yearly", "all'anno": "yearly", "annui": "yearly", "annuo": "yearly", "l'anno": "yearly", "per jaar": "yearly", "year": "yearly", "jahr": "yearly", "jaarlijks": "yearly",
    "monthly": "monthly", "month": "monthly", "per month": "monthly", "a month": "monthly", "/month": "monthly", "/mois": "monthly", "mois": "monthly", "par mois": "monthly", "mensuel": "monthly", "mensuels": "monthly", "im monat": "monthly", "pro monat": "monthly", "monatlich": "monthly", "al mes": "monthly", "mensuales": "monthly", "mensual": "monthly", "al mese": "monthly", "mensili": "monthly", "per maand": "monthly", "maandelijks": "monthly",
    "weekly": "weekly", "week": "weekly", "per week": "weekly", "a week": "weekly", "/week": "weekly", "par semaine": "weekly", "/semaine": "weekly", "hebdo": "weekly", "hebdomadaire": "weekly", "pro woche": "weekly", "die woche": "weekly", "wöchentlich": "weekly", "por semana": "weekly", "semanales": "weekly", "a settimana": "weekly", "alla settimana": "weekly", "settimanali": "weekly",
    "daily": "daily", "day": "daily", "per day": "daily", "a day": "daily", "/day": "daily", "day rate": "daily", "par jour": "daily", "/jour": "daily", "jour": "daily", "ht/j": "daily", "/j": "daily", "tjm": "daily", "pro tag": "daily", "am tag": "daily", "tagessatz": "daily", "täglich": "daily", "al día": "daily", "por día": "daily", "diarios": "daily", "al giorno": "daily", "giornalieri": "daily", "per dag": "daily", "dagtarief": "daily",
    "hourly": "hourly", "hour": "hourly", "per hour": "hourly", "an hour": "hourly", "/hour": "hourly", "/h": "hourly", "par heure": "hourly", "de l'heure": "hourly", "horaire": "hourly", "/heure": "hourly", "pro stunde": "hourly", "die stunde": "hourly", "in der stunde": "hourly", "stündlich": "hourly", "la hora": "hourly", "por hora": "hourly", "a la hora": "hourly", "all'ora": "hourly", "l'ora": "hourly", "orari": "hourly", "per uur": "hourly",
}
#: Phrases that open a statement of pay.
PAY_CUES = (
    "pay:", "we pay", "pay is", "salary:", "salary is", "salary on offer", "compensation", "day rate:", "rate:", "rate is",
    "salaire :", "salaire:", "salaire est", "rémunération", "tarif :", "tarif:", "tjm :", "tjm:", "tjm", "nous payons",
    "vergütung", "gehalt", "wir zahlen", "tagessatz:", "stundensatz:",
    "sueldo", "salario", "ofrecemos", "tarifa:", "pagamos",
    "stipendio", "retribuzione", "paghiamo", "offriamo", "compenso", "tariffa",
    "salaris", "wij betalen", "we betalen", "tarief:", "dagtarief:", "vergoeding",
)
#: Phrases among them that name the period too.
RATE_CUES = {"tjm :": "daily", "tjm:": "daily", "tjm": "daily", "day rate:": "daily", "tagessatz:": "daily", "stundensatz:": "hourly", "dagtarief:": "daily"}
#: A statement ends where one of these begins: perks and bonuses are no pay.
PERK_CUES = ("bonus", "voucher", "prime de", "prime annuelle", "tickets restaurant", "essensmarken", "vales de comida", "prima ", "buoni pasto", "premio", "maaltijdbonnen", "fresh capital", "capital au", "kapital", "de capital")

_NUMBER = re.compile(r"\d{1,3}(?:[   .,'’]\d{3})+(?!\d)(?:[.,]\d{1,2}(?!\d))?|\d+(?:[.,]\d{1,2}(?!\d))?")
#: Where a sentence ends: at a line's end, or at a mark that a capital follows.
_SENTENCE_END = re.compile(r"\n|[.!?;](?=\s+[^\W\d_a-zà-öø-ÿ])")
_K = re.compile(r"\s?k(?![a-zà-ÿ])")


def number_value(text: str) -> float:
    """The value of a figure with thousands marked by a blank, point, comma or apostrophe, and decimals by point or comma."""
    digits = re.sub(r"[   '’]", "", text)
    if m := re.fullmatch(r"(\d{1,3}(?:[.,]\d{3})+)(?:[.,](\d{1,2}))?", digits):
        return float(re.sub(r"[.,]", "", m[1]) + "." + (m[2] or "0"))
    return float(digits.replace(",", "."))


def unit_automaton() -> ahocorasick.Automaton:
    """All phrases and aliases in one automaton; values are sets of (kind, meaning)."""
    words: dict[str, list[tuple[str, str]]] = {}
    for kind, table in (("currency", CURRENCY_ALIASES), ("period", PERIOD_ALIASES)):
        for alias, meaning in table.items():
            words.setdefault(alias, []).append((kind, meaning))
    for kind, phrases in (("cue", PAY_CUES), ("perk", PERK_CUES)):
        for phrase in phrases:
            words.setdefault(phrase, []).append((kind, phrase))
    for phrase, period in RATE_CUES.items():
        words[phrase].append(("period", period))
    a = ahocorasick.Automaton()
    for word, meanings in words.items():
        a.add_word(word, (len(word), tuple(meanings)))
    a.make_automaton()
    return a


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether a hit stands on word borders; digits may touch a currency sign."""
    first, last = text[start], text[end - 1]
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    return not (first.isalpha() and before.isalpha()) and not (last.isalpha() and after.isalpha())


def _hits(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, tuple]]:
    """Bounded hits, the longest where they overlap."""
    found = [(end + 1 - n, end + 1, what) for end, (n, what) in automaton.iter(text) if _bounded(text, end + 1 - n, end + 1)]
    found.sort(key=lambda h: (h[0], -h[1]))
    kept: list[tuple[int, int, tuple]] = []
    for h in found:
        if kept and h[0] < kept[-1][1]:
            if h[1] - h[0] > kept[-1][1] - kept[-1][0]:
                kept[-1] = h
            continue
        kept.append(h)
    return kept


def stated_pay(text: str | None, currency: str | None, automaton: ahocorasick.Automaton) -> tuple[float, str, str | None] | None:
    """(lower figure, currency code, period code or None) of the first statement of pay in a text, or None."""
    if not text:
        return None
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = _hits(automaton, low)
    for k, (start, end, what) in enumerate(hits):
        if not any(kind == "cue" for kind, _ in what):
            continue
        last_mark = _SENTENCE_END.search(text, end) if len(text) == len(low) else None
        stop = last_mark.start() if last_mark else len(low)
        for s, _, w in hits[k + 1 :]:
            if s >= stop:
                break
            if any(kind in ("perk", "cue") for kind, _ in w):
                stop = s
        figures = [m for m in _NUMBER.finditer(low, end, stop)]
        if not figures:
            continue
        first = figures[0]
        # A second figure belongs to the same amount only if a range mark stands between them.
        second = figures[1] if len(figures) > 1 and re.fullmatch(r"[^.;:!?\d\n]{0,22}?(?:-|–|—|\bto\b|à|\ba\b|\bbis\b|\btot\b|\be\b|\bund\b|\band\b)[^.;:!?\d\n]{0,14}", low[first.end() : figures[1].start()].replace("fr.", "fr").replace("ca$", "$")) else None
        last = second or first
        near = [(h, m) for h in hits if start <= h[0] < stop for kind, m in h[2] if kind == "currency"]
        near = [(h, m) for h, m in near if h[0] <= last.end() + 6 and h[1] >= end]
        if not near:
            continue
        low_by = {True: 0, False: 1}
        best = min(near, key=lambda x: (min(abs(x[0][0] - f.end()) if x[0][0] >= f.end() else abs(f.start() - x[0][1]) for f in ([first, second] if second else [first])), low_by[x[0][0] >= first.start()]))[1]
        code = best.split("?")[0]
        if "?" in best and currency in best.split("?"):
            code = currency
        scale = 1000.0 if _K.match(low, first.end()) or (second and _K.match(low, second.end())) else 1.0
        after = [m for h in hits if last.end() <= h[0] < stop for kind, m in h[2] if kind == "period"]
        before = [m for h in hits if start <= h[0] < first.start() for kind, m in h[2] if kind == "period"]
        amount = number_value(first[0]) * scale
        if second:
            amount = min(amount, number_value(second[0]) * (1000.0 if _K.match(low, second.end()) or scale > 1 else 1.0))
        return amount, code, (after or before or [None])[0]
    return None


def unit_code(column: Column, table: dict[str, str]) -> Column:
    """The code an alias stands for, with case and blanks ignored; NULL for a NULL or unknown alias."""
    pairs = [x for alias, code in table.items() for x in (F.lit(alias), F.lit(code.split("?")[0]))]
    return F.create_map(*pairs)[F.lower(F.trim(column))]


def annual_pay(jobs: DataFrame, pay_units: DataFrame, thousands_below: float = 1000.0) -> DataFrame:
    """The lower amount each disclosed listing offers, in whole euros per year.

    Input: `id`, `salary` and `description_text` (other columns are ignored). Output: `id, min_annual_eur, min_eur, stated`, one
    row per distinct listing value; `min_eur` is NULL where neither the text nor the columns hold a figure. A sentence that states
    pay tells figure and units and outranks the columns. Without one the columns do: an unknown or missing currency counts as
    euros and an unknown or missing period as yearly; a yearly figure below `thousands_below` is in thousands. NULL and empty
    texts state nothing, repeated rows give one row, and undisclosed listings give none.

    `pay_units` (kind, code, factor) is a table of units: its size does not depend on the listings, and it is counted before it is broadcast.
    """
    rows = jobs.where(F.col("salary.is_disclosed")).select(
        "id",
        F.col("salary.min_annual_eur").alias("figure"),
        unit_code(F.col("salary.currency_original"), CURRENCY_ALIASES).alias("currency"),
        unit_code(F.col("salary.frequency_original"), PERIOD_ALIASES).alias("period"),
        "description_text",
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = unit_automaton()
        for b in batches:
            said = [stated_pay(t, c, automaton) for t, c in zip(b.description_text, b.currency)]
            b = b.drop(columns="description_text")
            b["said"] = [x[0] if x else None for x in said]
            b["said_currency"] = [x[1] if x else None for x in said]
            b["said_period"] = [x[2] if x else None for x in said]
            yield b

    read_rows = rows.mapInPandas(read, "id string, figure double, currency string, period string, said double, said_currency string, said_period string")
    stated = F.col("said").isNotNull()
    period = F.coalesce(F.when(stated, F.col("said_period")), F.col("period"), F.lit("yearly"))
    chosen = read_rows.select(
        "id", "figure", stated.alias("stated"),
        F.when(stated, F.col("said_currency")).otherwise(F.coalesce("currency", F.lit("EUR"))).alias("currency"),
        period.alias("period"),
        F.when(stated, F.col("said")).when((period == "yearly") & (F.col("figure") < thousands_below), F.col("figure") * 1000).otherwise(F.col("figure")).alias("amount"),
    )
    rows_of_units = pay_units.count()
    of = lambda kind, name: broadcast_if_small(pay_units.where(F.col("kind") == kind).select(F.col("code").alias(name), F.col("factor").alias(f"{name}_factor")), rows_of_units)
    return (
        chosen.join(of("currency", "currency"), "currency", "left")
        .join(of("frequency", "period"), "period", "left")
        .select("id", F.col("figure").alias("min_annual_eur"), F.round(F.col("amount") * F.col("currency_factor") * F.col("period_factor")).cast("long").alias("min_eur"), "stated")
        .distinct()
    )


def wrong_pay(jobs: DataFrame, pay_units: DataFrame) -> DataFrame:
    """`id, min_eur` of the listings whose recorded yearly minimum is off by more than one euro."""
    pay = annual_pay(jobs, pay_units)
    off = F.col("min_annual_eur").isNull() | (F.abs(F.col("min_annual_eur") - F.col("min_eur")) > 1)
    return pay.where(F.col("min_eur").isNotNull() & off).select("id", "min_eur").distinct()
