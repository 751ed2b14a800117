"""Pay and date strings of the boards, parsed in column expressions. Bad input gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import salary, undisclosed
from .text import mapped

# Rates and working time that the boards' figures are turned into euros a year with.
USD, GBP = 0.92, 1.17
DAYS_PER_YEAR = 220
PERIODS = {"year": 1, "yr": 1, "yearly": 1, "month": 12, "mo": 12, "monthly": 12, "day": 260, "daily": 260, "hour": 2080, "hr": 2080, "hourly": 2080}
RATES = {"EUR": 1.0, "€": 1.0, "USD": USD, "US$": USD, "$": USD}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_SPACE = r"[\s  ]"


def whole(x: Column) -> Column:
    """Rounded half to even."""
    return F.bround(x, 0)


def plain_number(text: Column) -> Column:
    """A figure with blanks taken out and a k for thousands."""
    t = F.lower(F.regexp_replace(text, _SPACE, ""))
    return F.when(t.endswith("k"), F.regexp_replace(t, "k$", "").try_cast("double") * 1000).otherwise(t.try_cast("double"))


def amounts(text: Column) -> Column:
    """Figures between dashes, each up to its currency sign."""
    return F.filter(F.transform(F.split(text, r"\s*[-–—]\s*"), lambda p: plain_number(F.regexp_replace(p, r"(?s)\s*[€¤$].*", ""))), lambda x: x.isNotNull())


def pay_or_rate(pay: Column, rate: Column) -> Column:
    """Yearly pay, or else a daily rate over the working days of a year; undisclosed where neither is positive."""
    paid, rated = amounts(F.coalesce(pay, F.lit(""))), F.transform(amounts(F.coalesce(rate, F.lit(""))), lambda x: x * DAYS_PER_YEAR)
    use = F.when(F.size(paid) > 0, paid).otherwise(rated)
    low, high = F.try_element_at(use, F.lit(1)), F.try_element_at(use, F.lit(-1))
    positive = lambda x: F.when(x > 0, x)
    daily = (F.coalesce(rate, F.lit("")) != "") & (F.coalesce(pay, F.lit("")) == "")
    return salary(positive(low), positive(high), "EUR", F.when(daily, "daily").otherwise("yearly"))


def range_per_period(text: Column) -> Column:
    """'a-b CUR/period'; undisclosed where it has another form or currency."""
    form = r"(?i)^\s*(\d[\d\s.,]*)\s*-\s*(\d[\d\s.,]*)\s*([A-Za-z€$]{2,4})\s*/\s*(year|yr|yearly|month|mo|monthly|day|daily|hour|hr|hourly)\s*$"
    part = lambda k: F.regexp_extract(text, form, k)
    figure = lambda k: F.regexp_replace(F.regexp_replace(part(k), " ", ""), ",", ".").try_cast("double")
    code, period = F.upper(part(3)), F.lower(part(4))
    rate = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])[code]
    times = F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv])[period]
    low, high = figure(1), figure(2)
    told = F.coalesce(rate.isNotNull() & low.isNotNull() & high.isNotNull(), F.lit(False))
    return F.when(told, salary(whole(low * times * rate), whole(high * times * rate), code, period, F.lit(True))).otherwise(undisclosed())


def euro_figures(text: Column) -> Column:
    """Least and greatest of all 'N €', the period by its words; figures are not turned into yearly ones. NULL where there is none."""
    values = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([\d\s  .,]*\d)\s*€"), 1), lambda x: F.regexp_replace(x, _SPACE, "").try_cast("double")), lambda x: x.isNotNull())
    low = F.lower(text)
    period = F.when(low.rlike("/h|par heure|horaire"), "hourly").when(low.rlike("/mois|mensuel"), "monthly").otherwise("yearly")
    return F.when(F.size(values) > 0, salary(F.array_min(values), F.array_max(values), "EUR", period, F.lit(True)))


def annual_figures(text: Column, annualised: bool = True) -> Column:
    """`euro_figures` in euros a year, for users who want what the field's name says."""
    s = euro_figures(text)
    times = F.when(s["frequency_original"] == "hourly", PERIODS["hourly"]).when(s["frequency_original"] == "monthly", 12).otherwise(1) if annualised else F.lit(1)
    return F.when(s.isNotNull(), salary(s["min_annual_eur"] * times, s["max_annual_eur"] * times, s["currency_original"], s["frequency_original"], F.lit(True)))


def code_and_range(text: Column) -> Column:
    """A currency by code or sign, then one figure or two; dollars are turned into euros, others taken as they are."""
    form = r"(?:([A-Z]{3})\s*)?([$€£])?\s*(\d[\d,]*)(?:\s*-\s*(?:[A-Z]{3}\s*)?[$€£]?\s*(\d[\d,]*))?"
    part = lambda k: F.nullif(F.regexp_extract(text, form, k), F.lit(""))
    code = F.upper(F.coalesce(part(1), mapped(part(2), {"$": "USD", "€": "EUR", "£": "GBP"}), F.lit("USD")))
    rate = F.when(code == "USD", USD).otherwise(1.0)
    figure = lambda k: F.regexp_replace(part(k), ",", "").try_cast("double")
    return F.when(figure(3).isNotNull(), salary(whole(figure(3) * rate), whole(figure(4) * rate), code)).otherwise(undisclosed("USD"))


def signed_amounts(text: Column) -> Column:
    """All amounts with a sign; hourly texts and texts without any are undisclosed. One amount gives a minimum only."""
    found = F.regexp_extract_all(text, F.lit(r"([$€£]\s?\d[\d,]*[kK]?)"), 1)
    value = lambda x: (
        F.regexp_replace(x, r"[^\d]", "").try_cast("double") * F.when(F.lower(x).endswith("k"), 1000.0).otherwise(1.0) * F.when(x.startswith("$"), USD).when(x.startswith("£"), GBP).otherwise(1.0)
    )
    values = F.filter(F.transform(found, value), lambda x: x.isNotNull())
    hourly = F.coalesce(text.rlike(r"(?i)\b(per\s*hour|hourly)\b|/\s*hr\b"), F.lit(True))
    return F.when(~hourly & (F.size(values) > 0), salary(whole(F.array_min(values)), F.when(F.size(values) > 1, whole(F.array_max(values))), "EUR", "yearly", F.lit(True))).otherwise(undisclosed())


def dollars(low: Column, high: Column, zero_is_none: bool = True, currency: Column | None = None, frequency: Column | None = None) -> Column:
    """Figures in dollars, or in a currency named, as euros; zero means undisclosed."""
    rate = F.lit(USD) if currency is None else F.when(currency == "USD", USD).otherwise(1.0)
    one = lambda x: whole(F.when(x > 0, x) * rate if zero_is_none else x * rate)
    s = salary(one(low), one(high), F.lit("USD") if currency is None else currency, F.lit("yearly") if frequency is None else frequency)
    return F.when(s["is_disclosed"], s).otherwise(undisclosed() if currency is None else s)


def paid_pair(pay: Column) -> Column:
    """(low, high) of a disclosed salary, one standing in for the other; (0, 0) if undisclosed. Zero says nothing."""
    low, high = F.nullif(pay["min_annual_eur"], F.lit(0.0)), F.nullif(pay["max_annual_eur"], F.lit(0.0))
    told = F.coalesce(pay["is_disclosed"], F.lit(False))
    of = lambda a, b: F.when(told, F.coalesce(a, b, F.lit(0.0))).otherwise(0.0)
    return F.struct(of(low, high).alias("low"), of(high, low).alias("high"))


def iso_guarded(text: Column) -> Column:
    """The date of a string that starts like an ISO date; words such as 'yesterday' are none."""
    return F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)), "yyyy-MM-dd")


def month_first(text: Column) -> Column:
    """M/D/YYYY as ISO; anything else as it is, '' as NULL."""
    m = lambda k: F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})", k)
    return F.when(m(1) != "", F.concat_ws("-", m(3), F.lpad(m(1), 2, "0"), F.lpad(m(2), 2, "0"))).otherwise(F.nullif(text, F.lit("")))


def day_first(text: Column) -> Column:
    m = lambda k: F.regexp_extract(text, r"(\d{1,2})/(\d{1,2})/(\d{4})", k)
    return F.try_to_date(F.when(m(1) != "", F.concat_ws("-", m(3), F.lpad(m(2), 2, "0"), F.lpad(m(1), 2, "0"))), "yyyy-MM-dd")


def french_posted(text: Column, now: Column) -> Column:
    """DD/MM/YYYY, today, yesterday or 'il y a N units' before `now`, as an ISO date."""
    low, today = F.lower(F.trim(text)), F.to_date(now)
    n = F.regexp_extract(low, r"il y a (\d+)\s*(heure|jour|semaine|mois|an)", 1).try_cast("int")
    unit = F.regexp_extract(low, r"il y a (\d+)\s*(heure|jour|semaine|mois|an)", 2)
    days = F.when(unit == "jour", n).when(unit == "semaine", n * 7).when(unit == "mois", n * 30).when(unit == "an", n * 365)
    hours = F.to_date(F.timestamp_seconds(F.unix_timestamp(now) - n * 3600))
    out = F.when(low.rlike(r"\d{1,2}/\d{1,2}/\d{4}"), day_first(low)).when(low.contains("aujourd"), today).when(low.startswith("hier"), F.date_sub(today, 1)).when(unit == "heure", hours).otherwise(F.date_sub(today, days))
    return F.date_format(out, "yyyy-MM-dd")


def month_day(text: Column, today: Column) -> Column:
    """'August 4' as its latest occurrence up to today."""
    word, day = F.lower(F.regexp_extract(F.trim(text), r"^([A-Za-z]+)\s+(\d{1,2})$", 1)), F.regexp_extract(F.trim(text), r"^([A-Za-z]+)\s+(\d{1,2})$", 2)
    number = mapped(word, {**{m: f"{k:02d}" for k, m in enumerate(MONTHS, 1)}, **{m[:3]: f"{k:02d}" for k, m in enumerate(MONTHS, 1)}})
    in_year = lambda y: F.try_to_date(F.concat_ws("-", y.cast("string"), number, F.lpad(day, 2, "0")), "yyyy-MM-dd")
    this = F.when(number.isNotNull(), in_year(F.year(today)))
    return F.date_format(F.when(this > today, F.when(number.isNotNull(), in_year(F.year(today) - 1))).otherwise(this), "yyyy-MM-dd")


def mail_date(text: Column) -> Column:
    """The local date of an RFC 2822 stamp."""
    d = F.regexp_extract(F.trim(text), r"^(?:[A-Za-z]{3},\s*)?(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})", 1)
    return F.date_format(F.try_to_date(F.nullif(F.regexp_replace(d, r"\s+", " "), F.lit("")), "d MMM yyyy"), "yyyy-MM-dd")


def iso_or_epoch(text: Column, epoch: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)).otherwise(F.date_format(F.timestamp_seconds(epoch.try_cast("bigint")), "yyyy-MM-dd"))


def before_t(text: Column) -> Column:
    return F.nullif(F.when(text.contains("T"), F.substring(text, 1, 10)).otherwise(text), F.lit(""))


def run_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HHmmss'Z'")
