from pyspark.sql import functions as F

from gristmill.operators.units import annual_pay, number_value, stated_pay, unit_automaton, wrong_pay

UNITS = [("currency", "EUR", 1.0), ("currency", "USD", 0.92), ("currency", "GBP", 1.17), ("currency", "CAD", 0.68), ("currency", "SEK", 0.09), ("frequency", "yearly", 1.0), ("frequency", "monthly", 12.0), ("frequency", "daily", 220.0), ("frequency", "hourly", 1820.0)]
SCHEMA = "id string, salary struct<min_annual_eur:double,max_annual_eur:double,currency_original:string,frequency_original:string,is_disclosed:boolean>, description_text string, currency string, period string, figure int"


def frame(spark, rows):
    return spark.createDataFrame([(k, s, t, "clash", "clash", 1) for k, s, t in rows], SCHEMA)


def test_numbers():
    for text, value in (("54.000", 54000), ("70 000", 70000), ("27,50", 27.5), ("26.50", 26.5), ("66,500", 66500), ("80000", 80000), ("1 234,5", 1234.5)):
        assert number_value(text) == value


def test_statements():
    a = unit_automaton()
    for text, currency, want in (
        ("We pay US$85k - US$100k p.a.", None, (85000, "USD", "yearly")), ("Tarif : 66-85 k€ brut annuel", None, (66000, "EUR", "yearly")), ("TJM : 240 € – 300 € suivant", None, (240, "EUR", "daily")),
        ("Pay: $35 an hour", "CAD", (35, "CAD", "hourly")), ("Pay: $35 an hour", None, (35, "USD", "hourly")), ("Vergütung: 72-78k Fr. im Jahr", None, (72000, "CHF", "yearly")), ("Retribuzione: £190 - £230 al giorno", None, (190, "GBP", "daily")),
        ("Salaire : 27,50 EUR - 31,50 EUR par heure", None, (27.5, "EUR", "hourly")), ("COMPENSATION WILL BE 54K EUR A YEAR", None, (54000, "EUR", "yearly")),
    ):
        assert stated_pay(text, currency, a) == want, text
    for text in (None, "", "Meal vouchers worth 10 € per day and a yearly bonus of 8%.", "The group raised 20 million euros.", "The salary depends on experience.", "x" * 100_000):
        assert stated_pay(text, None, a) is None


def test_wrong_pay(spark):
    rows = [
        ("told", (50000.0, None, "EUR", "yearly", True), "We pay $50,000 a year."), ("right", (46000.0, None, "EUR", "yearly", True), "We pay $50,000 a year."),
        ("month", (3000.0, 3500.0, "€", "MONTHLY", True), None), ("thousand", (45.0, 50.0, "EUR", "yearly", True), ""), ("fine", (45000.0, None, None, None, True), "no pay"),
        ("hidden", (3000.0, None, "USD", "monthly", False), None), ("none", None, "We pay $50,000 a year."), ("empty", (None, None, None, None, True), None), ("text only", (None, None, None, None, True), "Pay: 100 EUR per day"),
    ]
    units = spark.createDataFrame(UNITS, "kind string, code string, factor double")
    jobs = frame(spark, rows + rows)
    got = {r["id"]: r["min_eur"] for r in wrong_pay(jobs, units).collect()}
    assert got == {"told": 46000, "month": 36000, "thousand": 45000, "text only": 22000}
    assert annual_pay(jobs, units).where("id = 'empty'").first()["min_eur"] is None
    assert wrong_pay(jobs.limit(0), units).count() == 0
    assert annual_pay(jobs, units).count() == annual_pay(jobs.dropDuplicates(["id"]), units).count()
    assert jobs.where(F.col("id") == "told").count() == 2
