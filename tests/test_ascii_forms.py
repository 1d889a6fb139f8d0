"""Rules have a quicker form for texts of ASCII, which gives the same there; other texts keep the form for Unicode."""

from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T

RULES = [*R.PERCENTAGES, *R.YEARS, *R.date_rules(), *R.CURRENCIES, *R.EMISSION_UNITS, *R.number_word_rules(), *R.MISSING_VALUES, *R.CAPTIONS, *R.SENTENCE_BOUNDARIES, *R.heading_rules(), *R.ANNEXES, *R.TERMS, *R.BOILERPLATE, *R.country_rules()]
TEXTS = ["1 may 20203 may 2021 x6 MAY 2030 66 may 2031\x0bmay 5, 2030", "a\x1cb 5\x0cPERCENT by  the year 2031_ in '25", "5 MtCO2e 3 Kwh_ KWH twenty-two", "Annex b\nx\n\ny References\nz", "whereas a\nnow therefore b.C..", "Introduction\ncarbon\tdioxide 12/31/2030 in_china China"]


def test_both_forms_agree_on_ascii(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for java, plain, by in (T._java(*r[:3]) for r in RULES):
        assert d.filter(F.regexp_replace("t", java, by) != F.regexp_replace("t", plain, by)).collect() == [], java


def test_letters_beyond_ascii_keep_their_case_rules(spark):
    d = spark.createDataFrame([("3 KWh, 5 percent, ١ may 2020, ſee",)], "t string")
    assert d.select(T.normalize_numeric_and_dates(F.col("t"))).first()[0] == "3 kWh, 5%, 2020-05-0١, ſee"
