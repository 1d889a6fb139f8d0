"""Scalar text functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T


def apply(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.o for r in rows.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (T.normalize_dates, "on 31st December 2030", "on 2030-12-31"),
        (T.normalize_dates, "on 3 december 2030", "on 2030-12-03"),
        (T.normalize_dates, "December 5, 2030", "2030-12-05"),
        (T.normalize_dates, "December 15 2030", "2030-12-15"),
        (T.normalize_dates, "2030, December", "2030-12"),
        (T.normalize_dates, "in 2030 may follow", "in 2030-05 follow"),
        (T.normalize_years, "by the year 2030", "by the 2030"),
        (T.normalize_years, "in '25 and in '61", "in 2025 and in 1961"),
        (T.normalize_currency, "$5bn and $7m", "5,000,000,000 USD and 7,000,000 USD"),
        (T.normalize_currency, "Rs. 5 million", "5,000,000 INR"),
        (T.normalize_emission_units, "5 MtCO2e and 3 kwh", "5 million tonnes CO2e and 3 kWh"),
        (T.normalize_numeric_and_dates, "5 MtCO2e", "5 1000000 tonnes CO2e"),
        (T.handle_missing_values, "more than 20%", ">20%"),
        (T.handle_missing_values, "reduce emissions by __%", "reduce emissions by MISSING%"),
        (T.handle_missing_values, "10–20% and 5-___%", "10-20% and 5-MISSING%"),
        (T.fix_sentence_boundaries, "Intro.Next", "Intro. Next"),
        (T.mark_sections, "Introduction\nx", "\n=== Introduction ===\n\nx"),
        (T.remove_annexes_references, "See [12] and (3)", "See  and "),
        (T.remove_annexes_references, "a annex b gone\nall\n\nstays", "a \n\nstays"),
        (T.standardize_terms, "Greenhouse gases and methane", "GHG and CH4"),
        (T.entity_tagging_prep, "12/31/2030 in china", "2030-31-12 in China"),
        (T.preprocess_text, "Act now. Emissions rose 2.5% in 2030! See https://x.y", "Act now . Emissions rose 2 . 5 in 2030 ! See httpsx . y"),
        (T.sanitize_text, "a€b (c) é;", "ab (c) ;"),
        (T.lower_keep_acronyms, "The IPCC and CO2e, REDD+ Redd+ EUROPE EU", "the IPCC and co2e, REDD+ redd+ europe EU"),
        (T.basic_text_cleaning, " A •  b\n\n# C ", "a  b  c"),
        (T.remove_headers_footers, "Page 3 of 9\n 12. kept \n\nDraft of 2021\nMinistry of x 2020\n7\n3 of 12", "kept"),
        (T.clean_special_characters, "a b©c—d inter-\n nal", "a bc-d internal"),
        (T.remove_captions, "x\nFigure 3: gone\ny (see table 4)", "x\n\ny "),
        (T.dedup_sentences, "The first one here. short. the  FIRST one here! Another one here?", "The first one here. Another one here"),
        (T.dedup_paragraphs, "A paragraph that is long\n\nshort\n\na  PARAGRAPH that is long", "A paragraph that is long"),
        (T.remove_legal_boilerplate, "whereas this goes\nnow therefore x", "\n x"),
        (T.final_cleanup, " a.B\n c ", "a. B c"),
    ],
)
def test_golden(spark, f, given, wanted):
    assert apply(spark, f, given) == [wanted]


def test_null_stays_null_and_empty_stays_empty(spark):
    for f in (*T.COMPAT, *T.STRUCTURED, T.tokenize_words, T.sentences):
        assert apply(spark, f, None) == [None]
    for f in T.COMPAT + T.STRUCTURED:
        assert apply(spark, f, "") == [""]


def test_modes_differ_on_line_rules(spark):
    text = "Page 1 of 2\nThe plan holds for every region here.\nFigure 1: a caption\nIt continues for every region there."
    compat, structured = (apply(spark, lambda c, m=m: T.clean_document(c, m), text)[0] for m in ("compat", "structured"))
    assert "caption" not in structured and "continues" in structured
    # In the first mode the text is one line that begins with a page number and goes whole.
    assert compat == ""


def test_idempotent(spark):
    texts = ["a€b. C", "  x \n y", "REDD+ Ab.Cd", ""]
    for f in (T.sanitize_text, T.final_cleanup, T.basic_text_cleaning):
        once = apply(spark, f, *texts)
        assert apply(spark, f, *once) == once


def test_validity(spark):
    assert apply(spark, T.valid_text, None, "short", "   long enough   ", " " * 20) == [False, False, True, False]
    assert apply(spark, T.non_empty, None, " \n", "x") == [False, False, True]
    assert apply(spark, T.supported_file, "a.PDF", "b.docx", "c.txt", None) == [True, True, False, False]
    assert apply(spark, lambda c: T.supported_file(c, True), "a.PDF", "a.pdf") == [False, True]
    assert apply(spark, lambda c: T.preview_chars(c, 3), "abcd", "abc", None) == ["abc...", "abc", None]
