"""The policy texts hold something for every rule, so that no query passes by doing nothing."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T
from docloom.plans import sql as S
from docloom.plans.policy_docs import policy_docs


@pytest.mark.parametrize("name", S.ORDER)
def test_text_function_changes_rows(spark, sf, name):
    d = policy_docs(spark, sf)
    assert d.filter(getattr(T, name)(F.col("text")) != F.col("text")).count() > 0


GROUPS = {"percentages": R.PERCENTAGES, "currencies": R.CURRENCIES, "units": R.EMISSION_UNITS, "missing": R.MISSING_VALUES, "captions": R.CAPTIONS, "boundaries": R.SENTENCE_BOUNDARIES, "annexes": R.ANNEXES, "boilerplate": R.BOILERPLATE, "headings": R.heading_rules(), "countries": R.country_rules()}


@pytest.mark.parametrize("group", GROUPS)
def test_needles_leave_no_match_out(spark, sf, group):
    """Each rule alone, gated or not, gives the same."""
    d = policy_docs(spark, sf)
    for rule in GROUPS[group]:
        both = d.select(T.rewrite(F.col("text"), [rule]).alias("a"), T.replace(F.col("text"), *rule[:3]).alias("b"))
        assert both.filter("a != b").count() == 0
