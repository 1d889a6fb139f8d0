"""Text functions: Column in, Column out, built from Spark's own expressions. Null stays null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

#: White space and word characters of all of Unicode; a line ends at \n alone.
UNICODE = "(?Ud)"
#: The same for texts of ASCII.
LINES = "(?d)"
#: The white space that \\s stands for there.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SENTENCE_END = r"(?<=[.!?])\s+"


def replace(text: Column, pattern: str, by: str, any_case: bool = False) -> Column:
    """regexp_replace with \\1 for groups, Unicode classes and, if any_case, Unicode case."""
    java, _, replacement = _java(pattern, by, any_case)
    return F.regexp_replace(text, java, replacement)


def _java(pattern: str, by: str, any_case: bool) -> tuple[str, str, str]:
    """The pattern, its form for texts of ASCII, where Java's plain classes and cases are the same and quicker, and the
    replacement."""
    return ("(?iu)" if any_case else "") + UNICODE + pattern, ("(?i)" if any_case else "") + LINES + pattern, re.sub(r"\\(\d)", r"$\1", by.replace("$", "\\$"))


def rewrite(text: Column, rules: R.Rules) -> Column:
    """All rules in order. Rules are a constant array that is gone through for each text, so that plans stay
    small however many there are; one without a needle in the text is passed over, as plain searches cost little.
    A text of ASCII may get other signs on the way, but no letters, digits or spaces beyond ASCII."""

    def row(pattern: str, by: str, any_case: bool, needles: tuple[str, ...]) -> Column:
        java, plain, replacement = _java(pattern, by, any_case)
        return F.struct(F.lit(java).alias("p"), F.lit(plain).alias("a"), F.lit(replacement).alias("b"), F.array(*map(F.lit, needles or ("",))).alias("n"))

    listed = F.array(*[row(*r) for r in rules])

    def step(low: Column, form: str) -> Callable[[Column, Column], Column]:
        return lambda t, r: F.when(F.exists(r["n"], lambda n: F.contains(low, n)), F.regexp_replace(t, r[form], r["b"])).otherwise(t)

    def all_of(t: Column, low: Column) -> Column:
        return F.when(ascii_only(t), F.reduce(listed, t, step(low, "a"))).otherwise(F.reduce(listed, t, step(low, "p")))

    return once(text, lambda t: once(folded(t), lambda low: all_of(t, low)))


def ascii_only(text: Column) -> Column:
    """True if all characters are of one byte."""
    return F.octet_length(text) == F.length(text)


def folded(text: Column) -> Column:
    """Lower case, with the few letters that ignoring case also takes for s, i and k. Texts of ASCII have none of them
    and are lower-cased only. Names `text` several times."""
    return F.lower(F.when(ascii_only(text), text).otherwise(F.translate(text, "\u017f\u0131\u0130\u212a", "siik")))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often `use` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of an int array up to each place: each pass adds what stands 1, 2, 4, ... places before, so
    n values take log2(n) passes. Sums must fit an int."""
    for k in range(31):
        step = 1 << k
        values = once(values, lambda s, step=step: F.when(F.size(s) > step, F.transform(s, lambda v, i: v + F.coalesce(F.get(s, i - step), F.lit(0)))).otherwise(s))
    return values


def runs(items: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """Runs of equal keys in a sorted array: (at, n), the place of the first and their number."""

    def of(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (key(F.get(s, i - 1)) != key(x)), i)), lambda i: i.isNotNull())
        return once(first, lambda at: F.transform(at, lambda i, k: F.struct(i.alias("at"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("n"))))

    return once(items, of)


def first_by_key(items: Column, key: Callable[[Column], Column]) -> Column:
    """The array without items whose key an earlier item has; sorts, so long arrays don't square."""
    placed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))

    def firsts(s: Column) -> Column:
        new = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"]))
        return F.transform(F.sort_array(F.transform(new, lambda x: F.struct(x["i"], x["x"]))), lambda x: x["x"])

    return once(placed, firsts)


# ---- single functions ------------------------------------------------------------------------


def sanitize_text(text: Column) -> Column:
    """Only letters a-z, digits, white space and . , ; : ! ? ( ) - stay."""
    return replace(text, r"[^a-zA-Z0-9\s.,;:!?()-]", "")


def preprocess_text(text: Column) -> Column:
    """Single spaces, no special characters, one space on both sides of every . ! and ?"""
    kept = replace(strip(replace(text, r"\s+", " ")), r"[^\w\s.,;?!-]", "")
    # White space before a mark begins where the one before it ends, so long gaps are looked at once.
    return strip(replace(kept, r"(?:(?<!\s)\s+)?([.!?])\s*", r" \1 "))


def lower_keep_acronyms(text: Column) -> Column:
    """Lower case but for whole words that are acronyms; the + of one that ends so must follow."""
    plain = [a for a in R.ACRONYMS if a.isalnum()]
    plus = [a[:-1] for a in R.ACRONYMS if a.endswith("+")]

    def word(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda w, i: F.when(w.isin(plain) | (w.isin(plus) & F.coalesce(F.get(parts, i + 1), F.lit("")).startswith("+")), w).otherwise(F.lower(w))), "")

    # An ASCII text without the letters of any acronym is lower-cased as a whole.
    there = r"(?=[A-Z])(?:" + "|".join(plain + plus) + ")"
    return once(text, lambda t: F.when(ascii_only(t) & ~t.rlike(there), F.lower(t)).otherwise(once(F.split(t, r"\b"), word)))


def basic_text_cleaning(text: Column) -> Column:
    return F.trim(F.regexp_replace(replace(lower_keep_acronyms(text), r"\s+", " "), "[#*•▪▫]", ""))


def remove_headers_footers(text: Column) -> Column:
    """Lines without page numbers, headers and footers; leading line numbers go."""
    lines = F.transform(F.split(text, "\n"), strip)
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike("(?iu)" + UNICODE + R.PAGE_LINE))
    lines = F.transform(lines, lambda x: replace(x, r"^\d+\.\s*", ""))
    noise = "|".join(f"(?:{p})" for p in R.HEADER_FOOTER_LINES)
    return F.array_join(F.filter(lines, lambda x: ~x.rlike("(?iu)" + UNICODE + noise)), "\n")


def join_hyphenated(text: Column) -> Column:
    """Words cut by a hyphen at the end of a line, as one."""
    return replace(text, r"(\w)-[^\S\n]*\n\s*(\w+)", r"\1\2")


def clean_special_characters(text: Column) -> Column:
    def signs(t: Column) -> Column:
        spaced = F.regexp_replace(t, "[\\u00a0\\u2000-\\u200f\\u2028\\u2029]", " ")
        return F.regexp_replace(F.regexp_replace(spaced, "[©®™]", ""), "[–—]", "-")

    return replace(join_hyphenated(once(text, lambda t: F.when(ascii_only(t), t).otherwise(signs(t)))), r"\s+", " ")


def normalize_percentages(text: Column) -> Column:
    return rewrite(text, R.PERCENTAGES)


def normalize_years(text: Column) -> Column:
    return rewrite(text, R.YEARS)


def normalize_dates(text: Column) -> Column:
    """Day, month and year in either order, or year and month, to yyyy-mm-dd and yyyy-mm."""
    return rewrite(text, R.date_rules())


def normalize_currency(text: Column) -> Column:
    return rewrite(text, R.CURRENCIES)


def normalize_emission_units(text: Column) -> Column:
    return rewrite(text, R.EMISSION_UNITS)


def convert_written_numbers(text: Column) -> Column:
    return rewrite(text, R.number_word_rules())


def normalize_numeric_and_dates(text: Column) -> Column:
    for f in (normalize_percentages, normalize_years, normalize_dates, normalize_currency, normalize_emission_units, convert_written_numbers):
        text = f(text)
    return text


def handle_missing_values(text: Column) -> Column:
    return rewrite(text, R.MISSING_VALUES)


def remove_captions(text: Column) -> Column:
    return rewrite(text, R.CAPTIONS)


def sentence_key(text: Column) -> Column:
    return replace(F.lower(text), r"\s+", " ")


def dedup_sentences(text: Column) -> Column:
    """Sentences of more than 10 characters, the first of each, joined by '. '."""
    found = F.filter(F.transform(F.split(text, "[.!?]+"), strip), lambda x: F.length(x) > 10)
    return F.array_join(first_by_key(found, sentence_key), ". ")


def fix_sentence_boundaries(text: Column) -> Column:
    return rewrite(text, R.SENTENCE_BOUNDARIES)


def mark_sections(text: Column) -> Column:
    return rewrite(text, R.heading_rules())


def structure_oriented_cleaning(text: Column) -> Column:
    return mark_sections(fix_sentence_boundaries(dedup_sentences(remove_captions(text))))


def dedup_paragraphs(text: Column) -> Column:
    """Paragraphs with keys of more than 20 characters, the first of each."""
    found = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: F.length(sentence_key(x)) > 20)
    return F.array_join(first_by_key(found, sentence_key), "\n\n")


def remove_annexes_references(text: Column) -> Column:
    return rewrite(text, R.ANNEXES)


def standardize_terms(text: Column) -> Column:
    return rewrite(text, R.TERMS)


def remove_legal_boilerplate(text: Column) -> Column:
    return rewrite(text, R.BOILERPLATE)


def entity_tagging_prep(text: Column) -> Column:
    return rewrite(text, R.country_rules())


def climate_policy_cleaning(text: Column) -> Column:
    return entity_tagging_prep(remove_legal_boilerplate(standardize_terms(remove_annexes_references(text))))


def final_cleanup(text: Column) -> Column:
    return F.trim(replace(replace(text, r"\s+", " "), r"([.!?])\s*([A-Z])", r"\1 \2"))


#: The steps of clean_document(): in the first mode line breaks go first, so rules on lines act on
#: the whole text; in the second, rules that need lines come before that.
COMPAT = [basic_text_cleaning, remove_headers_footers, clean_special_characters, normalize_numeric_and_dates, handle_missing_values, structure_oriented_cleaning, dedup_paragraphs, climate_policy_cleaning, final_cleanup]
STRUCTURED = [remove_headers_footers, join_hyphenated, remove_captions, remove_annexes_references, dedup_paragraphs, basic_text_cleaning, clean_special_characters, normalize_numeric_and_dates, handle_missing_values, dedup_sentences, fix_sentence_boundaries, mark_sections, standardize_terms, remove_legal_boilerplate, entity_tagging_prep, final_cleanup]


def clean_document(text: Column, mode: str = "structured") -> Column:
    """The full cleaning of a document; mode is "structured" or "compat"."""
    for step in {"compat": COMPAT, "structured": STRUCTURED}[mode]:
        text = step(text)
    return text


def tokenize_words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(strip(F.lower(text)), UNICODE + r"\s+"), lambda x: x != "")


def truncate_text(text: Column, n: int = 4000) -> Column:
    return F.substring(text, 1, n)


def preview_chars(text: Column, n: int = 500) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def valid_text(text: Column, least: int = 10) -> Column:
    return F.coalesce(F.length(strip(text)) >= least, F.lit(False))


def non_empty(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def supported_file(name: Column, pdf_only: bool = False) -> Column:
    """Suffix .pdf, .docx or .doc in any case; with pdf_only .pdf in that case."""
    return F.coalesce(name.endswith(".pdf") if pdf_only else F.lower(name).rlike(r"\.(pdf|docx|doc)$"), F.lit(False))


def sentences(text: Column) -> Column:
    """The text cut at white space after . ! or ?; a trailing empty sentence stays."""
    return F.split(text, UNICODE + SENTENCE_END)
