"""Fixed values of the text functions: patterns, replacements and word lists, as data.

\\1 is a group. A number before a unit is matched by its last digit alone, so that long runs of digits
take linear time.
"""

from __future__ import annotations

#: Rewrites of one text function, applied in order: (pattern, replacement, ignore case, needles). Every
#: match holds one of the needles, in lower case; a text without any is passed over. No needles: all texts.
Rules = list[tuple[str, str, bool, tuple[str, ...]]]

# ---- fixed values -------------------------------------------------------------------------

ACRONYMS = ["UNFCCC", "IPCC", "NDC", "EU", "UNEP", "GHG", "CO2", "CH4", "N2O", "LULUCF", "REDD+", "CDM", "JI", "ETS", "COP", "CMP", "SBI", "SBSTA", "NAMA", "MRV", "ICA", "BUR", "NC", "AR", "WG", "SPM", "TS", "FAQ"]

PAGE_LINE = r"^page\s+\d+(\s+of\s+\d+)?$"
HEADER_FOOTER_LINES = [r"^(ministry|department|government).*\d{4}$", r"^draft.*\d{4}$", r"^confidential.*draft$", r"^\d+\s*$", r"^page\s+\d+", r"^\d{1,3}\s+of\s+\d{1,3}$"]

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

NUMBER_WORDS = {"twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100", "thousand": "1000", "million": "1000000", "billion": "1000000000"}

PERCENTAGES: Rules = [(r"(\d)\s*%", r"\1%", False, ("%",)), (r"(\d)\s+percent", r"\1%", True, ("percent",))]

YEARS: Rules = [
    (r"\byear\s+(\d{4})\b", r"\1", True, ("year",)),
    (r"\bby\s+the\s+year\s+(\d{4})\b", r"by \1", True, ("year",)),
    (r"\bin\s+'([0-4]\d)\b", r"in 20\1", False, ("'",)),
    (r"\bin\s+'([5-9]\d)\b", r"in 19\1", False, ("'",)),
]

CURRENCIES: Rules = [
    (r"\$(\d+)bn\b", r"\1,000,000,000 USD", True, ("$",)),
    (r"\$(\d+)m\b", r"\1,000,000 USD", True, ("$",)),
    (r"(\d)\s+billion\s+USD", r"\1,000,000,000 USD", True, ("billion",)),
    (r"Rs\.?\s*(\d+)\s+million", r"\1,000,000 INR", True, ("million",)),
]

EMISSION_UNITS: Rules = [
    (r"(\d)\s*MtCO2e?\b", r"\1 million tonnes CO2e", True, ("mtco2",)),
    (r"(\d)\s*GtCO2e?\b", r"\1 billion tonnes CO2e", True, ("gtco2",)),
    (r"\bkWh\b", "kWh", True, ("kwh",)),
    (r"\bMWh\b", "MWh", True, ("mwh",)),
    (r"\bgigatonnes?\b", "Gt", True, ("gigatonne",)),
]

MISSING_VALUES: Rules = [
    (r"reduce\s+emissions\s+by\s+___?%", "reduce emissions by MISSING%", True, ("emissions",)),
    (r"around\s+(\d+)%", r"≈\1%", True, ("around",)),
    (r"less\s+than\s+(\d+)%", r"<\1%", True, ("less",)),
    (r"more\s+than\s+(\d+)%", r">\1%", True, ("more",)),
    (r"(\d)[–-](\d+)%", r"\1-\2%", False, ("%",)),
    (r"(\d)[–-]___%", r"\1-MISSING%", False, ("%",)),
]

CAPTIONS: Rules = [
    (r"\b(figure|table|chart|graph)\s+\d+[.:]\s*[^\n]*", "", True, ("figure", "table", "chart", "graph")),
    (r"\b(fig|tab)\.\s*\d+[.:]\s*[^\n]*", "", True, ("fig.", "tab.")),
    (r"\(see\s+(figure|table|chart)\s+\d+\)", "", True, ("(see",)),
]

SENTENCE_BOUNDARIES: Rules = [
    (r"([.!?])([A-Z])", r"\1 \2", False, ()),
    (r"[.]{2,}", ".", False, ("..",)),
    (r"[!]{2,}", "!", False, ("!!",)),
    (r"[?]{2,}", "?", False, ("??",)),
    (r"([a-zA-Z])[^\S\n]*\n\s*([A-Z])", r"\1. \2", False, ("\n",)),
]

SECTION_HEADINGS = [
    (r"\b(introduction|executive\s+summary)\b", ("introduction", "executive")),
    (r"\b(objectives?|goals?|targets?)\b", ("objective", "goal", "target")),
    (r"\b(mitigation|adaptation)\b", ("mitigation", "adaptation")),
    (r"\b(implementation|monitoring)\b", ("implementation", "monitoring")),
    (r"\b(conclusion|summary)\b", ("conclusion", "summary")),
    (r"\b(annex|appendix)\b", ("annex", "appendix")),
]

FOOTNOTES: Rules = [(r"\[\d+\]", "", False, ("[",)), (r"\(\d+\)", "", False, ("(",))]

TERMS: Rules = [
    (r"\bcarbon\s+dioxide\b", "CO2", True, ("carbon",)),
    (r"\bmethane\b", "CH4", True, ("methane",)),
    (r"\bnitrous\s+oxide\b", "N2O", True, ("nitrous",)),
    (r"\bgreenhouse\s+gas(es)?\b", "GHG", True, ("greenhouse",)),
    (r"\bemission\s+reduction(s)?\b", "mitigation", True, ("emission",)),
    (r"\bclimate\s+change\s+adaptation\b", "adaptation", True, ("climate",)),
    (r"\brenewable\s+energy\b", "renewable energy", True, ("renewable",)),
    (r"\benergy\s+efficiency\b", "energy efficiency", True, ("efficiency",)),
    (r"\bnational(ly)?\s+determined\s+contribution(s)?\b", "NDC", True, ("determined",)),
    (r"\bparis\s+agreement\b", "Paris Agreement", True, ("paris",)),
    (r"\bkyoto\s+protocol\b", "Kyoto Protocol", True, ("kyoto",)),
]

BOILERPLATE: Rules = [
    (r"\bhereby\s+acknowledge(s)?\b", "", True, ("hereby",)),
    (r"\bthereof\s+and\s+thereto\b", "", True, ("thereof",)),
    # The line break that ends a recital stays.
    (r"\bwhereas\b[^\n]*(\n)", r"\1", True, ("whereas",)),
    (r"\bnow\s+therefore\b", "", True, ("therefore",)),
    (r"\bin\s+witness\s+whereof\b", "", True, ("witness",)),
]

COUNTRIES = ["united states", "european union", "china", "india", "brazil", "russia", "japan"]

POLICY_WORDS = ["policy", "regulation", "law", "act", "strategy", "plan", "framework", "guidance", "directive", "measure"]

#: Category -> substrings of the lower-cased sentence.
CATEGORIES = {
    "Mitigation_Targets": ["reduce emissions", "carbon neutral", "renewable", "net zero"],
    "Adaptation_Strategies": ["resilience", "adaptation", "coastal protection", "climate-proof"],
    "Finance_Commitments": ["funding", "finance", "investment", "billion", "million usd"],
    "Legislation_Policies": ["act", "law", "policy", "framework", "regulation"],
    "Stakeholders": ["government", "ministry", "organization", "ngo", "stakeholder"],
    "Sectors_Covered": ["energy", "transport", "agriculture", "forestry", "waste", "industry"],
    "Monitoring_Reporting": ["monitoring", "reporting", "verification", "mrv", "tracking progress"],
    "International_Cooperation": ["paris agreement", "unfccc", "bilateral", "international", "cooperation"],
    "Institutional_Arrangements": ["committee", "council", "agency", "authority", "institution"],
    "Social_Community": ["community", "indigenous", "gender", "health", "vulnerable"],
    "Technology_Innovation": ["technology", "innovation", "research", "development", "carbon capture", "hydrogen"],
}
#: The one category that goes by a pattern on the sentence as it stands.
TARGET_CATEGORY, TARGET_YEAR = "Targets_Timelines", r"\b(20[2-5][0-9])\b"
#: All twelve in the order of the report.
CATEGORY_ORDER = ["Mitigation_Targets", "Adaptation_Strategies", "Finance_Commitments", "Legislation_Policies", "Stakeholders", "Targets_Timelines", "Sectors_Covered", "Monitoring_Reporting", "International_Cooperation", "Institutional_Arrangements", "Social_Community", "Technology_Innovation"]

#: Impact -> (words that open the gate, words that raise it, words that lower it).
IMPACTS = {
    "temperature": (["temperature", "warming", "heat", "cooling", "thermal"], ["increase", "rise", "higher", "hot"], ["decrease", "reduce", "lower", "cool"]),
    "humidity": (["humidity", "moisture", "precipitation", "rainfall"], ["increase", "more", "higher", "wet"], ["decrease", "less", "lower", "dry"]),
    "wind": (["wind", "breeze", "gust", "storm"], ["increase", "strong", "higher", "severe"], ["decrease", "weak", "lower", "mild"]),
}

RECOMMENDATION = "Content-based recommendation using cosine similarity on historical weather-like features."

# ---- own word list --------------------------------------------------------------------------

#: Words that carry no topic.
STOP_WORDS = "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own per same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with within would you your".split()


def date_rules() -> Rules:
    """Month names to numbers, one set of rules a month; one-digit days are padded first."""
    names = [(name, f"{i:02d}") for i, name in enumerate(MONTHS, 1)]
    made: Rules = []
    for name, mm in names:
        made += [(rf"(\d)(?<!\d\d)(st|nd|rd|th)?\s+{name}\s+(\d{{4}})", rf"\3-{mm}-0\1", True, (name,)), (rf"(\d{{2}})(st|nd|rd|th)?\s+{name}\s+(\d{{4}})", rf"\3-{mm}-\1", True, (name,))]
    for name, mm in names:
        made += [(rf"{name}\s+(\d),?\s+(\d{{4}})", rf"\2-{mm}-0\1", True, (name,)), (rf"{name}\s+(\d{{2}}),?\s+(\d{{4}})", rf"\2-{mm}-\1", True, (name,))]
    return made + [(rf"(\d{{4}}),?\s+{name}", rf"\1-{mm}", True, (name,)) for name, mm in names]


def number_word_rules() -> Rules:
    return [(rf"\b{word}\b", digits, True, (word,)) for word, digits in NUMBER_WORDS.items()]


def heading_rules() -> Rules:
    """A heading at the start of a line is set apart; (?m) holds for the pattern."""
    return [(f"(?m)^({p})", "\n=== \\1 ===\n", True, needles) for p, needles in SECTION_HEADINGS]


def country_rules() -> Rules:
    return [(rf"\b{c}\b", c.title(), True, (c,)) for c in COUNTRIES] + [(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", r"\3-\2-\1", False, ("/",))]


#: From an annex or a list of references to the next blank line or the end; the blank line stays.
ANNEXES: Rules = [(r"(?s)\bannex\s+[a-z]\b.*?(\n\n|\z)", r"\1", True, ("annex",)), (r"(?s)\b(references?|bibliography)\s*\n.*?(\n\n|\z)", r"\2", True, ("reference", "bibliography")), *FOOTNOTES]
