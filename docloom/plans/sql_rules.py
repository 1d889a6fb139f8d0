"""Fixed values of the SQL side, spelled out for RE2 apart from those of the Spark side, so that a wrong rule of
one of them shows.

Patterns, replacements and word lists are fixed values, in the order in which they apply.
"""

from __future__ import annotations

#: (pattern, replacement, ignore case).
Rule = tuple[str, str, bool]

# ---- fixed values -------------------------------------------------------------------------

ACRONYMS = ["UNFCCC", "IPCC", "NDC", "EU", "UNEP", "GHG", "CO2", "CH4", "N2O", "LULUCF", "CDM", "JI", "ETS", "COP", "CMP", "SBI", "SBSTA", "NAMA", "MRV", "ICA", "BUR", "NC", "AR", "WG", "SPM", "TS", "FAQ"]

PAGE_LINE = r"^page\s+\d+(\s+of\s+\d+)?$"
HEADER_FOOTER_LINES = [r"^(ministry|department|government).*\d{4}$", r"^draft.*\d{4}$", "^confidential.*draft$", r"^\d+\s*$", r"^page\s+\d+", r"^\d{1,3}\s+of\s+\d{1,3}$"]

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

PERCENTAGES: list[Rule] = [
    (r"(\d+)\s*%", r"\1%", False),
    (r"(\d+)\s+percent", r"\1%", True),
]

YEARS: list[Rule] = [
    (r"\byear\s+(\d{4})\b", r"\1", True),
    (r"\bby\s+the\s+year\s+(\d{4})\b", r"by \1", True),
    (r"\bin\s+'([0-4]\d)\b", r"in 20\1", False),
    (r"\bin\s+'([5-9]\d)\b", r"in 19\1", False),
]

CURRENCIES: list[Rule] = [
    (r"\$(\d+)bn\b", r"\1,000,000,000 USD", True),
    (r"\$(\d+)m\b", r"\1,000,000 USD", True),
    (r"(\d+)\s+billion\s+USD", r"\1,000,000,000 USD", True),
    (r"Rs\.?\s*(\d+)\s+million", r"\1,000,000 INR", True),
]

EMISSION_UNITS: list[Rule] = [
    (r"(\d+)\s*MtCO2e?\b", r"\1 million tonnes CO2e", True),
    (r"(\d+)\s*GtCO2e?\b", r"\1 billion tonnes CO2e", True),
    (r"\bkWh\b", "kWh", True),
    (r"\bMWh\b", "MWh", True),
    (r"\bgigatonnes?\b", "Gt", True),
]

MISSING_VALUES: list[Rule] = [
    (r"reduce\s+emissions\s+by\s+___?%", "reduce emissions by MISSING%", True),
    (r"around\s+(\d+)%", r"≈\1%", True),
    (r"less\s+than\s+(\d+)%", r"<\1%", True),
    (r"more\s+than\s+(\d+)%", r">\1%", True),
    (r"(\d+)[–-](\d+)%", r"\1-\2%", False),
    (r"(\d+)[–-]___%", r"\1-MISSING%", False),
]

CAPTIONS: list[Rule] = [
    (r"\b(figure|table|chart|graph)\s+\d+[.:]\s*[^\n]*", "", True),
    (r"\b(fig|tab)\.\s*\d+[.:]\s*[^\n]*", "", True),
    (r"\(see\s+(figure|table|chart)\s+\d+\)", "", True),
]

SENTENCE_BOUNDARIES: list[Rule] = [
    ("([.!?])([A-Z])", r"\1 \2", False),
    ("[.]{2,}", ".", False),
    ("[!]{2,}", "!", False),
    ("[?]{2,}", "?", False),
    (r"([a-zA-Z])\s*\n\s*([A-Z])", r"\1. \2", False),
]

WRITTEN_NUMBERS: list[Rule] = [
    (r"\btwenty\b", "20", True),
    (r"\bthirty\b", "30", True),
    (r"\bforty\b", "40", True),
    (r"\bfifty\b", "50", True),
    (r"\bsixty\b", "60", True),
    (r"\bseventy\b", "70", True),
    (r"\beighty\b", "80", True),
    (r"\bninety\b", "90", True),
    (r"\bhundred\b", "100", True),
    (r"\bthousand\b", "1000", True),
    (r"\bmillion\b", "1000000", True),
    (r"\bbillion\b", "1000000000", True),
]

HEADINGS: list[Rule] = [
    (r"(?m)^(\b(introduction|executive\s+summary)\b)", "\n=== \\1 ===\n", True),
    (r"(?m)^(\b(objectives?|goals?|targets?)\b)", "\n=== \\1 ===\n", True),
    (r"(?m)^(\b(mitigation|adaptation)\b)", "\n=== \\1 ===\n", True),
    (r"(?m)^(\b(implementation|monitoring)\b)", "\n=== \\1 ===\n", True),
    (r"(?m)^(\b(conclusion|summary)\b)", "\n=== \\1 ===\n", True),
    (r"(?m)^(\b(annex|appendix)\b)", "\n=== \\1 ===\n", True),
]

ANNEXES: list[Rule] = [
    (r"(?s)\bannex\s+[a-z]\b.*?(\n\n|\z)", r"\1", True),
    (r"(?s)\b(references?|bibliography)\s*\n.*?(\n\n|\z)", r"\2", True),
    (r"\[\d+\]", "", False),
    (r"\(\d+\)", "", False),
]

TERMS: list[Rule] = [
    (r"\bcarbon\s+dioxide\b", "CO2", True),
    (r"\bmethane\b", "CH4", True),
    (r"\bnitrous\s+oxide\b", "N2O", True),
    (r"\bgreenhouse\s+gas(es)?\b", "GHG", True),
    (r"\bemission\s+reduction(s)?\b", "mitigation", True),
    (r"\bclimate\s+change\s+adaptation\b", "adaptation", True),
    (r"\brenewable\s+energy\b", "renewable energy", True),
    (r"\benergy\s+efficiency\b", "energy efficiency", True),
    (r"\bnational(ly)?\s+determined\s+contribution(s)?\b", "NDC", True),
    (r"\bparis\s+agreement\b", "Paris Agreement", True),
    (r"\bkyoto\s+protocol\b", "Kyoto Protocol", True),
]

BOILERPLATE: list[Rule] = [
    (r"\bhereby\s+acknowledge(s)?\b", "", True),
    (r"\bthereof\s+and\s+thereto\b", "", True),
    (r"\bwhereas\b[^\n]*(\n)", r"\1", True),
    (r"\bnow\s+therefore\b", "", True),
    (r"\bin\s+witness\s+whereof\b", "", True),
]

COUNTRIES: list[Rule] = [
    (r"\bunited states\b", "United States", True),
    (r"\beuropean union\b", "European Union", True),
    (r"\bchina\b", "China", True),
    (r"\bindia\b", "India", True),
    (r"\bbrazil\b", "Brazil", True),
    (r"\brussia\b", "Russia", True),
    (r"\bjapan\b", "Japan", True),
    (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", r"\3-\2-\1", False),
]

POLICY_WORDS = ["policy", "regulation", "law", "act", "strategy", "plan", "framework", "guidance", "directive", "measure"]

#: Category -> substrings of the lower-cased sentence; one goes by a pattern.
CATEGORIES = {
    "Mitigation_Targets": ["reduce emissions", "carbon neutral", "renewable", "net zero"],
    "Adaptation_Strategies": ["resilience", "adaptation", "coastal protection", "climate-proof"],
    "Finance_Commitments": ["funding", "finance", "investment", "billion", "million usd"],
    "Legislation_Policies": ["act", "law", "policy", "framework", "regulation"],
    "Stakeholders": ["government", "ministry", "organization", "ngo", "stakeholder"],
    "Targets_Timelines": None,
    "Sectors_Covered": ["energy", "transport", "agriculture", "forestry", "waste", "industry"],
    "Monitoring_Reporting": ["monitoring", "reporting", "verification", "mrv", "tracking progress"],
    "International_Cooperation": ["paris agreement", "unfccc", "bilateral", "international", "cooperation"],
    "Institutional_Arrangements": ["committee", "council", "agency", "authority", "institution"],
    "Social_Community": ["community", "indigenous", "gender", "health", "vulnerable"],
    "Technology_Innovation": ["technology", "innovation", "research", "development", "carbon capture", "hydrogen"],
}
TARGET_YEAR = r"\b(20[2-5][0-9])\b"

#: Impact -> (gate, words that raise it, words that lower it).
IMPACTS = {
    "temperature": (["temperature", "warming", "heat", "cooling", "thermal"], ["increase", "rise", "higher", "hot"], ["decrease", "reduce", "lower", "cool"]),
    "humidity": (["humidity", "moisture", "precipitation", "rainfall"], ["increase", "more", "higher", "wet"], ["decrease", "less", "lower", "dry"]),
    "wind": (["wind", "breeze", "gust", "storm"], ["increase", "strong", "higher", "severe"], ["decrease", "weak", "lower", "mild"]),
}

_MONTH = "(?:" + "|".join(MONTHS) + ")"
#: Label -> pattern of entities; at one place the first label wins.
ENTITIES = {
    "DATE": rf"\d{{4}}-\d{{2}}(?:-\d{{2}})?|\d{{1,2}}(?:st|nd|rd|th)? {_MONTH} \d{{4}}|{_MONTH} \d{{1,2}},? \d{{4}}|{_MONTH} \d{{4}}|\b(?:19|20)\d{{2}}\b",
    "MONEY": r"[$€£]\s?\d[\d,.]*(?:\s?(?:bn|billion|million|m)\b)?|\d[\d,.]* (?:USD|INR|EUR)\b",
    "PERCENT": r"\d+(?:\.\d+)?(?: ?%| percent\b)",
    "CARDINAL": r"\b\d[\d,]*(?:\.\d+)?\b",
}


def dates() -> list[Rule]:
    """Day, month, year; month, day, year; year, month: the months one after another in each form, one-digit days first in the first two."""
    made: list[Rule] = []
    for i, name in enumerate(MONTHS, 1):
        made.append((rf"(^|[^\d])(\d)(st|nd|rd|th)?\s+{name}\s+(\d{{4}})", rf"\1\4-{i:02d}-0\2", True))
        made.append((rf"(\d{{2}})(st|nd|rd|th)?\s+{name}\s+(\d{{4}})", rf"\3-{i:02d}-\1", True))
    for i, name in enumerate(MONTHS, 1):
        made.append((rf"{name}\s+(\d),?\s+(\d{{4}})", rf"\2-{i:02d}-0\1", True))
        made.append((rf"{name}\s+(\d{{2}}),?\s+(\d{{4}})", rf"\2-{i:02d}-\1", True))
    return made + [(rf"(\d{{4}}),?\s+{name}", rf"\1-{i:02d}", True) for i, name in enumerate(MONTHS, 1)]
