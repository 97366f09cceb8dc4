"""Default word lists and constants. Every operator takes them as parameters."""

# --- fixed values -----------------------------------------------------------------------------
RISK_TERMS = (
    "strike",
    "shutdown",
    "closed",
    "closure",
    "flood",
    "storm",
    "cyclone",
    "earthquake",
    "war",
    "sanction",
    "shortage",
    "disruption",
    "delay",
    "congestion",
    "fire",
    "bankruptcy",
    "recall",
)

# Denied risks, blanked one after the other before the risk terms are looked up.
NEGATIONS = (
    "no (?:material )?shortage",
    "no disruption",
    "no delays?",
    "not affected",
    "without disruption",
)

EVENT_KEYWORDS = {
    "Port or transport disruption": (
        "port",
        "strike",
        "shipping",
        "congestion",
        "transport",
        "rail",
    ),
    "Extreme weather": ("flood", "storm", "cyclone", "hurricane", "earthquake", "weather"),
    "Factory shutdown": ("factory", "plant", "shutdown", "closure", "fire"),
    "Material shortage": ("shortage", "scarcity", "raw material", "semiconductor", "component"),
    "Geopolitical disruption": ("war", "sanction", "border", "political", "conflict", "tariff"),
    "Financial distress": ("bankruptcy", "insolvency", "default", "financial distress"),
    "Quality or recall": ("recall", "defect", "contamination", "quality failure"),
}

SEVERITY_WORDS = {
    "critical": 1.0,
    "major": 0.85,
    "severe": 0.85,
    "emergency": 0.9,
    "closed": 0.8,
    "shutdown": 0.8,
    "delay": 0.55,
    "warning": 0.45,
}

DAYS_PER_UNIT = {"day": 1, "week": 7, "month": 30}

COMPANY_SUFFIXES = ("limited", "ltd", "inc", "corp", "corporation", "company", "co")

NO_EVENT = "No relevant external event"
OTHER_EVENT = "Other disruption"
NO_DISRUPTION = "No disruption"

# Loss and probability floors, priority, action; the first line that holds wins.
PRIORITY_RULES = (
    (250_000, 0.78, "Critical", "Escalate and activate backup"),
    (100_000, 0.62, "High", "Contact supplier and prepare backup"),
    (25_000, 0.45, "Medium", "Monitor closely"),
)
LOWEST_PRIORITY = ("Low", "Continue routine monitoring")

# Texts that a CSV reader takes for a missing value.
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
