"""Word lists, patterns and formats that decide results.

Everything here must keep exactly this content for results to agree with
existing stores, logs and evaluation files. Logic lives elsewhere.
"""

# Characters Python's str.strip() removes (Unicode whitespace plus separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Characters the sparse tokenizer turns into spaces.
TOKEN_PUNCTUATION = "[]().,:;!?-*"

# Words ignored by the set-similarity tokenizer.
JACCARD_STOPWORDS = (
    "the", "a", "an", "of", "in", "and", "for", "to", "is",
    "on", "at", "by", "with", "from", "or", "as", "are",
)

# Okapi BM25 parameters, fusion constant, list depths.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_CONSTANT = 60
TOP_K = 6
POOL_EXTRA = 4

# Parser defaults and limits.
DEFAULT_TITLE = "Unknown Framework"
DEFAULT_CHAPTER = "Global Context"
MIN_PROSE_CHARS = 40
NOTE_CHARS = 300
FIGURE_CHARS = 180
RAW_ROW_CHARS = 120
PRIMARY_COLUMNS = (
    "Recommendations [R], Considerations [C], and Notes [N]",
    "Suggested Action",
    "Requirement",
)

# Reference identifiers: function keywords and their canonical prefix.
FUNCTION_PREFIX = {
    "govern": "GOVERN", "gv": "GOVERN",
    "measure": "MEASURE", "me": "MEASURE",
    "manage": "MANAGE", "mn": "MANAGE",
    "map": "MAP", "mp": "MAP",
}
SHORT_PREFIX = {"GV": "GOVERN", "ME": "MEASURE", "MN": "MANAGE", "MP": "MAP"}
UNIVERSAL_ID = r"\b([A-Z]{2,7})[-.\s](\d+(?:\.\d+)*)\b"
STANDARD_IDS = (
    r"ISO(?:/IEC)?\s*\d{4,5}(?:[-:]\d+)*",
    r"(?:NIST\s+)?SP\s+\d{3}-\d{3}[A-Z]?",
    r"NIST\s+AI\s+\d{3}(?:-\d+)?(?:[A-Z]|e\d+)?",
    r"(?:E\.?O\.?|Executive\s+Order)\s+\d{5}",
    r"FIPS\s+(?:PUB\s+)?\d+(?:-\d+)*",
    r"RFC\s+\d{4,5}",
    r"IEEE\s+\d{3,5}(?:\.\d+)*",
)

# Cleaning profiles: where the body starts and what boilerplate to delete.
CLEAN_PROFILES = {
    "800-218A": {
        "anchor": "## 1. Introduction",
        "junk": (
            r"NIST Special Publication 800 NIST SP 800-218A",
            r"Secure Software Development Practices for Generative AI.*",
            r"This publication is available free of charge from:.*",
            r"https://doi.org/10.6028/NIST.SP.800-218A",
        ),
    },
    "100-1": {
        "anchor": "## Executive Summary",
        "junk": (
            r"NIST AI 100-1",
            r"Artificial Intelligence Risk Management Framework \(AI RMF 1\.0\)",
            r"This publication is available free of charge from: https://doi\.org/10\.6028/NIST\.AI\.100-1",
            r"January 2023",
            r"U\.S\. Department of Commerce.*",
            r"National Institute of Standards and Technology.*",
            r"Page \d+",
        ),
    },
    "600-1": {
        "anchor": "## 1. Introduction",
        "junk": (
            r"NIST AI 600-1",
            r"NIST Trustworthy and Responsible AI",
            r"Artificial Intelligence Risk Management Framework: Generative Artificial Intelligence Profile",
            r"This publication is available free of charge from: https://doi\.org/10\.6028/NIST\.AI\.600-1",
            r"July 2024",
            r"U\.S\. Department of Commerce.*",
            r"National Institute of Standards and Technology.*",
            r"Laurie E\. Locascio.*",
            r"Gina M\. Raimondo.*",
            r"Page \d+",
        ),
    },
}

# Question classifiers, per profile. Matched on the lower-cased question.
RISK_PATTERNS = {
    "core": (
        r"which\s+\w+\s+answers",
        r"which\s+\w+\s+describes",
        r"which\s+\w+\s+property",
        r"what\s+are\s+the\s+(six|five|four|three|two|\d+)\s+\w+",
        r"what\s+is\s+\w+\s+defined",
        r"how\s+does\s+nist\s+\w+\s+define",
        r"when\s+a\s+user\s+asks",
    ),
}
RISK_PATTERNS["ui"] = RISK_PATTERNS["core"] + (
    r"what\s+are\s+(examples|some\s+examples)",
    r"(give|provide|list)\s+(me\s+)?(some\s+)?examples",
    r"examples\s+of\s+\w+",
)
LIST_PATTERNS = {
    "core": (
        r"what\s+are\s+the\s+(six|five|four|three|two|\d+)\s+\w+",
        r"list\s+the\s+\w+",
        r"name\s+the\s+(six|five|four|three|two|\d+)",
    ),
}
LIST_PATTERNS["ui"] = LIST_PATTERNS["core"] + (
    r"what\s+are\s+(examples|some\s+examples)",
    r"(give|provide|list)\s+(me\s+)?(some\s+)?examples",
)

# Answer texts and context labels.
LIST_NOTE = (
    "\n\nNote: This list may be incomplete. "
    "Refer to the original NIST source document for the full list."
)
ERROR_ANSWER = "I encountered an error while processing your request."
ERROR_SENTINEL = "ERROR_LOCAL_GENERATION_FAILED"
NO_HISTORY = "No previous conversation."
DEFAULT_SOURCE = "NIST Document"
SHORT_SOURCE = r"NIST\s+AI\s+\d+-\d+"
CONTEXT_MARK = "--- Source:"
NEIGHBOR_LABEL = "  [table context — adjacent row]\n"
FALLBACK_CHARS = 800
HISTORY_CHARS = 1000
HISTORY_CHARS_DEFAULT = 4000
CONTEXT_TOKENS = 4096

# Generation settings and stop strings.
GENERATION = {
    "temperature": 0.1, "num_predict": 600, "num_ctx": 4096, "repeat_penalty": 1.15,
    "stop": ("\n\nHuman:", "User:"),
}

# Evaluation.
METRICS = ("faithfulness", "relevance", "completeness", "correctness")
SCORE_ANCHORS = ("0.0", "0.25", "0.5", "0.75", "1.0")
HIT_THRESHOLD = 0.40
CONTEXT_LIMIT = 300_000
CONTEXT_CUT = "\n\n[... CONTEXT TRUNCATED AT SAFETY LIMIT ...]"
JUDGE_FAILURE = "JUDGE_FAILURE"
JUDGE_ATTEMPTS = 4
JUDGE_BASE_DELAY = 4.0
GOLDEN_FIELDS = ("question_category", "question", "expected_answer")
TRACE_ONLY_COLUMNS = ("generated_answer", "retrieved_context", "expected_answer")

# Log lines.
LOG_RISK = r"_classify_query_risk → (HIGH|LOW)"
LOG_TOTAL = r"Total Latency: ([\d.]+)s"
LOG_RETRIEVAL = r"\(R\): ([\d.]+)s"
LOG_GENERATION = r"\(G\): ([\d.]+)s"
LOG_LINES = 600
