"""Fixed values the results depend on, and the options a job may set."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: similarity bands -----------------------------------------
STANDARD_BANDS = {"strong": 0.80, "moderate": 0.65, "weak": 0.45}
SHORT_QUERY_BANDS = {"strong": 0.72, "moderate": 0.60, "weak": 0.42}
SHORT_QUERY_MAX_WORDS = 2
BAND_LABELS = ("Strong", "Moderate", "Weak", "Off-topic")

# --- Fixed values: coverage score -------------------------------------------
COVERAGE_WEIGHTS = {"strong": 1.0, "moderate": 0.6, "weak": 0.2, "off_topic": 0.0}
COVERAGE_LABELS = ((80.0, "Strong"), (60.0, "Moderate"), (40.0, "Weak"))
COVERAGE_FLOOR_LABEL = "Low"

# --- Fixed values: readiness score ------------------------------------------
READINESS_WEIGHTS = {"coverage": 0.50, "structure": 0.20, "evidence": 0.15, "answerability": 0.15}
READINESS_LABELS = ((80.0, "AI-ready"), (60.0, "Nearly ready"), (40.0, "Needs work"))
READINESS_FLOOR_LABEL = "Not ready"

# --- Fixed values: chunking --------------------------------------------------
TARGET_TOKENS = 150
CHARS_PER_TOKEN = 4
ATOMIC_MAX_WORDS = 100
STRATEGIES = ("flat", "markdown", "html", "auto")

# --- Fixed values: recommendations and next steps ---------------------------
OFF_TOPIC_HIGH_SHARE = 0.15
LOW_SECTION_COVERAGE = 40.0
DILUTION_SHARE = 0.20
MAX_RECOMMENDATIONS = 5
MAX_NEXT_STEPS = 7
SHORT_TARGET_LIST = 5
PREVIEW_CHARS = 80
TARGET_PREVIEW_CHARS = 60
EXAMPLE_CHARS = 200

# --- Fixed values: query terms and intent -----------------------------------
TERM_STOP_WORDS = ("with", "from", "that", "this", "your", "what", "when", "where", "which", "into")
TERM_MIN_CHARS = 4
MAX_TERMS = 8
HOW_TO_WORDS = r"how to|steps?|tutorial|guide|checklist"
COMMERCIAL_WORDS = (
    r"best|top|pricing|cost|cheap|review|tool|tools|software|platform|service|agency|template|alternatives?"
)
INTENTS = ("informational", "how_to", "commercial")

# --- Fixed values: content signal patterns ----------------------------------
TLDR_CHARS = 800
FRESHNESS_CHARS = 2000
DEFINITION_WORDS = 220
INTRO_WORDS = 200
TLDR_PATTERN = r"\bTL;?DR\b|\bSummary\b"
FAQ_PATTERN = r"\bFAQ\b|frequently asked questions"
SOURCES_HEADINGS = r"references|sources|further reading"
DEFINITION_PATTERN = r"\b(is|are|refers to|means)\b"
EXAMPLE_PATTERN = r"\b(for example|e\.g\.|example:)\b"
COMPARISON_PATTERN = r"\b(vs\.?|versus|compare|comparison|alternatives?)\b"
FRESHNESS_PATTERN = r"\b(updated|last updated|as of|new in)\b|\b20(1\d|2\d)\b"


@dataclass(frozen=True)
class ChunkOptions:
    """What a caller may change about chunking."""

    target_tokens: int = TARGET_TOKENS
    atomic_max_words: int = ATOMIC_MAX_WORDS
    split_long_paragraphs: bool = True
    #: Character ranges cost a second pass over the text; scoring jobs leave them out.
    with_offsets: bool = True


def check_strategy(name: str) -> str:
    """Bad options stop the job on the driver; bad rows only reach the rejects."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {name!r}; expected one of {', '.join(STRATEGIES)}")
    return name
