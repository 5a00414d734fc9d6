"""Our wording, keyed by the ids of recommendations and next steps.

Texts state what a rule measured. ``%s`` takes the values named beside a text, in order; they are
the columns of :func:`values`.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = tuple[str, Sequence[str]]


class Step(NamedTuple):
    title: str
    why: Text
    how: Text
    example: str | None = None


class Advice(NamedTuple):
    what: Text
    why: Text
    how: Text


RECOMMENDATIONS = {
    "rewrite_off_topic": Advice(
        ("%s of %s chunks are off topic", ("off", "total")),
        ("An off-topic chunk counts 0 in the coverage score, which is a mean over all chunks.", ()),
        ("Raise the listed chunks to %s, where they begin to count, or delete them.", ("weak_from",)),
    ),
    "strengthen_weak": Advice(
        ("%s chunks lie between %s and %s", ("weak", "weak_from", "moderate_from")),
        ("Such a chunk counts 0.2; from %s on it counts 0.6.", ("moderate_from",)),
        ("Say in the listed chunks, in the topic's own terms, how they bear on it.", ()),
    ),
    "expand_strong": Advice(
        ("%s chunks score %s or more", ("strong", "strong_from")),
        ("The example is the chunk closest to the topic, so its words are known to work.", ()),
        ("Use them in the listed chunks.", ()),
    ),
    "restructure_section": Advice(
        ("%s sections score below 40, the first of them '%s' with %s", ("low_sections", "low_heading", "low_score")),
        ("A section is scored over its heading and the chunks right below it.", ()),
        ("Move out what does not belong to the heading, or write a heading for what is there.", ()),
    ),
    "remove_dilution": Advice(
        ("%s strong chunks stand beside %s off-topic ones", ("strong", "off")),
        ("Both groups hold a fifth of the chunks or more, and the second pulls the mean down.", ()),
        ("Shorten or delete the listed chunks: the mean rises without a new word.", ()),
    ),
}

NEXT_STEPS = {
    "front_load": Step(
        "Bring the topic to the start",
        ("The first 200 words hold %s %% of the topic's terms; the closest chunk begins after %s %% of the chunks.", ("intro_share", "best_share")),
        ("Put a passage that uses these terms into the first fifth of the text.", ()),
        "<topic>: what it is, and which question about it is answered below.",
    ),
    "add_definition": Step(
        "Say what the topic is",
        ("Within the first 220 words no sentence with is, are, means or refers to goes with a term of the topic.", ()),
        ("Write one, with the topic as its subject.", ()),
        "<topic> means ...",
    ),
    "reduce_drift": Step(
        "Deal with the off-topic chunks",
        ("%s of %s chunks score below %s.", ("off", "total", "weak_from")),
        ("Each of them has to reach %s, or to go.", ("weak_from",)),
    ),
    "strengthen_weak": Step(
        "Lift the weak chunks",
        ("%s chunks score from %s to %s.", ("weak", "weak_from", "moderate_from")),
        ("Name the topic in them where they only allude to it, until they reach %s.", ("moderate_from",)),
    ),
    "add_steps": Step(
        "Number the procedure",
        ("The query asks how something is done, and no line begins with a number or the word step.", ()),
        ("Write one action per line and number the lines.", ()),
        "1. ...\n2. ...",
    ),
    "add_comparison": Step(
        "Set the options against each other",
        ("The query is about choosing or buying; in %s words nothing is compared.", ("words",)),
        ("Name the options in one place and say where they differ.", ()),
        "<option> vs <option>: ...",
    ),
    "add_headings": Step(
        "Break the text up by headings",
        ("%s words run on without a heading of level 2 or 3.", ("words",)),
        ("Begin a section wherever the subject changes.", ()),
        "## <what this part is about>",
    ),
    "add_evidence": Step(
        "Show where claims come from",
        ("The text has %s links, and a section of sources: %s.", ("links", "sources")),
        ("Link the origin of each claim, and repeat the links under a heading of their own.", ()),
        "## Sources",
    ),
    "add_examples": Step(
        "Give an example",
        ("In %s words nothing is introduced as one.", ("words",)),
        ("Let a concrete case follow the main claim.", ()),
        "For example, ...",
    ),
    "add_faq": Step(
        "List the questions that are answered",
        ("The text has %s words and no list of questions.", ("words",)),
        ("Gather them under one heading, each with its answer.", ()),
        "## FAQ",
    ),
    "add_summary_box": Step(
        "Sum up at the top",
        ("The text has %s words; its first 800 characters hold no summary.", ("words",)),
        ("Write down there what a reader should remember.", ()),
        "TL;DR ...",
    ),
}

EMPTY_REPORT = "There is no chunk, so nothing was measured."

#: Step report headline by coverage floor.
HEADLINES = (
    (80.0, "Coverage is 80 or more: what is left are details."),
    (60.0, "Coverage is between 60 and 80: chunks below the moderate band make the difference."),
    (40.0, "Coverage is between 40 and 60: the steps at the top of the list weigh most."),
)
LOWEST_HEADLINE = "Coverage is below 40: most of the text is about something else."

#: Recommendation report headline where nothing is recommended, by coverage floor.
NOTHING_TO_DO = (
    (80.0, "No rule applies; coverage is 80 or more."),
    (60.0, "No rule applies; coverage is between 60 and 80."),
)
LITTLE_TO_SAY = "No rule applies, yet coverage is below 60."


def values(columns: Sequence[str]) -> dict[str, Column]:
    """The values texts may name, from report columns; those whose columns are missing are left out."""

    def share(c: str) -> Column:
        return F.bround(F.col(c) * 100).cast("int").cast("string")

    def edge(name: str) -> Column:
        return F.format_string("%.2f", F.col("bands")[name])

    low = F.col("first_low_section")
    known: dict[str, tuple[str, Column | None]] = {
        "total": ("total_chunks", None), "off": ("chunks_off_topic", None), "weak": ("chunks_weak", None),
        "strong": ("chunks_strong", None), "low_sections": ("low_sections", None), "words": ("word_count", None),
        "links": ("link_count", None),
    }
    out = {name: F.col(c).cast("string") for name, (c, _) in known.items() if c in columns}
    if "bands" in columns:
        out |= {f"{b}_from": edge(b) for b in ("strong", "moderate", "weak")}
    if "intro_query_term_coverage" in columns:
        out |= {"intro_share": share("intro_query_term_coverage")}
    if "best_position" in columns:
        out |= {"best_share": share("best_position")}
    if "has_sources_section" in columns:
        out |= {"sources": F.when(F.col("has_sources_section"), "yes").otherwise("no")}
    if "first_low_section" in columns:
        out |= {
            "low_heading": F.coalesce(low["heading"], F.lit("")),
            "low_score": F.bround(low["coverage_score"]).cast("int").cast("string"),
        }
    return out


def fill(text: Text, known: dict[str, Column]) -> Column:
    """The text with its values; a value that is not known is shown as a dash."""
    template, names = text
    if not names:
        return F.lit(template)
    return F.format_string(template, *[known.get(n, F.lit("-")) for n in names])
