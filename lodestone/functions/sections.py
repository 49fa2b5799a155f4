"""Rules on the sections of a full text: which stay, where an introduction begins, how lines are joined.

A section is one row with its chunks, an array of texts whose first one is or holds the heading.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openings and phrases below must equal the surveyed ones.
STARTERS = ["background", "introduction", "review", "introdution"]
_METHODS = ["materials", "methods"]
_WORK = "(?:study|work|report|paper|research|investigation|article)"
_WORKS = "(?:study|work|report|manuscript|paper|research|investigation|article)"
MARKERS = [
    rf"The present {_WORKS}\b",
    rf"In this {_WORK}\b",
    rf"This {_WORK}\b",
    rf"In the present {_WORKS}\b",
    rf"In the current {_WORKS}\b",
    rf"The aim of this {_WORKS}\b",
    rf"The purpose of this {_WORKS}\b",
    rf"The goal of this {_WORKS}\b",
    r"We (?:used|employed|showed|investigated|present|report)\b",
    r"It was (?:thus|therefore) our goal\b",
    rf"This {_WORKS} (?:was|is)\b",
    rf"Therefore, in this {_WORKS}\b",
    rf"Thus, in this {_WORKS}\b",
    r"Here we\b",
    r"Here, we\b",
    r"The research reported here\b",
    r"Inspired by this work, we\b",
    r"Based on the (?:above )?reasons, we\b",
    r"Herein,\b",
    r"Recently, we\b",
    r"We (?:describe|discuss|examine|analyze|present|investigate|report|show)\b",
]
LAST_SENTENCES = 6


def _text(chunks: Column, separator: str) -> Column:
    return F.array_join(chunks, separator, "")


def is_back_matter(chunks: Column) -> Column:
    """Whether the first two chunks say that a section is about authors, funding, ethics or supplements.

    Methods may speak of authors and ethics. Null chunks read as empty; a null or empty array is no back matter.
    """
    opening = F.lower(_text(F.slice(chunks, 1, 2), " "))
    holds = lambda word: F.contains(opening, F.lit(word))
    methods = opening.rlike(f"^(?:{'|'.join(_METHODS)})")
    always = holds("acknowledgements") | holds("funding") | holds("supplementary")
    support = holds("supporting information") & ~holds("see supporting information")
    return F.coalesce(always | support | (~methods & (holds("author") | holds("ethics statement") | holds("ethic approval"))), F.lit(False))


def heading_word(text: Column) -> Column:
    """The first word in lower-case letters, behind a Roman numeral and whatever is no letter; empty if there is none."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, r"^(?i)[ivxlcdm]+\.", "")), "^[^a-z]*", "")
    return F.regexp_replace(F.regexp_extract(bare, r"^\S+", 0), "[^a-z]", "")


def introduction(chunks: Column) -> Column:
    """The part of an introduction that tells of the work itself: all from the first marker sentence, else the last six sentences.

    Null where neither of the first two chunks starts with an introduction's word. Sentences end at a dot before a capital.
    """
    named = F.coalesce(heading_word(F.get(chunks, F.lit(0))).isin(STARTERS), F.lit(False)) | F.coalesce(heading_word(F.get(chunks, F.lit(1))).isin(STARTERS), F.lit(False))
    sentences = F.split(F.regexp_replace(_text(chunks, ""), r"\.\s+", "."), r"(?<=\.)(?=[A-Z])")
    marker = rf"(?i)^\s*(?:{'|'.join(MARKERS)})"

    def told(s: Column) -> Column:
        at = F.array_position(F.transform(s, lambda x: x.rlike(marker)), True)
        return F.when(at > 0, F.slice(s, at.cast("int"), F.size(s))).when(F.size(s) > LAST_SENTENCES, F.slice(s, -LAST_SENTENCES, LAST_SENTENCES)).otherwise(s)

    # an array of one element binds the sentences, which would be cut again for each use otherwise
    return F.when(named, F.array_join(F.get(F.transform(F.array(sentences), told), F.lit(0)), " "))


def joined_lines(text: Column) -> Column:
    """Line breaks with a capital on neither side become blanks."""
    return F.regexp_replace(text, r"(?<![A-Z])\n(?![A-Z])", " ")


def without_primers(text: Column) -> Column:
    """DNA between 5′ and 3′ out."""
    return F.regexp_replace(text, "5′-?[ACGTNacgnt]+-?3′", "")


def section_text(place: Column, chunks: Column) -> Column:
    """The text of the section at a place (from 0): of the first, the introduction under its name, or null; of others, all chunks."""
    intro = F.concat(F.lit("Introduction:\n"), introduction(chunks))
    return joined_lines(F.regexp_replace(F.when(place == 0, intro).otherwise(_text(chunks, " ")), r"\s{2,}", " "))
