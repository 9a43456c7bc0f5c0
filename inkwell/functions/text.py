"""Text similarity as Column expressions: normalisation, edit distance, error rates, structure.

A null text counts as an empty one. An empty reference and an empty hypothesis
have error 0, an empty reference alone has error 1; rates may exceed 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word codes start at this code point and leave out the surrogates; a pair of texts may have MOST_CODES different words.
FIRST_CODE = 0x4E00
MOST_CODES = 0x110000 - FIRST_CODE - 0x800


def normalize(text: Column, profile: str = "standard") -> Column:
    """Lower case, single spaces, trimmed; the standard profile also drops what is no letter, digit, underscore or space."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if profile == "standard":
        low = F.regexp_replace(low, r"[^\p{L}\p{N}_\s\p{Z}]", "")
    elif profile != "notebook":
        raise ValueError("profile is standard or notebook")
    return F.trim(F.regexp_replace(low, r"[\s\p{Z}]+", " "))


def rate(distance: Column, size: Column, other_empty: Column) -> Column:
    """distance / size, with the rules for an empty reference."""
    return F.when(size == 0, F.when(other_empty, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(distance / size)


def cer(reference: Column, hypothesis: Column, normalized: bool = True, profile: str = "standard") -> Column:
    """Character error rate."""
    r, h = (normalize(c, profile) if normalized else F.coalesce(c, F.lit("")) for c in (reference, hypothesis))
    return rate(F.levenshtein(r, h).cast("double"), F.length(r), F.length(h) == 0)


def tokens(normalized: Column) -> Column:
    return F.when(F.length(normalized) == 0, F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance between arrays of words: each different word becomes one character; more than MOST_CODES of them are an error."""
    known = F.array_distinct(F.concat(reference, hypothesis))
    known = F.when(F.size(known) <= MOST_CODES, known).otherwise(F.raise_error(F.lit(f"more than {MOST_CODES} different words in a pair of texts")))

    def code(known: Column, word: Column) -> Column:
        at = F.array_position(known, word) + F.lit(FIRST_CODE - 1)
        at = F.when(at >= 0xD800, at + 0x800).otherwise(at)
        return F.decode(F.unhex(F.lpad(F.hex(at), 8, "0")), "UTF-32")

    def distance(known: Column) -> Column:
        coded = [F.array_join(F.transform(words, lambda w: code(known, w)), "") for words in (reference, hypothesis)]
        return F.levenshtein(*coded)

    # a one-element array binds the list of words, which would be built again for every word otherwise
    return F.element_at(F.transform(F.array(known), distance), 1)


def raw_tokens(text: Column) -> Column:
    """The words between white space, as they are."""
    return tokens(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " ")))


def wer(reference: Column, hypothesis: Column, profile: str = "standard", normalized: bool = True) -> Column:
    """Word error rate."""
    r, h = (tokens(normalize(c, profile)) if normalized else raw_tokens(c) for c in (reference, hypothesis))
    return rate(word_distance(r, h).cast("double"), F.size(r), F.size(h) == 0)


def notebook_wer(reference: Column, hypothesis: Column) -> Column:
    """The notebook's rate: character distance of the words, a line each, over the number of reference words."""
    r, h = (tokens(normalize(c, "notebook")) for c in (reference, hypothesis))
    return rate(F.levenshtein(F.array_join(r, "\n"), F.array_join(h, "\n")).cast("double"), F.size(r), F.size(h) == 0)


def accuracy(cer_normalized: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - cer_normalized)


def numeric_cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate of the digits 0-9 alone."""
    r, h = (F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "") for c in (reference, hypothesis))
    return rate(F.levenshtein(r, h).cast("double"), F.length(r), F.length(h) == 0)


# The status texts of a structure that is missing, invented, kept or absent.
TABLE_TEXTS = (
    "Table detected in Ground Truth, but missing in OCR output.",
    "Table detected in OCR output, but not in Ground Truth (potential hallucination).",
    "Table structure preserved.",
    "No tables present in document.",
)
MATH_TEXTS = (
    "Math notation detected in Ground Truth, but missing in OCR output.",
    "Math notation detected in OCR output, but not in Ground Truth.",
    "Math notation preserved.",
    "No mathematical notation present.",
)


def has_table(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("|")) & F.contains(text, F.lit("---")), F.lit(False))


def has_math(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("$")), F.lit(False))


def kept_score(in_reference: Column, in_hypothesis: Column) -> Column:
    """1 or 0 where the reference has the structure, null where it has none."""
    return F.when(in_reference, in_hypothesis.cast("double"))


def kept_text(in_reference: Column, in_hypothesis: Column, texts: tuple[str, str, str, str]) -> Column:
    missing, invented, kept, absent = texts
    return F.when(in_reference & ~in_hypothesis, missing).when(~in_reference & in_hypothesis, invented).when(in_reference, kept).otherwise(absent)


def standard_scores(reference: Column, hypothesis: Column) -> dict[str, Column]:
    """All scores of the standard mode."""
    error = cer(reference, hypothesis)
    tables, maths = [has_table(c) for c in (reference, hypothesis)], [has_math(c) for c in (reference, hypothesis)]
    return {
        "cer": error,
        "cer_raw": cer(reference, hypothesis, normalized=False),
        "wer": wer(reference, hypothesis),
        "wer_raw": wer(reference, hypothesis, normalized=False),
        "accuracy": accuracy(error),
        "table_score": kept_score(*tables),
        "table_status": kept_text(*tables, TABLE_TEXTS),
        "math_score": kept_score(*maths),
        "math_status": kept_text(*maths, MATH_TEXTS),
    }
