"""Text keys and matches as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that say nothing about a name.
STOP_WORDS = ("of", "the", "and", "with", "a", "an", "in", "to", "abnormal", "abnormality")


def normal(text: Column) -> Column:
    """Trimmed, lower-cased, with single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def word_key(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, after the possessive's apostrophe is dropped."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(F.lower(text), "'s", "s"), F.lit("[a-z0-9]+"), 0), " ")


def words(text: Column) -> Column:
    """Distinct words without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)), F.array(*map(F.lit, STOP_WORDS)))


def similar(query: Column, label: Column) -> Column:
    """A shared word, a shared stem of five letters or more, or one inside the other."""
    a, b = words(query), words(label)
    stem = lambda x, y: (F.length(x) >= 5) & (F.length(y) >= 5) & (F.startswith(x, y) | F.startswith(y, x))
    q, lab = F.lower(query), F.lower(label)
    return F.arrays_overlap(a, b) | F.exists(a, lambda x: F.exists(b, lambda y: stem(x, y))) | F.contains(lab, q) | F.contains(q, lab)


def slug(text: Column, separator: str = "_", most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", separator), f"^{separator}|{separator}$", ""), 1, most)


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """NFKD without combining marks, case-folded; Spark has no built-in for it."""
    one = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()
    return texts.map(one)


# Patterns of personal data in texts and pages.
PERSONAL = {
    "addresses": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "hosts": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "phones": r"\+?[0-9]{2,3}[ -][0-9]{3,4}[ -][0-9]{3,4}\b",
    "trackers": r"[?&](?:utm_source|ref|session|user)=[A-Za-z0-9]+",
}


def personal_counts(text: Column) -> list[Column]:
    """How often each pattern of PERSONAL occurs, a column each."""
    return [F.regexp_count(text, F.lit(pattern)).alias(name) for name, pattern in PERSONAL.items()]


# Characters that a search term may not hold, and names that are abbreviations.
BAD_CHARACTERS = r'[\\"“”«»`\x00-\x1f\x7f]'
ABBREVIATION = r"^[A-Z]{2,6}[0-9]{0,2}[A-Z]?$"


def search_term(name: Column) -> Column:
    """A name without quotes, backslashes and control characters, with single spaces, trimmed of punctuation."""
    return F.btrim(F.regexp_replace(F.regexp_replace(name, BAD_CHARACTERS, " "), r"\s+", " "), F.lit(" ,.:;-/'"))


def usable_term(term: Column, least: int = 4) -> Column:
    """Not several items in one, and of ``least`` letters or digits at least."""
    return ~F.contains(term, F.lit(";")) & (F.length(F.replace(word_key(term), F.lit(" "))) >= least)


def usable_name(name: Column) -> Column:
    """Four characters or more, with a word, and neither an abbreviation nor an identifier."""
    return (word_key(name) != "") & (F.length(name) >= 4) & ~name.rlike(ABBREVIATION) & ~F.contains(name, F.lit(":"))


def excerpt(text: Column, most: int = 400) -> Column:
    """The text with single spaces, cut to ``most`` characters of which the last is then an ellipsis."""
    body = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(body) > most, F.concat(F.rtrim(F.substring(body, 1, most - 1)), F.lit("…"))).otherwise(body)
