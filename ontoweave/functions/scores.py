"""Score formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def noisy_or(weight: Column) -> Column:
    """Aggregate: the chance that at least one of independent pieces of evidence holds; weights are clamped to [0, 1]."""
    kept = F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0))
    return F.lit(1.0) - F.coalesce(F.product(F.lit(1.0) - kept), F.lit(1.0))


def information_content(entities: Column, total: Column) -> Column:
    """ln(total / entities); a term without entities is as informative as one with a single one."""
    return F.when(entities > 0, F.ln(total / entities)).otherwise(F.ln(total))


def degree_specificity(degree: Column) -> Column:
    """1 for a node of no degree, falling with the logarithm, 0.05 at least; unknown degrees count 0.5."""
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.log10(F.lit(1.0) + degree) / F.lit(4.0)), F.lit(0.5))


# Shares of the frequency terms and words, in order of precedence.
FREQUENCY_TERMS = {"HP:0040280": 1.0, "HP:0040281": 0.9, "HP:0040282": 0.55, "HP:0040283": 0.17, "HP:0040284": 0.02, "HP:0040285": 0.0}
FREQUENCY_WORDS = {"obligate": 1.0, "very frequent": 0.9, "frequent": 0.55, "occasional": 0.17, "very rare": 0.02, "excluded": 0.0}
UNKNOWN_FREQUENCY = 0.5


def frequency(text: Column) -> Column:
    """Share meant by an annotation's frequency: a term id, a leading word, n/m or x%; 0.5 if it is none of these."""
    text = F.trim(text)
    parts = [F.regexp_extract(text, r"^([0-9]{1,15})\s*/\s*([0-9]{1,15})$", i).try_cast("double") for i in (1, 2)]
    percent = F.regexp_extract(text, r"^([0-9.]+)\s*%$", 1).try_cast("double") / F.lit(100.0)
    found = F.coalesce(F.try_divide(*parts), percent, F.lit(UNKNOWN_FREQUENCY))
    for word, value in reversed(FREQUENCY_WORDS.items()):
        found = F.when(F.startswith(F.lower(text), F.lit(word)), F.lit(value)).otherwise(found)
    for term, value in FREQUENCY_TERMS.items():
        found = F.when(text == term, F.lit(value)).otherwise(found)
    return F.when(text.isNull(), F.lit(UNKNOWN_FREQUENCY)).otherwise(found)
