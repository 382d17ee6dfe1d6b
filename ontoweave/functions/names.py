"""Predicates on names and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import word_key

# Prefixes of taxa, laboratory codes and animal ontologies, and of entries that say nothing specific.
NOISE_PREFIXES = ("NCBITAXON", "LOINC", "OMIA", "MP", "ZP", "WBPHENOTYPE", "FBCV", "XPO", "DDPHENO", "APO")
GENERIC_PREFIXES = ("GENO", "OTAR")


def prefix(curie: Column) -> Column:
    return F.upper(F.substring_index(F.coalesce(curie, F.lit("")), ":", 1))


def is_noise(curie: Column, label: Column, xrefs: Column) -> Column:
    """No human entity: an excluded prefix, a taxon among the cross-references, a disease number outside the human range, an
    animal's or an obsolete name. Nulls are empty."""
    name = F.lower(F.coalesce(label, F.lit("")))
    animal_disease = (prefix(curie) == "MONDO") & ~F.startswith(F.substring_index(curie, ":", -1), F.lit("0"))
    taxon = F.exists(F.coalesce(xrefs, F.array().cast("array<string>")), lambda x: prefix(x) == "NCBITAXON")
    return prefix(curie).isin(*NOISE_PREFIXES) | taxon | F.coalesce(animal_disease, F.lit(False)) | F.contains(name, F.lit("non-human animal")) | F.startswith(name, F.lit("obsolete "))


def is_generic(curie: Column, inheritance: Column) -> Column:
    """Not worth expanding: an excluded prefix, or a mode of inheritance by the caller's closure."""
    return prefix(curie).isin(*GENERIC_PREFIXES) | F.coalesce(inheritance, F.lit(False))


# Numbers and letters that name a type, words that deny sameness, and words that only qualify.
DESIGNATOR = r"^(?:[ivx]{1,4}|[0-9]+[a-z]?|[a-z][0-9]{0,2})$"
NOT_SAME = (
    "like", "related", "associated", "mimicking", "versus", "vs", "and", "or", "carrier", "carriers", "model", "models", "mouse", "mice", "rat", "zebrafish", "cells", "cell",
    "differential",
)
QUALIFIERS = (
    "atypical", "classic", "classical", "typical", "infantile", "juvenile", "adult", "adolescent", "childhood", "neonatal", "congenital", "late", "early", "onset", "variant", "variants",
    "form", "forms", "subtype", "severe", "mild", "attenuated", "intermediate", "progressive", "rapidly", "slowly", "non", "crim", "negative", "positive", "cross", "reactive",
    "immunologic", "immunological", "material", "patients", "phenotype", "presentation", "the", "of", "with", "in", "human",
)


def extends(sub: Column, base: Column) -> Column:
    """A subtype's designator of ``base``: c1 of c, 1a of 1, but not iii of ii."""
    rest = F.substring(sub, F.length(base) + 1, F.length(sub))
    lettered = base.rlike("^[a-z]$") & rest.rlike("^[0-9]{1,2}$")
    return F.startswith(sub, base) & (lettered | (base.rlike("^[0-9]+$") & rest.rlike("^[a-z]$")))


def qualified_match(label: Column, names: Column, not_same: tuple[str, ...] = NOT_SAME, qualifiers: tuple[str, ...] = QUALIFIERS) -> Column:
    """Why a label is one of ``names`` under another name: "same name", "qualified", "parent", or null.

    A name of two words or more, no plural, stands in the label as a run of words; its last word may be a subtype's
    designator. The words around it may only qualify: none may deny sameness, and each designator among them must be one that
    a name has, or a subtype or supertype of one. A "parent" is a label that a name extends by qualifiers alone. The first
    name, and in it the first place, that is met decides; "parent" comes last.
    """
    w = F.split(word_key(label), " ")
    listed = F.transform(F.filter(names, lambda n: n.isNotNull() & ~F.contains(n, F.lit(";"))), lambda n: F.split(word_key(n), " "))
    used = F.filter(listed, lambda n: (F.size(n) >= 2) & ~F.element_at(n, -1).rlike("(?<![su])s$"))
    marks = lambda ws: F.filter(ws, lambda x: x.rlike(DESIGNATOR))
    known = marks(F.flatten(used))
    deny, only = (F.array(*map(F.lit, x)) for x in (not_same, qualifiers))

    def places(outer: Column, inner: Column) -> Column:
        return F.sequence(F.lit(1), F.size(outer) - F.size(inner) + 1)

    def around(ws: Column, i: Column, m: Column) -> Column:
        return F.concat(F.slice(ws, 1, i - 1), F.slice(ws, i + m, F.size(ws)))

    def told(n: Column, i: Column) -> Column:
        m, rest = F.size(n), around(w, i, F.size(n))
        last, want = F.get(w, i + m - 2), F.element_at(n, -1)
        fits = (F.slice(w, i, m - 1) == F.slice(n, 1, m - 1)) & ((last == want) | extends(last, want))
        fits &= ~F.arrays_overlap(rest, deny)
        fits &= F.forall(marks(rest), lambda d: F.exists(known, lambda k: (d == k) | extends(d, k) | extends(k, d)))
        return F.when(fits, F.when((F.size(rest) > 0) | (last != want), "qualified").otherwise("same name"))

    met = F.flatten(F.transform(used, lambda n: F.when(F.size(w) >= F.size(n), F.transform(places(w, n), lambda i: told(n, i))).otherwise(F.array(F.lit(None).cast("string")))))
    extended = F.exists(used, lambda n: (F.size(n) > F.size(w)) & F.exists(
        F.when(F.size(n) > F.size(w), places(n, w)).otherwise(F.array(F.lit(1))),
        lambda i: (F.slice(n, i, F.size(w)) == w) & (F.size(F.array_except(around(n, i, F.size(w)), only)) == 0)))
    return F.when(F.size(w) >= 2, F.coalesce(F.get(F.filter(met, lambda x: x.isNotNull()), F.lit(0)), F.when(extended, "parent")))
