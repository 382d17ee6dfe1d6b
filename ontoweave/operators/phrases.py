"""Dictionaries of many-word phrases met in texts, with positions, and what follows from the longest ones.

No text is held against every phrase: a text's words and pairs of words are joined with the words or pairs that phrases
begin with, and what a text may hold is then verified in one pass over its own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topk import best_per_key


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text, apostrophes dropped."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’`]", ""), F.lit(r"[\p{L}\p{N}]+"), 0)


def _heads(words: Column, single: bool) -> Column:
    """(place from 1, head) of each pair of words, and of each word if phrases of one word are sought."""
    at = F.sequence(F.lit(1), F.size(words))
    pairs = F.transform(F.slice(at, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.struct(i.alias("start"), F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)).alias("head")))
    both = F.concat(pairs, F.transform(at, lambda i: F.struct(i.alias("start"), F.get(words, i - 1).alias("head")))) if single else pairs
    return F.when(F.size(words) > 0, both)


def phrase_matches(texts: DataFrame, phrases: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """(text_id, phrase_id, start, end) of every occurrence of phrases (phrase_id, phrase) in texts (text_id, text).

    Places are numbers of words from 1, both included. Letters are compared in lower case, other characters part words.
    Phrases and texts without words meet nothing; a null text_id or phrase_id is kept as it is. The heads are broadcast only
    if there are at most ``most_broadcast``; beyond that they are joined by a shuffle.
    """
    known = phrases.select("phrase_id", tokens(F.col("phrase")).alias("words")).where(F.size("words") > 0).distinct()
    known = known.withColumn("head", F.array_join(F.slice("words", 1, 2), " "))
    sizes = known.agg(F.count("*").alias("n"), F.min(F.size("words")).alias("least")).first()
    known = known.hint("broadcast" if sizes["n"] <= most_broadcast else "merge")
    read = texts.select(F.struct("text_id").alias("id"), tokens(F.col("text")).alias("text_words"))
    met = read.select("id", F.inline(_heads(F.col("text_words"), sizes["least"] == 1))).join(known, "head")
    # Phrases of up to two words are settled by their head.
    short, long = F.size("words") <= 2, F.size("words") > 2
    found = met.where(short).select("id.text_id", "phrase_id", "start", (F.col("start") + F.size("words") - 1).alias("end"))
    open_ = met.where(long & (F.size("words") > 0)).groupBy("id").agg(F.collect_list(F.struct("phrase_id", "start", "words")).alias("open"))
    ends = F.filter("open", lambda c: F.slice(F.col("text_words"), c["start"], F.size(c["words"])) == c["words"])
    # A text_id that several texts share keeps the matches of each.
    verified = read.join(open_, "id").select("id", F.explode(ends).alias("c"))
    return found.unionByName(verified.select("id.text_id", "c.phrase_id", "c.start", (F.col("c.start") + F.size("c.words") - 1).alias("end"))).distinct()


def longest(matches: DataFrame) -> DataFrame:
    """The matches that lie in no longer one of their text; equal spans stand together."""
    spans = matches.select("text_id", "start", "end").distinct()
    earlier = Window.partitionBy("text_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    free = spans.withColumn("upto", F.max("end").over(earlier)).where(F.col("upto").isNull() | (F.col("upto") < F.col("end"))).drop("upto")
    return matches.join(free, ["text_id", "start", "end"])


def first_named(matches: DataFrame, most: int) -> DataFrame:
    """(text_id, place, phrase_id): the first ``most`` phrases that a text names, by where they begin, longer ones first."""
    firsts = best_per_key(longest(matches), ["text_id", "phrase_id"], ["start", F.desc("end")])
    place = F.row_number().over(Window.partitionBy("text_id").orderBy("start", F.desc("end"), "phrase_id"))
    return firsts.withColumn("place", place).where(F.col("place") <= most).select("text_id", "place", "phrase_id")


def named(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, phrase_id): texts that hold a name as whole words, the last one also with an ending s or es."""
    forms = names.select("phrase_id", F.explode(F.array(*(F.concat("phrase", F.lit(ending)) for ending in ("", "s", "es")))).alias("phrase"))
    return phrase_matches(texts, forms).select("text_id", "phrase_id").distinct()


def inferred(texts: DataFrame, names: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """(text_id, topic): the first of rules (place, topic, phrase) with a phrase outside the names that the text holds.

    A rule's phrase that shares a word with a name of names (phrase_id, phrase) does not count; texts without one get ``default``.
    """
    both = phrase_matches(texts, names.select(F.struct(F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("topic")).alias("phrase_id"), "phrase").unionByName(
        rules.select(F.struct(F.col("place").cast("int").alias("place"), "topic").alias("phrase_id"), "phrase")))
    name = F.col("phrase_id.place").isNull()
    by = Window.partitionBy("text_id").orderBy("start")
    before = F.max(F.when(name, F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(name, F.col("start"))).over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    outside = F.coalesce(before < F.col("start"), F.lit(True)) & F.coalesce(after > F.col("end"), F.lit(True))
    told = both.withColumn("outside", outside).where(~name & F.col("outside")).groupBy("text_id").agg(F.min("phrase_id").alias("rule"))
    return texts.select("text_id").distinct().join(told, "text_id", "left").select("text_id", F.coalesce("rule.topic", F.lit(default)).alias("topic"))
