"""How far profiles of cohorts agree with their patients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle


def score_profiles(profiles: DataFrame, features: DataFrame, closed: DataFrame, weights: DataFrame, common: float = 0.25, least_specificity: float = 0.35, frequent: float = 0.8, unique: bool = False) -> DataFrame:
    """(cohort, patients, terms, recall, lenient, common_recall, supported, contradicted) of profiles (cohort, term, freq) against
    features (cohort, patient, term, excluded); ``unique`` says that these are settled rows and all different.

    A patient's observed features count once each. One is mentioned if it is a profile's term or an ancestor of one, and
    leniently also if a term of the profile with ``least_specificity`` is an ancestor of it. ``common_recall`` is of the features
    that at least ``common`` of the patients, and two, have. A patient has a term whose descendant, or itself, is observed, and lacks
    one of which, or of an ancestor of which, it is said that it is excluded; ``supported`` is the share of the profile's assessed
    terms that a patient has; ``contradicted`` counts terms of frequency ``frequent`` or more that over half of three or more assessed patients lack.
    Shares of nothing are null, a recall of nothing is 0. Every step groups by cohort and term, after features are unique, so a
    large cohort is spread over its terms. Patients meet a profile's term only where several features tell of it; elsewhere the
    feature's own count says how many they are.
    """
    features = features.where("term is not null").select("cohort", "patient", "term", "excluded")
    features = features if unique else settle(features.distinct(), "features")
    prof = settle(profiles.where("term is not null").groupBy("cohort", "term").agg(F.max("freq").alias("freq")), "profiles")
    up = closed.select(F.col("descendant").alias("term"), "ancestor")
    size = features.select("cohort", "patient").distinct().groupBy("cohort").agg(F.count("patient").alias("patients"))
    counts = settle(features.groupBy("cohort", "term").agg(F.count_if(~F.col("excluded")).alias("n"), F.count_if("excluded").alias("excluded")), "counts")
    observed = counts.where("n > 0").select("cohort", "term", "n")

    strict = prof.join(up, "term").select("cohort", F.col("ancestor").alias("term")).distinct().withColumn("strict", F.lit(True))
    informative = prof.join(weights.where(F.col("specificity") >= least_specificity).select("term"), "term", "left_semi").select("cohort", F.col("term").alias("ancestor"))
    broader = observed.join(up, "term").join(informative, ["cohort", "ancestor"]).select("cohort", "term").distinct().withColumn("broader", F.lit(True))
    told = observed.join(strict, ["cohort", "term"], "left").join(broader, ["cohort", "term"], "left").join(size, "cohort")
    yes, also = F.coalesce("strict", F.lit(False)), F.coalesce("strict", "broader", F.lit(False))
    often = F.col("n") >= F.greatest(F.lit(2.0), common * F.col("patients"))
    recall = told.groupBy("cohort").agg(
        (F.sum(F.when(yes, F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"), (F.sum(F.when(also, F.col("n")).otherwise(0)) / F.sum("n")).alias("lenient"),
        F.when(F.count_if(often) > 0, F.count_if(often & yes) / F.count_if(often)).alias("common_recall"))

    down = prof.join(closed.select(F.col("ancestor").alias("term"), "descendant"), "term").select("cohort", "term", F.col("descendant").alias("said"))
    above = prof.join(up, "term").select("cohort", "term", F.col("ancestor").alias("said"))

    def counted(near: DataFrame, excluded: bool, name: str) -> DataFrame:
        said = counts.select("cohort", F.col("term").alias("said"), F.col("excluded" if excluded else "n").alias(name)).where(F.col(name) > 0)
        met = settle(near.join(said, ["cohort", "said"]), "met")
        by_term = met.groupBy("cohort", "term").agg(F.count("*").alias("ways"), F.first(name).alias(name))
        several = met.join(by_term.where("ways > 1").select("cohort", "term"), ["cohort", "term"], "left_semi").select("cohort", "term", "said")
        patients = features.where(F.col("excluded") == excluded).select("cohort", "patient", F.col("term").alias("said")).join(several, ["cohort", "said"])
        # A null patient counts in a feature's own count, so it counts here too.
        merged = patients.select("cohort", "term", "patient").distinct().groupBy("cohort", "term").agg(F.count("*").alias(name))
        return by_term.where("ways = 1").select("cohort", "term", name).unionByName(merged)

    assessed = prof.join(counted(down, False, "has"), ["cohort", "term"], "left").join(counted(above, True, "lacks"), ["cohort", "term"], "left").na.fill(0, ["has", "lacks"])
    seen = F.col("has") + F.col("lacks")
    against = (F.col("freq") >= frequent) & (seen >= 3) & (F.col("lacks") * 2 > seen)
    of_terms = assessed.groupBy("cohort").agg(F.count("*").alias("terms"), F.when(F.count_if(seen > 0) > 0, F.count_if(F.col("has") > 0) / F.count_if(seen > 0)).alias("supported"), F.count_if(against).alias("contradicted"))
    found = of_terms.join(size, "cohort", "left").join(recall, "cohort", "left").na.fill(0, ["patients", "recall", "lenient"])
    return found.select("cohort", "patients", "terms", "recall", "lenient", "common_recall", "supported", "contradicted")
