"""Readers of ontology stanzas and annotation tables, as text and CSV scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import frequency


def obo_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, obsolete, lines) of the terms of an OBO file; stanzas are split where the file has empty lines."""
    raw = spark.read.text(path, lineSep="\n\n").where(F.startswith(F.ltrim("value"), F.lit("[Term]")))
    lines = F.transform(F.split("value", "\n"), lambda x: F.trim(x))
    one = lambda tag: F.get(F.transform(F.filter("lines", lambda x: x.startswith(f"{tag}: ")), lambda x: F.substr(x, F.lit(len(tag) + 3))), 0)
    rows = raw.select(lines.alias("lines"))
    return rows.select(one("id").alias("id"), one("name").alias("name"), F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("obsolete"), "lines").where("id is not null")


def _tagged(stanzas: DataFrame, tag: str) -> DataFrame:
    values = F.transform(F.filter("lines", lambda x: x.startswith(f"{tag}: ")), lambda x: F.substr(x, F.lit(len(tag) + 3)))
    return stanzas.select("id", F.explode(values).alias("value"))


def obo_is_a(stanzas: DataFrame) -> DataFrame:
    """(child, parent) of the terms that are not obsolete."""
    return _tagged(stanzas.where("not obsolete"), "is_a").select(F.col("id").alias("child"), F.regexp_extract("value", r"^\S+", 0).alias("parent"))


def obo_synonyms(stanzas: DataFrame) -> DataFrame:
    """(id, name, scope); a synonym without a scope is RELATED."""
    found = _tagged(stanzas, "synonym")
    scope = F.regexp_extract("value", r'^"[^"]*"\s+([A-Z]+)', 1)
    return found.select("id", F.regexp_extract("value", r'^"([^"]*)"', 1).alias("name"), F.when(scope == "", "RELATED").otherwise(scope).alias("scope"))


def obo_relations(stanzas: DataFrame) -> DataFrame:
    """(id, relation, target)."""
    parts = F.split(F.regexp_replace("value", r"\s*[{!].*$", ""), r"\s+")
    return _tagged(stanzas, "relationship").select("id", parts[0].alias("relation"), parts[1].alias("target"))


def obo_alternatives(stanzas: DataFrame) -> DataFrame:
    """(alternative, id)."""
    return _tagged(stanzas, "alt_id").select(F.col("value").alias("alternative"), "id")


def annotation_table(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a tab-separated annotation table whose comments start with #."""
    schema = "database_id string, disease_name string, qualifier string, hpo_id string, reference string, evidence string, onset string, frequency string, sex string, modifier string, aspect string, biocuration string"
    return spark.read.csv(path, sep="\t", comment="#", quote="", schema=schema).where("database_id <> 'database_id'")


def ranked_annotations(rows: DataFrame, alternatives: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((disease, term, freq), (disease, term, references)) for ranking.

    Only phenotypes without NOT; replaced term ids become current ones and unknown ones go; the highest frequency of a
    pair counts and pairs of frequency 0 are left out, but their references stay.
    """
    kept = rows.where("aspect = 'P' and not (coalesce(qualifier, '') = 'NOT')")
    current = kept.join(alternatives.toDF("hpo_id", "current"), "hpo_id", "left").withColumn("term", F.coalesce("current", "hpo_id"))
    known = current.join(terms.select(F.col("id").alias("term")), "term", "left_semi")
    named = known.select(F.regexp_replace("database_id", "^ORPHANET:", "ORPHA:").alias("disease"), "term", frequency(F.col("frequency")).alias("freq"), "reference")
    pairs = named.groupBy("disease", "term").agg(F.max("freq").alias("freq"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.split(F.coalesce("reference", F.lit("")), ";"))))).alias("references"))
    return pairs.where("freq > 0").select("disease", "term", "freq"), pairs.select("disease", "term", "references")


def excluded_frequency(text: Column) -> Column:
    """True for the frequencies that mean never: the excluded term, 0 %, and none of n."""
    return F.coalesce(F.trim(text).rlike(r"^(HP:0040285|0(\.0+)?%|0/[1-9][0-9]*)$"), F.lit(False))


def present_annotations(rows: DataFrame) -> DataFrame:
    """Rows without NOT in any case and without an excluded frequency."""
    return rows.where((F.upper(F.coalesce("qualifier", F.lit(""))) != "NOT") & ~excluded_frequency(F.col("frequency")))


def gene_names(spark: SparkSession, path: str) -> DataFrame:
    """(hgnc_id, name, kind): symbols, aliases and earlier symbols of a gene table in upper case."""
    rows = spark.read.csv(path, sep="\t", header=True, quote='"')
    part = lambda column, kind: rows.select("hgnc_id", F.explode(F.split(F.coalesce(column, F.lit("")), r"\|")).alias("name"), F.lit(kind).alias("kind"))
    found = part("symbol", "symbol").unionByName(part("alias_symbol", "alias")).unionByName(part("prev_symbol", "previous"))
    return found.select("hgnc_id", F.upper(F.trim("name")).alias("name"), "kind").where("name <> ''").distinct()


def cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, disease, observed, excluded) of patient records in JSON, one row for each diagnosed disease; a record a file, or a line."""
    schema = (
        "id string, phenotypicFeatures array<struct<type:struct<id:string>,excluded:boolean>>, diseases array<struct<term:struct<id:string>>>,"
        "interpretations array<struct<diagnosis:struct<disease:struct<id:string>>>>"
    )
    rows = spark.read.schema(schema).json(path, multiLine=not lines)
    features = F.coalesce("phenotypicFeatures", F.array().cast("array<struct<type:struct<id:string>,excluded:boolean>>"))
    terms = lambda wanted: F.array_distinct(F.transform(F.filter(features, lambda f: F.coalesce(f["excluded"], F.lit(False)) == wanted), lambda f: f["type"]["id"]))
    named = F.filter(F.transform("interpretations", lambda i: i["diagnosis"]["disease"]["id"]), lambda x: x.isNotNull())
    diagnosed = F.when(F.size(named) > 0, F.array_distinct(named)).otherwise(F.slice(F.transform("diseases", lambda x: x["term"]["id"]), 1, 1))
    return rows.select("id", F.explode(diagnosed).alias("disease"), terms(F.lit(False)).alias("observed"), terms(F.lit(True)).alias("excluded"))
