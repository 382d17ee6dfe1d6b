"""Scans of variant summaries, text annotations and associations in tab-separated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import parts_for

# Cross-references of a trait by their prefix in the file, as (source, prefix of the index); stars of review states;
# names that say that there is no trait.
TRAIT_SOURCES = {
    "MONDO": ("MONDO", "MONDO"), "Orphanet": ("Orphanet", "ORPHA"), "OMIM": ("OMIM", "OMIM"), "HP": ("Human Phenotype Ontology", "HP"),
    "Human Phenotype Ontology": ("Human Phenotype Ontology", "HP"), "MedGen": ("MedGen", "UMLS"),
}
REVIEW_STARS = {
    "practice guideline": 4, "reviewed by expert panel": 3, "criteria provided, multiple submitters, no conflicts": 2,
    "criteria provided, conflicting classifications": 1, "criteria provided, single submitter": 1,
}
NO_TRAIT = ("not provided", "not specified", "-", "")


def _position() -> Column:
    """Where a row stands: its file, its split of the file, and its row there, as a split is read by one task in order."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _chosen(values: dict[str, object], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for item in values.items() for x in item)), key)


def traits(ids: Column, names: Column) -> Column:
    """array<struct<name, xrefs: array<struct<source, prefix, id>>>>: the groups of ``ids``, parted by | and ;, with the name at the same place.

    Cross-references of unknown sources are left out, as are repeated traits and those without references that only say that
    nothing is given. A missing name is empty.
    """
    named = F.split(F.coalesce(names, F.lit("")), "[|;]")

    def one(group: Column, i: Column) -> Column:
        parts = F.transform(F.split(group, ","), lambda x: F.struct(F.substring_index(x, ":", 1).alias("from"), F.regexp_extract(x, "^[^:]*:(.*)$", 1).alias("id")))
        kept = F.filter(parts, lambda x: x["from"].isin(*TRAIT_SOURCES) & (x["id"] != ""))
        source = lambda x, n: _chosen({k: v[n] for k, v in TRAIT_SOURCES.items()}, x["from"])
        refs = F.transform(kept, lambda x: F.struct(source(x, 0).alias("source"), source(x, 1).alias("prefix"), x["id"].alias("id")))
        return F.struct(F.coalesce(F.get(named, i), F.lit("")).alias("name"), refs.alias("xrefs"))

    every = F.transform(F.split(F.coalesce(ids, F.lit("")), "[|;]"), one)
    return F.array_distinct(F.filter(every, lambda t: (F.size(t["xrefs"]) > 0) | ~t["name"].isin(*NO_TRAIT)))


def variant_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row for each variation: (vid, name, rs, significance, review, stars, submitters, pathogenic, traits, genes).

    Of several rows, the first on GRCh38 counts, else the first. ``genes`` are (geneid, symbol, hgnc) by their place; the HGNC number
    is that of the first. Rows without a number are left out. Only the columns used are read into the shuffle, which first reduces each
    split's rows of one variation to one.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    raw = raw.withColumn("_vid", F.col("VariationID").try_cast("long")).where("_vid is not null")
    wanted = ["Name", "RS# (dbSNP)", "ClinicalSignificance", "ReviewStatus", "NumberSubmitters", "PhenotypeIDS", "PhenotypeList", "GeneID", "GeneSymbol", "HGNC_ID"]
    first = F.struct((~F.col("Assembly").eqNullSafe("GRCh38")).alias("other"), _position().alias("at"))
    best = raw.select("_vid", first.alias("_first"), F.struct(*(F.col(f"`{c}`") for c in wanted)).alias("_row")).groupBy("_vid").agg(F.min_by("_row", "_first").alias("r"))
    r = lambda name: F.col("r").getField(name)
    given = lambda name, *no: F.when(~r(name).isin(*no), r(name))
    listed = lambda name, *no: F.filter(F.split(F.coalesce(r(name), F.lit("")), ";"), lambda x: ~x.isin("", *no))
    said, review = F.lower(F.coalesce(r("ClinicalSignificance"), F.lit(""))), r("ReviewStatus")
    shaped = best.select(
        F.col("_vid").alias("vid"), r("Name").alias("name"), given("RS# (dbSNP)", "-1", "-", "").alias("rs"), r("ClinicalSignificance").alias("significance"), review.alias("review"),
        F.coalesce(_chosen(REVIEW_STARS, review), F.lit(0)).alias("stars"), F.coalesce(r("NumberSubmitters").try_cast("int"), F.lit(0)).alias("submitters"),
        (F.contains(said, F.lit("pathogenic")) & ~F.contains(said, F.lit("conflicting"))).alias("pathogenic"), traits(r("PhenotypeIDS"), r("PhenotypeList")).alias("traits"),
        listed("GeneID", "-1").alias("_ids"), listed("GeneSymbol", "-").alias("_symbols"), given("HGNC_ID", "-", "").alias("_hgnc"))
    gene = lambda x, i: F.struct(F.when(F.size("_ids") > 0, x).alias("geneid"), F.get("_symbols", i).alias("symbol"), F.when(i == 0, F.col("_hgnc")).alias("hgnc"))
    return shaped.withColumn("genes", F.transform(F.when(F.size("_ids") > 0, F.col("_ids")).otherwise(F.col("_symbols")), gene)).drop("_ids", "_symbols", "_hgnc")


def variant_search(variants: DataFrame, field: str, value: str, n: int, pathogenic: bool = False) -> DataFrame:
    """The ``n`` best reviewed variations, then those with most submitters, then the latest: by geneid, hgnc, symbol, trait or rs number.

    ``value`` of a trait is prefix:id; the symbol's case and a leading rs or HGNC: do not matter.
    """
    if field == "trait":
        prefix, _, local = value.partition(":")
        hit = F.exists("traits", lambda t: F.exists(t["xrefs"], lambda x: (x["prefix"] == prefix) & (F.upper(F.regexp_extract(x["id"], "[^:]*$", 0)) == local.upper())))
    elif field == "rs":
        hit = F.col("rs") == value.lower().removeprefix("rs")
    elif field == "symbol":
        hit = F.exists("genes", lambda g: F.upper(g["symbol"]) == value.upper())
    elif field == "hgnc":
        hit = F.exists("genes", lambda g: g["hgnc"] == "HGNC:" + value.upper().removeprefix("HGNC:"))
    elif field == "geneid":
        hit = F.exists("genes", lambda g: g["geneid"] == value)
    else:
        raise ValueError(f"no such field: {field}")
    rows = variants.where(hit & F.col("pathogenic")) if pathogenic else variants.where(hit)
    return rows.orderBy(F.desc("stars"), F.desc("submitters"), F.desc("vid")).limit(n)


def text_annotations(spark: SparkSession, path: str, subset: DataFrame) -> DataFrame:
    """(pmid, type, db_id, mention, at): the concepts, parted by ;, of annotations (pmid, type, concepts, mentions) of papers in ``subset`` (pmid).

    ``-`` is no concept; ``at`` is the place in the files.
    """
    rows = spark.read.csv(path, sep="\t", quote="", schema="pmid string, type string, concepts string, mentions string, resource string")
    known = rows.select(F.col("pmid").try_cast("long").alias("pmid"), "type", "concepts", "mentions", _position().alias("at")).join(subset.select("pmid").distinct(), "pmid", "left_semi")
    exploded = known.select("pmid", "type", F.explode(F.split("concepts", ";")).alias("db_id"), F.substring_index("mentions", "|", 1).alias("mention"), "at")
    return exploded.where("db_id not in ('', '-')")


def concepts(annotations: DataFrame, names: DataFrame) -> DataFrame:
    """(type, db_id, name, papers): each concept with the number of papers, under its name in ``names`` (type, db_id, name), else its first mention."""
    # A paper's mentions of a concept are made one first, in partitions of bounded size; ``annotations`` should be settled, as they are counted.
    once = annotations.repartition(parts_for(annotations.count()), "type", "db_id", "pmid").groupBy("type", "db_id", "pmid").agg(F.min("at").alias("at"), F.min_by("mention", "at").alias("mention"))
    found = once.groupBy("type", "db_id").agg(F.count("pmid").alias("papers"), F.min_by("mention", "at").alias("mention"))
    known = names.groupBy("type", "db_id").agg(F.min("name").alias("name"))
    return found.join(known, ["type", "db_id"], "left").select("type", "db_id", F.coalesce("name", "mention", "db_id").alias("name"), "papers")


def relations(spark: SparkSession, path: str, subset: DataFrame) -> DataFrame:
    """(pmid, type, a_type, a, b_type, b) of rows (pmid, type, kind|id, kind|id); a row that lacks part of an end is left out."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="pmid string, type string, x string, y string")
    end = lambda c, n: F.when(F.contains(F.col(c), F.lit("|")), F.regexp_extract(c, r"^([^|]*)\|(.*)$", n))
    read = rows.select(F.col("pmid").try_cast("long").alias("pmid"), "type", end("x", 1).alias("a_type"), end("x", 2).alias("a"), end("y", 1).alias("b_type"), end("y", 2).alias("b"))
    return read.where("a_type <> '' and a <> '' and b_type <> '' and b <> ''").join(subset.select("pmid").distinct(), "pmid", "left_semi")


def mutations(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, rs, hgvs, gene, mention): a concept is an rs number, or a list of labelled values parted by ;."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="pmid string, type string, concept string, mention string, resource string")
    part = lambda label, shape: F.nullif(F.regexp_extract("concept", f"(?:^|;){label}:({shape})", 1), F.lit(""))
    bare = F.startswith("concept", F.lit("rs"))
    read = rows.where("concept is not null").select(
        F.col("pmid").try_cast("long").alias("pmid"), F.when(bare, F.col("concept")).otherwise(F.concat(F.lit("rs"), part("RS#", r"\d+"))).alias("rs"), F.when(~bare, part("HGVS", "[^;]+")).alias("hgvs"),
        F.when(~bare, part("CorrespondingGene", r"\d+")).alias("gene"), F.coalesce("mention", F.lit("")).alias("mention"))
    return read.where("pmid is not null")


def gene_diseases(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, disease, association), each once, of a table with a header; symbols in upper case."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    return rows.select(F.upper("gene_symbol").alias("symbol"), F.regexp_replace("disease_id", "ORPHANET:", "ORPHA:").alias("disease"), F.col("association_type").alias("association")).distinct()


def is_causal(association: Column) -> Column:
    """Changes in the gene cause the disease."""
    return F.coalesce((association == "MENDELIAN") | F.startswith(association, F.lit("Disease-causing")), F.lit(False))


def sound_associations(rows: DataFrame) -> DataFrame:
    """(src, dst, relation) of rows (subject, predicate, object, negated): what is not denied, with both identifiers of the predicate's form."""
    shape = lambda predicate, a, b: (F.col("predicate") == f"biolink:{predicate}") & F.col("subject").rlike(f"^{a}:[0-9]+$") & F.col("object").rlike(f"^{b}:[0-9]+$")
    relation = F.when(shape("has_phenotype", "MONDO", "HP"), "has_phenotype").when(shape("causes", "HGNC", "MONDO"), "causes")
    kept = rows.where(~F.coalesce("negated", F.lit(False))).select(F.col("subject").alias("src"), F.col("object").alias("dst"), relation.alias("relation"))
    return kept.where("relation is not null")


def first_rows(rows: DataFrame, by: str, order: list[Column], n: Column) -> DataFrame:
    """The first ``n`` rows of each ``by``; ``n``, which may differ from row to row of ``by``, is taken into 1 to 25."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("place", place).where((F.col("place") <= 25) & (F.col("place") <= F.greatest(F.lit(1), F.least(n, F.lit(25)))))
