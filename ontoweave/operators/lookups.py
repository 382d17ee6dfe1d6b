"""Concepts, variants and citations of documents, and an entity's relations in groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Amino acids by their three letters, with the end of a protein.
AMINO_ACIDS = dict(zip("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL TER".split(), "ARNDCQEGHILKMFPSTWYV*", strict=True))
# Groups of relations in their order, each with the parts of a relation's name that put it there.
RELATION_GROUPS = (
    ("Genes", ("gene", "target")),
    ("Phenotypes / symptoms", ("phenotype", "inheritance")),
    ("Drugs / treatments", ("treat", "indicat", "drug", "contraindic", "off_label", "side_effect")),
    ("Variants", ("variant",)),
    ("Hierarchy", ("subclass", "parent", "therapeutic_area")),
    ("Cross-references", ("xref", "matches")),
    ("Anatomy / expression", ("location", "expressed", "tissue", "anatomy")),
    ("Groups / organisations / research", ("organisation", "expert_", "network", "consortium", "research_", "trial", "registry", "biobank", "sponsored", "collaborator", "investigator", "ern_")),
)
DISEASES_WITH = "Diseases with this phenotype"
APPROVED = ("approved_drug", "treated_by", "indicated_for")
# Symbols of genes that read as words.
WORD_SYMBOLS = (
    "CAT", "SET", "MAX", "REST", "WAS", "CAN", "MET", "KIT", "RET", "SHE", "CLOCK", "IMPACT", "STAR", "AIRE", "HR", "PIGS", "TANK", "FAST", "LARGE", "NOV", "MARS",
    "COIL", "SPINK", "GAL", "CA", "AR", "APP", "TH", "CD", "BAD", "BID", "ARMS",
)


def folded(name: Column) -> Column:
    """Case and runs of space do not matter."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def match_concepts(concepts: DataFrame, entries: DataFrame) -> DataFrame:
    """(concept, entry, by): for each of ``concepts`` (concept, exact_id, names) the first of ``entries`` (entry, db_id, name, place) with
    its exact identifier or, after folding, one of its names. The place in the entries decides; a broader identifier is no match,
    so it must be left null. Two equi-joins; a name that many concepts have costs one row each."""
    named = concepts.select("concept", F.explode(F.array_distinct(F.transform("names", folded))).alias("name")).where("name <> ''")
    by_id = concepts.select("concept", F.col("exact_id").alias("db_id")).join(entries, "db_id").select("concept", "entry", "place", F.lit("id").alias("by"))
    by_name = named.join(entries.select("entry", "place", folded(F.col("name")).alias("name")), "name").select("concept", "entry", "place", F.lit("name").alias("by"))
    order = F.struct("place", "entry", "by")
    return by_id.unionByName(by_name).groupBy("concept").agg(F.min_by(F.struct("entry", "by"), order).alias("m")).select("concept", "m.entry", "m.by")


def summarize_concepts(mentions: DataFrame, skipped: tuple[str, str] = ("Species", "9606")) -> DataFrame:
    """(doc_id, key, type, name, n, place): how often each document names a concept, most often first, then the one named first.

    ``mentions`` (doc_id, at, type, identifier, accession, name, text): the key is the accession, else type:identifier. Mentions of the
    ``skipped`` concept, which nearly every document names, are left out.
    """
    key = F.coalesce("accession", F.concat_ws(":", F.coalesce("type", F.lit("None")), F.coalesce("identifier", F.lit("None"))))
    kept = mentions.where(~(F.col("type").eqNullSafe(skipped[0]) & F.col("identifier").eqNullSafe(skipped[1])))
    first = lambda value: F.min_by(value, "at")
    counted = kept.withColumn("key", key).groupBy("doc_id", "key").agg(first("type").alias("type"), first(F.coalesce("name", "text")).alias("name"), F.count("*").alias("n"), F.min("at").alias("_first"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "_first", "key"))
    return counted.withColumn("place", place).drop("_first")


def protein_key(change: Column) -> Column:
    """A substitution under one spelling: P.V600E for p.(Val600Glu); other texts in upper case."""
    text = F.upper(F.trim(change))
    shape = r"^P\.\(?([A-Z]{3}|[A-Z*])([0-9]+)([A-Z]{3}|[A-Z*=])\)?$"
    short = F.create_map(*(F.lit(x) for item in AMINO_ACIDS.items() for x in item))
    letter = lambda n: F.when(F.length(F.regexp_extract(text, shape, n)) == 1, F.regexp_extract(text, shape, n)).otherwise(short[F.regexp_extract(text, shape, n)])
    return F.coalesce(F.when(text.rlike(shape), F.concat(F.lit("P."), letter(1), F.regexp_extract(text, shape, 2), letter(3))), text)


def resolve_variants(asked: DataFrame, variants: DataFrame) -> DataFrame:
    """(asked, variant): asked (asked, gene, change) that name exactly one variant (variant, genes, change) of that gene and change.

    Several identifiers of one change are unresolved, not interchangeable, and give no row.
    """
    known = variants.select("variant", F.explode(F.array_distinct(F.transform("genes", folded))).alias("gene"), protein_key(F.col("change")).alias("change"))
    # What a change stands for is settled before it meets those that ask, so many variants of one change make no rows of their own.
    stands = known.groupBy("gene", "change").agg(F.min("variant").alias("low"), F.max("variant").alias("high"))
    found = asked.select("asked", folded(F.col("gene")).alias("gene"), protein_key(F.col("change")).alias("change")).join(stands, ["gene", "change"])
    return found.groupBy("asked").agg(F.min("low").alias("variant"), F.max("high").alias("high")).where("variant = high").select("asked", "variant")


def top_variant_papers(papers: DataFrame, variants: int, each: int) -> DataFrame:
    """(gene, variant, paper, rank, place): of each gene's variants the most published ones, and the first papers (gene, variant, paper, at) of each."""
    rows = papers.groupBy("gene", "variant", "paper").agg(F.min("at").alias("at"))
    counted = rows.groupBy("gene", "variant").agg(F.count("*").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("n"), "variant"))).where(F.col("rank") <= variants)
    kept = rows.join(best.select("gene", "variant", "rank"), ["gene", "variant"])
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("gene", "variant").orderBy("at", "paper"))).where(F.col("place") <= each).drop("at")


_CITED = r"\[\d+(?:\s*,\s*\d+)*\](?!\()"


def remap_citations(text: Column, requested: Column, selected: Column) -> Column:
    """``text`` with [1, 3] renumbered from places in ``requested`` to places in ``selected``, both arrays of source ids.

    Repeats within one bracket go, and so do sources that were not selected; a bracket without any left goes too. Links,
    [1](...), are left alone. A null text stays null.
    """
    marks = F.regexp_extract_all(text, F.lit(f"({_CITED})"), 0)
    pieces = F.split(text, _CITED)

    def renumbered(mark: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(mark, F.lit(r"\d+"), 0), lambda x: F.array_position(selected, F.get(requested, x.try_cast("int") - 1)))
        kept = F.array_distinct(F.filter(numbers, lambda n: n > 0))
        return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(F.transform(kept, lambda n: n.cast("string")), ", "), F.lit("]"))).otherwise("")

    return F.array_join(F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(renumbered(F.get(marks, i)), F.lit("")))), "")


def relation_group(relation: Column, kind: Column) -> Column:
    """The first group that a relation's name fits; phenotype relations with a disease are a group of their own."""
    found = F.when((kind == "disease") & F.contains(relation, F.lit("phenotype")), DISEASES_WITH)
    for group, parts in RELATION_GROUPS:
        fits = F.lit(False)
        for part in parts:
            fits = fits | F.contains(relation, F.lit(part))
        found = found.when(fits, group)
    return found.otherwise("Other")


def focus_groups(edges: DataFrame, focus: DataFrame, kinds: DataFrame) -> DataFrame:
    """(focus, group, node, relations, sources, place): what each ``focus`` (focus) is related to, in groups.

    ``edges`` (src, dst, relation, source) count from both ends, from the far end as (inverse) relations. In a group, nodes with
    most sources come first; drugs by approval and trial phase before that. Loops are left out.
    """
    side = lambda end, other, name: edges.where("src <> dst").join(focus.select(F.col("focus").alias(end)).distinct(), end).select(F.col(end).alias("focus"), F.col(other).alias("node"), "relation", name.alias("named"), "source")
    near = side("src", "dst", F.col("relation")).unionByName(side("dst", "src", F.concat(F.lit("(inverse) "), "relation")))
    near = near.join(kinds.groupBy("node").agg(F.min("kind").alias("kind")), "node", "left")
    phase = F.regexp_extract("relation", "^trial_drug_phase_([0-9])", 1).try_cast("int")
    stage = F.when(F.col("relation").isin(*APPROVED), 0).when(phase.isNotNull(), 5 - phase).otherwise(9)
    grouped = near.groupBy("focus", relation_group(F.col("relation"), F.coalesce("kind", F.lit(""))).alias("group"), "node").agg(
        F.sort_array(F.collect_set("named")).alias("relations"), F.count_distinct("source").alias("sources"), F.min(stage).alias("_stage"))
    first = F.when(F.startswith("group", F.lit("Drugs")), F.col("_stage")).otherwise(0)
    place = F.row_number().over(Window.partitionBy("focus", "group").orderBy(first, F.desc("sources"), "node"))
    return grouped.withColumn("place", place).drop("_stage")


def gene_terms(symbol: Column, label: Column, names: Column, words: tuple[str, ...] = WORD_SYMBOLS, n: int = 3) -> Column:
    """What to search a gene by: its symbol, unless that is of up to three letters or reads as a word, and its names, at most ``n``."""
    own = F.coalesce(F.nullif(symbol, F.lit("")), label, F.lit(""))
    risky = (F.length(own) <= 3) | (own.rlike(r"^\p{L}+$") & F.upper(own).isin(*words))
    listed = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x != own)
    return F.slice(F.concat(F.when(risky, F.array().cast("array<string>")).otherwise(F.array(own)), listed), 1, n)


def category_search(enriched: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, gene, category, value, place): genes of ``enriched`` (gene, field, name, category, value) that fit asked (asked, field, name, categories),
    the greatest value first; names go without case."""
    rows = asked.select("asked", "field", F.lower(F.trim("name")).alias("name"), F.explode(F.array_distinct(F.transform("categories", lambda x: F.trim(x)))).alias("category"))
    found = rows.join(enriched.withColumn("name", F.lower("name")), ["field", "name", "category"])
    return found.select("asked", "gene", "category", "value", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc_nulls_last("value"), "gene", "category")).alias("place"))
