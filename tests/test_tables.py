"""Scans of tab-separated files and searches in them, on small cases."""

import pytest
from pyspark.sql import functions as F

from ontoweave.operators import search
from ontoweave.sources import tables as T

HEAD = "#AlleleID\tVariationID\tName\tAssembly\tRS# (dbSNP)\tClinicalSignificance\tReviewStatus\tNumberSubmitters\tPhenotypeIDS\tPhenotypeList\tGeneID\tGeneSymbol\tHGNC_ID"


def test_the_first_row_on_the_newest_assembly_counts(spark, tmp_path):
    row = lambda vid, name, asm, ids="", names="", genes="1", symbols="A": f"0\t{vid}\t{name}\t{asm}\t-1\tPathogenic\treviewed by expert panel\t2\t{ids}\t{names}\t{genes}\t{symbols}\t-"
    lines = [HEAD, row(1, "old", "GRCh37"), row(1, "new", "GRCh38"), row(1, "late", "GRCh38"), row(2, "first", "GRCh37"), row(2, "second", "na"), row("x", "bad", "GRCh38"), row(3, 'say "hi', "GRCh38", genes="-1", symbols="B;-")]
    (tmp_path / "v.tsv").write_text("\n".join(lines) + "\n")
    v = T.variant_summary(spark, str(tmp_path / "v.tsv"))
    assert {(r.vid, r.name, r.rs, r.stars, r.pathogenic) for r in v.collect()} == {(1, "new", None, 3, True), (2, "first", None, 3, True), (3, 'say "hi', None, 3, True)}
    assert [tuple(g) for g in v.where("vid = 3").first().genes] == [(None, "B", None)]
    assert [r.vid for r in T.variant_search(v, "symbol", "a", 5).collect()] == [2, 1] and T.variant_search(v, "rs", "rs5", 5).count() == 0
    with pytest.raises(ValueError):
        T.variant_search(v, "colour", "red", 1)
    (tmp_path / "e.tsv").write_text(HEAD + "\n")
    assert T.variant_summary(spark, str(tmp_path / "e.tsv")).count() == 0


def test_traits_keep_places_and_drop_what_says_nothing(spark):
    cases = {
        ("MONDO:MONDO:1,Orphanet:5,Foo:2|-;HP:HP:9", "a|b;c"): [("a", ["MONDO:1", "5"]), ("b", []), ("c", ["HP:9"])], ("-|MedGen:C1;MedGen:C1", "not provided|x;x"): [("x", ["C1"])],
        ("OMIM:7|OMIM:", "only"): [("only", ["7"])], (None, None): [], ("OMIM:7", None): [("", ["7"])],
    }
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, ids string, names string").select("i", T.traits(F.col("ids"), F.col("names")).alias("t"))
    got = {r.i: [(t.name, [x.id for x in t.xrefs]) for t in r.t] for r in rows.collect()}
    assert got == dict(enumerate(cases.values()))


def test_annotations_relations_and_mutations(spark, tmp_path):
    subset = spark.createDataFrame([(1,), (1,), (2,)], "pmid long")
    (tmp_path / "a").write_text("1\tGene\t5;;-\tp53|TP53\tr\n2\tGene\t5\tlater\tr\n3\tGene\t5\tother\tr\nx\tGene\t5\tbad\tr\n2\tDisease\t-\tnone\tr\n1\tGene\t5\tagain\tr\n")
    found = T.concepts(T.text_annotations(spark, str(tmp_path / "a"), subset), spark.createDataFrame([], "type string, db_id string, name string"))
    assert [tuple(r) for r in found.collect()] == [("Gene", "5", "p53", 2)]
    (tmp_path / "r").write_text("1\ttreat\tDisease|D1\tChemical|C|2\n1\ttreat\tDisease|\tChemical|C\n1\ttreat\tnone\tChemical|C\n9\ttreat\tDisease|D\tGene|1\n")
    assert [tuple(r) for r in T.relations(spark, str(tmp_path / "r"), subset).collect()] == [(1, "treat", "Disease", "D1", "Chemical", "C|2")]
    (tmp_path / "m").write_text("1\tm\trs5\tx\tr\n2\tm\ttmVar:p|A;HGVS:p.V1E;RS#:7;CorrespondingGene:9\t\tr\n3\tm\tXRS#:7\ty\tr\n")
    assert sorted(tuple(r) for r in T.mutations(spark, str(tmp_path / "m")).collect()) == [(1, "rs5", None, None, "x"), (2, "rs7", "p.V1E", "9", ""), (3, None, None, None, "y")]


def test_predicates_and_limits(spark):
    rows = spark.createDataFrame([("MONDO:1", "biolink:has_phenotype", "HP:1", None), ("MONDO:1", "biolink:has_phenotype", "HP:1", True), ("MONDO:x", "biolink:has_phenotype", "HP:1", False), ("HGNC:1", "biolink:causes", "MONDO:2", False), (None, "biolink:causes", "MONDO:2", False)], "subject string, predicate string, object string, negated boolean")
    assert sorted(tuple(r) for r in T.sound_associations(rows).collect()) == [("HGNC:1", "MONDO:2", "causes"), ("MONDO:1", "HP:1", "has_phenotype")]
    many = spark.range(120).selectExpr("id % 3 as k", "id")
    asked = F.element_at(F.array(F.lit(-4), F.lit(99), F.lit(2)), (F.col("k") + 1).cast("int"))
    assert sorted((r.k, r["count"]) for r in T.first_rows(many, "k", [F.col("id")], asked).groupBy("k").count().collect()) == [(0, 1), (1, 25), (2, 2)]


def test_latest_first(spark):
    docs = spark.createDataFrame([(1, "red box", 2000), (2, "red red", 2001), (3, "box", None), (4, None, 2002), (5, "Red, box", 2001)], "doc_id int, text string, year int")
    index = search.build_index(docs, ["text"])
    page = lambda words, every, n=10, skip=0: [(r.doc_id, r.total) for r in search.latest_first(index, docs, words, every, {}, n, skip).collect()]
    assert page(["red BOX"], True) == [(5, 2), (1, 2)] and page(["red", "box"], False, 2, 1) == [(2, 4), (1, 4)] and page(["?"], True) == []
