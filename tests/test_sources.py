"""Readers on small files."""

import json

from ontoweave.sources import ontologies

OBO = """format-version: 1.2

[Term]
id: HP:1
name: Root
alt_id: HP:9

[Term]
id: HP:2
name: Lens
synonym: "Crystalline lens" EXACT []
synonym: "Eye lens" []
is_a: HP:1 ! Root
relationship: part_of UBERON:1 ! eye

[Term]
id: HP:3
name: Gone
is_a: HP:1
is_obsolete: true

[Typedef]
id: part_of
name: part of
"""


def test_obo(spark, tmp_path):
    (tmp_path / "a.obo").write_text(OBO)
    terms = ontologies.obo_stanzas(spark, str(tmp_path / "a.obo"))
    assert {(r.id, r.name, r.obsolete) for r in terms.collect()} == {("HP:1", "Root", False), ("HP:2", "Lens", False), ("HP:3", "Gone", True)}
    assert [tuple(r) for r in ontologies.obo_is_a(terms).collect()] == [("HP:2", "HP:1")]
    assert {tuple(r) for r in ontologies.obo_synonyms(terms).collect()} == {("HP:2", "Crystalline lens", "EXACT"), ("HP:2", "Eye lens", "RELATED")}
    assert [tuple(r) for r in ontologies.obo_relations(terms).collect()] == [("HP:2", "part_of", "UBERON:1")]
    assert [tuple(r) for r in ontologies.obo_alternatives(terms).collect()] == [("HP:9", "HP:1")]


def test_annotations(spark, tmp_path):
    (tmp_path / "a.obo").write_text(OBO)
    header = "database_id\tdisease_name\tqualifier\thpo_id\treference\tevidence\tonset\tfrequency\tsex\tmodifier\taspect\tbiocuration"
    rows = [
        "ORPHANET:1\tA\t\tHP:2\tPMID:1;PMID:2\tPCS\t\t1/4\t\t\tP\tx", "ORPHANET:1\tA\t\tHP:2\tPMID:3\tPCS\t\tHP:0040281\t\t\tP\tx", "ORPHANET:1\tA\tNOT\tHP:1\tPMID:1\tPCS\t\t\t\t\tP\tx",
        "OMIM:2\tB\t\tHP:9\tPMID:4\tPCS\t\t0%\t\t\tP\tx", "OMIM:2\tB\t\tHP:8\tPMID:4\tPCS\t\t\t\t\tP\tx", "OMIM:2\tB\tnot\tHP:2\tPMID:4\tPCS\t\t0/7\t\t\tI\tx",
    ]
    (tmp_path / "p.hpoa").write_text("#comment\n" + "\n".join([header, *rows]) + "\n")
    table = ontologies.annotation_table(spark, str(tmp_path / "p.hpoa"))
    terms = ontologies.obo_stanzas(spark, str(tmp_path / "a.obo"))
    pairs, references = ontologies.ranked_annotations(table, ontologies.obo_alternatives(terms), terms)
    assert [tuple(r) for r in pairs.collect()] == [("ORPHA:1", "HP:2", 0.9)]
    assert {(r.disease, r.term, *r.references) for r in references.collect()} == {("ORPHA:1", "HP:2", "PMID:1", "PMID:2", "PMID:3"), ("OMIM:2", "HP:1", "PMID:4")}
    assert ontologies.present_annotations(table).count() == 3


def test_genes_and_cases(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("hgnc_id\tsymbol\talias_symbol\tprev_symbol\nHGNC:1\tabc\t\"X|y\"\t\n")
    assert {tuple(r) for r in ontologies.gene_names(spark, str(tmp_path / "g.tsv")).collect()} == {("HGNC:1", "ABC", "symbol"), ("HGNC:1", "X", "alias"), ("HGNC:1", "Y", "alias")}
    record = {
        "id": "c1", "phenotypicFeatures": [{"type": {"id": "HP:1"}}, {"type": {"id": "HP:2"}, "excluded": True}],
        "interpretations": [{"diagnosis": {"disease": {"id": "OMIM:1"}}}], "diseases": [{"term": {"id": "OMIM:9"}}],
    }
    (tmp_path / "c.json").write_text(json.dumps(record))
    assert [tuple(r) for r in ontologies.cases(spark, str(tmp_path / "c.json")).collect()] == [("c1", "OMIM:1", ["HP:1"], ["HP:2"])]
