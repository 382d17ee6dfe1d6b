"""Concepts, variants, citations, relation groups and category searches on small cases."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoweave.operators import lookups as L


def test_concepts_match_by_exact_identity_alone(spark):
    entries = spark.createDataFrame([("e1", "M1", "Marfan  Syndrome", 1), ("e2", "M2", "marfan syndrome", 0), ("e3", None, "Other", 2)], "entry string, db_id string, name string, place int")
    asked = spark.createDataFrame([(1, "M1", ["x"]), (2, None, ["MARFAN syndrome"]), (3, None, ["marfan"]), (4, "M1", ["marfan syndrome"]), (5, None, None), (6, None, ["", " "])], "concept int, exact_id string, names array<string>")
    assert sorted(tuple(r) for r in L.match_concepts(asked, entries).collect()) == [(1, "e1", "id"), (2, "e2", "name"), (4, "e2", "name")]


def test_document_concepts(spark):
    rows = [(1, 0, "Gene", "5", None, "A", "a"), (1, 1, "Species", "9606", None, "human", "patients"), (1, 2, "Species", "10090", None, None, "mice"), (1, 3, "Species", "10090", "K", None, "mouse"), (1, 4, "Species", "10090", "K", "M", "m"), (2, 0, None, None, None, None, "t")]
    found = L.summarize_concepts(spark.createDataFrame(rows, "doc_id int, at int, type string, identifier string, accession string, name string, text string"))
    assert sorted((r.doc_id, r.place, r.key, r.name, r.n) for r in found.collect()) == [(1, 1, "K", "mouse", 2), (1, 2, "Gene:5", "A", 1), (1, 3, "Species:10090", "mice", 1), (2, 1, "None:None", "t", 1)]


def test_variants(spark):
    said = {"p.Val600Glu": "P.V600E", " p.(V600*) ": "P.V600*", "p.Val600Xxx": "P.VAL600XXX", "c.1A>G": "C.1A>G", "p.V600=": "P.V600=", None: None}
    rows = spark.createDataFrame([(k,) for k in said], "c string").select("c", L.protein_key(F.col("c")).alias("k"))
    assert {r.c: r.k for r in rows.collect()} == said
    known = spark.createDataFrame([("v1", ["BRAF"], "p.V600E"), ("v2", ["X", "braf"], "p.V600K"), ("v3", ["BRAF"], "p.(Val600Lys)")], "variant string, genes array<string>, change string")
    asked = spark.createDataFrame([(1, "braf", "p.Val600Glu"), (2, "BRAF", "p.V600K"), (3, "X", "p.V600K"), (4, "Y", "p.V600E"), (5, None, "p.V600E")], "asked int, gene string, change string")
    assert sorted(tuple(r) for r in L.resolve_variants(asked, known).collect()) == [(1, "v1"), (3, "v2")]
    papers = spark.createDataFrame([("G", v, p, p) for v, n in (("a", 3), ("b", 5), ("c", 3)) for p in range(n)] + [("G", "a", 0, 0)], "gene string, variant string, paper int, at int")
    assert sorted((r.variant, r.paper, r.rank, r.place) for r in L.top_variant_papers(papers, 2, 2).collect()) == [("a", 0, 2, 1), ("a", 1, 2, 2), ("b", 0, 1, 1), ("b", 1, 1, 2)]


def _plain(text, requested, selected):
    def one(m):
        ids = [requested[int(n) - 1] if 0 < int(n) <= len(requested) else None for n in re.findall(r"\d+", m[0])]
        kept = list(dict.fromkeys(selected.index(i) + 1 for i in ids if i in selected))
        return f"[{', '.join(map(str, kept))}]" if kept else ""

    return re.sub(r"\[\d+(?:\s*,\s*\d+)*\](?!\()", one, text)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.text("[]()1230, a", max_size=25), st.permutations("abc"), st.integers(0, 3)), min_size=30, max_size=60))
def test_citations_are_remapped_as_by_a_plain_loop(spark, cases):
    cases = [(t, list("abc"), list(p[:n])) for t, p, n in cases] + [("[1, 3][9](u) [2 ,1,1]", list("abc"), ["c", "a"]), ("", [], []), ("[99999999999]", ["a"], ["a"])]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, r array<string>, s array<string>")
    got = {r.i: r.x for r in rows.select("i", L.remap_citations(F.col("t"), F.col("r"), F.col("s")).alias("x")).collect()}
    assert got == {i: _plain(*c) for i, c in enumerate(cases)}


def test_focus_groups(spark):
    edges = spark.createDataFrame([("F", "d1", "trial_drug_phase_3", "s"), ("F", "d2", "off_label", "s"), ("F", "d2", "off_label", "t"), ("d3", "F", "approved_drug", "s"), ("F", "x", "has_phenotype", "s"), ("F", "y", "has_phenotype", "s"), ("F", "F", "loop", "s"), ("d3", "x", "sold", "s"), ("F", "z", "near", "s")],
                                  "src string, dst string, relation string, source string")
    kinds = spark.createDataFrame([("x", "disease"), ("y", "symptom")], "node string, kind string")
    got = {(r.group, r.place): (r.node, r.relations, r.sources) for r in L.focus_groups(edges, spark.createDataFrame([("F",)], "focus string"), kinds).collect()}
    drugs = "Drugs / treatments"
    assert got == {(drugs, 1): ("d3", ["(inverse) approved_drug"], 1), (drugs, 2): ("d1", ["trial_drug_phase_3"], 1), (drugs, 3): ("d2", ["off_label"], 2), (L.DISEASES_WITH, 1): ("x", ["has_phenotype"], 1),
                   ("Phenotypes / symptoms", 1): ("y", ["has_phenotype"], 1), ("Other", 1): ("z", ["near"], 1)}


def test_gene_terms_and_categories(spark):
    cases = {("TP53", "l", ("tumor", "TP53", "b", "c")): ["TP53", "tumor", "b"], ("CAT", "l", ("catalase",)): ["catalase"], ("Clock", "l", None): [], (None, "label", ("x",)): ["label", "x"], (None, None, ("x",)): ["x"]}
    rows = spark.createDataFrame([(i, s, l, list(n) if n else None) for i, (s, l, n) in enumerate(cases)], "i int, s string, l string, n array<string>").select("i", L.gene_terms(F.col("s"), F.col("l"), F.col("n")).alias("t"))
    assert {r.i: r.t for r in rows.collect()} == dict(enumerate(cases.values()))
    held = spark.createDataFrame([("g1", "tissue", "Liver", "Enriched", 1.0), ("g2", "tissue", "liver", "Enhanced", 5.0), ("g3", "tissue", "liver", "Low", 9.0), ("g4", "cell", "liver", "Enriched", 9.0)], "gene string, field string, name string, category string, value double")
    asked = spark.createDataFrame([(1, "tissue", " LIVER", ["Enriched", " Enhanced", "Enriched"])], "asked int, field string, name string, categories array<string>")
    assert [(r.gene, r.place) for r in L.category_search(held, asked).orderBy("place").collect()] == [("g2", 1), ("g1", 2)]
