"""Nested selections, merged papers, entity graphs, clusters, bridges and mechanisms against small plain cases."""

import pytest
from pyspark.sql import functions as F

from ontoweave.operators import entities as E
from ontoweave.operators import mechanisms as M
from ontoweave.operators.nested import Selection, nested


def test_nested_pages_counts_and_empty_lists(spark):
    low = spark.createDataFrame([(1, i, f"x{i}") for i in range(5)] + [(2, 9, None), (None, 8, "lost"), (7, 6, "orphan")], "up int, n int, s string")
    deep = spark.createDataFrame([(i, i * 10 + j) for i in (3, 4, 9) for j in range(3)], "n int, v int")
    of = lambda **k: Selection(low, ["n", "s"], key="n", parent="up", order=[F.desc("n")], children={"deep": Selection(deep, ["v"], parent="n", order=["v"], size=2)}, **k)
    top = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    got = {r.id: r.low for r in nested(Selection(top, ["id"], key="id", children={"low": of(size=2, skip=1)})).collect()}
    assert got[1]["count"] == 5 and [(x.n, x.deep["count"], [y.v for y in x.deep["rows"]]) for x in got[1]["rows"]] == [(3, 3, [30, 31]), (2, 0, [])]
    assert (got[2]["count"], got[2]["rows"]) == (1, []) and all((got[k]["count"], got[k]["rows"]) == (0, []) for k in (3, None))
    whole = {r.id: r.low for r in nested(Selection(top, ["id"], key="id", children={"low": of()})).collect()}
    assert [x.n for x in whole[1]["rows"]] == [4, 3, 2, 1, 0] and whole[2]["rows"][0].s is None


def test_papers_merge_through_chains(spark):
    rows = [(1, ["PMID:1"], None, [], 3), (2, ["DOI:x"], "second", ["B"], None), (3, ["PMID:1", "DOI:x"], "third", ["C"], 9), (4, [], "none", [], 1), (5, [None, "PMC5"], "", ["D"], None), (6, ["PMC5"], "six", [], 0)]
    records = spark.createDataFrame(rows, "seq int, ids array<string>, title string, authors array<string>, cited int")
    members = E.paper_members(records, F.col("ids"))
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    got = {r.paper: (r.records, r.title, r.authors, r.cited) for r in E.merge_papers(records, members, ["title"], ["authors"], ["cited"]).collect()}
    assert got == {1: (3, "second", ["B"], 9), 5: (2, "six", ["D"], 0)}
    hits = spark.createDataFrame([(1, "p", "q", "e", 4), (3, "p", "q", "e", 1), (4, "p", "q", "e", 1), (2, "r", "q", "e", 0)], "seq int, provider string, query string, entity string, rank int")
    assert {tuple(r) for r in E.merge_hits(hits, members).collect()} == {(1, "p", "q", "e", 4), (1, "r", "q", "e", 0)}


@pytest.fixture
def small(spark):
    frame = spark.createDataFrame
    nodes = frame([("D1", "disease"), ("D2", "disease"), ("G", "gene"), ("P", "process"), ("H", "phenotype")], "id string, kind string")
    relations = frame([("G", "D1", "causes", "s"), ("G", "D1", "causes", "s"), ("G", "P", "in", "s"), ("D1", "H", "has", "s"), ("D2", "H", "has", "s"), ("G", "gone", "in", "s"), (None, "D1", "x", "s")], "src string, dst string, relation string, source string")
    claims = frame([(1, "G", "H", "A"), (2, "D2", "H", "A"), (3, "D1", "gone", "A"), (4, "D1", "P", "lost"), (5, "D1", None, "A")], "claim int, subject string, object string, paper string")
    return nodes, relations, claims, frame([("A",), ("B",)], "paper string"), frame([("D1", "B"), ("D2", "lost")], "entity string, paper string")


def test_entity_graph_takes_claims_by_the_entity_and_its_genes_alone(spark, small):
    asked = spark.createDataFrame([("D1",), ("D2",), ("gone",), (None,)], "entity string")
    got = {(r.entity, r.src, r.dst, r.relation) for r in E.entity_graph(asked, *small).collect()}
    d2 = {("D2", "H", "has"), ("evidence:2", "D2", "claim_subject"), ("evidence:2", "H", "claim_object"), ("A", "evidence:2", "contains_claim")}
    d1 = {("G", "D1", "causes"), ("G", "P", "in"), ("D1", "H", "has"), ("evidence:1", "G", "claim_subject"), ("evidence:1", "H", "claim_object"), ("A", "evidence:1", "contains_claim"), ("D1", "B", "literature_search_result")}
    assert got == {("D1", *x) for x in d1} | {("D2", *x) for x in d2}


def test_cluster_detail(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None)], "cluster int, member string")
    pairs = spark.createDataFrame([(1, "c1"), (1, "c1"), (1, "lost"), (3, "c1")], "cluster int, claim string")
    claims = spark.createDataFrame([("c1", "p1"), ("c2", "p2")], "claim string, paper string")
    assert sorted(tuple(r) for r in E.cluster_detail(members, pairs, claims).collect()) == [(1, "claim", "c1"), (1, "member", "a"), (1, "member", "b"), (1, "paper", "p1")]


def test_bridges_and_mechanisms(spark):
    edge = lambda a, b, relation, causal=False, up=None: [(a, b, relation, causal, up is not None, up is False), (b, a, relation, causal, up is not None, up is True)]
    near = sum((edge("D", "G", "causes", True), edge("X", "G", "causes", True), edge("Y", "G", "involves"), edge("D", "X", "shares_mechanism_with"), edge("D", "T", "subclass_of", up=True), edge("Y", "T", "subclass_of", up=True),
                *(edge(a, f"H{i}", "has_phenotype") for i in range(5) for a in "DX")), [])
    frame = spark.createDataFrame(near, "node string, other string, relation string, causal boolean, hierarchy boolean, child boolean")
    kinds = spark.createDataFrame([(x, "disease") for x in "DXYT"] + [("G", "gene")] + [(f"H{i}", "phenotype") for i in range(5)], "node string, kind string")
    one, none = spark.createDataFrame([("D",)], "input string"), spark.createDataFrame([], "input string, node string")
    rows = M.bridges(one, frame, kinds, spark.createDataFrame([("D", "H1")], "input string, node string"), none.select("node")).collect()
    got = {(r.node, r.basis): (r.weight, r.shared) for r in rows}
    want = {("D", "input"): (1.0, 1), ("H1", "symptom"): (0.7, 1), ("X", "shares_mechanism"): (0.9, 1), ("T", "hierarchy"): (0.6, 1), ("G", "linked gene"): (1.0, 1), ("X", "shared gene"): (1.0, 1), ("Y", "shared gene"): (0.5, 1),
            ("Y", "sibling"): (0.4, 1), ("X", "shared phenotype"): (0.6, 5)} | {(f"H{i}", "linked phenotype"): (0.3, 1) for i in range(5)}
    assert got == want and len(rows) == len(want)

    edges = spark.createDataFrame(
        [(1, "D", "G", 0.5, False, False, None), (2, "M", "G", 0.5, None, False, None), (3, "drug", "P", 0.9, False, True, "D"), (4, "drug", "Q", 0.9, False, True, "X"), (5, "D", "N", 0.9, True, False, None), (6, "D", "Z", None, False, False, None), (7, "D", "M", 0.9, False, False, None)],
        "edge int, src string, dst string, confidence double, mostly_negative boolean, solution boolean, context string")
    inputs = spark.createDataFrame([("D", "D"), ("D", "M")], "input string, entity string")
    papers = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "edge int, paper string")
    kinds = spark.createDataFrame([(x, "gene") for x in "GPQNZMC"], "node string, kind string")
    found = M.mechanisms(inputs, edges, papers, kinds, spark.createDataFrame([("D", "C"), ("D", "G"), ("D", "unknown")], "input string, node string"), 3).orderBy("place").collect()
    assert [(r.node, r.papers, r.confidence) for r in found] == [("G", 2, 0.75), ("C", 0, 1.0), ("P", 0, 0.9)]
