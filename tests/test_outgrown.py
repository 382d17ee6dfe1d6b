"""Steps that a review projected to outgrow their limits: results against plain models, and the shape of their plans."""

import math

from ontoweave import plans
from ontoweave.operators import entities, graph, mechanisms, ontology, search, selection, similarity
from ontoweave.plans import files
from ontoweave.sources import tables, xml

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _plans(monkeypatch, module):
    """(name, plan) of whatever the module settles from now on."""
    seen, settle = [], module.settle
    monkeypatch.setattr(module, "settle", lambda df, name="step": (seen.append((name, _plan(df))), settle(df, name))[1])
    return seen


def test_claims_are_told_without_a_shuffle(spark):
    frame = spark.createDataFrame
    nodes = frame([("d1", "disease"), ("d2", "disease"), ("g1", "gene"), ("g2", "gene"), ("evidence:9", "other"), ("p1", "other")], "id string, kind string")
    relations = frame([("g1", "d1", "causes", "s"), ("g2", "d1", "causes", "s"), ("g1", "d2", "causes", "s"), ("g1", "d1", "causes", "s"), ("evidence:9", "d1", "claim_subject", "p1")], "src string, dst string, relation string, source string")
    claims = frame([(1, "g1", "g2", "p1"), (2, "d1", "g1", "p1"), (3, "g2", "g2", "p1"), (4, "g1", "d2", "p1"), (4, "d2", "g2", "p1"), (9, "d1", "zz", "p1"), (9, "d1", "g2", "p1"), (1, "g1", "g2", "p1")], "claim long, subject string, object string, paper string")
    found = entities.entity_graph(frame([("d1",), ("d2",)], "entity string"), nodes, relations, claims, frame([("p1",)], "paper string"), frame([("d1", "p1"), ("d1", "p1")], "entity string, paper string"))
    sound = {(1, "g1", "g2"), (2, "d1", "g1"), (3, "g2", "g2"), (4, "g1", "d2"), (4, "d2", "g2"), (9, "d1", "g2")}
    near = {"d1": {"d1", "g1", "g2"}, "d2": {"d2", "g1"}}
    want = {("d1", g, "d1", "causes", "s") for g in ("g1", "g2")} | {("d2", "g1", "d2", "causes", "s"), ("d1", "evidence:9", "d1", "claim_subject", "p1"), ("d1", "d1", "p1", "literature_search_result", "search")}
    for e, anchors in near.items():
        asked = {c for c, s, o in sound if {s, o} & anchors}
        for c, s, o in sound:
            if c in asked:
                want |= {(e, f"evidence:{c}", s, "claim_subject", "p1"), (e, f"evidence:{c}", o, "claim_object", "p1"), (e, "p1", f"evidence:{c}", "contains_claim", "p1")}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert _plan(found).startswith("Union")


def test_leaves_take_no_part_in_rounds(spark, monkeypatch):
    seen = _plans(monkeypatch, ontology)
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("a", "c"), ("x", "c"), ("c", "c"), ("x", None), (None, "c"), ("a", "b"), ("y", "y")]
    shut = ontology.closure(spark.createDataFrame(edges, "child string, parent string"))
    want = {("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("b", "b", 0), ("b", "c", 1), ("c", "c", 0), ("c", "b", 1), ("x", "x", 0), ("x", "c", 1), ("x", "b", 2)}
    assert {tuple(r) for r in shut.collect()} == want and shut.count() == len(want)
    assert [name for name, _ in seen][:3] == ["edges", "parents", "upper"]
    own = spark.createDataFrame([("e", "a", 0.5), ("e", "x", 1.0), ("f", "b", 0.1), ("f", "unknown", 1.0)], "entity string, term string, freq double")
    prop = ontology.propagate(own, shut)
    assert {tuple(r) for r in prop.collect()} == {("e", "a", 0.5), ("e", "x", 1.0), ("e", "b", 1.0), ("e", "c", 1.0), ("f", "b", 0.1), ("f", "c", 0.1)}
    # An entity's rows are parted into ancestors where they are merged.
    assert "RepartitionByExpression [entity" in _plan(prop)


def test_only_the_focus_is_brought_to_others(spark, monkeypatch):
    up = {"a": "t", "b": "t", "t": "r", "c": "r", "r": None}
    above = {t: [t] + ([up[t]] if up[t] else []) + (["r"] if up[t] == "t" else []) for t in up}
    ic = {"a": 3.0, "b": 2.0, "t": 1.0, "c": 2.5, "r": 0.0}
    own = {"f": {"a": 1.0, "b": 0.5}, "g": {"a": 0.25, "c": 1.0}, "h": {"c": 0.5, "t": 1.0}, "i": {"a": 1.0}}
    frame = spark.createDataFrame
    ann = frame([(e, t, f) for e, ts in own.items() for t, f in ts.items()], "entity string, term string, freq double")
    held = {e: {x for t in ts for x in above[t]} for e, ts in own.items()}
    prop = frame([(e, x, 1.0) for e in held for x in held[e]], "entity string, term string, freq double")
    closed = frame([(t, x, 0) for t in above for x in above[t]], "descendant string, ancestor string, depth int")
    seen = _plans(monkeypatch, similarity)
    got = {(r.a, r.b): r.similarity for r in similarity.symmetric_similarity(ann, prop, frame(list(ic.items()), "term string, ic double"), closed, "f", 2, 0.0).collect()}
    value = lambda a, b: max(1e-9, sum(max(ic[x] for x in above[t] if x in held[b]) * (0.4 + 0.6 * f) for t, f in own[a].items()))
    want = {("f", e): math.sqrt(value("f", e) / value("f", "f") * (value(e, "f") / value(e, e))) for e in ("g", "h")}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in want)
    # What is settled of all entities is one row each, not one a pair.
    assert "Join Inner" not in dict(seen)["directed"].split("Join LeftOuter")[0]
    assert [name for name, _ in seen] == ["focus", "directed", "climbs"]


def test_edges_are_cut_to_the_asked_nodes_first(spark, monkeypatch):
    seen = _plans(monkeypatch, graph)
    edges = spark.createDataFrame([("a", "b", "s", 1), ("b", "c", "s", 2), ("a", "b", "s", 1)], "src string, dst string, source string, weight int")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.expand_frontier(edges, start, 2, 1, 5).collect()} == {("a", 0, 0), ("b", 1, 1), ("c", 2, 1)}
    first = next(p for name, p in seen if name == "frontier" and "Window" in p)
    assert first.index("Window") < first.index("LeftSemi")
    seen.clear()
    assert {tuple(r) for r in graph.shortest_paths(edges, start, 3).collect()} == {("a", 0, None), ("b", 1, "a"), ("c", 2, "b")}
    # Edges are not merged before they meet the nodes of the round.
    assert seen[1][0] == "paths" and seen[1][1].count("Aggregate") == 1


def test_pairs_are_counted_in_as_many_tasks_as_they_need(spark):
    assert "RepartitionByExpression [a#" in _plan(plans.QUERIES["jn_06_inverted_index_pairs"](spark, SMALL))


def test_selection_joins_once(spark):
    frame = spark.createDataFrame
    items = frame([(1, 1, 3, 1, True), (1, 2, 3, 2, False), (1, 3, 1, 3, False), (2, 4, 1, 1, False)], "group int, item int, level int, place int, own boolean")
    found = selection.diverse_selection(items, frame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y"), (1, 3, "y")], "group int, item int, key string"), frame([(1, "y", 0)], "group int, key string, place int"), 3)
    assert {tuple(r) for r in found.collect()} == {(1, 3, 1), (1, 1, 2), (1, 2, 3), (2, 4, 1)}
    assert _plan(found).count("Join") == 1


def test_bridges_merge_only_edges_of_neighbours(spark, monkeypatch):
    seen = _plans(monkeypatch, mechanisms)
    assert plans.QUERIES["gr_42_bridges"](spark, SMALL).count() > 0
    there = dict(seen)["there"]
    assert there.index("Aggregate") < there.index("LeftSemi")


def test_texts_not_words_are_shuffled_for_an_index(spark, monkeypatch):
    seen = _plans(monkeypatch, search)
    index = search.build_index(spark.createDataFrame([(1, "a b a", None), (2, "b", "c")], "doc_id long, text string, source string"), ["text", "source"])
    assert {(r.doc_id, r.field, r.term, tuple(r.positions)) for r in index.postings.collect()} == {(1, "text", "a", (0, 2)), (1, "text", "b", (1,)), (2, "text", "b", (0,)), (2, "source", "c", (0,))}
    assert index.sizes.count() == 4 and "RepartitionByExpression [doc_id#" in dict(seen)["postings"]


def test_xml_files_are_of_bounded_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(xml, "RECORDS_PER_FILE", 100)
    monkeypatch.setattr(files, "_fresh", lambda spark, name: str(tmp_path / name))
    assert plans.QUERIES["src_13_15_nested_xml"](spark, SMALL).count() > 1000
    assert len(list((tmp_path / "xml").glob("part-*"))) > 5


def test_concepts_of_a_paper_are_made_one_first(spark):
    rows = spark.createDataFrame([(1, "Gene", "B1", "m2", 2), (1, "Gene", "B1", "m1", 1), (2, "Gene", "B1", None, 3), (2, "Gene", "C", None, 4)], "pmid long, type string, db_id string, mention string, at long")
    found = tables.concepts(rows, spark.createDataFrame([], "type string, db_id string, name string"))
    assert {tuple(r) for r in found.collect()} == {("Gene", "B1", "m1", 2), ("Gene", "C", "C", 1)}
    assert "RepartitionByExpression [type#" in _plan(found)
