"""Queries that were projected to outgrow their limits: what their steps may not do, and results against plain models."""

import math
import random

from ontoweave.operators import graph, lineage, ontology, profiles
from ontoweave.plans import QUERIES

SF = "/root/testdata/sf0.001"


def _settled(monkeypatch, *modules):
    """The names of what is written while a query is built."""
    names = []
    for module in modules:
        monkeypatch.setattr(module, "settle", lambda df, name="step": names.append(name) or lineage.settle(df, name))
    return names


def test_profile_scores_write_no_propagated_pairs(spark, monkeypatch):
    from ontoweave.plans import bindings, rankings

    names = _settled(monkeypatch, bindings, rankings, profiles)
    assert QUERIES["o_agg_18_profile_scores"](spark, SF).count() == 5
    # Lines are dealt by customer once: neither annotations nor features nor pairs of entity and ancestor are written beside the pairs.
    assert "pairs" in names and not {"annotations", "propagated", "features"} & set(names)


def test_weights_of_annotations_are_those_of_propagated_pairs(spark):
    edges = [("lens", "eye"), ("iris", "eye"), ("eye", "all"), ("spine", "bone"), ("bone", "all"), ("spine", "eye")]
    shut = ontology.closure(spark.createDataFrame(edges, "child string, parent string"))
    rows = [(e, t, 0.5) for e, ts in (("a", "lens iris"), ("b", "spine eye"), ("c", "bone"), ("d", "unknown"), ("e", "all lens"), (None, "iris")) for t in ts.split()] + [("f", None, 0.5)]
    ann = spark.createDataFrame(rows, "entity string, term string, freq double")
    want = {tuple(r) for r in ontology.term_weights(ontology.propagate(ann, shut)).collect()}
    assert {tuple(r) for r in ontology.annotation_weights(ann.union(ann), shut).collect()} == want and len(want) == 6
    assert ontology.annotation_weights(ann.where("entity = 'd'"), shut).count() == 0


def test_patients_of_one_feature_are_counted_without_meeting_it(spark):
    rng = random.Random(18)
    parent = {f"t{i}": f"t{i // 3}" for i in range(1, 40)}
    up = {t: {t} for t in ["t0", *parent]}
    for t in sorted(parent, key=lambda t: int(t[1:])):
        up[t] |= up[parent[t]]
    shut = spark.createDataFrame([(t, a, 0) for t in up for a in up[t]], "descendant string, ancestor string, depth int")
    told = {(c, rng.randrange(12), rng.choice(sorted(up)), rng.random() < 0.4) for c in "cd" for _ in range(120)}
    said = {(c, t): rng.choice((0.1, 0.9)) for c in "cd" for t in rng.sample(sorted(up), 15)}
    features = spark.createDataFrame(sorted(told), "cohort string, patient int, term string, excluded boolean")
    profile = spark.createDataFrame([(c, t, f) for (c, t), f in said.items()], "cohort string, term string, freq double")
    weights = spark.createDataFrame([(t, 1.0) for t in up], "term string, specificity double")
    for unique in (False, True):
        got = {r.cohort: r for r in profiles.score_profiles(profile, features, shut, weights, unique=unique).collect()}
        for c in "cd":
            has = {t: {p for k, p, f, x in told if k == c and not x and t in up[f]} for k, t in said if k == c}
            lacks = {t: {p for k, p, f, x in told if k == c and x and f in up[t]} for t in has}
            seen = {t: len(has[t]) + len(lacks[t]) for t in has}
            assert got[c].patients == len({p for k, p, _, _ in told if k == c}) and got[c].terms == len(has)
            assert math.isclose(got[c].supported, sum(bool(has[t]) for t in has if seen[t]) / sum(map(bool, seen.values())))
            assert got[c].contradicted == sum(said[c, t] >= 0.8 and seen[t] >= 3 and 2 * len(lacks[t]) > seen[t] for t in has)


def test_graph_merges_numbers_and_makes_no_lists_before_the_shuffle(spark):
    rows = [(1, 3, "sells", "1995", 10), (1, 3, "sells", "1995", 9), (1, 3, "sells", "1995", 10), (1, 3, "orders", "1995", 9), (1, 3, "sells", None, 7), (1, 3, "sells", None, 8), (3, 3, "sells", "1995", 1)]
    merged = graph.build_graph(spark.createDataFrame(rows, "src long, dst long, relation string, source string, proof long"), 3)
    assert {(*r[:4], tuple(sorted(r.evidence))) for r in merged.collect()} == {(1, 3, "sells", "1995", (9, 10)), (1, 3, "orders", "1995", (9,)), (1, 3, "sells", None, (7, 8))}
    found = QUERIES["gr_19_build_graph"](spark, SF)
    # Below every exchange there are only numbers of tables: no list, and no name of a node.
    lower = [part.split("ObjectHashAggregate")[0] for part in found._jdf.queryExecution().executedPlan().toString().split("Exchange")[1:]]
    assert len(lower) == 3 and not any("collect_list" in part or "supplier:" in part for part in lower)
    assert [r.evidence for r in found.where("src = 'supplier:1' and size(evidence) > 1").collect()] == [sorted(r.evidence) for r in found.where("src = 'supplier:1' and size(evidence) > 1").collect()]


def test_contradictions_are_told_where_lines_are_dealt_by_customer(spark, tmp_path):
    # Case 1 orders one part most, of its least brand; 2 has that brand by a part ordered too seldom; 3 orders an unknown part most; 4 has a part without a brand besides.
    lines = [(1, 10, 2), (1, 11, 1), (2, 10, 1), (2, 11, 3), (3, 99, 4), (3, 10, 1), (4, 12, 3), (4, 11, 3), (None, 10, 1)]
    spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(lines)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, p) for i, (_, p, n) in enumerate(lines) for _ in range(n)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10, "Brand#1", "A"), (11, "Brand#2", "B"), (12, None, "B")], "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["gr_38_contradicted"](spark, str(tmp_path))
    assert sorted(r.case for r in found.collect()) == [1, 4]
    # Lines are read once, and entities and ancestors meet in no join.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1 and "LeftSemi" not in plan


def test_mechanisms_settle_what_is_told_and_order_numbers_by_name(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ontoweave.operators import mechanisms

    names = _settled(monkeypatch, mechanisms)
    edges = spark.createDataFrame([(e, 1, dst, 0.5, False, False, None) for e, dst in enumerate((9, 10, 11))], "edge long, src long, dst long, confidence double, mostly_negative boolean, solution boolean, context long")
    papers = spark.createDataFrame([(0, "p"), (1, "q"), (2, "q"), (2, "r"), (2, "r")], "edge long, paper string")
    kinds, inputs = spark.createDataFrame([(n, "gene") for n in (9, 10, 11, 12)], "node long, kind string"), spark.createDataFrame([(1, 1)], "input long, entity long")
    found = mechanisms.mechanisms(inputs, edges, papers, kinds, spark.createDataFrame([(1, 12)], "input long, node long"), 4, name=lambda c: F.col(c).cast("string"))
    assert [tuple(r) for r in found.orderBy("place").collect()] == [(1, 11, 2, 0.5, 1), (1, 10, 1, 0.5, 2), (1, 9, 1, 0.5, 3), (1, 12, 0, 1.0, 4)] and names == ["told"]
