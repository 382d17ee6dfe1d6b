"""Frontier expansion against plain loops, and the search of names."""

import random

from ontoweave.operators import graph, search


def test_frontier_equals_plain_loops(spark):
    rng = random.Random(12)
    edges = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", f"s{rng.randrange(4)}"): rng.randint(1, 5) for _ in range(260)}.items())
    edges = [(*k, w) for k, w in edges]
    for rounds, per_source, most in ((1, 1, 1), (3, 2, 4), (4, 3, 100)):
        known, asked = {"n0": (0, 0), "n1": (0, 0)}, ["n0", "n1"]
        for r in range(1, rounds + 1):
            support = {}
            for node in asked:
                for source in {e[2] for e in edges}:
                    for _, dst, _, _ in sorted((e for e in edges if e[0] == node and e[2] == source), key=lambda e: (-e[3], e[1]))[:per_source]:
                        support.setdefault(dst, set()).add(source)
            fresh = {n: len(s) for n, s in support.items() if n not in known}
            known |= {n: (r, s) for n, s in fresh.items()}
            asked = sorted(fresh, key=lambda n: (-fresh[n], n))[:most]
        table = spark.createDataFrame(edges, "src string, dst string, source string, weight int")
        got = graph.expand_frontier(table, spark.createDataFrame([("n0",), ("n1",)], "node string"), rounds, per_source, most)
        assert {r.node: (r.round, r.support) for r in got.collect()} == known


def test_name_search(spark):
    rows = [("1", "Marfan syndrome", "Marfan syndrome", True), ("2", "Other", "marfan  Syndrome", False), ("3", "Neonatal Marfan syndrome", "Neonatal Marfan syndrome", True), ("3", "Neonatal Marfan syndrome", "NMS", False),
            ("4", "Z", "syndrome of Marfan", False), ("5", "Rett syndrome", "Rett syndrome", True), ("6", "Long other", "Marfan syndrome", False)]
    names = spark.createDataFrame(rows, "id string, label string, name string, is_label boolean")
    got = [r.id for r in search.name_search(names, " MARFAN syndrome ", 10).orderBy("place").collect()]
    assert got == ["1", "2", "6", "3", "4"]
    assert [r.id for r in search.name_search(names, "nms", 1).collect()] == ["3"] and search.name_search(names, " . ", 5).count() == 0
