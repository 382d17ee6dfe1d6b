"""Merges in order: the same blocks from whole components in tasks, from rounds and from a plain model; long chains in few writes."""

import random

import pytest

from ontoweave.operators import identity


def _greedy(links, may_join):
    block = {n: {n} for link in links for n in link[:2]}
    for a, b in links:
        x, y = block[a], block[b]
        if x is not y and may_join(x, y):
            x |= y
            block.update({n: x for n in y})
    return block


@pytest.mark.parametrize("cell_edges", [0, 12, identity.CELL_EDGES])
def test_cells_and_rounds_merge_alike(spark, cell_edges):
    rng = random.Random(cell_edges)
    # Three dense parts of different sizes and one chain, so that a bound of 12 leaves some of them to the rounds.
    pairs = [(o + a, o + b) for o, n in ((0, 7), (100, 12), (200, 4)) for a in range(n) for b in range(a) if rng.random() < 0.75] + [(300 + i, 301 + i) for i in range(5)]
    pairs = [(min(p), max(p)) for p in pairs]
    value = {p: round(rng.uniform(0.5, 1), 1) for p in pairs}
    good = set(pairs)
    block = _greedy(sorted(pairs, key=lambda p: (-value[p], p)), lambda x, y: all((min(i, j), max(i, j)) in good for i in x for j in y))
    want = {(min(x), n) for x in block.values() if len(x) > 1 for n in x}
    rows = spark.createDataFrame([(a, b, value[a, b]) for a, b in pairs] + [(1, 2, 0.1), (3, 3, 1.0)], "a int, b int, value double")
    assert {tuple(r) for r in identity.complete_link(rows, 0.5, cell_edges).collect()} == want

    nodes = [f"{rng.choice('ABXYZ')}:{i}" for i in range(60)]
    links = [tuple(rng.sample(nodes, 2)) for _ in range(55)]
    block = _greedy(links, lambda x, y: not any(i[0] == j[0] and i[0] in "AB" for i in x for j in y))
    rows = spark.createDataFrame([(*p, i) for i, p in enumerate(links)] + [("X:99", "X:99", 0), (None, "X:1", 1)], "a string, b string, ord int")
    assert {r.node: r.entity for r in identity.veto_merge(rows, ["A", "B"], cell_edges).collect()} == {n: min(x) for n, x in block.items()} | {"X:99": "X:99"}


def test_a_chain_of_rising_edges_needs_few_writes(spark, monkeypatch):
    n = 100_000
    writes, settle = [], identity.settle
    monkeypatch.setattr(identity, "settle", lambda df, name="step": writes.append(name) or settle(df, name))
    chain = spark.range(n).selectExpr("id as a", "id + 1 as b", f"0.5 + id / {2 * n} as value")
    got = identity.complete_link(chain, 0.5)
    # The last edge is best, so pairs form from the far end.
    assert (got.count(), got.select("cluster").distinct().count()) == (2 * ((n + 1) // 2), (n + 1) // 2) and len(writes) < 30


def test_nothing_to_merge(spark):
    assert identity.complete_link(spark.createDataFrame([], "a long, b long, value double"), 0.5).count() == 0
    assert identity.veto_merge(spark.createDataFrame([], "a string, b string, ord int"), ["A"]).count() == 0
