"""Steps whose work must not outgrow their input: results against plain models, and what their plans may not hold."""

import math
import random

import pytest

from ontoweave.operators import bridge, lookups, ranking, similarity


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block_entries, block_sets, at_least", [(2_000_000, 8192, 0.3), (150, 20, 0.3), (2_000_000, 7, 1e-9), (1, 1, 0.8)])
def test_grid_of_set_blocks_finds_every_pair(spark, block_entries, block_sets, at_least):
    rng = random.Random(block_sets)
    # Some features that most sets have, many that few have, and copies.
    sets = {i: {f"w{min(rng.randrange(1, 400), rng.randrange(1, 400)) // rng.choice((1, 40))}" for _ in range(rng.choice((1, 4, 30)))} for i in range(24)}
    sets |= {100 + i: set(s) for i, s in list(sets.items())[:4]}
    rows = spark.createDataFrame([(i, f) for i, s in sets.items() for f in s] * 2 + [(None, "x"), (5, None)], "entity long, feature string")
    pairs = similarity.jaccard_pairs(rows, at_least, block_entries, block_sets)
    want = {(a, b): (len(s & t), len(s & t) / len(s | t)) for a, s in sets.items() for b, t in sets.items() if a < b and s & t and len(s & t) >= at_least * len(s | t)}
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in pairs.collect()}
    assert got.keys() == want.keys() and pairs.count() == len(got)
    assert all(got[p][0] == want[p][0] and math.isclose(got[p][1], want[p][1]) for p in want)
    # No join brings whole sets to pairs, which outgrow the sets.
    assert "Join" not in _plan(pairs)


def test_variants_of_one_change_meet_no_one_by_one(spark):
    asked = spark.createDataFrame([(1, "g", "p.V600E"), (1, "g", "p.V601E"), (2, "g", "p.V600E"), (3, "g", "p.V602E"), (3, "g", "p.V600E")], "asked int, gene string, change string")
    variants = spark.createDataFrame([(10, ["g"], "p.V600E"), (11, ["g"], "p.V601E"), (12, ["g"], "p.V601E"), (10, ["g", "h"], "p.V602E")], "variant int, genes array<string>, change string")
    found = lookups.resolve_variants(asked, variants)
    assert {tuple(r) for r in found.collect()} == {(2, 10), (3, 10)}
    plan = _plan(found)
    assert "Aggregate" in plan[plan.index("Join"):]


def test_bridge_brings_no_profile_to_a_pair(spark, monkeypatch):
    plans, settle = [], bridge.settle
    monkeypatch.setattr(bridge, "settle", lambda df, name="step": (plans.append(_plan(df)) if name == "pairs" else None) or settle(df, name))
    rows = [(e, "phenotype", f, f != "p9") for e, fs in (("A", "p1 p2 p9"), ("B", "p1 p2 p3"), ("C", "p9"), ("D", "p9 p1")) for f in fs.split()] + [("A", "mechanism", "m", True), ("C", "mechanism", "m", True), ("E", "mechanism", "m", True), ("A", "phenotype", "p1", True)]
    claims = spark.createDataFrame([], "claim_id string, subject string, object string, relation string, direction string, polarity string")
    found = bridge.bridge_candidates(spark.createDataFrame(rows, "entity string, mode string, feature string, verified boolean"), claims, 0.3)
    got = {(r.a, r.b): (r.value and round(r.value, 6), r.shared_phenotypes, r.shared_processes) for r in found.collect()}
    assert got == {("A", "B"): (0.5, ["p1", "p2"], []), ("A", "C"): (0.333333, ["p9"], ["m"]), ("A", "D"): (0.666667, ["p1", "p9"], []), ("A", "E"): (None, [], ["m"]), ("C", "E"): (None, [], ["m"])}
    assert len(plans) == 1 and plans[0].count("Join") == 1


def test_candidates_are_scored_in_their_row(spark):
    rng = random.Random(3)
    parent = {f"t{i}": f"t{i // 3}" for i in range(1, 30)}
    up = {t: {t} for t in ["t0", *parent]}
    for t in sorted(parent, key=lambda t: int(t[1:])):
        up[t] |= up[parent[t]]
    closed = spark.createDataFrame([(t, a, 0) for t in up for a in up[t]], "descendant string, ancestor string, depth int")
    own = {(f"e{e}", f"t{t}"): rng.choice((0.25, 0.5, 1.0)) for e in range(12) for t in rng.sample(range(30), 4)}
    carried = {}
    for (e, t), f in own.items():
        for a in up[t]:
            carried[e, a] = max(f, carried.get((e, a), 0))
    ic = {t: (0.0 if t == "t0" else 0.5 + int(t[1:]) % 7) for t in up}
    asks = {c: rng.sample(sorted(up), 3) for c in range(6)}
    among = [(c, f"e{e}") for c in range(6) for e in range(13)] + [(99, "e1")]
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    queries, out = frame([(c, t) for c in asks for t in asks[c]], "case int, term string"), frame([("t5",)], "term string")
    prop, ann = (frame([(e, t, f) for (e, t), f in x.items()], "entity string, term string, freq double") for x in (carried, own))
    weights = frame(list(ic.items()), "term string, ic double")
    useful = {t for t in up if ic[t] > 0 and t != "t5"}
    rows = frame(among, "case int, entity string")
    scored = ranking.rank_entities(queries, prop, weights, closed, rows, out)
    for r in scored.collect():
        best = [max(((ic[t] * (0.6 + 0.4 * carried[r.entity, t]), t == q) for t in up[q] & useful if (r.entity, t) in carried), default=(0, False)) for q in asks.get(r.case, [])]
        assert math.isclose(r.score, sum(v for v, _ in best), abs_tol=1e-9) and r.full == sum(o for _, o in best)
    covered = ranking.annotation_coverage(queries, ann, weights, closed, rows, out)
    for r in covered.collect():
        mine = {t: f for (e, t), f in own.items() if e == r.entity and t in useful}
        above = {a for q in asks.get(r.case, []) for a in up[q] & useful}
        explained = sum(f * max((ic[a] for a in up[t] & above), default=0) for t, f in mine.items())
        assert math.isclose(r.coverage, explained / sum(f * ic[t] for t, f in mine.items()) if mine else 1.0, abs_tol=1e-9)
    assert scored.count() == covered.count() == len(among)
    # A candidate is never made into a row for each of its case's terms.
    assert "Generate" not in _plan(scored) + _plan(covered)


def test_pins_read_a_ranking_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(ranking, "settle", lambda df, name="step", plain=ranking.settle: names.append(name) or plain(df, name))
    rows = spark.createDataFrame([(1, f"e{i}", 1.0 / i, 1, [], i) for i in range(1, 20)], "case int, entity string, score double, full int, xrefs array<string>, rank int")
    found = ranking.pin(rows, spark.createDataFrame([(1, "e7", 1), (1, "e18", 2)], "case int, entity string, ord int"), 3)
    assert names == ["near"]
    assert [(r.entity, r.pinned, r.score > 0) for r in found.orderBy("rank").collect()] == [("e7", True, True), ("e18", True, False), ("e1", False, True)]


def test_blocks_meet_where_sizes_allow_a_pair():
    sizes = [(n, 3 + n % 5) for n in range(1, 60)] + [(60, 900)]
    placed, partners = similarity._blocks(sizes, 0.4, 500, 40)
    held, meets = {}, dict(partners)
    for (n, first, parts), (size, count) in zip(placed, sizes):
        assert n == size
        for b in range(first, first + parts):
            held.setdefault(b, []).append((n, count / parts))
    assert set(held) == set(meets) and max(held) > 20
    assert all(sum(c for _, c in h) <= 40 and (sum(n * c for n, c in h) <= 500 or len(h) == 1) for h in held.values())
    for a, x in held.items():
        for b, y in held.items():
            assert (b in meets[a]) == (a in meets[b]) and (b in meets[a] or not any(min(m, n) >= 0.4 * max(m, n) for m, _ in x for n, _ in y))
    # Most blocks are too far apart in size to meet.
    wide = similarity._blocks([(2**k, 100) for k in range(12)], 0.4, 1 << 20, 100)[1]
    assert sum(len(p) for _, p in wide) < 0.3 * len(wide) ** 2
