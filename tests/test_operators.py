"""Operators on small worked examples and against plain-Python models."""

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ontoweave.functions import ids, scores, text
from ontoweave.operators import evidence, graph, identity, ontology, ranking, search, similarity, state
from ontoweave.sources import html

# Tools: a hierarchy of its own. Four shops list tools; 'tool' says nothing, as every shop has one.
IS_A = [("saw", "cutting"), ("axe", "cutting"), ("cutting", "tool"), ("hammer", "hitting"), ("mallet", "hitting"), ("hitting", "tool")]
ANN = [("S1", "saw", 1.0), ("S1", "hammer", 0.5), ("S2", "axe", 1.0), ("S3", "mallet", 0.2), ("S3", "saw", 0.1), ("S4", "hammer", 1.0)]


def index(spark):
    shut = ontology.closure(spark.createDataFrame(IS_A, "child string, parent string"))
    ann = spark.createDataFrame(ANN, "entity string, term string, freq double")
    prop = ontology.propagate(ann, shut)
    return shut, ann, prop, ontology.term_weights(prop)


def test_closure_is_idempotent_and_survives_cycles(spark):
    shut = ontology.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string"))
    assert shut.count() == 9
    again = ontology.closure(shut.select(F.col("descendant").alias("child"), F.col("ancestor").alias("parent")))
    assert {tuple(r)[:2] for r in again.collect()} == {tuple(r)[:2] for r in shut.collect()}


def test_information_content(spark):
    ic = {r.term: r.ic for r in index(spark)[3].collect()}
    assert math.isclose(ic["axe"], math.log(4)) and math.isclose(ic["saw"], math.log(2)) and math.isclose(ic["cutting"], math.log(4 / 3)) and ic["tool"] == 0


def test_ranking_example(spark):
    shut, ann, prop, weights = index(spark)
    case = spark.createDataFrame([(1, "saw"), (1, "hammer")], "case int, term string")
    among = ranking.candidates(case, prop)
    got = {r.entity: r for r in ranking.rank_entities(case, prop, weights, shut).collect()}
    # By hand: saw and hammer weigh ln 2, their parents ln 4/3.
    two, part = math.log(2), math.log(4 / 3)
    assert set(got) == {"S1", "S3", "S4"} and got["S1"].full == 2 and got["S4"].full == 1
    assert math.isclose(got["S1"].score, two * 1.0 + two * 0.8)
    assert math.isclose(got["S3"].score, two * 0.64 + part * 0.68) and math.isclose(got["S4"].score, two)
    cov = {r.entity: r.coverage for r in ranking.annotation_coverage(case, ann, weights, shut, among).collect()}
    assert math.isclose(cov["S1"], 1.0)
    # S3: the saw is explained whole, the mallet (ln 4) by its parent alone.
    assert math.isclose(cov["S3"], (0.1 * two + 0.2 * part) / (0.1 * two + 0.2 * math.log(4)))
    without = ranking.rank_entities(case, prop, weights, shut, excluded=spark.createDataFrame([("saw",)], "term string"))
    assert math.isclose({r.entity: r.score for r in without.collect()}["S1"], part * 1.0 + two * 0.8)


def test_merging_pinning_and_gating(spark):
    _, ann, _, _ = index(spark)
    rows = spark.createDataFrame([(1, "S1", 3.0, 2), (1, "S3", 2.9, 2), (1, "S4", 1.0, 1), (1, "S2", 0.5, 0)], "case int, entity string, score double, full long")
    names = spark.createDataFrame([("S1", "one"), ("S4", "one"), ("S2", "two"), ("S3", "three")], "entity string, name string")
    genes = spark.createDataFrame([(1, "G")], "case int, gene string")
    links = spark.createDataFrame([("G", "S2", False)], "gene string, entity string, causal boolean")
    merged = ranking.merge_names(rows, names, ann, genes, links)
    assert [(r.entity, r.xrefs, r.genes, r.annotated) for r in merged.orderBy("rank").collect()] == [("S2", [], 1, 1), ("S1", ["S4"], 0, 3), ("S3", [], 0, 2)]
    pinned = ranking.pin(merged, spark.createDataFrame([(1, "S4", 1), (1, "new", 2)], "case int, entity string, ord int"), 3)
    assert [(r.entity, r.pinned) for r in pinned.orderBy("rank").collect()] == [("S1", True), ("new", True), ("S2", False)]
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("score"))))
    assert [r.entity for r in ranking.focus_gate(plain, 3).orderBy("rank").collect()] == ["S1", "S3"]


def test_dedupe_is_greedy(spark):
    keys = {"a": {"1"}, "b": {"2"}, "c": {"1", "2", "3"}, "d": {"3"}, "e": {"2"}}
    ranked = spark.createDataFrame([(1, x, i + 1, 1.0) for i, x in enumerate(keys)], "case int, entity string, rank int, score double").withColumn("xrefs", F.array().cast("array<string>"))
    table = spark.createDataFrame([(x, k) for x, ks in keys.items() for k in ks], "entity string, key string")
    got = [(r.entity, sorted(r.xrefs)) for r in ranking.dedupe_ranking(ranked, table).orderBy("rank").collect()]
    out = []
    for x, ks in keys.items():
        hit = next((o for o in out if o[2] & ks), None)
        if hit:
            hit[1].append(x)
            hit[2].update(ks)
        else:
            out.append((x, [], set(ks)))
    assert got == [(x, sorted(more)) for x, more, _ in out]


def test_weighted_neighbours(spark):
    _, ann, prop, weights = index(spark)
    found = {r.other: r for r in similarity.weighted_neighbours(prop, weights, spark.createDataFrame([("S4",)], "entity string"), ann).collect()}
    two, part = math.log(2), math.log(4 / 3)
    assert set(found) == {"S1", "S3"} and found["S1"].features == ["hammer", "hitting"] and math.isclose(found["S1"].exact, 0.5)
    assert math.isclose(found["S1"].score, (two + part) / (2 * two + 2 * part)) and found["S3"].exact == 0


def test_pairs_and_merges_match_plain_models(spark):
    rng = random.Random(11)
    sets = {i: set(rng.sample(range(12), rng.randint(1, 6))) for i in range(60)}
    rows = spark.createDataFrame([(i, str(f)) for i, s in sets.items() for f in s], "entity long, feature string")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    pairs = similarity.jaccard_pairs(rows, 0.5)
    got = {(r.a, r.b): r.jaccard for r in pairs.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in want)
    block = {i: {i} for i in sets}
    for a, b in sorted(want, key=lambda p: (-want[p], p)):
        x, y = block[a], block[b]
        if x is not y and all((min(i, j), max(i, j)) in want for i in x for j in y):
            x |= y
            block.update({n: x for n in y})
    clusters = {(min(x), n) for x in block.values() if len(x) > 1 for n in x}
    assert {tuple(r) for r in identity.complete_link(pairs.select("a", "b", F.col("jaccard").alias("value")), 0.5).collect()} == clusters
    nodes = [f"{rng.choice('ABXYZ')}:{i}" for i in range(40)]
    links = [(*rng.sample(nodes, 2), i) for i in range(90)]
    block = {n: {n} for link in links for n in link[:2]}
    for a, b, _ in links:
        x, y = block[a], block[b]
        if x is not y and not any(i[0] == j[0] and i[0] in "AB" for i in x for j in y):
            x |= y
            block.update({n: x for n in y})
    merged = identity.veto_merge(spark.createDataFrame(links, "a string, b string, ord int"), ["A", "B"])
    assert {r.node: r.entity for r in merged.collect()} == {n: min(x) for n, x in block.items()}


def test_complete_link_does_not_chain(spark):
    pairs = spark.createDataFrame([("M1", "M2", 0.8), ("M2", "M3", 0.7), ("M1", "M3", 0.1)], "a string, b string, value double")
    assert {tuple(r) for r in identity.complete_link(pairs, 0.5).collect()} == {("M1", "M1"), ("M1", "M2")}
    assert identity.complete_link(pairs, 0.9).count() == 0


def test_cluster_ids(spark):
    row = spark.range(1).select(
        identity.stable_cluster_id("pathway", F.lit("GO:1"), F.array(*map(F.lit, ("MONDO:1", "MONDO:2", "MONDO:3")))).alias("a"),
        identity.stable_cluster_id("phenotype", F.lit(None).cast("string"), F.array(F.lit("MONDO:1"), F.lit("MONDO:2"))).alias("b"),
    ).first()
    assert row.a == "pathway-1fba2d87c1e9fdeeac70" and row.b == "phenotype-f2fb45586bd1723707d3"


def test_components_match_a_plain_model(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    label = {x: x for p in links for x in p}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in identity.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label


def test_unique_prefixes_veto_merges(spark):
    links = [("A:1", "X:1", 1), ("A:2", "X:1", 2), ("A:2", "X:2", 3)]
    got = {r.node: r.entity for r in identity.veto_merge(spark.createDataFrame(links, "a string, b string, ord int"), ["A"]).collect()}
    assert got == {"A:1": "A:1", "X:1": "A:1", "A:2": "A:2", "X:2": "A:2"}


def test_paths(spark):
    edges = spark.createDataFrame([("HP:1", "HP:2"), ("OMIM:1", "HP:2")], "src string, dst string")
    got = {r.node: (r.length, r.via) for r in graph.shortest_paths(edges, spark.createDataFrame([("HP:1",)], "node string"), 5).collect()}
    assert got == {"HP:1": (0, None), "HP:2": (1, "HP:1"), "OMIM:1": (2, "HP:2")}


def test_scores(spark):
    values = {"a": [0.9, 0.49], "b": [1.2, 0.3], "c": [0.25, 0.35], "d": [None]}
    frame = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: r.s for r in frame.groupBy("k").agg(F.round(scores.noisy_or(F.col("v")), 6).alias("s")).collect()}
    assert got == {"a": 0.949, "b": 1.0, "c": 0.5125, "d": 0.0}
    row = spark.range(1).select(*(F.round(scores.degree_specificity(F.lit(n)), 6) for n in (1, 30, 3000))).first()
    assert tuple(row) == (0.924743, 0.62716, 0.130684)


def test_frequency(spark):
    said = {"HP:0040280": 1.0, "Very frequent": 0.9, "frequent (x)": 0.55, "3/7": 3 / 7, "45%": 0.45, "rare": 0.5, "": 0.5, None: 0.5, "1/0": 0.5}
    frame = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r.t: r.f for r in frame.select("t", scores.frequency(F.col("t")).alias("f")).collect()} == said


def test_identifiers(spark):
    row = spark.range(1).select(
        ids.normalize(F.lit("mondo:123")), ids.normalize(F.lit("Foo:1")), ids.bridge_id(F.lit(" foo:1")), ids.normalize(F.lit("plain")), ids.bridge_id(F.lit("Orphanet:5")),
        ids.publication_ids(F.lit("PMID:012"), F.lit("pmc7"), F.lit("https://doi.org/10.1000/AB")),
    ).first()
    assert row[:5] == ("MONDO:0000123", "Foo:1", "FOO:1", "plain", "ORPHA:5") and row[5] == ["PMID:12", "PMC7", "DOI:10.1000/ab"]


def test_similar_names(spark):
    pairs = [("Marfan syndrome", "marfanoid habitus", True), ("PMM2-CDG", "pmm2-cdg type 1", True), ("abnormal x", "abnormal y", False)]
    frame = spark.createDataFrame(pairs, "q string, l string, want boolean")
    assert all(r.want == r.got for r in frame.select("want", text.similar(F.col("q"), F.col("l")).alias("got")).collect())


def test_edge_confidence(spark):
    quotes = [(1, "p1", "clinical_trial", "positive", False), (1, "p2", "observational", "positive", True), (1, "p3", "review", "negative", False), (2, "p1", "animal", "negative", False)]
    got = {r.edge: r for r in evidence.edge_confidence(spark.createDataFrame(quotes, "edge int, paper string, level string, effect string, abstract boolean")).collect()}
    assert (got[1].confidence, got[1].papers, got[1].mostly_negative) == (0.949, 2, False)
    assert (got[2].confidence, got[2].mostly_negative) == (0.0, True)


def test_counter_restarts_at_its_end(spark):
    events = spark.createDataFrame([(1, 0, 1), (1, 9, 2), (1, 10, 3), (1, 11, 4)], "key long, at long, id long")
    got = [(r.at, r.hits, r.allowed) for r in state.fixed_window_counter(events, 10, 1).orderBy("at").collect()]
    assert got == [(0, 1, True), (9, 2, False), (10, 1, True), (11, 2, False)]


def test_html_rows(spark):
    page = "<table><tbody><tr><td><b>A&amp;B</b></td><td> 2 </td></tr><tr><td>c</td></tr></tbody></table>"
    got = html.table_rows(spark.createDataFrame([(1, page)], "page_id int, html string")).orderBy("row").collect()
    assert [r.cells for r in got] == [["A&B", "2"], ["c"]]


def test_streams_match_batches(spark, tmp_path):
    from ontoweave.streaming import windows

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "events"))
    query = windows.windowed_counts(windows.read_events(spark, str(tmp_path / "events"))).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    batch = windows.windowed_counts(source.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("counted").select("start", "event_type", "n").collect())) == sorted(map(tuple, batch.select("start", "event_type", "n").collect()))


def test_last_writer_wins(spark, tmp_path):
    from ontoweave.streaming import windows

    write = windows.last_writer(str(tmp_path / "held"))
    schema = "key long, ord long, value string, deleted boolean"
    write(spark.createDataFrame([(1, 1, "a", False), (2, 1, "b", False)], schema), 0)
    write(spark.createDataFrame([(1, 2, "c", False), (2, 3, "", True)], schema), 1)
    write(spark.createDataFrame([(2, 2, "late", False)], schema), 2)
    assert [tuple(r) for r in windows.read_last(spark, str(tmp_path / "held")).collect()] == [(1, 2, "c", False)]


def test_search_language(spark):
    docs = [(11, 1990, "Garden tools for children", "Tools"), (12, 2021, "Tools and oak", None), (13, None, "A tools fair", None), (14, 2021, "Old saws", "Garden Tools"), (15, 2005, "Tool box", "boxes")]
    index = search.build_index(spark.createDataFrame([(i, t, m) for i, _, t, m in docs], "doc_id int, title string, tag string"), ["title", "tag"])
    tags = {"title": ["title"], "tag": ["tag"]}
    asked = {
        '"garden tools"[title] OR "garden tools"[tag]': {11, 14}, "tools": {11, 12, 13, 14}, "tool*": {11, 12, 13, 14, 15}, "tools NOT garden": {12, 13}, "tools AND (oak OR fair)": {12, 13},
        "tools[tag] children": {11}, "NOT tools": {15}, "a tools fair": {13}, "n avg": set(),
    }
    for text, want in asked.items():
        assert {r.doc_id for r in search.matching(index, search.parse_query(text, tags)).collect()} == want, text
    assert search.parse_query("()", tags) is None
    scores = {r.doc_id: r.score for r in search.weighted_bm25(index, ["garden", "n"], {"title": 1.0, "tag": 3.0}).collect()}
    assert set(scores) == {11, 14} and scores[14] > scores[11]


def test_near_join_meets_each_pair_once(spark):
    from ontoweave.operators.ranges import near_join

    left = [(0, -1.0), (1, 0.0), (2, 0.5), (3, 2.49), (4, None), (5, 0.0)]
    right = [(0, 0.5), (1, -0.5), (2, 1.0), (3, 2.5), (4, None)]
    got = near_join(spark.createDataFrame(left, "a int, x double"), spark.createDataFrame(right, "b int, y double"), "x", "y", 0.5).collect()
    want = [(a, b) for a, x in left for b, y in right if x is not None and y is not None and abs(x - y) <= 0.5]
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_stage_states(spark):
    from ontoweave.operators.state import stage_states

    rows = [(1, 0, 1, "queued"), (1, 0, 2, "running"), (1, 1, 1, "running"), (1, 1, 2, "done"), (1, 1, 3, "running"), (2, 0, 1, "queued"), (2, 1, 5, None), (2, 2, 2, "failed"), (2, 2, 1, "running")]
    got = stage_states(spark.createDataFrame(rows, "job int, stage int, ord int, kind string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "failed", 1), (1, 1, "done", 2), (2, 0, "queued", 0), (2, 2, "failed", 1)]
    assert stage_states(spark.createDataFrame([], "job int, stage int, ord int, kind string")).isEmpty()
