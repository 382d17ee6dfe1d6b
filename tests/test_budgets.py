"""Budgeted sections against a plain writer; sketches' merges."""

import random

from pyspark.sql import functions as F

from ontoweave.operators import budgets as B
from ontoweave.operators import sketches as K


def plain(sections, rows, budget):
    """{section: (entries, omitted, used, carry)} of one entity; ``rows`` are lists of (full, short) by section."""
    carry, out = 0, {}
    for s in sections:
        entries = rows.get(s.name, [])
        if not entries:
            continue
        room, used = int(budget * s.share) + carry, len(f"## {s.title}") + 2
        limit = room if used + sum(len(f) + 1 for f, _ in entries) <= room else used + B.FULL_SHARE * (room - used)
        lines = []
        for full, short in entries:
            whole = used + len(full) + 1 <= limit
            text = full if whole else short
            if used + len(text) + 1 > room:
                break
            if not whole:
                limit = 0
            lines.append(("full" if whole else "short", text))
            used += len(text) + 1
        used += B.OMITTED_SIZE if len(lines) < len(entries) else 0
        carry = max(0, room - used)
        out[s.name] = (lines, len(entries) - len(lines), used, carry)
    return out


def test_sections_equal_a_plain_writer(spark):
    rng = random.Random(8)
    sections = [B.Section("a", "First", 0.4), B.Section("b", "Second part", 0.3), B.Section("c", "Rest", 0.3)]
    rows, want = [], {}
    for e in range(60):
        mine = {s.name: [("x" * rng.randint(0, 60), "y" * rng.randint(0, 12)) for _ in range(rng.choice([0, 1, 3, 9, 30]))] for s in sections}
        rows += [(e, s, i, *texts) for s, list_ in mine.items() for i, texts in enumerate(list_)]
        want[e] = plain(sections, mine, 400)
    texts, told = B.budgeted_sections(spark.createDataFrame(rows, "entity int, section string, place int, full string, short string"), sections, 400)
    got = {(r.entity, r.section): (r.shown, r.omitted, r.used, r.carry) for r in told.collect()}
    assert got == {(e, s): (len(lines), omitted, used, carry) for e, w in want.items() for s, (lines, omitted, used, carry) in w.items()}
    lines = {}
    for r in sorted(texts.collect(), key=lambda r: r.place):
        lines.setdefault((r.entity, r.section), []).append((r.form, r.text))
    assert lines == {(e, s): w[0] for e, ws in want.items() for s, w in ws.items() if w[0]}
    none = B.budgeted_sections(spark.createDataFrame([], "entity int, section string, place int, full string, short string"), sections, 400)
    assert none[0].count() == none[1].count() == 0


def test_cited_facts(spark):
    rows = [(1, "b", 2, "x"), (1, "b", 1, "y"), (1, "a", 9, "z"), (1, "none", 1, "q"), (2, "b", 1, "w"), (2, "b", 1, "v")]
    got = {tuple(r) for r in B.cited_facts(spark.createDataFrame(rows, "entity int, kind string, place int, text string"), {"a": 3, "b": 1}).collect()}
    assert got == {(1, "E1", "a", "z"), (1, "E2", "b", "y"), (2, "E1", "b", "v")}


def test_merged_sketches_are_near_the_exact_figures(spark):
    e = spark.range(0, 40_000).select((F.col("id") % 10).cast("int").alias("day"), (F.hash("id") % 5000).alias("who"), F.when(F.col("id") % 50 > 0, (F.hash("id", F.lit(1)) % 1000).cast("double")).alias("v"))
    states = K.sketch_states(e, "day", "who", "v")
    spans = spark.createDataFrame([("all", 0, 9), ("some", 2, 4), ("beyond", 8, 30)], "range_id string, first int, last int")
    got = {r.range_id: r for r in K.merged_states(states, spans).collect()}
    for name, lo, hi in (("all", 0, 9), ("some", 2, 4), ("beyond", 8, 30)):
        x = e.where(F.col("day").between(lo, hi)).agg(F.count_distinct("who").alias("n"), F.count("*").alias("rows"), F.avg((F.col("v") <= got[name].median).cast("double")).alias("at")).first()
        assert got[name].rows == x.rows and abs(got[name].distinct - x.n) <= 0.03 * x.n and abs(x["at"] - 0.5) < 0.02
    assert K.merged_states(states.limit(0), spans).count() == 0
