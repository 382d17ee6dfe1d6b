"""Phrases, interpretation, qualified names and diverse selection against plain models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ontoweave.functions import names as N
from ontoweave.operators import phrases as P
from ontoweave.operators.interpretation import interpret
from ontoweave.operators.selection import diverse_selection
from ontoweave.plans.phrases import selection_tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most_broadcast", [500_000, 0])
def test_phrases_equal_a_plain_search(spark, most_broadcast):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "B", "c", "d"])
    texts = [(i, " ".join(word() + rng.choice(["", ",", "'", " -"]) for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(40, None), (41, ""), (42, "a " * 5000)]
    phrases = [(f"p{i}", " ".join(word() for _ in range(rng.randint(1, 5)))) for i in range(25)] + [("none", "-"), (None, "c  d"), ("same", "A b"), ("same", "a, b")]
    split = lambda t: re.findall("[a-z]+", (t or "").lower().replace("'", ""))
    want = set()
    for i, t in texts:
        w = split(t)
        for p, x in phrases:
            x = split(x)
            want |= {(i, p, s + 1, s + len(x)) for s in range(len(w) - len(x) + 1) if x and w[s : s + len(x)] == x}
    tables = spark.createDataFrame([(*t, 1) for t in texts], "text_id int, text string, head int"), spark.createDataFrame([(*p, "w") for p in phrases], "phrase_id string, phrase string, words string")
    found = P.phrase_matches(*tables, most_broadcast=most_broadcast)
    assert {tuple(r[c] for c in ("text_id", "phrase_id", "start", "end")) for r in found.collect()} == want
    kept = {m for m in want if not any(o[0] == m[0] and o[2] <= m[2] and o[3] >= m[3] and o[3] - o[2] > m[3] - m[2] for o in want)}
    assert {tuple(r[c] for c in ("text_id", "phrase_id", "start", "end")) for r in P.longest(found).collect()} == kept
    first = {}
    for m in sorted(kept, key=lambda m: (m[0], m[2], -m[3], m[1] or "")):
        if m[1] not in first.setdefault(m[0], []):
            first[m[0]].append(m[1])
    assert {(r.text_id, r.place, r.phrase_id) for r in P.first_named(found, 3).collect()} == {(t, i + 1, p) for t, ps in first.items() for i, p in enumerate(ps[:3])}
    assert P.phrase_matches(tables[0].limit(0), tables[1]).count() == 0 and P.phrase_matches(tables[0], tables[1].limit(0)).count() == 0


def test_names_and_topics(spark):
    texts = spark.createDataFrame([(1, "Muscular atrophy of the legs"), (2, "muscular legs"), (3, "plasma, rings"), (4, None), (5, "the big ring rings")], "text_id int, text string")
    names = spark.createDataFrame([("m", "muscular atrophy"), ("s", "SMA"), ("r", "ring"), ("b", "big ring")], "phrase_id string, phrase string")
    assert {tuple(r) for r in P.named(texts, names).collect()} == {(1, "m"), (3, "r"), (5, "r"), (5, "b")}
    rules = spark.createDataFrame([(1, "muscles", "muscular"), (2, "legs", "legs"), (3, "rings", "ring"), (3, "rings", "rings")], "place int, topic string, phrase string")
    got = {r.text_id: r.topic for r in P.inferred(texts, names.where("phrase_id in ('m', 'b')"), rules, "body").collect()}
    assert got == {1: "legs", 2: "muscles", 3: "rings", 4: "body", 5: "rings"}
    assert P.inferred(texts, names.where("phrase_id = 'b'"), rules.limit(0), "body").where("topic = 'body'").count() == 5


def test_interpretation(spark):
    names = spark.createDataFrame(
        [("FBN1", "gene", "g1", False), ("Marfan  syndrome", "disease", "d1", True), ("marfan syndrome", "phenotype", "p1", False), ("short stature", "disease", "d2", False), ("Short Stature", "phenotype", "p2", False),
         ("cleft lip and palate", "phenotype", "p3", False), ("palate", "phenotype", "p4", False), ("a, b", "disease", "d0", True), ("fbn1", "disease", "d9", True), ("", "disease", "empty", True)],
        "name string, kind string, id string, fixed boolean")
    texts = {1: " marfan Syndrome ", 2: "FBN1 + short stature", 3: "cleft lip and palate", 4: "palate and unknown", 5: "fbn1 with palate, , what", 6: "A, B", 7: "  ", 8: None, 9: "and"}
    got = {}
    for r in interpret(spark.createDataFrame(list(texts.items()), "text_id int, text string"), names).collect():
        got.setdefault(r.text_id, []).append((r.part, r.piece, r.segment, r.id))
    assert {k: [x[2:] for x in sorted(v)] for k, v in got.items()} == {
        1: [("marfan Syndrome", "d1")], 2: [("FBN1", "g1"), ("short stature", "p2")], 3: [("cleft lip and palate", "p3")], 4: [("palate and unknown", None)],
        5: [("fbn1", "g1"), ("palate", "p4"), ("what", None)], 6: [("A, B", "d0")], 9: [("and", None)]}


def plain_qualified(label, names):
    key = lambda t: re.findall("[a-z0-9]+", t.lower().replace("'s", "s"))
    mark = re.compile(N.DESIGNATOR)

    def extends(sub, base):
        more = sub[len(base) :]
        return sub.startswith(base) and bool((re.fullmatch("[a-z]", base) and re.fullmatch("[0-9]{1,2}", more)) or (re.fullmatch("[0-9]+", base) and re.fullmatch("[a-z]", more)))

    w = key(label)
    if len(w) < 2:
        return None
    used = [k for k in (key(n) for n in names if n and ";" not in n) if len(k) >= 2 and not re.search("(?<![su])s$", k[-1])]
    known = [x for k in used for x in k if mark.match(x)]
    for n in used:
        for i in range(len(w) - len(n) + 1):
            seg, rest = w[i : i + len(n)], w[:i] + w[i + len(n) :]
            if seg[:-1] == n[:-1] and (seg[-1] == n[-1] or extends(seg[-1], n[-1])) and not set(rest) & set(N.NOT_SAME):
                if all(any(d == k or extends(d, k) or extends(k, d) for k in known) for d in rest if mark.match(d)):
                    return "qualified" if rest or seg != n else "same name"
    for n in used:
        for i in range(len(n) - len(w) + 1):
            rest = n[:i] + n[i + len(w) :]
            if n[i : i + len(w)] == w and rest and all(x in N.QUALIFIERS for x in rest):
                return "parent"
    return None


def test_qualified_match(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("pompe disease type late onset c c1 1 1a ii iii like severe niemann pick syndromes lupus".split())
    text = lambda low: rng.choice([" ", "-"]).join(word() for _ in range(rng.randint(low, 4)))
    rows = [(text(0), [rng.choice([text(0), text(2), text(2), None, "a b; c"]) for _ in range(rng.randint(0, 3))]) for _ in range(3000)]
    rows += [("Late-onset Pompe disease", ["Pompe disease"]), ("Niemann-Pick type C1", ["Niemann-Pick type C"]), ("Niemann-Pick type A", ["Niemann-Pick type C"]), ("Rett syndrome", ["Atypical Rett syndrome"]), ("Pompe-like disease", ["Pompe disease"])]
    got = [r.m for r in spark.createDataFrame(rows, "label string, names array<string>").select(N.qualified_match(F.col("label"), F.col("names")).alias("m")).collect()]
    want = [plain_qualified(*r) for r in rows]
    assert got == want and {"qualified", "same name", "parent", None} == set(want)
    assert got[-5:] == ["qualified", "qualified", None, "parent", None]


def plain_selection(items, keys, wanted, n):
    """``items`` (item, level, place, own) of one group, ``keys`` by item, ``wanted`` in order."""
    ranked = sorted(items, key=lambda x: x[2])
    cap, out = max(1, 2 * n // 3), []

    def take(k):
        for x in ranked:
            if len(out) < cap and x not in out and k in keys.get(x[0], ()):
                out.append(x)
                return

    for k in wanted:
        take(k)
    covered = {k for x in out for k in keys.get(x[0], ())}
    for k in dict.fromkeys(k for x in ranked if x[3] for k in sorted(keys.get(x[0], ()))):
        if k not in covered:
            take(k)
            covered |= {k for x in out for k in keys.get(x[0], ())}
    out = out[:n]
    covered = {k for x in out for k in keys.get(x[0], ())}
    while len(out) < n and len(out) < len(ranked):
        left = [x for x in ranked if x not in out]
        pool = [x for x in left if x[1] == max(y[1] for y in left)]
        x = next((x for x in pool if set(keys.get(x[0], ())) - covered), pool[0])
        covered |= set(keys.get(x[0], ()))
        out.append(x)
    return [x[0] for x in out]


def test_diverse_selection_is_the_greedy_one(spark):
    rng = random.Random(9)
    items, keys, wanted = [], [], []
    for g in range(25):
        m = rng.randint(0, 9)
        places = rng.sample(range(100), m)
        items += [(g, i, rng.randint(1, 3), p, rng.random() < 0.4) for i, p in enumerate(places)]
        keys += [(g, i, k) for i in range(m) for k in "abcdef" if rng.random() < 0.3] * 2
        wanted += [(g, k, p) for p, k in enumerate(rng.sample("abcdefx", rng.randint(0, 4)))]
    tables = [spark.createDataFrame(items, "group int, item int, level int, place int, own boolean"), spark.createDataFrame(keys, "group int, item int, key string"), spark.createDataFrame(wanted, "group int, key string, place int")]
    for n in (1, 4):
        got = {}
        for r in sorted(diverse_selection(*tables, n).collect(), key=lambda r: r.turn):
            got.setdefault(r.group, []).append(r.item)
        for g in range(25):
            held = {}
            for a, i, k in keys:
                if a == g:
                    held.setdefault(i, set()).add(k)
            assert got.get(g, []) == plain_selection([x[1:] for x in items if x[0] == g], held, [k for a, k, p in wanted if a == g], n)


def test_diverse_selection_of_the_tables(spark):
    items, keys, wanted = selection_tables(spark, SMALL)
    got = {}
    for r in sorted(diverse_selection(items, keys, wanted, 6).collect(), key=lambda r: r.turn):
        got.setdefault(r.group, []).append(r.item)
    by, held, want = {}, {}, {}
    for r in items.collect():
        by.setdefault(r.group, []).append((r.item, r.level, r.place, r.own))
    for r in keys.collect():
        held.setdefault(r.item, set()).add(r.key)
    for r in sorted(wanted.collect(), key=lambda r: r.place):
        want.setdefault(r.group, []).append(r.key)
    assert got == {g: plain_selection(rows, held, list(dict.fromkeys(want.get(g, []))), 6) for g, rows in by.items()}
