"""WARC archives, conversation repair and collocations: SQL, round trips, brute force, and the edge cases of each."""

import gzip
import hashlib
import heapq
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ontoweave.llm import collocations, queries, turn_repair, warc

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_threshold_topk", "op4_chat_format", "op8_source_mixing", "op9_url_reputation", "op11_warc", "op13_collocations"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in order)) for r in want.fetchall())


# -- archives

PAGES = "page_id long, url string, html string, payload string, record_id long, row int"


def pages(spark):
    big = "<p>ü" * 40
    rows = [
        (5, "http://a/ x\r\ny%20", big), (2, None, big), (2, "http://b/", big), (None, "http://c/", big), (7, "http://d/", None), (8, "http://d/", ""), (9, "é ", "short"), (10, "http://e/", "short"),
        (11, "http://f/", "WARC/1.1\r\n\r\n" * 3000), (12, "http://g/", "a\x00b" + "\r\n" * 60),
    ]
    return spark.createDataFrame([(*r, "x", 1, 1) for r in rows], PAGES)


def told(df):
    return sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most_broadcast", [100_000, 0])
def test_archive_records(spark, most_broadcast):
    got = warc.archive_records(pages(spark), most_broadcast=most_broadcast)
    big = len(("<p>ü" * 40).encode())
    kinds = Counter(t for t in told(got) if t[3] == big)
    assert kinds == Counter({(2, "response", None, big): 1, (2, "revisit", "urn:page:2", big): 1, (5, "revisit", "urn:page:2", big): 1, (None, "revisit", "urn:page:2", big): 1})
    assert {t[1] for t in told(got) if t[3] < 100} == {"response"}
    assert warc.archive_records(pages(spark).limit(0)).count() == 0


def test_archive_round_trip(spark, tmp_path):
    made, path = warc.archive_records(pages(spark)), f"file:{tmp_path}/a"
    warc.write_archive(made, path)
    key = lambda r: (r.record_id, r.record_type, repr(r.uri), r.payload_bytes, r.payload_digest, r.refers_to, bytes(r.payload or b""))
    want, got = sorted(map(key, made.collect())), sorted(map(key, warc.read_archive(spark, path).collect()))
    assert got == want
    assert all(hashlib.sha256(r[6]).hexdigest() == r[4] for r in got if r[1] == "response")
    small = warc.read_archive(spark, path, splitBytes="1").select("record_id")
    assert small.count() == len(want)
    # Any gzip reader sees plain concatenated records.
    text = b"".join(gzip.open(f).read() for f in (tmp_path / "a").glob("*.warc.gz"))
    assert text.count(b"WARC-Type: ") == len(want)


def test_archive_scan_pushes_predicates_and_skips_payloads(spark, tmp_path):
    rows = spark.range(0, 400).select(
        F.concat(F.lit("urn:page:"), "id").alias("record_id"), F.when(F.col("id") % 4 == 0, "response").otherwise("metadata").alias("record_type"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload_digest"), F.expr("cast(concat_ws(',', transform(sequence(0, 4000), i -> hash(i, id))) as binary)").alias("payload"),
    ).coalesce(1)
    path = f"{tmp_path}/b"
    warc.write_archive(rows, path)
    (name,) = (f for f in os.listdir(path) if f.endswith(".gz"))
    size = os.path.getsize(f"{path}/{name}")
    scan = warc.read_archive(spark, path, "record_id", "record_type").where("record_type = 'response' and record_id like 'urn:page:1%'")
    assert scan.count() == sum(i % 4 == 0 and str(i).startswith("1") for i in range(400))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan.replace("RuntimeFilters", ""), plan  # every predicate is the source's
    system, file = warc.file_system(f"{path}/{name}")
    with system.open_input_file(file) as f:
        window, at, inflated = warc.Window(f, size, 2048), 0, 0
        while at < size:
            record = warc.Member(window, at, True)
            record.upto(b"\r\n\r\n", 0)
            inflated += len(record.text)
            at = record.end(0)
    assert inflated < 400 * 2100 and window.fetched < size / 2


def test_archive_commits_whole_jobs_only(spark, tmp_path):
    path = f"{tmp_path}/c"
    good = spark.range(0, 50, 1, 4).select(F.col("id").cast("string").alias("record_id"), F.lit("response").alias("record_type"), F.lit(b"x" * 200).alias("payload"))
    warc.write_archive(good, path)
    bad = good.withColumn("record_id", F.when(F.col("record_id") == "49", F.raise_error(F.lit("lost"))).otherwise(F.col("record_id")))
    with pytest.raises(Exception, match="lost"):
        warc.write_archive(bad, path, "overwrite")
    assert warc.read_archive(spark, path, "record_id").count() == 50
    assert len([n for n in os.listdir(path) if n.startswith("_manifest")]) == 1
    warc.write_archive(good.limit(10), path)
    assert warc.read_archive(spark, path, "record_id").count() == 60
    open(f"{path}/stray-00000.warc.gz", "wb").write(b"no record")
    warc.write_archive(good.limit(3), path, "overwrite")
    assert warc.read_archive(spark, path, "record_id").count() == 3
    warc.write_archive(good.limit(0), f"{tmp_path}/d")
    assert warc.read_archive(spark, f"{tmp_path}/d").count() == 0


def test_archives_of_other_makers(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x:%d>\r\nwarc-target-uri: http://a/\r\n  b\r\nContent-Type: text/plain\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    texts = [(b"resource", i, len(t), t) for i, t in enumerate([b"one", b"", b"WARC/1.0\r\n" * 900])]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "plain.warc").write_bytes(b"".join(record % t for t in texts))
    (tmp_path / "e" / "members.warc.gz").write_bytes(b"".join(gzip.compress(record % t) for t in texts))
    got = warc.read_archive(spark, f"{tmp_path}/e").collect()
    assert sorted((r.record_id, bytes(r.payload), r.payload_bytes, r.uri) for r in got) == sorted([(f"urn:x:{i}", t, n, "http://a/ b") for _, i, n, t in texts] * 2)
    (tmp_path / "e" / "members.warc.gz").write_bytes(gzip.compress(record % texts[2])[:-20])
    with pytest.raises(Exception, match="ends early|no end"):
        warc.read_archive(spark, f"{tmp_path}/e").collect()


# -- conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute_force(rows):
    """Cheapest edits by searching all of them, in the order of (cost, audit); ``rows`` are (role, text, fault)."""
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        roles = "".join(r[:1] for r, _ in out)
        if at == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if (at, audit, roles) in seen or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        seen.add((at, audit, roles))
        for name in ("user", "assistant"):
            if len(out) <= len(rows) + 2:
                heapq.heappush(heap, (cost + 5, audit + "I", at, (*out, (name, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*out, (role, text))))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, (*out, (name, text))))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


@pytest.mark.parametrize("seed", range(120))
def test_repair_is_the_cheapest(seed, monkeypatch):
    monkeypatch.setattr(turn_repair, "PIECE", 2)
    rng = random.Random(seed)
    rows = faults([(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " "]), rng.choice(["a.", "b!", "c", "d?", "", "e. "])) for _ in range(rng.randint(0, 5))])
    parser = turn_repair.Parser()
    for role, text, fault in rows:
        parser.row(role.encode(), text.encode(), fault)
        if seed % 2:
            parser.frontier = turn_repair.ranked(parser.frontier)
    cost, audit, text = brute_force(rows)
    assert parser.best() == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
    assert len(parser.frontier) <= 5


def test_a_long_conversation_of_unknown_roles():
    parser = turn_repair.Parser()
    for i in range(20_001):
        parser.row(b"tool", b"t%d." % i, None)
    cost, audit, _ = parser.best()
    assert (cost, audit) == (20_002, "D" + "R" * 20_000)


def test_repair_of_the_table(spark):
    got = {r.conv_id: r for r in queries.QUERIES["op12_turn_repair"](spark, SMALL).collect()}
    table = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    assert set(got) == {r.conv_id for r in table}
    for conv_id, r in got.items():
        mine = []
        for row in sorted((x for x in table if x.conv_id == conv_id), key=lambda x: x.turn):
            kind = zlib.crc32(f"{conv_id}:{row.turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", row.text) if kind == 2 else row.text
            mine += [(row.turn, "user" if kind == 4 else row.role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows, turns = faults([x[1:] for x in mine]), {x[0] for x in mine}
        parser = turn_repair.Parser()
        for role, text, fault in rows:
            parser.row(role.encode(), text.encode(), fault)
        counts = Counter(f for *_, f in rows)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal)
        assert (r.cost, r.audit, r.repaired_sha256) == parser.best()


def test_repair_edges(spark):
    rows = [
        (1, None, None, None), (1, 2, "user", "x."), (1, 2, "assistant", "y."), (1, None, "", "z."), (2, 1, "user", "only"), (3, None, "user", "gone"), (None, None, "user", "a."), (None, 7, "élan", "b."),
        (None, 9, "assistant", "word " * 50_000 + "."),
    ]
    table = spark.createDataFrame([(*r, "f", 1, True) for r in rows], "conv_id long, turn long, role string, text string, fault string, same int, gone boolean")
    got = {r.conv_id: r for r in turn_repair.repair_conversations(table.withColumn("gone", F.coalesce(F.col("conv_id") == 3, F.lit(False)))).collect()}
    assert got[3][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # Sorted: ("", "z.") and (" ", " ") without a turn, then assistant and user of turn 2.
    assert (got[1].gaps, got[1].blank, got[1].illegal, got[1].cost, got[1].audit) == (0, 1, 2, 5, "RDKD")
    assert (got[2].truncated, got[2].cost, got[2].audit) == (1, 2, "D")
    assert (got[None].gaps, got[None].illegal, got[None].cost, got[None].audit) == (1, 2, 2, "KDK")
    assert turn_repair.repair_conversations(table.limit(0)).count() == 0
    damaged = turn_repair.damaged(table.drop("gone", "fault", "same"))
    assert set(damaged.columns) == {"conv_id", "turn", "role", "text", "gone"} and damaged.where("text is null or role is null").count() == 0


# -- collocations

def plain_counts(docs):
    counts = Counter()
    for text, lang in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            counts.update((lang or "und", " ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    return counts


@pytest.mark.parametrize("spacing", [1, 2, 3, 8])
def test_dictionary_counts_every_occurrence_once(spark, spacing):
    rng = random.Random(spacing)
    docs = [(" ".join(rng.choice("a b c D\té , x.y É ; \n".split(" ")) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    docs += [docs[0]] * 5 + [(None, "en"), ("", None), ("  \t. ,", "fr"), ("w " * 5000, "en")]
    table = spark.createDataFrame([(*d, 1, "p") for d in docs], "text string, lang string, words int, phrase string")
    want = plain_counts(docs)
    dictionary = collocations.parse(table, spacing)
    for n in (1, 2, 3):
        got = {(r.lang, bytes(r.gram).decode()): r.f for r in collocations.count_grams(dictionary, n).collect()}
        assert got == {k: v for k, v in want.items() if len(k[1].split(" ")) == n}
    grams, totals = collocations.frequent_grams(table, 4, spacing)
    assert {(r.lang, r.gram): r.f for r in grams.collect()} == {k: v for k, v in want.items() if v >= 4}
    assert {r.lang: r.n for r in totals.collect()} == {lang: sum(v for k, v in want.items() if k[0] == lang and " " not in k[1]) for lang, _ in want}
    top = collocations.collocations(table, least=4, most=3, spacing=spacing).toPandas()
    assert top.groupby("lang")["rank"].max().max() <= 3 and (top["score"] == 10**6 * top.a * top.a // (top.l * top.r)).all()


def test_chunks_repeat_with_passages():
    rng = random.Random(1)
    passage = [b"w%d" % rng.randrange(50) for _ in range(200)]
    texts = [[b"v%d" % rng.randrange(999) for _ in range(rng.randrange(40))] + passage + [b"z"] for _ in range(2)]
    chunks = [collocations.chunks_of([b"\t ".join(t)], 4)[0].to_pylist() for t in texts]
    assert len(set(chunks[0]) & set(chunks[1])) > 25
    for t, c in zip(texts, chunks, strict=True):  # put together again, without their overlaps
        assert [w for x in c[:-1] for w in x.split(b" ")[: -collocations.OVERLAP]] + c[-1].split(b" ") == t


def test_collocation_edges(spark):
    table = spark.createDataFrame([], "doc_id long, text string, lang string, rank int")
    assert collocations.collocations(table).count() == 0
    bits = collocations.bitmap(spark.createDataFrame([(b"a b",), ("é ü".encode(),)], "gram binary"), 2)
    assert sum(bin(b).count("1") for b in bits) == 2
    for gram in (b"a b", "é ü".encode()):
        slot = int(collocations.slots([collocations.np.array([zlib.crc32(w)]) for w in gram.split(b" ")])[0])
        assert bits[slot >> 3] >> (slot & 7) & 1
