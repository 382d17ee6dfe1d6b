"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every dealt operator."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ontoweave.llm import ann, chat, kneser_ney, mixing, packing, sharding, simhash, token_counts, topk, url_reputation

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slice int, fp string, key string, rank int, length int, tokens long"
LONG = "word " * 30_000


def documents(spark):
    rows = [
        (1, "One two three four five six seven.", "en", "src1"), (2, "One two three four five six seven.", "en", "src1"), (2, "One two three four five six seven.", "en", "src1"),
        (3, None, None, None), (None, "Without a number", "en", "x"), (None, None, None, "src2"), (4, "", "", ""), (5, LONG, "de", "src99999999999"),
        (6, "<|endoftext|> é  \n ß\t", "en", "src3"), (7, " ", "fr", "src4"),
    ]
    return spark.createDataFrame([(*r, 9, 9, 9, 9, "f", "k", 9, 9, 9) for r in rows], DOCS)


@pytest.fixture(params=["full", "empty"])
def docs(request, spark):
    found = documents(spark)
    return found if request.param == "full" else found.limit(0)


def test_sharding(docs):
    got = sharding.shard_documents(docs, shards=3, rows_per_slice=1).toPandas()
    assert len(got) == docs.count()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    if len(got):
        assert set(got["size"][got.doc_id.isna()]) == {8 + 16, 8}
        assert ((got.grown_shard == got.shard) | (got.grown_shard == 3)).all()


def test_token_counts(docs):
    got = token_counts.count_tokens(docs, token_counts.default_vocabulary()).toPandas()
    assert len(got) == docs.count()
    if len(got):
        assert got.n_words[got.doc_id == 5].item() == 30_000
        assert got.n_tokens[got.doc_id == 3].item() == 0


def test_simhash(docs):
    got = simhash.simhash_components(docs).toPandas()
    assert len(got) == docs.count()
    if len(got):
        named = got.dropna(subset=["doc_id"]).groupby("doc_id").component_id.first()
        assert named[2] == named[1] == 1
        assert named[3] == named[4] == named[7] == 3  # fingerprint zero links
        assert got.component_id[got.doc_id.isna()].isna().all()


def test_near_duplicates(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    if docs.count():
        assert sorted(x for x in ids if x is not None) == [1, 3, 5, 6]
        assert ids.count(None) == 2


def test_quality(docs, spark):
    trusted = docs.where("doc_id < 3").select("doc_id")
    got = kneser_ney.judge_quality(docs, trusted).toPandas()
    assert len(got) == docs.count()
    if len(got):
        assert got.keep[got.doc_id == 1].all() and not got.keep[got.doc_id == 3].any()
    unjudged = kneser_ney.judge_quality(docs, trusted.limit(0)).toPandas()
    assert unjudged.keep.sum() == sum(bool(r.text) for r in docs.collect())
    assert kneser_ney.keep_quality(docs, trusted).columns == docs.columns


def test_mixing(docs):
    got = mixing.mix(docs, mixing.source_domain(), share=1.0, epochs=1, weights={})
    assert got.count() == docs.count()
    carried = mixing.mix(docs, mixing.source_domain(), share=0.5, epochs=3, weights={}, carry=True)
    assert carried.columns == docs.columns
    assert carried.count() <= 3 * docs.count()


def test_packing(docs):
    got = packing.pack_documents(docs, packing.default_vocabulary(), capacity=64).toPandas()
    if not docs.count():
        assert not len(got)
        return
    assert (got.ids.map(len) == got.length).all()
    assert got.groupby(["sequence_id"]).length.sum().max() <= 64
    assert (got.length[got.doc_id == 3] == 1).all()
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]]


VECTORS = "vec_id long, embedding array<float>, label int, rank int, score long, block long, list int"


def vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [0.0, 0.0]),
        (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, []), (9, [2.0]), (10, [0.0, 0.0, 3.0]), (11, [1e30, 0.0]),
    ]
    return spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], VECTORS)


def test_top_k_edges(spark):
    table = vectors(spark)
    got = topk.top_k_inner(table.where("vec_id in (0, 2, 3)"), table, k=3).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0][["rank", "vec_id", "score"]].values.tolist() == [[1, 11, 2**63 - 1], [2, 9, 2048 * 1024], [3, 1, 512 * 1024]]
    assert set(got.query_id) == {0, 2}
    large = spark.createDataFrame([(0, [1.0, 0.0]), (1, [70000.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.25]), (3, [3e9, -3e9]), (3, [3e9, -3e9])], "vec_id long, embedding array<double>")
    got = topk.top_k_inner(large.where("vec_id in (0, 2)"), large, k=2, block=2).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0][["vec_id", "score"]].values.tolist() == [[3, 3072000000000 * 1024], [1, 71680000 * 1024]]
    # Products of unbounded size decide; what no long holds counts as its limit.
    huge = spark.createDataFrame([(0, [1e-3, -1e300]), (1, [2.0, 1e300]), (2, [1.0, 0.0]), (3, [4.0, 1.0])], "vec_id long, embedding array<double>")
    got = topk.top_k_inner(huge.where("vec_id = 0"), huge, k=3).toPandas().sort_values("rank")
    assert got.vec_id.tolist() == [2, 1, 3] and got.score.tolist() == [1024, -(2**63), -(2**63)]
    # 1024 times a component is beyond the range of a double.
    most = spark.createDataFrame([(0, [1e-300, 0.0]), (1, [1e306, -1e306]), (2, [1.7e308, 0.25]), (3, [-0.5, 0.0])], "vec_id long, embedding array<double>")
    got = topk.top_k_inner(most, most, k=1, block=2).toPandas().set_index("query_id")
    assert got.vec_id.to_dict() == {0: 1, 1: 2, 2: 1, 3: 0} and got.score[1] == 2**63 - 1
    assert topk.top_k_inner(table.limit(0), table, k=3).count() == 0
    assert topk.top_k_inner(table.limit(0), table.limit(0), k=3).count() == 0


def test_nearest_edges(spark):
    table = vectors(spark)
    got = ann.nearest(table.where("vec_id in (0, 3, 6)"), table, k=20).toPandas().sort_values(["query_id", "rank"])
    assert got.vec_id.tolist() == [11, 9, 1, 2, 10] and set(got.query_id) == {0}
    assert ann.nearest(table, table.limit(0), k=3).count() == 0
    assert ann.nearest(table.limit(0), table, k=3).count() == 0


def test_chat_edges(spark):
    turns = [
        (1, 0, "user", "a\\<s>[INST]\\"), (1, 1, "user", None), (1, 2, "assistant", "[TURN]</s>\n[/INST]"), (1, 3, "assistant", ""), (1, 3, "assistant", "é<"),
        (None, None, None, None), (2, 5, "[INST]</s>", "x"), (2, None, "assistant", "first"), (3, 1, "assistant", "s>"), (3, 0, "assistant", "<"),
    ]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, formatted int")
    made = chat.format_conversations(table)
    got = {r.conv_id: r for r in made.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "a\\<s>[INST]\\"), ("user", ""), ("assistant", "[TURN]</s>\n[/INST]"), ("assistant", ""), ("assistant", "é<")]
    assert got[1].loss == "[TURN]</s>\n[/INST]é<"
    assert got[1].formatted.count("</s>") == 2
    assert [tuple(t) for t in got[2].turns] == [("assistant", "first"), ("[INST]</s>", "x")]
    assert [tuple(t) for t in got[None].turns] == [("", "")] and got[None].loss == ""
    assert got[3].loss == "<s>"
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_url_edges(spark):
    urls = [
        (1, "http://A.Example.COM/en/x?y"), (2, "http://www.example.com/en/"), (3, None), (4, "no scheme"), (5, "http://"), (6, "x://b.net/es/#f"), (7, "http://com/"),
        (7, "http://com"), (None, "http://É.net/fr/://z"), (8, "http://evil.org/a"), (9, "http://notcom/"),
    ]
    pages = spark.createDataFrame([(*u, "h", 1) for u in urls], "page_id long, url string, html string, host int")
    labels = spark.createDataFrame([(8, 1), (8, 1), (None, 1), (4, None), (9, 0)], "page_id long, bad int")
    got = url_reputation.judge_urls(pages, labels).toPandas()
    by = {r.page_id: r for r in got.itertuples() if r.page_id != 7}
    assert len(got) == len(urls)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (by[2].rule, by[2].verdict) == ("www.example.com/en/", "allow")
    assert all((by[i].host, by[i].path) == ("", "") for i in (3, 4, 5))
    assert by[6].rule == "net/es/" and by[9].rule is None
    assert sorted(x.rule or "" for x in got.itertuples() if x.page_id == 7) == ["", "com/"]
    assert url_reputation.judge_urls(pages, labels.limit(0)).count() == len(urls)
    assert url_reputation.judge_urls(pages.limit(0), labels).count() == 0


def recall_of(spark, matrix, k=20):
    """Recall of every 20th row's ``k`` nearest, and the least number of rows that a query got."""
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(matrix)), "embedding": matrix.tolist()}), "vec_id long, embedding array<double>")
    got = ann.nearest(table.where("vec_id % 20 = 0"), table, k).toPandas().groupby("query_id").vec_id.agg(list)
    asking = np.arange(0, len(matrix), 20)
    with np.errstate(over="ignore"):
        scores = matrix[asking] @ matrix.T
    scores[np.arange(len(asking)), asking] = -np.inf
    true = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.mean([len(set(t) & set(got[q])) / k for q, t in zip(asking, true, strict=True)]), min(map(len, got))


@pytest.mark.parametrize("kind", ["even", "varied norms", "clusters", "one long row", "one huge row"])
def test_recall_on_other_shapes(spark, kind):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(4000, 16))
    if kind == "varied norms":
        matrix *= np.exp(1.5 * rng.normal(size=(4000, 1)))
    if kind == "clusters":
        matrix = 0.1 * matrix + rng.normal(size=(20, 16))[rng.integers(0, 20, 4000)]
    if kind.startswith("one"):
        matrix[77] = 0
        matrix[77, 0] = 1e4 if kind == "one long row" else 1e200
    recall, least = recall_of(spark, matrix)
    assert recall >= 0.9 and least == 20


def test_samples_are_bounded(spark):
    nulls = spark.range(0, 200_000).select(F.lit(None).cast("long").alias("vec_id"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("embedding"))
    one = spark.range(0, 50_000).select(F.lit(4).cast("long").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    many = spark.range(0, 3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("embedding"))
    table = nulls.unionByName(one).unionByName(many)
    assert ann.draw_sample(nulls, 0, 1000).count() == 0
    assert ann.draw_sample(table, 53_000, 1000).count() <= 2000


def test_weights_of_zero_strand_no_budget(spark):
    rows = [("d0", "en", "x0", 100), ("d0", "de", "x0", 10), ("d1", "de", "x1", 100)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(leaves, 0.5, 1, {"lang": {"en": 0.0}}).collect()}
    assert got == {("d0", "de"): 10, ("d0", "en"): 0, ("d1", "de"): 95}
    got = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(leaves, 1.0, 1, {"domain": {"d1": 0.0}, "source": {"x0": 0.0}}).collect()}
    assert set(got.values()) == {0}


def test_sites(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "shop.x.co.uk:8080": ("x.co.uk", "co.uk"), "me@me.github.io": ("me.github.io", "github.io"), "x.com:8080": ("x.com", "com"), "10.0.0.7:80": ("10.0.0.7", "number"),
             "[::1]:80": ("[::1]", "number"), "localhost": ("localhost", "localhost"), "": ("", ""), "co.uk": ("co.uk", "co.uk"), "u:p@deep.a.org": ("a.org", "org")}
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *url_reputation.site(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == hosts
    # Two owners under one shared suffix do not pool: the good one keeps its good name.
    urls = [(i, f"http://{'bad' if i % 2 else 'good'}.github.io/p{i}", "", 1) for i in range(40)] + [(i, f"http://h{i}.net/", "", 1) for i in range(40, 60)]
    pages = spark.createDataFrame(urls, "page_id long, url string, html string, host int")
    outcomes = spark.createDataFrame([(i, i % 2 if i < 40 else 0) for i in range(60)], "page_id long, bad int")
    rates = {r.host: r.bad_rate for r in url_reputation.judge_urls(pages, outcomes).select("host", "bad_rate").distinct().collect()}
    assert rates["bad.github.io"] > 0.8 and rates["good.github.io"] < 0.2


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_of_texts_are_never_broadcast(spark):
    texts = spark.createDataFrame([(i, "ab cd " * i, 1) for i in range(1, 9)], "id long, text string, model long")
    models = kneser_ney.fit(kneser_ney.count_runs(texts))
    # A list of runs counts as one row when its table is sized, so no size may decide.
    plan = _physical(kneser_ney.score(texts, models, 1 << 4, 1 << 8))
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan


def test_keys_of_cells_are_broadcast_by_count_alone(spark, monkeypatch):
    rows = simhash.materialise(spark.createDataFrame([(n % 3, n % 7, n, bytes([n] * 16)) for n in range(60)], "number int, key long, node long, fp binary"), "rows")
    keyed = rows.mapInArrow(lambda batches: batches, rows.schema)
    few = simhash.cells(keyed, 2)
    monkeypatch.setattr(simhash, "MOST_KEYS", 20)
    many = simhash.cells(keyed, 2)
    assert "BuildRight" in _physical(few) and "BuildLeft" not in _physical(few) and "Broadcast" not in _physical(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.select("node").distinct().count() == 60
