"""Quality classifier: perplexity under interpolated modified Kneser-Ney models of trusted text, one for each language.

The models count runs of four code points. Tasks count their own texts' runs, a shuffle adds them up, and every lower
order follows from the one above by continuation counts. Discounts, back-off weights and probabilities are windows and
joins over these count tables, which are as large as the trusted text makes them and are never gathered in one place.

The log probability of a document is a sum of one number for each run of one to four code points in it::

    log p(text) = symbols * log p(unknown) + sum over runs g of value(g)
    value(g) = log P(g) - log back(context of g) - log P(g without its first symbol) + log back(g as a context)

where a run that trusted text does not hold has the value 0. So scoring is a join of each document's counted runs with
the sharded table of values, and a sum. The most frequent run of each slot of a table of fixed size is looked up
where the text is read; all others go through the join, less those that a filter of fixed size shows to be
in no model. Neither changes a result.

A document is kept when its perplexity lies within quantiles of those of its language's trusted documents: junk is above
them, endless repetition below. For the quantiles trusted documents are scored by a model of the half of the trusted
documents that they are not in, as a model flatters the texts that it was trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, materialise, semi_join_checked, table

ORDER = 4  # 3 at least, and 6 at most
BITS = 21  # of a symbol: a code point and one, so that 0 is no symbol
MASK = (1 << BITS) - 1
START, END = 0x110001, 0x110002
GRAM = ["hi", "lo"]  # a run's symbols: the last three in lo, those before in hi
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Joins with a row for each model are broadcast up to so many models.
MOST_MODELS = 10_000


def symbols(text: bytes) -> np.ndarray:
    """The text's symbols between those of its start and its end; bytes that are no UTF-8 count as one replacement."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64) + 1
    return np.concatenate([np.full(ORDER - 1, START), points, [END]])


def _mixed(x: np.ndarray) -> np.ndarray:
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_MIXED = _mixed(np.arange(END + 1))


def run_keys(s: np.ndarray, salt: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """For each order the keys of the runs that end at each symbol of ``s``; the first ones of a text are not whole."""
    mixed, total = _MIXED.take(s), np.zeros(len(s), np.uint64)
    for m in range(ORDER):
        total[m:] += mixed[: len(s) - m] * _ODD[m]
        yield total ^ salt


def gram_keys(hi: np.ndarray, lo: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The same keys for packed runs."""
    total = np.zeros(len(lo), np.uint64)
    for m in range(ORDER):
        s = (lo >> BITS * m if m < 3 else hi >> BITS * (m - 3)) & MASK
        total += np.where(s > 0, _mixed(s) * _ODD[m], np.uint64(0))
    return total ^ model.view(np.uint64)


def count_runs(texts: DataFrame) -> DataFrame:
    """(model, hi, lo, n) over all ``texts`` (text, model); each task sends a run of some thousand texts once."""

    def counted(model: int, pieces: list[np.ndarray]) -> pa.RecordBatch:
        s = np.concatenate(pieces).astype(np.int64)
        back = lambda m: s[ORDER - 1 - m : len(s) - m]
        lo = back(0) | back(1) << BITS | back(2) << 2 * BITS
        hi = sum((back(m) << BITS * (m - 3) for m in range(3, ORDER)), np.zeros_like(lo))
        whole = s[ORDER - 1 :] != START  # runs do not cross from one text into the next
        *_, keys = run_keys(s, np.uint64(0))
        order = np.argsort(keys[ORDER - 1 :][whole])
        hi, lo = hi[whole][order], lo[whole][order]
        first = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
        n = np.diff(np.append(first, len(lo)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), model)), pa.array(hi[first]), pa.array(lo[first]), pa.array(n)], names=["model", *GRAM, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}
        for batch in by_bytes(batches, 0):
            for text, model in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if data := text.as_py():
                    held.setdefault(model, []).append(symbols(data).astype(np.int32))
                    size[model] = size.get(model, 0) + len(held[model][-1])
                    if size[model] > 1 << 19 or sum(size.values()) > 1 << 22:
                        model = max(size, key=size.get)
                        yield counted(model, held.pop(model))
                        del size[model]
        for model, pieces in held.items():
            yield counted(model, pieces)

    rows = texts.select(F.col("text").cast("binary").alias("text"), "model")
    return rows.mapInArrow(run, "model long, hi long, lo long, n long").groupBy("model", *GRAM).agg(F.sum("n").alias("n"))


def shorter(order: int) -> tuple[Column, Column]:
    """A run of the order without its first symbol."""
    keep = order - 1
    hi = F.col("hi").bitwiseAND(F.lit((1 << BITS * max(0, keep - 3)) - 1))
    return hi.alias("hi"), F.col("lo").bitwiseAND(F.lit((1 << BITS * min(3, keep)) - 1)).alias("lo")


def context() -> tuple[Column, Column]:
    """A run without its last symbol."""
    low = F.shiftright("lo", BITS).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(F.lit(MASK)), 2 * BITS))
    return F.shiftright("hi", BITS).alias("chi"), low.alias("clo")


def discounts(counts: DataFrame) -> DataFrame:
    """(model, d1, d2, d3): discounts of counts 1, 2 and 3 or more, from the counts of counts (Chen and Goodman, 1998)."""
    n = counts.groupBy("model").agg(*(F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)))
    y = F.col("n1") / (F.col("n1") + 2.0 * F.col("n2"))
    enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    one = lambda i, least: F.when(enough, F.least(F.greatest(i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}"), F.lit(0.1)), F.lit(float(i)))).otherwise(least).alias(f"d{i}")
    return n.select("model", one(1, 0.5), one(2, 0.75), one(3, 0.75))


class Models(NamedTuple):
    """``values``: (model, hi, lo, value, weight) of the runs and contexts of all models; ``unknown``: (model, unknown), the log
    probability of a symbol that a model has not seen; ``chances``: for each order (model, hi, lo, p)."""

    values: DataFrame
    unknown: DataFrame
    chances: list[DataFrame]


def fit(counts: DataFrame, few: bool = True) -> Models:
    """Models from counts (model, hi, lo, n) of runs of ORDER symbols. With ``few`` models their constants are broadcast."""
    per_model = (lambda df: F.broadcast(df)) if few else (lambda df: df.hint("merge"))
    levels = [materialise(counts.withColumn("weight", F.col("n")), "runs")]
    for order in range(ORDER, 1, -1):
        lower = levels[0].select("model", *shorter(order), "weight").groupBy("model", *GRAM)
        levels.insert(0, materialise(lower.agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "runs"))
    rows, below, chances, unknown = [], None, [], None
    for level in levels:
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        # A context has at most as many rows as there are symbols.
        own = Window.partitionBy("model", "chi", "clo")
        made = (
            level.join(per_model(discounts(level)), "model").withColumn("taken", taken).select("model", *GRAM, *context(), "n", "taken", "weight")
            .withColumn("total", F.sum("n").over(own)).withColumn("back", F.sum("taken").over(own) / F.col("total"))
            .withColumn("share", (F.col("n") - F.col("taken")) / F.col("total"))
        )
        if below is None:
            # One symbol more than were seen stands for all unknown ones.
            made = made.withColumn("low", F.lit(1.0) / (F.count("*").over(own) + 1))
        else:
            low = below.select("model", F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("low"))
            made = made.withColumns(dict(zip(("shi", "slo"), shorter(len(chances) + 1), strict=True))).join(low.hint("merge"), ["model", "shi", "slo"])
        kept = ["model", *GRAM, "chi", "clo", "back", "low", "weight"]
        below = materialise(made.select(*kept, (F.col("share") + F.col("back") * F.col("low")).alias("p")), "chances")
        if unknown is None:
            unseen = F.ln("back") + F.ln("low")
            unknown = below.groupBy("model").agg(F.first(unseen).alias("unknown"))
            gain = F.ln("p") - unseen
        else:
            gain = F.ln("p") - F.ln("back") - F.ln("low")
            contexts = below.groupBy("model", F.col("chi").alias("hi"), F.col("clo").alias("lo")).agg(F.ln(F.first("back")).alias("value"), F.sum("weight").alias("weight"))
            rows.append(contexts)
        rows.append(below.select("model", *GRAM, gain.alias("value"), "weight"))
        chances.append(below.select("model", *GRAM, "p"))
    values = rows[0]
    for more in rows[1:]:
        values = values.unionByName(more)
    return Models(values.groupBy("model", *GRAM).agg(F.sum("value").alias("value"), F.max("weight").alias("weight")), materialise(unknown, "unknown"), chances)


class Lookup(NamedTuple):
    """Values of the most frequent run of each slot, and a bit for each run that is in no slot."""

    keys: np.ndarray
    values: np.ndarray
    others: np.ndarray


def shard_values(models: Models, slots: int, filter_bits: int) -> tuple[Lookup, DataFrame]:
    """The lookup, of ``slots`` values and ``filter_bits`` bits (powers of two) whatever the models' size, and (key, value) of all other runs."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, hi, lo = (batch.column(c).to_numpy() for c in range(3))
            keys = gram_keys(hi, lo, model).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(3).cast(pa.float32()), batch.column(4)], names=["key", "value", "weight"])

    keyed = models.values.select("model", *GRAM, "value", "weight").mapInArrow(key, "key long, value float, weight long")
    slot = Window.partitionBy("slot").orderBy(F.desc("weight"), "key")
    ranked = keyed.withColumn("slot", F.col("key").bitwiseAND(F.lit(slots - 1))).withColumn("place", F.row_number().over(slot))
    ranked = materialise(ranked.select("key", "value", (F.col("place") == 1).alias("hot")), "values")
    hot = ranked.where("hot").select("key", "value").toArrow()  # at most ``slots`` rows
    keys, values = np.zeros(slots, np.uint64), np.zeros(slots, np.float32)
    found = hot.column("key").to_numpy().view(np.uint64)
    at = found & np.uint64(slots - 1)
    keys[at], values[at] = found, hot.column("value").to_numpy()
    cold = ranked.where("not hot").select("key", "value")
    bit = F.shiftright("key", 20).bitwiseAND(F.lit(filter_bits - 1))
    words = cold.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(key, 20) & {min(63, filter_bits - 1)} as int))")).alias("bits")).toArrow()
    others = np.zeros(max(1, filter_bits >> 6), np.uint64)  # at most filter_bits / 64 rows
    others[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Lookup(keys, values, others), cold


def score(texts: DataFrame, models: Models, slots: int = 1 << 20, filter_bits: int = 1 << 26, few: bool = True) -> DataFrame:
    """(the columns of ``texts`` but text, cost): the mean negative log probability of a symbol of each row's whole text.

    ``texts`` (text, model, ...). Null and empty texts, and those whose model does not exist, have a null cost.
    """
    lookup, cold = shard_values(models, slots, filter_bits)
    shared = texts.sparkSession.sparkContext.broadcast(lookup)
    carried = [c for c in texts.columns if c not in ("text", "model")]
    rows = texts.select(F.col("text").cast("binary").alias("text"), "model", *carried)

    def piece(texts: list[bytes | None], model: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        hot = shared.value
        parts = [symbols(t) if t else np.zeros(0, np.int64) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        full, local = np.flatnonzero(sizes), np.zeros(len(parts))
        if not len(full):
            nothing = [pa.array([[]] * len(parts), pa.list_(t)) for t in (pa.int64(), pa.int32())]
            return sizes, local, *nothing
        s, begins = np.concatenate(parts), (np.cumsum(sizes) - sizes)[full]
        salt = np.repeat(model.view(np.uint64), sizes)
        # Runs end at each symbol of the text and at its end; at the last symbol before the text they are contexts only.
        within = s != START
        before = within.copy()
        before[begins + ORDER - 2] = True
        met = []
        for m, keys in enumerate(run_keys(s, salt)):
            slot = (keys & np.uint64(len(hot.keys) - 1)).view(np.int64)
            hit = hot.keys.take(slot) == keys
            ends = before if m < ORDER - 1 else within
            local[full] += np.add.reduceat(hot.values.take(slot) * (hit & ends), begins, dtype=np.float64)
            at = np.flatnonzero(ends & ~hit)
            bit = (keys[at] >> np.uint64(20)) & np.uint64(64 * len(hot.others) - 1)
            at = at[(hot.others.take((bit >> np.uint64(6)).view(np.int64)) >> (bit & np.uint64(63))) & np.uint64(1) > 0]
            met.append((at, keys[at]))
        at, keys = (np.concatenate(x) for x in zip(*met, strict=True))
        own = full[np.searchsorted(begins, at, side="right") - 1]
        order = np.lexsort((keys, own))
        own, keys = own[order], keys[order]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (keys[1:] != keys[:-1]))) if len(own) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(own)))
        bounds = pa.array(np.searchsorted(own[first], np.arange(len(parts) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (keys[first].view(np.int64), n.astype(np.int32))]
        return np.maximum(sizes - (ORDER - 1), 0), local, *lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        for batch in by_bytes(batches, 0, 1 << 18):
            columns = piece(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            ids = pa.array(np.arange(made, made + batch.num_rows))
            made += batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0]), pa.array(columns[1]), *columns[2:], *batch.columns[1:]], names=["row", "symbols", "local", "keys", "counts", "model", *carried])

    fields = "row long, symbols long, local double, keys array<long>, counts array<int>, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    local = materialise(rows.mapInArrow(run, fields), "local")
    met = local.where(F.size("keys") > 0).select("row", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
    # Spark sizes an explode as if each list held one run, so it would broadcast what may be the largest table of all.
    joined = met.hint("merge").join(cold, "key").groupBy("row").agg(F.sum(F.col("value") * F.col("n")).alias("more"))
    known = F.broadcast(models.unknown) if few else models.unknown.hint("merge")
    total = F.col("symbols") * F.col("unknown") + F.col("local") + F.coalesce("more", F.lit(0.0))
    found = local.drop("keys", "counts").join(joined, "row", "left").join(known, "model", "left")
    return found.select(*carried, F.when(F.col("symbols") > 1, -total / F.col("symbols")).alias("cost"))


def _number(fold: Column, lang: Column) -> Column:
    """Number of the model of a half (0 or 1) or of all (2) trusted texts of a language; null: of all languages."""
    return F.xxhash64(fold.cast("int"), F.coalesce(lang, F.lit("\0")))


def _digest(docs: DataFrame) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(docs["lang"], F.lit("")), F.lit("\0"), F.coalesce(docs["text"], F.lit("")))))


def judge_quality(docs: DataFrame, trusted: DataFrame, low: float = 0.0, high: float = 0.995, slots: int = 1 << 20, filter_bits: int = 1 << 26) -> DataFrame:
    """(doc_id, lang, digest, perplexity, lowest, highest, keep) of every row of ``docs``; ``digest`` is that of lang and text.

    ``trusted``: doc_id of trusted documents; a null one counts for none. A null language is the language ''. Languages
    without trusted documents are judged by a model of all trusted ones and its quantiles; without any trusted text
    nothing can be judged and all are kept. Null and empty texts have no perplexity and are not kept; rows with a null
    doc_id are judged like others; repeated rows are judged each and alike; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text", _digest(docs).alias("digest"))
    full = F.coalesce(F.octet_length("text") > 0, F.lit(False))
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")  # copies of a text are in one half
    known = semi_join_checked(docs, trusted, "doc_id").where(full).withColumn("half", half)
    langs = materialise(known.groupBy("lang").agg(*(F.max((F.col("half") == i).cast("int")).alias(f"has{i}") for i in (0, 1))), "langs")
    n = langs.count()
    few = n <= MOST_MODELS
    near = F.broadcast if few else (lambda df: df.hint("merge"))
    if not n:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", "lang", "digest", nothing.alias("perplexity"), nothing.alias("lowest"), nothing.alias("highest"), full.alias("keep"))
    strange = not docs.where(full).select("lang").distinct().join(near(langs), "lang", "left_anti").isEmpty()

    texts = known.select("text", "half", F.col("lang").alias("own"))
    owners = langs.select(F.col("lang").alias("own"), "has0", "has1")
    if strange:  # the model of all languages is needed
        nobody = F.lit(None).cast("string").alias("own")
        texts = texts.unionByName(texts.withColumn("own", nobody))
        owners = owners.unionByName(owners.agg(F.max("has0").alias("has0"), F.max("has1").alias("has1")).select(nobody, "has0", "has1"))
    counts = materialise(count_runs(texts.select("text", _number(F.col("half"), F.col("own")).alias("model"))), "halves")
    numbers = owners.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("half"), "own").select(_number(F.col("half"), F.col("own")).alias("model"), _number(F.lit(2), F.col("own")).alias("whole"))
    together = counts.join(near(numbers), "model").groupBy(F.col("whole").alias("model"), *GRAM).agg(F.sum("n").alias("n"))
    models = fit(counts.unionByName(together), few)

    # A trusted document is scored by the other half's model, as if it were new, and any other one by the whole one.
    ids = materialise(trusted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True)), "trusted")
    placed = docs.join(ids.hint("broadcast" if ids.count() <= 1_000_000 else "merge"), "doc_id", "left").na.fill(False, ["trusted"])
    placed = placed.join(near(langs.select("lang", F.col("lang").alias("own"))), "lang", "left").withColumn("asked", F.lit(True))
    if strange:
        placed = placed.unionByName(placed.where("trusted").withColumn("own", nobody).withColumn("asked", F.lit(False)))
    placed = placed.join(near(owners.toDF("mine", "has0", "has1")), F.col("own").eqNullSafe(F.col("mine")))
    other = F.when(half == 0, F.when(F.col("has1") == 1, 1)).when(F.col("has0") == 1, 0)
    fold = F.coalesce(F.when(F.col("trusted"), other), F.lit(2))
    rows = placed.select("doc_id", "lang", "digest", "own", "trusted", "asked", "text", _number(fold, F.col("own")).alias("model"))
    costs = materialise(score(rows, models, slots, filter_bits, few), "costs")
    sample = costs.where("trusted and cost is not null").where(F.col("own").isNull() | F.col("asked"))
    at = F.percentile_approx("cost", F.array(F.lit(low), F.lit(high)), 10_000)
    limits = near(materialise(sample.groupBy(F.col("own").alias("mine")).agg(at.alias("at")).select("mine", F.get("at", 0).alias("low"), F.get("at", 1).alias("high")), "limits"))
    return costs.where("asked").join(limits, F.col("own").eqNullSafe(F.col("mine")), "left").select(
        "doc_id", "lang", "digest", F.exp("cost").alias("perplexity"), F.exp("low").alias("lowest"), F.exp("high").alias("highest"),
        F.coalesce(F.col("cost").between(F.col("low"), F.col("high")), F.lit(False)).alias("keep"),
    )


def trusted_documents(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def keep_quality(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects.

    The digests of rejected rows decide, so that few are joined: rows of one text and language go or stay together, whatever
    their ids. Without a rejected row all stay.
    """
    judged = judge_quality(docs, trusted)
    rejected = materialise(judged.where("not keep").select("digest").distinct(), "rejected")
    hint = "broadcast" if rejected.count() <= 300_000 else "merge"
    return docs.join(rejected.hint(hint).withColumnRenamed("digest", "_digest"), _digest(docs) == F.col("_digest"), "left_anti").select(docs.columns)


def op7_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_quality(table(spark, sf_dir, "documents"), trusted_documents(table(spark, sf_dir, "labels")))
    return found.select("doc_id", "lang", "perplexity", "lowest", "highest", "keep")
