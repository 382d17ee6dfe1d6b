"""Similarity of entities by shared features: set pairs from a grid of blocks, scores from joins on common features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from .lineage import parts_for, settle


#: Feature entries of one block of sets, and sets of one; two blocks are what a task holds at once.
BLOCK_ENTRIES, BLOCK_SETS = 4_000_000, 16_384


def _compared(at_least: float, entity: DataType) -> Callable[[tuple, pa.Table], pa.Table]:
    """One cell of the grid: all sets of its block ``lo`` against those of ``hi``. Sets are taken in order of size, a strip of one
    side at a time against those of the other that are large enough; features that many of both have are counted by a matrix
    product, the others by their pairs of sets. The function holds all it needs, as tasks get it by value."""
    out = pa.schema([("a", to_arrow_type(entity)), ("b", to_arrow_type(entity)), ("shared", pa.int64()), ("jaccard", pa.float64())])

    def counted(x, c, rows: int, y, d, columns: int, features: int):
        """Features shared by each of ``rows`` and ``columns`` sets: entries (x, c) and, in order of features, (y, d)."""
        na, nb = np.bincount(c, minlength=features), np.bincount(d, minlength=features)
        dense = na * nb > max(rows * columns // 100, 64)
        shared = np.zeros((rows, columns), np.float32)
        often = np.flatnonzero(dense)
        number = np.full(features, -1)
        number[often] = np.arange(len(often))
        cx, dy = (number[c], number[d]) if features else (c, d)
        for low in range(0, len(often), 512):
            left, right = np.zeros((rows, 512), np.float32), np.zeros((512, columns), np.float32)
            m, n = (cx >= low) & (cx < low + 512), (dy >= low) & (dy < low + 512)
            left[x[m], cx[m] - low] = 1
            right[dy[n] - low, y[n]] = 1
            shared += left @ right
        seldom = (cx < 0) & (nb[c] > 0) if features else np.zeros(0, bool)
        x, c = x[seldom], c[seldom]
        starts, met = np.concatenate([[0], np.cumsum(nb)]), np.cumsum(nb[c]) if len(c) else np.empty(0, int)
        at = 0
        while at < len(c):
            # Some millions of pairs at a time; one entry meets at most all columns.
            to = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + 4_000_000, "right")))
            n = nb[c[at:to]]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            cells = np.repeat(x[at:to] * columns, n) + y[np.repeat(starts[c[at:to]], n) + inside]
            shared += np.bincount(cells, minlength=rows * columns).reshape(rows, columns)
            at = to
        return shared

    def side(table: pa.Table, block: int):
        rows = table.filter(pc.equal(table["block"], block)).combine_chunks()
        rows = rows.take(pa.array(np.argsort(rows["n"].to_numpy(), kind="stable")))
        return rows["entity"], rows["n"].to_numpy(), rows["features"].combine_chunks().flatten().to_numpy()

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = (int(k.as_py()) for k in key)
        names, na, fa = side(table, lo)
        others, nb, fb = (names, na, fa) if lo == hi else side(table, hi)
        found: list[pa.Table] = []
        if not len(na) or not len(nb):
            return out.empty_table()
        # Only features of both sides count; they get numbers from 0.
        common = np.unique(fa) if lo == hi else np.intersect1d(fa, fb)
        place = lambda f, n: (np.repeat(np.arange(len(n)), n), np.searchsorted(common, f)) if len(common) else (np.empty(0, int), np.empty(0, int))
        ra, ca = place(fa, na)
        rb, cb = place(fb, nb)
        if lo != hi and len(common):
            ra, ca = (x[common[np.minimum(ca, len(common) - 1)] == fa] for x in (ra, ca))
            rb, cb = (x[common[np.minimum(cb, len(common) - 1)] == fb] for x in (rb, cb))
        ends_a = np.searchsorted(ra, np.arange(len(na) + 1))
        by_feature = np.argsort(cb, kind="stable")
        cb, rb = cb[by_feature], rb[by_feature]
        strip = max(1, 4_000_000 // len(nb))
        for at in range(0, len(na), strip):
            to = min(at + strip, len(na))
            first = int(np.searchsorted(nb, at_least * na[at] - 1e-9))
            last = int(np.searchsorted(nb, na[to - 1] / at_least + 1e-9, "right"))
            if first >= last:
                continue
            x, c = ra[ends_a[at]:ends_a[to]] - at, ca[ends_a[at]:ends_a[to]]
            fits = (rb >= first) & (rb < last)
            y, d = rb[fits] - first, cb[fits]
            shared = counted(x, c, to - at, y, d, last - first, len(common))
            union = na[at:to, None] + nb[None, first:last] - shared
            i, j = np.nonzero((shared > 0) & (shared >= (at_least - 1e-12) * union - 1e-6))
            if lo == hi:
                once = i + at < j + first
                i, j = i[once], j[once]
            k = shared[i, j].astype(np.int64)
            value = k / union[i, j]
            good = value >= at_least - 1e-12
            i, j = i[good], j[good]
            found.append(pa.table([names.take(pa.array(i + at)), others.take(pa.array(j + first)), pa.array(k[good]), pa.array(value[good])], schema=out))
        return pa.concat_tables(found) if found else out.empty_table()

    return compare


def _blocks(sizes: list[tuple[int, int]], at_least: float, block_entries: int, block_sets: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, list[int]]]]:
    """(size, first block, blocks) of each (size, sets), and (block, blocks that it meets): blocks of rising sizes and bounded entries and sets,
    which meet where the smallest sets of one can have the Jaccard with the largest of the other."""
    # A small input is still dealt to several tasks.
    block_sets = min(block_sets, max(256, -(-sum(c for _, c in sizes) // 6)))
    placed, bounds, room, left = [], [], 0, 0
    for n, count in sizes:
        parts = max(-(-count * n // block_entries), -(-count // block_sets))
        if parts == 1 and bounds and count * n <= room and count <= left:
            bounds[-1][1] = n
            placed.append((n, len(bounds) - 1, 1))
        else:
            placed.append((n, len(bounds), parts))
            bounds += [[n, n] for _ in range(parts)]
            room, left = (block_entries, block_sets) if parts == 1 else (count * n, count)  # a size that is cut shares no block
        room, left = room - count * n, left - count
    meets = lambda x, y: min(x[1], y[1]) >= at_least * max(x[0], y[0]) - 1e-9
    return placed, [(i, [j for j, y in enumerate(bounds) if meets(x, y)]) for i, x in enumerate(bounds)]


def jaccard_pairs(features: DataFrame, at_least: float, block_entries: int = BLOCK_ENTRIES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(a, b, shared, jaccard), a < b, of all entities of (entity, feature) with a Jaccard of ``at_least``, which is above 0.

    The sets, with numbers for their features, are dealt to blocks of bounded size in the order of their sizes, and each pair of blocks whose
    sizes allow the Jaccard is compared in one task: no pair that fails, and no set for each of its pairs, is ever shuffled. Each set goes to as
    many tasks as there are such blocks, so the work stays quadratic in the sets of like size but what moves is the sets times these blocks.
    """
    rows = settle(features.where("entity is not null and feature is not null").select("entity", "feature").distinct(), "features")
    # Numbers are settled, as they depend on the run; they have no gaps but between tasks.
    numbers = settle(rows.select("feature").distinct().withColumn("id", F.monotonically_increasing_id()), "numbers")
    within = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    each = (numbers.agg(F.max(within)).first()[0] or 0) + 1
    numbers = numbers.select("feature", (F.shiftright("id", 33) * each + within).cast("int").alias("f"))
    sets = settle(rows.join(numbers.hint("merge"), "feature").groupBy("entity").agg(F.array_sort(F.collect_list("f")).alias("features")).withColumn("n", F.size("features")), "sets")
    sizes = sorted((r.n, r.sets) for r in sets.groupBy("n").agg(F.count("*").alias("sets")).collect())  # a row for each size, fewer than the square root of twice the entries
    placed, partners = _blocks(sizes, at_least, block_entries, block_sets)
    spark = sets.sparkSession
    place = F.broadcast(spark.createDataFrame(placed, "n int, first int, parts int"))
    meets = F.broadcast(spark.createDataFrame(partners, "block int, partners array<int>"))
    dealt = sets.join(place, "n").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("entity"), F.col("parts"))).cast("int")).join(meets, "block")
    dealt = settle(dealt.select("block", "entity", "n", "features", "partners"), "blocks")
    cells = dealt.select("block", "entity", "n", "features", F.explode("partners").alias("with")).select(F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "entity", "n", "features")
    kind = sets.schema["entity"].dataType
    schema = StructType().add("a", kind).add("b", kind).add("shared", "long").add("jaccard", "double")
    found = cells.groupBy("lo", "hi").applyInArrow(_compared(at_least, kind), schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "jaccard")


def weighted_neighbours(profiles: DataFrame, weights: DataFrame, asking: DataFrame, annotations: DataFrame) -> DataFrame:
    """(entity, other, score, exact, features): weight of shared terms over weight of all terms, for the entities of ``asking``.

    ``exact`` is the Jaccard of their own ``annotations``; ``features`` are the five weightiest shared terms. Terms that every entity has
    weigh nothing and make no neighbours. The asking entities' terms are few and meet all entities' terms in one join.
    """
    rows = profiles.select("entity", "term").join(weights.where("ic > 0").select("term", "ic"), "term")
    whole = rows.groupBy("entity").agg(F.sum("ic").alias("whole"))
    mine = rows.join(asking, "entity", "left_semi")
    shared = mine.join(rows.select(F.col("entity").alias("other"), "term"), "term").where("entity <> other")
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("ic")).alias("w"), "term"))), 1, 5), lambda x: x["term"])
    met = shared.groupBy("entity", "other").agg(F.sum("ic").alias("shared"), best.alias("features"))
    own = annotations.select("entity", "term").distinct()
    sizes = own.groupBy("entity").agg(F.count("*").alias("n"))
    same = own.join(asking, "entity", "left_semi").join(own.toDF("other", "term"), "term").groupBy("entity", "other").agg(F.count("*").alias("both"))
    found = (
        met.join(whole, "entity").join(whole.toDF("other", "other_whole"), "other").join(same, ["entity", "other"], "left").na.fill(0, ["both"])
        .join(sizes, "entity").join(sizes.toDF("other", "other_n"), "other")
    )
    return found.select(
        "entity", "other", (F.col("shared") / (F.col("whole") + F.col("other_whole") - F.col("shared"))).alias("score"),
        (F.col("both") / (F.col("n") + F.col("other_n") - F.col("both"))).alias("exact"), "features",
    )


def trio_similarity(features: DataFrame, anchor: DataFrame) -> DataFrame:
    """0.45, 0.35 and 0.20 of the Jaccards of kinds pathway, phenotype and gene against ``anchor`` (entity).

    ``features``: (entity, kind, feature). Entities without an overlap are left out.
    """
    features = features.distinct()
    sizes = features.groupBy("entity", "kind").agg(F.count("*").alias("n"))
    mine = features.join(anchor, "entity", "left_semi").select(F.col("entity").alias("anchor"), "kind", "feature")
    shared = mine.join(features, ["kind", "feature"]).where("entity <> anchor").groupBy("anchor", "entity", "kind").agg(F.count("*").alias("shared"))
    mine_sizes = sizes.select(F.col("entity").alias("anchor"), "kind", F.col("n").alias("na"))
    part = shared.join(sizes, ["entity", "kind"]).join(mine_sizes, ["anchor", "kind"])
    part = part.withColumn("jaccard", F.col("shared") / (F.col("n") + F.col("na") - F.col("shared")))
    value = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("jaccard"))), F.lit(0.0))
    wide = part.groupBy("anchor", "entity").agg(value("pathway").alias("pathway"), value("phenotype").alias("phenotype"), value("gene").alias("gene"))
    score = 0.45 * F.col("pathway") + 0.35 * F.col("phenotype") + 0.20 * F.col("gene")
    medium = ((F.col("phenotype") > 0) & (F.col("raw") >= 0.2)) | (F.col("raw") >= 0.25)
    # The confidence looks at the score before rounding.
    return wide.withColumn("raw", score).select(
        "anchor", "entity", F.round("raw", 4).alias("score"), F.when(medium, "medium").otherwise("low").alias("confidence"), "pathway", "phenotype", "gene",
    )


def directed_similarity(annotations: DataFrame, propagated: DataFrame, weights: DataFrame, closed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, value): for each pair how well b's propagated terms explain a's, by ic of the best shared ancestor."""
    up = closed.select(F.col("descendant").alias("term"), F.col("ancestor"))
    weight = weights.select(F.col("term").alias("ancestor"), "ic")
    climbed = annotations.join(up, "term").join(weight, "ancestor").select(F.col("entity").alias("a"), "term", "freq", "ancestor", "ic")
    theirs = propagated.select(F.col("entity").alias("b"), F.col("term").alias("ancestor"))
    best = pairs.join(climbed, "a").join(theirs, ["b", "ancestor"]).groupBy("a", "b", "term", "freq").agg(F.max("ic").alias("best"))
    return best.groupBy("a", "b").agg(F.sum(F.col("best") * (F.lit(0.4) + F.lit(0.6) * F.col("freq"))).alias("value"))


def symmetric_similarity(annotations: DataFrame, propagated: DataFrame, weights: DataFrame, closed: DataFrame, focus: str, fewest: int = 3, least: float = 0.25) -> DataFrame:
    """(a, b, similarity): ``focus`` against all entities; the root of the product of how well each explains the other, over how well
    each explains itself. Entities with fewer than ``fewest`` terms and similarities below ``least`` are left out.

    ``propagated`` are all of ``annotations`` carried up ``closed``. Only the focus's few terms are brought to other entities' rows."""
    n = parts_for(annotations.count())
    climbs = closed.select(F.col("descendant").alias("term"), "ancestor").join(weights.select(F.col("term").alias("ancestor"), "ic"), "ancestor")
    focused = settle(propagated.where(F.col("entity") == focus).select(F.col("term").alias("ancestor"), F.lit(True).alias("held")).distinct(), "focus")
    # How well a term is explained by its own entity, which holds all its ancestors, and by the focus, is the same for all entities with it.
    best = climbs.join(focused, "ancestor", "left").groupBy("term").agg(F.max("ic").alias("best_own"), F.max(F.when(F.col("held"), F.col("ic"))).alias("best_back"))
    rows = annotations.select("entity", "term", "freq").join(best, "term", "left").repartition(n, "entity").groupBy("entity", "term", "freq").agg(F.count("*").alias("n"), F.first("best_own").alias("best_own"), F.first("best_back").alias("best_back"))
    told = lambda c: F.sum(F.col(c) * (F.lit(0.4) + F.lit(0.6) * F.col("freq")))
    least_value = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(1e-9)))
    v = rows.groupBy("entity").agg(F.sum("n").alias("n"), least_value(told("best_own")).alias("own"), least_value(told("best_back")).alias("back")).where(F.col("n") >= fewest).drop("n")
    v = settle(v, "directed")

    mine = annotations.where(F.col("entity") == focus).select("term", "freq").distinct().join(climbs, "term").select("term", "freq", "ancestor", "ic")
    mine = settle(mine, "climbs")
    near = propagated.select(F.col("entity").alias("b"), F.col("term").alias("ancestor")).join(F.broadcast(mine.select("ancestor").distinct()), "ancestor", "left_semi").repartition(n, "b")
    there = near.join(F.broadcast(mine), "ancestor").groupBy("b", "term", "freq").agg(F.max("ic").alias("best")).groupBy("b").agg(least_value(told("best")).alias("value"))
    alone = v.where(F.col("entity") == focus).select(F.col("entity").alias("a"), F.col("own").alias("own_a"))
    both = there.where(F.col("b") != focus).join(v.toDF("b", "own_b", "back"), "b").join(F.broadcast(alone))
    found = both.select("a", "b", F.sqrt(F.col("value") / F.col("own_a") * (F.col("back") / F.col("own_b"))).alias("similarity"))
    return found.where(F.col("similarity") >= least)
