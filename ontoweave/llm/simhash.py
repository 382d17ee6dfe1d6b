"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that may be close share a key; rows of one key stand next to each other and are compared 64 at a time. The
fingerprints of 64 rows are stored vertically, one machine word a bit plane, and a probe adds the planes in which it
differs to carry-save counters that hold 64 distances at once. A block whose 64 distances all exceed the radius is
abandoned. Each task hands on a spanning forest of the links it finds, never all pairs, and components of the links are
found by alternating star contractions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, materialise, semi_join_checked, table

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
LANES = 64
#: Sets of at most so many shingles are compared exactly: the bits of small sets of one similarity differ more often.
SHORT = 32


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; the whole sequence if there are fewer words.

    A-Z are lower-cased and words are separated by space and the bytes 9 to 13.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - k + 1)


def _widen(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hashes themselves, then words mixed from them by a 64-bit finaliser."""
    out = [hashes]
    for i in range(1, words):
        z = hashes + np.uint64(0x9E3779B97F4A7C15 * i % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(hashes: np.ndarray, words: int = 1, at_once: int = 1 << 15) -> bytes:
    """Big-endian fingerprint of ``words`` 64-bit words: a bit is 1 if it is set in over half of the hashes."""
    totals = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), at_once):
        wide = _widen(hashes[i : i + at_once], words).astype(">u8")
        totals += np.unpackbits(wide.view(np.uint8).reshape(len(wide), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * totals > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, k: int, words: int = 1, repeats: bool = True, upto: int = 0) -> DataFrame:
    """(doc_id, fp) of every document's whole text; texts are read where they are, without a shuffle.

    With ``upto`` there is a third column, ``shingles``: the sorted distinct hashes of a text that has at most so many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            made, sets = [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py() or b"", k)
                if not repeats:
                    hashes = np.unique(hashes)
                made.append(fingerprint(hashes, words))
                if upto:
                    some = np.unique(hashes)
                    sets.append(some.tobytes() if len(some) <= upto else None)
            columns = [batch.column(0), pa.array(made, pa.binary()), *[pa.array(sets, pa.binary())] * bool(upto)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "shingles"][: len(columns)])

    fields = "doc_id long, fp binary" + ", shingles binary" * bool(upto)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, fields)


def exact_keys(bits: int, radius: int, rows: int, most: float = 8.0) -> list[list[int]]:
    """Bit positions of each key table such that any two fingerprints within ``radius`` agree on one table at least.

    The bits are cut into radius + m parts, of which m must agree; m grows until a key has at most ``most`` rows on average.
    """
    for m in range(1, bits - radius + 1):
        parts = np.array_split(np.arange(bits), radius + m)
        tables = [np.concatenate(c).tolist() for c in combinations(parts, m)]
        if rows / 2.0 ** min(map(len, tables)) <= most or len(tables) > 1000:
            break
    return tables


def banded_keys(rows: int, flip: float, recall: float, bucket: float = 64.0) -> list[list[int]]:
    """Bands of which two fingerprints agree on one at least with probability ``recall`` when each bit differs with ``flip``.

    A band is as wide as keeps ``bucket`` rows to a key on average; the number of bands, and so of bits, follows.
    """
    width = max(12, math.ceil(math.log2(max(rows, 2) / bucket)))
    bands = math.ceil(math.log(1.0 - recall) / math.log(1.0 - (1.0 - flip) ** width))
    return [list(range(i * width, (i + 1) * width)) for i in range(bands)]


def flip_rate(shared: int, first: int, second: int) -> float:
    """Chance that a fingerprint bit differs between two sets with ``shared`` hashes in common, ``first`` and ``second`` of their own."""

    def chances(n: int) -> np.ndarray:
        return np.exp([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2.0) for i in range(n + 1)])

    def set_bit(own: int) -> np.ndarray:
        over = np.append(np.cumsum(chances(own)[::-1])[::-1], 0.0)  # over[i]: at least i of the own hashes have the bit
        return over[np.clip((shared + own) // 2 + 1 - np.arange(shared + 1), 0, own + 1)]

    x, y = set_bit(first), set_bit(second)
    return float((chances(shared) * (x * (1.0 - y) + y * (1.0 - x))).sum())


@lru_cache
def largest_flip(above: int, similarity: float) -> float:
    """The largest flip_rate() of two sets of more than ``above`` hashes and of the similarity; it falls with the size."""
    most = math.acos(2.0 * similarity / (1.0 + similarity)) / math.pi
    for shared in range(math.ceil(similarity * (above + 1)), 3 * above):
        apart = math.floor(shared / similarity + 1e-9) - shared
        for first in range(apart // 2 + 1):
            if shared + first > above:
                most = max(most, flip_rate(shared, first, apart - first))
    return most


def proposal_plan(rows: int, flip: float, recall: float) -> tuple[list[list[int]], int, int]:
    """Bands, words of 64 bits and radius that together lose at most 1 - ``recall`` of the pairs whose bits differ with ``flip``."""
    tables = banded_keys(rows, flip, 1.0 - 0.9 * (1.0 - recall))
    words = -(-sum(map(len, tables)) // 64)
    bits = 64 * words
    n = np.arange(bits + 1)
    logs = np.array([math.lgamma(bits + 1) - math.lgamma(i + 1) - math.lgamma(bits - i + 1) for i in n.tolist()])
    beyond = 1.0 - np.cumsum(np.exp(logs + n * math.log(flip) + (bits - n) * math.log(1.0 - flip)))
    return tables, words, int(np.argmax(beyond <= 0.1 * (1.0 - recall)))


def close_pairs(fps: np.ndarray, ends: np.ndarray, radius: int, at_once: int = 8_192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j < ends[i], whose rows of ``fps`` (n, words) differ in at most ``radius`` bits, by pieces.

    ``ends``: for each row the end of its group of consecutive rows.
    """
    n, width = len(fps), 64 * fps.shape[1]
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(n, -1), axis=1)
    blocks = -(-n // LANES)
    padded = np.zeros((blocks * LANES, width), np.uint8)
    padded[:n] = bits
    # planes[p, b]: bit p of the 64 rows of block b, the first row in the lowest bit.
    packed = np.packbits(padded.reshape(blocks, LANES, width).transpose(2, 0, 1), axis=2, bitorder="little")
    planes = np.ascontiguousarray(packed).view("<u8")[:, :, 0].copy()
    own = np.ascontiguousarray(bits.T)
    first, last = (np.arange(n) + 1) // LANES, (ends - 1) // LANES
    many = np.where(ends > np.arange(n) + 1, last - first + 1, 0)
    upto = np.cumsum(many)
    levels = radius.bit_length()
    offset = (1 << levels) - 1 - radius  # a counter that starts here carries out of its top bit beyond the radius
    for start in range(0, int(upto[-1]) if n else 0, at_once):
        item = np.arange(start, min(start + at_once, int(upto[-1])))
        probe = np.searchsorted(upto, item, side="right")
        block = first[probe] + item - (upto[probe] - many[probe])
        low = np.clip(probe + 1 - block * LANES, 0, LANES).astype(np.uint64)
        high = np.clip(ends[probe] - block * LANES, 0, LANES).astype(np.uint64)
        over = ~(_ones(high) & ~_ones(low))
        counters = [np.full(len(item), FULL if offset >> level & 1 else 0, np.uint64) for level in range(levels)]
        waiting: list[np.ndarray | None] = [None] * levels

        for plane in range(width):
            carry, level = np.where(own[plane][probe], ~planes[plane][block], planes[plane][block]), 0
            while True:
                if level == levels:
                    over |= carry
                    break
                if waiting[level] is None:
                    waiting[level] = carry
                    break
                a, c = waiting[level], counters[level]
                waiting[level] = None
                half = a ^ carry
                counters[level] = half ^ c
                carry, level = (a & carry) | (half & c), level + 1
            if plane % 16 == 15 and plane + 1 < width:
                alive = over != FULL
                if np.count_nonzero(alive) < 0.7 * len(alive):
                    probe, block, over = probe[alive], block[alive], over[alive]
                    counters = [c[alive] for c in counters]
                    waiting = [None if w is None else w[alive] for w in waiting]
        for level in range(levels):
            carry = waiting[level]
            for higher in range(level, levels) if carry is not None else ():
                counters[higher], carry = counters[higher] ^ carry, counters[higher] & carry
            if carry is not None:
                over |= carry
        hit = np.flatnonzero(over != FULL)
        lanes = np.unpackbits((~over[hit]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(lanes)
        yield probe[hit][row], block[hit][row] * LANES + lane


def _ones(count: np.ndarray) -> np.ndarray:
    """Words whose ``count`` lowest bits are 1."""
    return np.where(count >= LANES, FULL, (np.uint64(1) << np.minimum(count, np.uint64(63))) - np.uint64(1))


class Forest:
    """Spanning forest of links that arrive in pieces, nearer ones first within a piece; rows of one label are joined from the start."""

    def __init__(self, labels: np.ndarray):
        first, at = np.unique(labels, return_index=True, return_inverse=True)[1:]
        self.root, self.links = first[at], []

    def _settle(self) -> None:
        while (self.root != (up := self.root[self.root])).any():
            self.root = up

    def add(self, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> None:
        order = np.argsort(distance, kind="stable")
        while True:
            a, b = self.root[i[order]], self.root[j[order]]
            apart = a != b
            order, a, b = order[apart], a[apart], b[apart]
            if not len(order):
                return
            # Each component's nearest link leaves it for another, so the number of components at least halves.
            first = np.unique(np.concatenate([a, b]), return_index=True)[1] % len(a)
            for at in np.unique(first).tolist():
                x, y = self._find(a[at]), self._find(b[at])
                if x != y:
                    self.root[max(x, y)] = min(x, y)
                    self.links.append((i[order[at]], j[order[at]], distance[order[at]]))
            self._settle()

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            x = self.root[x]
        return x


#: Keys of several rows that are broadcast at most.
MOST_KEYS = 300_000


def cells(keyed: DataFrame, group_rows: int, group_bytes: int = 8 << 20) -> DataFrame:
    """``keyed`` (number, key, node, ...) by (number, key, low, high), in sorted partitions: keys of one row are left out, and those
    of more than ``group_rows`` rows, or ``group_bytes`` of shingles, are cut into parts of which each pair meets."""
    rest = [c for c in keyed.columns if c not in ("number", "key")]
    held = F.sum(F.octet_length("shingles")) if "shingles" in rest else F.lit(0)
    many = keyed.groupBy("number", "key").agg(F.count("*").alias("rows"), held.alias("bytes")).where(F.col("rows") > 1)
    parts = F.ceil(F.greatest(F.col("rows") / F.lit(group_rows), F.col("bytes") / F.lit(group_bytes))).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # Spark sizes what Arrow functions make by what they read, so a side is broadcast only when a count allows it.
    many = materialise(many.select("number", "key", parts.alias("parts")), "many")
    dealt = (
        keyed.join(many.hint("broadcast" if many.count() <= MOST_KEYS else "merge"), ["number", "key"])
        .withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("number", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), *rest)
    )
    by = ["number", "key", "low", "high"]
    return dealt.repartition(*by).sortWithinPartitions(*by)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows of cells(), some thousand rows at a time, with the end of each row's group."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(final: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        nonlocal held, size
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        rows = rows[0] if rows else held[0]
        groups = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in range(4)])
        starts = np.flatnonzero(np.concatenate([[True], (groups[:, 1:] != groups[:, :-1]).any(axis=0)])) if rows.num_rows else np.zeros(0, np.int64)
        keep = rows.num_rows if final or not len(starts) else int(starts[-1])  # the last group may go on
        held, size = ([rows.slice(keep)], rows.num_rows - keep) if keep < rows.num_rows else ([], 0)
        if keep:
            bounds = np.append(starts[starts < keep], keep)
            yield rows.slice(0, keep), np.repeat(bounds[1:], np.diff(bounds))

    for batch in batches:
        for at in range(0, batch.num_rows, LANES * LANES):
            held.append(batch.slice(at, LANES * LANES))
            size += held[-1].num_rows
            if size >= LANES * LANES:
                yield from flush(False)
    if held:
        yield from flush(True)


def similar_pairs(sets: list[np.ndarray], ends: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, rows after i in its group whose sets have the similarity to that of row i), by an inverted index."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat, group = np.concatenate(sets), ends[owner]
    order = np.lexsort((owner, flat, group))
    flat, group, rows = flat[order], group[order], owner[order]
    last = np.flatnonzero(np.append((flat[1:] != flat[:-1]) | (group[1:] != group[:-1]), True))
    until = last[np.searchsorted(last, np.arange(len(flat)))] + 1
    spans = np.argsort(rows, kind="stable")
    upto = np.cumsum(sizes)
    for i in range(len(sets)):
        at = spans[upto[i] - sizes[i] : upto[i]]
        at = at[until[at] > at + 1]
        if len(at):
            shared = np.bincount(np.concatenate([rows[p + 1 : q] for p, q in zip(at.tolist(), until[at].tolist(), strict=True)]) - i)
            j = np.flatnonzero(shared)
            n = shared[j]
            yield i, i + j[n >= similarity * (sizes[i] + sizes[i + j] - n)]


def short_links(nodes: DataFrame, similarity: float, group_rows: int = 4_096, hot_rows: int = 1_000) -> DataFrame:
    """(a, b): links that join exactly the ``nodes`` (node, shingles: distinct hashes) that links of the similarity join.

    Sets of the similarity share a hash among the first n - ceil(similarity * n) + 1 of their n in any one order of the hashes.
    Those of over ``hot_rows`` sets stand last in it, so common passages are seldom keys.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], names=["key"])

    often = nodes.select("shingles").mapInArrow(single, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    often = sorted((r.key, r.n) for r in often.orderBy(F.desc("n")).limit(100_000).collect())
    hot = nodes.sparkSession.sparkContext.broadcast((np.array([k for k, _ in often], np.int64), np.array([n for _, n in often] + [0], np.int64)))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = hot.value
        for batch in batches:
            at, keys = [], []
            for row, data in enumerate(batch.column(1).to_pylist()):
                some = np.frombuffer(data, np.int64)
                if len(some):
                    place = np.searchsorted(names, some)
                    known = np.append(names, 0)[place] == some
                    rank = np.where(known & (place < len(names)), counts[place], 0)
                    first = some[np.lexsort((some, rank))][: len(some) - math.ceil(similarity * len(some) - 1e-9) + 1]
                    at.append(np.full(len(first), row))
                    keys.append(first)
            if at:
                at = pa.array(np.concatenate(at))
                columns = [pa.array(np.zeros(len(at), np.int32)), pa.array(np.concatenate(keys)), batch.column(0).take(at), batch.column(1).take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "key", "node", "shingles"])

    keyed = nodes.select("node", "shingles").mapInArrow(key, "number int, key long, node long, shingles binary")
    return set_links(keyed.select("number", "key", "node", F.col("node").alias("component"), "shingles"), similarity, group_rows)


def set_links(keyed: DataFrame, similarity: float, group_rows: int) -> DataFrame:
    """(a, b): links that join, with those of ``component``, exactly what all links of the similarity join between rows of ``keyed``
    (number, key, node, component, shingles) of one number and key. The work is that of an inverted index of each cell's hashes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in groups_of(batches):
            node = rows.column(4).to_numpy()
            forest = Forest(rows.column(5).to_numpy())
            for i, j in similar_pairs([np.frombuffer(x.as_buffer(), np.int64) for x in rows.column(6)], ends, similarity):
                forest.add(np.full(len(j), i), j, np.zeros(len(j), np.int64))
            if forest.links:
                i, j, _ = np.array(forest.links).T
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    return cells(keyed, group_rows).mapInArrow(compare, "a long, b long")


def close_links(nodes: DataFrame, tables: Sequence[Sequence[int]], radius: int, group_rows: int = 4_096) -> DataFrame:
    """(a, b, distance): links between ``nodes`` (node, fp) that agree on a key table and lie within ``radius``.

    All links are found; those of each group of a key are handed on as a spanning forest. A key with more than ``group_rows``
    rows is cut into parts that meet pairwise in groups of their own, so no task holds a whole hot key.
    """
    nodes = nodes.select("node", "fp")
    tables = [np.array(t) for t in tables]
    width = max(int(t.max()) for t in tables) + 1

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1), axis=1)
            for number, at in enumerate(tables):
                packed = np.zeros((n, 8), np.uint8)
                cut = np.packbits(bits[:, at], axis=1)[:, :8]
                packed[:, : cut.shape[1]] = cut
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(packed.view("<i8")[:, 0].copy()), *batch.columns], names=["number", "key", *batch.schema.names])

    assert width <= 64 * 64 and all(len(t) <= 64 for t in tables)
    keyed = nodes.mapInArrow(key, "number int, key long, node long, fp binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in groups_of(batches):
            node = rows.column(4).to_numpy()
            fps = np.frombuffer(b"".join(rows.column(5).to_pylist()), ">u8").reshape(len(node), -1).astype(np.uint64)
            forest = Forest(node)
            for i, j in close_pairs(fps, ends, radius):
                forest.add(i, j, np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64))
            if forest.links:
                i, j, distance = np.array(forest.links).T
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(distance.astype(np.int32))], names=["a", "b", "distance"])

    return cells(keyed, group_rows).mapInArrow(compare, "a long, b long, distance int")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link (a, b): the smallest node that links lead to.

    Alternating large-star and small-star contractions (Kiveris et al., 2014). Every round is written to the shared
    folder, so plans stay short and a lost executor costs one round at most.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(edges)
    for _ in range(most_rounds if before[0] else 0):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialise(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        if (now := state(edges)) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    if before[0]:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def label(prints: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp) with component_id: the component of the node (smallest doc_id) of their fingerprint."""
    found = components(links)
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of all documents; fingerprints link at ``radius`` or fewer differing bits, exactly.

    A null or empty text has fingerprint zero, which links like any other; equal texts and repeated rows share a
    fingerprint and so a component; rows with a null doc_id get a fingerprint but no component and link nothing; an empty
    table gives no rows; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, k), "prints")
    nodes = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")).select("node", "fp"), "nodes")
    return label(prints, close_links(nodes, exact_keys(64, radius, nodes.count()), radius), nodes)


def similar_components(docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """(doc_id, fp, component_id) where documents link at a Jaccard similarity of k-word shingle sets of ``similarity`` or more.

    Pairs with a set of at most SHORT shingles are found exactly, by short_links(). For others SimHash proposes: the bits of
    two longer sets of that similarity differ at most with a known probability, from which the bands, the number of bits and
    the radius follow, for a chance of ``recall`` at the threshold itself and more above it, whatever the number of rows.
    Proposals are then held against the true shingle sets, all of them where true ones do not already join the same groups.
    Cases as simhash_components().
    """
    tables, words, radius = proposal_plan(docs.count(), largest_flip(SHORT, similarity), recall)
    prints = materialise(fingerprints(docs, k, words, repeats=False, upto=math.floor(SHORT / similarity + 1e-9)), "prints")
    nodes = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("shingles").alias("shingles")), "nodes")
    prints, nodes = prints.select("doc_id", "fp"), nodes.select("node", "fp", "shingles")
    short = materialise(short_links(nodes.where("shingles is not null"), similarity), "short").distinct()
    long = nodes.where(F.col("shingles").isNull() | (F.octet_length("shingles") > 8 * SHORT)).select("node", "fp")
    links = verified_links(docs, long, tables, radius, k, similarity).union(short)
    return label(prints, links, nodes.select("node", "fp"))


def verified_links(docs: DataFrame, nodes: DataFrame, tables: Sequence[Sequence[int]], radius: int, k: int, similarity: float) -> DataFrame:
    """(a, b): links of true similarity that join all ``nodes`` (node, fp) which the links of close_links() with that similarity join.

    A forest of proposals may hold a false link in place of a true one. So the sets of nodes that proposals join but true links
    do not are compared with all others that proposals join them to, by an inverted index. That is quadratic in the nodes
    of such a component, which is cut into parts that meet pairwise.
    """
    links = close_links(nodes, tables, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    checked = materialise(_checked(docs, materialise(links.distinct(), "proposed"), k, similarity), "checked")
    good = checked.where("good").select("a", "b")
    mine = components(good).withColumnRenamed("component", "mine")
    reach = components(checked).withColumnRenamed("component", "reach")
    wide = reach.join(mine, "node", "left").select("node", "reach", F.coalesce("mine", "node").alias("component"))
    # The smallest node of a component has no row in components(); it is the smallest of its true component as well.
    wide = materialise(wide.union(reach.selectExpr("reach", "reach", "reach").distinct()), "reach")
    split = wide.groupBy("reach").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_ = materialise(semi_join_checked(wide, split, "reach"), "open")
    keyed = open_.join(shingle_sets(docs, open_, k), "node").select(F.lit(0).alias("number"), F.col("reach").alias("key"), "node", "component", "shingles")
    return good.union(materialise(set_links(keyed, similarity, 2_048), "settled"))


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(node, shingles): sorted distinct hashes of the texts of the documents ``ids`` (node)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            made = [np.unique(shingle_hashes(t.as_py() or b"", k)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text"))
    return materialise(semi_join_checked(texts, ids, "node").mapInArrow(sets, "node long, shingles binary"), "shingles").dropDuplicates(["node"])


def _checked(docs: DataFrame, links: DataFrame, k: int, similarity: float) -> DataFrame:
    """The ``links`` (a, b) with ``good``: the documents' shingle sets have the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(len(x) + len(y) == 0 or shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    shingles = shingle_sets(docs, links.select("a").union(links.select("b")).toDF("node").distinct(), k)
    first = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    second = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return links.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long, good boolean")


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each near-duplicate group; rows with a null doc_id stay.

    Rows that repeat a doc_id count as copies of one document, of which one stays.
    """
    found = materialise(similar_components(docs, k, similarity).select("doc_id", "component_id"), "groups")
    rows, ids = found.where("doc_id is not null").agg(F.count("*"), F.count_distinct("doc_id")).first()
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone.hint("broadcast" if gone.count() <= 1_000_000 else "merge"), "doc_id", "left_anti").select(docs.columns)
    if rows == ids:
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
