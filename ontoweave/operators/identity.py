"""Merging records that name the same thing, and clusters of similar things."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .lineage import settle


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of all nodes of links (a, b): the smallest connected node.

    Labels go to neighbours and then follow their own label's label, which halves the distance left each round.
    """
    edges = settle(links.select("a", "b").union(links.select("b", "a")).where("a is not null and b is not null").distinct(), "links")
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = edges.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        stepped = labels.join(near, "node").select("node", "component", F.least("component", "label").alias("label"))
        jumped = stepped.join(labels.toDF("label", "further"), "label").select("node", "component", F.least("label", "further").alias("label"))
        jumped = settle(jumped, "labels")
        labels = jumped.select("node", F.col("label").alias("component"))
        if jumped.where("label <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _first_for_both(edges: DataFrame) -> DataFrame:
    """Edges (a, b, ord, ...) of blocks that come before all other edges of both their blocks."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("block"), "ord").groupBy("block").agg(F.min("ord").alias("first"))
    left, right = ends.toDF("a", "first_a"), ends.toDF("b", "first_b")
    return edges.join(left, "a").join(right, "b").where((F.col("ord") == F.col("first_a")) & (F.col("ord") == F.col("first_b"))).drop("first_a", "first_b")


def _renamed(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges with the blocks of ``moved`` (old, new) renamed, those within a block left out, and a before b."""
    for end in ("a", "b"):
        edges = edges.join(moved.toDF(end, "new"), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return edges.where("a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})


#: The most edges of a component that one task holds at once while it merges them in order.
CELL_EDGES = 200_000


def _split(edges: DataFrame, cell_edges: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, ord) of components of at most ``cell_edges`` edges, with their component, and those of larger ones."""
    labels = connected_components(edges)
    owned = settle(edges.join(labels.toDF("a", "component"), "a"), "owned")
    crowds = owned.groupBy("component").count().where(F.col("count") > cell_edges).select("component")
    return owned.join(crowds, "component", "left_anti"), owned.join(crowds, "component", "left_semi").drop("component")


def _merged_in_order(small: DataFrame, merge: Callable[[list[tuple[str, str]]], Iterable[tuple[str, str]]], name: str) -> DataFrame:
    """(``name``, block) by ``merge`` of each component's edges (a, b) in order of ``ord``. A task sorts whole components and streams
    them, so it holds the edges of one component, which ``_split`` has bounded, and no component costs a call of its own."""
    kind = small.schema["a"].dataType
    schema = StructType().add(name, kind).add("block", kind)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3))))
        held: list[tuple[str, str]] = []
        for _, edges in groupby(rows, key=lambda row: row[0]):
            held += merge([(a, b) for _, a, b in edges])
            if len(held) >= 10_000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({name: [p[0] for p in pairs], "block": [p[1] for p in pairs]}, arrow)

    return small.repartition("component").sortWithinPartitions("component", "ord").select("component", "a", "b").mapInArrow(run, schema)


def _cell_merge(unique_prefixes: Sequence[str] | None) -> Callable[[list[tuple[str, str]]], list[tuple[str, str]]]:
    """Merges one component's edges, best first: if all pairs across are edges (None), or unless two ids of one unique prefix would meet.

    ``across`` counts the edges between blocks; the block with fewer neighbours moves, so that a pair's count moves a logarithmic
    number of times. The function holds all it needs, as tasks get it by value.
    """
    unique = None if unique_prefixes is None else frozenset(unique_prefixes)

    def merge(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
        parent = {x: x for edge in edges for x in edge}
        size = dict.fromkeys(parent, 1)
        across: dict[str, dict[str, int]] = {x: {} for x in parent} if unique is None else {}
        # Different nodes of one prefix are different ids.
        held = {} if unique is None else {x: {x.partition(":")[0]} & unique for x in parent}

        def root(x: str) -> str:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if unique is None:
            for a, b in edges:
                across[a][b] = across[b][a] = 1
        for a, b in edges:
            a, b = root(a), root(b)
            if a == b or (across[a][b] != size[a] * size[b] if unique is None else held[a] & held[b]):
                continue
            if (len(across[a]) < len(across[b])) if unique is None else size[a] < size[b]:
                a, b = b, a
            parent[b] = a
            size[a] += size[b]
            if unique is not None:
                held[a] |= held.pop(b)
                continue
            for other, n in across.pop(b).items():
                del across[other][b]
                if other != a:
                    across[a][other] = across[other][a] = across[a].get(other, 0) + n
        return [(x, root(x)) for x in parent]

    return merge


def complete_link(pairs: DataFrame, threshold: float, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(cluster, member): pairs (a, b, value), best first; blocks merge only if every cross pair reaches the threshold.

    No merge crosses a component of the good pairs. Components of at most ``cell_edges`` pairs are merged in order by one task each,
    however long their chains are. The others are merged in rounds: two blocks may merge once their edge is the first of both,
    whatever goes on elsewhere, so each round merges many. Edges between blocks carry the number of good pairs across; blocks whose pairs are not all good never come to be mergeable, as
    blocks only grow, so such an edge is done when its turn comes. Each round is joins and aggregations over the edges that
    are left. Equal values go by the smaller names. Blocks of one are left out; a cluster is named by its smallest member.
    """
    good = pairs.where((F.col("value") >= threshold) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    good = good.groupBy("a", "b").agg(F.max("value").alias("value"))
    edges = settle(good.select("a", "b", F.struct((-F.col("value")).alias("v"), F.col("a").alias("x"), F.col("b").alias("y")).alias("ord"), F.lit(1).cast("long").alias("good")), "edges")
    small, edges = _split(edges, cell_edges)
    edges, cells = settle(edges, "edges"), settle(_merged_in_order(small, _cell_merge(None), "member"), "cells")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("member")).distinct()
    blocks = settle(nodes.select("member", F.col("member").alias("block")), "blocks")
    while True:  # the first edge of all is always the first of both its blocks
        if edges.isEmpty():
            named = blocks.union(cells).withColumn("cluster", F.min("member").over(Window.partitionBy("block"))).withColumn("n", F.count("*").over(Window.partitionBy("block")))
            return named.where("n > 1").select("cluster", "member")
        size = blocks.groupBy("block").agg(F.count("*").alias("size"))
        # An edge whose good pairs are not all pairs across can be left out at once.
        whole = edges.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
        open_ = settle(whole.where(F.col("good") == F.col("na") * F.col("nb")).select("a", "b", "ord", "good"), "edges")
        moved = settle(_first_for_both(open_).select(F.col("b").alias("old"), F.col("a").alias("new")), "moved")
        blocks = settle(blocks.join(moved.toDF("block", "new"), "block", "left").select("member", F.coalesce("new", "block").alias("block")), "blocks")
        edges = settle(_renamed(open_, moved).groupBy("a", "b").agg(F.min("ord").alias("ord"), F.sum("good").alias("good")), "edges")


def veto_merge(links: DataFrame, unique_prefixes: Sequence[str], cell_edges: int = CELL_EDGES) -> DataFrame:
    """(node, entity): links (a, b, ord) merge in order unless that would join two ids of one unique prefix.

    Components of at most ``cell_edges`` links are merged in order by one task each, the others in rounds.
    Links between blocks that hold different ids of one prefix can never merge, as blocks only grow, so each round drops
    all of them. Two blocks merge once their link is the first of both: then no earlier link can change either. A block
    without any such id also merges by its own first link, whatever the other side waits for, as it brings nothing that
    could clash. Equal ``ord`` go by the smaller names. Entities are named by their smallest node.
    """
    rows = links.where("a is not null and b is not null").select("a", "b", F.struct("ord", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).alias("ord"))
    edges = settle(rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ord").groupBy("a", "b").agg(F.min("ord").alias("ord")), "edges")
    small, edges = _split(edges, cell_edges)
    edges, cells = settle(edges, "edges"), settle(_merged_in_order(small, _cell_merge(unique_prefixes), "node"), "cells")
    # Nodes that are linked with nothing but themselves are entities of their own.
    nodes = rows.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(cells, "node", "left_anti")
    blocks = settle(nodes.select("node", F.col("node").alias("block")), "blocks")
    prefix = F.substring_index("node", ":", 1)
    while True:
        # A block holds one id of each unique prefix at most: equal ids are the same node.
        held = settle(blocks.withColumn("prefix", prefix).where(F.col("prefix").isin(*unique_prefixes)).select("block", "prefix", "node"), "held")
        clash = edges.join(held.toDF("a", "prefix", "i"), "a").join(held.toDF("b", "prefix", "j"), ["b", "prefix"]).where("i <> j").select("a", "b").distinct()
        edges = settle(edges.join(clash, ["a", "b"], "left_anti"), "edges")
        if edges.isEmpty():
            return blocks.union(cells).select("node", F.min("node").over(Window.partitionBy("block")).alias("entity"))
        both = _first_for_both(edges).select(F.col("b").alias("old"), F.col("a").alias("new"))
        ends = edges.select("a", "b", "ord").union(edges.select("b", "a", "ord")).groupBy(F.col("a").alias("old")).agg(F.min_by("b", "ord").alias("new"))
        free = ends.join(held.select(F.col("block").alias("old")).distinct(), "old", "left_anti")
        moves = settle(both.union(free).groupBy("old").agg(F.min("new").alias("new")), "moves")
        # A block that others move to stays where it is this round; of two that would swap, the smaller one stays.
        swaps = moves.join(moves.toDF("new", "back"), "new").where("old = back and old < new").select("old")
        going = moves.join(swaps, "old", "left_anti")
        moved = settle(going.join(going.select(F.col("old").alias("new")), "new", "left_anti").select("old", "new"), "moved")
        blocks = settle(blocks.join(moved.toDF("block", "new"), "block", "left").select("node", F.coalesce("new", "block").alias("block")), "blocks")
        edges = settle(_renamed(edges, moved).groupBy("a", "b").agg(F.min("ord").alias("ord")), "edges")


def stable_cluster_id(kind: str, process: Column, members: Column) -> Column:
    """``kind-`` and 20 hexadecimal digits of the SHA-256 of [kind, process, members] written as JSON with ', '."""
    quote = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    listed = F.concat(F.lit("["), F.array_join(F.transform(members, quote), ", "), F.lit("]"))
    text = F.concat(F.lit(f'["{kind}", '), F.coalesce(quote(process), F.lit("null")), F.lit(", "), listed, F.lit("]"))
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(text, 256), 1, 20))


def shared_process_groups(members: DataFrame) -> DataFrame:
    """(process, members, id): the members (process, member) of each process that more than one shares; groups may overlap."""
    groups = members.groupBy("process").agg(F.sort_array(F.collect_set("member")).alias("members")).where(F.size("members") > 1)
    return groups.withColumn("id", stable_cluster_id("pathway", F.col("process"), F.col("members")))
