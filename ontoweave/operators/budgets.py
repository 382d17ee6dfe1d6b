"""Sections of ranked entries within a budget of characters, and numbered facts with caps, for all entities at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

#: The part of a section's budget that entries may fill in full when not all of them fit.
FULL_SHARE = 0.6
OMITTED_SIZE = 60


class Section(NamedTuple):
    name: str
    title: str
    share: float


def budgeted_sections(rows: DataFrame, sections: Sequence[Section], budget: int, full_share: float = FULL_SHARE) -> tuple[DataFrame, DataFrame]:
    """((entity, section, place, form, text), (entity, section, shown, omitted, used, carry)) of rows (entity, section, place, full, short).

    Sections follow one another; each has its share of ``budget`` and what the one before left. Entries go in the order of
    ``place``, which differs within an entity and section: in full, as long as all of them fit, or up to ``full_share`` of the
    room below the title; from the first that does not, short; until the first that does not fit at all. The rest is counted,
    and the line that says so costs sixty characters. An entity without entries in a section keeps its carry. Null texts are
    empty. An entry takes a character at least, so a window never holds more than ``budget`` + 1 entries of an entity: Spark cuts
    the rest off before the shuffle, and totals are aggregated apart.
    """
    by = Window.partitionBy("entity").orderBy("place")
    carry, texts, told = None, None, None
    for s in sections:
        mine = rows.where(F.col("section") == s.name).select("entity", "place", F.coalesce("full", F.lit("")).alias("full"), F.coalesce("short", F.lit("")).alias("short"))
        whole = mine.groupBy("entity").agg(F.count("*").alias("entries"), F.sum(F.length("full") + 1).alias("all_full"))
        head = len(f"## {s.title}") + 2
        left = F.lit(0) if carry is None else F.coalesce("carry", F.lit(0))
        whole = whole if carry is None else whole.join(carry, "entity", "left")
        whole = whole.select("entity", "entries", "all_full", (F.lit(int(budget * s.share)) + left).alias("room"))
        within = F.when(F.col("all_full") + head <= F.col("room"), F.col("room").cast("double")).otherwise(head + full_share * (F.col("room") - head))
        first = mine.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= budget + 1).join(whole.withColumn("within", within), "entity")
        first = first.withColumn("upto", head + F.sum(F.length("full") + 1).over(by))
        first = first.withColumn("form", F.when(F.col("upto") <= F.col("within"), "full").otherwise("short"))
        # Sizes grow, so full entries are the first ones; short ones follow.
        taken = F.when(F.col("form") == "full", F.length("full") + 1).otherwise(F.length("short") + 1)
        shown = settle(first.withColumn("used", head + F.sum(taken).over(by)).where((F.col("form") == "full") | (F.col("used") <= F.col("room"))), "section")
        # A short entry may fit again after one that did not; what counts is the run from the first.
        run = shown.withColumn("at", F.row_number().over(by)).where(F.col("at") == F.col("nth"))
        last = run.groupBy("entity").agg(F.count("*").alias("shown"), F.max("used").alias("used"))
        state = whole.join(last, "entity", "left").withColumn("shown", F.coalesce("shown", F.lit(0).cast("long"))).withColumn("omitted", F.col("entries") - F.col("shown"))
        state = state.withColumn("used", F.coalesce("used", F.lit(head)) + F.when(F.col("omitted") > 0, OMITTED_SIZE).otherwise(0))
        state = settle(state.select("entity", F.lit(s.name).alias("section"), "shown", "omitted", F.col("used").cast("long").alias("used"), F.greatest(F.lit(0), F.col("room") - F.col("used")).cast("long").alias("carry")), "budget")
        now = state.select("entity", "carry")
        carry = now if carry is None else settle(now.unionByName(carry.join(now, "entity", "left_anti")), "carry")
        out = run.select("entity", F.lit(s.name).alias("section"), "place", "form", F.when(F.col("form") == "full", F.col("full")).otherwise(F.col("short")).alias("text"))
        texts, told = (out, state) if texts is None else (texts.unionByName(out), told.unionByName(state))
    return texts, told


def cited_facts(facts: DataFrame, caps: Mapping[str, int]) -> DataFrame:
    """(entity, citation, kind, text): facts (entity, kind, place, text) numbered E1, E2, ... in the order of ``caps``.

    Of each kind an entity has as many as its cap, by ``place`` and text; kinds without a cap are left out.
    """
    nth = F.row_number().over(Window.partitionBy("entity", "kind").orderBy("place", "text"))
    kinds = list(caps)
    cap = F.try_element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("kind"))
    most = max(caps.values(), default=0)
    kept = facts.where(F.col("kind").isin(*kinds)).withColumn("nth", nth).where(F.col("nth") <= most).where(F.col("nth") <= cap)
    order = Window.partitionBy("entity").orderBy(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), "nth")
    return kept.select("entity", F.concat(F.lit("E"), F.row_number().over(order).cast("string")).alias("citation"), "kind", "text")
