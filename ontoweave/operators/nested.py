"""Nested selections: rows with lists of what hangs below them, each list counted, ordered and cut to a page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Selection:
    """``columns`` of ``rows`` and, under its name, each of ``children``.

    A child's ``parent`` column holds the ``key`` of the row that it hangs below. Its list is ordered by ``order``, which should
    leave no ties, and cut to ``size`` rows after the first ``skip``; ``size`` None keeps all. Rows with
    the same ``key`` have the same lists below them. Only the columns named here are read.
    """

    rows: DataFrame
    columns: Sequence[str]
    key: str | None = None
    parent: str | None = None
    order: Sequence[str | Column] = ()
    size: int | None = None
    skip: int = 0
    children: Mapping[str, Selection] = field(default_factory=dict)


def nested(selection: Selection) -> DataFrame:
    """One row with ``columns`` and a struct (count, rows) for each child: the number of all rows below, and the page of them.

    A row with nothing below it, or a null key, has count 0 and an empty list; rows below no row are left out. Lists are cut before
    anything is nested into them, so that what hangs below rows outside the page is not read into the lists, and with a page size
    no list grows with the data.
    """
    return _with_children(selection, cut=False).select(*selection.columns, *selection.children)


def _with_children(selection: Selection, cut: bool) -> DataFrame:
    rows = selection.rows
    for name, child in selection.children.items():
        below = _lists(child, rows.select(F.col(selection.key).alias("_above")) if cut else None)
        kind = below.schema["_list"].dataType
        nothing = F.struct(F.lit(0).cast("long").alias("count"), F.array().cast(kind["rows"].dataType).alias("rows"))
        rows = rows.join(below, rows[selection.key] == below["_below"], "left").withColumn(name, F.coalesce("_list", nothing)).drop("_below", "_list")
    return rows


def _lists(child: Selection, above: DataFrame | None) -> DataFrame:
    """(_below, _list) of a child by its parent's key; ``above`` are the keys that are left where the parents are a page."""
    rows = child.rows.where(F.col(child.parent).isNotNull())
    if above is not None:
        rows = rows.join(above, rows[child.parent] == above["_above"], "left_semi")
    counts = rows.groupBy(F.col(child.parent).alias("_of")).agg(F.count("*").alias("_count"))
    place = F.row_number().over(Window.partitionBy(child.parent).orderBy(*(child.order or [F.lit(1)])))
    page = rows.withColumn("_place", place)
    if child.size is not None:
        page = page.where(F.col("_place") <= child.skip + child.size)
    if child.skip:
        page = page.where(F.col("_place") > child.skip)
    full = _with_children(replace(child, rows=page), cut=above is not None or child.size is not None or child.skip > 0)
    row = F.struct(*child.columns, *child.children)
    listed = full.groupBy(F.col(child.parent).alias("_below")).agg(F.array_sort(F.collect_list(F.struct("_place", row.alias("_row")))).alias("_rows"))
    plain = listed.select("_below", F.transform("_rows", lambda x: x["_row"]).alias("_rows"))
    lists = counts.join(plain, counts["_of"] == plain["_below"], "left")
    none = F.array().cast(plain.schema["_rows"].dataType)  # a page past the end
    return lists.select(F.col("_of").alias("_below"), F.struct(F.col("_count").alias("count"), F.coalesce("_rows", none).alias("rows")).alias("_list"))
