"""Reading embedding columns into numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Shape(NamedTuple):
    rows: int
    width: int
    top_norm: float


def norms(matrix: np.ndarray) -> np.ndarray:
    """Lengths of rows of any finite components; squares are taken of rows at the scale of their largest component."""
    if not matrix.size:
        return np.zeros(len(matrix))
    top = np.abs(matrix).max(axis=1)
    with np.errstate(over="ignore"):
        return top * np.sqrt(((matrix / np.where(top > 0, top, 1.0)[:, None]) ** 2).sum(axis=1))


def dense(ids: pa.Array, lists: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a float64 matrix of the rows with an id and a list without null or non-finite components.

    Shorter lists are padded with zeros, which leaves inner products and distances as they are.
    """
    values = lists.values
    ends = np.asarray(lists.offsets)
    sizes = np.where(np.asarray(lists.is_valid()), np.diff(ends), 0)
    good = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good &= wrong[ends[:-1] + sizes] == wrong[ends[:-1]]
    width = int(sizes.max(initial=0)) if width is None else width
    at = np.flatnonzero(good)
    matrix = np.zeros((len(at), width))
    row = np.repeat(np.arange(len(at)), sizes[at])
    first = np.cumsum(sizes[at]) - sizes[at]
    column = np.arange(len(row)) - np.repeat(first, sizes[at])
    matrix[row, column] = flat[np.repeat(ends[:-1][at], sizes[at]) + column]
    return ids.take(pa.array(at)).to_numpy().astype(np.int64), matrix


def shape_of(vectors: DataFrame) -> Shape:
    """Count, largest length and largest norm of the usable rows of (vec_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, matrix = dense(batch.column(0), batch.column(1))
            top = float(norms(matrix).max(initial=0.0))
            yield pa.RecordBatch.from_pydict({"rows": [len(ids)], "width": [matrix.shape[1]], "top": [top]})

    made = vectors.select("vec_id", "embedding").mapInArrow(run, "rows long, width long, top double")
    row = made.agg(F.sum("rows").alias("rows"), F.max("width").alias("width"), F.max("top").alias("top")).first()
    return Shape(row["rows"] or 0, row["width"] or 0, row["top"] or 0.0)
