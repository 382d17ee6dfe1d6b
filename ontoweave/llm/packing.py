"""Best-fit packing of tokenised documents, planned on the histogram of piece lengths.

The plan is made over counts: at most one number a length reaches the driver, however many documents there are. It is
a list of runs, each giving consecutive ranks of one length their sequences and offsets. Pieces then take their slots
by joining on their rank within their length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, materialise, table

class CachedTokenizer:
    """Ids of whole texts by a byte-level BPE file of ``tokenizers``; the ids of words met before come from a cache.

    The file's vocabulary runs on tiktoken's merge loop, which gives the same ids several times as fast. A single space
    between two non-spaces always starts a new pre-token, so a text without other white space around its spaces is
    the sequence of its words; any other text is encoded in one go.
    """

    def __init__(self, path: str, most: int = 100_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        visible = byte_alphabet()
        ranks = {bytes(visible[c] for c in t): i for t, i in self.whole.get_vocab(with_added_tokens=False).items() if t not in self.special}
        # Fixed value: the pre-tokeniser pattern of byte-level BPE.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def _at_once(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *words = text.split(" ")
        if not words:
            return self._at_once(text)
        if not head or head[-1].isspace():
            return self._at_once(text)
        found = list(map(self.known.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, x in zip(words, found, strict=True) if x is None))
            if any(not w or w[0].isspace() or w[-1].isspace() for w in new):
                return self._at_once(text)
            ids = np.array(self.bpe.encode_ordinary(" " + " ".join(new)), "<u4")
            cuts = [*(4 * np.flatnonzero(self.spaced[ids])).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            fresh = {w: data[i:j] for w, i, j in zip(new, cuts[:-1], cuts[1:], strict=True)}
            found = [fresh[w] if x is None else x for w, x in zip(words, found, strict=True)]
            if len(self.known) < self.most:
                self.known.update(fresh)
        return self._at_once(head) + b"".join(found)


def byte_alphabet() -> dict[str, int]:
    """The byte for each visible character of byte-level BPE: printable Latin-1 stands for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    """One for each Python worker."""
    return CachedTokenizer(path)


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: all of the capacity but the first, which may be shorter."""
    first = n % capacity or capacity
    return [first, *[capacity] * ((n - first) // capacity)]


def tokenize_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids with ``end_id`` after them."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).ids
        for batch in by_bytes(batches, 1):
            ids, rows, kept = batch.column(0), [], []
            for i, text in enumerate(batch.column(1)):
                data = memoryview(encode(text.as_py() or "") + end)
                start = 0
                for piece, length in enumerate(cut_lengths(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((i, piece, start, length, zlib.crc32(part)))
                    if with_ids:
                        kept.append(np.frombuffer(part, "<i4"))
                    start += length
            at, piece, start, length, crc = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True)) if rows else [pa.array([], pa.int64())] * 5
            columns = [ids.take(at), piece.cast(pa.int32()), start, length, crc]
            if with_ids:
                ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def plan_best_fit(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, rank after the last, pieces a sequence, first sequence, offset).

    Lengths go from long to short; each count goes into the open sequences with the least room that still holds the
    length, many sequences at a time, then into new ones.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, how many)
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fit = length
        while left:
            while fit < capacity and not room[fit]:
                fit += 1
            each = fit // length
            if fit < capacity:
                first, many = room[fit].pop()
            else:
                first, many = opened, -(-left // each)
                opened += many
            full = min(many, left // each)
            parts = [(first, full, each)] if full else []
            if full < many and left - full * each:
                parts.append((first + full, 1, min(each, left - full * each)))
            for at, n, k in parts:
                runs.append((length, rank, rank + n * k, k, at, capacity - fit))
                rank, left = rank + n * k, left - n * k
                first, many = first + n, many - n
                room[fit - k * length].append((at, n))
            if many:
                room[fit].append((first, many))
    return runs


def pack_pieces(pieces: DataFrame, capacity: int, rows_per_slice: int | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset; no sequence exceeds the capacity.

    Ranks within a length are counted in hashed slices of bounded size, so a length that most pieces share is not one
    task's work; by default a slice has the square root of all pieces, so neither the rows of a slice nor the slices of a
    length are many. What is broadcast, the slices of each length and the plan, depends on the capacity only.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    by_length = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows_per_slice = rows_per_slice or max(500, math.isqrt(sum(by_length.values())))
    runs = plan_best_fit(by_length, capacity)
    plan = spark.createDataFrame(runs, "length long, from_rank long, to_rank long, each long, first_sequence long, at long")
    slices = spark.createDataFrame([(n, math.ceil(c / rows_per_slice)) for n, c in by_length.items()], "length long, slices int")
    cut = F.pmod(F.xxhash64("doc_id", "piece"), F.col("slices")).cast("int")
    pieces = pieces.join(F.broadcast(slices), "length").withColumn("slice", cut).drop("slices")
    upto = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("length", "slice").count().select("length", "slice", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("rank_start"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(within)).join(starts, ["length", "slice"]).withColumn("rank", F.col("rank_start") + F.col("nth") - 1)
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= from_rank and rank < to_rank")
    step = F.col("rank") - F.col("from_rank")
    return (
        placed.withColumn("sequence_id", F.col("first_sequence") + F.floor(step / F.col("each")))
        .withColumn("offset", F.col("at") + step % F.col("each") * F.col("length"))
        .select(*columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = True) -> DataFrame:
    """All documents as pieces placed in sequences of at most ``capacity`` ids.

    A null text is empty and still packs its end id; repeated rows are packed each; null ids stay null; an empty table
    gives no rows; other columns are ignored. Texts are tokenised once, whole, and are not shuffled; ``with_ids`` keeps
    the ids of every piece, else only their CRC goes on.
    """
    pieces = materialise(tokenize_pieces(docs, path, end_id, capacity, with_ids), "pieces")
    return pack_pieces(pieces, capacity)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), default_vocabulary(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
