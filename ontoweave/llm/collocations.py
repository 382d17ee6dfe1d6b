"""Phrase collocations by prefix-free parsing.

A pair of words whose hash falls in one of ``spacing`` classes is a trigger. Texts are cut at triggers into chunks that run
from a trigger to the end of the next one, so neighbours overlap by a pair of words and equal passages give equal chunks
wherever they stand. Chunks become a dictionary with the number of times that each is parsed; n-grams are counted inside
distinct chunks, weighted with that number. An n-gram belongs to the chunk in which it starts before the closing trigger,
so the overlap is counted once.

Only n-grams whose parts are frequent can be frequent: the parts' hashes are told to the next count in a bitmap of fixed
size. What collides there is counted in vain, never lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, materialise, table

OVERLAP = 2
#: Slots of the bitmap of frequent parts: 8 MB, whatever the corpus.
SLOTS = 1 << 26
# Letters that are lowered, characters that end a piece, and the tab that parts words like a space.
LOWER = bytes(
    ord("\n") if chr(b) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256)
)


#: A fixed random value of each byte; a word's are summed, which is enough to choose triggers by.
SPREAD = np.random.default_rng(13).integers(0, 1 << 40, 256)


def spans(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte strings data[first[i]:end[i]]."""
    offsets = np.concatenate([[0], (end - first).cumsum()])
    at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], end - first)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in one buffer, a space after each: (buffer, starts, ends, number of the piece, number of the text)."""
    data = np.frombuffer(b"\n".join(texts).translate(LOWER), np.uint8)
    inside = np.concatenate([[False], (data != 32) & (data != 10), [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    first, size = turns[::2], turns[1::2] - turns[::2]
    piece = np.searchsorted(np.flatnonzero(data == 10), first)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, side="right")
    starts = (size + 1).cumsum() - (size + 1)
    at = np.arange(len(first) + size.sum()) + np.repeat(first - starts, size + 1)
    held = data[np.minimum(at, max(0, len(data) - 1))]
    held[starts + size] = 32
    return held, starts, starts + size, piece, text


def chunks_of(texts: list[bytes], spacing: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunks, number of each one's text, whether it ends its piece)."""
    data, first, end, piece, text = words_of(texts)
    if not len(first):
        return pa.array([], pa.binary()), text, np.zeros(0, bool)
    sums = np.concatenate([[0], SPREAD[data].cumsum()])
    sums = (sums[end] - sums[first]) % (1 << 31)
    # A chunk begins with a piece or with a trigger, a pair of words of one piece; it ends with its piece or the next trigger.
    opens = np.concatenate([[True], piece[1:] != piece[:-1]])
    trigger = np.concatenate([((sums[:-1] * 31 + sums[1:]) // 7 % spacing == 0) & ~opens[1:], [False]])
    begin = np.flatnonzero(opens | trigger)
    after = np.concatenate([begin[1:], [len(first)]])
    last = np.concatenate([opens[begin[1:]], [True]])
    until = np.where(last, after - 1, after + OVERLAP - 1)
    return spans(data, first[begin], end[until]), text[begin], last


def parse(docs: DataFrame, spacing: int = 8) -> DataFrame:
    """(lang, chunk, last, times): the dictionary of docs (text, lang), as bytes of words parted by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1, 1 << 20):
            chunks, text, last = chunks_of(part.column(1).to_pylist(), spacing)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), chunks, pa.array(last)], names=["lang", "chunk", "last"])

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "lang string, chunk binary, last boolean").groupBy("lang", "chunk", "last").agg(F.count("*").alias("times"))


def slots(sums: list[np.ndarray]) -> np.ndarray:
    """Bitmap slots of n-grams by the checksums of their words."""
    slot = sums[0] % SLOTS
    for s in sums[1:]:
        slot = (slot * 31 + s) % SLOTS
    return slot


def bitmap(frequent: DataFrame, n: int) -> bytes:
    """The slots of ``frequent`` (gram of n words) as SLOTS bits; made of pieces of 4 KB that Spark aggregates."""
    words = F.split(F.col("gram").cast("string"), " ", -1)
    slot = F.pmod(F.crc32(words[0].cast("binary")), F.lit(SLOTS))
    for i in range(1, n):
        slot = F.pmod(slot * 31 + F.crc32(words[i].cast("binary")), F.lit(SLOTS))
    place = frequent.select((slot + 1).alias("place"))
    made = place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = bytearray(SLOTS // 8)
    for row in made.collect():  # at most SLOTS / 32768 rows
        at = (row["bucket"] - 1) * 4096
        bits[at : at + len(row["bits"])] = row["bits"]
    return bytes(bits)


def count_grams(dictionary: DataFrame, n: int, parts: bytes | None = None) -> DataFrame:
    """(lang, gram, f): n-grams of the dictionary with all their occurrences; with ``parts``, those whose (n-1)-grams have bits there."""
    shared = None if parts is None else dictionary.sparkSession.sparkContext.broadcast(parts)

    def grams(chunks: list[bytes], last: np.ndarray, times: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        # Chunks hold single spaces only, so the texts' words are the chunks' in order.
        data, first, end, of, _ = words_of(chunks)
        coded = spans(data, first, end).dictionary_encode()
        numbers, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        sizes = np.bincount(of, minlength=len(chunks))
        place = np.arange(len(first)) - (sizes.cumsum() - sizes)[of]
        # Starts before the closing trigger, or anywhere in the last chunk of a piece.
        starts = np.flatnonzero((place + n <= sizes[of]) & (last[of] | (place < sizes[of] - OVERLAP)))
        columns = [numbers[starts + i] for i in range(n)]
        if shared is not None:
            bits, sums = np.frombuffer(shared.value, np.uint8), np.fromiter(map(zlib.crc32, known.to_pylist()), np.int64, len(known))
            good = np.ones(len(starts), bool)
            for part in range(2):
                slot = slots([sums[c] for c in columns[part : part + n - 1]])
                good &= (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)
            starts, columns = starts[good], [c[good] for c in columns]
        key = columns[0]
        for c in columns[1:]:  # ranks keep the keys of three words within 64 bits
            key = np.unique(key, return_inverse=True)[1] * len(known) + c
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        held = np.add.reduceat(times[of[starts[order]]], heads) if len(heads) else np.zeros(0, np.int64)
        at = starts[order[heads]]
        return spans(data, first[at], end[at + n - 1]), held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1):
            langs = part.column(0).dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                mine = part.take(pa.array(np.flatnonzero(code == i)))
                found, held = grams(mine.column(1).to_pylist(), mine.column(2).to_numpy(zero_copy_only=False), mine.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found, pa.array(held)], names=["lang", "gram", "f"])

    counted = dictionary.select("lang", "chunk", "last", "times").mapInArrow(run, "lang string, gram binary, f long")
    return counted.groupBy("lang", "gram").agg(F.sum("f").alias("f"))


def frequent_grams(docs: DataFrame, least: int, spacing: int = 8) -> tuple[DataFrame, DataFrame]:
    """(grams, totals): (lang, gram string, words, f) of all n-grams of 1 to 3 words that occur ``least`` times, and (lang, n)."""
    dictionary = materialise(parse(docs, spacing), "chunks")
    single = materialise(count_grams(dictionary, 1), "words")
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    found = [materialise(single.where(F.col("f") >= least), "frequent1")]
    for n in (2, 3):
        found.append(materialise(count_grams(dictionary, n, bitmap(found[-1], n - 1)).where(F.col("f") >= least), f"frequent{n}"))
    grams = [g.select("lang", F.col("gram").cast("string").alias("gram"), F.lit(n).alias("words"), "f") for n, g in enumerate(found, 1)]
    return grams[0].unionByName(grams[1]).unionByName(grams[2]), totals


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, inside: int = 50, spacing: int = 8) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of two or three words.

    ``a`` is a phrase's number of occurrences, at least ``least``; ``l`` and ``r`` those of its parts at the cut with the
    lowest score, floor(1000000 a a / (l r)), ties to the first cut; ``n`` the language's words. Phrases of which a longer
    one makes up ``inside`` per cent are left out. Words are what spaces and tabs part in pieces between ``.,;:!?`` and line
    ends, with A-Z lowered. Null texts count as empty and null languages as und; rows that repeat count each time; other
    columns are left out; texts without words and empty tables give no row. Products are decimals of 38 digits: exact up
    to 10^16 occurrences of a phrase.
    """
    grams, totals = frequent_grams(docs, least, spacing)
    phrases = grams.where("words > 1").withColumnRenamed("gram", "phrase").withColumnRenamed("f", "a")
    part = lambda first, last: F.array_join(F.slice(F.split("phrase", " ", -1), first, last), " ")
    cut = lambda k: F.struct(F.lit(k).alias("k"), part(1, k).alias("left"), part(k + 1, 3).alias("right"))
    cuts = phrases.select("lang", "phrase", "words", "a", F.inline(F.when(F.col("words") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))))
    of = lambda c, name: grams.select("lang", F.col("gram").alias(c), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("cast((cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)"))
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    longer = phrases.where("words = 3").select("lang", F.col("a").alias("longer"), F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce("longer", F.lit(0)) * 100 < F.col("a") * inside)
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
i as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words, row_number() over () as id from p),
w as (select lang, id, unnest(words) as x, generate_subscripts(words, 1) as pos from i),
v as (select lang, x, lead(x, 1) over (partition by id order by pos) as y, lead(x, 2) over (partition by id order by pos) as z from w),
g as (
  select lang, x as gram, 1 as k from v union all select lang, x || ' ' || y, 2 from v where y is not null
  union all select lang, x || ' ' || y || ' ' || z, 3 from v where z is not null),
f as (select lang, gram, k, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, gram as phrase, k, f as a, string_split(gram, ' ') as w from f where k > 1 and f >= 10),
u as (
  select lang, phrase, a, 1 as cut, lang || ' ' || w[1] as l_key, lang || ' ' || array_to_string(w[2:], ' ') as r_key from c
  union all select lang, phrase, a, 2, lang || ' ' || w[1] || ' ' || w[2], lang || ' ' || w[3] from c where k = 3),
q as (select lang || ' ' || gram as key, f from f where f >= 10),
t as (select u.*, q.f as l from u join q on l_key = key),
s as (select t.*, q.f as r, ((a::hugeint * a::hugeint * 1000000) // (l::hugeint * q.f::hugeint))::bigint as score from t join q on r_key = key),
b as (select lang, phrase, a, unnest(arg_min({'l': l, 'r': r, 'score': score}, [score, cut])) from s group by lang, phrase, a),
h as (select lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase, a as longer from c where k = 3),
m as (select lang, phrase, max(longer) as longer from h group by all),
z as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank from b left join m using (lang, phrase) where 100 * coalesce(longer, 0) < 50 * a)
select lang, rank, phrase, a, l, r, n, score from z join n using (lang) where rank <= 2000
"""
