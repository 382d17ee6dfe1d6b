"""Reading a text as known names: whole, else its listed parts, else the pieces of a part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal
from .topk import best_per_key

PARTS, PIECES = r"[,;\n+]", r"(?i)\s+(?:and|with)\s+"


def interpret(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, part, piece, segment, kind, id): what texts (text_id, text) name, in order.

    ``names`` (name, kind, id, fixed): kinds are gene, disease and phenotype. A gene's name is a gene; of a name that is a
    disease and a phenotype, the disease stays if it is ``fixed`` as one, otherwise it is read as the phenotype; of several
    ids of a kind the least. A text that is a name is that name alone. Otherwise its parts, between commas, semicolons, line
    ends and plus signs, are names or, if all pieces of a part between "and" and "with" are names, those; a part that is
    neither has no kind and id. Blank parts are none; blank or null texts give no row.
    """
    key = normal(F.col("segment"))
    by_kind = F.when(F.col("kind") == "gene", 0).when((F.col("kind") == "disease") & F.col("fixed"), 1).when(F.col("kind") == "phenotype", 2).otherwise(3)
    known = best_per_key(names.select(normal(F.col("name")).alias("key"), "kind", "id", by_kind.alias("rank")).where(F.col("key") != ""), ["key"], ["rank", "id"]).drop("rank")

    filled = lambda split: F.filter(split, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    parts = texts.select("text_id", "text", F.posexplode(filled(F.split("text", PARTS))).alias("part", "segment"))
    # Of each text the whole (part -1), its parts (piece -1) and their pieces.
    pieces = parts.select("text_id", "part", F.posexplode(filled(F.split("segment", PIECES))).alias("piece", "segment"))
    whole = texts.select("text_id", F.lit(-1).alias("part"), F.lit(-1).alias("piece"), F.col("text").alias("segment")).where(normal(F.col("segment")) != "")
    segments = whole.unionByName(parts.select("text_id", "part", F.lit(-1).alias("piece"), "segment")).unionByName(pieces)
    read = segments.withColumn("key", key).join(known, "key", "left").drop("key")

    row = F.struct("part", "piece", F.trim("segment").alias("segment"), "kind", "id")
    by_text = read.groupBy("text_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    is_whole, is_part = (lambda r: r["part"] == -1), (lambda r: (r["part"] >= 0) & (r["piece"] == -1))
    one = F.filter("rows", lambda r: is_whole(r) & r["kind"].isNotNull())
    of = lambda r: F.filter("rows", lambda q: (q["part"] == r["part"]) & (q["piece"] >= 0))
    split = lambda r: F.when(r["kind"].isNull() & (F.size(of(r)) > 1) & F.forall(of(r), lambda q: q["kind"].isNotNull()), of(r)).otherwise(F.array(r))
    told = F.when(F.size(one) > 0, one).otherwise(F.flatten(F.transform(F.filter("rows", is_part), split)))
    return by_text.select("text_id", F.inline(told))
