"""Search over names and texts with posting tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

WORD = "[\\p{L}\\p{N}]+"


def match_rank(query: str, identifier: Column, label: Column) -> Column:
    """0 for the exact id, 1 for the exact label, 2 for a label's beginning, 3 for a part of one, else null; case is ignored."""
    q = F.lit(" ".join(query.split()).lower())
    name = F.lower(label)
    return F.when(F.lower(identifier) == q, 0).when(name == q, 1).when(F.startswith(name, q), 2).when(F.contains(name, q), 3)


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, pos) for each word of docs (doc_id, text)."""
    terms = F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)
    return docs.select("doc_id", F.posexplode(terms).alias("pos", "term"))


class Index(NamedTuple):
    """Postings (doc_id, field, term, positions) and sizes (doc_id, field, length) of documents with several text fields."""

    postings: DataFrame
    sizes: DataFrame


def build_index(docs: DataFrame, fields: Sequence[str]) -> Index:
    """The index of docs (doc_id, one text column for each field), written once; a null field has no words."""
    listed = F.array(*(F.struct(F.lit(f).alias("field"), F.regexp_extract_all(F.lower(F.coalesce(f, F.lit(""))), F.lit(WORD), 0).alias("words")) for f in fields))
    # Texts are dealt to tasks by document, once; their words are only parted there.
    rows = docs.select("doc_id", *fields).repartition("doc_id").select("doc_id", F.explode(listed).alias("x")).select("doc_id", "x.field", "x.words")
    found = rows.select("doc_id", "field", F.posexplode("words").alias("pos", "term")).groupBy("doc_id", "field", "term")
    return Index(settle(found.agg(F.sort_array(F.collect_list("pos")).alias("positions")), "postings"), settle(rows.select("doc_id", "field", F.size("words").alias("length")), "sizes"))


class Node(NamedTuple):
    """``kind``: and, or, not, words. Words are next to each other; the last one is a beginning if ``prefix``; ``fields`` () means any."""

    kind: str
    parts: tuple[Node, ...] = ()
    words: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    prefix: bool = False


_TOKEN = re.compile(r'\s*(?:([()])|("[^"]*"|[^\s()\[\]"]+)(\*?)\s*(?:\[([^\]]*)\])?)')


def parse_query(text: str, tags: Mapping[str, Sequence[str]]) -> Node | None:
    """The tree of a query of words, "phrases", beginnings*, [field] tags, AND, OR, NOT and brackets; NOT binds first, then AND, then OR.

    Terms side by side are joined by AND. ``tags``: lower-cased tag to fields; an unknown tag means any field. None without a term.
    """
    tokens = [m.groups() for m in _TOKEN.finditer(text)]
    at = 0

    def word(token) -> Node | None:
        raw, star, tag = token[1], token[2], token[3]
        prefix = bool(star) or raw.strip('"').endswith("*")
        words = tuple(re.findall(r"[^\W_]+", raw.lower()))
        return Node("words", words=words, fields=tuple(tags.get((tag or "").strip().lower(), ())), prefix=prefix) if words else None

    def joined(kind: str, parts: list[Node | None]) -> Node | None:
        parts = [p for p in parts if p]
        return None if not parts else parts[0] if len(parts) == 1 else Node(kind, tuple(parts))

    def peek() -> str | None:
        return None if at == len(tokens) else tokens[at][0] or (tokens[at][1] if not tokens[at][3] else "term")

    def either() -> Node | None:
        nonlocal at
        parts = [both()]
        while peek() == "OR":
            at += 1
            parts.append(both())
        return joined("or", parts)

    def both() -> Node | None:
        nonlocal at
        parts = [one()]
        while peek() not in (None, "OR", ")"):
            if peek() == "AND":
                at += 1
            parts.append(one())
        return joined("and", parts)

    def one() -> Node | None:
        nonlocal at
        if peek() == "NOT":
            at += 1
            inner = one()
            return Node("not", (inner,)) if inner else None
        if peek() == "(":
            at += 1
            inner = either()
            at += peek() == ")"
            return inner
        if peek() in (None, ")", "AND", "OR"):
            return None
        token = tokens[at]
        at += 1
        return word(token)

    return either()


def _holding(index: Index, node: Node) -> DataFrame:
    """(doc_id) of the documents with the node's words next to each other in one of its fields."""
    rows = index.postings if not node.fields else index.postings.where(F.col("field").isin(*node.fields))
    last = len(node.words) - 1
    found = None
    for i, w in enumerate(node.words):
        fits = F.startswith("term", F.lit(w)) if node.prefix and i == last else F.col("term") == w
        here = rows.where(fits).select("doc_id", "field", *([F.explode("positions").alias("pos")] if last else []))
        if last:
            here = here.select("doc_id", "field", (F.col("pos") - i).alias("at")).distinct()
        found = here if found is None else found.join(here, ["doc_id", "field", "at"], "left_semi")
    return found.select("doc_id").distinct()


def matching(index: Index, query: Node) -> DataFrame:
    """(doc_id) of the documents that a query's tree holds for; a NOT alone is taken from all documents."""
    if query.kind == "words":
        return _holding(index, query)
    if query.kind == "not":
        return index.sizes.select("doc_id").distinct().join(matching(index, query.parts[0]), "doc_id", "left_anti")
    if query.kind == "or":
        found = matching(index, query.parts[0])
        for part in query.parts[1:]:
            found = found.unionByName(matching(index, part))
        return found.distinct()
    wanted = [p for p in query.parts if p.kind != "not"]
    found = matching(index, wanted[0]) if wanted else index.sizes.select("doc_id").distinct()
    for part in wanted[1:]:
        found = found.join(matching(index, part), "doc_id", "left_semi")
    for part in query.parts:
        if part.kind == "not":
            found = found.join(matching(index, part.parts[0]), "doc_id", "left_anti")
    return found


def weighted_bm25(index: Index, terms: Sequence[str], weights: Mapping[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score): BM25 in which a word counts by the weight of its field and lengths add over all fields (Robertson and Zaragoza, 2009).

    Only the postings of the asked terms are read; terms stand in rows, so their names can't clash with columns.
    """
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in weights.items() for x in item)), F.col("field")), F.lit(1.0))
    lengths = index.sizes.groupBy("doc_id").agg(F.sum("length").alias("length"))
    total = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    asked = index.postings.where(F.col("term").isin(*set(terms)))
    tf = asked.groupBy("doc_id", "term").agg(F.sum(F.size("positions") * weight).alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(F.lit(1.0) + (F.lit(float(total["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / (total["mean"] or 1.0)))
    return tf.join(F.broadcast(df), "term").join(lengths, "doc_id").groupBy("doc_id").agg(F.sum(part).alias("score"))


def term_counts(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(doc_id, length, tf: counts of the terms in their order), without exploding texts into rows."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)
    count = lambda t: F.size(F.filter("w", lambda x: x == F.lit(t)))
    return docs.select("doc_id", found.alias("w")).select("doc_id", F.size("w").alias("length"), F.array(*map(count, terms)).alias("tf"))


def bm25(docs: DataFrame, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of the documents with a term, by BM25 (Robertson and Zaragoza, 2009)."""
    counts = term_counts(docs, terms)
    held = F.array(*(F.count_if(F.get("tf", i) > 0) for i in range(len(terms))))
    n, mean, dfs = counts.agg(F.count("*"), F.avg("length"), held).first()
    score = F.lit(0.0)
    for i, df in enumerate(dfs):
        tf = F.get("tf", i)
        idf = F.ln(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / (mean or 1.0)))
    return counts.select("doc_id", score.alias("score")).where("score > 0")


def phrase_docs(docs: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """(doc_id, n): documents with the words next to each other, and how often."""
    rows = postings(docs).where(F.col("term").isin(*phrase))
    starts = [rows.where(F.col("term") == w).select("doc_id", (F.col("pos") - i).alias("at")) for i, w in enumerate(phrase)]
    found = starts[0]
    for other in starts[1:]:
        found = found.join(other, ["doc_id", "at"])
    return found.groupBy("doc_id").agg(F.count("*").alias("n"))


def name_search(names: DataFrame, query: str, n: int, label_bonus: float = 0.5) -> DataFrame:
    """(place, id, label): the first ``n`` entries for a free text among names (id, label, name, is_label).

    Entries with a name equal to the query, but for case and space, come first: by their labels before other names, then the
    shorter label, then id. Then come entries with a name that holds every word of the query, by the BM25 score of that name,
    rounded to six places, with a bonus for labels, then id. An entry has its best place; a query without words finds exact names only.
    """
    asked = " ".join(query.lower().split())
    terms = list(dict.fromkeys(re.findall(r"\w+", asked)))
    exact = names.where(F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))) == asked)
    found = exact.select("id", "label", F.struct(F.lit(0).alias("stage"), (~F.col("is_label")).cast("double").alias("by"), F.length("label").alias("size")).alias("order"))
    if terms:
        docs = names.select(F.struct("id", "label", "is_label", "name").alias("doc_id"), F.col("name").alias("text"))
        held = term_counts(docs, terms).where(F.forall("tf", lambda x: x > 0)).select("doc_id")
        score = F.round("score", 6) + F.when(F.col("doc_id.is_label"), label_bonus).otherwise(0.0)
        ranked = bm25(docs, terms).join(held, "doc_id", "left_semi")
        found = found.unionByName(ranked.select("doc_id.id", "doc_id.label", F.struct(F.lit(1).alias("stage"), (-score).alias("by"), F.lit(0).alias("size")).alias("order")))
    best = found.groupBy("id").agg(F.min(F.struct("order", "label")).alias("best")).orderBy("best.order", "id").limit(n)
    return best.select(F.row_number().over(Window.orderBy("best.order", "id")).alias("place"), "id", F.col("best.label").alias("label"))


def latest_first(index: Index, docs: DataFrame, words: Sequence[str], every: bool, weights: Mapping[str, float], n: int, skip: int = 0) -> DataFrame:
    """(doc_id, year, score, total): a page of docs (doc_id, year) that hold ``every`` one of the words, or any, the latest year first,
    then the best score, then the smallest number; ``total`` counts all that match. Without words nothing matches."""
    asked = [w for text in words for w in re.findall(r"[^\W_]+", text.lower())]
    found = weighted_bm25(index, asked, weights)
    if every:
        held = index.postings.where(F.col("term").isin(*set(asked))).groupBy("doc_id").agg(F.count_distinct("term").alias("held"))
        found = found.join(held.where(F.col("held") == len(set(asked))), "doc_id", "left_semi")
    rows = settle(docs.select("doc_id", "year").join(found, "doc_id").select("doc_id", "year", F.round("score", 6).alias("score")), "found")
    page = rows.orderBy(F.desc_nulls_last("year"), F.desc("score"), "doc_id").offset(skip).limit(n)
    return page.withColumn("total", F.lit(rows.count()))
