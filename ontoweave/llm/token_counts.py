"""Word-piece counts by a linear longest-match automaton (Song et al., 2021).

The vocabulary is a trie. Each node has a failure link to the node that the unread part of its string reaches once the
longest pieces are taken off, and the number of pieces taken off on that way. Reading a word once and adding those
numbers gives the number of its greedy longest-match pieces; no piece is built.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, table
from .packing import byte_alphabet

#: Added to a byte's symbol when it ends its word.
FINAL = 256
_SYMBOLS = 512


class LongestMatch:
    """Greedy longest-match piece counts of symbol strings; every symbol of a string must be a piece of its own."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.next: dict[int, int] = {}
        is_piece = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                child = self.next.get(node * _SYMBOLS + symbol)
                if child is None:
                    child = self.next[node * _SYMBOLS + symbol] = len(is_piece)
                    is_piece.append(False)
                node = child
            is_piece[node] = True
        self.link, self.popped = [-1] * len(is_piece), [0] * len(is_piece)
        children: list[list[tuple[int, int]]] = [[] for _ in is_piece]
        for key, child in self.next.items():
            children[key // _SYMBOLS].append((key % _SYMBOLS, child))
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for symbol, node in children[parent]:
                todo.append(node)
                if is_piece[node]:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                at, count = self.link[parent], self.popped[parent]
                while at >= 0 and at * _SYMBOLS + symbol not in self.next:
                    at, count = self.link[at], count + self.popped[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.next[at * _SYMBOLS + symbol], count

    def count(self, symbols: Iterable[int]) -> int:
        node = total = 0
        step, link, popped = self.next, self.link, self.popped
        for symbol in symbols:
            while (child := step.get(node * _SYMBOLS + symbol)) is None:
                if node == 0 or link[node] < 0:
                    raise ValueError(f"symbol {symbol} is no piece")
                total += popped[node]
                node = link[node]
            node = child
        while node:
            total += popped[node]
            node = link[node]
        return total


class WordPieces:
    """Counts for texts under a word-level vocabulary file whose pieces are byte strings, final ones marked ``</w>``."""

    def __init__(self, path: str, most: int = 200_000):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file["added_tokens"]}
        visible = byte_alphabet()
        self.pieces = [self._symbols(t, visible) for t in file["model"]["vocab"] if t not in special]
        self.automaton = LongestMatch(self.pieces)
        # Fixed value: the pre-tokeniser pattern of the vocabulary file.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.known, self.most = {}, most

    @staticmethod
    def _symbols(token: str, visible: dict[str, int]) -> tuple[int, ...]:
        final = token.endswith("</w>")
        bytes_ = [visible[c] for c in (token[:-4] if final else token)]
        return (*bytes_[:-1], bytes_[-1] + FINAL * final)

    def chunk(self, chunk: str) -> int:
        """Pieces of a text without white space."""
        total = 0
        for word in self.words(chunk):
            data = word.encode()
            total += self.automaton.count((*data[:-1], data[-1] + FINAL))
        return total

    def count(self, text: str) -> tuple[int, int]:
        """(words, pieces) of the whole text; counts of words met before come from a bounded cache."""
        chunks = unicodedata.normalize("NFC", text).lower().split()
        known = self.known
        found = list(map(known.get, chunks))
        if None in found:
            fresh = {c: self.chunk(c) for c in {c for c, n in zip(chunks, found, strict=True) if n is None}}
            found = [fresh[c] if n is None else n for c, n in zip(chunks, found, strict=True)]
            if len(known) < self.most:
                known.update(fresh)
        return len(chunks), sum(found)


@lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    """One for each Python worker."""
    return WordPieces(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document's whole text, without a shuffle.

    Texts are put in NFC and lower case; words are runs between white space, and the vocabulary's own pattern cuts
    them before matching. Null and empty texts count 0; null ids and repeated rows stay; an empty table gives no rows;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = word_pieces(path).count
        for batch in by_bytes(batches, 1):
            got = [count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (zip(*got, strict=True) if got else ([], [])))], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_vocabulary())
