"""Ranked lexical search: exact maximum inner products by sparse ball trees.

A document is a sparse vector of integers, one for each term that it shares with the
queries; a query is a sparse vector of integer term weights, and a score is their inner
product. The documents of a task are taken in blocks, and a block becomes a ball tree: a
node has the centroid c of its documents and a radius r around it, so that no document
below scores more than q.c + |q| r, where q keeps the terms that occur below. These bounds are computed in doubles and rounded up by
more than any rounding can have lost. A query visits nodes best bound first and ends when
the best bound left cannot reach its 20th result; what it meets in a leaf is scored in
64-bit integers. Nothing is left out: the result is exact whatever the bounds prune.

Tasks only send their best documents of every query; a window picks the final ones.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import pieces, stored

#: Entries and documents of a block, documents of a leaf.
BLOCK_ENTRIES, BLOCK_DOCS, LEAF_DOCS = 1 << 20, 1 << 14, 64
#: (query, term) pairs that one pass over the documents looks for; more queries take more passes.
QUERY_TERMS = 1_000_000
#: Share by which bounds are raised; 53-bit sums of up to a million terms lose less.
SLACK = 1e-9

# Letters and digits of ASCII stay (A-Z in lower case), as do all bytes of other characters; the rest separates terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class Vectors:
    """Sparse rows: ``start`` has a place more than rows, ``at`` rises inside a row."""

    start: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' entries and where each row begins among them. No row is empty."""
        n = self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(n)
        places = np.repeat(self.start[rows] - (ends - n), n) + np.arange(ends[-1])
        return places, ends - n

    def dot(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        places, begins = self.entries(rows)
        return np.add.reduceat(dense[self.at[places]] * self.value[places], begins)


class BallTree:
    """``exact``: the rows of integers; nodes are (centroid places, centroid, radius, rows or None, children)."""

    def __init__(self, exact: Vectors, width: int, leaf: int = LEAF_DOCS):
        self.exact, self.width, self.leaf = exact, width, leaf
        self.real = Vectors(exact.start, exact.at, exact.value.astype(float))
        self.square = np.add.reduceat(self.real.value**2, exact.start[:-1])
        self.nodes: list[tuple] = []
        todo = [(np.arange(len(exact.start) - 1), -1)]
        while todo:
            rows, parent = todo.pop()
            place = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][4].append(place)
            centre, distance = self._ball(rows)
            some = np.flatnonzero(centre)
            inner = len(rows) > self.leaf
            self.nodes.append((some, centre[some], float(distance.max()), None if inner else rows, []))
            if inner:
                todo.extend((part, place) for part in self._halves(rows, rows[distance.argmax()]))

    def _ball(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid, and an upper bound of each row's distance from it."""
        places, _ = self.real.entries(rows)
        centre = np.bincount(self.real.at[places], self.real.value[places], self.width) / len(rows)
        own = centre @ centre
        squared = self.square[rows] - 2 * self.real.dot(rows, centre) + own
        return centre, np.sqrt(np.maximum(squared, 0) + SLACK * (self.square[rows] + own)) * (1 + SLACK)

    def _dense(self, row: int) -> np.ndarray:
        places, _ = self.real.entries(np.array([row]))
        out = np.zeros(self.width)
        out[self.real.at[places]] = self.real.value[places]
        return out

    def _halves(self, rows: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
        """Halves by the projection on the line from a far row to the row farthest from it."""
        a = self._dense(far)
        b = self._dense(rows[(self.square[rows] - 2 * self.real.dot(rows, a)).argmax()])
        order = np.argsort(self.real.dot(rows, a - b), kind="stable")
        return rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]

    def bound(self, node: tuple, query: np.ndarray) -> float:
        """No document below scores more. Terms that no document below has take no part."""
        own = query[node[0]]
        norm = math.sqrt(own @ own) * (1 + SLACK)
        return (float(own @ node[1]) + norm * node[2]) * (1 + SLACK) + 1 if norm else 0.0

    def search(self, query: np.ndarray, best: Best, names: list[list]) -> int:
        """Offer the rows that may be among the best; returns the number of leaves visited."""
        real = query.astype(float)
        agenda = [(-self.bound(self.nodes[0], real), 0)]
        visited = 0
        while agenda:
            bound, place = heapq.heappop(agenda)
            if -bound < max(best.least, 1):
                break  # a score equal to the last one may still win by its doc_id
            _, _, _, rows, children = self.nodes[place]
            if rows is None:
                for c in children:
                    heapq.heappush(agenda, (-self.bound(self.nodes[c], real), c))
                continue
            visited += 1
            scores = self.exact.dot(rows, query)
            good = np.flatnonzero((scores > 0) & (scores >= best.least))
            best.offer([(-s, n) for s, r in zip(scores[good].tolist(), rows[good].tolist(), strict=True) for n in names[r]])
        return visited


class Best:
    """The ``k`` first (negative score, name) pairs seen; ``least``: the score to reach."""

    def __init__(self, k: int):
        self.k, self.found, self.least = k, [], 0

    def offer(self, more: list[tuple]) -> None:
        if more:
            self.found = sorted(self.found + more)[: self.k]
            if len(self.found) == self.k:
                self.least = -self.found[-1][0]


def _name(doc: int | None) -> tuple:
    """Sorts documents without an id behind all others."""
    return (doc is None, doc or 0)


def search_block(rows: list[tuple], queries: list[tuple[np.ndarray, np.ndarray]], best: list[Best], k: int) -> None:
    """One block's tree, asked by every query. rows: (doc_id, places, values), none of them without entries.

    Equal vectors are one row; of their documents the ``k`` with the smallest ids can be among the best.
    """
    same: dict[tuple[bytes, bytes], list] = {}
    for doc, at, value in rows:
        same.setdefault((at.tobytes(), value.tobytes()), []).append(_name(doc))
    names = [sorted(n)[:k] for n in same.values()]
    ats = [np.frombuffer(a, np.int32) for a, _ in same]
    here, local = np.unique(np.concatenate(ats), return_inverse=True)
    values = np.concatenate([np.frombuffer(v, np.int64) for _, v in same])
    start = np.cumsum([0, *map(len, ats)])
    tree = BallTree(Vectors(start, local, values), len(here))
    dense = np.zeros(len(here), np.int64)
    for (at, weight), b in zip(queries, best, strict=True):
        place = np.minimum(np.searchsorted(here, at), len(here) - 1)
        has = here[place] == at
        if has.any():
            dense[place[has]] = weight[has]
            tree.search(dense, b, names)
            dense[place[has]] = 0


def _count_terms(docs: DataFrame, key: str, text: str, places: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, at, tf) of documents with a term: number of terms, and packed places and counts of those in ``places``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            docs, lengths, ats, counts = [], [], [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if found := terms(t):
                    some = sorted(Counter(filter(None.__ne__, map(places.get, found))).items())
                    docs.append(doc)
                    lengths.append(len(found))
                    ats.append(np.array([a for a, _ in some], np.int32).tobytes())
                    counts.append(np.array([c for _, c in some], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ats, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "n", "at", "tf"],
            )

    return docs.select(F.col(key).cast("long"), text).mapInArrow(count, "doc_id bigint, n bigint, at binary, tf binary")


def _document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["at", "df"])

    out = np.zeros(size, np.int64)
    for r in counted.select("at").mapInArrow(histogram, "at bigint, df bigint").groupBy("at").agg(F.sum("df").alias("df")).collect():
        out[r["at"]] = r["df"]  # at most QUERY_TERMS rows
    return out


def _search(counted: DataFrame, queries: list[tuple], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): every task's best documents of every query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        asked = [(at, weight) for _, at, weight in queries]
        block: list[tuple] = []
        held = 0
        for b in pieces(batches):
            for doc, n, at, tf in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tf = np.frombuffer(tf, np.int32).astype(np.int64)
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                block.append((doc, np.frombuffer(at, np.int32), (1_000_000_000 * tf) // (1000 * tf + 12 * m)))
                held += len(tf)
                if held >= BLOCK_ENTRIES or len(block) >= BLOCK_DOCS:
                    search_block(block, asked, best, k)
                    block, held = [], 0
        if block:
            search_block(block, asked, best, k)
        found = [(q[0], None if name[0] else name[1], -s) for q, b in zip(queries, best, strict=True) for s, name in b.found]
        columns = list(zip(*found, strict=True)) if found else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    some = counted.where(F.octet_length("at") > 0)
    return some.mapInArrow(search, "item bigint, doc_id bigint, score bigint")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", query_terms: int = QUERY_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0.

    Equal scores go by ascending document id, documents without an id last. Every row of
    ``items`` is a query of its own, and every row of ``docs`` a document, so repeated rows
    rank side by side. Null and empty texts have no terms: such documents are not counted
    and such items find nothing. Without documents or items the result is empty. Texts are
    read whole. Queries are dealt by hash to passes of about ``query_terms`` (query, term)
    pairs, so that what a worker holds of them is bounded; one pass looks for all where
    they are fewer.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            counts = [Counter(x.decode() for x in terms(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([list(c) for c in counts], pa.list_(pa.string())),
                 pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], ["item", "item_id", "terms", "counts"],
            )

    kind = items.schema[item_key].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))
    asked = stored(numbered.mapInArrow(cut, f"item bigint, item_id {kind}, terms array<string>, counts array<bigint>"), "queries")
    passes = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // query_terms)
    found = None
    for p in range(passes):
        mine = asked.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("item"), F.lit(passes)) == p)).orderBy("item").collect()
        places: dict[bytes, int] = {}
        for r in mine:
            for t in r["terms"]:
                places.setdefault(t.encode(), len(places))
        counted = stored(_count_terms(docs, key, text, places), "term-counts")
        n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
        df = _document_frequencies(counted, len(places)).tolist()
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df], np.int64)
        queries = []
        for r in mine:
            at = np.array([places[t.encode()] for t in r["terms"]], np.int32)
            queries.append((r["item"], at, weight[at] * np.array(r["counts"], np.int64)))
        part = _search(counted, queries, n_docs, n_terms or 1, k)
        found = part if found is None else found.union(part)
    if found is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
