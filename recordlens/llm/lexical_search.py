"""Ranked lexical search: every document scored for every item by dense matrix products.

Items go in tiles, whose terms are numbered compactly; a block of documents becomes a matrix of
impacts over these terms, and one product of float64 matrices scores the block for the tile.
All weights and impacts are integers, and a product's columns are bounded so that every partial
sum stays below 2^53: the sums are exact in any order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm import words as W

#: Terms are runs of ASCII letters, digits and all characters beyond ASCII.
INSIDE = W.byte_set([b for b in range(256) if b >= 128 or chr(b).isalnum()])
#: Text of the items that are searched for together; more go in further passes.
PASS_BYTES = 8 << 20
#: Items and terms of a tile, and documents of a block.
TILE_ITEMS, TILE_TERMS, BLOCK_DOCS = 16, 1024, 512
#: Above any impact: 10^9 tf / (1000 tf + 12 m) < 10^6.
MOST_IMPACT = 1_000_000
EXACT = 1 << 53


class Items(NamedTuple):
    """Items of one pass: ids, terms, and the occurrences of terms in items, as numbers."""

    ids: list[int | None]
    terms: pa.Array
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


class Tile(NamedTuple):
    """Some items' weights over some terms. ``last``: their other terms came before."""

    items: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    last: bool


def found_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, lower-cased in A-Z only, and the text of each."""
    data, bounds = W.lowered(texts)
    terms, at = W.words(data, bounds, INSIDE)
    return terms, W.owner(bounds, at)


def coded(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray,
                                                          np.ndarray]:
    """Number of terms of each text, and text, term number and occurrences of every distinct
    term of a text that is in the vocabulary."""
    terms, row = found_terms(texts)
    lengths = np.bincount(row, minlength=len(texts))
    number = pc.index_in(terms, value_set=vocabulary)
    known = number.is_valid().to_numpy(zero_copy_only=False)
    pairs = row[known] * np.int64(max(len(vocabulary), 1)) \
        + number.drop_null().to_numpy().astype(np.int64)
    pairs, times = np.unique(pairs, return_counts=True)
    return lengths, *np.divmod(pairs, max(len(vocabulary), 1)), times


def gather_items(rows: list[tuple[int | None, list[str]]]) -> Items:
    ids = [r[0] for r in rows]
    texts = pa.array(["\n".join(r[1]) for r in rows], pa.large_string())
    vocabulary = found_terms(texts)[0].unique()
    _, item, term, times = coded(texts, vocabulary)
    return Items(ids, vocabulary, item, term, times)


def weigh(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1)))
                     for d in df], np.int64)


def tiles(items: Items, weights: np.ndarray, tile_items: int = TILE_ITEMS,
          tile_terms: int = TILE_TERMS) -> Iterator[Tile]:
    """Items in their order, as many as fit. Terms of a tile go into a further matrix where they
    are too many, or where an item's sum could reach 2^53."""
    values = weights[items.term] * items.times
    for start in range(0, len(items.ids), tile_items):
        own = np.flatnonzero((items.item >= start) & (items.item < start + tile_items))
        terms = np.unique(items.term[own])
        some = np.arange(start, min(start + tile_items, len(items.ids)))
        whole = np.zeros((len(terms), len(some)), np.int64)
        whole[np.searchsorted(terms, items.term[own]), items.item[own] - start] = values[own]
        cut = [(a, b, part) for part in _exact_parts(whole)
               for a, b in _spans(part, tile_terms)]
        for n, (a, b, part) in enumerate(cut, 1):
            yield Tile(some, terms[a:b], part[a:b].astype(np.float64), n == len(cut))


def _exact_parts(weights: np.ndarray) -> Iterator[np.ndarray]:
    """Matrices that add up to the weights, none with a product of 2^53 or more."""
    while weights.any():
        part = np.minimum(weights, (EXACT - 1) // MOST_IMPACT)
        weights = weights - part
        yield part


def _spans(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(weights):
        sums = np.cumsum(weights[at:at + most], axis=0).max(axis=1) * MOST_IMPACT
        to = at + max(1, int(np.searchsorted(sums, EXACT)))
        yield at, to
        at = to


def impacts(times: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of terms that occur ``times`` in documents of ``lengths`` terms; integers only."""
    lean = 100 - 25 + 25 * lengths.astype(np.int64) * n_docs // max(n_terms, 1)
    times = times.astype(np.int64)
    return 1_000_000_000 * times // (1000 * times + 12 * lean)


class Best:
    """The best ``k`` documents of each item so far, equal scores by id, null ids last."""

    def __init__(self, k: int, n_items: int):
        self.k, self.held, self.size = k, [], 0
        self.least = np.ones(n_items, np.int64)  # a lower score can't get in any more

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray,
            null: np.ndarray) -> None:
        """scores: a row per document, a column per item."""
        doc, item = np.nonzero(scores >= self.least[items])
        if len(doc):
            self.held.append((items[item], -scores[doc, item], null[doc], ids[doc]))
            self.size += len(doc)
            if self.size > 4 * self.k * len(self.least) + 100_000:
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        rows = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        order = np.lexsort(rows[::-1])
        rows = [c[order] for c in rows]
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(len(order)) - first
        full = place == self.k - 1
        self.least[rows[0][full]] = -rows[1][full]
        rows = tuple(c[place < self.k] for c in rows)
        self.held, self.size = [rows], len(rows[0])
        return rows


def statistics(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each item term; at
    most a row per term of the pass comes to the driver."""
    vocabulary = items.terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for part in W.blocks(batch, 0):
                lengths, _, term, _ = coded(part.column(0), vocabulary)
                df += np.bincount(term, minlength=len(df))
                n_docs += int((lengths > 0).sum())
                n_terms += int(lengths.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n_docs, n_terms]))],
            ["term", "n"])

    rows = dict(docs.select("text").mapInArrow(count, "term long, n long")
                .groupBy("term").agg(F.sum("n")).collect())
    df = np.array([rows.get(t, 0) for t in range(len(vocabulary))], np.int64)
    return rows.get(-1, 0), rows.get(-2, 0), df


def search_pass(docs: DataFrame, items: Items, k: int, block_docs: int, tile_items: int,
                tile_terms: int) -> DataFrame:
    """item, doc_id, score: the best ``k`` of each partition of ``docs``."""
    n_docs, n_terms, df = statistics(docs, items)
    made = list(tiles(items, weigh(df, n_docs), tile_items, tile_terms))
    vocabulary, names = items.terms, pa.array(items.ids, pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, place = Best(k, len(names)), np.full(max(len(vocabulary), 1), -1)
        for batch in batches:
            for part in W.blocks(batch, 1):
                for at in range(0, part.num_rows, block_docs):
                    some = part.slice(at, block_docs)
                    ids = some.column(0)
                    null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                    ids = pc.fill_null(ids, 0).to_numpy()
                    lengths, doc, term, times = coded(some.column(1), vocabulary)
                    value = impacts(times, lengths[doc], n_docs, n_terms)
                    total = None
                    for tile in made:
                        place[tile.terms] = np.arange(len(tile.terms))
                        column = place[term]
                        own = column >= 0
                        place[tile.terms] = -1
                        impact = np.zeros((len(ids), len(tile.terms)))
                        impact[doc[own], column[own]] = value[own]
                        scores = (impact @ tile.weights).astype(np.int64)
                        total = scores if total is None else total + scores
                        if tile.last:
                            best.add(tile.items, total, ids, null)
                            total = None
        item, score, null, ids = best.cut()
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(item)), pa.array(ids, mask=null.astype(bool)), pa.array(-score)],
            ["item_id", "doc_id", "score"])

    return docs.mapInArrow(work, "item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id",
         text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
         pass_bytes: int = PASS_BYTES, block_docs: int = BLOCK_DOCS,
         tile_items: int = TILE_ITEMS, tile_terms: int = TILE_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0.

    Every document is scored for every item, in blocks of documents and tiles of items. Equal
    scores go by doc_id, null ids last. Rows that share an item id are one item of all their
    different texts; rows that share a doc_id are ranked apart. Null texts have no terms; items
    without terms and empty tables give no rows; other columns are ignored. A long text makes
    its block longer, not its matrix.

    Items come to the driver and the tasks in passes whose size is checked first, so any number
    of items takes bounded memory; each pass reads the documents twice. Each task hands over at
    most ``k`` rows an item.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"),
                         F.coalesce(item_text_col, F.lit("")).alias("text")) \
        .distinct().withColumn("size", F.octet_length("text") + 64)
    passes = -(-(items.agg(F.sum("size")).first()[0] or 0) // pass_bytes)
    found = None
    for some in _passes(items, passes, pass_bytes):
        rows = some.groupBy("item_id").agg(F.sort_array(F.collect_list("text")).alias("texts")) \
            .orderBy("item_id").collect()
        if rows:
            own = search_pass(docs, gather_items([tuple(r) for r in rows]), k, block_docs,
                              tile_items, tile_terms)
            found = own if found is None else found.unionByName(own)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("item_id", "rank", "doc_id", "score")


def _passes(items: DataFrame, n: int, most: int) -> Iterator[DataFrame]:
    """The items in parts of at most twice ``most`` bytes, or of one item id."""
    if n <= 1:
        yield items
        return
    while True:
        part = F.pmod(F.xxhash64(F.lit(17), "item_id"), F.lit(n))
        sizes = items.groupBy(part.alias("part")).agg(
            F.sum("size").alias("size"), F.count_distinct("item_id").alias("ids"))
        if not sizes.where((F.col("size") > 2 * most) & (F.col("ids") > 1)).limit(1).count():
            break
        n *= 2
    for i in range(n):
        yield items.where(part == i)
