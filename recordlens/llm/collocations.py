"""Phrases whose words occur together more often than apart, from a weighted de Bruijn graph.

An edge is a run of ``longest`` words within a piece, between the node of its first and the node
of its last ``longest - 1`` words. A piece is followed by ends, so that every word begins one
edge; edges that hold an end are the corrections for the ends of pieces. All edges are counted;
the count of a node is the flow that leaves it, ends included, and shorter phrases are prefixes
of nodes in turn. A node whose whole flow enters by one edge and leaves by one is compacted into
the path through it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm import words as W
from recordlens.llm.scratch import Scratch

#: Bytes that end a piece, and bytes that end a word within one.
BREAKS = W.byte_set(b".,;:!?\n\x0b\x0c\r")
INSIDE = ~(BREAKS | W.byte_set(b" \t"))
#: Text whose edges are counted together before they are sent.
BLOCK_BYTES = 8 << 20
#: Text whose edges meet in one bucket.
BUCKET_BYTES = 4 << 20
#: Names that are Python objects at a time.
SOME_NAMES = 1 << 16
#: Buckets that a block is dealt to at a time; more are reached in further rounds.
FAN_OUT = 1024
MOST_PARTITIONS = 20_000
LANG = "und"
PACKED = "bucket long, size long, packed binary"
COUNTED = f"{PACKED}, lang string, phrase string, words int, f long"


class Edges:
    """Counted runs: ``ids`` has a column for the language and one per word, as numbers of
    ``names`` from 1; 0 stands for an end. Rows are distinct and ordered by their columns."""

    def __init__(self, names: pa.Array, ids: list[np.ndarray], counts: np.ndarray):
        self.names = names
        key, room = ids[0].astype(np.int64), len(names) + 1
        for column in ids[1:]:
            if len(key) and (int(key.max()) + 1) * room >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
            key *= room
            key += column
        order = np.argsort(key)
        first = np.flatnonzero(_changes(key[order]))
        del key
        self.counts = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
        order = order[first]
        self.ids = [c[order] for c in ids]

    def prefixes(self) -> Edges:
        """The same with a word less: the flow that leaves each node."""
        return Edges(self.names, self.ids[:-1], self.counts)

    def hashes(self) -> np.ndarray:
        own, total = np.zeros(len(self.names) + 1, np.uint64), np.zeros(len(self.counts), np.uint64)
        for i in range(0, len(self.names), SOME_NAMES):
            some = self.names.slice(i, SOME_NAMES).to_pylist()
            own[i + 1:i + 1 + len(some)] = list(map(xxhash.xxh64_intdigest, some))
        for column in self.ids:
            total = (total ^ own[column]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        return total

    def pack(self, buckets: int, step: int = 1) -> Iterator[pa.RecordBatch]:
        """A row per bucket that has edges: its own names and numbers, compressed. Buckets go in
        groups of ``step``."""
        bucket = (self.hashes() % np.uint64(buckets)).astype(np.int64) // step
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(np.flatnonzero(_changes(bucket[order])), len(order))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[a:b]
            used, inverse = np.unique(np.concatenate([c[rows] for c in self.ids]),
                                      return_inverse=True)
            inverse = inverse + (used[0] != 0)
            names = self.names.take(pa.array(used[used > 0] - 1))
            ends = np.frombuffer(names.buffers()[1], np.int64)[:len(names) + 1]
            body = b"".join([
                np.array([len(names), len(rows), len(self.ids)], "<i8").tobytes(),
                np.diff(ends).astype("<u4").tobytes(), inverse.astype("<u4").tobytes(),
                self.counts[rows].astype("<i8").tobytes(),
                memoryview(names.buffers()[2])[:ends[-1]] if len(names) else b""])
            packed = pa.compress(body, "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[rows[0]])], pa.int64()), pa.array([len(body)], pa.int64()),
                 pa.array([packed], pa.binary())], ["bucket", "size", "packed"])

    def phrases(self, least: int) -> pa.RecordBatch:
        """The runs without an end that occur ``least`` times or more."""
        rows = np.flatnonzero((self.counts >= least) & (self.ids[-1] > 0))
        parts = [self.names.take(pa.array(c[rows] - 1)).cast(pa.large_string()) for c in self.ids]
        text = parts[1] if len(parts) == 2 else pc.binary_join_element_wise(
            *parts[1:], pa.scalar(" ", pa.large_string()))
        return _found(parts[0], text, len(parts) - 1, self.counts[rows])

    def totals(self) -> pa.RecordBatch:
        """All words of each language, as the phrase of no words."""
        langs, at = np.unique(self.ids[0], return_inverse=True)
        names = self.names.take(pa.array(langs - 1)).cast(pa.large_string())
        sums = np.zeros(len(langs), np.int64)
        np.add.at(sums, at, self.counts)
        return _found(names, pa.array([""] * len(langs)), 0, sums)


def _changes(values: np.ndarray) -> np.ndarray:
    return np.append(True, values[1:] != values[:-1])[:len(values)]


def _found(lang, phrase, words: int, f: np.ndarray) -> pa.RecordBatch:
    n = len(f)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
         lang.cast(pa.string()), phrase.cast(pa.string()),
         pa.array(np.full(n, words, np.int32)), pa.array(f.astype(np.int64))],
        [c.split()[0] for c in COUNTED.split(", ")])


def _wide(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
         pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
        [c.split()[0] for c in COUNTED.split(", ")])


def unpack(rows: list[tuple[int, bytes]]) -> Edges:
    """The edges of several packed rows together."""
    names, columns, counts, base = [], [], [], 0
    for size, packed in rows:
        body = memoryview(pa.decompress(packed, size, "zstd", asbytes=True))
        n, m, k = np.frombuffer(body[:24], "<i8").tolist()
        at = 24 + 4 * n
        ends = np.cumsum(np.append(0, np.frombuffer(body[24:at], "<u4"))).astype(np.int64)
        ids = np.frombuffer(body[at:at + 4 * k * m], "<i4").reshape(k, m)
        at += 4 * k * m
        counts.append(np.frombuffer(body[at:at + 8 * m], "<i8"))
        names.append(pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(body[at + 8 * m:])]))
        columns.append(np.where(ids > 0, ids + np.int32(base), np.int32(0)))
        base += n
    coded = pa.concat_arrays(names).dictionary_encode()
    number = np.append(np.int32(0), coded.indices.to_numpy() + np.int32(1))
    return Edges(coded.dictionary, list(number[np.concatenate(columns, axis=1)]),
                 np.concatenate(counts))


def count_runs(langs: pa.Array, texts: pa.Array, longest: int) -> Edges:
    """Every word of the texts with the words behind it in its piece, counted."""
    data, bounds = W.lowered(texts)
    found, at = W.words(data, bounds, INSIDE)
    row = W.owner(bounds, at)
    piece = np.cumsum(BREAKS[data], dtype=np.int64)[at] if len(at) else at
    langs = pc.fill_null(langs.cast(pa.large_binary()), LANG.encode())
    both = pa.concat_arrays([langs, found]).dictionary_encode()
    number = both.indices.to_numpy() + np.int32(1)
    columns = [number[:len(langs)][row], number[len(langs):]]
    joined = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False)[:len(at)]
    for _ in range(longest - 1):
        behind = np.append(columns[-1][1:], np.int32(0))[:len(at)]
        columns.append(np.where(joined, behind, np.int32(0)))
    return Edges(both.dictionary, columns, np.ones(len(at), np.int64))


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Edges]:
    """Edges of each bucket in rows ordered by bucket; with ``most``, in parts of so many bytes."""
    held: list[tuple[int, bytes]] = []
    bucket, size = None, 0
    for batch in batches:
        for b, s, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (b != bucket or most and size > most):
                yield unpack(held)
                held, size = [], 0
            bucket = b
            size += s
            held.append((s, packed))
    if held:
        yield unpack(held)


def counts(docs: DataFrame, longest: int, least: int, scratch: Scratch, lang_col: str = "lang",
           text_col: str = "text", block_bytes: int = BLOCK_BYTES,
           bucket_bytes: int = BUCKET_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """lang, phrase, words, f: all phrases of 1 to ``longest`` words that occur ``least`` times or
    more within pieces, and per language the phrase of no words with the number of all words.

    Equal runs of a block of text are counted before they are sent, so a run has at most one row
    per block, however often it occurs, and buckets go by the whole run: no word or node is a key.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = -(-size // bucket_bytes) or 1
    partitions = min(buckets, MOST_PARTITIONS)
    step = 1
    while -(-buckets // step) > fan_out:
        step *= fan_out

    def first(batches, step=step):
        held, bytes_ = [], 0
        for batch in batches:
            for part in W.blocks(batch, 1):
                held.append(part)
                bytes_ += part.nbytes
                if bytes_ >= block_bytes:
                    yield from _counted(held).pack(buckets, step)
                    held, bytes_ = [], 0
        if held:
            yield from _counted(held).pack(buckets, step)

    def _counted(held):
        table = pa.Table.from_batches(held).combine_chunks()
        return count_runs(*(pa.concat_arrays(c.cast(pa.large_binary()).chunks)
                            for c in table.columns), longest)

    packed = rows.mapInArrow(first, PACKED)
    while step > 1:
        step //= fan_out

        def deal(batches, step=step):
            for edges in _grouped(batches, 4 * block_bytes):
                yield from edges.pack(buckets, step)

        packed = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket") \
            .mapInArrow(deal, PACKED)
    found = []
    for level in range(longest, 0, -1):
        def merge(batches, level=level):
            for edges in _grouped(batches, 0):
                yield edges.phrases(least)
                if level == 1:
                    yield edges.totals()
                else:
                    edges = edges.prefixes()
                    yield from map(_wide, edges.pack(buckets))
                del edges
                pa.default_memory_pool().release_unused()  # the next bucket follows

        table = scratch.keep(packed.repartition(partitions, "bucket")
                             .sortWithinPartitions("bucket").mapInArrow(merge, COUNTED),
                             f"level{level}")
        found.append(table.where("packed IS NULL").select("lang", "phrase", "words", "f"))
        packed = table.where("packed IS NOT NULL").select("bucket", "size", "packed")
    whole = functools.reduce(DataFrame.unionByName, found)
    totals = whole.where("words = 0").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return whole.where("words > 0").unionByName(totals)


def _nodes(longest: int) -> tuple[str, str]:
    return (f"substring_index(phrase, ' ', {longest - 1})",
            f"substring_index(phrase, ' ', {1 - longest})")


def unary_links(counted: DataFrame, longest: int) -> DataFrame:
    """lang, node, edge, behind: the nodes whose whole flow enters by ``edge`` and leaves by
    ``behind``. No path of them closes: a cycle would have neither start nor end of a piece."""
    first, last = _nodes(longest)
    edges = counted.where(F.col("words") == longest)
    nodes = counted.where(F.col("words") == longest - 1) \
        .select("lang", F.col("phrase").alias("node"), "f")
    entering = edges.select("lang", F.expr(last).alias("node"), "f", F.col("phrase").alias("edge"))
    leaving = edges.select("lang", F.expr(first).alias("node"), "f",
                           F.col("phrase").alias("behind"))
    on = ["lang", "node", "f"]
    return entering.join(nodes, on).join(leaving, on).select("lang", "node", "edge", "behind")


def paths(counted: DataFrame, longest: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The edges compacted into paths (lang, path: the words, f), and the nodes inside them.

    All edges of a path have its count, and so have the nodes inside it. Each round doubles the
    distance that an edge looks back. A path lies within every piece that holds one of its edges,
    so it is no longer than the shortest of them.
    """
    links = scratch.keep(unary_links(counted, longest), "links")
    edges = counted.where(F.col("words") == longest).select("lang", "phrase", "f")
    back = edges.join(links.select("lang", F.col("behind").alias("phrase"), "edge"),
                      ["lang", "phrase"], "left") \
        .select("lang", "phrase", "f", F.coalesce("edge", "phrase").alias("head"),
                F.col("edge").isNotNull().cast("long").alias("at"))
    back, n = scratch.keep(back, "back0"), 0
    while back.where(F.col("at") == 1 << n).limit(1).count():
        further = back.where("at > 0").select("lang", F.col("phrase").alias("head"),
                                              F.col("head").alias("to"), F.col("at").alias("more"))
        back = back.join(further, ["lang", "head"], "left").select(
            "lang", "phrase", "f", F.coalesce("to", "head").alias("head"),
            (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
        n += 1
        back = scratch.keep(back, f"back{n}")
    ordered = F.array_sort(F.collect_list(F.struct("at", "phrase")))
    whole = back.groupBy("lang", "head", "f").agg(ordered.alias("run")).select(
        "lang", F.concat(F.split("head", " "), F.transform(
            F.slice("run", 2, F.greatest(F.size("run") - 1, F.lit(0))),
            lambda r: F.substring_index(r["phrase"], " ", -1))).alias("path"), "f")
    return whole, links.select("lang", "node")


def _score(a: str, left: str, right: str) -> str:
    """floor(1000000 * a * a / (left * right)) by exact decimals, for counts up to 10^15."""
    big = "cast({} as decimal(15, 0))".format
    return (f"cast(1000000 as decimal(7, 0)) * {big(a)} * {big(a)} div "
            f"({big(left)} * {big(right)})")


def collocations(docs: DataFrame, longest: int = 3, shortest: int = 2, least: int = 10,
                 share: int = 50, top: int | None = None, lang_col: str = "lang",
                 text_col: str = "text", **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: per language, the phrases of ``shortest`` to
    ``longest`` words that occur ``least`` times or more, best first.

    A phrase is cut in two where that scores least (ties: the earliest place); l and r are the
    counts of both parts, n counts all words of the language. Phrases that lie in a longer one
    with at least ``share`` percent of their count are dropped. Equal scores are ordered by
    count, then by the bytes of the phrase. Null texts are empty, null languages ``und``; equal
    rows count each; an empty table gives no rows; other columns are ignored. Long texts are
    cut into blocks of rows, never within a text.
    """
    if not 1 < shortest <= longest or not 0 < share <= 100 or least < 1:
        raise ValueError("1 < shortest <= longest, 0 < share <= 100 and least > 0 are needed")
    scratch = Scratch(docs.sparkSession, "collocations")
    counted = scratch.keep(counts(docs, longest, least, scratch, lang_col, text_col, **sizes),
                           "counted")
    whole, inside = paths(counted, longest, scratch)
    # a node inside a path lies in an edge of the same count, so it is never reported itself
    shorter = scratch.keep(counted.where(F.col("words").between(1, longest - 1)).join(
        inside.withColumnRenamed("node", "phrase"), ["lang", "phrase"], "left_anti"), "shorter")
    windows = F.transform(F.sequence(F.lit(1), F.size("path") - longest + 1),
                          lambda i: F.array_join(F.slice("path", i, longest), " "))
    runs = whole.select("lang", F.explode(windows).alias("phrase"),
                        F.lit(longest).alias("words"), "f")
    found = scratch.keep(runs.unionByName(shorter.where(F.col("words") >= shortest)), "candidates")
    kept = found
    if shortest < longest:
        pieces = F.expr(f"""flatten(transform(sequence({shortest}, words - 1), m -> transform(
            sequence(1, words - m + 1),
            i -> array_join(slice(split(phrase, ' '), i, m), ' '))))""")
        longer = found.where(F.col("words") > shortest) \
            .select("lang", F.explode(pieces).alias("phrase"), "f") \
            .groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        kept = found.join(longer, ["lang", "phrase"], "left") \
            .where(F.expr(f"most IS NULL OR 100 * most < {share} * f")).drop("most")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words",
                       F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")) \
        .withColumn("left", F.expr("substring_index(phrase, ' ', k)")) \
        .withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(shorter.select("lang", F.col("phrase").alias(side),
                                        F.col("f").alias(name)), ["lang", side], "left")
    cuts = cuts.withColumns({x: F.coalesce(x, "a") for x in ("l", "r")})  # inside a path
    best = cuts.withColumn("cut", F.struct(F.expr(_score("a", "l", "r")).alias("score"),
                                           "k", "l", "r")) \
        .groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score") \
        .withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = counted.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang") \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
