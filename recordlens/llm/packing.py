"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing: every partition packs its own pieces best-fit decreasing and
emits the nearly full bins. The underfull bins of several partitions become the items of the
next round, and so on up a tree.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm import words as W
from recordlens.llm.scratch import Scratch

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
MEMBER = "doc_id long, piece int, start long, length int, ids_crc32 long, offset long"
BINS = f"done boolean, used int, members array<struct<{MEMBER.replace(' long', ': bigint').replace(' int', ': int')}>>"
_NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
#: Words remembered with their ids in a Python worker.
CACHED_WORDS = 300_000


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _special(path: str) -> re.Pattern:
    """Strings of special tokens, in any case: they are ids of their own within a text."""
    added = _tokenizer(path).get_added_tokens_decoder().values()
    return re.compile("|".join(re.escape(t.content) for t in added) or "(?!)", re.IGNORECASE)


@functools.lru_cache(maxsize=2)
def _known(path: str) -> dict[str, bytes]:
    return {"": b""}


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers.

    The tokenizer lower-cases, drops white space and never joins across it. So texts are taken
    apart there, every distinct piece is encoded once, and the rest is looked up.
    """
    known, special = _known(path), _special(path)
    split = [W.pieces(t, not special.search(t)) for t in texts]
    new = set().union(*split).difference(known)
    if len(known) + len(new) > CACHED_WORDS:
        known.clear()
        known[""] = b""
        new = set().union(*split)
    fresh = _encode(list(new), path)
    known.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
    get = {**fresh, **known}.__getitem__ if any(len(w) > 64 for w in fresh) else known.__getitem__
    return [b"".join(map(get, words)) for words in split]


def _encode(words: list[str], path: str) -> dict[str, bytes]:
    """Plain words share one call and are told apart by their word numbers; others go alone."""
    tokenizer, coded = _tokenizer(path), {}
    plain = [w for w in words if w.isalpha() and len(w) <= 64 and
             (w.isascii() or w == w.lower() and unicodedata.is_normalized("NFC", w))]
    for i in range(0, len(plain), 2000):
        some = plain[i:i + 2000]
        got = tokenizer.encode(" ".join(some), add_special_tokens=False)
        ids, at = np.array(got.ids, "<u4"), np.array(got.word_ids)
        ends = np.flatnonzero(np.r_[at[1:] != at[:-1], True]) + 1
        if len(ends) == len(some):
            data, ends = ids.tobytes(), (4 * ends).tolist()
            coded.update((w, data[a:b]) for w, a, b in zip(some, [0, *ends], ends, strict=False))
    rest = [w for w in words if w not in coded]
    for w, got in zip(rest, tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
        coded[w] = np.array(got.ids, "<u4").tobytes()
    return coded


def cut(texts: list[str | None], path: str, capacity: int, end_id: int) -> list[list[bytes]]:
    """Pieces of at most ``capacity`` ids; a null text is empty and still gets the end id."""
    end = np.array([end_id], "<u4").tobytes()
    coded = (data + end for data in token_bytes([t or "" for t in texts], path))
    return [[d[i:i + 4 * capacity] for i in range(0, len(d), 4 * capacity)] for d in coded]


def _some(batch: pa.RecordBatch, rows: int = 500) -> Iterator[tuple[list, list]]:
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every item: longest first, each into the fullest bin that still takes it.

    Bins are kept by their free space; a bit mask of the spaces in use finds the least one
    that suffices, so an item costs the same however many bins are open.
    """
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        above = mask >> length
        if above:
            space = (above & -above).bit_length() - 1 + length
            b = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            b, space, made = made, capacity, made + 1
        bins[item] = b
        if space > length:
            left = space - length
            if not free[left]:
                mask |= 1 << left
            free[left].append(b)
    return bins


def _merge(used: np.ndarray, starts: np.ndarray, ends: np.ndarray, members: list[pa.Array],
           capacity: int, full_at: int) -> pa.RecordBatch:
    """One best-fit round over items; item i holds members starts[i]:ends[i]."""
    bins = best_fit(used, capacity)
    order = np.lexsort((np.arange(len(used)), bins))
    before = np.cumsum(used[order]) - used[order]
    first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(order) else np.array([], bool)
    base = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
    sizes = (ends - starts)[order]
    take = np.repeat(starts[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    columns = [pa.array(np.empty(0), t) if not len(take) else m.take(pa.array(take))
               for m, t in zip(members, _TYPES, strict=True)]
    if len(take):
        shifted = np.asarray(columns[5]) + np.repeat(base, sizes)
        columns[5] = pa.array(shifted, pa.int64())
    n = int(first.sum())
    totals = np.bincount(bins, weights=used, minlength=n).astype(np.int32)
    counts = np.bincount(bins, weights=ends - starts, minlength=n).astype(np.int64)
    lists = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)),
        pa.StructArray.from_arrays(columns, names=list(_NAMES)))
    return pa.RecordBatch.from_arrays(
        [pa.array(totals >= full_at), pa.array(totals), lists], ["done", "used", "members"])


def _sliced(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def first_round(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, full_at: int,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack within each input partition. Only numbers leave it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rest = [], []
        for batch in batches:
            for docs_, texts in _some(batch):
                held, known = [], []
                for doc, pieces in zip(docs_, cut(texts, tokenizer, capacity, end_id),
                                       strict=True):
                    for n, data in enumerate(pieces):
                        held.append(doc)
                        known.append((n, n * capacity, len(data) // 4, zlib.crc32(data)))
                ids.append(pa.array(held, pa.int64()))
                rest.append(np.array(known, np.int64))
        if ids:
            ids, table = pa.concat_arrays(ids), np.concatenate(rest)
            columns = [ids, pa.array(table[:, 0], pa.int32()),
                       pa.array(table[:, 1]), pa.array(table[:, 2], pa.int32()),
                       pa.array(table[:, 3]), pa.array(np.zeros(len(ids), np.int64))]
            at = np.arange(len(ids))
            yield from _sliced(_merge(table[:, 2], at, at + 1, columns, capacity, full_at))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, BINS)


def next_round(bins: DataFrame, capacity: int, full_at: int) -> DataFrame:
    """Pack underfull bins, as items, within each partition."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        lists = table.column("members").chunk(0)
        bounds = np.asarray(lists.offsets)
        columns = [lists.values.field(i) for i in range(len(_NAMES))]
        yield from _sliced(_merge(table.column("used").to_numpy().astype(np.int64), bounds[:-1],
                                  bounds[1:], columns, capacity, full_at))

    return bins.mapInArrow(work, BINS)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1,
         slack: int = 16, fan_in: int = 8, bins_per_task: int = 50_000,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every document's tokens, end id included, in sequences of at most ``capacity``.

    Only longer documents are cut, into full pieces and a rest. Returns per piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset. Null texts count as empty and hold the
    end id alone; null ids and repeated rows are packed like any other; an empty table gives no
    rows; other columns are ignored.

    A round merges ``fan_in`` partitions into one, but never more than ``bins_per_task`` bins;
    the tree ends where it can't shrink any further, and what is left becomes sequences.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    full_at = capacity - slack
    made = [scratch.keep(first_round(docs, tokenizer, capacity, end_id, full_at, id_col,
                                     text_col), "round0")]
    parts = 1 << 30
    while True:
        open_bins = made[-1].where(~F.col("done"))
        seen = open_bins.select(F.spark_partition_id().alias("part")) \
            .agg(F.count("*"), F.countDistinct("part")).first()
        fewer = max(-(-min(parts, seen[1]) // fan_in), -(-seen[0] // bins_per_task))
        if not seen[0] or fewer >= parts:
            break
        merged = next_round(open_bins.repartition(fewer), capacity, full_at)
        made[-1] = made[-1].where("done")
        made.append(scratch.keep(merged, f"round{len(made)}"))
        parts = fewer
        if parts == 1:
            break
    bins = functools.reduce(DataFrame.unionByName, made)
    return bins.withColumn("sequence_id", F.monotonically_increasing_id()) \
        .select("sequence_id", F.explode("members").alias("m")) \
        .select("m.doc_id", "m.piece", "m.start", F.col("m.length").cast("long").alias("length"),
                "m.ids_crc32", "sequence_id", "m.offset")


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = 4096,
              end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id and input_ids, from unique document ids.

    Each group is one sequence, so at most ``capacity`` ids.
    """
    def pieces(batches):
        for batch in batches:
            for docs_, texts in _some(batch):
                found = [(doc, n, np.frombuffer(data, "<u4").astype(np.int32))
                         for doc, parts in zip(docs_, cut(texts, tokenizer, capacity, end_id),
                                               strict=True) for n, data in enumerate(parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (
                        pa.int64(), pa.int32(), pa.list_(pa.int32())), strict=True)],
                    ["doc_id", "piece", "ids"])

    ids = docs.select(F.col(id_col).cast("long"), F.col(text_col)) \
        .mapInArrow(pieces, "doc_id long, piece int, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id") \
        .agg(F.flatten(F.transform(ordered, lambda s: s["ids"])).alias("input_ids"))
