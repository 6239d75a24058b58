"""Exact removal of repeated passages by a sparse suffix array over content-defined segments.

A suffix per byte would be many times the text. Instead, every run of ``length`` bytes (a window)
is assigned to its anchor: the ``GRAM`` bytes in it with the least hash. Equal windows have equal
anchors, wherever they are. The windows of one anchor follow each other and form a segment, about
one per twenty bytes; a text is a sequence of these tokens, and a suffix begins at each.

1. Suffixes are ordered by (anchor, segment, document). Splitters from a sample deal them out by
   range, so that one passage in very many documents is spread over many buckets. A bucket sorts
   its own by multikey sort, one token after the other and only where the former tie, and
   compares neighbours: a segment that a smaller document has too is settled as a whole.
2. What is left can only share some windows of a segment. These fall in three thirds, by where in
   the window the anchor lies; the windows of a third have some bytes around the anchor in common.
   Where another document has the same, and for anchors with more suffixes than a bucket, the
   windows are compared one by one. They are dealt by their anchor and third, so that a run of them
   stays together and a window takes little more than its hash on the way; what would still take
   more than a share of the text goes in several passes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.scratch import Scratch

GRAM = 12
#: Bits of a position within a block; blocks are a little smaller.
POSITION_BITS = 18
BLOCK = (1 << POSITION_BITS) - 4096
#: Suffixes for which a bucket is planned, and the most buckets.
BUCKET_SUFFIXES = 600_000
MOST_BUCKETS = 100_000
#: Suffixes gathered in the sample for the splitters, at most (bounds the driver's memory).
SAMPLE = 1_000_000
#: Bytes of text that a task holds before it sends suffixes on.
FLUSH_BYTES = 8 << 20
SUFFIXES = ("bucket int, keys binary, segs binary, sides binary, places binary, docs binary, "
            "versions binary, counts binary")
_FIELDS = [c.split()[0] for c in SUFFIXES.split(", ")]
SETTLED, OPEN = 0, 1
#: Bits of a side, and of a key as it is sent.
SIDE_BITS, KEY_BITS = 21, 40
#: Windows for which a bucket is planned, and that a task holds before it sends them on.
BUCKET_WINDOWS, FLUSH_WINDOWS = 1_000_000, 250_000
#: Bytes of the hashes sent in a pass, at most: this share of the text's, or so many.
PASS_SHARE, PASS_BYTES = 0.4, 64 << 20
WINDOWS = ("bucket int, hashes binary, docs binary, versions binary, firsts binary, "
           "reaches binary, counts binary")
_WINDOW_FIELDS = [c.split()[0] for c in WINDOWS.split(", ")]

_U = np.uint64
_MIX, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_FACTOR = 0x2545F4914F6CDD1D
_TABLE = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:8] for i in range(256)), "<u8")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _cache:
        n = (1 << POSITION_BITS) + 256
        _cache["up"] = _powers(_FACTOR, n)
        _cache["down"] = _powers(pow(_FACTOR, -1, 1 << 64), n)
    return _cache["up"], _cache["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(29))) * _MIX2
    return h ^ (h >> _U(32))


def _thirds(length: int) -> tuple[int, int]:
    """From how many bytes between a window's start and its anchor it is of the middle third,
    and from how many of the left one."""
    width = length - GRAM + 1
    return width // 3, 2 * width // 3


def block_segments(data: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of a block of concatenated texts; ``doc`` numbers the text of every byte.

    Returns first and last window start, anchor, key, segment hash, and for the left, middle and
    right third the hash of the bytes that all its windows hold (0 without such windows).
    """
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (int, int, int, _U, _U, _U, _U, _U))
    up, down = _power_tables()
    width = length - GRAM + 1
    near, far = _thirds(length)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * down[:len(data)], out=sums[1:])

    def gram(start: np.ndarray, size) -> np.ndarray:
        return (sums[start + size] - sums[start]) * up[start]

    hashes = _mixed((sums[GRAM:] - sums[:-GRAM]) * up[:len(data) - GRAM + 1])
    low = _U((1 << POSITION_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=_U)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(data) - length + 1
    least = np.minimum(least[:n], least[width - span:width - span + n])
    anchor = (least & low).astype(np.int64)
    valid = doc[:n] == doc[length - 1:]
    change = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])]
    first = np.flatnonzero(change)
    last = np.r_[first[1:], n] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    anchor = anchor[first]
    size = last - first + length
    seg = _mixed(gram(first, size) + size.astype(_U) * _MIX)
    sides = []
    for has, before, after in zip(_has_thirds(anchor - first, last - first, length),
                                  (far, near, 0), (0, width - far, width - near), strict=True):
        side = np.zeros(len(first), _U)
        side[has] = _mixed(gram(anchor[has] - before, before + GRAM + after))
        sides.append(side)
    return first, last, anchor, hashes[anchor], seg, *sides


def _has_thirds(reach: np.ndarray, further: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Whether a segment has windows of the left, middle and right third. The anchor lies
    ``reach`` bytes behind the first window start; ``further`` windows follow that one."""
    near, far = _thirds(length)
    return reach >= far, (reach >= near) & (reach - further < far), reach - further < near


def suffixes(texts: list[memoryview | bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of several texts: text number, place, key, segment hash, sides (SIDE_BITS bits each).
    A place is the first window start, the number of further ones and the anchor's distance."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    found = []
    for at in range(0, len(data), BLOCK):
        end = min(at + BLOCK + length - 1, len(data))
        first, last, anchor, key, seg, *sides = block_segments(data[at:end], doc[at:end], length)
        number = doc[at + first]
        place = ((at + first - starts[number]) << 12 | (last - first) << 6 | (anchor - first))
        left, middle, right = (x >> _U(64 - SIDE_BITS) for x in sides)
        found.append((number, place, key, seg,
                      left << _U(2 * SIDE_BITS) | middle << _U(SIDE_BITS) | right))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int32, np.int64, _U, _U, _U))
    return tuple(np.concatenate(c).astype(t) for c, t in zip(
        zip(*found, strict=True), (np.int32, np.int64, _U, _U, _U), strict=True))


def _composite(key: np.ndarray, seg: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sort key of fixed width in byte order; the sign of a document id is shifted."""
    out = np.empty(len(key), [("k", ">u8"), ("s", ">u8"), ("d", ">u8")])
    out["k"], out["s"], out["d"] = key, seg, doc.astype(np.int64).view(_U) ^ _U(1 << 63)
    return out.view("S24").ravel()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list]]:
    """Ids, versions and texts, about FLUSH_BYTES at a time."""
    ids, versions, texts, held = [], [], [], 0
    for doc, version, text in zip(*(batch.column(i) for i in range(3)), strict=True):
        ids.append(doc.as_py())
        versions.append(version.as_py())
        texts.append(text.as_buffer())
        held += len(texts[-1])
        if held >= FLUSH_BYTES:
            yield ids, versions, texts
            ids, versions, texts, held = [], [], [], 0
    if ids:
        yield ids, versions, texts


def _grouped(batches) -> Iterator[tuple[list, list, list]]:
    ids, versions, texts, held = [], [], [], 0
    for batch in batches:
        for a, b, c in _texts(batch):
            ids, versions, texts = ids + a, versions + b, texts + c
            held += sum(map(len, c))
            if held >= FLUSH_BYTES:
                yield ids, versions, texts
                ids, versions, texts, held = [], [], [], 0
    if ids:
        yield ids, versions, texts


def splitters(docs: DataFrame, length: int, buckets: int, n_docs: int) -> np.ndarray:
    """Bounds of the buckets from the suffixes of some documents; they steer only where the work
    is done, not what is found."""
    share = min(1.0, max(300.0, 40.0 * buckets) / max(n_docs, 1))
    each = max(8, SAMPLE // max(int(n_docs * share), 1) // 2)

    def work(batches):
        for ids, _, texts in _grouped(batches):
            number, _, key, seg, _ = suffixes(texts, length)
            pick = np.sort(np.random.default_rng(0).permutation(len(key))[:each * len(ids)])
            made = _composite(key[pick], seg[pick], np.array(ids, np.int64)[number[pick]])
            yield pa.RecordBatch.from_pydict({"s": pa.array([made.astype("S24").tobytes()],
                                                            pa.binary())})

    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
                        < int(share * 1_000_000) + 1)
    found = np.sort(np.frombuffer(
        b"".join(r[0] for r in chosen.mapInArrow(work, "s binary").collect()), "S24"))
    at = (np.arange(1, buckets) * len(found)) // buckets
    return _uncut(found[at]) if len(found) else found


def _bound_keys(bounds: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bounds).view([("k", ">u8"), ("rest", "V16")])["k"].astype(_U)


def _uncut(bounds: np.ndarray) -> np.ndarray:
    """A bound on a key that no other bound has moves before the key. Keys that stay cut are those
    of more suffixes than a bucket has."""
    key, out = _bound_keys(bounds), bounds.copy()
    new = key[1:] != key[:-1]
    alone = np.r_[True, new][:len(key)] & np.r_[new, True][:len(key)]
    out.view(np.uint8).reshape(-1, 24)[alone, 8:] = 0
    return out


def _cut_keys(bounds: np.ndarray) -> np.ndarray:
    """Of the keys that bounds cut, KEY_BITS bits."""
    key = _bound_keys(bounds)
    return np.unique(key[1:][key[1:] == key[:-1]] >> _U(64 - KEY_BITS))


def deal(docs: DataFrame, length: int, bounds: np.ndarray) -> DataFrame:
    """Suffixes by bucket, many in a row. Documents come as runs: an id and a count."""
    def work(batches):
        for ids, versions, texts in _grouped(batches):
            number, place, key, seg, sides = suffixes(texts, length)
            doc = np.array(ids, np.int64)
            bucket = np.searchsorted(bounds, _composite(key, seg, doc[number]), "right") \
                if len(bounds) else np.zeros(len(key), np.int64)
            order = np.argsort(bucket.astype(np.int32), kind="stable")
            number, place, key, seg, sides, bucket = (
                x[order] for x in (number, place, key, seg, sides, bucket))
            version = np.array(versions, np.int32)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                runs = np.flatnonzero(np.r_[True, number[a + 1:b] != number[a:b - 1]])
                own = number[a:b][runs]
                rows.append((int(bucket[a]), _short_keys(key[a:b]), seg[a:b].tobytes(),
                             sides[a:b].tobytes(), _thin(place[a:b]), _thin(doc[own]),
                             _thin(version[own]), _thin(np.diff(np.r_[runs, b - a]))))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i == 0 else pa.binary())
                     for i, c in enumerate(zip(*rows, strict=True))], _FIELDS)

    return docs.mapInArrow(work, SUFFIXES)


def _thin(values: np.ndarray) -> bytes:
    """Bytes of integers, as wide as their distance from the least needs; see ``_wide``."""
    values = values.astype(np.int64)
    least = values.min(keepdims=True)
    above = values.view(_U) - least.view(_U)
    kind = np.min_scalar_type(above.max())
    return bytes([kind.itemsize]) + least.tobytes() + above.astype(kind).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    above = np.frombuffer(packed, f"<u{packed[0]}", offset=9).astype(_U)
    return (above + np.frombuffer(packed, _U, 1, 1)).view(np.int64)


def _short_keys(key: np.ndarray) -> bytes:
    """The upper KEY_BITS bits: keys only bring together what may be equal."""
    return (key >> _U(32)).astype(np.uint32).tobytes() + (key >> _U(24)).astype(np.uint8).tobytes()


def _keys(packed: bytes) -> np.ndarray:
    n = len(packed) * 8 // KEY_BITS
    return np.frombuffer(packed, np.uint32, n).astype(_U) << _U(8) \
        | np.frombuffer(packed, np.uint8, n, 4 * n)


def multikey_order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns one after the other, and for each place the number of columns in
    which it agrees with the one before. Rows that differ in a column are not compared again."""
    order = np.argsort(columns[0], kind="stable")
    agree = np.zeros(len(order), np.int8)
    tied = np.arange(len(order))
    for depth, column in enumerate(columns):
        if not len(tied):
            break
        if depth:
            within = np.cumsum(agree[tied] < depth)
            own = order[tied]
            again = np.lexsort((column[own], within))
            order[tied] = own[again]
        value = column[order[tied]]
        same = np.r_[False, (value[1:] == value[:-1]) & (np.diff(tied) == 1)
                     & (agree[tied[1:]] >= depth)]
        agree[tied[same]] = depth + 1
        if depth + 1 < len(columns):
            tied = tied[same | np.r_[same[1:], False]]
    return order, agree


def _shared(key: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows whose (key, side) occurs in two documents at least."""
    out = np.zeros(len(key), bool)
    if len(key):
        both = key << _U(64 - KEY_BITS) ^ side  # of these, equal ones need not be
        order = np.lexsort((doc, both))
        first = np.r_[True, both[order][1:] != both[order][:-1]]
        start = np.flatnonzero(first)
        end = np.r_[start[1:], len(order)] - 1
        out[order] = (doc[order[start]] != doc[order[end]])[np.cumsum(first) - 1]
    return out


def _judge(rows: list[tuple[bytes, ...]], length: int, cut: np.ndarray) -> pa.RecordBatch:
    """Settled and open ranges of window starts of one bucket."""
    counts = [_wide(r[6]) for r in rows]
    key = np.concatenate([_keys(r[0]) for r in rows])
    seg, sides = (np.concatenate([np.frombuffer(r[i], _U) for r in rows]) for i in (1, 2))
    place = np.concatenate([_wide(r[3]) for r in rows])
    doc, version = (np.concatenate([np.repeat(_wide(r[i]), c)
                                    for r, c in zip(rows, counts, strict=True)]) for i in (4, 5))
    order, agree = multikey_order([key, seg, doc])
    edge = np.isin(key[order], cut)
    some = np.flatnonzero((agree > 0) | np.r_[agree[1:] > 0, False] | edge)
    at, agree, edge = order[some], agree[some], edge[some]
    begins = np.flatnonzero(agree < 2)  # a new segment; documents ascend within it
    least = doc[at[begins]][np.cumsum(agree < 2) - 1]
    settled = doc[at] > least
    owners = ~settled
    first, further, reach = place[at] >> 12, place[at] >> 6 & 63, place[at] & 63
    last, anchor = first + further, first + reach
    opened = []
    for i, has in enumerate(_has_thirds(reach, further, length)):
        side = sides[at] >> _U((2 - i) * SIDE_BITS) & _U((1 << SIDE_BITS) - 1)
        third, own = edge & has & owners, np.flatnonzero(owners & has)
        third[own] |= _shared(key[at[own]], side[own], doc[at[own]])
        opened.append(third)
    left, middle, right = opened
    near, far = _thirds(length)
    start = np.where(settled | left, first, np.maximum(
        first, anchor - np.where(middle, far, near) + 1))
    end = np.where(settled | right, last, np.minimum(last, anchor - np.where(middle, near, far)))
    out = settled | left | middle | right
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[at][out]), pa.array(version[at][out].astype(np.int32)),
         pa.array(start[out]), pa.array(end[out]),
         pa.array((anchor - start)[out].astype(np.int32)),
         pa.array(np.where(settled[out], SETTLED, OPEN).astype(np.int32))],
        ["doc_id", "version", "first", "last", "reach", "kind"])


#: Of window starts; the anchor lies ``reach`` bytes behind the first.
RUNS = "doc_id long, version int, first long, last long, reach int"
RANGES = RUNS + ", kind int"


def _by_bucket(dealt: DataFrame, buckets: int, one: Callable[[list[tuple]], pa.RecordBatch],
               schema: str) -> DataFrame:
    """One bucket is held at a time; its rows arrive together."""
    def work(batches):
        held, bucket = [], None
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            for row in zip(*columns, strict=True):
                if row[0] != bucket and held:
                    yield one(held)
                    held = []
                bucket = row[0]
                held.append(row[1:])
        if held:
            yield one(held)

    return dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(work, schema)


def judge(dealt: DataFrame, length: int, buckets: int, bounds: np.ndarray) -> DataFrame:
    cut = _cut_keys(bounds)
    return _by_bucket(dealt, buckets, lambda rows: _judge(rows, length, cut), RANGES)


def _with_text(docs: DataFrame, ranges: DataFrame, how: str,
               fields: tuple[str, ...] = ("first", "last")) -> DataFrame:
    """Documents, texts compressed for the shuffle, with their ranges."""
    def squeeze(batches):
        for batch in batches:
            pack = zstandard.ZstdCompressor(level=3).compress
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([pack(t.as_buffer()) for t in part.column(2)], pa.binary())],
                    ["doc_id", "version", "packed"])

    packed = docs.mapInArrow(squeeze, "doc_id long, version int, packed binary")
    own = ranges.groupBy("doc_id", "version").agg(
        F.collect_list(F.struct(*fields)).alias("ranges"))
    return packed.join(own.hint("shuffle_merge"), ["doc_id", "version"], how)


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """First and last window starts of every row, and what else its ranges have; a null list is
    empty."""
    bounds = np.asarray(column.offsets)
    fields = [np.asarray(column.values.field(i)) for i in range(column.type.value_type.num_fields)]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield tuple(x[a:b] for x in fields)


def _quick(text: bytes, at: np.ndarray, length: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(text[p:p + length]) for p in at.tolist()), _U, len(at)) \
        .view(np.int64)


def _exact(text: bytes, at: np.ndarray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(text[p:p + length], digest_size=16).digest()
                                   for p in at.tolist()]), np.int64).reshape(-1, 2)


def _hash_columns(hashes: np.ndarray) -> list[np.ndarray]:
    hashes = hashes.reshape(len(hashes), -1)
    return [np.ascontiguousarray(hashes[:, i]) for i in range(hashes.shape[1])]


def _found_elsewhere(hashes: list[np.ndarray], doc: np.ndarray,
                     exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each window, whether it counts as found here: if ``exact``, one that a smaller document
    has too, else one that any other has. And whether its document is the least that has it."""
    order, agree = multikey_order([*hashes, doc])
    group = np.cumsum(agree < len(hashes)) - 1
    start = np.flatnonzero(agree < len(hashes))
    least = np.empty(len(doc), bool)
    least[order] = doc[order] == doc[order[start]][group]
    if exact:
        return ~least, least
    end = np.r_[start[1:], len(order)] - 1
    found = np.empty(len(doc), bool)
    found[order] = (doc[order[start]] != doc[order[end]])[group]
    return found, least


def _window_buckets(data: np.ndarray, at: np.ndarray, reach: np.ndarray, length: int) -> np.ndarray:
    """A number that is equal for windows with the same anchor in the same third."""
    grams = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at + reach]
    near, far = _thirds(length)
    out = ((reach >= near).astype(_U) + (reach >= far)) * _MIX2
    for word in np.ascontiguousarray(grams).view(np.uint32).T:
        out = _mixed(out + word)
    return out


def deal_windows(joined: DataFrame, length: int, buckets: int, exact: bool, passes: int,
                 turn: int) -> DataFrame:
    """The hashes of the windows in the ranges, by bucket, many in a row: 64 bits, which say what
    may be equal, or if ``exact`` a digest of 128 bits that stands for the bytes. Of equal ones
    that are held together, only those of the least document go; the others are known as found, and
    come as rows without hashes."""
    hashed = _exact if exact else _quick

    def send(chosen: np.ndarray, hashes: np.ndarray | None, at, reach, row, bucket, doc,
             version) -> pa.RecordBatch:
        chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
        at, reach, row, bucket = (x[chosen] for x in (at, reach, row, bucket))
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
                    | (reach[1:] != reach[:-1] - 1)]
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(chosen)], strict=True):
            new[a] = True
            runs = a + np.flatnonzero(new[a:b])
            rows.append((int(bucket[a]), b"" if hashes is None else hashes[chosen[a:b]].tobytes(),
                         *(_thin(x) for x in (doc[row[runs]], version[row[runs]], at[runs],
                                              reach[runs], np.diff(np.r_[runs, b])))))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32() if i == 0 else pa.binary())
             for i, c in enumerate(zip(*rows, strict=True))], _WINDOW_FIELDS)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, versions, texts, ats, reaches = zip(*held, strict=True)
        text = b"".join(texts)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(held)), [len(x) for x in ats])
        at, reach = np.concatenate(ats), np.concatenate(reaches)
        bucket = _window_buckets(np.frombuffer(text, np.uint8), at + starts[row], reach, length)
        bucket = (bucket % _U(buckets * passes)).astype(np.int64)
        own = np.flatnonzero(bucket // buckets == turn)
        if not len(own):
            return
        at, reach, row, bucket = at[own], reach[own], row[own], bucket[own] % buckets
        doc, version = np.array(docs, np.int64), np.array(versions, np.int64)
        hashes = hashed(text, at + starts[row], length)
        found, least = _found_elsewhere(_hash_columns(hashes), doc[row], exact)
        for chosen, what in ((least, hashes), (found, None)):
            if chosen.any():
                yield send(np.flatnonzero(chosen), what, at, reach, row, bucket, doc, version)

    def work(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held, n_bytes, n_windows = [], 0, 0
        for batch in batches:
            for doc, version, packed, (first, last, reach) in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2),
                    _lists(batch.column(3)), strict=True):
                n = last - first + 1
                at, each = np.unique(np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()),
                                     return_index=True)
                held.append((doc, version, unpack(packed.as_buffer()), at,
                             np.repeat(first + reach, n)[each] - at))
                n_bytes, n_windows = n_bytes + len(held[-1][2]), n_windows + len(at)
                if n_bytes >= FLUSH_BYTES or n_windows >= FLUSH_WINDOWS:
                    yield from flush(held)
                    held, n_bytes, n_windows = [], 0, 0
        if held:
            yield from flush(held)

    return joined.mapInArrow(work, WINDOWS)


def _judge_windows(rows: list[tuple[bytes, ...]], exact: bool) -> pa.RecordBatch:
    """Runs of found windows of one bucket."""
    doc, version, first, reach, count = (
        np.concatenate([_wide(r[i]) for r in rows]) for i in range(1, 6))
    found = np.ones(count.sum(), bool)
    asked = np.repeat(np.concatenate([np.full(len(_wide(r[5])), bool(r[0])) for r in rows]), count)
    if asked.any():
        hashes = np.frombuffer(b"".join([r[0] for r in rows]), np.int64) \
            .reshape(-1, 2 if exact else 1)
        found[asked], _ = _found_elsewhere(_hash_columns(hashes), np.repeat(doc, count)[asked],
                                           exact)
    run = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    picked = np.flatnonzero(found)
    new = np.r_[True, (np.diff(picked) != 1) | (np.diff(run[picked]) != 0)][:len(picked)]
    start = picked[new]
    end = picked[np.r_[new[1:], True][:len(picked)]]
    run, skip = run[start], within[start]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[run]), pa.array(version[run].astype(np.int32)), pa.array(first[run] + skip),
         pa.array(first[run] + within[end]), pa.array((reach[run] - skip).astype(np.int32))],
        [c.split()[0] for c in RUNS.split(", ")])


def found_windows(docs: DataFrame, ranges: DataFrame, length: int, total: int, scratch: Scratch,
                  name: str, exact: bool) -> DataFrame:
    """Runs of those windows in the ranges that other documents have; see ``_found_elsewhere``.
    In as many passes as keep the hashes below a share of the text, ``total`` bytes."""
    windows = ranges.agg(F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0))).first()[0]
    passes = max(1, math.ceil(windows * (16 if exact else 8) / max(PASS_SHARE * total, PASS_BYTES)))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                  windows // passes // BUCKET_WINDOWS + 1)
    joined = _with_text(docs, ranges, "inner", ("first", "last", "reach"))
    out = None
    for turn in range(passes):
        found = scratch.keep(_by_bucket(
            deal_windows(joined, length, buckets, exact, passes, turn), buckets,
            lambda rows: _judge_windows(rows, exact), RUNS), f"{name}/{turn}")
        out = found if out is None else out.unionByName(found)
    return out


def _runs(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Removed runs of bytes: the union of [first, last + length)."""
    if not len(first):
        return []
    order = np.argsort(first)
    start, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.r_[True, start[1:] > end[:-1]]
    return list(zip(start[new].tolist(), end[np.r_[new[1:], True]].tolist(), strict=True))


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    starts, ends = [a for a, _ in runs], [b for _, b in runs]
    return b"".join([text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)])


def removed_windows(docs: DataFrame, length: int, id_col: str,
                    text_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, version, text in bytes), and (doc_id, version, first, last):
    ranges of window starts that a document with a smaller id has too. The version tells rows
    apart that share an id but not the text; it is 0 where no such rows exist."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
                       .alias("text"))
    ids = scratch.keep(rows.select("doc_id", F.octet_length("text").alias("size"),
                                   F.xxhash64("text").alias("hash")), "ids")
    total, n_docs = ids.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    differ = ids.groupBy("doc_id").agg((F.min("hash") != F.max("hash")).alias("differ")) \
        .where("differ AND doc_id IS NOT NULL").limit(1).count()
    version = F.pmod(F.xxhash64("text"), F.lit(1 << 31)).cast("int") if differ else F.lit(0)
    rows = rows.select("doc_id", version.alias("version"), "text")
    named = rows.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull())

    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                 2 * total // (length - GRAM + 2) // BUCKET_SUFFIXES + 1)
    buckets = min(MOST_BUCKETS, wanted)
    bounds = splitters(named, length, buckets, n_docs)
    ranges = scratch.keep(judge(deal(named, length, bounds), length, buckets, bounds), "ranges")

    # few windows are left by the first, so the second can afford digests that stand for their bytes
    alike = found_windows(named, ranges.where(F.col("kind") == OPEN), length, total, scratch,
                          "alike", exact=False)
    repeated = found_windows(named, alike, length, total, scratch, "repeated", exact=True)
    scratch.remove("alike")
    place = ["doc_id", "version", "first", "last"]
    return rows, ranges.where(F.col("kind") == SETTLED).select(*place) \
        .unionByName(repeated.select(*place))


def repeated_passages(docs: DataFrame, length: int = 50, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Finds each byte covered by ``length`` bytes that also start in a document with a smaller
    id. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans.

    Texts are UTF-8 bytes, null ones empty. Rows that share an id never remove each other's
    bytes. Rows without an id are kept whole and remove nothing. An empty table gives no rows;
    other columns are ignored.
    """
    rows, removed = removed_windows(docs, length, id_col, text_col)
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "spans array<struct<start: bigint, end: bigint>>")
    types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct(
        [("start", pa.int64()), ("end", pa.int64())]))]

    def work(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part, out = batch.slice(i, 500), []
                for doc, packed, (first, last) in zip(
                        part.column(0).to_pylist(), part.column(2), _lists(part.column(3)),
                        strict=True):
                    text = unpack(packed.as_buffer())
                    runs = _runs(first, last, length)
                    left = _without(text, runs)
                    out.append((doc, len(text), len(text) - len(left), len(runs),
                                hashlib.sha256(left).hexdigest(),
                                [{"start": a, "end": b} for a, b in runs]))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types,
                                                        strict=True)],
                        [c.split()[0] for c in schema.split(", ")[:5]] + ["spans"])

    return _with_text(rows, removed, "left").mapInArrow(work, schema)


def cut_repeated(docs: DataFrame, length: int = 50, id_col: str = "doc_id",
                 text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The documents without their repeated passages, in the same columns; ``count_col``, if
    there, gets the new number of characters. Of a character that is cut in two nothing stays.
    Documents of which nothing is left go; texts without repeats stay as they are, null ones too.
    """
    _, removed = removed_windows(docs, length, id_col, text_col)
    own = removed.groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("first", "last")).alias("_cut_ranges"),
        (F.min("version") != 0).alias("_cut_named")) \
        .withColumnsRenamed({"doc_id": "_cut_id", "version": "_cut_version"})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    joined = docs.join(own.hint("shuffle_merge"), (F.col(id_col).cast("long") == F.col("_cut_id")) & (
        ~F.col("_cut_named") | (F.pmod(F.xxhash64(text), F.lit(1 << 31)).cast("int")
                                == F.col("_cut_version"))), "left") \
        .select(*[docs[c] for c in docs.columns], "_cut_ranges")
    at = docs.columns.index(text_col)
    count_at = docs.columns.index(count_col) if count_col in docs.columns else None

    def work(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            texts, keep = columns[at].to_pylist(), np.ones(batch.num_rows, bool)
            counts = None if count_at is None else columns[count_at].to_pylist()
            for i, (first, last) in enumerate(_lists(batch.column(batch.num_columns - 1))):
                if len(first):
                    left = _without(texts[i].encode(), _runs(first, last, length))
                    texts[i] = left.decode(errors="ignore")
                    keep[i] = bool(texts[i])
                    if counts is not None:
                        counts[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if counts is not None:
                columns[count_at] = pa.array(counts, columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, docs_names).filter(pa.array(keep))

    docs_names = list(docs.columns)
    return joined.mapInArrow(work, docs.schema)
