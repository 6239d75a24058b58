"""SimHash fingerprints and their links at a small Hamming distance.

Generalised pigeonhole: the bits are grouped so that correlated bits share a group, and group i
is searched at its own threshold t_i, where the sum of (t_i + 1) is the distance plus one. Two
fingerprints within the distance then agree up to t_i bits in some group i. Dynamic programming
picks the thresholds from estimated candidate counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.components import components
from recordlens.llm.scratch import Scratch

BITS = 64
SEED = 42
#: Shingles hashed at a time, which bounds memory for very long texts.
CHUNK = 1 << 16
#: Runs of at most so many fingerprints are compared by offset, longer ones by search.
SHORT_RUN = 32


def fingerprint(text: bytes | None, width: int) -> int:
    """Majority of each bit over the hashes of all shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        columns = [words[i + j:min(i + CHUNK, n) + j] for j in range(min(width, len(words)))]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in
                           map(b" ".join, zip(*columns, strict=True))], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. Only A-Z is lower-cased; words are cut
    at ASCII white space. A null text counts as empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())],
                                             ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary")).mapInArrow(work, "doc_id long, fp long")


def _unpacked(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(">i8").view(np.uint8)).reshape(-1, BITS)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often two bits are set together, over all of them; at most
    one row per bit pair comes to the driver."""
    def work(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _unpacked(batch.column(0).to_numpy()).astype(np.float32)
            total, n = total + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_pydict({"n": [n], "both": [total.ravel().astype(np.int64)]})

    parts = prints.select("fp").mapInArrow(work, "n long, both array<long>") \
        .select("n", F.posexplode("both").alias("pair", "both"))
    rows = parts.groupBy("pair").agg(F.sum("n"), F.sum("both")).collect()
    both = np.zeros(BITS * BITS)
    for pair, _, count in rows:
        both[pair] = count
    return (rows[0][1] if rows else 0), both.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Groups of nearly equal size; each takes, one by one, the bit that correlates most with
    those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, made = list(range(BITS)), []
    for g in range(groups):
        size = len(left) // (groups - g)
        own = [max(left, key=lambda b: corr[b][left].sum())]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: corr[b][own].sum()))
            left.remove(own[-1])
        made.append(sorted(own))
    return made


def _near(agree: np.ndarray, most: int) -> float:
    """Chance that two fingerprints differ in at most ``most`` of some bits."""
    chance = np.r_[1.0, np.zeros(most)]
    for p in agree:
        chance = chance * p + np.r_[0.0, chance[:-1]] * (1 - p)
    return float(chance.sum())


def plan(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Groups with their thresholds, of the least estimated cost: one unit per probe row and per
    candidate pair. A group with threshold -1 is not searched."""
    p = np.diag(both) / max(n, 1)
    agree, best = p * p + (1 - p) * (1 - p), None
    for m in range(2, distance + 2):
        groups = group_bits(both, n, m)
        cost: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:  # cost[k]: k of the distance + 1 units are allocated
            each = [0.0] + [
                n * sum(comb(len(bits), j) for j in range(t + 1))
                + n * n / 2 * _near(agree[bits], t) * sum(comb(len(bits), j) for j in range(t + 1))
                ** (0 if t == 0 else 0.5) for t in range(min(distance, 2) + 1)]
            step: dict[int, tuple[float, list[int]]] = {}
            for k, (c, chosen) in cost.items():
                for units, more in enumerate(each):
                    at = k + units
                    if at <= distance + 1 and (at not in step or c + more < step[at][0]):
                        step[at] = (c + more, [*chosen, units - 1])
            cost = step
        if distance + 1 in cost and (best is None or cost[distance + 1][0] < best[0]):
            best = (cost[distance + 1][0], [
                (b, t) for b, t in zip(groups, cost[distance + 1][1], strict=True) if t >= 0])
    return best[1]


def probes(prints: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (grp, key, fp, rep): a fingerprint's bits of the group, and at a threshold above 0
    also all values at up to that many differing bits."""
    masks = [(np.array([BITS - 1 - b for b in bits], np.uint64), t) for bits, t in chosen]

    def work(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for g, (shifts, t) in enumerate(masks):
                key = np.zeros(len(fp), np.int64)
                for k, s in enumerate(shifts):
                    key |= ((fp >> s) & np.uint64(1)).astype(np.int64) << k
                flips = [sum(1 << b for b in some) for r in range(t + 1)
                         for some in combinations(range(len(shifts)), r)]
                for flip in flips:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fp), g, np.int32)), pa.array(key ^ flip),
                         batch.column(0), batch.column(1)], ["grp", "key", "fp", "rep"])

    return prints.select("fp", "rep").mapInArrow(work, "grp int, key long, fp long, rep long")


def _search(fp: np.ndarray, distance: int) -> np.ndarray:
    """Component of each fingerprint of one run, by breadth-first search over those not yet
    reached; a dense group of copies is reached in a few steps."""
    label, rest = np.full(len(fp), -1), np.arange(len(fp))
    while len(rest):
        queue, name = [rest[0]], rest[0]
        label[name], rest = name, rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(fp[rest] ^ fp[queue.pop()]) <= distance
            found, rest = rest[near], rest[~near]
            label[found] = name
            queue.extend(found.tolist())
    return label


def _stars(keys: np.ndarray, fp: np.ndarray, rep: np.ndarray,
           distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key: every linked rep with the least rep of its component."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    run = np.repeat(np.arange(len(start)), size)
    short, label = size[run] <= SHORT_RUN, rep.copy()
    left, right = [], []
    for off in range(1, int(size[size <= SHORT_RUN].max(initial=1))):
        i = np.flatnonzero(short[:-off] & (run[:-off] == run[off:]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + off]) <= distance]
        left.append(i)
        right.append(i + off)
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        while len(i):
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
    for r in np.flatnonzero(size > SHORT_RUN):
        own = slice(start[r], start[r] + size[r])
        names = _search(fp[own], distance)
        least = np.full(size[r], np.iinfo(np.int64).max)
        np.minimum.at(least, names, rep[own])
        label[own] = least[names]
    linked = label < rep
    return rep[linked], label[linked]


def links(keyed: DataFrame, distance: int) -> DataFrame:
    """Edges (child, parent) that connect what is linked within each bucket: a star per
    component, not all pairs."""
    def work(batches):
        held: list[np.ndarray] = []

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            child, parent = _stars(rows[0], rows[1].view(np.uint64), rows[2], distance)
            return pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent)],
                                              ["child", "parent"])

        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(3)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            ended = np.flatnonzero(held[0] != held[0][-1])
            if len(held[0]) > 100_000 and len(ended):
                end = ended[-1] + 1
                yield out([x[:end] for x in held])
                held = [x[end:] for x in held]
        if held:
            yield out(held)

    return keyed.repartition("grp", "key").sortWithinPartitions("grp", "key") \
        .select((F.col("key") * 64 + F.col("grp")).alias("key"), "fp", "rep") \
        .mapInArrow(work, "child long, parent long").distinct()


def near_components(docs: DataFrame, width: int = 5, distance: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id: the least doc_id reachable over links between
    fingerprints that differ in at most ``distance`` bits; equal ones are linked.

    Null and word-less texts have fingerprint 0 and are linked like any other. Repeated rows
    stay and share a component; a null id never becomes a component's name unless it is alone.
    An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, width, id_col, text_col), "prints")
    reps = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    known = reps.where("rep IS NOT NULL")
    n, both = bit_statistics(known)
    edges = links(probes(known, plan(max(n, 1), both, distance)), distance)
    roots = components(edges, scratch)
    names = reps.join(roots, reps.rep == roots.node, "left") \
        .select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, width: int = 5, distance: int = 3, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of one document per group: the one that names the component. Of rows with the
    same id all stay; documents without an id stay."""
    found = near_components(docs, width, distance, id_col, text_col)
    dropped = found.where(F.col("doc_id") != F.col("component_id")) \
        .select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, F.col(id_col) == F.col("_dropped"), "left_anti")
