"""Rules against repetition within a text, from a suffix array over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words sorted at a time; a longer text is sorted on its own.
BATCH_WORDS = 500_000
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, covered_fraction double, "
          "longest_repeat long, spans array<struct<start: bigint, end: bigint>>, kept boolean")
_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "base_failed", "covered_fraction", "longest_repeat", "spans", "kept"]


def suffix_array(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, those of each text together, and the rank of every suffix by its first
    1, 2, 4, ... words. Prefix doubling; only what is still tied is sorted again."""
    n = len(words)
    key = doc.astype(np.int64) << 32 | words
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, step = [rank], 1
    while not new.all():
        tied = np.flatnonzero(~new | np.r_[~new[1:], False])
        at = order[tied]
        ahead = np.minimum(at + step, n - 1)
        inside = (at + step < n) & (doc[ahead] == doc[at])
        key = rank[at].astype(np.int64) * (n + 1) + np.where(inside, rank[ahead] + 1, 0)
        again = np.argsort(key, kind="stable")
        order[tied], key = at[again], key[again]
        differs = np.r_[True, key[1:] != key[:-1]]
        new[tied] |= differs
        rank = rank.copy()
        rank[order[tied]] = tied[np.flatnonzero(differs)][np.cumsum(differs) - 1]
        levels.append(rank)
        step *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in order; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b, common = order[pair + 1].copy(), order[pair].copy(), np.zeros(len(pair), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) < len(order)
        same = np.zeros(len(pair), bool)
        same[inside] = levels[i][a[inside]] == levels[i][b[inside]]
        a[same] += 1 << i
        b[same] += 1 << i
        common[same] += 1 << i
    lcp[pair + 1] = common
    return lcp


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from there that occurs again in its text:
    the value of the innermost common-prefix interval that holds the suffix."""
    order, levels = suffix_array(words, doc)
    lcp = common_prefixes(order, levels)
    longest = np.zeros(len(words), np.int64)
    longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return longest


def _covered(longest: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Words inside a repeat of at least ``least`` words, or inside its first ``width``."""
    start = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + (longest[start] if width is None else width), -1)
    return np.cumsum(edge[:-1]) > 0


def _counts(text: str, data: bytes) -> tuple[int, int, int]:
    lines = [line for line in data.split(b"\n") if line.split()]
    return (len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)))


def repetition(docs: DataFrame, min_words: int = 10, max_covered: float = 0.3,
               max_longest: int = 100, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Counts, repeated spans and a verdict per document, from its whole text; no shuffle.

    Spans are word ranges: the union of the maximal repeats of at least ``min_words`` words. A
    document that passes the base rules is kept if they cover at most ``max_covered`` of its
    words and the longest repeat has at most ``max_longest`` words. The base rules fail texts of
    under 50 words, and those where over half of the words lie in 3-word windows found again.
    Null and empty texts have no words and fail. Repeated rows are judged alike; other columns
    are ignored.
    """
    def judge(group: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(g[2]) for g in group])
        ends = np.cumsum(sizes)
        longest = np.zeros(0, np.int64)
        if ends[-1]:
            longest = longest_repeats(np.concatenate([g[2] for g in group]),
                                      np.repeat(np.arange(len(group)), sizes))
        three, long = _covered(longest, 3, 3), _covered(longest, min_words)
        rows = []
        for (doc, counts, _), a, b in zip(group, ends - sizes, ends, strict=True):
            n, again = int(b - a), int(three[a:b].sum())
            own = np.flatnonzero(np.diff(np.r_[0, long[a:b].astype(np.int8), 0])).tolist()
            covered = int(long[a:b].sum()) / n if n else 0.0
            most = int(longest[a:b].max(initial=0))
            failed = n < 50 or 100 * again > 50 * n
            rows.append((doc, n, *counts, again, failed, covered, most, [
                {"start": s, "end": e} for s, e in zip(own[::2], own[1::2], strict=True)],
                not failed and covered <= max_covered and most <= max_longest))
        types = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.int64(), pa.list_(
            pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, number = [], 0, {}
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                data = text.encode()
                ids = np.array([number.setdefault(w, len(number)) for w in data.split()],
                               np.int64)
                group.append((doc, _counts(text, data), ids))
                total += len(ids)
                if total >= BATCH_WORDS:
                    yield judge(group)
                    group, total, number = [], 0, {}
        if group:
            yield judge(group)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)) \
        .mapInArrow(work, SCHEMA)
