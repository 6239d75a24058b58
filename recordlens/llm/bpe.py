"""Byte-pair encoding and decoding of whole texts.

The words of many texts are merged together: an index maps each pair of neighbouring symbols to
all places where it stands, ranks that have places are applied in ascending order, and each merge
enters the new pairs beside it into the lists of their ranks.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm import words as W

#: Pieces between spaces that a Python worker remembers with their ids.
REMEMBERED = 400_000
#: Symbols that are merged together.
BLOCK_SYMBOLS = 2_000_000
#: Lower-case letters, runs of which are a word, and stay as they are.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xdf, 0xf7), *range(0xf8, 0x100)]))
#: White space of any kind but the space, or a former one: such pieces are normalised alone.
ODD = re.compile("[^\\S ]|᠎")
#: Distinct texts or pieces of a text beyond this length are not remembered.
LONG = 64


class Encoder:
    """Ids of the tokenizer in a file of the ``tokenizers`` library, and texts of ids.

    Its normaliser and the rule that cuts texts into words are the library's own. Every symbol
    must be known, a merge's parts must come from earlier merges, and added tokens are searched
    for in the text as it is; another kind of file raises ValueError.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, added = described["model"], described["added_tokens"]
        plain = not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "byte_fallback",
            "ignore_merges"))
        if model["type"] != "BPE" or not plain or described.get("decoder") or any(
                t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"not a plain BPE tokenizer: {path}")
        tokenizer = Tokenizer.from_file(path)
        self.normalise = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.suffix, self.ids = model.get("end_of_word_suffix") or "", model["vocab"]
        self._index_merges([m if isinstance(m, list) else m.split(" ") for m in model["merges"]])
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(longest_first)})" if self.added else r"(?!)()")
        self.unlike = re.compile(self.special.pattern, re.IGNORECASE)
        tokens = {i: t for t, i in (self.ids | self.added).items()}
        # behind every token a space, so that a text is the tokens it takes, but the last space
        self.tokens = pa.array([f"{tokens.get(i, '')} ".encode() if i in tokens else b""
                                for i in range(max(tokens) + 1)], pa.large_binary())
        # may texts be cut into pieces? yes if words hold no space, nor letters with punctuation
        self.spaced = self._words("A1 b-\u00e9, 'c") == [
            w for part in ("a1", "b-\u00e9", ",", "'c") for w in self._words(part)] \
            and len(self._words(LETTERS)) == 1
        self.bytes = {c: w for c in LETTERS for w in [self._words(c)[0]]} if self.spaced else {}
        self.known: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        return [w for w, _ in self.cut(self.normalise(text))]

    def _index_merges(self, merges: list[list[str]]) -> None:
        n = max(self.ids.values()) + 1
        left, right, made = (np.array([self.ids[f(m)] for m in merges], np.int64) for f in (
            lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        maker = np.full(n, -1)
        maker[made] = np.arange(len(merges))
        if len(np.unique(made)) < len(made) or (
                np.maximum(maker[left], maker[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge needs parts of a later one")
        self.left, self.right, self.made, self.room = left, right, made, n
        code = left * n + right
        self.rank_of = np.argsort(code)
        self.codes = code[self.rank_of]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        code = left * self.room + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank_of[at], -1) if len(self.codes) \
            else np.full(len(code), -1)

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        coded, start, size = [], 0, 0
        for end, word in enumerate(words, 1):
            size += len(word)
            if size >= BLOCK_SYMBOLS or end == len(words):
                coded += self._merge(words[start:end])
                start, size = end, 0
        return coded

    def _merge(self, words: list[str]) -> list[bytes]:
        get, suffix = self.ids.__getitem__, self.suffix
        if suffix:
            symbol = np.array([get(c) for w in words for c in (*w[:-1], w[-1] + suffix)],
                              np.int64)
        else:
            symbol = np.array([get(c) for w in words for c in w], np.int64)
        ends = np.cumsum([len(w) for w in words])
        after = np.arange(1, len(symbol) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(symbol) - 1)
        before[np.append(0, ends[:-1])] = -1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Pairs that begin at these places, into the lists of their ranks."""
            rank = self._ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])[:len(rank)])
            for a, b in zip(cuts, np.append(cuts[1:], len(rank)), strict=len(cuts) > 0):
                r = int(rank[a])
                if r not in places:
                    places[r] = []
                    heapq.heappush(active, r)
                places[r].append(at[a:b])

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = places.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            follows = after[at]
            good = (symbol[at] == self.left[r]) & (follows >= 0)
            good &= symbol[follows] == self.right[r]
            at = at[good]
            if self.left[r] == self.right[r] and len(at) > 1:
                at = _apart(at, after)
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone], after[at] = self.made[r], -1, beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            ahead = before[at]
            touched = np.concatenate([ahead[ahead >= 0], at[inner]])
            if len(touched):
                enter(touched)
        kept = symbol >= 0
        ids = symbol[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept)[ends - 1]).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces of text. Runs of letters are words already; the others are normalised
        and cut into words, ordinary ones together."""
        words: dict[str, int] = {}
        number = lambda w: words.setdefault(w, len(words))
        simple, rest = [], []
        for p in pieces:
            (simple if self.spaced and p and not p.strip(LETTERS) else rest).append(p)
        spell = self.bytes.__getitem__
        parts = [[number(p if p.isascii() else "".join(map(spell, p)))] for p in simple]
        easy = [p for p in rest if self.spaced and p and not ODD.search(p)
                and not self.special.search(p)]
        forms = self.normalise("\n".join(easy)).split(" ") if easy else []
        if len(forms) == len(easy) > 0:
            own: list[list[int]] = [[] for _ in forms]
            ends, cut = np.cumsum([len(f) + 1 for f in forms]), self.cut(" ".join(forms))
            at = np.searchsorted(ends, [start for _, (start, _) in cut], "right").tolist()
            for (word, _), n in zip(cut, at, strict=True):
                own[n].append(number(word))
            parts += own
            simple += easy
        for p in set(rest).difference(simple):
            simple.append(p)
            parts.append([])  # word numbers, or ~id of an added token
            for n, text in enumerate(self.special.split(p)):
                if n % 2:
                    parts[-1].append(~self.added[text])
                elif text:
                    parts[-1].extend(map(number, self._words(text)))
        coded = self.merge(list(words)) if words else []
        return {p: coded[own[0]] if len(own) == 1 and own[0] >= 0 else
                b"".join(coded[n] if n >= 0 else np.uint32(~n).astype("<u4").tobytes()
                         for n in own) for p, own in zip(simple, parts, strict=True)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        if self.spaced:
            cut = [W.pieces(t or "", not t or not self.unlike.search(t)) for t in texts]
        else:
            cut = [[t] if t else [] for t in texts]
        known = self.known
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*cut)
        fresh = self._encode_pieces(list(new))
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= LONG)
        if len(fresh) and max(map(len, fresh)) > LONG:
            get = {**known, **fresh}.__getitem__
        else:
            get = known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The text of each list of ids, in UTF-8; special tokens stay."""
        ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
        taken = self.tokens.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:][ends].tolist() \
            if ends[-1] else [0] * len(ends)
        data = memoryview(taken.buffers()[2]) if ends[-1] else b""
        return [bytes(data[a:max(a, b - 1)]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places of a pair of equal symbols, ascending: from the left, those that share none."""
    chained = np.append(False, after[at[:-1]] == at[1:])
    start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - start) % 2 == 0]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for batch in batches:
        for part in W.blocks(batch, 1):
            yield part.column(0), part.column(1).to_pylist()


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id and ids: every row's whole text as the tokenizer's ids, without special tokens
    around it. Strings of special tokens in a text become their ids. Null and empty texts have
    no ids; repeated rows stay; an empty table gives no rows; other columns are ignored. A text
    is never cut, so a row's memory grows with its text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            coded = encoder(tokenizer).encode(texts)
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return _input(docs, id_col, text_col).mapInArrow(work, "doc_id long, ids array<int>")


def decode(coded: DataFrame, tokenizer: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """doc_id and text: the tokens of the ids with a space between them, special ones included.
    Null lists count as empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [np.array(i or [], "<u4").tobytes() for i in part.column(1).to_pylist()]
                texts = pa.array(encoder(tokenizer).decode(ids), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["doc_id", "text"])

    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode`` and ``decode`` in one step, where
    only digests leave the task. Rows as in ``encode``."""
    def digests(values: list[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            coded = encoder(tokenizer).encode(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, pc.cast(pa.array([len(c) // 4 for c in coded]), pa.int64()),
                 digests(coded), digests(encoder(tokenizer).decode(coded))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs, id_col, text_col).mapInArrow(
        work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
