import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from recordlens.llm import packing
from tests.llm.conftest import TOKENIZER


def expected_pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    out = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for n, i in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[i:i + capacity], "<u4").tobytes()
            out.append((doc, n, i, len(part) // 4, zlib.crc32(part)))
    return out


def key(row):
    return tuple(-1 if v is None else v for v in row)


def check(rows, df, capacity, **options):
    placed = packing.pack(df, TOKENIZER, capacity, **options).collect()
    found = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed]
    assert sorted(found, key=key) == sorted(expected_pieces(rows, capacity), key=key)
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in placed)


def test_pieces_and_places(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(rows, odd_docs, 512)
    check(rows, odd_docs.repartition(7), 64, fan_in=2)


def test_ids_are_the_plain_tokenizers():
    """Fuzzed: letters whose lower case or normal form is more than a letter, special tokens."""
    pick, tokenizer = random.Random(7), Tokenizer.from_file(TOKENIZER)
    signs = [*"abHJTWYi İıΣß,.!'-7é\n\u0307\u0331\u030c\u0301क़ǅﬁ\xa0\x85", "<|endoftext|>",
             "<|ENDOFTEXT|>", "xİ. y", "it's", " the "]
    texts = ["".join(pick.choices(signs, k=pick.randint(0, 30))) for _ in range(10_000)]
    texts += ["İ, b", "xİ. y", "İ! x", "a<|endoftext|>. b", "H\u0331. J\u030c, x"]
    for text, ids in zip(texts, packing.token_bytes(texts, TOKENIZER), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(
            text, add_special_tokens=False).ids


def test_table_is_packed_tightly(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bins, tokens = check(rows, docs.repartition(8), 4096)
    assert bins <= 1.05 * tokens / 4096 + 1


def test_sequences_hold_the_ids(docs):
    few = docs.limit(40)
    placed = packing.pack(few, TOKENIZER, 1024)
    made = packing.sequences(few, placed, TOKENIZER, 1024).collect()
    assert sum(len(r.input_ids) for r in made) == sum(r.length for r in placed.collect())
    by_id = {r.sequence_id: r.input_ids for r in made}
    for r in placed.collect():
        part = np.array(by_id[r.sequence_id][r.offset:r.offset + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32


def test_best_fit_is_best_fit():
    lengths = np.array([6, 5, 5, 4, 3, 3, 2, 2])
    bins = packing.best_fit(lengths, 10)
    assert np.bincount(bins, lengths).tolist() == [10, 10, 10]


def test_no_documents(no_docs):
    assert packing.pack(no_docs, TOKENIZER).count() == 0
