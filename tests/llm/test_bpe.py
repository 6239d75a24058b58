import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from recordlens.llm import bpe
from tests.llm.conftest import TOKENIZER

SIGNS = [*"abcdeABCDEstmdlrHJTWY'’ ,.!?;-_019\n\t\r\x0b\x1c\x85\xa0　᠎İıΣςσßẞÉñÑçŒæ中文한हि",
         *"̧̱́̈̇̌̊", *"दابجд…—“€😀‍ﬁﬀǅǆ<|endoftext|>",
         "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " the ", " in", "ing ", "it's"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(TOKENIZER)


def expected(plain, text):
    ids = plain.encode(text or "", add_special_tokens=False).ids
    return ids, plain.decode(ids, skip_special_tokens=False)


def same(plain, texts):
    encoder = bpe.Encoder(TOKENIZER)
    coded = encoder.encode(texts)
    for text, ids, back in zip(texts, coded, encoder.decode(coded), strict=True):
        assert (np.frombuffer(ids, "<u4").tolist(), back.decode()) == expected(plain, text)


def test_fuzzed_texts(plain):
    pick = random.Random(5)
    same(plain, ["".join(pick.choices(SIGNS, k=pick.randint(0, 40))) for _ in range(10_000)])
    same(plain, ["".join(chr(pick.choice((pick.randint(0, 0x2fff), pick.randint(0xe000, 0x1ffff))))
                         for _ in range(pick.randint(1, 30))) for _ in range(5_000)])


def test_odd_and_long_texts(plain):
    same(plain, [None, "", " \n", "aaaa aaaaaaa aaa", "<|endoftext|>", "x<|endoftext|>y z",
                 "İ, b", "ΑΣ Σ ΟΔΟΣ.", "H̱ J̌.", "\x1c a\x85b", "ab" * 60_000,
                 "a" * 99_999, "日本語" * 5_000, "word, " * 50_000])


def test_memory_of_pieces_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "BLOCK_SYMBOLS", 12)
    encoder = bpe.Encoder(TOKENIZER)
    for _ in range(3):
        for texts in (["one two three", "four five six seven"], ["two eight", None, "x" * 70]):
            coded = [np.frombuffer(c, "<u4").tolist() for c in encoder.encode(texts)]
            assert coded == [expected(plain, t)[0] for t in texts]


def test_table(plain, odd_docs, no_docs):
    def sha(data):
        return hashlib.sha256(data).hexdigest()

    found = [tuple(r) for r in bpe.round_trip(odd_docs, TOKENIZER).collect()]
    wanted = []
    for r in odd_docs.collect():
        ids, text = expected(plain, r.text)
        wanted.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()),
                       sha(text.encode())))
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert bpe.round_trip(no_docs, TOKENIZER).count() == 0


def test_ids_and_texts(plain, odd_docs):
    coded = bpe.encode(odd_docs, TOKENIZER)
    assert sorted((str(r.doc_id), r.ids) for r in coded.collect()) == sorted(
        (str(r.doc_id), expected(plain, r.text)[0]) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(coded, TOKENIZER).collect()) == sorted(
        (str(r.doc_id), expected(plain, r.text)[1]) for r in odd_docs.collect())


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder("/opt/tokenizers/byte_bpe_50k.json")
