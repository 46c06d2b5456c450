"""Packed sequences against the vocabulary's own encoder and a plain walk over the pieces."""

import random
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from parlance.llm import packing

RNG = random.Random(4)
TEXTS = [
    None, "", "   \n\t ", "The quick brown fox's 12 tests, don't <|endoftext|> x", "\x1c.\x1d a\xa0b c é ỄİΣς", " ̈x\x00y 日本語 한국어 🙂🙂",
    "z" * 5000 + " tail", "A.B,c!!? 3.5 it's. DON'T'S! É.È ×÷ <|ENDOFTEXT|> End<|startoftext|>.X ÀÉß ªº Ǆ ﬀ 'Sx", " ".join(RNG.choice(["alpha", "Beta", "naïve", "x9", "--", "ﬁ"]) for _ in range(20000)),
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "a", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "b", 2), (None, "no id", "c", 3), (None, None, "d", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length int").repartition(3, "start")


@lru_cache(1)
def coder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def encoded(text):
    return [*coder().encode(text or "", add_special_tokens=False).ids, packing.END]


@pytest.mark.parametrize("length", [7, 4096])
def test_every_token_lies_in_one_piece(documents, length, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 1000)
    pieces = packing.pack_documents(documents, length=length).collect()
    want = {(r.doc_id, r.text): encoded(r.text) for r in documents.collect()}
    total = sum(len(want[r.doc_id, r.text]) for r in documents.collect())
    spots = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    walked = 0
    for sequence, offset, size in spots:  # gapless from the first token to the last
        assert sequence * length + offset == walked and offset + size <= length
        walked += size
    assert walked == total
    for p in pieces:
        ids = struct.unpack(f"<{p.length}I", p.tokens)
        assert p.ids_crc32 == zlib.crc32(p.tokens)
        assert any(len(w) == p.doc_tokens and tuple(w[p.start : p.start + p.length]) == ids for (i, _), w in want.items() if i == p.doc_id)
    of = defaultdict(int)
    for p in pieces:
        of[p.doc_id] += p.length
    assert of[3] == 2 * len(encoded(TEXTS[3])) and of[1] == 1 and of[None] == len(encoded("no id")) + 1


def test_sequences_are_padded_unless_a_power_of_two(spark, documents):
    pieces = packing.pack_documents(documents, length=4096)
    done = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert [r.n_tokens for r in done[:-1]] == [4096] * (len(done) - 1)
    for r in done:
        assert len(r.tokens) == 4 * r.padded and r.padded in (4096, r.n_tokens)
        assert r.tokens[4 * r.n_tokens :] == bytes(4 * (r.padded - r.n_tokens))
    small = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.n_tokens, r.padded) for r in packing.sequences(packing.pack_documents(small)).collect()] == [(2, 2)]


def test_no_documents_have_no_pieces(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty).count() == 0


def test_words_of_tables_are_the_vocabulary_s_own(spark):
    rng = random.Random(6)
    words = packing.Words(packing.vocabulary_path())
    letters = "aZé.ß,!?'s re' 9\u0301İΣς\x1c\xa0<|-\tÀ×"
    for text in ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]:
        got = words.encode([text.encode()])[0]
        assert list(struct.unpack(f"<{len(got) // 2}H", got)) == encoded(text)[:-1], text


def test_words_forget_and_still_encode(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    words = packing.Words(packing.vocabulary_path())
    for text in ("a b c d e", "b x", TEXTS[3], "b " + "q" * 200):
        got = words.encode([text.encode()])[0]
        assert [int.from_bytes(got[i : i + 2], "little") for i in range(0, len(got), 2)] == encoded(text)[:-1]
    assert not any(len(w) > packing.WORD_BYTES for w in words.known)
