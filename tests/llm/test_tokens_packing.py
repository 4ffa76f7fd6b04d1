"""Token counts and packing against the tokenizers library itself, and round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tempora.llm import packing, tokens

PIECES = [" ", "  ", "\n", "\t", "a", "Bc", "1", "'s", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "É", "é", "Σ", "İ", "\r", "!", "日本", "　", "'", "  \n ", "\x0b", "\u0085", "😀", "×", "x" * 50, "ß", "ab cd", " Ef"]


def odd(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) for _ in range(n)] + ["", "word " * 5000]


@pytest.mark.parametrize("chunk", [7, 64, 1024])
def test_counts_are_the_librarys(chunk):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path(tokens.VOCABULARY))
    texts = odd(2000, chunk)
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    small = tokens.Transducer(tokenizer, nodes=500)  # most fragments don't fit
    for t in (tokens.Transducer(tokenizer), small):
        assert t.count([x.encode() for x in texts], chunk).tolist() == want
        assert t.count([x.encode() for x in texts], chunk).tolist() == want  # now from what it has learned


def test_ids_are_the_librarys():
    path = packing.vocabulary_path()
    tokenizer, encoder, texts = Tokenizer.from_file(path), packing.Encoder(path), odd(2000, 3)
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.ids(text), np.uint32).tolist() == e.ids


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_takes_the_tightest_window(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 30) for _ in range(200)]
    got = packing.best_fit(lengths, 30)
    rooms: list[int] = []
    want = [(-1, -1)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(room, w) for w, room in enumerate(rooms) if room >= lengths[k]]
        if fits:
            room = min(fits)[0]
            w = got[k][0]  # any window with the least room that holds it
            assert rooms[w] == room
        else:
            w = len(rooms)
            rooms.append(30)
        want[k] = w, 30 - rooms[w]
        rooms[w] -= lengths[k]
    assert got == want


def test_pieces_make_up_every_document(docs_of):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "long " * 6000), (1, "one two three")]
    found = packing.pack(docs_of(rows), packing.vocabulary_path()).collect()
    encoder = packing.Encoder(packing.vocabulary_path())
    for doc_id, text in dict(rows).items():
        ids = encoder.ids(text or "") + (1).to_bytes(4, "little")
        mine = [r for r in found if r.doc_id == doc_id]
        assert {r.doc_tokens for r in mine} == {len(ids) // 4}
        assert sum(r.length for r in mine) == len(ids) // 4 * sum(1 for d, _ in rows if d == doc_id)
        assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in mine)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_counts_of_nulls_and_empty_tables(docs_of):
    path = packing.vocabulary_path(tokens.VOCABULARY)
    assert [tuple(r) for r in tokens.token_counts(docs_of([(1, None), (2, "")]), path).collect()] == [(1, 0, 0), (2, 0, 0)]
    assert tokens.token_counts(docs_of([]), path).collect() == [] and packing.pack(docs_of([]), packing.vocabulary_path()).collect() == []
