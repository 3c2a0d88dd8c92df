"""Byte-level BPE against tiktoken, packing against tokenizers and the packing rules."""

from __future__ import annotations

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillpanel.llm import byte_bpe, packing

from .conftest import odd_texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "É", "ß", "'s", "'LL", " ", "  ", "\n", "\t", " ", "\x1c", "　", "12", "½", "!?", "=====", "日本", "😀",
         "\x00", "the", "é", "İ", "Σ", "ſ", "word.", "|"]


def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixtures(n: int) -> list[str]:
    rng = random.Random(9)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_encoder_on_mixtures():
    encoder, want = byte_bpe.Encoder(byte_bpe.Ranks(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN), reference()
    texts = [*mixtures(1500), "a" * 3000, " " * 2000, "=" * 4000 + "x", "ab" * 900]
    for got, text in zip(encoder.encode(texts), texts):
        assert np.frombuffer(got, "<i4").tolist() == want.encode_ordinary(text)


def test_round_trip(odd, empty):
    want = reference()
    out = byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(out, RANKS).select("doc_id", "text", "ids", "decoded", "score").collect()
    assert len(back) == len(odd_texts())
    for r in back:
        assert r.ids == want.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode() and r.score == "z"
    both = byte_bpe.encode_and_decode(odd, RANKS, public_tokenizers.PATTERN).select("ids", "decoded").collect()
    assert sorted((r.ids, bytes(r.decoded)) for r in both) == sorted((r.ids, bytes(r.decoded)) for r in back)
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_chunks_on_mixtures():
    chunks, want = packing.Chunks(open(WORDS, encoding="utf-8").read()), Tokenizer.from_file(WORDS)
    texts = mixtures(1500)
    for got, text in zip(chunks.encode(texts), texts):
        assert np.frombuffer(got, "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


def test_markers_of_the_vocabulary():
    """Added tokens are taken out before the split, whatever they stand beside; a part or other case of one is plain text."""
    chunks, want = packing.Chunks(open(WORDS, encoding="utf-8").read()), Tokenizer.from_file(WORDS)
    marks = [t.content for t in want.get_added_tokens_decoder().values()]
    assert sorted(marks) == ["<|endoftext|>", "<|startoftext|>"]
    texts = [form.replace("{}", m) for m in [*marks, marks[0].upper(), marks[1][:-1], marks[0][1:]]
             for form in ("{}", "a {} b", "a{}b", "É{}.", "12{}\n{}'s", "日{}本", "{}{}", "<{}>", "İ{}ſ x{}")]
    encoded = chunks.encode(texts)
    for got, text in zip(encoded, texts):
        assert np.frombuffer(got, "<u4").tolist() == want.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(chunks.encode([f"a {marks[0]} b"])[0], "<u4").tolist().count(want.token_to_id(marks[0])) == 1


def expected_pieces(capacity: int) -> list[tuple]:
    want, out = Tokenizer.from_file(WORDS), []
    for i, text in odd_texts():
        ids = [*want.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a:a + capacity], dtype="<u4")
            out.append((-1 if i is None else i, k, a, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


@pytest.mark.parametrize("slice_rows", [packing.SLICE_ROWS, 3])
def test_pieces_and_sequences(odd, monkeypatch, slice_rows):
    monkeypatch.setattr(packing, "SLICE_ROWS", slice_rows)
    rows = packing.pack_documents(odd, WORDS).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
                  for r in rows) == expected_pieces(packing.CAPACITY)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(sequences) <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_empty_table_packs_to_nothing(empty):
    assert packing.pack_documents(empty, WORDS).count() == 0


def best_fit(lengths: list[int], capacity: int) -> int:
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(2)
    for trial in range(60):
        capacity = rng.choice([10, 64, 500])
        lengths = [rng.randint(1, capacity) if trial % 3 else rng.choice([1, 3, capacity // 2]) for _ in range(rng.randint(1, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used, placed = set(), {}
        for length, rank, pieces, first, each, offset in packing.sweep(counts, capacity):
            placed.setdefault(length, []).extend(range(rank, rank + pieces))
            used |= {(first + i // each, offset + i % each * length + j) for i in range(pieces) for j in range(length)}
        assert all(placed[n] == list(range(c)) for n, c in counts.items())
        assert len(used) == sum(lengths) and max(at for _, at in used) < capacity  # nothing overlaps
        assert len({s for s, _ in used}) == best_fit(lengths, capacity)
