"""Byte-level BPE of a tokenizer file against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillpanel.llm import pair_merges as pm
from quillpanel.llm.queries import QUERIES

from ..conftest import SMALL
from .conftest import odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "É", "ß", "'s", "'LL", " ", "  ", "\n", "\t", " ", "\x1c", "　", "12", "½", "!?", "=====", "日本", "😀",
         "\x00", "the", "é", "İ", "Σ", "ſ", "word.", "|", "<|endoftext|>", "<|endof", "՘", "\U00010940", "undisestablished" * 5]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return pm.Model(open(PATH, encoding="utf-8").read())


def ids_of(found: bytes) -> list[int]:
    return np.frombuffer(found, "<i4").tolist()


def test_mixtures_and_long_words(library, model):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 2000, "=" * 4000 + "x", "ab" * 9000, "é" * 65, ""]
    for got, text in zip(model.encode(texts), texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(got) == want
        assert model.decode(want) == library.decode(want, skip_special_tokens=False)


def test_classes_below_the_settled_character(library):
    split = pm.regex.compile(pm.SPLIT)
    for at in range(ord(pm.SETTLED)):
        text = f"a{chr(at)}a1{chr(at)}1 {chr(at)}!{chr(at)}!"
        assert [m.span() for m in split.finditer(text)] == [s for _, s in library.pre_tokenizer.pre_tokenize_str(text)]


def test_both_trees_agree(model):
    rng = random.Random(5)
    words = ["".join(rng.choice("abethinrso ") for _ in range(rng.randint(2, 64))).encode() for _ in range(400)]
    short = pm.word_ids(words, model.merges)
    assert short == [pm.lone_tree(w, model.merges) for w in words]


def test_long_texts_in_slices(library, monkeypatch):
    monkeypatch.setattr(pm, "SLICE", 400)
    monkeypatch.setattr(pm, "WORDS", 7)
    monkeypatch.setattr(pm, "CACHE", 50)
    small = pm.Model(open(PATH, encoding="utf-8").read())
    rng = random.Random(8)
    base = " ".join("".join(rng.choice(PARTS[:25]) for _ in range(4)) for _ in range(900))
    for text in (base, base + "日本", "x!" * 2000, base.encode("ascii", "ignore").decode(), base + "<|endoftext|>" + base):
        assert ids_of(small.encode([text, "tail"])[0]) == library.encode(text, add_special_tokens=False).ids
    assert "".join(pm._segments(base, 50)) == base and len(list(pm._segments(base, 50))) > 20


def test_unknown_ids_and_broken_text(library, model):
    for ids in ([], [50256], [50257, 5], [188, 97], [220, 50256, 188], list(range(256))):
        assert model.decode(ids) == library.decode([i for i in ids if i <= 50256], skip_special_tokens=False)


def test_other_files_are_refused():
    file = json.load(open(PATH, encoding="utf-8"))
    file["model"]["dropout"] = 0.1
    with pytest.raises(ValueError):
        pm.Merges(json.dumps(file))


def test_frames(library, odd, empty):
    out = pm.encode(odd, PATH, decoded="decoded")
    rows = out.select("text", "ids", "decoded", "score").collect()
    assert len(rows) == len(odd_texts())
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
        assert r.score == "z"
    back = pm.decode(pm.encode(odd, PATH), PATH).select("text", "decoded").collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == len(rows)
    assert pm.encode(empty, PATH).count() == 0 and pm.decode(pm.encode(empty, PATH), PATH).count() == 0


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op13_pair_merges"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
